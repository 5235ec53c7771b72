"""The corpus operators on small fixtures, against brute force, and on nulls, empty texts, repeats and empty tables."""

import random
import re
import time

import numpy as np
import pytest

from pathloom.llm import decontaminate, htmltext, matroska, pieces, pii, quality, sharding, simhash, substrings, urlfilter

RNG = random.Random(5)
VOCABULARY = ["the", "of", "And", "thor", "ening", "réau", "zu", "x1", "lyhe", "stou", "ble", "tion"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, key int, grp int"


def prose(n):
    return " ".join(RNG.choice(VOCABULARY) + str(RNG.randrange(40)) for _ in range(n))


BASE = prose(60)
TEXTS = [BASE, BASE, BASE + " more", prose(30), None, "", "  \n", "one two", prose(14) + " " + " ".join(BASE.split()[10:30]), prose(300) + " " + BASE, "Mail a.b@c.de or 10.1.2.3 or +1 (555) 123-4567 or 4539578763621486"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 3 == 0 else "en", f"s{i % 2}", None if i == 4 else len(t or ""), 1, 2, 3) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + [rows[0]], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_simhash_links_and_components(docs, nothing):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fps = {i: simhash.fingerprint(t) for i, t in enumerate(TEXTS)}
    assert {i: r.fp for i, r in got.items()} == fps and fps[4] == fps[5] == fps[6] == 0
    root = {i: i for i in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if ((fps[a] ^ fps[b]) & (1 << 64) - 1).bit_count() <= 3:
                    root[a] = root[b] = min(root[a], root[b])
    assert {i: r.component for i, r in got.items()} == root
    assert simhash.near_duplicates(nothing).count() == 0


def test_pigeonring_finds_all_pairs(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        for n in (1, 2, 3, 4, 5):
            x = int(b)
            for k in rng.choice(64, n, replace=False):
                x ^= 1 << int(k)
            fps.add(x)
    fps = sorted(x - (1 << 64) * (x >> 63) for x in fps)
    frame = spark.createDataFrame(list(enumerate(fps)), "id long, fp long")
    expected = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if ((fps[a] ^ fps[b]) & (1 << 64) - 1).bit_count() <= 3}
    assert {(r.a, r.b) for r in simhash.linked(frame).collect()} == expected


def jaccard(a, b):
    a, b = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").lower().split() for t in (a, b)))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_similar_groups(spark, docs, nothing):
    got = {r.doc_id: r.component for r in simhash.similar_groups(docs).collect()}
    assert got[0] == got[1] == got[2] == 0 and got[3] == 3 and got[9] == 9 and got[4] == got[5] == got[6] == 4
    assert simhash.similar_groups(nothing).count() == 0
    texts = [" ".join(f"{RNG.choice(VOCABULARY)}{RNG.randrange(500)}" for _ in range(300)) for _ in range(12)]
    for t in texts[:12]:
        for n in (1, 3, 8, 20, 60):  # copies on both sides of 0.8
            w = t.split()
            for k in RNG.sample(range(300), n):
                w[k] = "new"
            texts.append(" ".join(w))
    root = list(range(len(texts)))
    for a in root:
        for b in range(a):
            if root[a] != root[b] and jaccard(texts[a], texts[b]) >= 0.8:
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, texts[0], 1), (None, "alone", 1)]
    got = {(r.doc_id, r.component) for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string, key int")).collect()}
    assert got == set(enumerate(root)) | {(None, 0), (None, None)}


def components_by_brute_force(texts):
    root = list(range(len(texts)))
    for a in root:
        for b in range(a):
            if root[a] != root[b] and jaccard(texts[a], texts[b]) >= 0.8:
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    return root


def fresh(n):
    return [f"{RNG.choice(VOCABULARY)}{RNG.randrange(500)}" for _ in range(n)]


def test_similar_groups_around_one_original(spark):
    base = fresh(343)
    texts = [" ".join(base)]
    while len(texts) < 50:  # each is like the original only
        w = list(base)
        for k in RNG.sample(range(5, 338), 7):
            w[k] = f"new{RNG.random()}"
        texts.append(" ".join(w))
    RNG.shuffle(texts)
    root = components_by_brute_force(texts)
    got = {r.doc_id: r.component for r in simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert root.count(0) > 40 and got == dict(enumerate(root))


def test_similar_groups_of_block_edits(spark):
    texts = []
    for n in (40, 200, 600):
        for share in (0.04, 0.08, 0.09, 0.1, 0.11, 0.16, 0.2, 0.24, 0.26):  # both sides of 0.8
            base, new = fresh(n), fresh(round(n * share))
            k = RNG.randrange(n - len(new))
            texts += [" ".join(base), " ".join(base + new), " ".join(base[:k] + new + base[k + len(new) :])]
    common = " ".join(fresh(30))  # a passage that many share
    texts = [f"{common} {t}" if i % 2 else t for i, t in enumerate(texts)] + texts
    root = components_by_brute_force(texts)
    got = {r.doc_id: r.component for r in simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(set(root)) < len(root) and got == dict(enumerate(root))


def test_common_shingles_come_last():
    shingles = np.arange(1, 101, dtype=np.uint64)
    order = (np.arange(1, 95, dtype=np.uint64), np.arange(94)[::-1])
    assert simhash.prefix(shingles, *order, 0.8).tolist() == [*range(95, 101), *range(94, 79, -1)]
    assert simhash.prefix(shingles, order[0][:0], order[1][:0], 0.8).tolist() == list(range(1, 22))


def test_similar_pairs_are_exact_and_spread(spark):
    base = [str(k) for k in range(100)]
    texts = [" ".join(base[: 100 - n] + ["x"] * n) for n in range(40)] * 5
    rows = spark.createDataFrame([(i, f"{t} {i // 40}", 0) for i, t in enumerate(texts)] + [(7, "another text of this id", 0)], "doc_id long, text string, a int")
    keys = {r.doc_id: r.key for r in simhash.signatures(rows).filter("doc_id <> 7").collect()}
    pairs = spark.createDataFrame([(keys[0], keys[i], 0, i) for i in keys if i], "a string, b string, id_a long, id_b long")
    got = {r.b for r in simhash.similar_pairs(rows, pairs, 0.8, 5, "doc_id", "text").collect()}
    assert len(keys) > 3 * simhash.SLICE and got == {keys[i] for i in keys if i and jaccard(f"{texts[0]} 0", f"{texts[i]} {i // 40}") >= 0.8}


def test_hilbert_neighbours_touch():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    index = sharding.hilbert(cells, 3)
    path = cells[np.argsort(index)]
    assert sorted(index) == list(range(512)) and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_shards_are_even_and_gapless(docs, nothing):
    rows = sharding.shard_rows(docs, ["lang", "source", "n_chars"], 5).collect()
    by = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(5)}
    assert len(rows) == 12 and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(v == list(range(len(v))) for v in by.values())
    order = [r.curve for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order) and {r.doc_id: r.size for r in rows}[4] == 8
    assert sharding.shard_rows(nothing, ["lang"], 5).count() == 0


def test_url_rules_and_model(spark):
    urls = [None, "no scheme", "http://A.example.ORG/es/1?x", "http://example.org/en/12", "http://x.com/de/1", "https://x.com/fr/2#t", "http://x.org", "http://net/a?b", ""]
    urls += [f"http://news{i}.example.net/story/{i}" for i in range(60)] + [f"http://cheap-pills{i}.example.net/buy/{i}" for i in range(60)]
    rows = {r.page_id: r for r in urlfilter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [(rows[i].host, rows[i].path, rows[i].rule) for i in range(9)] == [("", "", None), ("", "", None), ("a.example.org", "/es/1", "example.org/es/"), ("example.org", "/en/12", "example.org/en/1"), ("x.com", "/de/1", "com/de/"), ("x.com", "/fr/2", "com/fr/"), ("x.org", "", None), ("net", "/a", None), ("", "", None)]
    assert [rows[i].verdict for i in (2, 3, 4, 5)] == ["block", "block", "block", "allow"]
    assert all(rows[i].verdict == "allow" for i in range(9, 69)) and sum(rows[i].verdict == "block" for i in range(69, 129)) > 55
    assert urlfilter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_substrings(docs, nothing):
    got = {r.doc_id: r for r in substrings.remove_repeats(docs).collect()}
    first = {}
    for i, t in enumerate(TEXTS):
        w = words(t)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    for i, t in enumerate(TEXTS):
        w = words(t)
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    assert substrings.remove_repeats(nothing).count() == 0


def test_repeats_in_two_steps_of_the_exchange(spark, monkeypatch):
    """With more buckets than ranges the same places are found as in one step."""
    passages = [prose(20) for _ in range(6)]
    rows = [(i, f"{prose(RNG.randrange(5, 60))} {RNG.choice(passages)} {prose(3)}") for i in range(150)] + [(500, " ".join(f"w{k}" for k in range(70_000)) + " " + passages[0])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)

    def places(buckets, level):
        out = set()
        for r in substrings.repeated_places(frame, buckets, level=level).collect():
            counts = np.frombuffer(r.counts, np.uint32).astype(np.int64)
            out |= set(zip(np.repeat(np.frombuffer(r.ids, np.int64), counts).tolist(), substrings.unpack_places(r.places, counts).tolist()))
        return out

    seen, expected = {}, set()
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 12):
            if seen.setdefault(tuple(w[k : k + 13]), i) != i:
                expected.add((i, k))
    assert len(expected) > 200 and places(8, 1024) == places(5000, 256) == places(700, 512) == expected


def test_a_batch_costs_the_same_however_many_buckets():
    rng = np.random.default_rng(3)
    ids = np.repeat(np.arange(4000), 100)
    args = ids, np.tile(np.arange(100), 4000), rng.integers(0, 1 << 63, len(ids)).astype(np.uint64) * np.uint64(2)
    took = []
    for buckets in (1000, 1_000_000):
        began = time.process_time()
        batch = substrings.dealt(*args, buckets, buckets, ["key", "ids", "counts", "places", "hashes"])
        took.append(time.process_time() - began)
        counts = [np.frombuffer(c.as_py(), np.uint32).astype(np.int64) for c in batch.column(2)]
        assert sum(c.sum() for c in counts) == len(ids)
    assert took[1] < 3 * took[0] + 0.5


def test_personal_data(docs, nothing):
    model = pii.fit(np.zeros((0, pii.FEATURES)), np.zeros(0, bool), np.zeros(0, bool))
    got = {r.doc_id: r for r in pii.find(docs, model, ["doc_id"], redact=True).collect()}
    assert (got[10].n_email, got[10].n_ip, got[10].n_card, got[10].n_phone) == (1, 1, 1, 1) and got[4].redacted is None
    assert got[10].redacted == "Mail <email> or <ip> or <phone> or <card>" and got[0].spans == ""
    assert pii.find(nothing, pii.train(nothing), ["doc_id"]).count() == 0


def test_email_scan_equals_the_pattern():
    for _ in range(3000):
        t = "".join(RNG.choice(list("a1.+@-_ é") + ["b@c.de"]) for _ in range(RNG.randrange(14)))
        assert pii.emails(t) == [m.span() for m in pii.EMAIL.finditer(t)]


def test_boosted_trees_learn_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2, (2000, pii.FEATURES)).astype(float)
    y = (x[:, 3] != x[:, 5]) & (x[:, 7] > 0)
    model = pii.fit(x, y, np.arange(2000) % 4 == 0)
    assert ((pii.probability(model, x) > 0.5) == y).mean() > 0.98


def test_matroska(docs, nothing):
    for n in (1, 576, 577, 5000, 200_000):
        p = bytes(RNG.randrange(256) for _ in range(n))
        found, cues = matroska.parse(matroska.mux(p))
        f = matroska.mux(p)
        assert b"".join(f[x.start : x.start + x.size] for x in found) == p and {x.cluster for x in found} == cues
        assert matroska.parse(f[: len(f) // 2])[0] == [x for x in found if x.start + x.size <= len(f) // 2][: len(matroska.parse(f[: len(f) // 2])[0])]
    for kind in (1, 3):
        frames = [b"a" * n for n in (300, 5, 255, 0, 7000)]
        block = matroska.laced(frames, kind)
        assert matroska.frame_sizes(block, 0, len(block), kind)[0] == [300, 5, 255, 0, 7000]
    rows = matroska.features(matroska.stored(docs), ["doc_id", "n_bytes"]).collect()
    assert len({(r.media_sha256, r.feature) for r in rows if r.doc_id in (0, 1)}) == 1 and {r.payload_bytes for r in rows if r.doc_id in (4, 5)} == {576}
    assert matroska.packets(matroska.stored(docs), "doc_id").filter("cued").count() == sum(r.payload_bytes // 576 for r in rows)
    assert matroska.features(matroska.stored(nothing), ["doc_id"]).count() == 0


def test_pieces_against_all_segmentations(docs):
    model = pieces.load_model()
    encoder = pieces.Encoder(model, 4)

    def every(t, i=0):
        if i == len(t):
            return [0.0]
        out = [model.pieces[t[i:j]][1] + s for j in range(i + 1, min(len(t), i + 16) + 1) if t[i:j] in model.pieces for s in every(t, j)]
        return out + (every(t, i + 1) if t[i] not in model.pieces else [])

    for _ in range(60):
        t = "".join(RNG.choice(["th", "e ", "er", "  ", "a", "é", "\n", "ing", ".", "一"]) for _ in range(RNG.randint(1, 5)))
        u = encoder.encode(t)
        assert [u.score, *(u.score - loss for loss, _ in u.others)] == pytest.approx(sorted(every((" " + t).replace(" ", "▁")), reverse=True)[:4])
        assert all(encoder.decode(x) == t for x in (u.ids, *(o[1] for o in u.others)))
    assert all(r.round_trip for r in pieces.digests(docs, ["doc_id"]).collect())
    e = encoder.encode("a▁b ▁")
    assert encoder.decode(e.ids) == "a▁b ▁"


def test_decontamination(spark, docs, nothing):
    items = spark.createDataFrame([(1, " ".join(BASE.split()[5:25])), (2, "one TWO"), (3, None), (10, " ".join(BASE.split()[12:22])), (4, "!!")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs, items).collect()}
    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    phrases = [(str(r.item_id), tuple(w[k : k + 10])) for r in items.collect() for w in [tokens(r.text)] if w for k in range(max(1, len(w) - 9))]
    for i, t in enumerate(TEXTS):
        w, hit, found = tokens(t), set(), set()
        for item, p in phrases:
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    found.add(item)
        assert (got[i].n_words, got[i].n_hit, got[i].items) == (len(w), len(hit), sorted(found))
    assert decontaminate.contamination(nothing, items).count() == 0 and decontaminate.contamination(docs, items.limit(0)).filter("n_hit > 0").count() == 0
    near = spark.createDataFrame([(1, "one three two")], "doc_id long, text string")
    phrases = decontaminate.phrases_of(items.filter("item_id = 2"), 10)
    assert [decontaminate.search(decontaminate.build_index(near), phrases, slop=s).first().n_hit > 0 for s in (0, 1)] == [False, True]


def test_main_text(spark):
    page = "<html><head><title>T</title></head><body><nav><a href='/'>Home</a></nav><div class='ad'>Buy, buy</div><article><h1>Head &amp; line</h1><p><b>First,  one.<br><p>Second <a href='x'>link</a> text, longer.</p><script>var a='<p>';</script></article><div id='comments'><p>Nice, very nice.</p></div><footer>End</footer></body></html>"
    assert htmltext.main_text(page) == "Head & line First, one. Second link text, longer."
    assert [htmltext.main_text(x) for x in (None, "", "<p>", "plain text")] == ["", "", "", "plain text"]
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string"), ["page_id", "url"]).count() == 0


def test_quality(spark, docs, nothing):
    good = [(i, " ".join(RNG.choice(VOCABULARY) for _ in range(30)) + ".") for i in range(200)]
    bad = [(i, " ".join(RNG.choice(VOCABULARY).upper() + "!!" for _ in range(30))) for i in range(200, 400)]
    both = spark.createDataFrame(good + bad + [(999, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 200)) for i in range(400)], "doc_id long, quality int")
    rows = quality.score(both, quality.train(both, labels), ["doc_id"]).filter("doc_id < 999").collect()
    assert all((r.score >= 0.5) == (r.doc_id < 200) for r in rows)
    assert {r.score for r in quality.score(docs, quality.train(docs, labels.limit(0)), ["doc_id"]).collect()} == {0.5}
    assert quality.score(nothing, quality.train(nothing, labels), ["doc_id"]).count() == 0


def test_quality_fit_is_bounded(spark):
    rows = [(i, " ".join(f"w{RNG.randrange(10**6)}" for _ in range(300)) + ("." if i % 2 else "!!")) for i in range(60)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    few, all_ = (quality.train(docs, labels, max_places=n) for n in (5000, 10**9))
    assert 0 < np.count_nonzero(few["weights"]) <= 7000 < np.count_nonzero(all_["weights"])


@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_a_star_gives_the_best_n_of_all_segmentations(n):
    model = pieces.load_model()
    encoder = pieces.Encoder(model, n)

    def every(t):
        return [(0.0, [])] if not t else [(model.pieces[t[:j]][1] + s, [model.pieces[t[:j]][0], *ids]) for j in range(1, len(t) + 1) if t[:j] in model.pieces for s, ids in every(t[j:])]

    for _ in range(300):
        word = "▁" + "".join(RNG.choice(["th", "er", "a", "é", "ing", "ß", "on", "e"]) for _ in range(RNG.randint(1, 4)))
        all_ = sorted(every(word), key=lambda x: -x[0])
        got = encoder.segmentations(word, n)
        assert [s for s, _ in got] == pytest.approx([s for s, _ in all_[:n]]) and len({ids for _, ids in got}) == len(got)
        scores = {np.array(ids, np.uint32).tobytes(): s for s, ids in all_}
        assert all(scores[ids] == pytest.approx(s) for s, ids in got)
    long = "thereof" * 20_000
    u = pieces.Encoder(model, n).encode(long)
    assert pieces.Encoder(model, n).decode(u.ids) == long and len(u.others) == n - 1 and all(loss >= 0 for loss, _ in u.others)


@pytest.mark.parametrize("n", [1, 2])
def test_every_unit_goes_through_the_search(n):
    """What the query (two segmentations) and the pipeline (one) remember of runs without a cut all came from the A* search."""
    searched = set()

    class Counting(pieces.Encoder):
        def segmentations(self, text, k):
            assert k == n
            searched.add(text)
            return super().segmentations(text, k)

    encoder = Counting(pieces.load_model(), n)
    texts = [*TEXTS, "▁mark", "日本語 unit of 一 signs", "x" * 300, prose(2000)]
    for t in texts:
        assert encoder.decode(encoder.encode(t).ids) == (t or "")
    whole = [p for p in encoder.parts if encoder.alone.issuperset(p) and (len(p) <= pieces.SHORT or all(a + b in encoder.together for a, b in zip(p, p[1:])))]
    assert len(whole) > 100 and set(whole) <= searched
