"""The secret scan against plain loops, on planted tokens and on odd rows."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pathloom.llm import secretscan as scan

RNG = random.Random(12)
SYLLABLES = ["the", "ment", "tion", "ver", "ing", "re", "ou", "lich", "keit", "an", "ble", "st", "qua", "dro"]


def word():
    return "".join(RNG.choice(SYLLABLES) for _ in range(RNG.randrange(1, 9)))


def prose(n):
    return " ".join(word() for _ in range(n))


def drawn(alphabet, n):
    return "".join(RNG.choice(alphabet) for _ in range(n))


def base_spans(text):
    text = text or ""
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24])


def tail(z):
    return 0.5 * math.erfc(z / math.sqrt(2))


def encoding(body):
    if re.fullmatch("[0-9]*", body):
        return None
    return next(((k, a) for k, (_, p, a) in enumerate(scan.ENCODINGS) if re.match(p, body)), None)


def kind(c):
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def battery(body, shares, rate):
    """(random, score) of a token by plain loops."""
    _, alphabet = encoding(body)
    n, k, counts = len(body), len(alphabet), Counter(body)
    x2 = sum((counts[a] - n / k) ** 2 / (n / k) for a in alphabet)
    df = (k - 1) * n / (n - 1)
    v = 2 / (9 * df)
    z1 = ((x2 * n / (n - 1) / df) ** (1 / 3) - (1 - v)) / math.sqrt(v)
    q = 1 - sum((sum(kind(a) == c for a in alphabet) / k) ** 2 for c in range(4))
    changes = sum(kind(a) != kind(b) for a, b in zip(body, body[1:]))
    z2 = (changes - (n - 1) * q) / math.sqrt((n - 1) * q * (1 - q))
    x = [2 * alphabet.index(c) - (k - 1) for c in body]
    z3 = sum(a * b for a, b in zip(x, x[1:])) / ((k * k - 1) / 3 * math.sqrt(n - 1))
    randomly = 6 * min(tail(abs(z)) for z in (z1, z2, z3))
    both_cases = any(c.islower() for c in alphabet) and any(c.isupper() for c in alphabet)
    p = [shares.get(a, 0) if both_cases or not a.isalpha() else shares.get(a.lower(), 0) + shares.get(a.upper(), 0) for a in alphabet]
    p = [y / (sum(p) or 1) for y in p]
    s2, s3 = sum(y**2 for y in p), sum(y**3 for y in p)
    pairs = sum(c * (c - 1) for c in counts.values())
    sd = math.sqrt(max(2 * n * (n - 1) * (s2 + 2 * (n - 2) * s3 - (2 * n - 3) * s2 * s2), 1e-9))
    even = math.log(max(tail((n * (n - 1) * s2 - pairs) / sd), 1e-300))
    a = changes / (n - 1)
    changed = -(n - 1) * ((a * math.log(a / rate) if a else 0) + ((1 - a) * math.log((1 - a) / (1 - rate)) if a < 1 else 0)) if a > rate else 0
    both = -(even + changed)
    return randomly, min(max((both - math.log(1 + both)) / math.log(10) * 100, 0), 30000)


def plainly(texts):
    """Added spans of each text, by plain loops over all of them."""
    words = [w for t in texts for w in re.findall("[A-Za-z0-9+/_-]{8,}", t or "")]
    counts = Counter(c for w in words for c in w)
    total = sum(counts.values())
    if not total:
        return [[] for _ in texts]
    shares = {c: k / total for c, k in counts.items()}
    rate = min(max(sum(kind(a) != kind(b) for w in words for a, b in zip(w, w[1:])) / (total - len(words)), 1e-6), 0.5)
    either = re.compile(f"{scan.ASSIGN}|{scan.TOKEN}")
    held = re.compile(f"^{scan.ASSIGN}$|{scan.ACCESS}|{scan.HEX}")
    free = [[m for m in either.finditer(t or "") if not held.search(m[0]) and encoding(m[0].rstrip("="))] for t in texts]
    facts = {m[0]: battery(m[0].rstrip("="), shares, rate) for ms in free for m in ms}
    group = lambda w: sum(len(w.rstrip("=")) >= k for k in scan.LENGTH_CLASSES[1:])
    least = {}
    for g in range(len(scan.LENGTH_CLASSES)):
        scores = sorted((math.floor(s) for w, (_, s) in facts.items() if group(w) == g), reverse=True)
        for s in set(scores):
            if 10 ** (-s / 100) <= 0.01 * sum(x >= s for x in scores) / len(scores):
                least[g] = min(s, least.get(g, s))
    return [[(m.start(), 3, m.end()) for m in ms if facts[m[0]][0] >= 0.01 and facts[m[0]][1] >= least.get(group(m[0]), 1 << 30)] for ms in free]


ODD = [
    None, "", "secret=token: abcdefgh", "TOKEN = 'abc'", "Api_Key:\"abcdef\" apikey  = x.y/z-+=", "passwd=short", "password==abcdefg", "ſecret=abcdefgh toKen=abcdefgh", "AKIA" + "Z" * 15, "AKIA" + "Z9" * 8, "xAKIAAKIA" + "Q" * 12,
    "0123456789abcdef01234567", "g" + "a" * 23 + "g", "é🙂 token=abcdef é " + "0f" * 12, "deadbeef" * 3 + " " + "deadbeef" * 2, "token=abcdef" + "0f" * 12, "x" * 3000, "=" * 50, "password:\n abcdefg", "Abc/def+" * 40, "1234567890123456 " * 3,
]


def planted():
    tokens = [drawn(scan.ENCODINGS[1][2], n) for n in (32, 40, 64)] + [drawn(scan.ENCODINGS[2][2], n) for n in (32, 52)] + [drawn(scan.ENCODINGS[3][2], n) for n in (32, 40)]
    tokens += [drawn(scan.ENCODINGS[5][2], n) for n in (20, 24, 32, 40, 43, 64, 88, 200, 5000)] + [drawn(scan.ENCODINGS[6][2], n) for n in (20, 24, 32, 43, 86)]
    tokens += [base64.b64encode(RNG.randbytes(n)).decode() for n in (16, 20, 32, 64)] + [base64.urlsafe_b64encode(RNG.randbytes(n)).decode() for n in (16, 32)]
    return tokens * 4


CLEAN = [
    "getHTTPResponseCodeFromServer", "usr/local/share/applications/firefox", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz0123456789", "AAAAAAAAAAAAAAAAAAAAAAAA", "550e8400-e29b-41d4-a716-446655440000", "Donaudampfschifffahrtsgesellschaft",
    "INTERNATIONALIZATION", "first_name_last_name_and_address", "aGVsbG8gaGVsbG8gaGVsbG8gaGVsbG8gaGVsbG8gaGVsbG8g", "2024-01-01_backup_of_everything", "----------------------------", "a-b-c-d-e-f-g-h-i-j-k-l",
]


@pytest.fixture(scope="module")
def texts():
    out = [prose(RNG.randrange(20, 200)) for _ in range(150)] + [prose(30).upper() for _ in range(5)] + [prose(30).title() for _ in range(5)]
    out += [f"{prose(20)} {t} {prose(20)}" for t in planted()] + [f"{prose(20)} {t}, {prose(20)}" for t in CLEAN] + ODD
    long = " ".join(drawn(scan.ENCODINGS[5][2], 30) if k % 3 else f"token={drawn('abcdef', 8)} é" for k in range(1500))
    return [*out, long, prose(20000), out[3], out[-3]]


def test_equals_plain_loops(spark, texts):
    rows = [(i if i % 50 else None, t, 1, "b") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, span int, base string").withColumn("place", F.monotonically_increasing_id()).repartition(3)
    got = sorted(((r.text or "", [tuple(x) for x in r.base], [tuple(x) for x in r.added]) for r in scan.scan(docs.select(F.struct("doc_id", "text").alias("key"), "text"), "key").select("key.text", "base", "added").collect()))
    assert got == sorted((t or "", base_spans(t), a) for t, a in zip(texts, plainly(texts)))


def test_planted_tokens_are_found_and_clean_ones_left(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in scan.scan(docs).collect()}
    n = len(planted())
    hits = sum(bool(found[i].added or found[i].base) for i in range(160, 160 + n))
    assert hits >= 0.9 * n
    clean = [*range(160), *range(160 + n, 160 + n + len(CLEAN))]
    assert not [texts[i] for i in clean if found[i].added or found[i].base]


def test_query_columns_and_nothing_to_scan(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for r in scan.op12_secret_scan(spark, str(tmp_path)).collect():
        spans = base_spans(ODD[r.doc_id])
        line = ",".join(f"{scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in spans) for x in range(3))
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(line.split(",")) - {""} <= set(r.spans.split(","))
    assert scan.scan(docs.limit(0)).count() == 0
    assert [r.added for r in scan.scan(docs.filter("doc_id < 2")).collect()] == [[], []]


def test_plan_has_no_python(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plan = scan.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|InPandas", plan)
