"""Personal data: candidate spans, gradient-boosted trees over format and context, calibrated thresholds.

Base spans follow fixed rules (email, ip, card, phone) and always stay. High-recall generators propose further,
overlapping spans: anything around an @ or "(at)", numbers in groups, dotted or bracketed numbers, long tokens with digits.
A candidate's format (lengths, kinds of characters, groups, checksums, entropy) and context (words and signs before and after it)
go through boosted trees; a span is redacted if its calibrated probability reaches the threshold of its kind and it
touches no base span. Of overlapping ones the most probable stays.

There are no labelled spans, so the trees learn from a bounded sample of documents whose labels come from elsewhere than
the features: base spans are positive, and so are planted ones, base spans rewritten in other forms (`VARIANTS`) at
their place in the text; planted look-alikes (`DECOYS`: dates, versions, amounts, identifiers) and all other candidates are negative.
Values assigned to a name like password or token are positive secrets; what stands before or after a candidate of this kind is
not shown to the trees, which so learn what such values look like. At most `max_docs` documents with a digit or an @, those with
the smallest hash of the id, give candidates, and at most `max_rows` candidates are fitted.

Defined cases: null and empty texts have no spans; texts of any length are searched whole, in time that follows their
length; a number with leading zeros counts by its value; of equally probable candidates the first found stays; repeated
rows are answered each; columns are taken by position, so other columns and their names don't matter; an empty
table gives an empty result, and too few candidates a model that adds nothing.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, table

KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = (*KINDS, "secret")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# No match starts inside a run of digits, and none gives digits back: so written, both take linear time.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TELLING = re.compile(r"[0-9@]|[\[(](?:at|AT)[\])]")
#: Generators: (kind, pattern). They overlap and accept far more than is personal.
GENERATORS = (
    ("email", re.compile(r"[^\s@<>()\[\]\"',;]{1,64}(?:@|\s?[\[(](?:at|AT)[\])]\s?)[^\s@<>()\[\]\"',;]{2,255}(?:\s?[\[(](?:dot|DOT)[\])]\s?[A-Za-z0-9-]{2,63}){0,4}")),
    ("phone", re.compile(r"\+?\(?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,17}")),
    ("card", re.compile(r"[0-9](?:[\x20._\-]?[0-9]){11,18}")),
    ("ip", re.compile(r"[0-9a-fA-F]{1,4}(?:(?:[.:]|\[[.:]\]|\x20\.\x20)[0-9a-fA-F]{1,4}){3,7}")),
    ("secret", re.compile(r"(?<![A-Za-z0-9_\-])(?=[A-Za-z_\-]*[0-9])[A-Za-z0-9_\-]{12,}")),
)
ASSIGNED = re.compile(r"(?i)(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key|auth)\s*[=:]\s*[\"']?$")
CONTEXT = tuple(re.compile(x, re.I) for x in (r"tel|phone|call|fax|mobil", r"mail|contact|write", r"card|visa|credit|account", r"\bip\b|host|server|addr"))
FEATURES = 30


def regrouped(digits: str, sign: str) -> str:
    return sign.join(digits[i : i + 4] for i in range(0, len(digits), 4))


def last_ten(digits: str) -> tuple[str, str, str]:
    d = digits[-10:].rjust(10, "5")
    return d[:3], d[3:6], d[6:]


#: Other forms of a base span, by kind: what people write to spell or to hide it.
VARIANTS: dict[str, tuple[Callable[[str], str], ...]] = {
    "email": (lambda s: s.replace("@", " (at) "), lambda s: s.replace("@", "[at]"), lambda s: s.replace("@", " [AT] ").replace(".", " [DOT] "), lambda s: s.replace("@", "(at)"), lambda s: " (dot) ".join(s.replace("@", " (at) ").rsplit(".", 1))),
    "ip": (lambda s: s.replace(".", "[.]"), lambda s: s.replace(".", " . "), lambda s: s.replace(".", ":")),
    "card": (lambda s: regrouped(only_digits(s), "."), lambda s: regrouped(only_digits(s), "_")),
    "phone": (lambda s: "({}) {}-{}".format(*last_ten(only_digits(s))), lambda s: "{}-{}-{}".format(*last_ten(only_digits(s))), lambda s: "{}.{}.{}".format(*last_ten(only_digits(s))), lambda s: "{}/{} {}".format(*last_ten(only_digits(s)))),
}


def decoy(rng: random.Random) -> str:
    """Something with digits that is nobody's: a date, a version, an amount, an order number, an identifier."""
    n = rng.randrange
    return rng.choice((
        f"{1900 + n(200)}-{1 + n(12):02}-{1 + n(28):02} {n(24):02}:{n(60):02}:{n(60):02}", f"{1 + n(28):02}.{1 + n(12):02}.{1900 + n(200)} {n(24):02}.{n(60):02}", f"{n(20)}.{n(30)}.{n(400)}.{300 + n(4000)}",
        f"{1 + n(999)},{n(1000):03},{n(1000):03}.{n(100):02}", f"{1 + n(9)} {n(1000):03} {n(1000):03} {n(1000):03}", f"{n(10**16):016}", f"{n(10**12):012}", f"section_{n(30)}_part_{n(90)}", f"chapter-{n(30)}-figure-{n(90)}",
        f"978-{n(10)}-{n(100):02}-{n(10**6):06}-{n(10)}", f"{n(24):02}:{n(60):02}:{n(60):02}:{n(100):02}", f"user@{n(100)}", f"{n(10)}@{n(10)}", f"item{n(1000)}-of-the-list",
    ))


DEPTH, TREES, RATE, LEAST = 3, 40, 0.3, 10


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """EMAIL's matches, found from each @ outwards: a run of local characters can match at its start or nowhere."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text, start - 1, start):
            start -= 1
        found = EMAIL.match(text, start) if start < at else None
        if found:
            out.append(found.span())
            done = found.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """The spans of each kind in KINDS, by their rules."""
    if not TELLING.search(text):
        return [[], [], [], []]
    ips = [m.span() for m in IP.finditer(text) if all(len(v := p.lstrip("0")) <= 3 and int(v or "0") <= 255 for p in m[0].split("."))]
    cards = [m.span() for m in CARD.finditer(text) if 16 <= len(d := only_digits(m[0])) <= 19 and luhn(d)]
    phones = [m.span() for m in PHONE.finditer(text) if 8 <= len(only_digits(m[0])) <= 15] if "+" in text else []
    return [emails(text), ips, cards, phones]


HIDDEN_AT = re.compile(r"[\[(](?:at|AT)[\])]")


def candidates(text: str) -> list[tuple[int, int, str]]:
    if not TELLING.search(text):
        return []
    out: dict[tuple[int, int], str] = {}
    for kind, pattern in GENERATORS:
        if kind == "email" and "@" not in text and not HIDDEN_AT.search(text):
            continue
        for m in pattern.finditer(text):
            end = m.end()
            while kind == "email" and end > m.start() + 3 and text[end - 1] in ".!?:":
                end -= 1
            out.setdefault((m.start(), end), kind)
    return [(a, b, k) for (a, b), k in out.items()]


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    span, before, behind = text[start:end], text[max(0, start - 40) : start], text[end : end + 12]
    counts = Counter(span)
    n = len(span)
    digits = only_digits(span)
    letters = sum(c.isalpha() for c in span)
    numbers = [int(x[:6]) for x in re.findall(r"[0-9]+", span)]
    around = kind != "secret"  # a secret's label comes from what stands around it
    return [
        float(MORE_KINDS.index(kind)), n, len(digits), len(digits) / n, letters / n, sum(c.isupper() for c in span) / n,
        sum(c in "0123456789abcdefABCDEF" for c in span) / n, -sum(v / n * math.log2(v / n) for v in counts.values()), len(counts) / n,
        counts["."], counts[" "], counts["-"], counts["("], counts[":"], counts["@"], float(span[0] == "+"), counts["_"] + counts["/"], counts["["],
        len(numbers), max(numbers, default=-1), float(len(digits) >= 12 and luhn(digits)), float(len(numbers) == 4 and max(numbers) <= 255),
        float("." in span[span.find("@") :]) if "@" in span else -1.0, around and float(before[-1:].isalnum()), around and float(behind[:1].isalnum()),
        *(around and float(bool(c.search(before))) for c in CONTEXT),
        float(sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:])) / n),
    ]


def examples(text: str, seed: str) -> list[tuple[int, int, list[float], bool]]:
    """Candidates of a text and of what is planted into it as (start, end, features, whether personal)."""
    spans = {k: s for k, s in zip(KINDS, base_spans(text))}
    base = {s for k in spans for s in spans[k]}
    out = [(a, b, features(text, a, b, kind), (a, b) in base or (kind == "secret" and bool(ASSIGNED.search(text[max(0, a - 40) : a])))) for a, b, kind in candidates(text)]
    rng = random.Random(seed)
    planted = [(a, b, v(text[a:b]), True) for k in KINDS for a, b in spans[k][:4] for v in VARIANTS[k]]
    gaps = [m.start() for m in re.finditer(r"(?<=\s)(?=[^\W\d_])", text[:100_000])]
    planted += [(at, at, f"{decoy(rng)} ", False) for at in rng.sample(gaps, min(4, len(gaps)))]
    for a, b, new, good in planted:
        start = max(0, a - 60)
        window = f"{text[start:a]}{new}{text[b : b + 60]}"
        at = (a - start, a - start + len(new.rstrip()))
        for x, y, kind in candidates(window):
            if x < at[1] and at[0] < y:
                out.append((start + x, start + y, features(window, x, y, kind), good and (x, y) == at))
    return out


# --- boosted trees ----------------------------------------------------------------------------------------------------


def grow(x: np.ndarray, cuts: list[np.ndarray], binned: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int) -> tuple:
    """A tree as nested (feature, cut, left, right) and leaf values; splits by gain of the second-order loss."""
    total_g, total_h = g[rows].sum(), h[rows].sum()
    leaf = -RATE * total_g / (total_h + 1.0)
    if depth == 0 or len(rows) < 2 * LEAST:
        return (leaf,)
    best = (1e-6, -1, 0)
    for f in range(x.shape[1]):
        n = len(cuts[f]) + 1
        if n == 1:
            continue
        b = binned[rows, f]
        gs, hs, cs = (np.cumsum(np.bincount(b, w, n))[:-1] for w in (g[rows], h[rows], None))
        gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
        gain[(cs < LEAST) | (len(rows) - cs < LEAST)] = -1
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (float(gain[k]), f, k)
    if best[1] < 0:
        return (leaf,)
    _, f, k = best
    left = binned[rows, f] <= k
    return (f, float(cuts[f][k]), grow(x, cuts, binned, g, h, rows[left], depth - 1), grow(x, cuts, binned, g, h, rows[~left], depth - 1))


def tree_values(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    left = x[:, tree[0]] < tree[1]
    out = np.empty(len(x))
    out[left], out[~left] = tree_values(tree[2], x[left]), tree_values(tree[3], x[~left])
    return out


def raw_score(model: dict, x: np.ndarray) -> np.ndarray:
    return model["start"] + sum((tree_values(t, x) for t in model["trees"]), np.zeros(len(x)))


def fit(x: np.ndarray, y: np.ndarray, aside: np.ndarray, precision: float = 0.98) -> dict:
    """Trees on the rows not aside; on those aside a sigmoid for the scores and, kind by kind, the smallest probability from which on at least `precision` of the rows are positive."""
    nothing = {"start": -30.0, "trees": [], "a": 1.0, "c": 0.0, "thresholds": {}}
    if min(y[~aside].sum(), (~y[~aside]).sum(), y[aside].sum(), (~y[aside]).sum()) < LEAST:
        return nothing
    xs, ys = x[~aside], y[~aside].astype(float)
    cuts = []
    for f in range(x.shape[1]):
        values = np.unique(xs[:, f])
        if len(values) > 64:
            values = np.unique(np.quantile(xs[:, f], np.linspace(0, 1, 64)))
        cuts.append((values[1:] + values[:-1]) / 2)
    binned = np.stack([np.searchsorted(c, xs[:, f], side="right") for f, c in enumerate(cuts)], axis=1)
    share = ys.mean()
    start = math.log(share / (1 - share))
    trees, score = [], np.full(len(ys), start)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        tree = grow(xs, cuts, binned, p - ys, np.maximum(p * (1 - p), 1e-6), np.arange(len(ys)), DEPTH)
        trees.append(tree)
        score += tree_values(tree, xs)
    model = {"start": start, "trees": trees, "a": 1.0, "c": 0.0, "thresholds": {}}
    held, truth = raw_score(model, x[aside]), y[aside]
    a, c = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * held + c, -30, 30)))
        d, k = p - (truth * (truth.sum() + 1) / (truth.sum() + 2) + ~truth / ((~truth).sum() + 2)), p * (1 - p) + 1e-9
        hess = np.array([[(k * held * held).sum() + 1e-3, (k * held).sum()], [(k * held).sum(), k.sum() + 1e-6]])
        move = np.linalg.solve(hess, [(d * held).sum(), d.sum()])
        a, c = a - move[0], c - move[1]
    model["a"], model["c"] = (float(a), float(c)) if a > 0 else (1.0, 0.0)
    p = probability(model, x[aside])
    for k, kind in enumerate(MORE_KINDS):
        mine = x[aside][:, 0] == k
        if (truth & mine).sum() < LEAST:
            continue
        order = np.argsort(-p[mine], kind="stable")
        good = np.cumsum(truth[mine][order]) / np.arange(1, mine.sum() + 1)
        enough = np.flatnonzero(good >= precision)
        if len(enough):
            model["thresholds"][k] = max(0.5, float(p[mine][order][enough[-1]]))
    return model


def probability(model: dict, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model["a"] * raw_score(model, x) + model["c"], -30, 30)))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 4000, max_rows: int = 20_000) -> dict:
    """The model, from the candidates of at most max_docs documents and at most max_rows of these."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter(F.col("_text").rlike(TELLING.pattern))
    chosen = rows.select("_id").filter(F.col("_id").isNotNull()).distinct().orderBy(F.xxhash64("_id"), "_id").limit(max_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, xs, ys = [], [], []
            for i, t in zip(batch.column(0).cast(pa.string()).to_pylist(), batch.column(1).to_pylist()):
                for k, (a, b, x, y) in enumerate(examples(t, i)):
                    # what comes from one document is fitted or set aside together: the first byte is the document's
                    ids.append(hashlib.md5(i.encode(), usedforsecurity=False).digest()[:1] + hashlib.md5(f"{i}:{a}:{b}:{k}".encode(), usedforsecurity=False).digest())
                    xs.append(x)
                    ys.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(xs, pa.list_(pa.float64())), pa.array(ys, pa.bool_())], names=["id", "x", "y"])

    found = in_batches(rows.join(F.broadcast(chosen), "_id", "left_semi"), run, "id binary, x array<double>, y boolean").orderBy(F.xxhash64("id"), "id").limit(max_rows).toPandas()
    if not len(found):
        return fit(np.zeros((0, FEATURES)), np.zeros(0, bool), np.zeros(0, bool))
    aside = np.array([i[0] % 4 == 0 for i in found["id"]])
    return fit(np.stack(found["x"].to_numpy()), found["y"].to_numpy(bool), aside)


def merged(base: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """The stretches that spans cover, in order and apart."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(s for spans in base for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def meets(apart: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether a..b overlaps one of the stretches, which are in order and apart."""
    k = bisect_left(apart, (b, 0))
    return k > 0 and apart[k - 1][1] > a


def added_spans(text: str, base: list[list[tuple[int, int]]], model: dict) -> list[tuple[str, int, int]]:
    """Spans that the model adds to the base spans: none overlaps another or a base span."""
    if not model["thresholds"]:
        return []
    taken = merged(base)
    free = [c for c in candidates(text) if not meets(taken, c[0], c[1])]
    if not free:
        return []
    p = probability(model, np.array([features(text, *c) for c in free], float))
    out: list[tuple[str, int, int]] = []
    chosen: list[tuple[int, int]] = []
    for k in np.argsort(-p, kind="stable"):
        a, b, kind = free[k]
        limit = model["thresholds"].get(MORE_KINDS.index(kind), 2.0)
        if p[k] >= limit and not meets(chosen, a, b):
            out.append((kind, a, b))
            insort(chosen, (a, b))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (MORE_KINDS.index(s[0]), s[1], s[2])))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span (overlapping ones as one) replaced by its kind in angle brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def find(docs: DataFrame, model: dict, keep: list[str], text_col: str = "text", redact: bool = False) -> DataFrame:
    """The columns `keep` with base and spans (kind:start:end, comma-joined), n_email to n_phone of the base spans and, with redact, redacted texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # TREES trees of DEPTH levels
    counts = [f"n_{k}" for k in KINDS]
    names = [*counts, "base", "spans", *(["redacted"] if redact else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(len(keep)):
                text = x.as_py() or ""
                base = base_spans(text)
                flat = [(k, a, b) for k, spans in zip(KINDS, base) for a, b in spans]
                every = flat + added_spans(text, base, shared.value)
                rows.append((*map(len, base), joined(flat), joined(every), *([redacted(text, every) if x.is_valid else None] if redact else [])))
            kinds = [pa.int64()] * 4 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), *(pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names)))], names=[*keep, *names])

    head = [docs.schema[c] for c in keep]
    return in_batches(docs.select(*keep, text_col), run, ", ".join(f"{n} long" for n in counts) + ", base string, spans string" + (", redacted string" if redact else ""), head)


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find(docs, train(docs), ["doc_id"])
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")
