"""Secret scan: base patterns, and tokens that a battery of randomness tests takes for random, under false-discovery control.

Candidates are runs of MIN_LENGTH or more token characters. Each gets the encoding with the smallest alphabet that holds it
(numbers alone get none), and three tests of the assumption that its symbols are drawn evenly and independently from that alphabet:
  - evenness: the chi-squared statistic of symbol counts, two-sided (Wilson-Hilferty; mean and variance matched to the length);
  - runs: the number of changes between classes of characters (lower, upper, digit, sign) against the share of such pairs;
  - serial correlation of neighbouring symbols' places in the alphabet, two-sided.
A token that one of them rejects (Bonferroni, `reject_below`) is not random. What is left might still be an ordinary word: the
chance that ordinary text of this length shows symbol counts as even, and as many class changes, follows from the symbols'
shares and the share of class changes in all words of LONG_WORD or more token characters of all documents (exact moments of the counts, a
Chernoff bound for the changes, joined by Fisher's rule). Within each class of lengths the Benjamini-Hochberg procedure over all
distinct candidates of the corpus bounds the share of ordinary words among those added by `false_discoveries`: a short token
must look far less like a word than its peers, a long one rarely fails to.

All of it is DataFrame code. The texts are read twice (shares, then candidates); the driver sees the shares of 64 symbols and
one threshold for each length class, however large the corpus. Nothing is joined: a document's spans come from its own row.

Base spans: `assign` (keyword, sign, value of 6 or more characters; the span is the whole match), `access`, `hex`. A
candidate that holds a base match is dropped, as that span covers it; so is one that an assignment's match takes in. An
assignment whose keyword ends a longer token can overlap a span of kind `random`.

Defined cases: a null text counts as empty and has no spans; rows with null or equal ids are scanned each; of spans with one
start the order of kinds decides (assign, access, hex, random); texts of any length are scanned whole; repeated tokens count once for the
control and are all marked; other columns are ignored, whatever their names; an empty table gives an empty result, a corpus without
long words no added spans.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
SYMBOLS = UPPER + LOWER + DIGITS + "+/-_"
#: (name, pattern, alphabet), the smallest alphabet first.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", DIGITS + LOWER[:6]),
    ("upper hex", "^[0-9A-F]+$", DIGITS + UPPER[:6]),
    ("base32", "^[A-Z2-7]+$", UPPER + DIGITS[2:8]),
    ("base36", "^[0-9a-z]+$", DIGITS + LOWER),
    ("upper base36", "^[0-9A-Z]+$", DIGITS + UPPER),
    ("base64", "^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", "^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
)
MIN_LENGTH, LONG_WORD = 16, 8
#: Keywords in either case, written out: case-insensitive matching knows more letters than these.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = "(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in k) for k in KEYWORDS) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"  # as AKIA[A-Z0-9]+ of 20 or more: a shorter run holds no longer one
HEX = "[0-9a-f]{24,}"
TOKEN = f"[A-Za-z0-9+/_-]{{{MIN_LENGTH},}}={{0,2}}"
KINDS = ("assign", "access", "hex", "random")
#: Lengths at which a new class begins.
LENGTH_CLASSES = (16, 20, 24, 32, 48, 64, 128, 256)
CHUNK = 512


def upper_tail(z: Column) -> Column:
    """P(standard normal > z), by formula 26.2.17 of Abramowitz and Stegun."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, found>> of the leftmost non-overlapping matches, start in code points.

    The texts between matches (split) give the places. Sums run within chunks and then over chunks, as an array grown by one
    element at a time costs the square of its length.
    """
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.coalesce(F.length(hit), F.lit(0)).alias("len"), hit.alias("found")))
    chunks = F.transform(F.array(pieces), lambda p: F.transform(F.sequence(F.lit(1), F.size(p), F.lit(CHUNK)), lambda k: F.slice(p, k, CHUNK)))[0]
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,found:string>>").alias("out"))
    inside = F.transform(chunks, lambda c: F.aggregate(c, none, lambda a, x: F.struct((a["at"] + x["gap"] + x["len"]).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), x["found"].alias("found")))).alias("out"))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<base:int,out:array<struct<start:int,found:string>>>>").alias("out"))
    placed = F.aggregate(inside, zero, lambda a, c: F.struct((a["at"] + c["at"]).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("base"), c["out"].alias("out")))).alias("out")))["out"]
    whole = F.flatten(F.transform(placed, lambda c: F.transform(c["out"], lambda x: F.struct((c["base"] + x["start"]).alias("start"), x["found"].alias("found")))))
    found = F.filter(whole, lambda x: x["found"].isNotNull())
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(F.array().cast("array<struct<start:int,found:string>>"))


def chosen(values: list, token: Column) -> Column:
    """The value that belongs to the token's encoding."""
    out = F.lit(None)
    for (_, pattern, _), value in reversed(list(zip(ENCODINGS, values))):
        out = F.when(F.rlike(token, F.lit(pattern)), F.lit(value)).otherwise(out)
    return F.when(~F.rlike(token, F.lit("^[0-9]*$")), out)


def classes_of(text: Column) -> Column:
    return F.translate(text, SYMBOLS, "A" * 26 + "a" * 26 + "0" * 10 + "-" * 4)


def runs_of(classes: Column) -> Column:
    """How many runs of equal characters."""
    return F.length(F.regexp_replace(classes, r"(.)\1+", "$1"))


def measured(token: Column) -> Column:
    """struct(body, enc, n, pairs, changes, serial): symbol pairs that are alike, class changes, sum over neighbours of centred places."""
    body = F.rtrim(token, F.lit("="))
    named = F.struct(body.alias("body"), chosen(list(range(len(ENCODINGS))), body).alias("enc"), chosen([a for *_, a in ENCODINGS], body).alias("alphabet"))

    def counted(t: Column) -> Column:
        n = F.length(t["body"]).cast("long")
        symbols = F.split(t["body"], "")
        places = F.transform(symbols, lambda c: 2 * F.instr(t["alphabet"], c).cast("long") - F.length(t["alphabet"]) - 1)
        pairs = F.aggregate(F.transform(F.split(t["alphabet"], ""), lambda a: n - F.length(F.replace(t["body"], a, F.lit("")))), F.lit(0).cast("long"), lambda s, c: s + c * (c - 1))
        return F.struct(t["body"].alias("body"), t["enc"].alias("enc"), n.alias("n"), pairs.alias("pairs"), (runs_of(classes_of(t["body"])) - 1).cast("long").alias("changes"), places.alias("places"))

    def summed(t: Column) -> Column:
        serial = F.aggregate(F.zip_with(F.slice(t["places"], F.lit(1), F.greatest(F.size(t["places"]) - 1, F.lit(0))), F.slice(t["places"], F.lit(2), F.size(t["places"])), lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x, F.lit(0).cast("long")))
        return F.struct(*(t[c].alias(c) for c in ("body", "enc", "n", "pairs", "changes")), serial.alias("serial"))

    # one step of transform each, so that what a step makes is not computed again for every use
    return F.transform(F.transform(F.transform(F.array(named), lambda t: t), counted), summed)[0]


def randomness(t: Column) -> Column:
    """The smallest chance of the three tests, times three, for a measured token of a known encoding."""
    per = lambda f: F.element_at(F.array(*(F.lit(float(f(a))) for *_, a in ENCODINGS)), t["enc"] + 1)
    size = per(len)
    n, pairs, changes, serial = (t[c].cast("double") for c in ("n", "pairs", "changes", "serial"))
    degrees = (size - 1) * n / (n - 1)
    statistic = (size / n * (pairs + n) - n) * n / (n - 1)
    spread = 2 / (9 * degrees)
    even = (F.pow(statistic / degrees, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)
    rate = per(lambda a: 1 - sum((sum(c in group for c in a) / len(a)) ** 2 for group in (LOWER, UPPER, DIGITS, "+/-_")))
    runs = (changes - (n - 1) * rate) / F.sqrt((n - 1) * rate * (1 - rate))
    linked = serial / ((size * size - 1) / 3 * F.sqrt(n - 1))
    return 3 * 2 * F.least(*(upper_tail(F.abs(z)) for z in (even, runs, linked)))


def wordlike(t: Column, shares: dict[str, float], rate: float) -> Column:
    """Minus the decimal logarithm of the chance that ordinary text shows counts as even and as many class changes, in hundredths, 30000 at most."""
    folded = {c: shares.get(c.lower(), 0.0) + (shares.get(c.upper(), 0.0) if c.isalpha() else 0.0) for c in SYMBOLS}
    moments = []
    for *_, alphabet in ENCODINGS:
        of = shares if LOWER in alphabet and UPPER in alphabet else folded
        whole = sum(of.get(c, 0.0) for c in alphabet) or 1.0
        p = [of.get(c, 0.0) / whole for c in alphabet]
        moments.append((sum(x * x for x in p), sum(x**3 for x in p)))
    two, three = (F.element_at(F.array(*(F.lit(m[k]) for m in moments)), t["enc"] + 1) for k in (0, 1))
    n, pairs, changes = (t[c].cast("double") for c in ("n", "pairs", "changes"))
    spread = 2 * n * (n - 1) * (two + 2 * (n - 2) * three - (2 * n - 3) * two * two)
    even = F.log(F.greatest(upper_tail((n * (n - 1) * two - pairs) / F.sqrt(F.greatest(spread, F.lit(1e-9)))), F.lit(1e-300)))
    part = F.least(changes / (n - 1), F.lit(1.0))
    rest = F.greatest(1 - part, F.lit(1e-12))
    changed = F.when(part > rate, -(n - 1) * (part * F.log(F.greatest(part, F.lit(1e-12)) / rate) + (1 - part) * F.log(rest / (1 - rate)))).otherwise(F.lit(0.0))
    both = -(even + changed)
    return F.floor(F.least(F.greatest((both - F.log(1 + both)) / log(10) * 100, F.lit(0.0)), F.lit(30000.0))).cast("int")


def length_class(n: Column) -> Column:
    return sum((F.when(n >= k, 1).otherwise(0) for k in LENGTH_CLASSES[1:]), F.lit(0))


def word_shares(docs: DataFrame, text_col: str = "text") -> tuple[dict[str, float], float]:
    """Shares of the symbols in long words of all documents, and the share of neighbours of different classes."""
    words = F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(f"[A-Za-z0-9+/_-]{{{LONG_WORD},}}"), F.lit(0))
    rows = docs.select(F.size(words).cast("long").alias("_w"), F.array_join(words, " ").alias("_t"))
    counts = [F.sum(F.octet_length("_t") - F.octet_length(F.replace("_t", F.lit(c), F.lit("")))) for c in SYMBOLS]
    changes = F.sum(runs_of(classes_of(F.col("_t"))) - 2 * F.col("_w") + F.when(F.col("_w") > 0, 1).otherwise(0))
    *each, words_seen, changed = rows.agg(*counts, F.sum("_w"), changes).first()
    total = sum(x or 0 for x in each)
    if not total:
        return {}, 0.5
    return {c: x / total for c, x in zip(SYMBOLS, each)}, min(max(changed / max(total - words_seen, 1), 1e-6), 0.5)


def thresholds(tests: DataFrame, false_discoveries: float) -> dict[int, int]:
    """For each length class the hundredths from which a token is taken (Benjamini-Hochberg); tests has one row a token: (class, score)."""
    counts = tests.groupBy("class", "score").agg(F.count("*").alias("n"))  # at most 30001 rows a class
    beyond = Window.partitionBy("class").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    sums = counts.withColumns({"taken": F.sum("n").over(beyond), "all": F.sum("n").over(Window.partitionBy("class"))})
    passing = sums.filter(F.pow(F.lit(10.0), -F.col("score") / 100) <= false_discoveries * F.col("taken") / F.col("all"))
    return {r["class"]: r["least"] for r in passing.groupBy("class").agg(F.min("score").alias("least")).collect()}  # one row a class


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reject_below: float = 0.01, false_discoveries: float = 0.01) -> DataFrame:
    """One row for each row of docs: id, base and added, arrays of struct<start, kind (its place in KINDS), end>."""
    shares, rate = word_shares(docs, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    span = lambda kind: lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), (x["start"] + F.length(x["found"])).alias("end"))
    assigned = F.filter(matches(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["found"], ASSIGN, 2)) >= 6)
    base = F.array_sort(F.concat(F.transform(assigned, span(0)), F.transform(matches(text, ACCESS), span(1)), F.transform(matches(text, HEX), span(2))))
    free = F.filter(matches(text, f"{ASSIGN}|{TOKEN}"), lambda x: ~F.rlike(x["found"], F.lit(f"^{ASSIGN}$|{ACCESS}|{HEX}")) & chosen([1] * len(ENCODINGS), F.rtrim(x["found"], F.lit("="))).isNotNull())
    # a token's hash stands for it where distinct ones are counted; the tests' figures are kept, the token is not
    rows = docs.select(F.col(id_col).alias("_id"), base.alias("_base"), free.alias("_free"))
    tested = F.transform("_free", lambda x: F.struct(span(3)(x).alias("span"), F.xxhash64(x["found"]).alias("token"), measured(x["found"]).alias("t")))
    rows = rows.select("_id", "_base", F.transform(tested, lambda x: F.struct(x["span"].alias("span"), x["token"].alias("token"), length_class(x["t"]["n"]).alias("class"), randomness(x["t"]).alias("random"), wordlike(x["t"], shares, rate).alias("score"))).alias("_tests"))
    rows = cut(rows)
    tests = rows.select(F.explode("_tests").alias("t")).select("t.token", "t.class", "t.score").distinct()
    from_score = thresholds(tests, false_discoveries)
    from_here = F.array(*(F.lit(from_score.get(k, 1 << 30)) for k in range(len(LENGTH_CLASSES))))
    taken = F.filter("_tests", lambda x: (x["random"] >= reject_below) & (x["score"] >= F.element_at(from_here, x["class"] + 1)))
    return rows.select(F.col("_id").alias(id_col), F.col("_base").alias("base"), F.transform(taken, lambda x: x["span"]).alias("added"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.array_sort(F.concat("base", "added"))).alias("spans"))
