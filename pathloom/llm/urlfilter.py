"""URL filter: site rules first, then a character language-model ratio.

Two variable-order Markov models over the characters of host and path, one for accepted and one for rejected URLs,
smoothed by interpolation (Witten-Bell): P_k(c|ctx) = (n(ctx,c) + t(ctx) P_{k-1}(c|shorter ctx)) / (n(ctx) + t(ctx)),
where t is the number of different characters seen after ctx. Contexts grow to ORDER characters where counts support it: a
context longer than SHORT that was seen under SUPPORT times in both models together, or not at all, falls back to the shorter one.
The score is the difference of log-likelihoods per character. All of it is DataFrame code: no Python runs on executors.

Rejected training rows are those that something else rejects: a table of labelled URLs if one is given, else a rule or one of
`reject_words` between separators. All others count as accepted, most of them rightly.
Every row is counted, but for those of one host in `calibration` (by checksum), from which the threshold comes: the
score that all but `false_rejects` of the accepted keep below; where all but `missed` of the rejected lie above that,
the middle of the two.

Defined cases: a null URL or one without "://" has empty host and path, no rule, and is judged by a score of 0 (allow); URLs
of any length are read whole; repeated URLs are judged alike; of rules of one length the first in order of verdict and name wins, a
label in the table goes before rules and words, rejection before acceptance where labels differ; other columns are
ignored, whatever their names; without labels of both kinds all scores are 0 and nothing is rejected; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, table

#: (verdict, domain, path prefix); the longest that fits wins.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
REJECT_WORDS = ("ads", "adult", "bet", "bets", "casino", "cheap", "farm", "free", "pills", "porn", "spam", "track", "win", "xxx")
ORDER, SHORT, SUPPORT = 6, 3, 4
#: Characters outside this set count as one; runs of digits count as one 0.
KNOWN = "a-z0-9./-"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL by plain string search; both empty without "://"."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"(?s)^([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matched_rule(rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule text, its verdict) of the longest rule for columns host and path, null where none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [((F.col("host") == d) | F.endswith(F.col("host"), F.lit("." + d))) & F.startswith(F.col("path"), F.lit(p)) for _, d, p in ordered]
    none = F.lit(None).cast("string")
    name = F.coalesce(*(F.when(f, F.lit(d + p)) for f, (_, d, p) in zip(fits, ordered)), none)
    verdict = F.coalesce(*(F.when(f, F.lit(v)) for f, (v, _, _) in zip(fits, ordered)), none)
    return name, verdict


def windows(rows: DataFrame, *keep: str) -> DataFrame:
    """Each character of `shape` (one row each) with its ORDER preceding ones, as `window`."""
    padded = F.concat(F.lit("^" * ORDER), "shape", F.lit("$"))
    return rows.select(*keep, padded.alias("_p")).select(*keep, "_p", F.explode(F.sequence(F.lit(1), F.length("_p") - ORDER)).alias("_i")).select(*keep, F.expr(f"substring(_p, _i, {ORDER + 1})").alias("window"))


def log_ratios(train: DataFrame, wanted: DataFrame) -> DataFrame:
    """(window, ratio) for each wanted window: log P_rejected - log P_accepted of its last character.

    train: (window, bad) rows of the training URLs. Every table here has at most one row per distinct window.
    """
    grams = cut(train.groupBy("window").agg(F.sum(F.col("bad").cast("long")).alias("n1"), F.sum((~F.col("bad")).cast("long")).alias("n0")))
    out = wanted
    probs = {c: F.lit(1.0 / 42) for c in (0, 1)}
    for k in range(ORDER + 1):
        tail = grams.select(F.expr(f"right(window, {k + 1})").alias(f"g{k}"), "n0", "n1").groupBy(f"g{k}").agg(F.sum("n0").alias(f"n0_{k}"), F.sum("n1").alias(f"n1_{k}"))
        contexts = tail.groupBy(F.expr(f"left(g{k}, {k})").alias(f"c{k}")).agg(*(e for c in (0, 1) for e in (F.sum(f"n{c}_{k}").alias(f"s{c}_{k}"), F.sum((F.col(f"n{c}_{k}") > 0).cast("long")).alias(f"t{c}_{k}"))))
        out = out.withColumn(f"g{k}", F.expr(f"right(window, {k + 1})")).withColumn(f"c{k}", F.expr(f"left(g{k}, {k})")).join(tail, f"g{k}", "left").join(contexts, f"c{k}", "left")
        enough = F.coalesce(F.col(f"s0_{k}") + F.col(f"s1_{k}"), F.lit(0)) >= (SUPPORT if k > SHORT else 1)
        for c in (0, 1):
            n, s, t = (F.coalesce(f"{x}{c}_{k}", F.lit(0)) for x in "nst")
            out = out.withColumn(f"p{c}_{k}", F.when(enough & (s > 0), (n + t * probs[c]) / (s + t)).otherwise(probs[c]))
            probs[c] = F.col(f"p{c}_{k}")
        out = out.select("window", f"p0_{k}", f"p1_{k}")
    return out.select("window", (F.log(probs[1]) - F.log(probs[0])).alias("ratio"))


def content_labels(pages: DataFrame, url_col: str = "url", html_col: str = "html", least_chars: int = 200, most_signs: float = 0.1) -> DataFrame:
    """(url, bad): what a page's content says of its URL, for judge_urls(labelled=...). Bad are pages with under `least_chars` characters of
    text in paragraphs, or of whose text more than the share `most_signs` are signs other than letters, digits, spaces and common marks.

    A null or empty page has no text and is bad; a null URL gets no label; a URL with several pages is bad if one of them is.
    """
    blocks = F.regexp_extract_all(F.coalesce(html_col, F.lit("")), F.lit(r"(?is)<p[\s>][^<]*(?:<(?!/?(?:p|div|article)[\s>/])[^<]*)*"), F.lit(0))
    text = F.trim(F.regexp_replace(F.regexp_replace(F.array_join(blocks, " "), "<[^>]*>?", " "), r"&[a-z#0-9]+;|\s+", " "))
    rows = pages.filter(F.col(url_col).isNotNull()).select(F.col(url_col).alias("url"), text.alias("_t"))
    signs = F.length(F.regexp_replace("_t", r"[\p{L}\p{N}\s.,;:!?'\"()-]", ""))
    return rows.groupBy("url").agg(F.max((F.length("_t") < least_chars) | (signs > most_signs * F.length("_t"))).alias("bad"))


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, reject_words: Sequence[str] = REJECT_WORDS, id_col: str = "page_id", url_col: str = "url",
    labelled: DataFrame | None = None, train: DataFrame | None = None, calibration: int = 5, false_rejects: float = 0.005, missed: float = 0.05,
) -> DataFrame:
    """One row for each row of pages: id, host, path, rule, verdict, score and threshold.

    labelled: (url, bad) rows, by which equal URLs are labelled. train: rows with URLs to learn from, if not pages itself.
    """
    host, path = url_parts(F.col("_url"))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.lit(True).alias("_asked"), F.lit(train is None).alias("_taught"))
    if train is not None:
        rows = rows.unionByName(train.select(F.lit(None).cast(pages.schema[id_col].dataType).alias("_id"), F.col(url_col).alias("_url"), F.lit(False).alias("_asked"), F.lit(True).alias("_taught")))
    rows = rows.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))
    shape = F.regexp_replace(F.regexp_replace(F.lower(F.concat("host", "path")), "[0-9]+", "0"), f"[^{KNOWN}]", "_")
    word = "(^|[^a-z])(" + "|".join(sorted(reject_words)) + ")([^a-z]|$)" if reject_words else "(?!)"
    name, verdict = matched_rule(rules)
    rows = rows.withColumns({"shape": shape, "rule": name, "_v": verdict, "held": F.crc32("host") % calibration == 0})
    if labelled is not None:
        known = labelled.select(F.col(labelled.columns[0]).alias("_u"), F.col(labelled.columns[1]).alias("_b")).groupBy("_u").agg(F.max("_b").alias("_b"))
        rows = rows.join(known, F.col("_url") == F.col("_u"), "left").drop("_u")
    else:
        rows = rows.withColumn("_b", F.lit(None).cast("boolean"))
    rows = cut(rows.withColumn("bad", F.coalesce(F.col("_b"), F.rlike(F.lower(F.concat("host", "path")), F.lit(word)) | F.coalesce(F.col("_v") == "block", F.lit(False)))).drop("_b"))
    each = rows.filter("shape <> ''").select("shape").distinct()
    seen = windows(rows.filter("shape <> '' AND _taught AND NOT held"), "bad")
    wanted = windows(each).distinct()
    ratios = broadcast_if_small(cut(log_ratios(seen, wanted)))
    # scores of distinct shapes; a shape's windows are summed before they are shuffled
    scores = cut(windows(each, "shape").join(ratios, "window").groupBy("shape").agg((F.sum("ratio") / F.count("*")).alias("score")))
    scored = rows.join(scores, "shape", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    both = scored.filter("shape <> '' AND _taught").agg(
        F.expr(f"percentile_approx(score, {1 - false_rejects}, 10000) FILTER (WHERE held AND NOT bad)").alias("kept"), F.expr(f"percentile_approx(score, {missed}, 10000) FILTER (WHERE held AND bad)").alias("lost"),
        F.expr("count(*) FILTER (WHERE NOT held AND bad)").alias("n1"), F.expr("count(*) FILTER (WHERE NOT held AND NOT bad)").alias("n0"),
    ).first()
    threshold = 0.0
    if not both.n1 or not both.n0:
        scored, threshold = scored.withColumn("score", F.lit(0.0)), 0.0
    elif both.kept is not None:
        threshold = (both.kept + both.lost) / 2 if both.lost is not None and both.lost > both.kept else both.kept
    found = F.coalesce("_v", F.when((F.col("score") > threshold) & (F.col("shape") != ""), F.lit("block")).otherwise(F.lit("allow")))
    return scored.filter("_asked").select(F.col("_id").alias(id_col), "host", "path", "rule", found.alias("verdict"), "score", F.lit(float(threshold)).alias("threshold"))


def op3_url_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
