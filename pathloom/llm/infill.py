"""Fill-in-the-middle transformation: a text is cut twice and its middle moved to the end, behind marks.

The draws (where to cut, which form) come from a hash of the id and are made by Spark. The cutting is one kernel for all rows of
a batch over its Arrow UTF-8 buffer: a table gives each byte's class (letter, inner byte of a character, other), a mask marks the
bytes that begin a token, which a byte does unless it continues a character or a run of letters (or always, where a document
begins); running sums of the mask, taken anew from each document's first byte, number the tokens, and one binary search
in them finds the cuts of all rows. Outputs are gathered from the buffer in one step too. `restored` undoes it from output and form
alone. Rows go through in runs of about RUN_BYTES, so memory follows that or the longest text.

Tokens are runs of A-Z and a-z, and every other code point alone. The three marks occur in no text that is cut, and none of them can
arise where a piece of text meets a mark, as no mark ends with the beginning of another.

Defined cases: a null text counts as empty; an empty text, or one that holds a mark, is plain; a null id draws as an empty
one; rows of one id draw alike; texts of any length are cut whole; other columns are ignored, whatever their names (those
in `keep` must differ from the results' names); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, table

MARKS = ("<P>", "<S>", "<M>")
RUN_BYTES = 4 << 20
FORMS = np.array(["plain", "psm", "spm"])
PLAIN, PSM, SPM = range(3)
OTHER, LETTER, INNER = range(3)
CLASSES = np.array([LETTER if chr(b).isalpha() and b < 128 else INNER if 128 <= b < 192 else OTHER for b in range(256)], np.uint8)
MARK_BYTES = np.frombuffer("".join(MARKS).encode(), np.uint8)


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of texts; the first offset need not be 0. Nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def runs(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges that hold about RUN_BYTES each, one row at least."""
    row = 0
    while row < len(offsets) - 1:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + RUN_BYTES, "right")) - 1)
        yield row, end
        row = end


def gathered(source: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row the stretches (start, length) of source put together, in their order: (bytes, offsets of the rows)."""
    ends = np.cumsum(lengths.ravel())
    place = np.arange(ends[-1] if len(ends) else 0)
    place += np.repeat(starts.ravel() - ends + lengths.ravel(), lengths.ravel())
    return source[place], np.concatenate(([0], ends[lengths.shape[1] - 1 :: lengths.shape[1]]))


def marks_in(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, row) of each mark that lies within a row."""
    opens = np.flatnonzero((data[:-2] == MARK_BYTES[0]) & (data[2:] == MARK_BYTES[2]) & np.isin(data[1:-1], MARK_BYTES[1::3]))
    rows = np.searchsorted(offsets, opens, "right") - 1
    inside = opens + 3 <= offsets[rows + 1] if len(rows) else np.zeros(0, bool)
    return opens[inside], rows[inside]


def cut_texts(data: np.ndarray, offsets: np.ndarray, draws: np.ndarray, plain_from: int, spm_below: int) -> tuple:
    """(n, form, prefix chars, middle chars, output bytes, their offsets) for the rows of data[offsets[0]:]; draws is 4 x rows."""
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    first, end = offsets[:-1], offsets[1:]
    kinds = CLASSES[data]
    point = kinds != INNER
    begins = point.copy()
    begins[1:] &= (kinds[1:] != LETTER) | (kinds[:-1] != LETTER)
    begins[first[first < end]] = True
    tokens = np.cumsum(begins)
    before = np.concatenate(([0], tokens))
    n = before[end] - before[first]
    points = np.concatenate(([0], np.cumsum(point)))

    one, two = draws[0] % (n + 1), draws[1] % (n + 1)
    # the cut before token c of a document is where the running sum passes c, counted from the document's first byte
    cuts = np.minimum(np.searchsorted(tokens, before[first] + np.stack((np.minimum(one, two), np.maximum(one, two))), "right"), end)
    form = np.where(draws[3] % 100 < spm_below, SPM, PSM)
    form[(n == 0) | (draws[2] % 100 >= plain_from)] = PLAIN
    form[marks_in(data, offsets)[1]] = PLAIN
    prefix, suffix, middle = (first, cuts[0] - first), (cuts[1], end - cuts[1]), (cuts[0], cuts[1] - cuts[0])

    source = np.concatenate((data, MARK_BYTES))
    mark = [(np.full_like(n, len(data) + 3 * k), np.full_like(n, 3)) for k in range(3)]
    starts, lengths = np.zeros((len(n), 6), np.int64), np.zeros((len(n), 6), np.int64)
    for kind, order in ((PSM, (mark[0], prefix, mark[1], suffix, mark[2], middle)), (SPM, (mark[1], suffix, mark[0], prefix, mark[2], middle)), (PLAIN, ((first, end - first),))):
        rows = form == kind
        for k, (start, length) in enumerate(order):
            starts[rows, k], lengths[rows, k] = start[rows], length[rows]
    return n, form, points[cuts[0]] - points[first], points[cuts[1]] - points[cuts[0]], *gathered(source, starts, lengths)


def joined_texts(data: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that outputs of these forms were made from: (bytes, offsets)."""
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    starts, lengths = np.zeros((len(form), 3), np.int64), np.zeros((len(form), 3), np.int64)
    starts[:, 0], lengths[:, 0] = offsets[:-1], np.diff(offsets)
    places, rows = marks_in(data, offsets)
    moved = form != PLAIN
    at = places[moved[rows]].reshape(-1, 3)
    begin, stop = at + 3, np.stack((at[:, 1], at[:, 2], offsets[1:][moved]), axis=1)
    spm = (form[moved] == SPM)[:, None]
    order = np.where(spm, np.array([1, 2, 0]), np.array([0, 2, 1]))  # where prefix, middle and suffix stand in the output
    starts[moved], lengths[moved] = np.take_along_axis(begin, order, 1), np.take_along_axis(stop - begin, order, 1)
    return gathered(data, starts, lengths)


def as_strings(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    return pa.concat_arrays([pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)) for data, offsets in parts] or [pa.array([], pa.string())])


def drawn(id_col: str, seed: int) -> list[Column]:
    """Four unsigned 32-bit integers from the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"_h{k}") for k in range(4)]


def fill_in_middle(docs: DataFrame, keep: Sequence[str], text_col: str = "text", id_col: str = "doc_id", seed: int = 1, moved_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """The columns `keep` with n (tokens), form (plain, psm, spm), prefix_chars, middle_chars (null if plain) and output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(len(keep) + 4))
            draws = np.stack([batch.column(len(keep) + k).to_numpy(zero_copy_only=False) for k in range(4)])
            done = [cut_texts(data, offsets[a : b + 1], draws[:, a:b], moved_percent, spm_percent) for a, b in runs(offsets)]
            n, form, prefix, middle = (np.concatenate([d[k] for d in done] or [np.zeros(0, np.int64)]) for k in range(4))
            plain = form == PLAIN
            made = [pa.array(n), pa.array(FORMS[form].tolist(), pa.string()), pa.array(prefix, mask=plain), pa.array(middle, mask=plain), as_strings([d[4:] for d in done])]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), *made], names=[*keep, "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(*keep, *drawn(id_col, seed), text_col)
    return in_batches(rows, run, "n long, form string, prefix_chars long, middle_chars long, output string", [docs.schema[c] for c in keep])


def restored(moved: DataFrame, keep: Sequence[str], output_col: str = "output", form_col: str = "form") -> DataFrame:
    """The columns `keep` with `restored`, the text from which output was made, from output and form alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(len(keep) + 1))
            names = batch.column(len(keep)).to_numpy(zero_copy_only=False)
            form = np.where(names == "psm", PSM, np.where(names == "spm", SPM, PLAIN))
            texts = as_strings([joined_texts(data, offsets[a : b + 1], form[a:b]) for a, b in runs(offsets)])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), texts], names=[*keep, "restored"])

    return in_batches(moved.select(*keep, form_col, output_col), run, "restored string", [moved.schema[c] for c in keep])


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = fill_in_middle(table(spark, sf_dir, "documents"), ["doc_id"])
    both = restored(moved, moved.columns)
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP11_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (
  SELECT doc_id, t, u, len(u) AS n, [CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT) FOR k IN [0, 1, 2, 3]] AS h FROM d),
c AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
         WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                   ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
