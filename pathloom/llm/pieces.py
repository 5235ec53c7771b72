"""SentencePiece encoding and decoding by N-best segmentation of the piece lattice.

A text is a lattice whose edges are the model's pieces. A forward Viterbi pass gives each place the best score of all
ways to reach it; a backward A* search from the end takes these as exact heuristics, so segmentations come out best
first. Characters that no piece holds are encoded as byte pieces.

The model file says in which order its pieces were made, not how likely they are: its scores are minus a rank, and a sum
of ranks favours many early pieces. A piece's score is therefore the logarithm of its share by Zipf's law for that rank
(`zipf`); nothing is trained. Other scores can be given as a `Model`.

Two neighbouring characters that stand together in no piece are always parted, so the lattice falls apart into units
between such places. Each unit is searched on its own and remembered; the best N of a text follow from the best N
of its units, as a text's score is the sum of theirs. Whole texts are encoded, however long; memory beyond the text itself
follows the longest unit, which is a run of letters or signs without a place where no piece can stand.

The model file is read on the driver only; its pieces (a fixed number) go to the tasks. Texts come back from
their ids unchanged: the mark for a space that occurs in a text itself is encoded as bytes.

Defined cases: null and empty texts have no pieces, one segmentation and a score of 0; of segmentations with one score
the one that the search meets first counts (the longest last piece), the same in every run; repeated rows are encoded
each; columns are taken by position, so other columns and their names don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import groupby
from math import log
from operator import add, itemgetter
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import in_batches, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Units that a worker's memory (one of words, one of other units, one of their parts) holds as lately met, and as many older ones.
REMEMBERED = 50_000
#: The same where nothing else needs the memory: a new word costs about ten times one met lately.
MUCH = 300_000
#: Ranks are counted from here on in Zipf's law (Mandelbrot's offset).
OFFSET = 2.7
#: Characters up to which a run is searched whole.
SHORT = 40
#: Runs of letters (with a space before) and of other characters, between which pieces seldom stand.
RUNS = re.compile(rf"{SPACE}?[^\W\d_]+|[\W\d_]+")
UNITS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Model(NamedTuple):
    """What encoding needs of a model file: ordinary pieces with ids and scores, ids of the 256 byte pieces, bytes of every id."""

    pieces: dict[str, tuple[int, float]]
    byte_ids: list[int]
    surface: list[bytes]


def zipf(ranks: list[int]) -> list[float]:
    """The logarithm of each rank's share, shares falling as 1 / (rank + OFFSET)."""
    whole = log(sum(1 / (r + OFFSET) for r in ranks)) if ranks else 0.0
    return [-log(r + OFFSET) - whole for r in ranks]


def load_model(path: str = MODEL) -> Model:
    import sentencepiece

    source = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary, byte_ids, surface = [], [0] * 256, []
    for i in range(source.get_piece_size()):
        piece = source.id_to_piece(i)
        if source.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            surface.append(bytes([int(piece[3:5], 16)]))
        elif source.is_control(i) or source.is_unknown(i):
            surface.append(b"")
        else:
            ordinary.append((-source.get_score(i), i, piece))
            surface.append(piece.replace(SPACE, " ").encode())
    ordinary.sort()
    scores = zipf(list(range(len(ordinary))))
    return Model({piece: (i, score) for (_, i, piece), score in zip(ordinary, scores)}, byte_ids, surface)


class Unit(NamedTuple):
    ids: bytes
    score: float
    #: (loss against the best, ids) of the next best segmentations
    others: tuple[tuple[float, bytes], ...]


#: A unit as it is remembered: ids, the first loss, the others. Its score follows from the ids.
Kept = tuple[bytes, float, tuple[tuple[float, bytes], ...]]
NEVER = float("inf")


class Memory(dict):
    """What `make` gives for texts met lately: two generations of `size` each; texts met again in the older come back."""

    def __init__(self, make: Callable[[str], Kept], size: int):
        self.make, self.older, self.size = make, {}, size

    def __missing__(self, text: str) -> Kept:
        got = self.older.get(text) or self.make(text)
        if len(text) <= 64:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[text] = got
        return got


def packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class Encoder:
    """Encodes texts with one model; n is how many segmentations a text gets, `remembered` how much it keeps of what it has met."""

    def __init__(self, model: Model, n: int = 1, remembered: int = REMEMBERED):
        self.model, self.n = model, n
        self.together = {p[i : i + 2] for p in model.pieces for i in range(len(p) - 1)}
        self.alone = {p for p in model.pieces if len(p) == 1}
        self.edges = {piece: packed([ident]) for piece, (ident, _) in model.pieces.items()}
        self.scores = np.zeros(len(model.surface))
        self.pieces = ahocorasick.Automaton()
        for piece, (ident, score) in model.pieces.items():
            self.scores[ident] = score
            self.pieces.add_word(piece, (len(piece) - 1, score, self.edges[piece]))
        self.pieces.make_automaton()
        self.words = Memory(lambda word: self.unit(SPACE + word), remembered)
        self.units, self.parts = Memory(self.unit, remembered), Memory(self.part, remembered)
        self.mark = (packed(self.bytes_of(SPACE)), NEVER, ())

    def segmentations(self, text: str, n: int) -> list[tuple[float, bytes]]:
        """The best n segmentations of a text of known characters as (score, ids), best first.

        Forwards, each place gets the best score of all ways to it, and the edges into it, longest piece first. Backwards, an entry
        of the A* search is a place with the path behind it; its value, the score behind plus the place's, is exactly that of
        the best whole through it.
        """
        best = [-NEVER] * (len(text) + 1)
        best[0] = 0.0
        edges: list[list[tuple[int, float, bytes]]] = [[] for _ in best]
        for last, edge in self.pieces.iter(text):
            whole = best[last - edge[0]] + edge[1]
            last += 1
            edges[last].append(edge)
            if whole > best[last]:
                best[last] = whole
        # (minus the score that the whole will have, tie-break, place, score behind it, path behind it)
        heap: list[tuple] = [(-best[-1], 0, len(text), 0.0, None)]
        out, pushed = [], 0
        # The heuristic is exact, so each entry ends in a path of its own with just its score: the n-th best bounds the rest.
        known, worst = [best[-1]], best[-1] if n == 1 else -NEVER
        while heap and len(out) < n:
            total, _, place, behind, path = heapq.heappop(heap)
            while place:  # the best successor would come off the heap next: it is followed at once, the others wait
                into = edges[place]
                follow = into[0]
                if len(into) > 1:
                    top, follow = best[place], None
                    for edge in into:
                        whole = best[place - 1 - edge[0]] + edge[1]
                        if follow is None and whole == top:
                            follow = edge
                        elif behind + whole > worst:
                            pushed += 1
                            heapq.heappush(heap, (-behind - whole, pushed, place - 1 - edge[0], behind + edge[1], (edge[2], path)))
                            known.append(behind + whole)
                            if len(known) >= n:
                                known.sort(reverse=True)
                                del known[n:]
                                worst = known[-1]
                place -= 1 + follow[0]
                behind += follow[1]
                path = (follow[2], path)
            ids: list[bytes] = []
            while path is not None:
                ident, path = path
                ids.append(ident)
            out.append((-total, b"".join(ids)))
        return out

    def bytes_of(self, text: str) -> list[int]:
        return [self.model.byte_ids[b] for b in text.encode()]

    def unit(self, text: str) -> Kept:
        """The best n segmentations of a stretch of text, from those of its runs of letters and of other characters."""
        runs = RUNS.findall(text)
        if len(runs) == 1:
            return self.parts[text]
        apart = runs[:1]
        for run in runs[1:]:
            if apart[-1][-1] + run[0] in self.together:
                apart[-1] += run
            else:
                apart.append(run)
        return self.joined(list(map(self.parts.__getitem__, apart)))

    def part(self, text: str) -> Kept:
        """The best n segmentations of a run; a long one is cut where no piece can stand, and around characters that no piece holds."""
        if not self.alone.issuperset(text):
            stretches = [(known, "".join(c)) for known, c in groupby(text, self.alone.__contains__)]
            return self.joined([self.part(x) if known else (packed(self.bytes_of(x)), NEVER, ()) for known, x in stretches])
        if len(text) > SHORT:
            cuts = [i for i, pair in enumerate(map(add, text, text[1:]), 1) if pair not in self.together]
            if cuts:
                return self.joined([self.parts[text[a:b]] for a, b in zip([0, *cuts], [*cuts, len(text)])])
        (score, ids), *others = self.segmentations(text, self.n)
        return ids, score - others[0][0] if others else NEVER, tuple([(score - s, i) for s, i in others])

    def joined(self, units: list[Kept]) -> Kept:
        """The best n of units in a row."""
        if len(units) == 1:
            return units[0]
        ids = list(map(itemgetter(0), units))
        best = b"".join(ids)
        if self.n == 1:
            return best, NEVER, ()
        if self.n == 2:
            losses = list(map(itemgetter(1), units))
            loss = min(losses, default=NEVER)
            if loss == NEVER:
                return best, NEVER, ()
            k = losses.index(loss)
            ids[k] = units[k][2][0][1]
            return best, loss, ((loss, b"".join(ids)),)
        # only the n - 1 units with the smallest first loss can take part in the best n
        near = heapq.nsmallest(self.n - 1, ((u[1], k) for k, u in enumerate(units) if u[2]))
        others, heap, seen = [], [(loss, ((k, 0),)) for loss, k in near], set()
        heapq.heapify(heap)
        while heap and len(others) < self.n - 1:
            loss, chosen = heapq.heappop(heap)
            if chosen in seen:
                continue
            seen.add(chosen)
            changed = dict(chosen)
            others.append((loss, b"".join(units[k][2][changed[k]][1] if k in changed else x for k, x in enumerate(ids))))
            for k, j in chosen:
                if j + 1 < len(units[k][2]):
                    heapq.heappush(heap, (loss - units[k][2][j][0] + units[k][2][j + 1][0], tuple(sorted((changed | {k: j + 1}).items()))))
            for first, k in near:
                if k not in changed:
                    heapq.heappush(heap, (loss + first, tuple(sorted((changed | {k: 0}).items()))))
        return best, others[0][0] if others else NEVER, tuple(others)

    def encode(self, text: str | None) -> Unit:
        if not text:
            return Unit(b"", 0.0, ())
        units: list[Kept] = []
        for k, piece in enumerate((" " + text).split(SPACE)):
            if k:
                units.append(self.mark)
            if "  " in piece or piece[:1] != " " or piece[-1:] == " ":
                units += map(self.units.__getitem__, UNITS.findall(piece.replace(" ", SPACE)))
            else:
                units += map(self.words.__getitem__, piece[1:].split(" "))
        ids, _, others = self.joined(units)
        return Unit(ids, float(self.scores[np.frombuffer(ids, np.uint32)].sum()), others)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.model.surface.__getitem__, np.frombuffer(ids, np.uint32).tolist())).decode()[1:]


def uncollected(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run with the cycle collector off until the task ends: encoding makes no cycles, and each round of the collector would walk all that is remembered."""

    def alone(batches: Iterator) -> Iterator:
        gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()

    return alone


def encoder_for(model: Model, n: int, remembered: int = REMEMBERED) -> Encoder:
    """This worker's encoder: what it remembers stays from task to task."""
    key = (n, remembered, hash(tuple(model.byte_ids)), hash(tuple(model.pieces.items())))
    if key not in ENCODERS:
        ENCODERS.clear()
        ENCODERS[key] = Encoder(model, n, remembered)
    return ENCODERS[key]


ENCODERS: dict[tuple, Encoder] = {}


def encode(docs: DataFrame, keep: list[str], text_col: str = "text", n: int = 1, model: Model | None = None) -> DataFrame:
    """The columns `keep` with the best n segmentations of each text: array<struct<score, ids>>."""
    shared = docs.sparkSession.sparkContext.broadcast(model or load_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(shared.value, n)
        for batch in batches:
            texts, scores, ids = [0], [], []
            for text in batch.column(len(keep)):
                u = encoder.encode(text.as_py())
                scores += [u.score, *(u.score - loss for loss, _ in u.others)]
                ids += [u.ids, *(x for _, x in u.others)]
                texts.append(len(scores))
            ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)))
            found = pa.StructArray.from_arrays([pa.array(scores, pa.float64()), lists], names=["score", "ids"])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.ListArray.from_arrays(pa.array(texts, pa.int32()), found)], names=[*keep, "segmentations"])

    head = [docs.schema[c] for c in keep]
    return in_batches(docs.select(*keep, text_col), uncollected(run), "segmentations array<struct<score:double,ids:array<int>>>", head)


def decode(encoded: DataFrame, keep: list[str], ids_col: str = "ids", model: Model | None = None) -> DataFrame:
    """The columns `keep` with the text of each row's ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(model or load_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(shared.value, 1)
        for batch in batches:
            texts = [encoder.decode(packed(x.as_py() or [])) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(texts, pa.string())], names=[*keep, "text"])

    head = [encoded.schema[c] for c in keep]
    return in_batches(encoded.select(*keep, ids_col), run, "text string", head)


def digests(docs: DataFrame, keep: list[str], text_col: str = "text", n: int = 2, model: Model | None = None, remembered: int = MUCH) -> DataFrame:
    """The columns `keep` with n_tokens, ids_sha256 (ids as little-endian 32-bit), score, the losses of the next n - 1
    segmentations, their digest, and whether the ids decode to the text. No id leaves the task that made it."""
    shared = docs.sparkSession.sparkContext.broadcast(model or load_model())
    names = ["n_tokens", "ids_sha256", "score", "losses", "others_sha256", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(shared.value, n, remembered)
        for batch in batches:
            rows = []
            for x in batch.column(len(keep)):
                text = x.as_py() or ""
                u = encoder.encode(text)
                rows.append((len(u.ids) // 4, hashlib.sha256(u.ids).hexdigest(), u.score, ",".join(f"{loss:.6f}" for loss, _ in u.others), hashlib.sha256(b"".join(ids for _, ids in u.others)).hexdigest(), encoder.decode(u.ids) == text))
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), *(pa.array([r[k] for r in rows], kinds[k]) for k in range(6))], names=[*keep, *names])

    head = [docs.schema[c] for c in keep]
    return in_batches(docs.select(*keep, text_col), uncollected(run), "n_tokens long, ids_sha256 string, score double, losses string, others_sha256 string, round_trip boolean", head)


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), ["doc_id"])
