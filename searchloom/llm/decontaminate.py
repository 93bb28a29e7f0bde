"""Benchmark decontamination by pigeonhole edit matching (operator 3).

A test item of m characters may occur with up to e = m * ERRORS edits.  Cut into e + 1
pieces, at least one piece then stands in the text unchanged, so an exact search for
the pieces of all items (one automaton, one pass over a text) finds every place worth
a look.  There, Myers' bit-parallel algorithm gives the edit distance.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, resident, text_slices

#: Edits allowed for each character of an item; characters of items that are sent to
#: the workers at once (larger benchmarks are taken block by block).
ERRORS, BLOCK_CHARS = 0.05, 4_000_000

_SPACE = bytes(c if chr(c).isalnum() or c >= 0x80 else 0x20 for c in range(256))

MATCHES = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType())]
    + [T.StructField(c, T.IntegerType()) for c in ("distance", "start", "stop", "item_chars")]
)


def normalized(text: bytes) -> str:
    """Lower case, runs of ASCII punctuation and white space as one space."""
    lower = text.decode("utf-8", "replace").lower().encode()
    return b" ".join(lower.translate(_SPACE).split()).decode()


def budget(item: str, errors: float = ERRORS) -> int:
    return int(len(item) * errors)


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece): ``edits + 1`` pieces of nearly equal length."""
    cuts = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def myers(pattern: str, text: str, most: int) -> tuple[int, int]:
    """(distance, stop) of the best occurrence of ``pattern`` that ends anywhere in
    ``text`` and starts anywhere, the first of equals; distance over ``most`` if none."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, high = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best = mask, 0, m, (most + 1, 0)
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        d0 = (((eq & vp) + vp) ^ vp) | eq | vn
        hp = vn | ~(d0 | vp) & mask
        hn = d0 & vp
        score += bool(hp & high) - bool(hn & high)
        hp = hp << 1 & mask
        vp = (hn << 1 & mask) | ~(d0 | hp) & mask
        vn = hp & d0
        if score < best[0]:
            best = (score, j)
    return best


class Matcher:
    """The pieces of a block of items, ready for search."""

    def __init__(self, items: list[tuple[int, str]], errors: float):
        self.items = [(i, t, budget(t, errors)) for i, t in items if t]
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, edits) in enumerate(self.items):
            for offset, piece in pieces(text, edits):
                places.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.any = bool(places)

    def find(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item_id, distance, start, stop, characters of the item): the best
        occurrence of each item in ``text``."""
        if not self.any:
            return []
        starts: dict[int, list[int]] = {}
        for last, (size, where) in self.automaton.iter(text):
            for n, offset in where:
                starts.setdefault(n, []).append(last - size + 1 - offset)
        return [(self.items[n][0], *found, len(self.items[n][1])) for n, s in starts.items() if (found := self.verify(n, s, text))]

    def verify(self, n: int, starts: list[int], text: str) -> tuple[int, int, int] | None:
        """(distance, start, stop).  Windows that overlap are searched as one, so a text
        is passed once however many pieces it holds."""
        _, item, edits = self.items[n]
        if (at := text.find(item)) >= 0:
            return 0, at, at + len(item)
        windows: list[list[int]] = []
        for start in sorted(starts):
            left, right = max(0, start - edits), start + len(item) + edits
            if windows and left <= windows[-1][1]:
                windows[-1][1] = right
            else:
                windows.append([left, right])
        best = None
        for left, right in windows:
            distance, stop = myers(item, text[left:right], edits)
            if distance <= edits and (best is None or distance < best[0]):
                # The start: the same search from the end backwards.
                _, back = myers(item[::-1], text[left : left + stop][::-1], distance)
                best = distance, left + stop - back, left + stop
        return best


def blocks_of(benchmark: DataFrame, errors: float) -> Iterator:
    """Broadcast (key, items, errors) for each BLOCK_CHARS characters of items."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_CHARS) or 1
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").toArrow()
        rows = [(i.as_py(), normalized(t.as_py().encode())) for i, t in zip(own["item_id"], own["text"], strict=True)]
        yield benchmark.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, rows, errors))


def opened(shared) -> Matcher:
    """One automaton for each worker process, however many tasks it runs."""
    key, items, errors = shared.value
    return resident(("matcher", key), lambda: Matcher(items, errors))


def matches(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS) -> DataFrame:
    """(doc_id, item_id, distance, start, stop, item_chars): for each document and
    test item within the error budget, the best occurrence, in positions of the
    normalised text.  Documents without one give no row.

    Null or empty texts and items (also of punctuation alone) match nothing; repeated
    rows give repeated rows; an item repeated under several ids matches under each; of
    equally distant occurrences the first is given.  Texts are searched whole.  Other
    columns are not looked at.  A benchmark of several blocks takes a pass for each.
    """
    found = None
    for shared in blocks_of(benchmark, errors):
        part = search(docs, shared)
        found = part if found is None else found.unionByName(part)
    return found


def search(docs: DataFrame, shared) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = opened(shared)
        for batch in batches:
            rows: list[tuple] = []
            ids = batch.column(0)
            for start, texts in text_slices(batch, "text"):
                for i, text in enumerate(texts):
                    found = matcher.find(normalized(text))
                    if found:
                        doc = ids[start + i].as_py()
                        rows += [(doc, *f) for f in found]
            if rows:
                kinds = (pa.int64(), pa.int64(), *[pa.int32()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=MATCHES.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, MATCHES)


def decontaminated(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS) -> DataFrame:
    """The rows of ``docs`` whose text holds no item within the error budget.

    Each row is judged by its own text, also where a doc_id repeats, so no row is moved.
    Rows with null or empty texts stay; all columns do.
    """

    def cleaned(docs: DataFrame, shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = opened(shared)
            for batch in batches:
                clean = [not matcher.find(normalized(t)) for _, texts in text_slices(batch, "text") for t in texts]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return docs.mapInArrow(run, docs.schema)

    for i, shared in enumerate(blocks_of(benchmark, errors)):
        # One block at a time, so that a worker holds one automaton.
        docs = cleaned(materialize(docs, "decontamination") if i else docs, shared)
    return docs
