"""Language identification by Kneser-Ney character models (operator 8).

Each language has an interpolated Kneser-Ney model of the characters of a word given
the three before them.  Counts come from all learning documents: every task counts
the 4-grams of its texts, Spark adds them up.  A model is a set of sorted
arrays of packed n-grams, with one column of probabilities for each language, and a
table of hashes into the longest.  It holds every n-gram of the learning documents, and
so grows with their distinct 4-grams.

Characters are UTF-16 code units, so four fill 64 bits and no two n-grams are packed
alike; a letter beyond 16 bits is two of them.

A text's score under a language is the mean log probability of its characters; the
language with the lowest cross-entropy wins.  A temperature turns the gaps between
languages into a probability; it is fitted on an eighth of the learning documents, left
out of the counts that it is fitted with.  Cross-entropy bounds by length reject texts
that are like none of the languages; they come from all learning documents, so none of
these is rejected.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, resident, text_slices

#: Temperatures that are tried.
TEMPERATURES = (0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0)
#: A text is rejected above SLACK times the largest cross-entropy of the learning
#: documents that are as long (ENOUGH of the longest at least), plus MARGIN nats (about
#: one unseen character) over its number of characters.
SLACK, ENOUGH, MARGIN = 1.15, 1_000, 10.0
#: One learning document in so many is left out of the counts for the temperature.
FOLDS = 8
#: Bytes of text that are scored at once, and distinct 4-grams a task counts before it
#: passes them on.
BLOCK, PARTIAL = 1 << 19, 1_000_000
DISCOUNT = 0.75
LETTER = re.compile(r"[^\W\d_]")
BEYOND, FOUR_BYTES, SPACES = re.compile("[\U00010000-\U0010ffff]"), re.compile(rb"[\xf0-\xf4]"), re.compile(rb"\s")
#: Codes of a word's start and end.
START, END = 1, 2


@cache
def letter_units() -> np.ndarray:
    """Which code units are letters.  Halves of a pair are; see ``units``."""
    table = np.zeros(1 << 16, bool)
    for i in range(1 << 16):
        table[i] = 0xD800 <= i < 0xE000 or LETTER.match(chr(i)) is not None
    return table


def pieces_of(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """(numbers of the texts, pieces) in blocks of about BLOCK bytes.  Longer texts are
    cut at white space, which no n-gram goes across."""
    of, own, size = [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while True:
            stop = len(text)
            if stop - at > BLOCK and (cut := SPACES.search(text, at + BLOCK)):
                stop = cut.start()
            of.append(i)
            own.append(text[at:stop])
            size += stop - at
            at = stop
            if size >= BLOCK:
                yield of, own
                of, own, size = [], [], 0
            if at >= len(text):
                break
    if own:
        yield of, own


def units(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(code units in lower case, the number of the piece that each belongs to); each
    piece ends with a zero."""
    raw = b"\0".join([p.replace(b"\0", b" ") if b"\0" in p else p for p in pieces]) + b"\0"
    text = raw.decode("utf-8", "ignore").lower()
    if FOUR_BYTES.search(raw):
        text = BEYOND.sub(lambda m: m.group() if LETTER.match(m.group()) else " ", text)
    found = np.frombuffer(text.encode("utf-16-le"), "<u2")
    ends = found == 0
    return found, np.cumsum(ends, dtype=np.int32) - ends


def grams(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(packed 4-grams of all words, the number of the piece that each is from): one for
    each letter and one for the end of each word."""
    own, of = units(pieces)
    letter = letter_units()[own]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # and what follows a word
    own, of, letter = own[keep].astype(np.uint64), of[keep], letter[keep]
    before = np.where(letter, own, np.uint64(START))
    own = np.where(letter, own, np.uint64(END))
    key, last = own, np.zeros(len(own), bool)
    for i in (1, 2, 3):
        one = np.full(len(own), START, np.uint64)
        one[i:] = before[:-i] if i < len(own) else before[:0]
        one[last] = START
        last = one == START
        key = key | one << np.uint64(16 * i)
    return key, of


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n[order], first) if len(first) else n[:0]


def length_class(chars: np.ndarray) -> np.ndarray:
    return np.log2(chars).astype(np.int64)


@dataclass
class Model:
    """grams[k], p[k]: sorted packed n-grams of order 4-k and their interpolated log
    probabilities by language; contexts[k], back[k]: contexts and the log weight that
    each leaves to the next lower order.  most: the largest cross-entropy of learning
    documents by length class."""

    languages: list[str]
    grams: list[np.ndarray]
    p: list[np.ndarray]
    contexts: list[np.ndarray]
    back: list[np.ndarray]
    uniform: np.ndarray
    temperature: float = 1.0
    most: np.ndarray = field(default_factory=lambda: np.full(64, np.inf))

    def reject_above(self, chars: np.ndarray) -> np.ndarray:
        """The largest cross-entropy that texts of so many characters may have."""
        chars = np.maximum(chars, 1)
        return self.most[length_class(chars)] * SLACK + MARGIN / chars

    def log_p(self, key: np.ndarray) -> np.ndarray:
        """Log probabilities of 4-grams, one column for each language."""
        out = np.zeros((len(key), len(self.languages)), np.float32)
        left, rest = np.arange(len(key)), key
        for k, bits in enumerate((64, 48, 32, 16)):
            own = rest if bits == 64 else rest & np.uint64((1 << bits) - 1)
            at = np.minimum(np.searchsorted(self.grams[k], own), len(self.grams[k]) - 1)
            hit = self.grams[k][at] == own
            out[left[hit]] += self.p[k][at[hit]]
            left, rest, own = left[~hit], rest[~hit], own[~hit]
            if not len(left):
                return out
            ctx = own >> np.uint64(16)
            at = np.minimum(np.searchsorted(self.contexts[k], ctx), len(self.contexts[k]) - 1)
            seen = self.contexts[k][at] == ctx
            out[left[seen]] += self.back[k][at[seen]]
        out[left] += self.uniform
        return out


class Scorer:
    """A model, and for each slot of a table of hashes a 4-gram that falls into it: most
    are found there, the others in the sorted arrays."""

    def __init__(self, model: Model):
        self.model = model
        bits = max(10, int(len(model.grams[0])).bit_length() + 2)
        self.shift = np.uint64(64 - bits)
        self.slot = np.zeros(1 << bits, np.int32)
        self.slot[self.hashed(model.grams[0])] = np.arange(len(model.grams[0]), dtype=np.int32)

    def hashed(self, key: np.ndarray) -> np.ndarray:
        return (key * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def log_p(self, key: np.ndarray) -> np.ndarray:
        at = self.slot[self.hashed(key)]
        out = self.model.p[0][at]
        missed = np.flatnonzero(self.model.grams[0][at] != key)
        out[missed] = self.model.log_p(key[missed])
        return out

    def totals(self, texts: list[bytes]) -> np.ndarray:
        """A row for each text: summed log probability by language, then characters."""
        out = np.zeros((len(texts), len(self.model.languages) + 1))
        for of, pieces in pieces_of(texts):
            key, piece = grams(pieces)
            p = self.log_p(key)
            sums = [np.bincount(piece, p[:, j], len(pieces)) for j in range(p.shape[1])]
            np.add.at(out, np.array(of), np.stack([*sums, np.bincount(piece, minlength=len(pieces))], 1))
        return out


def totals(scorer: Scorer, batch: pa.RecordBatch, name: str) -> np.ndarray:
    sums = [scorer.totals(texts) for _, texts in text_slices(batch, name)]
    return np.concatenate([np.zeros((0, len(scorer.model.languages) + 1)), *sums])


def count_grams(learn: DataFrame) -> DataFrame:
    """(lang, gram, n, fit): 4-grams of all of ``learn`` (text, lang, left), and of
    those that are not ``left`` out for the temperature."""
    schema = T.StructType([T.StructField("lang", T.StringType()), *(T.StructField(k, T.LongType()) for k in ("gram", "n", "fit"))])

    def out(counts: dict[tuple, list]) -> Iterator[pa.RecordBatch]:
        for (lang, left), found in counts.items():
            key, n = summed(*map(np.concatenate, zip(*found, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key)), pa.array(key.view(np.int64)), pa.array(n), pa.array(n * (not left))], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, list] = {}
        size = 0
        for batch in batches:
            kinds = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            for start, texts in text_slices(batch, "text"):
                by: dict[tuple, list] = {}
                for i, text in enumerate(texts):
                    by.setdefault(kinds[start + i], []).append(text)
                for kind, own in by.items():
                    for _, pieces in pieces_of(own):
                        found = np.unique(grams(pieces)[0], return_counts=True)
                        counts.setdefault(kind, []).append(found)
                        size += len(found[0])
                if size > PARTIAL:
                    counts = {kind: [summed(*map(np.concatenate, zip(*found, strict=True)))] for kind, found in counts.items()}
                    size = sum(len(found[0][0]) for found in counts.values())
                    if size > PARTIAL // 2:
                        yield from out(counts)
                        counts, size = {}, 0
        yield from out(counts)

    partial = learn.select("text", "lang", "left").mapInArrow(run, schema)
    return partial.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("fit").alias("fit"))


def build(languages: list[str], tables: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """Interpolated Kneser-Ney from the 4-grams (sorted keys, counts) of each language.

    Below the highest order a count is the number of distinct characters that an
    n-gram was seen after.
    """
    orders: list[list[tuple]] = [[] for _ in range(4)]
    for key, n in tables:
        key, n = key.astype(np.uint64), n.astype(np.float64)
        for k in range(4):
            ctx, of = np.unique(key >> np.uint64(16), return_inverse=True)
            total, kinds = np.bincount(of, n), np.bincount(of)
            orders[k].append((key, np.maximum(n - DISCOUNT, 0) / total[of], ctx, DISCOUNT * kinds / total))
            if k < 3:
                key, n = summed(key & np.uint64((1 << (48 - 16 * k)) - 1), np.ones(len(key)))
    none = np.zeros(1, np.uint64)
    all_grams = [np.unique(np.concatenate([none, *(t[0] for t in o)])) for o in orders]
    contexts = [np.unique(np.concatenate([none, *(t[2] for t in o)])) for o in orders]
    size = max(2, len(all_grams[3]))
    lower = np.full((1, len(languages)), 1 / size)
    p: list[np.ndarray] = [None] * 4  # type: ignore[list-item]
    back: list[np.ndarray] = [None] * 4  # type: ignore[list-item]
    for k in (3, 2, 1, 0):
        own, ctx = all_grams[k], contexts[k]
        weight = np.ones((len(ctx), len(languages)))
        direct = np.zeros((len(own), len(languages)))
        for j, (key, value, c, w) in enumerate(orders[k]):
            direct[np.searchsorted(own, key), j] = value
            weight[np.searchsorted(ctx, c), j] = w
        at = np.minimum(np.searchsorted(ctx, own >> np.uint64(16)), len(ctx) - 1)
        hold = np.where((ctx[at] == own >> np.uint64(16))[:, None], weight[at], 1.0)
        if k == 3:
            below = np.repeat(lower, len(own), 0)
        else:
            suffix = own & np.uint64((1 << (48 - 16 * k)) - 1)
            found = np.minimum(np.searchsorted(all_grams[k + 1], suffix), len(all_grams[k + 1]) - 1)
            below = np.exp(p[k + 1][found])
        p[k] = np.log(direct + hold * below).astype(np.float32)
        back[k] = np.log(weight).astype(np.float32)
    return Model(languages, all_grams, p, contexts, back, np.full(len(languages), -np.log(size), np.float32))


def train(learn: DataFrame) -> Model:
    """A model of all rows of ``learn`` (doc_id, text, lang; lang not null).  Null texts
    count nothing, repeated rows count repeatedly."""
    left = F.pmod(F.xxhash64("text"), F.lit(FOLDS)) == 0
    learn = learn.where(F.col("lang").isNotNull()).select("text", "lang", left.alias("left"))
    counted = materialize(count_grams(learn), "language-grams", plain=True)
    found = counted.toArrow()
    discard(counted)
    names = found["lang"].combine_chunks().dictionary_encode()
    languages = sorted(names.dictionary.to_pylist())
    if not languages:
        return build(["und"], [(np.array([1], np.uint64), np.array([1]))])
    own, gram, n, fit = names.indices.to_numpy(), found["gram"].to_numpy().view(np.uint64), found["n"].to_numpy(), found["fit"].to_numpy()
    order = np.argsort(gram, kind="stable")
    tables, fits = [], []
    for lang in languages:
        rows = order[own[order] == names.dictionary.index(lang).as_py()]
        tables.append((gram[rows], n[rows]))
        rows = rows[fit[rows] > 0]
        fits.append((gram[rows], fit[rows]))
    model = build(languages, tables)
    calibrate(model, build(languages, fits), learn)
    return model


def calibrate(model: Model, fitted: Model, learn: DataFrame) -> None:
    """Temperature by the likelihood of the documents left out of the model ``fitted``,
    and the bounds of rejection from all documents of ``learn``: each task adds up its
    own by length class, Spark adds up the tasks."""
    shared = learn.sparkSession.sparkContext.broadcast((model, fitted))
    key = uuid.uuid4().hex
    fits = [f"fit_{i}" for i in range(len(TEMPERATURES))]
    schema = T.StructType([T.StructField("class", T.LongType()), T.StructField("n", T.LongType()), *(T.StructField(k, T.DoubleType()) for k in ("most", *fits))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, other = resident(("language", key), lambda: tuple(map(Scorer, shared.value)))
        index = {lang: j for j, lang in enumerate(own.model.languages)}
        n, most, fit = np.zeros(64, np.int64), np.zeros(64), np.zeros((len(TEMPERATURES), 64))
        for batch in batches:
            total = totals(own, batch, "text")
            total = total[total[:, -1] > 0]
            if len(total):
                of = length_class(total[:, -1])
                n += np.bincount(of, minlength=64)
                np.maximum.at(most, of, (-total[:, :-1] / total[:, -1:]).min(1))
            out = batch.filter(batch.column(2))
            total = totals(other, out, "text")
            some = total[:, -1] > 0
            right = np.array([index[lang] for lang in out.column(1).to_pylist()], np.int64)[some]
            total = total[some]
            if len(total):
                rate, of = -total[:, :-1] / total[:, -1:], length_class(total[:, -1])
                for i, t in enumerate(TEMPERATURES):
                    z = (rate.min(1, keepdims=True) - rate) / t
                    fit[i] += np.bincount(of, np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), right], 64)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, n[at], most[at], *fit[:, at])], names=schema.names)

    sums = learn.mapInArrow(run, schema).groupBy("class").agg(F.sum("n").alias("n"), F.max("most").alias("most"), *(F.sum(k).alias(k) for k in fits)).collect()
    shared.unpersist()
    if not sums:
        return
    model.temperature = min((sum(r[k] for r in sums), t) for k, t in zip(fits, TEMPERATURES, strict=True))[1]
    found, most, top = 0, 0.0, 64
    for r in sorted(sums, key=lambda r: -r["class"]):
        found, most = found + r["n"], max(most, r["most"])
        if found >= ENOUGH:
            model.most[r["class"] : top] = most
            top = r["class"]
    model.most[:top] = most


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``lang_pred``, ``score`` (0 to 1), ``cross_entropy`` and ``rejected``.

    A null text, or one without letters, is ``und`` with score 0 and rejected.  So is,
    but for its language, a text above the model's cross-entropy bound for its length.
    Of equal languages the first by name is taken; repeated rows are predicted alike.
    Columns of these names are replaced, others kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    made = {"lang_pred": T.StringType(), "score": T.DoubleType(), "cross_entropy": T.DoubleType(), "rejected": T.BooleanType()}
    kept = [f for f in docs.schema.fields if f.name.lower() not in made]
    schema = T.StructType([*kept, *(T.StructField(k, v) for k, v in made.items())])
    names = [f.name for f in kept]
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = resident(("language", key), lambda: Scorer(shared.value))
        own = scorer.model
        for batch in batches:
            total = totals(scorer, batch, text)
            chars = total[:, -1]
            rate = -total[:, :-1] / np.maximum(chars, 1)[:, None]
            best = rate.argmin(1)
            z = np.exp((rate.min(1, keepdims=True) - rate) / own.temperature)
            score = np.where(chars > 0, 1 / z.sum(1), 0.0)
            lang = [own.languages[b] if c > 0 else "und" for b, c in zip(best, chars, strict=True)]
            entropy = np.where(chars > 0, rate.min(1), np.nan)
            columns = [batch.column(batch.schema.get_field_index(k)) for k in names]
            columns += [pa.array(lang, pa.string()), pa.array(score), pa.array(entropy, mask=~(chars > 0)), pa.array(~(chars > 0) | (rate.min(1) > own.reject_above(chars)))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *made])

    return docs.mapInArrow(run, schema)
