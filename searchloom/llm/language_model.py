"""Language-model scores by a log-bilinear neural model (operator 2).

The model predicts the class of a token from the classes of the two before it.  The
CLASSES classes are the end of text, the most frequent words, each its own class, and
RARE classes of all other words by their last two bytes; inside a rare class a word has
its smoothed share of the class's count.  So every token, unseen ones too, has a
probability, and those of one context sum to 1.

Training is noise-contrastive estimation in numpy over all learning documents, by
iterative parameter mixing: the documents are dealt to rounds and shards by their hash.
In each round every shard learns its part from the last average, and the parameters and
their Adagrad sums are averaged, weighted by tokens, in a tree of bounded groups.  The
number of shards follows the tokens; how the input is partitioned, and how large the
cluster is, changes nothing.  For scores, two matrix products give
all class scores by context position, and a third, of their exponentials, the
normaliser of every pair of context classes at once.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, resident, text_slices

#: Classes, those for rare words, frequent words that workers hold with their counts
#: (the rest are joined), and distinct words a task counts before it passes them on.
CLASSES, RARE, HEAD, PARTIAL = 2048, 128, 200_000, 300_000
#: Size of the vectors, tokens and shared noise samples of a step, learning rate.
SIZE, STEP, NOISE, RATE = 32, 256, 64, 0.08
#: Rounds of averaging, tokens of a shard in a round (about), tokens whose order is mixed.
ROUNDS, SHARD, MIXED = 4, 1_000_000, 65_536
#: Parameter sets averaged in one task.
GROUP = 16
#: The end of a text; no word is empty.
END = b""


@cache
def suffix_class(suffix: bytes) -> int:
    return CLASSES - RARE + zlib.crc32(suffix) % RARE


def rare_class(word: bytes) -> int:
    return suffix_class(word[-2:])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all texts in ASCII lower case; the end of each text counts once."""
    schema = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType())])

    def out(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for _, texts in text_slices(batch, "text"):
                for t in texts:
                    counts.update(t.lower().split())
                counts[END] += len(texts)
                if len(counts) > PARTIAL:
                    yield out(counts)
                    counts = Counter()
        if counts:
            yield out(counts)

    return docs.select("text").mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Frequent words with their classes and counts, and totals over all words."""

    index: dict[bytes, int]
    count: np.ndarray
    cls: np.ndarray
    total: int
    distinct: int
    #: Of each class: tokens and distinct words.
    tokens: np.ndarray
    words: np.ndarray

    def classes(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(position in the table of frequent words or -1, class) of each word."""
        get = self.index.get
        at = np.fromiter([get(w, -1) for w in words], np.int64, len(words))
        cls = self.cls[at]
        missing = np.flatnonzero(at < 0)
        cls[missing] = [rare_class(words[i]) for i in missing.tolist()]
        return at, cls


def vocabulary(counts: DataFrame) -> Vocabulary:
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head = counts.where(F.length("word") > 0).orderBy(F.desc("n"), "word").limit(HEAD).toArrow()
    ends = counts.where(F.length("word") == 0).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    words = [END, *(w.as_py() for w in head["word"])]
    count = np.array([ends, *head["n"].to_pylist()], np.int64)
    own = CLASSES - RARE
    cls = np.array([i if i < own else rare_class(w) for i, w in enumerate(words)], np.int64)
    # Totals of the rare classes, over all words: a fixed number of rows.
    suffix = F.crc32(F.when(F.length("word") > 2, F.expr("substring(word, length(word) - 1, 2)")).otherwise(F.col("word"))) % RARE
    tokens, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for c, n, k in counts.where(F.length("word") > 0).groupBy(suffix.alias("c")).agg(F.sum("n"), F.count("*")).collect():
        tokens[own + c], kinds[own + c] = n, k
    for w, n, i in zip(words[:own], count[:own], range(own), strict=False):
        tokens[i], kinds[i] = n, n > 0
        if w != END:
            tokens[rare_class(w)] -= n
            kinds[rare_class(w)] -= 1
    return Vocabulary({w: i for i, w in enumerate(words)}, count, cls, total, distinct, tokens, kinds)


# The model ------------------------------------------------------------------


class LogBilinear:
    """score(w | c1, c2) = ([R[c1], R[c2]] @ C) . Q[w, :-1] + Q[w, -1]; c1 is the nearer
    context class."""

    SHAPES = (("R", (CLASSES, SIZE)), ("C", (2 * SIZE, SIZE)), ("Q", (CLASSES, SIZE + 1)))

    def __init__(self, tokens: np.ndarray, seed: tuple[int, ...] = (5,)):
        rng = np.random.default_rng(5)
        self.noise = (tokens + 0.1) / (tokens.sum() + 0.1 * len(tokens))
        self.log_noise = np.log(NOISE * self.noise).astype(np.float32)
        self.upto = np.cumsum(self.noise)
        self.R = rng.normal(0, 0.1, (CLASSES, SIZE)).astype(np.float32)
        self.Q = rng.normal(0, 0.1, (CLASSES, SIZE + 1)).astype(np.float32)
        self.Q[:, -1] = np.log(self.noise)
        self.C = np.concatenate([np.eye(SIZE, dtype=np.float32), 0.5 * np.eye(SIZE, dtype=np.float32)])
        self.past = {name: np.full(shape, 1e-4, np.float32) for name, shape in self.SHAPES}
        self.rng = np.random.default_rng(seed)

    def packed(self) -> np.ndarray:
        """Parameters, then their sums of squared gradients."""
        return np.concatenate([getattr(self, n).ravel() for n, _ in self.SHAPES] + [self.past[n].ravel() for n, _ in self.SHAPES])

    def unpack(self, flat: np.ndarray) -> LogBilinear:
        at = 0
        for past in (False, True):
            for name, shape in self.SHAPES:
                size = math.prod(shape)
                own = flat[at : at + size].reshape(shape).astype(np.float32)
                if past:
                    self.past[name] = own
                else:
                    setattr(self, name, own)
                at += size
        return self

    def update(self, name: str, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Adagrad; with ``rows``, gradients of the same row are added first."""
        param, past = getattr(self, name), self.past[name]
        if rows is None:
            past += grad * grad
            param -= RATE * grad / np.sqrt(past)
            return
        order = np.argsort(rows, kind="stable")
        own = rows[order]
        new = np.empty(len(own), bool)
        new[0] = True
        np.not_equal(own[1:], own[:-1], out=new[1:])
        first = np.flatnonzero(new)
        grad, own = np.add.reduceat(grad[order], first, axis=0), own[first]
        sums = past[own] + grad * grad
        past[own] = sums
        grad /= np.sqrt(sums)
        grad *= RATE
        param[own] -= grad

    def step(self, c2: np.ndarray, c1: np.ndarray, target: np.ndarray) -> None:
        """One step of noise-contrastive estimation; the noise is shared by the step."""
        noise = np.minimum(np.searchsorted(self.upto, self.rng.random(NOISE)), CLASSES - 1).astype(np.uint16)
        n = len(target)
        context = np.concatenate([self.R[c1], self.R[c2]], axis=1)
        q = np.ones((n, SIZE + 1), np.float32)
        q[:, :-1] = context @ self.C
        of_target, of_noise = self.Q[target], self.Q[noise]
        # The gradient of each score: how far the odds against the noise are from right.
        g_target = np.einsum("ij,ij->i", q, of_target) - self.log_noise[target]
        g_noise = q @ of_noise.T - self.log_noise[noise]
        g_target, g_noise = -1 / (1 + np.exp(np.minimum(g_target, 30))), 1 / (1 + np.exp(np.minimum(-g_noise, 30)))
        g_target /= np.float32(n)
        g_noise /= np.float32(n)
        dq = g_target[:, None] * of_target[:, :-1] + g_noise @ of_noise[:, :-1]
        of_context = dq @ self.C.T
        of_q = np.empty((n + NOISE, SIZE + 1), np.float32)
        np.multiply(q, g_target[:, None], out=of_q[:n])
        np.matmul(g_noise.T, q, out=of_q[n:])
        self.update("C", context.T @ dq)
        self.update("Q", of_q, np.concatenate([target, noise]))
        self.update("R", np.concatenate([of_context[:, :SIZE], of_context[:, SIZE:]]), np.concatenate([c1, c2]))

    def learn(self, cls: np.ndarray, starts: np.ndarray) -> None:
        """Steps over texts laid end to end; ``starts``: where each begins."""
        c1, c2 = contexts(cls.astype(np.uint16), starts)
        cls = cls.astype(np.uint16)
        order = self.rng.permutation(len(cls))
        for at in range(0, len(cls), STEP):
            i = order[at : at + STEP]
            self.step(c2[i], c1[i], cls[i])

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(S1, S2, log Z): scores by the nearer and the farther context class, and the
        normaliser of every (nearer, farther) pair."""
        s1 = (self.R @ self.C[:SIZE]) @ self.Q[:, :-1].T
        s2 = (self.R @ self.C[SIZE:]) @ self.Q[:, :-1].T + self.Q[:, -1]
        top1, top2 = s1.max(1, keepdims=True), s2.max(1, keepdims=True)
        z = np.exp(s1 - top1) @ np.exp(s2 - top2).T
        return s1, s2, np.log(np.maximum(z, 1e-37)) + top1 + top2.T


def contexts(cls: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes one and two places before; the end's class (0) before a text."""
    c1, c2 = np.zeros_like(cls), np.zeros_like(cls)
    c1[1:], c2[2:] = cls[:-1], cls[:-2]
    c1[starts] = c2[starts] = 0
    second = starts + 1
    c2[second[second < len(cls)]] = 0
    return c1, c2


def laid_out(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    words: list[bytes] = []
    starts = []
    for t in texts:
        starts.append(len(words))
        words += t.lower().split()
        words.append(END)
    return words, np.array(starts, np.int64)


def class_rows(docs: DataFrame, shared) -> DataFrame:
    """(round, shard, place, classes) of all of ``docs`` (place, text): the token classes
    of each text as 16-bit numbers, dealt by the hash ``place``."""
    schema = T.StructType([T.StructField("place", T.LongType()), T.StructField("classes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch, "text"):
                words, starts = laid_out(texts)
                cls = shared.value.classes(words)[1].astype("<u2")
                found = [x.tobytes() for x in np.split(cls, starts[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array(found, pa.binary())], names=schema.names)

    shards = max(1, -(-int(shared.value.total) // (ROUNDS * SHARD)))
    dealt = docs.select("place", "text").mapInArrow(run, schema)
    return dealt.select(F.pmod("place", F.lit(ROUNDS)).cast("int").alias("round"), F.pmod(F.floor(F.col("place") / ROUNDS), F.lit(shards)).cast("int").alias("shard"), "place", "classes")


def learned(batches: Iterator[pa.RecordBatch], tokens: np.ndarray, start: np.ndarray, number: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(shard, tokens, parameters) of each shard in rows sorted by (shard, place).

    Texts are gathered to MIXED tokens, wherever batches end.
    """
    model, shard, seen, held, size = None, None, 0, [], 0

    def step() -> None:
        cls = np.concatenate(held)
        model.learn(cls, np.cumsum([0, *map(len, held[:-1])]))

    for batch in batches:
        for own, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if own != shard:
                if held:
                    step()
                if model is not None:
                    yield shard, seen, model.packed()
                model, shard, seen, held, size = LogBilinear(tokens, (5, number, own)).unpack(start), own, 0, [], 0
            held.append(np.frombuffer(raw.as_py(), "<u2"))
            size += len(held[-1])
            seen += len(held[-1])
            if size >= MIXED:
                step()
                held, size = [], 0
    if held:
        step()
    if model is not None:
        yield shard, seen, model.packed()


def average(found: DataFrame) -> np.ndarray | None:
    """The mean of parameter rows (id, tokens, params), weighted by tokens."""
    names = found.columns

    def mean(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("id", "tokens", "params")), strict=True))
        weight = sum(n for _, n, _ in rows)
        total = sum(np.frombuffer(p, np.float32).astype(np.float64) * (n / weight) for _, n, p in rows)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([weight]), pa.array([total.astype(np.float32).tobytes()])], names=names)

    while (n := found.count()) > GROUP:
        # The ids of n rows lie close together, so groups stay near GROUP rows.
        groups = found.withColumn("group", F.col("id") % -(-n // GROUP)).groupBy("group")
        more = materialize(groups.applyInArrow(mean, found.schema), "lm-params", plain=True)
        discard(found)
        found = more
    parts = found.orderBy("id").collect()
    discard(found)
    weight = sum(p.tokens for p in parts)
    return sum(np.frombuffer(p.params, np.float32).astype(np.float64) * (p.tokens / weight) for p in parts) if parts else None


def train(docs: DataFrame, vocab: Vocabulary) -> LogBilinear:
    """A model of all texts of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocab)
    rows = materialize(class_rows(docs.select(F.xxhash64("doc_id", "text").alias("place"), "text"), shared), "lm-classes", plain=True)
    shared.unpersist()
    shards = max(1, -(-int(vocab.total) // (ROUNDS * SHARD)))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("tokens", T.DoubleType()), T.StructField("params", T.BinaryType())])
    model = LogBilinear(vocab.tokens)
    for number in range(ROUNDS):
        start = spark.sparkContext.broadcast((vocab.tokens, model.packed(), number))

        def run(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            for shard, seen, params in learned(batches, *start.value):
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([float(seen)]), pa.array([params.tobytes()], pa.binary())], names=schema.names)

        own = rows.where(F.col("round") == number).select("shard", "place", "classes").repartitionById(shards, "shard").sortWithinPartitions("shard", "place")
        flat = average(materialize(own.select("shard", "classes").mapInArrow(run, schema), "lm-params", plain=True))
        start.unpersist()
        if flat is not None:
            model.unpack(flat)
    discard(rows)
    return model


class Scorer:
    def __init__(self, vocab: Vocabulary, flat: np.ndarray):
        self.vocab = vocab
        self.s1, self.s2, self.log_z = LogBilinear(vocab.tokens).unpack(flat).tables()
        self.base = np.log10((vocab.count + 1) / base_total(vocab))
        shares = np.log10((vocab.count + 1) / class_total(vocab)[vocab.cls])
        self.share = np.where(vocab.cls >= CLASSES - RARE, shares, 0.0)

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], tuple[np.ndarray, pa.DictionaryArray, np.ndarray]]:
        """(tokens, [known, base, score]) of each text without its words outside the
        table of frequent words, and (text, word, number) of those."""
        words, starts = laid_out(texts)
        at, cls = self.vocab.classes(words)
        c1, c2 = contexts(cls, starts)
        log_p = (self.s1[c1, cls] + self.s2[c2, cls] - self.log_z[c1, c2]).astype(np.float64) / math.log(10)
        known = at >= 0
        base = np.where(known, self.base[at], 0.0)
        log_p += np.where(known, self.share[at], 0.0)
        known &= self.vocab.count[at] > 0
        sums = [np.add.reduceat(x, starts) for x in (known.astype(np.int64), base, log_p)]
        missing = np.flatnonzero(at < 0)
        of = np.searchsorted(starts, missing, side="right") - 1
        coded = pa.array([words[i] for i in missing.tolist()], pa.binary()).dictionary_encode()
        kinds = max(1, len(coded.dictionary))
        pair, n = np.unique(of * kinds + coded.indices.to_numpy(), return_counts=True)
        tail = pa.DictionaryArray.from_arrays(pa.array((pair % kinds).astype(np.int32)), coded.dictionary)
        return np.append(starts[1:], len(words)) - starts, sums, (pair // kinds, tail, n)


def base_total(vocab: Vocabulary) -> float:
    return vocab.total + 1 * (vocab.distinct + 1)


def class_total(vocab: Vocabulary) -> np.ndarray:
    """Of each class: counts, one more for each word, and one for all unseen words."""
    return vocab.tokens + vocab.words + 1


def score_documents(docs: DataFrame, counts: DataFrame, vocab: Vocabulary, model: LogBilinear) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, held_out): doc_id, held_out, n_tokens,
    n_known, base_score, score (base 10 logarithms).

    Null and empty texts are one end token; texts of any length are scored whole.
    Repeated rows are scored one by one, other columns are not looked at.  Counts of
    words outside the table of frequent words come by a join.
    """
    shared, key = docs.sparkSession.sparkContext.broadcast((vocab, model.packed())), uuid.uuid4().hex
    schema = T.StructType(
        [T.StructField("row", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType())]
        + [T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known")]
        + [T.StructField(c, T.DoubleType()) for c in ("base_score", "score")]
        + [T.StructField("word", T.BinaryType()), T.StructField("cls", T.IntegerType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = resident(("scorer", key), lambda: Scorer(*shared.value))
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for start, texts in text_slices(batch, "text"):
                n, (known, base, score), (of, words, times) = own.score(texts)
                rows, rest = row + np.arange(len(texts)), len(of)
                # A key that no word has, and no other row: the join leaves it alone.
                keys = pa.array([b" %d" % r for r in rows.tolist()], pa.binary())
                cls = np.array([rare_class(w) for w in words.dictionary.to_pylist()], np.int32)[words.indices.to_numpy()]
                none = lambda kind, k=rest: pa.nulls(k, kind)
                columns = [
                    (pa.array(rows), pa.array(row + of)),
                    (batch.column(0).slice(start, len(texts)), none(pa.int64())),
                    (batch.column(2).slice(start, len(texts)), none(pa.bool_())),
                    (pa.array(n), pa.array(times)),
                    (pa.array(known), none(pa.int64())),
                    (pa.array(base), none(pa.float64())),
                    (pa.array(score), none(pa.float64())),
                    (keys, words.cast(pa.binary())),
                    (pa.nulls(len(texts), pa.int32()), pa.array(cls, pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], names=schema.names)
                row += len(texts)

    # Written, as rows are numbered in the order they come in: whatever is run again
    # after this finds each cell under the number it had.
    cells = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out").mapInArrow(run, schema), "lm-cells")
    totals = F.array(*(F.lit(float(x)) for x in class_total(vocab)[CLASSES - RARE :]))
    c, own = F.coalesce("n", F.lit(0)), F.col("cls").isNull()
    share = F.element_at(totals, F.col("cls") - (CLASSES - RARE) + 1)
    every = cells.join(counts, "word", "left").select(
        "row",
        "doc_id",
        "held_out",
        F.when(own, F.col("n_tokens")).otherwise(0).alias("n_tokens"),
        F.when(own, F.col("n_known")).when(c > 0, F.col("n_tokens")).otherwise(0).alias("n_known"),
        F.when(own, F.col("base_score")).otherwise(F.col("n_tokens") * F.log10((c + 1) / F.lit(float(base_total(vocab))))).alias("base_score"),
        F.when(own, F.col("score")).otherwise(F.col("n_tokens") * F.log10((c + 1) / share)).alias("score"),
    )
    summed = every.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *(F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base_score", "score")))
    return summed.drop("row")


def language_model_scores(docs: DataFrame, held_out) -> DataFrame:
    """``score_documents`` of all rows of ``docs`` by a model of those that are not
    ``held_out`` (a column expression; null counts as false), with ``train_tokens``."""
    docs = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    learn = docs.where(~F.col("held_out"))
    counts = materialize(word_counts(learn), "lm-counts")
    vocab = vocabulary(counts)
    model = train(learn, vocab)
    return score_documents(docs, counts, vocab, model).withColumn("train_tokens", F.lit(int(vocab.total)).cast("long"))
