"""Near-duplicate documents by MinHash with tensored banding (operator 9).

A document is the set of its distinct k-word shingles.  ``m`` sub-hashes A_1..A_m and
``m`` others B_1..B_m, of two minhashes each, are combined to ``m * m`` table keys
(A_i, B_j): as many tables as plain banding would need ``4 * m * m`` minhashes for are
made from ``4 * m``.  Two sets of similarity J share a key unless all A or all B
differ, with probability 2 * (1 - J^2)^m; ``m`` is chosen from the threshold so that
this is under MISSED at the threshold, and less above it.  Keys are formed only from
sub-hashes that two documents have: any other key would stand alone.

Candidates are verified on full sets, after bounds on size and a sketch.  A bucket of
any size costs work in proportion to its rows: its documents are held against the one
that shares most buckets with others, as what near copies were made from does.  A
document is first held against one such centre, then, if their components differ,
against that of each of its buckets.  What is left to compare are
documents of different components.  There, documents outside the largest component of
a bucket are compared with all in it; within a component no further link can change
the result, so its documents are never compared with each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, text_slices

#: Chance that a pair just at the threshold shares no table.
MISSED = 5e-5
#: Bins of a sketch, of four bits each, and the 64-bit numbers that hold it.
BINS, LONGS = 512, 32
#: Words handled at once.
RUN = 150_000

FEATURES = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType())]
    + [T.StructField(c, T.ArrayType(T.LongType())) for c in ("a", "b", "sketch")]
)


def tables_for(percent: int) -> int:
    """``m``: sub-hashes of each of the two collections."""
    j = percent / 100
    return max(2, math.ceil(math.log(MISSED / 2) / math.log(max(1e-9, 1 - j * j))))


def sketch_bound(percent: int) -> int:
    """Bins in which sketches of linked sets may differ: 4.5 standard deviations over
    the mean at the threshold (beyond it by chance: under 1 in 10^5)."""
    j = percent / 100
    return math.ceil(BINS * (1 - j) + 4.5 * math.sqrt(BINS * j * (1 - j)))


def runs_of(texts: list[bytes]) -> Iterator[list[list[bytes]]]:
    """The words of the texts, ASCII lower case, RUN words or one text at once."""
    run, size = [], 0
    for t in texts:
        run.append(t.lower().split())
        size += len(run[-1])
        if size >= RUN:
            yield run
            run, size = [], 0
    if run:
        yield run


def shingle_sets(docs: list[list[bytes]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sets laid end to end, where each ends): of each document the sorted distinct
    64-bit hashes of its k-word shingles; of the whole sequence as one shingle if there
    are fewer words; none without words."""
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(docs)), np.uint64, int(sizes.sum()))
    n = max(len(h) - k + 1, 0)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    sets, at = [], 0
    for words, size in zip(docs, sizes.tolist(), strict=True):
        if size >= k:
            own = np.sort(out[at : at + size - k + 1])
            sets.append(own[np.r_[True, own[1:] != own[:-1]]])
        elif size:
            sets.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=size)], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
        at += size
    return np.concatenate(sets), np.cumsum(np.fromiter(map(len, sets), np.int64, len(sets)))


def seeds(m: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240917)
    return rng.integers(0, 1 << 63, 4 * m, dtype=np.uint64), rng.integers(0, 1 << 63, 4 * m, dtype=np.uint64) | np.uint64(1)


def minhashes(flat: np.ndarray, starts: np.ndarray, xor: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """A row of minhashes for each of the sets that begin at ``starts``, none empty."""
    low = np.empty((len(starts), len(xor)), np.uint64)
    for j in range(len(xor)):
        part = (flat ^ xor[j]) * odd[j]
        part ^= part >> np.uint64(31)
        low[:, j] = np.minimum.reduceat(part, starts)
    return low


def combined(low: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The A and B sub-hashes, of two minhashes each; the position is mixed in."""
    pair = low.reshape(len(low), 2 * m, 2)
    mix = (pair[:, :, 0] * np.uint64(0xFF51AFD7ED558CCD)) ^ (pair[:, :, 1] * np.uint64(0xC4CEB9FE1A85EC53)) + np.arange(2 * m, dtype=np.uint64)
    mix = (mix ^ mix >> np.uint64(33)) * np.uint64(0x9E3779B97F4A7C15)
    return mix[:, :m].view(np.int64), mix[:, m:].view(np.int64)


def bin_sketches(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each sorted set four bits of the least hash in each bin (0 in empty ones), as
    a row of 64-bit numbers."""
    own = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(flat))))
    cell = own * BINS + (flat >> np.uint64(55)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
    four = np.zeros(len(starts) * BINS, np.uint8)
    four[cell[first]] = (flat[first] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(60)
    return (four[::2] << 4 | four[1::2]).view("<i8").reshape(-1, LONGS)


def lists(rows: np.ndarray, full: np.ndarray) -> pa.Array:
    """Rows of numbers as lists; null where a document is not ``full``."""
    ends = np.zeros(len(full) + 1, np.int32)
    ends[1:] = np.cumsum(np.where(full, rows.shape[1], 0))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(rows).ravel()), mask=pa.array(~full))


def sets_of(batch: pa.RecordBatch, k: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, pa.Array]]:
    """(doc_ids, sets laid end to end, where each ends, digests) of a batch (doc_id,
    text), in runs of bounded size."""
    ids = batch.column(0).cast(pa.int64())
    for start, texts in text_slices(batch, "text"):
        for own in runs_of(texts):
            flat, ends = shingle_sets(own, k)
            digest = [xxhash.xxh3_128_digest(flat[i:j].tobytes()) if j > i else b"" for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            yield ids.slice(start, len(own)), flat, ends, pa.array(digest, pa.binary())
            start += len(own)


def features(docs: DataFrame, k: int, m: int) -> DataFrame:
    """Per document: set size, a 128-bit digest of the set, sub-hashes and sketch."""
    xor, odd = seeds(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, flat, ends, digest in sets_of(batch, k):
                starts = np.append(0, ends[:-1])
                full = ends > starts
                some = starts[full]
                a, b = combined(minhashes(flat, some, xor, odd), m)
                yield pa.RecordBatch.from_arrays([ids, pa.array(ends - starts), digest, *(lists(x, full) for x in (a, b, bin_sketches(flat, some)))], names=FEATURES.names)

    return docs.select("doc_id", "text").mapInArrow(run, FEATURES)


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, digest, set) of all rows."""
    schema = T.StructType([FEATURES["doc_id"], FEATURES["digest"], T.StructField("set", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, flat, ends, digest in sets_of(batch, k):
                sets = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids, digest, sets], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node that each node of ``edges`` (x, y) reaches.

    Labels spread along edges and are then looked up twice (a label's own label), so
    the rounds grow with the logarithm of the longest path.  Each round is a table.
    """
    both = materialize(edges.select("x", "y").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = materialize(both.groupBy("x").agg(F.least("x", F.min("y")).alias("label")).withColumnRenamed("x", "node"), "labels")
    while True:
        near = both.join(labels, both.y == labels.node).groupBy("x").agg(F.min("label").alias("near"))
        spread = labels.join(near, labels.node == near.x).select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = materialize(spread.join(up, "label").select("node", F.least("label", "up").alias("label"), "old"), "labels")
        discard(labels)
        labels = new
        if labels.where("label <> old").isEmpty():
            discard(both)
            return labels.select("node", "label")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) whose full sets have 100 * intersection >= percent * union."""
    a = sets.select(F.col("doc_id").alias("x"), F.col("set").alias("set_x"))
    b = sets.select(F.col("doc_id").alias("y"), F.col("set").alias("set_y"))
    shared = F.size(F.array_intersect("set_x", "set_y"))
    linked = shared * 100 >= percent * (F.size("set_x") + F.size("set_y") - shared)
    return pairs.join(a, "x").join(b, "y").where(linked).select("x", "y")


def differing_bins(a: str, b: str) -> F.Column:
    """How many of the four-bit bins of two sketches differ."""
    ones = F.lit(0x1111111111111111)
    total = F.lit(0)
    for i in range(LONGS):
        x = F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        total = total + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(ones))
    return total


def may_link(percent: int, a: str, b: str) -> F.Column:
    """Bounds that linked sets keep: on sizes; on the bins that differ, which are no
    more than the elements that only one of the sets has."""
    size = 100 * F.least(f"{a}.n", f"{b}.n") >= percent * F.greatest(f"{a}.n", f"{b}.n")
    apart = (100 - percent) * (F.col(f"{a}.n") + F.col(f"{b}.n")) / (100 + percent)
    return size & (differing_bins(a, b) <= F.least(apart, F.lit(float(sketch_bound(percent)))))


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (x, y) whose nodes have different labels; one without a label has its
    own number."""
    of = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"of_{side}"))
    both = pairs.join(of("x"), "x", "left").join(of("y"), "y", "left")
    return both.where(F.coalesce("of_x", "x") != F.coalesce("of_y", "y")).select("x", "y")


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after further links between nodes: components of components."""
    of = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"of_{side}"))
    ends = links.join(of("x"), "x", "left").join(of("y"), "y", "left")
    more = materialize(ends.select("x", "y", F.coalesce("of_x", "x").alias("a"), F.coalesce("of_y", "y").alias("b")), "near-dup-links")
    if more.isEmpty():
        return labels
    merged = components(more.select(F.col("a").alias("x"), F.col("b").alias("y"))).select(F.col("node").alias("label"), F.col("label").alias("final"))
    new = more.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("label"))
    nodes = labels.unionByName(new).groupBy("node").agg(F.min("label").alias("label"))
    return materialize(nodes.join(merged, "label", "left").select("node", F.coalesce("final", "label").alias("label")), "near-dup-labels")


def representatives(feats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, one document for each distinct set) of rows of features: doc_id and
    digest, of a document's rows the smallest digest, and the smallest doc_id of each
    digest.  Both are narrow, so copies are put together without their sets."""
    full = feats.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "digest")
    own = materialize(full.groupBy("doc_id").agg(F.min("digest").alias("digest")), "near-dup-documents")
    return own, own.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "digest")


def buckets_of(reps: DataFrame) -> DataFrame:
    """(key, doc_id, size): the tables' buckets with two documents or more.

    Sub-hashes that one document alone has are left out before keys are formed of them.
    """
    sub = reps.select("doc_id", F.explode("a").alias("sub"), F.lit(True).alias("first"))
    sub = sub.unionByName(reps.select("doc_id", F.explode("b").alias("sub"), F.lit(False).alias("first")))
    common = sub.groupBy("sub").agg(F.count("*").alias("size")).where("size > 1").select("sub")
    side = lambda first: F.collect_list(F.when(F.col("first") == first, F.col("sub")))
    both = sub.join(common, "sub").groupBy("doc_id").agg(side(True).alias("a"), side(False).alias("b"))
    pairs = both.select("doc_id", "b", F.explode("a").alias("a")).select("doc_id", "a", F.explode("b").alias("b"))
    keys = materialize(pairs.select("doc_id", F.xxhash64("a", "b").alias("key")), "near-dup-keys")
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    multi = materialize(keys.join(shared, "key"), "near-dup-buckets")
    discard(keys)
    return multi


def stars(multi: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs of a document x and the centre y of one of its buckets, of each document
    the first such pair).  The centre of a bucket is its document of most company, of
    equals the smallest; a document's first centre that of most company."""
    known = multi.groupBy("doc_id").agg(F.sum("size").alias("weight"))
    weighted = materialize(multi.join(known, "doc_id").select("key", "doc_id", "weight"), "near-dup-weights")
    rank = F.struct(F.col("weight"), (-F.col("doc_id")).alias("least"))
    centers = weighted.groupBy("key").agg(F.max(rank).alias("c")).select("key", (-F.col("c.least")).alias("y"), F.col("c.weight").alias("of_y"))
    star = weighted.select("key", F.col("doc_id").alias("x")).join(centers, "key").where("x <> y").groupBy("x", "y").agg(F.max("of_y").alias("weight"))
    star = materialize(star, "near-dup-star")
    discard(weighted)
    best = F.max(F.struct(F.col("weight"), (-F.col("y")).alias("least")))
    return star, materialize(star.groupBy("x").agg(best.alias("c")).select("x", (-F.col("c.least")).alias("y")), "near-dup-first")


def candidates_across(reps: DataFrame, members: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share a sub-hash of each collection and may
    be linked: in each bucket of the first collection those outside its largest
    component against all others."""
    named = members.join(labels, members.doc_id == labels.node, "left").select("doc_id", F.coalesce("label", "doc_id").alias("label"))
    bits = [f"s{i}" for i in range(LONGS)]
    rows = named.join(reps, "doc_id").select("doc_id", "label", "n", "b", *bits, F.explode("a").alias("key"))
    rows = materialize(rows, "near-dup-rows")
    sizes = rows.groupBy("key", "label").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("size", "label")).alias("m"), F.count("*").alias("labels")).where("labels > 1")
    # Written, so that both sides of the join come straight from a shuffle, whose hot
    # keys adaptive execution can split.
    mixed = materialize(rows.join(largest.select("key", F.col("m.label").alias("largest")), "key"), "near-dup-mixed")
    discard(rows)
    p, q = mixed.where("label <> largest").alias("p"), mixed.alias("q")
    different = (F.col("q.label") == F.col("q.largest")) | (F.col("p.label") < F.col("q.label"))
    near = F.arrays_overlap("p.b", "q.b") & may_link(percent, "p", "q")
    pairs = p.join(q, (F.col("p.key") == F.col("q.key")) & (F.col("p.label") != F.col("q.label")) & different & near)
    pairs = materialize(pairs.select(F.col("p.doc_id").alias("x"), F.col("q.doc_id").alias("y")).distinct(), "near-dup-across")
    discard(mixed)
    return pairs


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, n_shingles,
    component_id, kept.

    Documents are linked if 100 * intersection >= percent * union of their sets of
    k-word shingles (ASCII lower case).  ``component_id`` is the smallest doc_id
    reachable; ``kept`` says that it is the document's own.  Texts without words, null
    or empty, are linked with nothing.  Rows without a doc_id are linked with nothing
    and kept, with a null component.  Rows of one doc_id count as one document, with
    the set whose digest is smallest; each keeps its own n_shingles.  Other columns of
    ``docs`` are not looked at.
    """
    feats = materialize(features(docs, k, tables_for(percent)), "near-dup-features")
    own, alone = representatives(feats)
    of_alone = ["doc_id", "digest"]
    reps = feats.select(*of_alone, "n", "a", "b", *(F.col("sketch")[i].alias(f"s{i}") for i in range(LONGS))).join(alone, of_alone)
    reps = materialize(reps.dropDuplicates(of_alone), "near-dup-sets")
    short = reps.drop("digest", "a", "b")
    multi = buckets_of(reps)
    members = materialize(multi.select("doc_id").distinct(), "near-dup-members")
    star, first_of = stars(multi)
    discard(multi)

    def near(pairs: DataFrame) -> DataFrame:
        """Those of the pairs that pass the bounds."""
        both = pairs.join(short.alias("p"), F.col("x") == F.col("p.doc_id")).join(short.alias("q"), F.col("y") == F.col("q.doc_id"))
        return materialize(both.where(may_link(percent, "p", "q")).select("x", "y"), "near-dup-near")

    def needed_sets(pairs: DataFrame) -> DataFrame:
        """The sets of the documents in pairs, made again from their texts: all sets
        together are larger than the texts."""
        named = pairs.select(F.explode(F.array("x", "y")).alias("doc_id")).distinct().join(alone, "doc_id").select("doc_id", F.col("digest").alias("own"))
        named = materialize(named, "near-dup-named")
        texts = docs.select("doc_id", "text").join(named.select("doc_id"), "doc_id")
        found = full_sets(texts, k).join(named, "doc_id").where("digest = own").dropDuplicates(["doc_id"])
        return materialize(found.select("doc_id", "set"), "near-dup-full", plain=True)

    star = near(star)
    sets = needed_sets(star)
    labels = components(verified(star.join(first_of, ["x", "y"], "left_semi"), sets, percent))
    others = apart(star.join(first_of, ["x", "y"], "left_anti"), labels)
    labels = joined(labels, verified(others, sets, percent))
    discard(sets)
    across = candidates_across(reps, members, labels, percent)
    sets = needed_sets(across)
    labels = joined(labels, verified(across, sets, percent))
    discard(sets)

    of_set = reps.select("doc_id", "digest").join(labels, F.col("doc_id") == labels.node, "left").select("digest", F.coalesce("label", "doc_id").alias("component"))
    of_doc = materialize(own.join(of_set, "digest").select("doc_id", "component"), "near-dup-components")
    discard(reps, members, star, first_of, across, own)
    done = feats.select("doc_id", "n").join(of_doc, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return done.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
