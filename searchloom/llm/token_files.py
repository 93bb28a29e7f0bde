"""Token-id output with Re-Pair grammar compression (operator 5).

Documents are dealt by ranges of ``doc_id``, so the order of the partitions is the
order of the ids.  Each task encodes its documents, cuts the stream of ids into
shards and compresses each shard by Re-Pair: frequent pairs of neighbouring symbols
are replaced by nonterminals, until no pair is frequent.  A shard is one row of a Parquet
table; Spark's writer commits it, so a lost executor costs a rerun task and no more.

File format, one row per shard: ``part``, ``shard`` (order inside the part),
``first_id`` (ids of the part before the shard), ``n_ids``, and binary columns,
zstandard over little-endian numbers: ``rules`` (uint32 pairs; rule k makes symbol
``terminals + k``), ``lengths`` (uint32, the ids that each rule expands to),
``symbols`` (the compressed sequence: all low 16-bit halves, then all high ones),
``doc_ids`` (int64), ``doc_known`` (uint8: 0 for documents without an id) and
``doc_ends`` (uint32: where each document ends in the shard).
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain, repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BATCH_BYTES, bound_batches, resident, scratch, text_slices

#: Ids of a shard (a document is never split, so one may have more), the fewest
#: occurrences of a pair that is replaced, and bits of the bins that pairs are counted in.
SHARD_IDS, LEAST, BIN_BITS = 1 << 20, 16, 18
#: Distinct pieces whose ids a worker remembers.
PIECES = 1_200_000

SHARDS = T.StructType(
    [T.StructField(k, T.LongType()) for k in ("part", "shard", "first_id", "n_ids")]
    + [T.StructField(k, T.BinaryType()) for k in ("rules", "lengths", "symbols", "doc_ids", "doc_known", "doc_ends")]
)


def gathered(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Pieces of ``flat`` one after another, given where each begins and its size."""
    ends = np.cumsum(size)
    if not len(size):
        return flat[:0]
    at = np.repeat(begin - ends + size, size)
    at += np.arange(ends[-1])
    return flat.take(at)


class KnownIds:
    """The ids of distinct strings, laid end to end; at most ``limit`` strings, and what
    one slice of texts needs.  ``encode`` tells those of others: (strings in any order,
    their ids end to end, number of each)."""

    def __init__(self, limit: int, encode):
        self.limit, self.encode = limit, encode
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.used = 0
        # Grown by halves, so that little is copied for each slice.
        self.flat, self.begin, self.size = np.zeros(1 << 16, "<u4"), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def add(self, missing: list[str]) -> None:
        missing, flat, size = self.encode(missing)
        at, stop, used = len(self.index), len(self.index) + len(missing), self.used + len(flat)
        self.index.update(zip(missing, range(at, stop), strict=True))
        if used > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(used + used // 2 - self.used, "<u4")])
        if stop > len(self.size):
            more = stop + stop // 2 - at
            self.begin, self.size = np.concatenate([self.begin[:at], np.zeros(more, np.int64)]), np.concatenate([self.size[:at], np.zeros(more, np.int32)])
        self.flat[self.used : used] = flat
        self.size[at:stop] = size
        self.begin[at:stop] = self.used + np.cumsum(size) - size
        self.used = used

    def rows(self, strings: list[str]) -> np.ndarray:
        """Where each string stands, -1 for those that are not known."""
        return np.fromiter(map(self.index.get, strings, repeat(-1)), np.int64, len(strings))

    def ids(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all strings, laid end to end, the number of each)."""
        rows = self.rows(strings)
        missing = np.flatnonzero(rows < 0).tolist()
        if missing:
            new = list({strings[i] for i in missing})
            if len(self.index) + len(new) > self.limit:
                self.clear()
                self.add(list(set(strings)))
                rows = self.rows(strings)
            else:
                self.add(new)
                rows[missing] = self.rows([strings[i] for i in missing])
        size = self.size.take(rows)
        return gathered(self.flat, self.begin.take(rows), size), size


class ByteTokenizer:
    """Ids of whole texts under a byte-level BPE file of the tokenizers library.

    Texts are cut to words at single spaces and newlines, which pieces of the file's
    pattern do not cross; distinct words are cut to pieces as the pattern does it, and
    the library encodes each distinct piece once.  Texts with white space beyond single spaces and newlines, with
    characters beyond the first scripts, or with the strings of special tokens go
    through the library whole.
    """

    #: Bytes of white space that pieces are not cut at here and of no character at all,
    #: and the lead bytes of characters from U+0250 on.
    ODD, LEADS = bytes([0, 9, 11, 12, 13, *range(28, 32)]), bytes(range(0xC9, 0x100))
    SPACES = re.compile(rb"\xc2[\xa0\x85]|\xc9[\x90-\xbf]|[\xca-\xff]")
    LETTERS, DIGITS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
    PIECE = re.compile(rf" ?[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|\n| ?[{DIGITS}]+| ?[^\s{LETTERS}{DIGITS}]+")
    #: What a line end among pieces stands for; no id is as large.
    LINE = 0xFFFFFFFF

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        from .bpe import byte_alphabet

        self.library = Tokenizer.from_file(path)
        # The same model for pieces that are already cut, in its byte alphabet.
        self.of_pieces = Tokenizer(self.library.model)
        self.of_pieces.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        spec = json.load(open(path, encoding="utf-8"))  # noqa: SIM115
        #: Strings for which the library has to see the whole text.
        self.special = [a["content"].encode() for a in spec["added_tokens"]]
        self.terminals = 1 + max([*spec["model"]["vocab"].values(), *(a["id"] for a in spec["added_tokens"])])
        self.alphabet = byte_alphabet() | {0: " "}  # a piece has no null byte
        vocab = spec["model"]["vocab"]
        self.newline = vocab[self.alphabet[10]]
        self.leads = np.zeros(self.terminals, bool)
        self.leads[[i for t, i in vocab.items() if t[0] == self.alphabet[32]]] = True
        self.pieces = KnownIds(PIECES, self.encode_pieces)

    @staticmethod
    def word_ends(text: bytes) -> np.ndarray:
        """Where spaces and newlines stand, and the end of the text."""
        flat = np.frombuffer(text, "u1")
        return np.append(np.flatnonzero((flat == 32) | (flat == 10)), len(flat))

    def whole(self, text: bytes, ends: np.ndarray) -> bool:
        """Whether only the library can cut a text, to which a newline was put in front;
        spaces and newlines that follow each other, or end the text, make empty words."""
        if (np.diff(ends) == 1).any() or any(x in text for x in self.special):
            return True
        if len(text.translate(None, self.ODD)) < len(text):
            return True
        return (b"\xc2" in text or len(text.translate(None, self.LEADS)) < len(text)) and self.SPACES.search(text) is not None

    def encode_pieces(self, pieces: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(pieces in another order, their ids end to end, number of each piece), many in
        one call of the library.  A piece that begins with a space has it nowhere else,
        so tokens that begin with one tell where pieces do; after the others a newline is
        put, which none of them holds.  A newline itself is LINE."""
        spaced, other = [p for p in pieces if p[0] == " "], [p for p in pieces if p[0] not in " \n"]
        lines = ["\n"] * (len(pieces) - len(spaced) - len(other))
        flat, size = [np.full(len(lines), self.LINE, "<u4")], [np.ones(len(lines), np.int64)]
        for own, mark in ((spaced, "\0"), (other, "\0\n\0")):
            for at in range(0, len(own), 512):
                # In the byte alphabet no byte stands for a space; pieces have no null byte.
                text = mark.join(own[at : at + 512]).encode().decode("latin-1").translate(self.alphabet)
                ids = np.array(self.of_pieces.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
                if own is spaced:
                    size.append(np.diff(np.flatnonzero(self.leads[ids]), append=len(ids)))
                else:
                    ends = ids == self.newline
                    size.append(np.diff(np.flatnonzero(ends), prepend=-1, append=len(ids)) - 1)
                    ids = ids[~ends]
                flat.append(ids)
        return lines + spaced + other, np.concatenate(flat), np.concatenate(size)

    def word_ids(self, text: bytes, ends: np.ndarray) -> np.ndarray:
        """The ids of a text that begins with a newline, given its ``word_ends``; LINE
        stands for newlines.

        A word begins with the space or newline before it, and no piece crosses such a
        place; only the distinct words of the text are cut to pieces.
        """
        cut = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(text)])
        words = cut.dictionary_encode()
        _, ends, kinds = words.dictionary.buffers()
        kinds = kinds.slice(0, np.frombuffer(ends, np.int64)[len(words.dictionary)]).to_pybytes()
        pieces = self.PIECE.findall(kinds.decode("utf-8", "replace"))
        ids, size = self.pieces.ids(pieces)
        # The first piece of a word has its space or newline, no other piece has one.
        first = np.flatnonzero(np.fromiter(map(" \n".__contains__, map(itemgetter(0), pieces)), bool, len(pieces)))
        size = np.add.reduceat(size, first, dtype=np.int64)
        of = words.indices.to_numpy()
        return gathered(ids, (np.cumsum(size) - size).take(of), size.take(of))

    def library_ids(self, text: bytes) -> np.ndarray:
        return np.array(self.library.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4")

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(texts)
        plain = [i for i, t in enumerate(texts) if t]
        joined = b"\n".join([b"", *(texts[i] for i in plain)])
        ends = self.word_ends(joined)
        if self.whole(joined, ends):
            odd = [i for i in plain if self.whole(b"\n" + texts[i], self.word_ends(b"\n" + texts[i]))]
            for i in odd:
                out[i] = self.library_ids(texts[i])
            plain = sorted(set(plain).difference(odd))
            joined = b"\n".join([b"", *(texts[i] for i in plain)])
            ends = self.word_ends(joined)
        if plain:
            ids = self.word_ids(joined, ends)
            # Line ends before texts are dropped, those of a text get their id.
            lines = np.flatnonzero(ids == self.LINE)
            own = np.cumsum([0, *(texts[i].count(b"\n") + 1 for i in plain)])
            before = lines[own[:-1]]
            ids[lines] = self.newline
            for i, start, stop in zip(plain, (before + 1).tolist(), [*before[1:].tolist(), len(ids)], strict=True):
                out[i] = ids[start:stop]
        return out


def opened(path: str) -> ByteTokenizer:
    """One tokenizer for each worker process."""
    return resident(("bytes", path), lambda: ByteTokenizer(path))


# Re-Pair ---------------------------------------------------------------------


def bins_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A bin for each pair; equal pairs share one."""
    mixed = left * np.uint32(0x9E3779B1)
    mixed ^= right * np.uint32(0x85EBCA77)
    mixed >>= np.uint32(32 - BIN_BITS)
    return mixed.astype(np.intp)


def frequent_pairs(seq: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(those of ``places`` where a pair stands that has LEAST of them, the pairs, their
    numbers of places, which pair stands at each of these places).

    A bin of LEAST places gets one of its pairs, counted without a sort; the places of
    other pairs in such bins, a few, are sorted.
    """
    if len(places) == len(seq) - 1:
        left, right = seq[:-1], seq[1:]
    else:
        left, right = seq.take(places), seq.take(places + 1)
    bin_of = bins_of(left, right)
    hot = np.flatnonzero((np.bincount(bin_of, minlength=1 << BIN_BITS) >= LEAST).take(bin_of))
    places, bin_of = places.take(hot), bin_of.take(hot)
    key = left.take(hot).astype(np.uint64)
    key <<= np.uint64(32)
    key |= right.take(hot)
    of_bin = np.zeros(1 << BIN_BITS, np.uint64)
    of_bin[bin_of] = key
    own = of_bin.take(bin_of) == key
    other = np.flatnonzero(~own)
    count = np.bincount(bin_of, minlength=1 << BIN_BITS) - np.bincount(bin_of.take(other), minlength=1 << BIN_BITS)
    bins = np.flatnonzero(count >= LEAST)
    number = np.full(1 << BIN_BITS, -1, np.int32)
    number[bins] = np.arange(len(bins))
    of = number.take(bin_of)
    pairs, back, n = np.unique(key.take(other), return_inverse=True, return_counts=True)
    often = n >= LEAST
    of[other] = np.where(often, len(bins) + np.cumsum(often) - 1, -1)[back]
    found = np.flatnonzero(of >= 0)
    return places.take(found), np.concatenate([of_bin[bins], pairs[often]]), np.concatenate([count[bins], n[often]]), of.take(found)


def chosen_pairs(pairs: np.ndarray, n: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(pairs to replace together, the number of each of ``pairs`` among them or -1).

    The most frequent first, of equals the smaller.  No symbol is the left half of one
    and the right half of another, so no two occurrences overlap but those of one
    symbol repeated.
    """
    side: dict[int, int] = {}
    chosen: list[tuple[int, int]] = []
    rule_of = np.full(len(pairs), -1)
    order = np.lexsort((pairs, -n))
    left, right = (pairs[order] >> np.uint64(32)).tolist(), (pairs[order] & np.uint64(0xFFFFFFFF)).tolist()
    for i, a, b in zip(order.tolist(), left, right, strict=True):
        if a == b:
            if a in side:
                continue
            side[a] = 3
        elif side.get(a, 1) != 1 or side.get(b, 2) != 2:
            continue
        else:
            side[a], side[b] = 1, 2
        rule_of[i] = len(chosen)
        chosen.append((a, b))
    return chosen, rule_of


def compress(ids: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, expansion lengths, symbols): pairs are replaced until none occurs LEAST
    times.

    Each round counts the pairs at the places that are still of interest: those of
    frequent pairs that had to wait, and those beside a new symbol; others cannot have
    become frequent.  Bins rule out most rare pairs before the exact count.
    """
    seq, size = ids.astype(np.uint32), max(terminals, int(ids.max(initial=0)) + 1)
    base, rules, length = size, [], {}
    places = np.arange(max(0, len(seq) - 1))
    while len(places):
        places, pairs, n, of = frequent_pairs(seq, places)
        chosen, rule_of = chosen_pairs(pairs, n)
        if not chosen:
            break
        rule = rule_of.take(of)
        ruled = np.flatnonzero(rule >= 0)
        where, rule = places.take(ruled), rule.take(ruled)
        own = np.flatnonzero(seq.take(where) == seq.take(where + 1))
        if len(own):  # of a run of one symbol every second place, from its left end on
            new_run = np.ones(len(own), bool)
            new_run[1:] = np.diff(where[own]) != 1
            start = np.maximum.accumulate(np.where(new_run, np.arange(len(own)), 0))
            keep = np.ones(len(where), bool)
            keep[own[(np.arange(len(own)) - start) % 2 == 1]] = False
            where, rule = where[keep], rule[keep]
        seq[where] = size + rule
        left = np.ones(len(seq), bool)
        left[where + 1] = False
        again = np.zeros(len(seq), bool)
        again[places] = True
        left = np.flatnonzero(left)
        seq, again = seq.take(left), again.take(left)
        new = where - np.arange(len(where))  # each replacement moves the later ones down
        again[new] = True
        again[np.maximum(new - 1, 0)] = True
        places = np.flatnonzero(again[:-1])
        for k, (a, b) in enumerate(chosen):
            length[size + k] = length.get(a, 1) + length.get(b, 1)
        rules += chosen
        size += len(chosen)
    return np.array(rules, "<u4").reshape(-1, 2), np.array([length[base + k] for k in range(len(rules))], "<u4"), seq.astype("<u4")


class Grammar:
    """A shard, open for reading: all ids, or those from one place to another."""

    def __init__(self, rules: np.ndarray, lengths: np.ndarray, symbols: np.ndarray, terminals: int):
        self.symbols = symbols
        self.length = np.concatenate([np.ones(terminals, np.int64), lengths.astype(np.int64)])
        # All expansions end to end, and where each begins; a rule's halves come before it.
        own: list[list[int]] = []
        for a, b in rules.tolist():
            own.append([*(own[a - terminals] if a >= terminals else [a]), *(own[b - terminals] if b >= terminals else [b])])
        self.flat = np.concatenate([np.arange(terminals, dtype="<u4"), np.fromiter(chain.from_iterable(own), "<u4")])
        self.begin = np.cumsum(self.length) - self.length
        self.ends: np.ndarray | None = None  # of the symbols, for windows

    def expand(self, seq: np.ndarray) -> np.ndarray:
        return gathered(self.flat, self.begin.take(seq), self.length.take(seq))

    def ids(self) -> np.ndarray:
        return self.expand(self.symbols)

    def window(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` only: the expansion lengths tell which symbols
        hold them."""
        if stop <= start:
            return np.zeros(0, "<u4")
        if self.ends is None:
            self.ends = np.cumsum(self.length[self.symbols])
        a, b = np.searchsorted(self.ends, [start, stop - 1], side="right")
        before = int(self.ends[a] - self.length[self.symbols[a]])
        return self.expand(self.symbols[a : b + 1])[start - before : stop - before]


def packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def halves(symbols: np.ndarray) -> np.ndarray:
    return np.concatenate([(symbols & 0xFFFF).astype("<u2"), (symbols >> 16).astype("<u2")])


def opened_shard(rules: bytes, lengths: bytes, symbols: bytes, terminals: int) -> Grammar:
    low, high = unpacked(symbols, "<u2").reshape(2, -1).astype(np.uint32)
    return Grammar(unpacked(rules, "<u4").reshape(-1, 2), unpacked(lengths, "<u4"), low | high << 16, terminals)


# Writing and reading ---------------------------------------------------------


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, shard_ids: int = SHARD_IDS) -> None:
    """Encodes ``docs`` (doc_id, text) and writes the shards to ``path``.

    Null and empty texts are the end id alone.  Rows with one doc_id stand in the
    order of their texts, null texts first; rows without a doc_id come before all
    others.  A document of any length stays in one shard.  Other columns are not looked at.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = opened(tokenizer), TaskContext.get().partitionId()
        held, names, ends, size, before, shard = [], [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            rules, lengths, symbols = compress(np.concatenate(held), own.terminals)
            row = [part, shard, before, size, packed(rules), packed(lengths), packed(halves(symbols)), packed(np.array([n or 0 for n in names], "<i8")), packed(np.array([n is not None for n in names], "u1")), packed(np.array(ends, "<u4"))]
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if i < 4 else pa.binary()) for i, v in enumerate(row)], names=SHARDS.names)

        for batch in batches:
            ids = batch.column(0)
            for start, texts in text_slices(batch, "text", BATCH_BYTES):
                for i, found in enumerate(own.encode(texts)):
                    held += [found, end]
                    size += len(found) + 1
                    names.append(ids[start + i].as_py())
                    ends.append(size)
                    if size >= shard_ids:
                        yield flush()
                        held, names, ends, before, size, shard = [], [], [], before + size, 0, shard + 1
        if size:
            yield flush()

    dealt.mapInArrow(run, SHARDS).write.parquet(path)


def read_documents(spark, path: str, tokenizer: str) -> DataFrame:
    """Per document of written shards: doc_id, start, n_tokens, ids_crc32."""
    made = T.StructType([T.StructField(k, T.LongType()) for k in ("part", "doc_id", "at", "n_tokens", "ids_crc32")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terminals = opened(tokenizer).terminals
        for batch in batches:
            for row in batch.to_pylist():
                ids = opened_shard(row["rules"], row["lengths"], row["symbols"], terminals).ids()
                ends = unpacked(row["doc_ends"], "<u4").astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                docs = unpacked(row["doc_ids"], "<i8")
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                no_id = unpacked(row["doc_known"], "u1") == 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(docs), row["part"])), pa.array(docs, mask=no_id), pa.array(starts + row["first_id"]), pa.array(ends - starts), pa.array(crc, pa.int64())],
                    names=made.names,
                )

    shards = spark.read.schema(SHARDS).parquet(path)
    spark_parts = shards.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    # One row for each part, however many documents there are.
    base = spark_parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("base"))
    return shards.mapInArrow(run, made).join(base, "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def through_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes ``docs`` to shards in the shared folder and reads them back."""
    path = scratch(docs.sparkSession, "token-shards")
    write_shards(docs, path, tokenizer)
    return read_documents(docs.sparkSession, path, tokenizer)
