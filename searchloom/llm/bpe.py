"""BPE encoding and decoding by prefix-sharing trie traversal (operator 10).

The encoding of a prefix is fixed by the last token of that encoding: if ``t`` is
the last token of the encoding of ``w[:i]``, what comes before it is the encoding
of ``w[:i-len(t)]``.  ``t`` is the one vocabulary entry that is a suffix of
``w[:i]`` and that may follow the last token of ``w[:i-len(t)]``, where two tokens
may stand together if merging the symbols of both gives just these two.

Distinct words are inserted in a trie.  Sorted words are the trie's preorder, so a
stack holds the states from the root to the current node; a node's state, its last
token, is computed once however many words pass through it.
"""

from __future__ import annotations

import hashlib
import json
import re
from codecs import charmap_decode
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BoundedCache, resident, text_slices, trim

#: Distinct pre-tokens, token pairs and steps between nodes that one worker remembers.
KEYS, PAIRS, STEPS = 500_000, 1_000_000, 500_000
#: Pre-tokens that it remembers where ids are asked for.
KEYS_WITH_IDS = 100_000
#: What the first token of a word follows.
START = -1


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte, as byte-level tokenizers define it."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in own}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(own))
    return table


class TrieEncoder:
    """Encodes words (already pre-tokenized) of a BPE vocabulary with word ends.

    Beside the last token a prefix has a node of an automaton over the vocabulary: the
    longest of its ends that begins an entry.  A node knows the entries that are ends of
    the prefix, so none is looked for by trying every length.  Nodes are made when a word
    first gets to them.
    """

    def __init__(self, vocab: dict[str, int], merges: list, end: str):
        self.vocab, self.end = vocab, end
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.inner = {t: i for t, i in vocab.items() if not (end and t.endswith(end) and len(t) > len(end))}
        self.final = {t[: -len(end)]: i for t, i in vocab.items() if end and t.endswith(end) and len(t) > len(end)}
        self.symbols: dict[int, tuple[str, ...]] = {}
        for t, i in self.inner.items():
            self.symbols[i] = tuple(t)
        for t, i in self.final.items():
            self.symbols[i] = (*t[:-1], t[-1] + end)
        #: Of each token that a node offers: itself, its length, what it may follow.
        self.offers: dict[int, tuple[int, int, dict[int, bool]]] = {}
        self.pairs = self.steps = 0
        self.begins = {t[:n] for table in (self.inner, self.final) for t in table for n in range(len(t) + 1)} | {""}
        #: Text, tokens that end a prefix there, tokens that end a word there, next nodes.
        self.nodes: dict[str, tuple[str, list, list, dict]] = {}
        self.halves = {"".join(p): p for p in reversed(pairs)}
        self.spines: tuple[dict, dict] = ({}, {})

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain BPE: the leftmost pair of lowest rank is merged until none is left."""
        parts, rank = list(symbols), self.rank
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), 1 << 30))
            if (parts[best], parts[best + 1]) not in rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def spine(self, token: int, side: int) -> list[tuple[str, int]]:
        """What stands at one end of a token while it is being merged: each symbol
        with the rank of the merge that takes it up (none: 1 << 30)."""
        found = self.spines[side].get(token)
        if found is None:
            symbols, rank = self.symbols[token], self.rank
            whole, until, found = "".join(symbols), 1 << 30, []
            while True:
                found.append((whole, until))
                halves = self.halves.get(whole)
                if halves is None:
                    break
                whole, until = halves[side], rank[halves]
            self.spines[side][token] = found
        return found

    def may_follow(self, left: int, right: int) -> bool:
        """No symbol at the end of ``left`` is ever merged with one at the start of
        ``right``: such a merge comes about only if its rank is below that of what
        takes up the left symbol, and not above that of what takes up the right
        one (of equal ranks the leftmost goes first)."""
        known = True
        get, starts = self.rank.get, self.spine(right, 0)
        for x, until_x in self.spine(left, 1):
            for y, until_y in starts:
                r = get((x, y))
                if r is not None and r < until_x and r <= until_y:
                    known = False
        if self.pairs >= PAIRS:
            self.pairs = 0
            for _, _, after in self.offers.values():
                after.clear()
                after[START] = True
        self.pairs += 1
        self.offers[right][2][left] = known
        return known

    def offered(self, text: str, table: dict[str, int]) -> list[tuple[int, int, dict[int, bool]]]:
        """Tokens of ``table`` that end ``text``, without those that merging their own
        symbols does not give."""
        found = []
        for at in range(len(text)):
            token = table.get(text[at:])
            if token is not None:
                symbols = self.symbols[token]
                if token in self.offers or self.merged(list(symbols)) == ["".join(symbols)]:
                    found.append(self.offers.setdefault(token, (token, len(text) - at, {START: True})))
        return found

    def node(self, text: str) -> tuple[str, list, list, dict]:
        """The node of the longest end of ``text`` that begins an entry."""
        while text not in self.begins:
            text = text[1:]
        found = self.nodes.get(text)
        if found is None:
            inner = self.offered(text, self.inner)
            found = self.nodes[text] = (text, inner, self.offered(text, self.final) if self.end else inner, {})
        return found

    def step(self, node: tuple[str, list, list, dict], symbol: str) -> tuple[str, list, list, dict]:
        found = self.node(node[0] + symbol)
        if self.steps >= STEPS:
            self.steps = 0
            for known in self.nodes.values():
                known[3].clear()
        self.steps += 1
        node[3][symbol] = found
        return found

    def last_token(self, offers: list, upto: int, states: list) -> tuple[int, int, dict[int, bool]] | None:
        """Which of ``offers`` ends the encoding of the first ``upto`` symbols."""
        for offer in offers:
            before = states[upto - offer[1]]
            if before is not None:
                ok = offer[2].get(before[0])
                if ok or (ok is None and self.may_follow(before[0], offer[0])):
                    return offer
        return None

    def encode_words(self, words: set[str]) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        states: list = [(START, 0, {})]
        nodes = [self.node("")]
        before, last_token, step = "", self.last_token, self.step
        for word in sorted(words):
            n, shared, most = len(word), 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del states[shared + 1 :], nodes[shared + 1 :]
            node = nodes[-1]
            for i in range(len(states), n):
                symbol = word[i - 1]
                node = node[3].get(symbol) or step(node, symbol)
                nodes.append(node)
                states.append(last_token(node[1], i, states))
            before = word[: n - 1]
            stop = None
            if n:
                node = nodes[n - 1]
                stop = last_token((node[3].get(word[-1]) or step(node, word[-1]))[2], n, states)
            if stop is None:
                out[word] = self.plain(word) if n else []
                continue
            ids, at = [stop[0]], n - stop[1]
            while at:
                stop = states[at]
                ids.append(stop[0])
                at -= stop[1]
            out[word] = ids[::-1]
        return out

    def plain(self, word: str) -> list[int]:
        """Words with symbols that the vocabulary lacks: merged without the trie."""
        symbols = [*word[:-1], word[-1] + self.end]
        return [self.vocab[t] for t in self.merged(symbols) if t in self.vocab]


class WordTokenizer:
    """Texts to ids and back for a tokenizers file of the word-end BPE kind.

    A text is cut to keys: pre-tokens as bytes where it has nothing but ASCII and
    letters of U+00C0 to U+00FF, else chunks without white space as strings, which the
    library splits.
    """

    #: Pre-tokens of lower-cased plain text.
    PLAIN = re.compile(rb"[a-z\xc3\x80-\xbf]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\sa-z0-9\xc3\x80-\xbf]+")
    #: Bytes of plain text in UTF-8: ASCII, and 0xC3 with what makes a letter after it.
    KEPT = bytes(b for b in (*range(0xC0), 0xC3) if b not in (0x97, 0xB7))
    #: Lower case of plain text: 0x80 to 0x9E follow 0xC3 only.
    LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A or 0x80 <= b <= 0x9E else b for b in range(256))
    STAND_INS = "".join(c for _, c in sorted(byte_alphabet().items()))

    def __init__(self, path: str, remembered: int = KEYS):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))  # noqa: SIM115
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer  # its model is not kept
        model = spec["model"]
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.around = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.encoder = TrieEncoder(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        self.token = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.written = {i: (b"%d" % i, t.encode()) for i, t in self.token.items()}
        self.known = BoundedCache(remembered)

    def is_plain(self, text: bytes) -> bool:
        if b"<|" in text or text.translate(None, self.KEPT):
            return False
        if not text.isascii():
            try:
                text.decode()
            except UnicodeDecodeError:
                return False
        return True

    def keys(self, text: bytes) -> list[bytes | str]:
        if self.is_plain(text):
            return self.PLAIN.findall(text.translate(self.LOWER))
        found: list[bytes | str] = []
        for chunk in text.split():
            if self.is_plain(chunk):
                found += self.PLAIN.findall(chunk.translate(self.LOWER))
            else:
                found.append(chunk.decode("utf-8", "replace"))
        return found

    def pieces(self, chunk: str) -> list[str | int]:
        """Pre-tokens of a chunk by the library; special tokens as ids."""
        found: list[str | int] = []
        for part in self.around.split(chunk) if self.around else [chunk]:
            if part in self.special:
                found.append(self.special[part])
            elif part:
                normal = self.normalizer.normalize_str(part)
                found += [p for p, _ in self.pre_tokenizer.pre_tokenize_str(normal)]
        return found

    def encode_keys(self, keys: list[bytes | str]) -> list[list[int]]:
        stand_ins = self.STAND_INS
        words = [charmap_decode(k, "strict", stand_ins)[0] if type(k) is bytes else self.pieces(k) for k in keys]
        distinct = {w for w in words if type(w) is str}
        distinct.update(p for w in words if type(w) is list for p in w if type(p) is str)
        known = self.encoder.encode_words(distinct)
        return [known[w] if type(w) is str else [i for p in w for i in (known[p] if type(p) is str else (p,))] for w in words]

    def strings(self, keys: list[bytes | str]) -> list[tuple[bytes, bytes] | None]:
        """Of each key: decimal ids and decoded text; none where it has no ids."""
        written, out = self.written, []
        for ids in self.encode_keys(keys):
            if len(ids) == 1:
                out.append(written[ids[0]])
            elif ids:
                found = [written[i] for i in ids]
                out.append((b" ".join([x for x, _ in found]), b" ".join([x for _, x in found])))
            else:
                out.append(None)
        return out

    def decode(self, ids: list[int]) -> str:
        """A file without a decoder joins its tokens by spaces."""
        return " ".join(self.token[i] for i in ids)

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.encode_keys(self.keys(text.encode())) for i in ids]


def opened(path: str, remembered: int = KEYS) -> WordTokenizer:
    """One tokenizer for each worker process."""
    return resident(("words", path, remembered), lambda: WordTokenizer(path, remembered))


def encode_documents(docs: DataFrame, path: str, text: str = "text", ids: bool = True) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if asked
    for, ``token_ids``; columns of these names in ``docs`` are replaced.

    Null and empty texts have no tokens.  Every text is encoded whole.  Memory is
    bounded by the caches, one batch of rows and the ids of one slice of its texts; no
    row leaves its partition.
    """
    made = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    if ids:
        made["token_ids"] = T.ArrayType(T.IntegerType())
    kept = [f for f in docs.schema.fields if f.name.lower() not in made]
    schema = T.StructType([*kept, *(T.StructField(k, v) for k, v in made.items())])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = opened(path, KEYS_WITH_IDS if ids else KEYS)
        for batch in batches:
            for start, texts in text_slices(batch, text):
                n, sha, back, lists = [], [], [], []
                pieces = [tokenizer.keys(t) for t in texts]
                known = tokenizer.known
                known.fill(set().union(*pieces), tokenizer.strings)
                for own in pieces:
                    found = [x for x in map(known.__getitem__, own) if x]
                    joined = b" ".join([x for x, _ in found])
                    n.append(joined.count(b" ") + 1 if found else 0)
                    sha.append(hashlib.sha256(joined).hexdigest())
                    back.append(hashlib.sha256(b" ".join([x for _, x in found])).hexdigest())
                    if ids and joined:
                        lists.append(np.fromstring(joined, np.int32, sep=" "))
                part = batch.slice(start, len(texts))
                columns = [part.column(part.schema.get_field_index(k)) for k in names]
                columns += [pa.array(n, pa.int64()), pa.array(sha), pa.array(back)]
                if ids:
                    ends = np.cumsum([0, *n], dtype=np.int32)
                    columns.append(pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int32), *lists])))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *made])
                if ids:
                    trim()  # pieces and strings of a slice come and go

    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """The contract's columns of ``encode_documents``, reading only what they need."""
    done = encode_documents(docs.select("doc_id", "text"), path, ids=False)
    return done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def decode_documents(tokens: DataFrame, path: str, ids: str = "token_ids") -> DataFrame:
    """Adds ``decoded`` to rows with token ids (null ids: null)."""
    @F.pandas_udf(T.StringType())
    def back(column: pd.Series) -> pd.Series:
        tokenizer = opened(path)
        return column.map(lambda x: None if x is None else tokenizer.decode(list(x)))

    return tokens.withColumn("decoded", back(F.col(ids)))
