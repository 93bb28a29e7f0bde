import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from searchloom.llm import token_files
from searchloom.llm.common import scratch

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_same_ids_as_the_library():
    own, library = token_files.ByteTokenizer(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(2)
    al = list("abcdetnsßéÉ'’-0129.,!?<>İΣ中🙂   \n\n\t\r²ɐ́_") + ["'s", "'ll", " ", "<|endoftext|>", "\0"]
    texts = ["", " ", "a  b", "x\n\ny", "word, other. end"] + ["".join(rng.choice(al) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    for text, ids in zip(texts, own.encode([t.encode() for t in texts]), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_repeated_words_are_looked_up_once():
    own, library = token_files.ByteTokenizer(PATH), Tokenizer.from_file(PATH)
    looked, rows = [], own.pieces.rows
    own.pieces.rows = lambda pieces: looked.append(len(pieces)) or rows(pieces)
    line = "some words, that's 12 é's of a line"
    texts = [" ".join([line] * 300), "\n".join([line] * 300), "", "line", line]
    for text, ids in zip(texts, own.encode([t.encode() for t in texts]), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert sum(looked) < 100


def test_grammars_expand_to_what_was_compressed():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 50, 5000):
        for kinds in (1, 2, 5, 40):
            ids = rng.integers(0, kinds, n).astype("<u4")
            rules, lengths, symbols = token_files.compress(ids, 50)
            grammar = token_files.Grammar(rules, lengths, symbols, 50)
            assert (grammar.ids() == ids).all() and len(symbols) <= n
            for _ in range(20):
                a, b = sorted(rng.integers(0, n + 1, 2).tolist())
                assert (grammar.window(a, b) == ids[a:b]).all()
            both = list(zip(symbols[:-1].tolist(), symbols[1:].tolist(), strict=True))
            seen, last = {}, None
            for i, pair in enumerate(both):  # places of a run of one symbol overlap
                if pair != last or pair[0] != pair[1] or i - seen[pair][1] > 1:
                    seen[pair] = (seen.get(pair, (0, 0))[0] + 1, i)
                last = pair
            assert all(k < token_files.LEAST for k, _ in seen.values())
    assert len(symbols) < n / 1.5 or kinds == 40


def test_files_round_trip(spark):
    low = -(1 << 63)
    texts = [(5, "b second"), (1, "first one"), (9, None), (7, ""), (3, "word " * 30_000), (3, "a again"), (3, "a again"), (None, "no id"), (None, None), (low, "lowest")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    path = scratch(spark, "t")
    token_files.write_shards(df, path, PATH, shard_ids=500)
    got = [tuple(r) for r in token_files.read_documents(spark, path, PATH).orderBy("start").collect()]
    library, start, want = Tokenizer.from_file(PATH), 0, []
    for doc, text in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert token_files.through_files(df.limit(0), PATH).isEmpty()
