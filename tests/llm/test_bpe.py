import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from searchloom.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    return bpe.WordTokenizer(PATH), Tokenizer.from_file(PATH)


CASES = ["", " ", "It's they'll 'S", "a<|endoftext|>b <|startoftext|>", "é é ÉÀ İΣ中文🙂 x", "a" * 5000, "=-" * 400, "12,345.67", "tab\tline\nend "]


def test_same_ids_and_text_as_the_library(both):
    own, library = both
    rng = random.Random(4)
    made = ["".join(rng.choice("abcdetnsßéÉ'’-0129.,!?<|endoftext|>İΣσ中🙂  ́\n") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    for text in CASES + made:
        ids = own.encode(text)
        assert ids == library.encode(text, add_special_tokens=False).ids, text
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_every_word_of_small_alphabets(both):
    import itertools

    own, library = both
    words = {"".join(w) for n in range(1, 6) for w in itertools.product("aeinst", repeat=n)}
    found = own.encoder.encode_words(words)
    for w in random.Random(1).sample(sorted(words), 2000):
        assert found[w] == library.encode(w, add_special_tokens=False).ids


def test_documents(spark):
    rows = [(i, t) for i, t in enumerate([*CASES, None])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
    got = {r["doc_id"]: r for r in bpe.encode_documents(df, PATH).collect()}
    library = Tokenizer.from_file(PATH)
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert list(got[i]["token_ids"]) == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decode_documents(bpe.encode_documents(df, PATH), PATH).where("doc_id = 2").first()
    assert back["decoded"] == library.decode(library.encode(CASES[2], add_special_tokens=False).ids, skip_special_tokens=False)
    assert bpe.encode_documents(df.limit(0), PATH).isEmpty()
    clash = df.withColumn("n_tokens", df.doc_id).withColumn("extra", df.doc_id)
    assert "extra" in bpe.encode_documents(clash, PATH).columns and bpe.encode_documents(clash, PATH).columns.count("n_tokens") == 1


def test_ids_leave_slice_by_slice():
    import pyarrow as pa
    from pyspark.sql import types as T

    from searchloom.llm.common import SLICE_BYTES

    class Rows:
        schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])

        def mapInArrow(self, run, schema):
            return run

    texts = [*("word of a slice " * (SLICE_BYTES // 64) for _ in range(10)), None, "", "last"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(13)), pa.array(texts)], names=["doc_id", "text"])
    found = list(bpe.encode_documents(Rows(), PATH)(iter([batch.slice(0, 0), batch])))
    assert [len(b) for b in found] == [4, 4, 5]
    rows = pa.Table.from_batches(found).to_pylist()
    library = Tokenizer.from_file(PATH)
    assert [r["doc_id"] for r in rows] == list(range(13))
    for r in (rows[0], rows[9], *rows[10:]):
        assert r["token_ids"] == library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(r["token_ids"])


class Rows:
    """As much of a DataFrame as ``encode_documents`` takes, without Spark."""

    def __init__(self):
        from pyspark.sql import types as T

        self.schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])

    def mapInArrow(self, run, schema):
        return run


def test_control_characters_and_letters_beyond_ascii(both):
    own, library = both
    every = [chr(c) for c in range(0x180)]
    for text in ["".join(every), *every, *("Q" + c + "b" for c in every), *(c * 3 + "1'S" for c in every), "H\u0331 É\u0301 à<|endoftext|>É"]:
        ids = own.encode(text)
        assert ids == library.encode(text, add_special_tokens=False).ids, repr(text)
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_a_pre_token_is_encoded_once(monkeypatch):
    import pyarrow as pa

    from searchloom.llm import common

    asked = []
    encode_words = bpe.TrieEncoder.encode_words
    monkeypatch.setattr(bpe.TrieEncoder, "encode_words", lambda self, words: asked.extend(words) or encode_words(self, words))
    monkeypatch.setattr(common, "_resident", {})
    texts = ["word été " * (common.SLICE_BYTES // 8), "Word, (word) ÉTÉ! été" + " word" * (common.SLICE_BYTES // 4), "word."]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3)), pa.array(texts)], names=["doc_id", "text"])
    found = pa.Table.from_batches(bpe.encode_documents(Rows(), PATH, ids=False)(iter([batch]))).to_pylist()
    assert asked.count("word") == 1 and len(asked) == len(set(asked))
    library = Tokenizer.from_file(PATH)
    for row in found:
        ids = library.encode(texts[row["doc_id"]], add_special_tokens=False).ids
        assert row["n_tokens"] == len(ids) and row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_vocabulary_is_not_searched_again_at_known_nodes(both):
    own, library = both
    looked = []

    class Table(dict):
        def get(self, key, default=None):
            looked.append(key)
            return super().get(key, default)

    encoder = bpe.TrieEncoder(own.encoder.vocab, [" ".join(p) for p in own.encoder.rank], own.encoder.end)
    rng = random.Random(2)
    words = ["".join(rng.choice("aeinst") for _ in range(12)) for _ in range(3000)]
    encoder.encode_words(set(words))
    encoder.inner = Table(encoder.inner)
    found = encoder.encode_words({w[6:] + w[:6] for w in words[:500]})
    assert len(looked) < 500 * 12
    assert all(ids == library.encode(w, add_special_tokens=False).ids for w, ids in found.items())


def test_what_is_remembered_changes_nothing(both, monkeypatch):
    own, library = both
    monkeypatch.setattr(bpe, "PAIRS", 7)
    monkeypatch.setattr(bpe, "STEPS", 5)
    encoder = bpe.TrieEncoder(own.encoder.vocab, [" ".join(p) for p in own.encoder.rank], own.encoder.end)
    rng = random.Random(3)
    words = {"".join(rng.choice("aeinst") for _ in range(rng.randint(1, 9))) for _ in range(500)}
    assert all(ids == library.encode(w, add_special_tokens=False).ids for w, ids in encoder.encode_words(words).items())
