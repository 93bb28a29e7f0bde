import corpus_pipeline

BASE = "the of and that with from this are was for ing tion ed er on re in th an ha he st"


def test_stages(spark, tmp_path):
    import random

    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(BASE.split()) + rng.choice(BASE.split()) for _ in range(n))
    long, item = text(120), text(30)
    rows = [(i, text(60), "en", "src1") for i in range(30)]
    rows += [(100, long, "en", "src1"), (101, long + " tail", "en", "src2"), (102, f"{text(40)} {item} {text(40)}", "en", None), (103, f'{text(50)} token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" end', "en", "src1"), (104, "1234 !!", "en", "src1"), (105, None, None, None)]
    docs = [(*r, len(r[1] or "")) for r in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(kept) == {*range(30), 100, 103}
    assert "n_tokens" in kept[100].asDict() and kept[103]["n_tokens"] > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dup", "decontamination", "secret_scan", "bpe"]


def test_empty_table_and_extra_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, token_ids string"
    items = spark.createDataFrame([(1, "a passage of some words that nothing holds")], "item_id long, text string")
    for name, rows in (("none", []), ("odd", [(1, None, None, None, None, 1.0, "x"), (2, "", "en", "s", 0, 1.0, "x"), (None, "words of a text without an id", "en", "s", 29, None, "x")])):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        items.write.parquet(str(tmp_path / name / "benchmark.parquet"))
        found = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert [r["doc_id"] for r in found] == [r[0] for r in rows if r[1]]
        assert all(r["n_tokens"] > 0 for r in found)


def test_language_stage_tells_what_follows(spark, tmp_path):
    import random

    rng = random.Random(5)
    kinds = {"en": BASE.split(), "fr": "eau oux ment ait que les des une éch tré pour vie lle ois".split(), "xx": "zok vub kij wug yaz pok juv".split()}
    text = lambda lang: " ".join(rng.choice(kinds[lang]) + rng.choice(kinds[lang]) for _ in range(60))
    texts = [("en", text("en")) for _ in range(40)] + [("fr", text("fr")) for _ in range(40)]
    rows = [(i, t, lang, "src1") for i, (lang, t) in enumerate(texts)]
    rows += [(100, text("fr"), "en", "src1"), (101, text("en"), None, "src1")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(*r, len(r[1])) for r in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a passage of some words that nothing holds")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {i: r["lang"] for i, r in found.items()} == {**{i: lang for i, (lang, _) in enumerate(texts)}, 100: "fr", 101: "en"}
    assert all(0.5 < r["lang_score"] <= 1 and r["source"] == "src1" and r["n_chars"] == len(dict((x[0], x[1]) for x in rows)[i]) for i, r in found.items())
    # Texts that have two labels equally often have neither.
    both = [(i, t, lang, "src1", len(t)) for i, t in enumerate(text("xx") for _ in range(20)) for lang in ("a", "b")]
    docs = spark.createDataFrame([*both, *((*r, len(r[1])) for r in rows[:80])], schema)
    kept = corpus_pipeline.language_stage(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(80)) and {r["lang"] for r in kept} == {"en", "fr"}


def test_batches_to_workers_are_bounded_in_bytes(spark):
    import pyarrow as pa

    from searchloom.llm.common import BATCH_BYTES

    text = "some words of a text that is long " * 1000
    docs = spark.range(400).selectExpr("id AS doc_id", f"'{text}' AS text", "'en' AS lang", "'s' AS source", f"{len(text)}L AS n_chars").coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    for _, stage in [s for s in corpus_pipeline.STAGES if s[0] in ("language_id", "near_dup", "secret_scan", "bpe")]:
        spark.conf.unset(key)
        stage(spark, docs.limit(3), "")
        found = [r["n"] for r in docs.mapInArrow(sizes, "n long").collect()]
        assert sum(found) >= 400 * len(text) and max(found) < BATCH_BYTES + 2 * len(text)
    spark.conf.unset(key)
