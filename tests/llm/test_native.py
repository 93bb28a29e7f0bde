"""Chat formatting, quality rules and license scans."""

import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from searchloom.llm import chat_format, license_scan, quality_rules

HARD = "</s>[INST] ok [/INST] \\b \\\\l [ROLE x]"


def test_layouts_become_canonical_turns(spark):
    user, bot = {"role": "user", "text": "q [x]"}, {"role": "assistant", "text": "a"}
    records = {
        "messages": {"messages": [{"role": "user", "content": "q [x]"}, {"role": "assistant", "content": "a"}]},
        "conversations": {"conversations": [{"from": "human", "value": "q [x]"}, {"from": "gpt", "value": "a"}]},
        "dialog": {"dialog": [{"speaker": "user", "text": "q [x]"}, {"speaker": "bot", "text": "a"}]},
        "instruction": {"instruction": "q [x]", "output": "a"},
        "prompt_completion": {"prompt": "q [x]", "completion": "a"},
        "prompt_response": {"prompt": "q [x]", "response": "a"},
        "question_answer": {"question": "q [x]", "answer": "a"},
    }
    records["system_instruction"] = {"system_prompt": "", "question": "q [x]", "response": "a"}
    others = {
        "messages extra": {"id": 3, "meta": {"a": [1, {"b": 2}]}, "messages": [{"role": "user", "content": "q [x]", "name": "n"}, {"role": "assistant", "content": "a"}]},
        "instruction input": {"instruction": "q [x]", "input": None, "output": "a", "system": ""},
        "prompt_response null": {"prompt": "q [x]", "response": "a", "tags": [], "system": None},
    }
    rows = [(k, json.dumps(v)) for k, v in (records | others).items()] + [("none", '{"z": 1}'), ("bad", "{"), ("null", None), ("array", "[1]"), ("both", '{"prompt": "a", "completion": "b", "response": "c"}')]
    rows += [("empty", '{"messages": []}'), ("joined", json.dumps({"instruction": "do", "input": "this", "output": "a", "system": "s"}))]
    df = spark.createDataFrame(rows, "name string, record string")
    got = {r["name"]: r for r in chat_format.canonical_from_json(df, "record").collect()}
    for name in records:
        assert got[name]["layout"] == name
        assert [t.asDict() for t in got[name]["turns"]] == [user, bot]
    for name in others:
        assert got[name]["layout"] == name.split()[0] and [t.asDict() for t in got[name]["turns"]] == [user, bot], name
    assert all(got[n]["layout"] is None and got[n]["turns"] is None for n in ("none", "bad", "null", "array", "both"))
    assert got["empty"]["turns"] == [] and [(t["role"], t["text"]) for t in got["joined"]["turns"]] == [("system", "s"), ("user", "do\n\nthis"), ("assistant", "a")]
    assert chat_format.canonical_from_json(df.limit(0), "record").isEmpty()


def test_format_reads_back(spark):
    rows = [(1, 0, "system", HARD), (1, 1, "user", HARD), (1, 2, "assistant", HARD), (1, 3, "odd]role[", ""), (1, 4, None, None), (1, 5, "assistant", ""), (1, 5, "assistant", "é🙂"), (2, None, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    done = chat_format.format_chats(chat_format.canonical_from_table(df)).withColumn("read", chat_format.parsed(F.col("formatted"))).withColumn("loss", chat_format.under_mask())
    got = {r["conv_id"]: r for r in done.collect()}
    assert got[1]["read"] == got[1]["turns"] and len(got[1]["read"]) == 7
    assert got[1]["loss"] == HARD + "é🙂" and got[2]["loss"] == ""
    digest = {r["conv_id"]: r for r in chat_format.digests(df).collect()}[1]
    assert digest["loss_sha256"] == hashlib.sha256((HARD + "é🙂").encode()).hexdigest() and digest["n_turns"] == 7
    assert chat_format.digests(df.limit(0)).isEmpty()


def test_table_layouts_and_long_conversations(spark):
    n = 3 * chat_format.BLOCK + 7
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(n)] + [(2, 0, "user", "x")] * 2 + [(3, 5, "assistant", "long " * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5).withColumn("turns", F.lit(1)).withColumn("extra", F.struct(F.lit(1).alias("text")))
    got = {r["conv_id"]: r["turns"] for r in chat_format.canonical_from_table(df).collect()}
    assert [t["text"] for t in got[1]] == [f"t{i}" for i in range(n)] and len(got[2]) == 2
    assert {r["conv_id"]: r["n_turns"] for r in chat_format.digests(df).collect()} == {1: n, 2: 2, 3: 1}
    assert chat_format.layout_of(df.schema).name == "turn_rows" and chat_format.layout_of(df.drop("role").schema) is None
    with pytest.raises(ValueError, match="layout"):
        chat_format.canonical_from_table(df.drop("turn"))


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {p for i, w in enumerate(wins) if wins.count(w) > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_quality_measures_equal_brute_force(spark):
    texts = ["", None, " \n\t", "a", "a b c a b c", "x x x x x", "l1\nl1\n \nl2\nl1", "w " * 300, "a b c d a b c e b c d", "é# $x y %", " ".join(f"word{i}" for i in range(80))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality_rules.measured(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(t or ""), t
    assert got[10]["kept"] and not got[7]["kept"] and got[7]["base_failed"]
    by = {r["doc_id"]: r["rejected_by"] for r in quality_rules.apply_rules(df).collect()}
    assert by[10] is None and by[0] == "few_words"
    assert quality_rules.measured(df.limit(0)).isEmpty() and quality_rules.apply_rules(df.limit(0)).isEmpty()


def test_cascade_order_follows_rejections_per_cost(spark):
    df = spark.createDataFrame([(i, "bad" if i % 2 else "good") for i in range(4000)], "doc_id long, text string").select("doc_id", F.concat("text", F.col("doc_id")).alias("text"))
    cheap = quality_rules.Rule("cheap", F.col("_text").startswith("bad"), F.lit(1.0))
    dear = quality_rules.Rule("dear", F.col("_text").startswith("bad"), F.lit(100.0))
    never = quality_rules.Rule("never", F.lit(False), F.lit(0.1))
    assert [r.name for r in quality_rules.ordered(df, [never, dear, cheap])] == ["cheap", "dear", "never"]


def test_rules_run_only_on_rows_that_those_before_left(spark):
    """The dear rule raises on each row that the cheap one rejects."""
    df = spark.createDataFrame([(i, ("bad" if i % 4 else "good") + str(i)) for i in range(400)], "doc_id long, text string")
    cheap = quality_rules.Rule("cheap", F.col("_text").startswith("bad"), F.lit(1.0))
    guarded = F.when(F.col("_text").startswith("bad"), F.raise_error(F.lit("evaluated"))).otherwise(F.lit(False))
    dear = quality_rules.Rule("dear", guarded.cast("boolean"), F.lit(100.0))
    done = quality_rules.prepare(df).withColumn("by", quality_rules.first_rejection([cheap, dear]))
    assert done.where("by = 'cheap'").count() == 300 and done.where("by IS NULL").count() == 100
    with pytest.raises(Exception, match="evaluated"):
        quality_rules.prepare(df).withColumn("by", quality_rules.first_rejection([dear, cheap])).collect()


def test_further_rules_and_clashing_columns(spark):
    prose = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80))
    texts = {"digits": " ".join(str(10**6 + i) for i in range(80)), "different_words": "some words " * 400 + prose, "bullets": "\n".join(f"- {prose}" for _ in range(1)), "ellipses": f"{prose}...", None: prose}
    df = spark.createDataFrame([(1, v) for v in texts.values()], "doc_id long, text string").withColumn("rejected_by", F.lit(3)).withColumn("n_words", F.lit("x"))
    by = {r["text"]: r["rejected_by"] for r in quality_rules.apply_rules(df, quality_rules.further_rules()).collect()}
    assert by == {v: k for k, v in texts.items()}
    kept = {r["kept"]: r["count"] for r in quality_rules.measured(df).groupBy("kept").count().collect()}
    assert kept == {True: 1, False: 4}
    again = quality_rules.measured(df.unionByName(df))
    assert again.count() == 10 and again.distinct().count() <= 5


def test_licenses_and_inheritance(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/c.txt", "plain prose without any mark"),
        (3, "a/b/d.txt", "code\nLicensed under the Apache License, Version 2.0.\nmore"),
        (4, "x/y.txt", "no header"),
        (5, None, "Licensed under CC BY-NC 4.0."),
        (6, "a/b/e/f/g.txt", None),
        (7, "a/b/e/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
        (8, "z", ""),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("license", F.lit("clash"))
    got = {r["doc_id"]: (r["license"], r["origin"], r["inherited_from"]) for r in license_scan.scan(df).collect()}
    assert got == {
        1: ("MIT", "file", None),
        2: ("MIT", "inherited", "a/LICENSE"),
        3: ("Apache-2.0", "header", None),
        4: (None, None, None),
        5: ("CC-BY-NC-4.0", "header", None),
        6: ("GPL-3.0", "inherited", "a/b/e/COPYING.txt"),
        7: ("GPL-3.0", "file", None),
        8: (None, None, None),
    }
    assert license_scan.scan(df.limit(0)).isEmpty()


def test_licenses_of_wrapped_headers_repeats_ties_and_long_texts(spark):
    notice = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and\nassociated documentation files"
    rows = [
        (1, "p/a.txt", f"prose before\n{notice}\nprose after"),
        (2, "p/b.txt", "Released under the MIT License"),
        (2, "p/b.txt", "Licensed under the Apache License, Version 2.0"),
        (2, "p/b.txt", "Licensed under the Apache License, Version 2.0"),
        (3, "q/LICENSE", "word " * 30_000 + "\nLicensed under CC BY 4.0"),
        (4, "q/r/s/t.txt", "no mark"),
        (5, "q/LICENSE.txt", "Licensed under CC BY 4.0"),
        (None, "q/u.txt", "Released under the MIT License"),
        (7, "", None),
        (8, "/v.txt", ""),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = sorted(((r["doc_id"] or 0, r["license"], r["origin"], r["inherited_from"]) for r in license_scan.scan(df).collect()), key=str)
    # Both licences of document 2 have similarity 1: the last by name; so have both files of folder q.
    assert got == sorted(
        [(0, "MIT", "header", None), (1, "MIT", "header", None), *[(2, "MIT", "header", None)] * 3, (3, "CC-BY-4.0", "file", None), (4, "CC-BY-4.0", "inherited", "q/LICENSE.txt"), (5, "CC-BY-4.0", "file", None), (7, None, None, None), (8, None, None, None)],
        key=str,
    )
