import random

from searchloom.llm import decontaminate as d


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != t)))
        row = new
    return min(row)


def test_matches_equal_brute_force():
    rng = random.Random(3)
    for _ in range(800):
        item = "".join(rng.choice("abcd ") for _ in range(rng.randint(20, 60))).strip()
        own = list(item)
        for _ in range(rng.randint(0, d.budget(item, 0.1) + 2)):
            k = rng.randrange(len(own))
            own[k : k + 1] = rng.choice([[], ["z"], [own[k], "q"]])
        text = "".join(rng.choice("abcd ") for _ in range(50)) + "".join(own) + "".join(rng.choice("abcd ") for _ in range(50))
        got, best = d.Matcher([(1, item)], 0.1).find(text), distance(item, text)
        assert bool(got) == (best <= d.budget(item, 0.1))
        if got:
            assert got[0][1] == best and distance(item, text[got[0][2] : got[0][3]]) == best


def test_queries(spark):
    item = "the quick brown fox jumps over the lazy dog and then sleeps for a very long while"
    near = item.replace("brown", "brwn").upper()
    docs = spark.createDataFrame([(1, f"Intro. {item}! End"), (2, near), (3, "nothing of it"), (4, None), (5, ""), (6, item[:40]), (1, f"Intro. {item}! End")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, None), (9, "!!")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["distance"]) for r in d.matches(docs, items).collect())
    assert got == [(1, 7, 0), (1, 7, 0), (2, 7, 1)]
    assert sorted(r["doc_id"] for r in d.decontaminated(docs, items).collect()) == [3, 4, 5, 6]
    assert d.matches(docs, items.limit(0)).isEmpty() and d.matches(docs.limit(0), items).isEmpty()


def test_rows_are_judged_by_their_own_text(spark):
    item = "the quick brown fox jumps over the lazy dog and then sleeps for a very long while"
    docs = spark.createDataFrame([(1, item, 5), (1, "clean words", 5), (None, item, 6), (None, None, 6)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = d.decontaminated(docs, items)
    assert got.columns == docs.columns and sorted(map(str, got.collect())) == sorted(map(str, docs.where("text IS NULL OR text LIKE 'clean%'").collect()))
    assert d.decontaminated(docs.limit(0), items).isEmpty()


def test_several_blocks_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_CHARS", 150)
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    items = [(i, text(10)) for i in range(8)]
    docs = [(i, f"{text(30)} {t} {text(30)}") for i, t in items] + [(100, " ".join([text(20_000), items[3][1], text(20_000), items[5][1]])), (101, text(50))]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in d.matches(docs, items).collect())
    assert got == [*((i, i) for i in range(8)), (100, 3), (100, 5)]
    assert [r["doc_id"] for r in d.decontaminated(docs, items).collect()] == [101]
