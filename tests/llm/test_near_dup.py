import random

from searchloom.llm import near_dup


def brute(rows, k, percent):
    sets = {}
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        sets[doc] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d), root(d) == d) for d in docs}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 60))
    rows = [(0, None), (1, ""), (2, "  \n"), (3, "One"), (4, "one"), (5, "two words"), (6, "two words")]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(20, 160))]
        for _ in range(rng.randint(1, 9)):
            own = list(base)
            for _ in range(rng.randint(0, 6)):
                own[rng.randrange(len(own))] = word()
            rows.append((len(rows), " ".join(own)))
    return rows


def result(df, **kw):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(df, **kw).collect()}


def test_components_equal_brute_force(spark):
    rows = corpus(1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(df, k=3, percent=85) == brute(rows, 3, 85)


def test_large_group_and_repeated_rows(spark):
    base = [f"w{i}" for i in range(120)]
    rng = random.Random(5)
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(120)] = f"x{rng.randint(0, 9)}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string")
    want = brute(rows, 5, 80)
    assert result(df) == want and near_dup.near_duplicates(df).count() == 153


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dup.near_duplicates(empty).isEmpty()
    rows = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = result(rows)
    assert got[None] == (2, None, True) and got[2] == (2, 1, False)
