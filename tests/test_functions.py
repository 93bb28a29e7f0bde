"""Column functions on small rows."""

from pyspark.sql import functions as F

from searchloom import queries
from searchloom.functions import html, ranking, text, urls
from searchloom.plans import query


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_tokenize_splits_at_sharp_s_and_drops_stop_words(spark):
    assert one(spark, text.tokenize("t"), t="The Straße of HTML-5 à la carte x") == ["stra", "html", "carte"]


def test_round_half_up_is_binary(spark):
    assert one(spark, text.round_half_up(F.lit(0.5005))) == 0.5
    assert one(spark, text.round_half_up(F.lit(1.2345))) in (1.234, 1.235)


def test_snippet_takes_the_densest_window(spark):
    words = ["w"] * 60 + ["crawler", "crawlers"] + ["w"] * 60
    got = one(spark, text.snippet("t", ["crawler"]), t=" ".join(words))
    assert got.startswith("…") and got.endswith("…") and got.count("crawler") == 2
    assert one(spark, text.snippet("t", ["zz"]), t=" ".join(words)).startswith("w ")
    assert one(spark, text.snippet("t", ["a"]), t="") == ""


def test_script_profile(spark):
    got = one(spark, text.script_profile("t"), t="Привет hello")
    assert (got["dominant"], got["latin_count"], got["blocked_count"]) == ("cyrillic", 5, 6)
    assert one(spark, text.script_profile("t"), t="123")["dominant"] == "unknown"


def test_urls(spark):
    assert one(spark, urls.normalize_url("u"), u="HTTPS://WWW.Example.com:443/a/../b//?q=1#x") == "https://www.example.com/b?q=1"
    assert one(spark, urls.normalize_url("u"), u="https://example.com") == "https://example.com/"
    assert one(spark, urls.normalize_url("u"), u="not a url") is None
    assert one(spark, urls.domain("u"), u="https://www.a.co.uk/x") == "a.co.uk"
    assert one(spark, urls.tld("u"), u="https://www.a.co.uk/x") == "co.uk"
    assert one(spark, urls.resolve(F.lit("../c?x=1"), F.lit("https://a.test/x/y/z.html"))) == "https://a.test/x/c?x=1"
    assert one(spark, urls.resolve(F.lit("mailto:x@y"), F.lit("https://a.test/"))) is None
    assert one(spark, urls.under_any(F.lit("m.bbc.com"), ["bbc.com"])) is True
    assert one(spark, urls.under_any(F.lit("notbbc.com"), ["bbc.com"])) is False


def test_entities_decode_twice_through_amp(spark):
    assert one(spark, html.decode_entities("t"), t="a &amp;lt; b &#65; &#x42; &eacute; &#39;") == "a < b A B &eacute; '"


def test_parse_pages_drops_escaped_scripts(spark):
    page = "<html lang='it'><title>T &amp; U</title><body>&lt;script&gt;var x&lt;/script&gt; Hello <nav>menu</nav> world <a href='/p?a=1&amp;b=2'>link</a></body></html>"
    got = html.parse_pages(spark.createDataFrame([(1, "https://a.test/x", page)], "page_id int, url string, html string")).first()
    assert got["title"] == "T & U" and got["lang"] == "it"
    assert "var x" not in got["text"] and "menu" not in got["text"] and "Hello" in got["text"]
    assert got["links"] == ["https://a.test/p?a=1&b=2"]


def test_media_precedence(spark):
    kind = lambda h, u: one(spark, html.classify_media("h", "u")["type"], h=h, u=u)
    assert kind('<meta property="og:type" content="video">', "https://a.test/shorts/1") == "short"
    assert kind('<meta property="og:type" content="video">', "https://a.test/x.png") == "video"
    assert kind("", "https://a.test/photos/1") == "image"
    assert kind("", "https://a.test/read") == "text"


def test_durations(spark):
    assert one(spark, html.duration_seconds(F.lit("1:02:03"))) == 3723
    assert one(spark, html.duration_seconds(F.lit("x"))) is None
    assert one(spark, html.format_duration(F.lit(3723))) == "1:02:03"


def test_boosts(spark):
    assert one(spark, ranking.country_boost(F.lit("https://a.it/x"), "IT")) == 1.8
    assert one(spark, ranking.language_boost(F.lit("en-US"), "IT")) == 1.7
    assert one(spark, ranking.vertical_boost(F.lit("image"), "video")) == 1 / 3


def test_vectors_round_trip(spark):
    df = spark.createDataFrame([([0.5, -1.0, 0.25],), ([0.0, 0.0, 0.0],)], "v array<double>").select("v", ranking.quantize(F.col("v")).alias("q"))
    rows = df.select("q", ranking.unpack_bytes(ranking.pack_bytes(F.col("q.q"))).alias("b"), ranking.cosine(F.col("v"), F.col("q.q"), F.col("q.scale")).alias("c")).collect()
    assert [list(r["q"]["q"]) for r in rows] == [[64, -127, 32], [0, 0, 0]]
    assert [list(r["b"]) for r in rows] == [[64, -127, 32], [0, 0, 0]]
    assert rows[0]["c"] > 0.999 and rows[1]["c"] == 0.0


def same_as_sql(spark, path, name, **tables):
    """The rows of a query over small tables, which have to be those of its SQL."""
    import duckdb

    with duckdb.connect() as con:
        for t, df in tables.items():
            df.coalesce(1).write.mode("overwrite").parquet(f"{path}/{t}.parquet")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet/*.parquet')")
        df = queries.QUERIES[name](spark, str(path))
        got = sorted(map(tuple, df.collect()), key=repr)
        want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert got == sorted(want, key=repr)
    return got


def test_page_title_lang_with_entities_is_its_sql(spark, tmp_path):
    page = "<html lang='DE'><title>a &quot;b&quot; &amp; &amp;quot; &#65; <b>c</b></title></html>"
    got = same_as_sql(spark, tmp_path, "page_title_lang", pages=spark.createDataFrame([(1, "https://a.test/x", page)], "page_id long, url string, html string"))
    assert got == [(1, "a &quot;b&quot; & &quot; &#65; c", "de")]
    assert one(spark, html.title("h"), h=page) == 'a "b" & " A c'


def test_query_plans_find_words_beside_letters_beyond_ascii(spark, tmp_path):
    rows = [(1, 0, "user", "der bestö stopß"), (2, 0, "user", "das ßbest ölvs"), (3, 0, "user", "howé nder"), (4, 0, "user", "bester"), (5, 0, "user", "how nder")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = same_as_sql(spark, tmp_path, "query_plans", conversations=df)
    assert {r[0]: r[2] for r in got if r[0] > 0} == {1: "best", 2: "best", 3: "how", 4: "lookup", 5: "how"}
    assert [query.intent_of(r[3]) for r in rows] == ["best", "best", "how", "lookup", "how"]


def test_snippet_starts_where_every_window_counted_alone_would(spark):
    import random

    deal, terms, size = random.Random(7), ["nder", "ab", "é"], 34
    pool = ["x", "nder", "nderö-ly", "'n-d'er!", "ab", "a.b", "abc", "É", "éa", "--", "İb", "under"]

    def plain(text, own):
        w = text.split()
        strip = ["".join(c for c in x.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789" or "à" <= c <= "ÿ") for x in w]
        hits = [any(p == t or (len(t) >= 4 and p.startswith(t)) for t in own) for p in strip]
        sums = [sum(hits[i : i + size]) for i in range(len(w) - size + 1)]
        at = sums.index(max(sums)) if sums else 0
        return ("…" if at else "") + " ".join(w[at : at + size]) + ("…" if at + size < len(w) else "")

    texts = ["", " \n ", "ab", "x " * 40 + "ab"]
    for n in (33, 34, 35, 80, 200, 400):
        texts += [deal.choice(["", " "]) + deal.choice([" ", "\n\t "]).join(deal.choices(pool, [deal.choice([1, 9, 90])] + [1] * 11, k=n)) for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    for own in (terms, ["nder"], []):
        made = df.select("i", text.snippet("t", own).alias("s"))
        assert [r["s"] for r in made.orderBy("i").collect()] == [plain(t, own) for t in texts]
    # No window is counted for each word of a text.
    assert "sequence(" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in df.select(text.snippet("t", terms))._jdf.queryExecution().optimizedPlan().toString()
    assert df.select(text.snippet(F.lit(None).cast("string"), terms)).first()[0] is None


def test_quality_of_odd_texts_is_its_sql_and_shingles_are_made_once(spark, tmp_path):
    stamp = "one two three four five six seven "
    texts = ["", " \t", "\n " + stamp * 9 + " \n", "  " + stamp.upper() + stamp * 3, stamp, "a b c d e " * 30, " ".join(f"w{i}" for i in range(90)) + "\t", "let x = [" + "1,2," * 90 + "] " + "k " * 30, "outlet y = [" + "1,2," * 90 + "] ", "camelCase x; {y} " * 40, "ÉCOLE école " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = same_as_sql(spark, tmp_path, "low_quality", documents=df)
    assert len(got) == len(texts)
    plan = queries.QUERIES["low_quality"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sequence(") == 1


def test_scripts_are_counted_beyond_latin_alone(spark, tmp_path):
    texts = ["", "abc 123", "Привет été 你好 𝔘 ß÷×", "αβγ" * 5 + "abc", "ɐɑ ſ", "ሀለሐ ꙁ x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: r[1:4] for r in same_as_sql(spark, tmp_path, "script_profile", documents=df) if r[0] >= 0}
    assert got[2] == ("latin", 6, 8) and got[3] == ("greek", 3, 15)
    plan = df.select(text.script_profile("text").alias("p"))._jdf.queryExecution().optimizedPlan().toString()
    # The text itself is read for Latin and for what is beyond it.
    assert plan.count("regexp_extract_all(text") == 2
