"""Quality rules as a short-circuit cascade, in DataFrame functions only (operator 6).

Each rule names its cost, in units of work on a row, and the condition under which it
rejects.  Cost and selectivity are estimated on a sample of the rows; the rules then run
in the order of rejections per cost, and a row stops at the first that rejects it: a
CASE evaluates a rule only for rows that all rules before it left.  The order changes
the work and the name of the rule that is reported, never the verdict.

Rules on the contract's measures cost nothing more where these are computed anyway;
the other rules look at words and lines again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One row in so many is looked at by the estimates, chosen by its hash.
SAMPLE = 32
SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    name: str
    #: Whether the row is rejected, given the row's words (column ``_words``).
    rejects: Column
    #: Estimated work, in about the time that one character takes a plain scan.
    cost: Column


def words_array(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def word_chars(words: str = "_words") -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def n_symbols(text: str = "_text") -> Column:
    return F.regexp_count(F.col(text), F.lit(SYMBOLS)).cast("long")


def n_dup_lines(text: str = "_text") -> Column:
    """Lines with a word that equal an earlier line."""
    lines = f"filter(split({text}, '\\\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    return F.expr(f"transform(array({lines}), a -> size(a) - size(array_distinct(a)))[0]").cast("long")


def n_repeat_words(words: str = "_words") -> Column:
    """Words in 3-word windows found twice or more.

    Windows are told apart by 64-bit hashes.  Texts without a repeated window, most of
    them, are done after one pass; in others the windows are sorted, those beside an
    equal one give their positions, and each position covers three words up to the
    next one.
    """
    windows = f"transform(sequence(0, size({words}) - 3), i -> xxhash64({words}[i], {words}[i + 1], {words}[i + 2]))"
    placed = "array_sort(transform(h, (x, i) -> struct(x AS h, i AS i)))"
    repeated = f"transform(array({placed}), s -> array_sort(filter(transform(s, (x, j) -> CASE WHEN (j > 0 AND s[greatest(j - 1, 0)].h = x.h) OR (j < size(s) - 1 AND s[least(j + 1, size(s) - 1)].h = x.h) THEN x.i END), p -> p IS NOT NULL)))[0]"
    covered = f"transform(array({repeated}), p -> aggregate(transform(p, (x, j) -> CASE WHEN j < size(p) - 1 THEN least(3, p[least(j + 1, size(p) - 1)] - x) ELSE 3 END), 0L, (a, x) -> a + x))[0]"
    return F.expr(f"CASE WHEN size({words}) < 4 THEN 0L ELSE transform(array({windows}), h -> CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE {covered} END)[0] END")


def lines_with(pattern: str, text: str = "_text") -> Column:
    """Lines with a word that match a pattern."""
    return F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(pattern)))


def lines_of_words(text: str = "_text") -> Column:
    return lines_with("[^\\x20\\x09-\\x0D]", text)


def measure_rules(n: Column, chars: Column, symbols: Column, dup_lines: Column, repeat_words: Column) -> list[tuple[str, Column]]:
    """(name, condition) of the rules on the contract's measures."""
    return [
        ("few_words", n < 50),
        ("symbols", 10 * symbols > n),
        ("word_length", (chars < 2 * n) | (chars > 12 * n)),
        ("repeated_lines", 100 * dup_lines > 40 * F.size(F.split("_text", "\n"))),
        ("repeated_words", 100 * repeat_words > 50 * n),
    ]


def further_rules() -> list[Rule]:
    """Rules beyond the measures: digits, few different words, lists, cut-off lines."""
    n, chars = F.size("_words"), F.length("_text").cast("double")
    return [
        Rule("digits", 100 * F.regexp_count("_text", F.lit("[0-9]")) > 50 * word_chars(), chars),
        Rule("different_words", 100 * F.size(F.array_distinct("_words")) < 10 * n, 10.0 * n),
        Rule("bullets", 100 * lines_with("^[\\x20\\x09]*[-*\u2022]") > 90 * lines_of_words(), 2 * chars),
        Rule("ellipses", 100 * lines_with("([.][.][.]|\u2026)[\\x20\\x09\\x0D]*$") > 30 * lines_of_words(), 2 * chars),
    ]


def standard_rules() -> list[Rule]:
    """Bounds that prose keeps easily: see the README for what each is after."""
    n, chars = F.size("_words"), F.length("_text").cast("double")
    costs = {"few_words": F.lit(1.0), "symbols": chars, "word_length": 0.3 * chars, "repeated_lines": 1.5 * chars, "repeated_words": 60.0 * n}
    return [Rule(k, c, costs[k]) for k, c in measure_rules(n, word_chars(), n_symbols(), n_dup_lines(), n_repeat_words())] + further_rules()


def ordered(docs: DataFrame, rules: list[Rule], text: str = "text") -> list[Rule]:
    """``rules`` by rejections per cost on a sample, ties by cost and name.

    Whether a row is looked at follows from its text's hash.  Only sums leave a task.  A
    rule that rejects no row of the sample stands at the end, cheap ones first.
    """
    sample = prepare(docs.select(text).where(F.pmod(F.xxhash64(text), F.lit(SAMPLE)) == 0), text)
    seen = sample.select(*(F.coalesce(r.rejects, F.lit(False)).cast("int").alias(f"r{i}") for i, r in enumerate(rules)), *(r.cost.cast("double").alias(f"c{i}") for i, r in enumerate(rules)))
    sums = seen.agg(*(F.sum(c).alias(c) for c in seen.columns)).first()
    cost = {r.name: sums[f"c{i}"] or 0.0 for i, r in enumerate(rules)}
    rate = {r.name: (sums[f"r{i}"] or 0) / max(cost[r.name], 1e-9) for i, r in enumerate(rules)}
    return sorted(rules, key=lambda r: (-rate[r.name], cost[r.name], r.name))


def prepare(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("_text", F.coalesce(F.col(text), F.lit(""))).withColumn("_words", words_array(F.col("_text")))


def first_rejection(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects, null if none does; later rules are not
    evaluated for the row."""
    chain = F.lit(None).cast("string")
    for rule in reversed(rules):
        chain = F.when(rule.rejects, rule.name).otherwise(chain)
    return chain


def apply_rules(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``rejected_by``: the first rule of the cascade that rejects the
    row, null where the row is kept.  Null texts count as empty; texts are looked at
    whole; repeated rows are judged alike; other columns are kept, one of the name
    replaced; no row is dropped, moved or shuffled."""
    rules = ordered(docs, rules or standard_rules(), text)
    return prepare(docs, text).withColumn("rejected_by", first_rejection(rules)).drop("_text", "_words")


def measured(docs: DataFrame) -> DataFrame:
    """The contract's measures and verdict of every row of ``docs`` (doc_id, text).

    The measures are returned, so they are computed for each row and the rules on them
    are free; the others are evaluated only for rows that the cascade reaches them with.
    """
    prepared = prepare(docs.select("doc_id", "text"))
    counts = prepared.select(
        "doc_id", "_text", "_words", F.size("_words").cast("long").alias("n_words"), word_chars().alias("word_chars"), n_symbols().alias("n_symbols"), n_dup_lines().alias("n_dup_lines"), n_repeat_words().alias("n_repeat_words")
    )
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    free = [Rule(k, c, F.lit(0.0)) for k, c in measure_rules(*map(F.col, names))]
    dear = ordered(docs, further_rules())
    done = counts.select("doc_id", *names, base.alias("base_failed"), first_rejection([*free, *dear]).alias("rejected_by"))
    return done.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())


MEASURED_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             string_split(text, chr(10)) AS every_line,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT r, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM w, unnest(range(1, len(words) - 1)) AS t(i)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY r),
m AS (SELECT w.r, doc_id, len(words)::BIGINT AS n_words, coalesce(length(array_to_string(words, '')), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             len(regexp_extract_all(text, '[0-9]')) AS n_digits, len(list_distinct(words)) AS n_kinds, len(lines) AS n_word_lines,
             len(list_filter(every_line, lambda x: regexp_matches(x, '^[\x20\x09]*[-*\x{2022}]'))) AS n_bullets,
             len(list_filter(every_line, lambda x: regexp_matches(x, '([.][.][.]|\x{2026})[\x20\x09\x0D]*$'))) AS n_cut,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(every_line) AS n_lines
      FROM w LEFT JOIN cov ON w.r = cov.r),
f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND NOT (10 * n_symbols > n_words) AND NOT (word_chars < 2 * n_words OR word_chars > 12 * n_words)
        AND NOT (100 * n_dup_lines > 40 * n_lines) AND NOT (100 * n_digits > 50 * word_chars) AND NOT (100 * n_kinds < 10 * n_words)
        AND NOT (100 * n_bullets > 90 * n_word_lines) AND NOT (100 * n_cut > 30 * n_word_lines)) AS kept
FROM f
"""
