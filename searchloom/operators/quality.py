"""The quality gate: which pages may be indexed and shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BLOCKED_HOST_PREFIXES, BLOCKED_HOSTS, BLOCKED_PATH_PATTERNS, BLOCKED_PATH_SEGMENTS, CONFIG, LATIN_LANGS, SCRIPT_OF_LANG
from ..functions.text import col, is_allowed_language, let, script_profile
from ..functions.urls import domain, hostname, is_curated, path, path_segments, under_any

Q = CONFIG.quality


def is_junk_url(url: Column | str) -> Column:
    """Social, ad and account hosts, listing and legal pages, and what is no URL."""
    host = domain(url)
    p = F.lower(path(url))
    patterns = "(" + "|".join(BLOCKED_PATH_PATTERNS) + ")"
    segments = F.transform(path_segments(url), lambda s: F.regexp_replace(s, r"\.(html?|php|aspx?)$", ""))
    return (
        (host == "")
        | under_any(host, BLOCKED_HOSTS)
        | F.element_at(F.split(host, r"\."), 1).isin(BLOCKED_HOST_PREFIXES)
        | p.rlike(patterns)
        | F.arrays_overlap(segments, F.array(*map(F.lit, BLOCKED_PATH_SEGMENTS)))
    )


def looks_like_code(text: Column | str) -> Column:
    """Machine payload in the first 4,000 characters: an endless word, an assignment of
    a dense literal, key-value pairs without prose, or mostly code-like words."""

    def by_words(own: Column, s: Column) -> Column:
        codeish = F.size(F.filter(own, lambda w: w.rlike(r"^[A-Za-z_][\w$]*[:=,;]$|[\"'{}\[\]]|^[a-z]+[A-Z]")))
        marks = F.regexp_count(s, F.lit(r"[\"'{}\[\]:;=]"))
        return F.exists(own, lambda w: F.length(w) > 400) | ((F.size(own) >= 40) & ((codeish / F.size(own) > 0.25) | (marks / F.length(s) > 0.14)))

    def judged(s: Column) -> Column:
        assigned = F.regexp_extract(s, r"((?=[clv])(?<![0-9A-Za-z_])(?:var|let|const)\s+[A-Za-z_$][\w$]*\s*=\s*[\[{][\s\S]{0,400})", 1)
        dense = let(assigned, lambda a: (a != "") & (F.regexp_count(F.substring(a, 1, 400), F.lit(r"\s")) < 12))
        keyed = let(F.regexp_count(s, F.lit('"[^"]{1,40}":')), lambda n: (n >= 8) & (n / F.greatest(F.length(s) / 200, F.lit(1.0)) > 2))
        words = let(F.array_remove(F.split(s, r"\s+"), ""), lambda own: by_words(own, s))
        return F.when(F.length(s) < 200, False).otherwise(dense | keyed | words)

    return let(F.substring(col(text), 1, 4000), judged)


def shingle_duplicate_ratio(low: Column, size: int = 6) -> Column:
    """Repeats among distinct shingles of ``size`` words, which are in lower case."""

    def ratio(low: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(low) - size)
        shingles = F.transform(starts, lambda i: F.concat_ws(" ", *(F.get(low, i + k) for k in range(size))))
        return F.when(F.size(low) < size, 0.0).otherwise(let(shingles, lambda s: let(F.size(F.array_distinct(s)), lambda n: (F.size(s) - n) / n)))

    return let(low, ratio)


def trimmed(text: Column | str) -> Column:
    return F.btrim(col(text), F.lit(" \t\n\x0b\f\r"))


def lower_words(text: Column | str) -> Column:
    """The words of a trimmed text in lower case; one empty word if it is empty."""
    return F.split(F.lower(col(text)), r"\s+")


def is_low_quality(text: Column | str, duplicates: Column | None = None) -> Column:
    """Too short, a script wall, code, a tiny vocabulary, or stamped phrases.
    ``duplicates``: the text's ``shingle_duplicate_ratio``, if it is known."""

    def by_words(low: Column) -> Column:
        rare = F.size(F.array_distinct(low)) / F.size(low) < 0.12
        ratio = shingle_duplicate_ratio(low) if duplicates is None else duplicates
        return F.when(F.size(low) < 12, False).when(rare, True).otherwise(ratio > Q.max_shingle_dup)

    def judged(t: Column) -> Column:
        return (
            F.when(F.length(t) < Q.min_doc_chars, True)
            .when(t.rlike(r"(?i)^(enable javascript|please enable|loading\.\.\.)"), True)
            .when(looks_like_code(t), True)
            .otherwise(let(lower_words(t), by_words))
        )

    return let(trimmed(text), judged)


def script_of_language(code: Column) -> Column:
    c = F.element_at(F.split(code, "-"), 1)
    out = None
    for script, langs in SCRIPT_OF_LANG.items():
        out = F.when(c.isin(langs), script) if out is None else out.when(c.isin(langs), script)
    return out.otherwise("latin")


def is_latin_language(code: Column) -> Column:
    return F.element_at(F.split(code, "-"), 1).isin(LATIN_LANGS)


def word_count(text: Column | str) -> Column:
    return F.size(F.array_remove(F.split(col(text), r"\s+"), ""))


def reject_reasons(
    url: Column | str = "url", text: Column | str = "text", lang: Column | str = "lang", words: Column | None = None,
    link_density: Column | None = None, site_card: Column | None = None, media_card: Column | None = None,
) -> Column:
    """Struct of junk, language and low_quality; cards are exempt from the length rules,
    curated hosts from the link rule."""
    card = F.coalesce(site_card if site_card is not None else F.lit(False), F.lit(False)) | F.coalesce(media_card if media_card is not None else F.lit(False), F.lit(False))
    density = F.coalesce(link_density if link_density is not None else F.lit(0.0), F.lit(0.0))
    count = F.coalesce(words, word_count(text)) if words is not None else word_count(text)
    low = (~card & ((count < Q.min_words) | is_low_quality(text))) | (~card & ~is_curated(hostname(url)) & (density > Q.max_link_density))
    code = F.lower(F.coalesce(col(lang), F.lit("")))
    declared = (code != "") & ~is_latin_language(code) & (script_of_language(code) != "latin")
    # A declared language of another script decides before the text is looked at.
    language = F.when(declared, True).otherwise(~is_allowed_language(script_profile(text)))
    return F.struct(is_junk_url(url).alias("junk"), language.alias("language"), low.alias("low_quality"))


def first_reason(reasons: Column) -> Column:
    return F.when(reasons["junk"], "junk").when(reasons["language"], "language").when(reasons["low_quality"], "lowQuality")


def gate(docs: DataFrame) -> DataFrame:
    """``docs`` with ``reject_reason``, null for those that stay."""
    has = set(docs.columns)
    own = lambda c: F.col(c) if c in has else None
    reasons = reject_reasons(words=own("word_count"), link_density=own("link_density"), site_card=own("site_card"), media_card=own("media_card"))
    return docs.withColumn("_reasons", reasons).withColumn("reject_reason", first_reason(F.col("_reasons"))).drop("_reasons")


def prune(docs: DataFrame) -> DataFrame:
    """What the present gate still admits."""
    return gate(docs).where("reject_reason IS NULL").drop("reject_reason")


def prune_counts(docs: DataFrame) -> DataFrame:
    return gate(docs).groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
