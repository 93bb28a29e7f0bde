"""Column functions on text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CONFIG, LATIN, SCRIPTS, STOPWORDS

#: Lower-case letters of Latin words; ``ß`` is not among them, so words split there.
WORD = "a-z0-9à-ÿ"

#: ``\b`` between ASCII letters, digits or ``_`` and all else, as in JavaScript and SQL; that
#: of Java and Python takes every letter for one.
BOUNDARY = "(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"


def sql_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, f) -> Column:
    """``f(value)`` with the value evaluated once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def tokenize(text: Column | str) -> Column:
    """Search terms in order: 2 to 32 letters or digits, no stop words."""
    return F.filter(runs(text, "{2,}+"), lambda t: (F.length(t) <= 32) & ~t.isin(STOPWORDS))


def runs(text: Column | str, repeats: str = "++") -> Column:
    """The runs of letters and digits in lower case.  They are sought themselves: Java
    looks for what a class of several ranges leaves out ten times as long."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(f"[{WORD}]{repeats}"), F.lit(0))


def words(text: Column | str, parts: Column | int = -1) -> Column:
    """Words between white space.  Of at most ``parts`` parts, the last is the rest of the
    text, and the first is none if the text begins with white space."""
    return F.array_remove(F.split(col(text), r"\s+", parts), "")


def normalize_text(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(col(text)), r"\s+", " "))


def normalize_phrase(text: Column | str) -> Column:
    """Lower case, runs of anything but letters and digits as one space."""
    return F.array_join(runs(text), " ")


def short_hash(text: Column | str) -> Column:
    return F.substring(F.sha2(col(text), 256), 1, 16)


def round_half_up(x: Column, digits: int = 3) -> Column:
    """floor(x * 10^digits + 0.5) / 10^digits in binary floating point."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def word_matches(word: Column, term: Column) -> Column:
    """Equal, or begun by a term of four letters or more."""
    w, t = F.lower(word), F.lower(term)
    return (w == t) | ((F.length(t) >= 4) & w.startswith(t))


def term_frequency(tokens: Column | str, term: str) -> Column:
    return F.size(F.filter(col(tokens), lambda t: t == term))


def snippet(text: Column | str, terms: list[str], window: int = CONFIG.bm25.snippet_words) -> Column:
    """The densest window of words around the terms, the earliest of equals."""

    def cut(found: Column) -> Column:
        # Of the text, only the words up to the end of the window are needed.
        every = words(text, found["start"] + window + 2)
        return F.when(found["n"] == 0, "").otherwise(joined(every, found["start"], found["n"], window))

    return let(densest_window(text, terms, window), cut)


def densest_window(text: Column | str, terms: list[str], window: int) -> Column:
    """Struct: n, the number of words, and start, that of the words before the window.

    The text is cut before each word that is a term or begins with one of four letters or
    more, so the words of the pieces say where these stand.  The earliest of the densest
    windows is the first or ends in such a word, and a window that ends in one holds at
    most one more than the best before it.
    """
    own = sorted({t.lower() for t in terms if re.fullmatch(f"[{WORD}]+", t.lower())})
    low = F.concat(F.lit(" "), F.lower(col(text)))
    # In a word, only letters and digits count.
    gap = rf"(?:(?![{WORD}])\S)*+"
    found = "|".join(gap + gap.join(t) + ("" if len(t) >= 4 else gap + r"(?!\S)") for t in own)
    pieces = F.split(low, rf"(?<!\S)(?={found})") if own else F.array(low)

    def step(a: Column, size: Column) -> Column:
        at = a["at"] + size
        more = (a["most"] == 0) | (F.element_at(a["last"], F.least(F.lit(window), window + 1 - a["most"])) > at - window)
        return F.struct(
            at.alias("at"),
            F.concat(F.slice(a["last"], 2, window - 1), F.array(at)).alias("last"),
            F.when(more, a["most"] + 1).otherwise(a["most"]).alias("most"),
            F.when(more, F.greatest(F.lit(0), at + 1 - window)).otherwise(a["start"]).alias("start"),
        )

    def placed(sizes: Column) -> Column:
        # at: the words so far; last: the places of the last hits; most: hits of the best.
        zero = F.struct(F.lit(0).alias("at"), F.array_repeat(F.lit(-window), window).alias("last"), F.lit(0).alias("most"), F.lit(0).alias("start"))
        best = F.aggregate(F.slice(sizes, 1, F.size(sizes) - 1), zero, step)
        n = lambda a: a["at"] + F.element_at(sizes, -1)
        return let(best, lambda a: F.struct(n(a).alias("n"), F.when(n(a) >= window, a["start"]).otherwise(0).alias("start")))

    return let(F.transform(pieces, lambda p: F.regexp_count(p, F.lit(r"\S++"))), placed)


def joined(w: Column, start: Column, total: Column, window: int) -> Column:
    body = F.array_join(F.slice(w, start + 1, window), " ")
    return F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(start + window < total, "…").otherwise(""))


def script_counts(text: Column | str) -> dict[str, Column]:
    return {name: F.regexp_count(col(text), F.lit(f"[{ranges}]")) for name, ranges in SCRIPTS.items()}


def script_profile(text: Column | str) -> Column:
    """Struct: dominant, latin_count, blocked_count, blocked_ratio.

    Each script is counted once; ties go to Latin, then to the order of the table.  Latin
    is counted by its runs, the others in what lies beyond U+024F, where they all do.
    """
    of = lambda ranges: F.array_join(F.regexp_extract_all(col(text), F.lit(f"[{ranges}]++"), F.lit(0)), "")
    counts = list(SCRIPTS)
    every = let(of(r"\x{0250}-\x{10FFFF}"), lambda beyond: F.struct(F.length(of(LATIN)).alias("latin"), *(c.alias(n) for n, c in script_counts(beyond).items())))

    def profile(s: Column) -> Column:
        blocked = sum((s[n] for n in counts), F.lit(0))
        top = F.greatest(s["latin"], *(s[n] for n in counts))
        dominant = F.when(s["latin"] == top, "latin")
        for n in counts:
            dominant = dominant.when(s[n] == top, n)
        total = s["latin"] + blocked
        return F.struct(
            F.when(total == 0, "unknown").otherwise(dominant).alias("dominant"),
            s["latin"].cast("long").alias("latin_count"),
            blocked.cast("long").alias("blocked_count"),
            F.when(total == 0, 0.0).otherwise(blocked / total).alias("blocked_ratio"),
        )

    return F.element_at(F.transform(F.array(every), profile), 1)


def is_allowed_language(profile: Column) -> Column:
    """Mostly Latin script, or no letters at all."""
    return (profile["dominant"] == "unknown") | ((profile["blocked_ratio"] <= CONFIG.quality.max_blocked_ratio) & (profile["dominant"] == "latin"))


def truncated(text: Column | str, chars: int = 4000) -> Column:
    """What an embedding service is sent: collapsed and cut."""
    return F.substring(F.trim(F.regexp_replace(col(text), r"\s+", " ")), 1, chars)


def clean_snippet(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(col(text), "^…", ""), "…$", ""), r"\s+", " "))


def ellipsized(text: Column | str, chars: int) -> Column:
    c = col(text)
    return F.when(F.length(c) > chars, F.concat(F.substring(c, 1, chars - 1), F.lit("…"))).otherwise(c)


def site_card_text(title: Column, text: Column, host: Column) -> Column:
    """Title, host and the first four sentences of 41 to 219 characters."""
    sentences = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), F.trim), lambda s: F.length(s).between(41, 219))
    return F.trim(F.concat(title, F.lit(" — "), host, F.lit(". "), F.array_join(F.slice(sentences, 1, 4), " ")))


def media_card_text(title: Column, description: Column, kind: Column, provider: Column) -> Column:
    """Title twice, description, and what and whose the medium is."""
    last = F.concat(kind, F.lit(" "), provider)
    return F.trim(F.array_join(F.filter(F.array(title, title, description, last), lambda x: x.isNotNull() & (x != "")), ". "))


def marked(text: Column | str, terms: list[str]) -> Column:
    """Whole words among ``terms`` in <mark> tags."""
    own = [t for t in dict.fromkeys(terms) if t]
    if not own:
        return col(text)
    return F.regexp_replace(col(text), r"(?i)\b(" + "|".join(map(re.escape, own)) + r")\b", "<mark>$1</mark>")


def int_or(raw: Column, fallback: int, low: int, high: int) -> Column:
    """Leading integer of a parameter, clamped; the fallback if there is none."""
    n = F.regexp_extract(F.coalesce(raw, F.lit("")), r"^\s*([+-]?\d{1,18})", 1).try_cast("long")
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(n, F.lit(fallback))))


def bool_or(raw: Column, fallback: bool) -> Column:
    return F.when(raw.isNull(), F.lit(fallback)).otherwise(~F.lower(raw).isin("0", "false", "no", "off"))
