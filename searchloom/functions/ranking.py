"""Column functions for scores, multipliers and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CONFIG, COUNTRY_LANGS, COUNTRY_TLDS
from .urls import tld

R = CONFIG.ranking


def idf(n: Column, df: Column) -> Column:
    return F.when(df > 0, F.ln(1 + (n - df + 0.5) / (df + 0.5))).otherwise(0.0)


def vertical_boost(kind: Column, wanted: str | None) -> Column:
    if wanted is None or wanted == "text":
        return F.lit(1.0)
    return F.when(kind == wanted, R.vertical_boost).otherwise(1 / R.vertical_penalty)


def country_boost(url: Column, country: str) -> Column:
    own = COUNTRY_TLDS.get(country)
    return F.when(tld(url).isin(own), R.geo_boost).otherwise(1.0) if own else F.lit(1.0)


def language_boost(lang: Column, country: str) -> Column:
    wanted = COUNTRY_LANGS.get(country, [])
    if not wanted:
        return F.lit(1.0)
    own = F.element_at(F.split(F.lower(F.coalesce(lang, F.lit(""))), "-"), 1)
    out = F.when(own == wanted[0], R.lang_boost)
    if wanted[1:]:
        out = out.when(own.isin(wanted[1:]), 1 + (R.lang_boost - 1) / 2)
    return out.otherwise(1.0)


def trust(trusted: Column) -> Column:
    return F.when(trusted, R.curated).otherwise(R.discovered)


def popularity(authority: Column, curated_root: Column) -> Column:
    rank = F.greatest(F.coalesce(authority, F.lit(0.0)), F.when(curated_root, R.curated_floor).otherwise(0.0))
    return 1 + R.authority * F.sqrt(rank)


def authority_boost(score: Column) -> Column:
    return F.when(score.isNull(), 1.0).otherwise(1 + R.authority * F.sqrt(score))


def quantize(vector: Column) -> Column:
    """Struct of ``q`` (a byte for each dimension) and ``scale``: peak / 127."""
    v = F.transform(vector, lambda x: x.cast("double"))

    def pack(v: Column) -> Column:
        peak = F.coalesce(F.array_max(F.transform(v, F.abs)), F.lit(0.0))
        scale = F.when(peak > 0, peak / 127).otherwise(1.0)
        return F.element_at(
            F.transform(F.array(scale), lambda s: F.struct(F.transform(v, lambda x: F.greatest(F.least(F.floor(x / s + 0.5), F.lit(127)), F.lit(-128)).cast("tinyint")).alias("q"), s.alias("scale"))),
            1,
        )

    return F.element_at(F.transform(F.array(v), pack), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def cosine(query: Column, q: Column, scale: Column) -> Column:
    """Similarity of a query and a stored vector over their common length; negative
    ones and those of zero vectors are 0."""
    n = F.least(F.size(query), F.size(q))
    a = F.transform(F.slice(query, 1, n), lambda x: x.cast("double"))
    b = F.transform(F.slice(q, 1, n), lambda x: x.cast("double") * scale)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, F.greatest(dot(a, b) / norms, F.lit(0.0))).otherwise(0.0)


def pack_bytes(q: Column) -> Column:
    """Base64 of the bytes, the compact form that files of vectors hold."""
    hexes = F.transform(q, lambda x: F.lpad(F.hex(F.pmod(x.cast("int"), F.lit(256))), 2, "0"))
    return F.base64(F.unhex(F.array_join(hexes, "")))


def unpack_bytes(text: Column) -> Column:
    raw = F.hex(F.unbase64(text))

    def byte(i: Column) -> Column:
        n = F.conv(F.substr(raw, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
        return F.when(n > 127, n - 256).otherwise(n).cast("tinyint")

    n = F.floor(F.length(raw) / 2).cast("int")
    return F.when(n == 0, F.array().cast("array<tinyint>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), byte))
