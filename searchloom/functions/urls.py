"""Column functions on URLs.  They canonicalise what the tables hold: scheme, host in
lower case, default ports, dot segments, fragments and trailing slashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CURATED_HOSTS, TRUSTED_HOSTS
from .text import col, let

SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://"
AUTHORITY = SCHEME + r"(?:[^/?#@]*@)?([^/?#:]*)"


def hostname(url: Column | str) -> Column:
    """Host in lower case, without port; empty if there is none."""
    return F.lower(F.regexp_extract(col(url), AUTHORITY, 2))


def domain(url: Column | str) -> Column:
    return F.regexp_replace(hostname(url), r"^www\.", "")


def host_with_port(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(url), SCHEME + r"(?:[^/?#@]*@)?([^/?#]*)", 2))


def path(url: Column | str) -> Column:
    found = F.regexp_extract(col(url), SCHEME + r"[^/?#]*([^?#]*)", 2)
    return F.when(found == "", "/").otherwise(found)


def without_fragment(url: Column | str) -> Column:
    """The key that a frontier knows a URL by: no fragment, slashes kept."""
    return F.regexp_replace(col(url), "#.*$", "")


def host_labels(host: Column) -> Column:
    return F.array_distinct(F.split(host, r"\."))


def is_exact_host(host: Column, term: str) -> Column:
    return (host == term) | host.startswith(term + ".")


def tld(url: Column | str) -> Column:
    """The last label, or the last two if the first of these is ``co``."""

    def last(parts: Column) -> Column:
        top = F.try_element_at(parts, F.lit(-1))
        return F.when(F.size(parts) < 2, "").when(F.try_element_at(parts, F.lit(-2)) == "co", F.concat(F.lit("co."), top)).otherwise(top)

    return let(F.split(hostname(url), r"\."), last)


def without_dot_segments(p: Column) -> Column:
    """``.`` and ``..`` resolved, as browsers do; the path begins with a slash."""

    def step(acc: Column, s: Column) -> Column:
        return F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.array_append(acc, s))

    parts = F.slice(F.split(p, "/"), 2, 1_000_000)
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    ends = p.endswith("/.") | p.endswith("/..")
    return F.when(p.contains("/."), F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(ends & (F.size(kept) > 0), "/").otherwise(""))).otherwise(p)


def canonical(url: Column | str) -> Column:
    """Without fragment: scheme and host in lower case, no default port, a path."""

    def parts(c: Column) -> Column:
        return F.struct(F.lower(F.regexp_extract(c, SCHEME, 1)).alias("scheme"), host_with_port(c).alias("host"), path(c).alias("path"), F.regexp_extract(c, r"(\?.*)$", 1).alias("query"))

    def joined(u: Column) -> Column:
        host = F.when(u["scheme"] == "http", F.regexp_replace(u["host"], ":80$", "")).when(u["scheme"] == "https", F.regexp_replace(u["host"], ":443$", "")).otherwise(u["host"])
        return F.when((u["scheme"] != "") & (u["host"] != ""), F.concat(u["scheme"], F.lit("://"), host, without_dot_segments(u["path"]), u["query"]))

    return let(let(without_fragment(url), parts), joined)


def normalize_url(url: Column | str) -> Column:
    """``canonical`` without trailing slashes (but for the root); null if not a URL."""

    def stripped(c: Column) -> Column:
        origin, query = F.regexp_extract(c, r"^([^/]*//[^/?]*)", 1), F.regexp_extract(c, r"(\?.*)$", 1)
        return F.concat(origin, let(F.regexp_replace(path(c), "/+$", ""), lambda p: F.when(p == "", "/").otherwise(p)), query)

    return let(canonical(url), stripped)


def discovered_url(url: Column | str) -> Column:
    """``canonical`` for web pages worth fetching, else null: http, no asset, path of at
    most 120 characters."""

    def worth(c: Column) -> Column:
        p = path(c)
        asset = p.rlike(r"(?i)\.(jpg|jpeg|png|gif|svg|webp|pdf|zip|mp4|mp3|css|js|json|xml)$")
        return F.when(c.rlike("^https?://") & ~asset & (F.length(p) <= 120), c)

    return let(canonical(url), worth)


def base_parts(base: Column) -> Column:
    """What references are resolved against: struct of scheme, origin, path, folder."""
    scheme = F.regexp_extract(base, SCHEME, 1)
    return F.struct(scheme.alias("scheme"), F.concat(scheme, F.lit("://"), host_with_port(base)).alias("origin"), path(base).alias("path"), F.regexp_replace(path(base), "[^/]*$", "").alias("folder"))


def resolve_in(ref: Column, base: Column) -> Column:
    """A reference against ``base_parts``; null if it is no web address."""

    def full(r: Column) -> Column:
        return (
            F.when(r.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.when(r.rlike("(?i)^https?://"), r))
            .when(r.startswith("//"), F.concat(base["scheme"], F.lit(":"), r))
            .when(r.startswith("/"), F.concat(base["origin"], r))
            .when(r.startswith("?"), F.concat(base["origin"], base["path"], r))
            .otherwise(F.concat(base["origin"], base["folder"], r))
        )

    return canonical(let(F.trim(ref), full))


def resolve(ref: Column, base: Column) -> Column:
    return let(base_parts(base), lambda b: resolve_in(ref, b))


def path_segments(url: Column | str) -> Column:
    return F.array_remove(F.split(F.lower(path(url)), "/"), "")


def path_depth(url: Column | str) -> Column:
    return F.when(hostname(url) == "", 99).otherwise(F.size(path_segments(url)))


def suffixes(host: Column) -> Column:
    """The host and the domains above it, so a suffix test becomes an equality."""
    return let(F.split(host, r"\."), lambda parts: F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, 1_000), ".")))


def under_any(host: Column, hosts: list[str]) -> Column:
    """Whether the host is one of ``hosts`` (a fixed list) or lies under one."""
    return F.arrays_overlap(suffixes(host), F.array(*map(F.lit, hosts))) if hosts else F.lit(False)


def is_curated(host: Column) -> Column:
    return under_any(host, CURATED_HOSTS)


def is_trusted(host: Column) -> Column:
    return under_any(host, TRUSTED_HOSTS)


def is_ip_host(url: Column | str) -> Column:
    """IPv4 or IPv6 addresses; what is no URL counts as one."""
    h = hostname(url)
    return (h == "") | h.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | h.startswith("[")


def client_ip(forwarded: Column, real: Column) -> Column:
    first = F.trim(F.element_at(F.split(forwarded, ","), 1))
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(F.trim(real), F.lit("")), F.lit("127.0.0.1"))


def is_local_ip(ip: Column) -> Column:
    return (ip == "") | ip.rlike(r"^(127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.|::1$|localhost$|f[cd])")
