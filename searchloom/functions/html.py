"""Column functions on HTML, none of which leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CONFIG, SHORT_HOSTS
from .text import col, let
from .urls import base_parts, domain, path, resolve, resolve_in, under_any

#: Elements that hold no prose.
DROPPED = "script style noscript template svg nav header footer aside form".split()
NAMED = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&#39;", "'"), ("&apos;", "'"), ("&mdash;", "—"), ("&ndash;", "–"))


def strip_tags(html: Column | str) -> Column:
    return F.regexp_replace(col(html), "<[^>]+>", " ")


def code_point(n: Column) -> Column:
    """The character of a number; what is no character becomes U+FFFD."""
    n = F.pmod(n, F.lit(65536).cast("decimal(38,0)")).cast("int")
    n = F.when((n >= 0xD800) & (n <= 0xDFFF), 0xFFFD).otherwise(n)
    return F.decode(F.unhex(F.lpad(F.hex(n), 4, "0")), "UTF-16BE")


def numeric_entities(text: Column, lead: str, digits: str, number) -> Column:
    """``lead`` digits ``;`` replaced by their character; the rest stays."""
    parts = F.split(text, f"(?i){lead}(?={digits}+;)")

    def one(p: Column, i: Column) -> Column:
        d = F.regexp_extract(p, f"(?i)^({digits}+);", 1)
        return F.when(i == 0, p).otherwise(let(d, lambda x: F.concat(code_point(number(x)), F.substr(p, F.length(x) + 2))))

    return F.array_join(F.transform(parts, one), "")


def decode_entities(text: Column | str) -> Column:
    """Named entities, ``&amp;`` before the others, then decimal and hexadecimal ones."""
    out = col(text)
    for name, value in NAMED:
        out = F.replace(out, F.lit(name), F.lit(value))

    def decimal(t: Column) -> Column:
        return F.when(t.contains("&#"), numeric_entities(t, "&#", r"\d", lambda d: F.coalesce(d.try_cast("decimal(38,0)"), F.lit(0xFFFD)))).otherwise(t)

    def hexadecimal(t: Column) -> Column:
        return F.when(t.contains("&#"), numeric_entities(t, "&#x", "[0-9a-f]", lambda d: F.conv(F.right(d, F.lit(4)), 16, 10).cast("decimal(38,0)"))).otherwise(t)

    return let(let(out, decimal), hexadecimal)


def decode_xml_entities(text: Column | str) -> Column:
    out = col(text)
    for name, value in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        out = F.replace(out, F.lit(name), F.lit(value))
    return F.trim(out)


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def decode_ampersands(text: Column | str) -> Column:
    return F.replace(col(text), F.lit("&amp;"), F.lit("&"))


def title(html: Column | str, decode=decode_entities) -> Column:
    raw = F.regexp_extract(col(html), r"(?i)<title[^>]*>([\s\S]{0,500})</title>", 1)
    return F.substring(collapsed(strip_tags(decode(raw))), 1, 200)


def language(html: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(html), r"(?i)<html[^>]+lang\s*=\s*[\"']([a-zA-Z-]{2,5})", 1))


def prose(decoded: Column | str) -> Column:
    """Decoded HTML without the elements that hold no prose."""
    out = col(decoded)
    for tag in DROPPED:
        out = F.regexp_replace(out, rf"(?i)<{tag}[\s\S]*?</{tag}>", " ")
    return out


def visible_text(prose_html: Column | str) -> Column:
    text = strip_tags(prose_html)
    text = F.regexp_replace(text, "->|=>|→", " ")
    text = F.regexp_replace(text, "[|*_~#>]+", " ")
    return collapsed(F.regexp_replace(text, r"[{}\[\]]", " "))


def link_chars(prose_html: Column | str) -> Column:
    inner = F.regexp_extract_all(col(prose_html), F.lit(r"(?i)<a(?![0-9A-Za-z_])[^>]*>([\s\S]*?)</a>"), F.lit(1))
    return F.aggregate(inner, F.lit(0), lambda a, x: a + F.length(F.regexp_replace(x, "<[^>]+>", " ")))


def raw_links(html: Column | str) -> Column:
    return F.regexp_extract_all(col(html), F.lit(r"(?i)<a[^>]+href\s*=\s*[\"']([^\"'#]+)[\"']"), F.lit(1))


def links(html: Column | str, base: Column | str, most: int = CONFIG.crawl.max_links) -> Column:
    """Distinct absolute web links in order, without fragments."""

    def against(b: Column) -> Column:
        # Equal references are resolved once.
        found = F.transform(F.array_distinct(raw_links(html)), lambda r: resolve_in(decode_entities(r), b))
        return F.slice(F.array_distinct(F.filter(found, lambda u: u.isNotNull())), 1, most)

    return let(base_parts(col(base)), against)


def meta_content(html: Column | str, prop: str) -> Column:
    """The content of a meta tag by property, name or itemprop, whatever the quotes and
    the order of the attributes; empty if there is none."""
    key = rf"(?:property|name|itemprop)=[\"']{prop}[\"']"
    found = [
        F.nullif(F.regexp_extract(col(html), p, 1), F.lit(""))
        for p in (
            rf'(?i)<meta[^>]*{key}[^>]*content="([^"]*)"',
            rf"(?i)<meta[^>]*{key}[^>]*content='([^']*)'",
            rf'(?i)<meta[^>]*content="([^"]*)"[^>]*{key}',
            rf"(?i)<meta[^>]*content='([^']*)'[^>]*{key}",
        )
    ]
    return F.trim(F.coalesce(*found, F.lit("")))


def description(decoded: Column | str) -> Column:
    found = [F.nullif(collapsed(strip_tags(decode_entities(meta_content(decoded, p)))), F.lit("")) for p in ("og:description", "twitter:description", "description")]
    return F.substring(F.coalesce(*found, F.lit("")), 1, 600)


def duration_seconds(raw: Column) -> Column:
    """Seconds of ``95``, ``1:35`` or ``1:02:03``; null for anything else."""
    ok = raw.rlike(r"^\d+(:\d+)*$")
    return F.when(ok, F.aggregate(F.split(raw, ":"), F.lit(0).cast("long"), lambda a, x: a * 60 + x.try_cast("long")))


def format_duration(seconds: Column) -> Column:
    s = seconds.cast("long")
    h, m, rest = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(s > 0, F.when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two(rest))).otherwise(F.concat_ws(":", m.cast("string"), two(rest))))


def meta_tags(html: Column | str) -> Column:
    """All meta tags in one short string, which is then searched instead of the page."""
    tag = r"(?i)<meta[^>]*content=\"[^\"]*\"[^>]*>|<meta[^>]*content='[^']*'[^>]*>|<meta[^>]*>"
    return F.array_join(F.regexp_extract_all(col(html), F.lit(tag), F.lit(0)), "\n")


def classify_media(tags: Column | str, url: Column | str) -> Column:
    """Struct: what a page is (short before video before image before text), with its
    picture, medium, provider, duration and size.  ``tags``: HTML, or its meta tags."""
    tags, url = col(tags), col(url)

    def facts(html: Column) -> Column:
        own = lambda *props: F.coalesce(*(F.nullif(meta_content(html, p), F.lit("")) for p in props))
        number = lambda x: F.nullif(x.try_cast("double"), F.lit(0.0))
        return F.struct(
            F.lower(F.coalesce(own("og:type"), F.lit(""))).alias("og"),
            own("og:image", "twitter:image").alias("image"),
            own("og:video", "og:video:url", "twitter:player").alias("video"),
            F.nullif(duration_seconds(own("og:video:duration", "video:duration", "duration")), F.lit(0).cast("long")).cast("double").alias("duration"),
            number(own("og:video:width", "og:image:width")).alias("width"),
            number(own("og:video:height", "og:image:height")).alias("height"),
            domain(url).alias("host"),
            path(url).alias("path"),
        )

    def kind_of(f: Column) -> Column:
        host, p, og = f["host"], f["path"], f["og"]
        is_image_file = p.rlike(r"(?i)\.(jpe?g|png|gif|webp|avif|bmp)$")
        provider_site = host.rlike(r"(?i)(^|\.)(youtube\.com|youtu\.be|vimeo\.com|dailymotion\.com|twitch\.tv|wistia\.(com|net)|ted\.com)$")
        is_short = p.rlike(r"(?i)/(?:shorts|reels|reel|tiktok|clips?)/") | under_any(host, SHORT_HOSTS)
        is_video = og.contains("video") | og.contains("music") | (provider_site & ~is_image_file) | p.rlike(r"(?i)\.(mp4|webm|mov|m3u8)$")
        is_image = og.startswith("image") | (og == "photo") | is_image_file | p.rlike(r"(?i)/(photo|photos|image|images)/")
        kind = F.when(host == "", "text").when(is_short, "short").when(is_video, "video").when(is_image, "image").otherwise("text")
        return F.struct(f.alias("f"), kind.alias("kind"))

    def made(x: Column) -> Column:
        f, kind = x["f"], x["kind"]
        absolute = lambda c: F.when(c.isNotNull(), F.coalesce(resolve(c, url), c))
        two_labels = let(F.split(f["host"], r"\."), lambda s: F.array_join(F.slice(s, F.greatest(F.size(s) - 1, F.lit(1)), 2), "."))
        return F.struct(
            kind.alias("type"),
            absolute(f["image"]).alias("image"),
            F.coalesce(absolute(f["video"]), F.when(kind != "text", url)).alias("video_url"),
            F.when(kind.isin("short", "video"), two_labels).alias("provider"),
            f["duration"].alias("duration"),
            f["width"].alias("width"),
            f["height"].alias("height"),
            F.when(kind == "short", F.nullif(F.regexp_extract(f["path"], r"(?i)(/(?:shorts|reels|reel|tiktok|clips?)/)", 1), F.lit(""))).alias("short_path"),
        )

    return let(let(let(tags, facts), kind_of), made)


def parse_pages(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``pages`` with title, text, lang, links, link_density, media and description in
    place of the HTML.

    Entities are decoded before elements are dropped, so escaped markup does not come
    back as text.  Steps are separate projections: each large string is made once.
    """
    steps = pages.withColumn("_decoded", decode_entities(html)).withColumn("_prose", prose("_decoded")).withColumn("_full", visible_text("_prose")).withColumn("_tags", meta_tags("_decoded"))
    density = F.when(F.length("_full") > 0, F.least(link_chars("_prose") / F.length("_full"), F.lit(1.0))).otherwise(0.0)
    return (
        steps.withColumn("title", title(html))
        .withColumn("lang", language(html))
        .withColumn("links", links(html, url))
        .withColumn("link_density", density)
        .withColumn("text", F.substring("_full", 1, CONFIG.crawl.max_text_chars))
        .withColumn("media", classify_media("_tags", url))
        .withColumn("description", description("_tags"))
        .drop("_decoded", "_prose", "_full", "_tags", html)
    )
