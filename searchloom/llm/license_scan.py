"""License scans, in DataFrame functions only (operator 4).

Headers (lines, and up to three lines in a row, over which a sentence may be wrapped)
and licence files are compared with templates by the cosine of sparse TF-IDF vectors; document frequencies
count all documents.  What a document does not say itself it takes from the licence file
of its nearest ancestor directory, by joins on paths.

The texts are read twice: for the frequencies of the templates' terms, and for the few
units that hold one of the terms without which no cosine reaches the threshold.  From
there on only units, folders and ids are moved.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Cosine from which a line or file counts as a template's.
THRESHOLD = 0.6
#: Names of licence files.
FILES = r"(?i)^(licen[cs]e|copying|unlicense)([.].*)?$"
#: Lines that a sentence may be wrapped over.
WRAPPED = 3
#: Sentences that state each licence, in notices or in its own text.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-2-Clause", "Use of this source code is governed by a BSD 2-Clause license"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD 3-Clause license"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)


def template_terms(text: str) -> dict[str, int]:
    counts: dict[str, int] = {}
    term = ""
    for c in text.lower() + " ":
        if c.isascii() and c.isalnum():
            term += c
        elif term:
            counts[term] = counts.get(term, 0) + 1
            term = ""
    return counts


def terms_array(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")


def inverse_frequencies(docs: DataFrame, templates=TEMPLATES) -> tuple[dict[str, float], float]:
    """(idf of each template term, idf of a term in no document), over all documents.

    The result has a row for each template term, so its size is that of the templates.
    """
    vocabulary = sorted({t for _, text in templates for t in template_terms(text)})
    own = F.array_intersect(terms_array(F.col("text")), F.array(*map(F.lit, vocabulary)))
    rows = docs.select(F.explode_outer(F.array_append(own, F.lit(""))).alias("term")).groupBy("term").count().collect()
    df = {r[0]: r[1] for r in rows}
    # Each document has the empty term once; texts that are null have only null.
    n = df.get("", 0) + df.get(None, 0)
    return {t: math.log((n + 1) / (df.get(t, 0) + 1)) + 1 for t in vocabulary}, math.log(n + 1) + 1


def weighted(templates, idf: dict[str, float]) -> list[tuple[int, str, dict[str, float]]]:
    """(number, licence, unit vector) of each template."""
    out = []
    for i, (name, text) in enumerate(templates):
        raw = {t: n * idf[t] for t, n in template_terms(text).items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        out.append((i, name, {t: v / norm for t, v in raw.items()}))
    return out


def anchors(vectors, threshold: float) -> list[str]:
    """Terms of which a line over the threshold has at least one: without a template's
    heaviest terms the rest of its unit vector is shorter than the threshold, and no
    cosine with the template can be larger than that."""
    found = set()
    for _, _, vector in vectors:
        rest = 1.0
        for term, w in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
            if math.sqrt(max(0.0, rest)) < threshold - 1e-6:
                break
            found.add(term)
            rest -= w * w
    return sorted(found)


def best_of(units: DataFrame, vectors, idf: dict[str, float], unseen: float, threshold: float) -> DataFrame:
    """(unit, license, similarity) of the distinct strings ``unit`` over the threshold."""
    spark = units.sparkSession
    table = spark.createDataFrame([(i, name, t, float(w)) for i, name, v in vectors for t, w in v.items()], "template int, license string, term string, weight double")
    weights = spark.createDataFrame([(t, float(v)) for t, v in idf.items()], "term string, idf double")
    counts = units.select("unit", F.explode(terms_array(F.col("unit"))).alias("term")).groupBy("unit", "term").agg(F.count("*").alias("tf"))
    vector = counts.join(F.broadcast(weights), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unseen)))
    norms = vector.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = vector.join(F.broadcast(table), "term").groupBy("unit", "template", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    cosine = dots.join(norms, "unit").select("unit", "license", (F.floor(F.col("dot") / F.col("norm") * 1e6 + 0.5) / 1e6).alias("similarity"))
    top = cosine.where(F.col("similarity") >= threshold).groupBy("unit").agg(F.max(F.struct("similarity", F.struct("license").alias("k"))).alias("m"))
    return top.select("unit", F.col("m.k.license").alias("license"), F.col("m.similarity").alias("similarity"))


def own_licenses(docs: DataFrame, templates, threshold: float) -> DataFrame:
    """(doc_id, path, license, similarity, is_file) of the documents that state one."""
    idf, unseen = inverse_frequencies(docs, templates)
    vectors = weighted(templates, idf)
    has_anchor = r"(?i)(?<![a-z0-9])(" + "|".join(anchors(vectors, threshold)) + r")(?![a-z0-9])"
    is_file = F.coalesce(F.regexp_extract("path", r"([^/]*)$", 1).rlike(FILES), F.lit(False))
    told = docs.where(F.col("text").rlike(has_anchor)).select("doc_id", "path", is_file.alias("is_file"), F.split("text", "\n").alias("lines"), "text")
    rows = lambda n: f"transform(sequence(1, greatest(size(lines) - {n - 1}, 1)), i -> array_join(slice(lines, i, {n}), '\n'))"
    parts = F.flatten(F.array(*(F.expr(rows(n)) for n in range(1, WRAPPED + 1))))
    every = F.when(F.col("is_file"), F.array_append(parts, F.col("text"))).otherwise(parts)
    units = told.select("doc_id", "path", "is_file", F.explode(F.array_distinct(every)).alias("unit")).where(F.col("unit").rlike(has_anchor))
    units = materialize(units, "license-units")
    best = best_of(units.select("unit").distinct(), vectors, idf, unseen, threshold)
    own = units.join(best, "unit").groupBy("doc_id", "path").agg(F.max(F.struct("similarity", F.struct("license").alias("k"))).alias("m"), F.max("is_file").alias("is_file"))
    return materialize(own.select("doc_id", "path", F.col("m.k.license").alias("license"), F.col("m.similarity").alias("similarity"), "is_file"), "license-own")


def folder_of(path: str) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def nearest_licenses(folders: DataFrame, own: DataFrame) -> DataFrame:
    """(folder, license, similarity, path) of the distinct ``folders`` with a licence
    file in them or in an ancestor: of the nearest such folder the file of highest
    similarity, of equals the last by path."""
    best = own.where("is_file").groupBy(folder_of("path").alias("above")).agg(F.max(F.struct("similarity", "path", "license")).alias("m"))
    best = materialize(best.select("above", "m.license", "m.similarity", "m.path"), "license-folders")
    prefix = lambda depth: f"array_join(slice(split(folder, '/'), 1, {depth}), '/')"
    # The folder '' has no parts; of any other all prefixes, itself included.
    depth = F.sequence(F.lit(0), F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/"))))
    steps = folders.select("folder", F.explode(depth).alias("depth")).withColumn("above", F.expr(prefix("depth")))
    # Only numbers are aggregated; the folder found is a prefix again.
    found = steps.join(best.select("above"), "above").groupBy("folder").agg(F.max("depth").alias("depth"))
    return materialize(found.withColumn("above", F.expr(prefix("depth"))).join(best, "above").select("folder", "license", "similarity", "path"), "license-nearest")


def scan(docs: DataFrame, path: str = "path", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, and a path): doc_id, path, license,
    similarity, origin (``file``, ``header``, ``inherited`` or null), inherited_from.

    A document's own licence is that of its line, or lines in a row, or for licence files
    also whole text, of highest cosine; of equals the last by name.  Without one it is
    inherited from the licence file nearest above it.  Null and empty texts have no
    licence of their own, null paths no ancestors.  Rows of one doc_id and path are one
    document, whose licence each of them gets.  Other columns are not looked at.
    """
    docs = docs.select("doc_id", F.col(path).alias("path"), "text")
    own = own_licenses(docs, templates, threshold)
    rows = docs.select("doc_id", "path", folder_of("path").alias("folder"))
    nearest = nearest_licenses(rows.where("folder IS NOT NULL").select("folder").distinct(), own)
    mine = own.select(F.col("doc_id").alias("own_id"), F.col("path").alias("own_path"), "license", "similarity", "is_file")
    done = rows.join(mine, rows.doc_id.eqNullSafe(mine.own_id) & rows.path.eqNullSafe(mine.own_path), "left")
    above = nearest.select(F.col("folder").alias("of"), F.col("license").alias("near_license"), F.col("similarity").alias("near_similarity"), F.col("path").alias("near_path"))
    done = done.join(above, done.folder == above.of, "left")
    has = F.col("license").isNotNull()
    return done.select(
        "doc_id",
        "path",
        F.coalesce("license", "near_license").alias("license"),
        F.when(has, F.col("similarity")).otherwise(F.col("near_similarity")).alias("similarity"),
        F.when(has & F.col("is_file"), "file").when(has, "header").when(F.col("near_license").isNotNull(), "inherited").alias("origin"),
        F.when(~has, F.col("near_path")).alias("inherited_from"),
    )


#: The layout that the query gives ``documents``, which have no paths: folders by source
#: and number, in which each fiftieth document is the folder's licence file.
PATH_SQL = "coalesce(source, 'none') || '/' || CAST(floor(doc_id / 1000) AS BIGINT) || CASE WHEN doc_id % 1000 = 0 THEN '/LICENSE' WHEN doc_id % 50 = 0 THEN '/' || CAST(floor(doc_id / 50) AS BIGINT) || '/LICENSE' ELSE '/' || CAST(floor(doc_id / 50) AS BIGINT) || '/doc_' || doc_id || '.txt' END"


def scan_sql() -> str:
    values = ", ".join(f"({i}, '{name}', '{term}', {n})" for i, (name, text) in enumerate(TEMPLATES) for term, n in template_terms(text).items())
    return rf"""
WITH t(template, license, term, n) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS r, doc_id, {PATH_SQL} AS path, text FROM documents),
dt AS (SELECT DISTINCT r, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM d),
total AS (SELECT count(*) AS n FROM d),
idf AS (SELECT v.term, ln((total.n + 1) / (count(dt.r) + 1)) + 1 AS idf
        FROM (SELECT DISTINCT term FROM t) v CROSS JOIN total LEFT JOIN dt ON dt.term = v.term GROUP BY v.term, total.n),
tw AS (SELECT template, license, t.term, t.n * idf AS w, sqrt(sum(t.n * idf * t.n * idf) OVER (PARTITION BY template)) AS norm FROM t JOIN idf ON t.term = idf.term),
f AS (SELECT doc_id, path, text, regexp_matches(regexp_extract(path, '([^/]*)$', 1), '(?i)^(licen[cs]e|copying|unlicense)([.].*)?$') AS is_file FROM d),
l AS (SELECT doc_id, path, is_file, string_split(text, chr(10)) AS lines FROM f),
u AS (SELECT doc_id, path, is_file, unnest(list_transform(range(1, greatest(len(lines) - n + 1, 1) + 1), lambda i: array_to_string(list_slice(lines, i, i + n - 1), chr(10)))) AS unit
      FROM l, (SELECT unnest([{', '.join(map(str, range(1, WRAPPED + 1)))}]) AS n) UNION SELECT doc_id, path, is_file, text FROM f WHERE is_file),
ut AS (SELECT unit, term, count(*) AS tf FROM (SELECT unit, unnest(regexp_extract_all(lower(unit), '[a-z0-9]+')) AS term FROM (SELECT DISTINCT unit FROM u)) GROUP BY ALL),
uw AS (SELECT unit, ut.term, tf * coalesce(idf, (SELECT ln(n + 1) + 1 FROM total)) AS w FROM ut LEFT JOIN idf ON ut.term = idf.term),
un AS (SELECT unit, sqrt(sum(w * w)) AS norm FROM uw GROUP BY unit),
dot AS (SELECT uw.unit, template, license, sum(uw.w * tw.w / tw.norm) AS dot FROM uw JOIN tw ON uw.term = tw.term GROUP BY ALL),
c AS (SELECT dot.unit, license, floor(dot / norm * 1e6 + 0.5) / 1e6 AS similarity FROM dot JOIN un ON dot.unit = un.unit),
own AS (SELECT doc_id, path, is_file, license, similarity FROM u JOIN c ON u.unit = c.unit WHERE similarity >= {THRESHOLD}
        QUALIFY row_number() OVER (PARTITION BY doc_id, path ORDER BY similarity DESC, license DESC) = 1),
folder AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS folder, path, license, similarity FROM own WHERE is_file
           QUALIFY row_number() OVER (PARTITION BY regexp_replace(path, '/?[^/]*$', '') ORDER BY similarity DESC, path DESC) = 1),
step AS (SELECT p.path, i AS depth, array_to_string(list_slice(string_split(p.path, '/'), 1, i), '/') AS folder
         FROM (SELECT DISTINCT path FROM d WHERE path IS NOT NULL) p, unnest(range(0, len(string_split(p.path, '/')))) AS x(i)),
near AS (SELECT step.path, folder.path AS from_path, license, similarity FROM step JOIN folder ON step.folder = folder.folder
         QUALIFY row_number() OVER (PARTITION BY step.path ORDER BY depth DESC) = 1)
SELECT d.doc_id, d.path, coalesce(own.license, near.license) AS license,
       CASE WHEN own.license IS NOT NULL THEN own.similarity ELSE near.similarity END AS similarity,
       CASE WHEN own.license IS NOT NULL AND own.is_file THEN 'file' WHEN own.license IS NOT NULL THEN 'header' WHEN near.license IS NOT NULL THEN 'inherited' END AS origin,
       CASE WHEN own.license IS NULL THEN near.from_path END AS inherited_from
FROM d LEFT JOIN own ON d.doc_id IS NOT DISTINCT FROM own.doc_id AND d.path IS NOT DISTINCT FROM own.path LEFT JOIN near ON d.path = near.path
"""
