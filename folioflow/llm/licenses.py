"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Templates are whole licence texts (the files of a folder) and the statements by which works name their licenses. What is
compared with them are three kinds of units of every file, each a sparse vector of terms, weighted by one plus the logarithm
of the count times inverse document frequency among the files scanned: the whole file, its paragraphs of several lines (wrapped
headers), and the sentences of its lines. A unit whose cosine to a template reaches THRESHOLD declares that license;
a file's own license is its own as a whole, else its best unit's. A file of which at least half of the terms stand in declaring units of
one kind is a licence file, as is one that is like a licence text as a whole: it covers its directory and what is
below. A file without an own license takes that of the nearest directory above it that holds a licence
file (the best scored one, then the first path).

A term's weight is ln(1 + files / (1 + files that have it)); one that no template has weighs as if the square root of all
files had it: names and years in a header must count, but not more than what it says.

Only DataFrame functions run. The driver holds a number for each term of the templates, a fixed set. A unit can reach the
threshold only if it has one of a few KEY terms (the rest of each template weighs too little, which is worked
out from the weights), a whole file only if it has several, so one pass over the texts leaves the units that can.

Defined cases: null and empty texts declare nothing but inherit; a null path has no directory
and inherits nothing; ties go to the template listed first; repeated rows are separate files;
an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import math
import os
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import release, store

THRESHOLD = 0.75
#: What the terms beside the keys of whole files weigh, at most: the less, the more keys a file must have.
REST = 0.5
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
PARAGRAPH = r"\n(?:[ \t\r]*\n)+"
SENTENCE = r"[.;!?]+(?:\s+|$)"
#: Units of a file.
FILE, BLOCK, LINE = 0, 1, 2
TEXTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "templates")

# The statements by which works name their licenses, and the headers that licences propose.
STATEMENTS = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("MPL-2.0", "This work is subject to the terms of the Mozilla Public License, version 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
]


def terms(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def templates(folder: str = TEXTS) -> list[tuple[str, str]]:
    """(license, text): the statements, then the whole texts of a folder, named for their licenses."""
    out = list(STATEMENTS)
    for name in sorted(os.listdir(folder)):
        with open(os.path.join(folder, name), encoding="utf-8") as f:
            out.append((name.removesuffix(".txt"), f.read()))
    return out


class Index:
    """The templates as sparse vectors of unit length, weighted for a set of files, and the key terms."""

    def __init__(self, counts: list[Counter], files: int, having: dict[str, int], threshold: float = THRESHOLD):
        self.threshold, self.unknown = threshold, math.log(1 + math.sqrt(files))
        self.idf = {t: math.log(1 + files / (1 + having.get(t, 0))) for t in sorted({t for c in counts for t in c})}
        self.vectors = []
        for c in counts:
            own = {t: (1 + math.log(k)) * self.idf[t] for t, k in sorted(c.items())}
            norm = math.sqrt(sum(w * w for w in own.values()))
            self.vectors.append({t: w / norm for t, w in own.items()} if norm else {})
        self.keys = self._keys(threshold)
        self.file_keys = self._keys(REST)
        self.needed = min((self._needed(v) for v in self.vectors if v), default=1)

    def _keys(self, rest: float) -> list[str]:
        """Terms beside which each template's others weigh less than ``rest``: without them that is the most its cosine can be."""
        keys: set[str] = set()
        left = [sum(w * w for w in v.values()) for v in self.vectors]
        while lacking := [k for k, x in enumerate(left) if x >= rest * rest - 1e-9]:
            gain = Counter()
            for k in lacking:
                for t, w in self.vectors[k].items():
                    if t not in keys:
                        gain[t] += w * w
            best = max(sorted(gain), key=gain.__getitem__)
            keys.add(best)
            left = [x - self.vectors[k].get(best, 0.0) ** 2 for k, x in enumerate(left)]
        return sorted(keys)

    def _needed(self, v: dict[str, float]) -> int:
        """Distinct file keys without which no file reaches the threshold for a template."""
        keys = set(self.file_keys)
        short = self.threshold**2 - 1e-9 - sum(w * w for t, w in v.items() if t not in keys)
        n = 0
        for w in sorted((w * w for t, w in v.items() if t in keys), reverse=True):
            if short <= 0:
                break
            short, n = short - w, n + 1
        return max(1, n)


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), 1)


def indexed(files: DataFrame, made: list[tuple[str, str]], text: str = "text", threshold: float = THRESHOLD) -> Index:
    """The templates weighted by the number of files that have each of their terms, counted over all files."""
    counts = [Counter(terms(t)) for _, t in made]
    known = files.sparkSession.createDataFrame([(t,) for t in sorted({t for c in counts for t in c})], "term string")
    met = files.select(F.explode(F.array_distinct(_terms(F.coalesce(F.col(text), F.lit(""))))).alias("term")).join(F.broadcast(known), "term")
    having = {r["term"]: r["count"] for r in met.groupBy("term").count().collect()}  # terms of the templates
    return Index(counts, files.count(), having, threshold)


def scan(files: DataFrame, made: list[tuple[str, str]] | None = None, path: str = "path", text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(key, path, own_license, own_score, license_file, license, licensed_by, distance) of every file.

    licensed_by is the file's own path, or the directory that it inherits from, distance
    directories above (0: its own).
    """
    made = made or templates()
    index, spark = indexed(files, made, text, threshold), files.sparkSession
    names, n = [name for name, _ in made], len(made)
    keyed = rf"(?:^|[^a-z0-9])(?:{'|'.join(map(re.escape, index.keys))})(?![a-z0-9])"
    has_key = lambda x: F.lower(x).rlike(keyed)
    literal = lambda values: F.array(*(F.lit(x) for x in values))
    unit = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("text"))
    none = F.array().cast("array<struct<kind:int,text:string>>")

    # one pass over the texts: their units that may declare something, and the number of their terms
    folder = F.regexp_replace(F.col(path), "/[^/]*$", "")
    rows = files.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(path).alias("path"), F.when(F.col(path).contains("/"), folder).alias("folder"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("terms", F.array_distinct(_terms(F.col("text"))))
    rows = rows.withColumn("any", F.arrays_overlap("terms", literal(index.keys))).withColumn("many", F.size(F.array_intersect("terms", literal(index.file_keys))) >= index.needed)
    blocks = F.filter(F.split("text", PARAGRAPH), has_key)
    sentences = lambda p: F.filter(F.flatten(F.transform(F.split(p, "\n"), lambda x: F.split(x, SENTENCE))), has_key)
    inner = F.flatten(F.transform(blocks, lambda p: F.concat(F.when(p.contains("\n"), F.array(unit(BLOCK, p))).otherwise(none), F.transform(sentences(p), lambda x: unit(LINE, x)))))
    units = F.concat(F.when(F.col("any"), inner).otherwise(none), F.when(F.col("many"), F.array(unit(FILE, F.col("text")))).otherwise(none))
    words = F.when(F.col("any") | F.col("many"), F.regexp_count(F.lower("text"), F.lit(TERM))).otherwise(0)
    rows = store(rows.select("row", "key", "path", "folder", units.alias("units"), words.alias("words")), "licenses")

    counted = rows.where(F.size("units") > 0).select("row", "words", F.posexplode("units").alias("unit", "u")).select("row", "words", "unit", "u.kind", F.explode(_terms(F.col("u.text"))).alias("term"))
    counted = counted.groupBy("row", "words", "unit", "kind", "term").agg(F.count("*").alias("tf"))
    weights = spark.createDataFrame([(t, idf, [v.get(t, 0.0) for v in index.vectors]) for t, idf in index.idf.items()], "term string, idf double, w array<double>")
    counted = counted.join(F.broadcast(weights), "term", "left")  # the templates' terms: a fixed table
    weight = (1 + F.log("tf")) * F.coalesce("idf", F.lit(index.unknown))
    sums = counted.groupBy("row", "words", "unit", "kind").agg(F.sum("tf").alias("terms"), F.sqrt(F.sum(weight * weight)).alias("norm"), *(F.coalesce(F.sum(weight * F.col("w")[k]), F.lit(0.0)).alias(f"d{k}") for k in range(n)))
    best = F.array_max(F.array(*(F.struct((F.col("kind") == FILE).alias("whole"), F.round(F.try_divide(F.col(f"d{k}"), F.col("norm")), 4).alias("score"), F.lit(-k).alias("k")) for k in range(n))))
    declared = sums.withColumn("best", best).where(F.col("best.score") >= index.threshold)
    declared = declared.groupBy("row", "words", "kind").agg(F.max("best").alias("best"), F.sum("terms").alias("inside"))  # three rows a file at most
    declared = declared.groupBy("row", "words").agg(F.max("best").alias("best"), F.max("inside").alias("inside"))
    declared = declared.select("row", F.element_at(literal(names), 1 - F.col("best.k")).alias("own_license"), F.col("best.score").alias("own_score"), (2 * F.col("inside") >= F.col("words")).alias("license_file"))
    found = store(rows.drop("units", "words").join(declared, "row", "left").withColumn("license_file", F.coalesce("license_file", F.lit(False))), "licenses")
    release(rows)

    # directories: the license of those that hold a licence file, then the nearest at or above each
    covers = found.where(F.col("license_file") & F.col("folder").isNotNull()).groupBy("folder").agg(F.min(F.struct((-F.col("own_score")).alias("s"), "path", "own_license")).alias("c")).select(F.col("folder").alias("above"), F.col("c.own_license").alias("license"))
    folders = found.where("own_license is null and folder is not null").select("folder").distinct()
    parts = F.split("folder", "/")
    chain = folders.select("folder", F.posexplode(F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("distance", "above"))
    nearest = chain.join(covers, "above").groupBy("folder").agg(F.min(F.struct("distance", "above", "license")).alias("n"))
    out = found.join(nearest, "folder", "left")
    mine = F.col("own_license").isNotNull()
    return out.select(
        F.col("key").alias(key),
        "path",
        "own_license",
        "own_score",
        "license_file",
        F.coalesce("own_license", "n.license").alias("license"),
        F.when(mine, F.col("path")).otherwise(F.col("n.above")).alias("licensed_by"),
        F.when(mine, F.lit(0)).otherwise(F.col("n.distance")).alias("distance"),
    )


def document_path(source: str = "source", lang: str = "lang", key: str = "doc_id") -> Column:
    """A path for rows of documents: source, language and block of 64 ids, at one of three depths."""
    s, language, d = F.coalesce(F.col(source), F.lit("none")), F.coalesce(F.col(lang), F.lit("none")), F.col(key)
    name = F.concat(F.lit("/"), d.cast("string"), F.lit(".txt"))
    deep = F.concat(F.lit("/"), s, F.lit("/"), language)
    return F.when(d % 8 == 0, F.concat(F.lit("/"), s, name)).when(d % 8 < 4, F.concat(deep, name)).otherwise(F.concat(deep, F.lit("/"), F.floor(d / 64).cast("string"), name))


def oracle_sql(made: list[tuple[str, str]] | None = None) -> str:
    """The same over ``documents`` in DuckDB SQL, without the pass that drops units by key terms."""
    made = made or templates()
    counts = ", ".join(f"({k}, '{t}', {n})" for k, (_, text) in enumerate(made) for t, n in sorted(Counter(terms(text)).items()))
    names = ", ".join(f"({k}, '{x}')" for k, (x, _) in enumerate(made))
    return rf"""
WITH counts(k, term, tf) AS (VALUES {counts}), names(k, name) AS (VALUES {names}),
d AS (SELECT doc_id, coalesce(text, '') AS text,
    CASE WHEN doc_id % 8 = 0 THEN '/' || coalesce(source, 'none') || '/' || doc_id || '.txt'
         WHEN doc_id % 8 < 4 THEN '/' || coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || doc_id || '.txt'
         ELSE '/' || coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || CAST(floor(doc_id / 64) AS BIGINT) || '/' || doc_id || '.txt' END AS path
    FROM documents),
f AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS folder, regexp_extract_all(lower(text), '{TERM}') AS terms, len(regexp_extract_all(lower(text), '{TERM}')) AS words FROM d),
n AS (SELECT count(*) AS n FROM f),
known AS (SELECT DISTINCT term FROM counts),
having_ AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(terms)) AS term FROM f) JOIN known USING (term) GROUP BY term),
idf AS (SELECT term, ln(1 + n / (1 + coalesce(df, 0))) AS idf FROM known LEFT JOIN having_ USING (term) CROSS JOIN n),
weights AS (SELECT k, term, x / sqrt(sum(x * x) OVER (PARTITION BY k)) AS w FROM (SELECT k, term, (1 + ln(tf)) * idf AS x FROM counts JOIN idf USING (term))),
blocks AS (SELECT doc_id, generate_subscripts(s, 1) AS block, unnest(s) AS text FROM (SELECT doc_id, string_split_regex(text, '{PARAGRAPH}') AS s FROM f)),
lines AS (SELECT doc_id, block, generate_subscripts(s, 1) AS line, unnest(s) AS text FROM (SELECT doc_id, block, string_split(text, chr(10)) AS s FROM blocks)),
parts AS (SELECT doc_id, block, line, generate_subscripts(s, 1) AS part, unnest(s) AS text FROM (SELECT doc_id, block, line, string_split_regex(text, '{SENTENCE}') AS s FROM lines)),
units AS (SELECT doc_id, {FILE} AS kind, 0 AS block, 0 AS line, 0 AS part, text FROM f
    UNION ALL SELECT doc_id, {BLOCK}, block, 0, 0, text FROM blocks WHERE contains(text, chr(10))
    UNION ALL SELECT doc_id, {LINE}, block, line, part, text FROM parts),
t AS (SELECT doc_id, kind, block, line, part, term, count(*) AS tf FROM (SELECT doc_id, kind, block, line, part, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM units) GROUP BY ALL),
v AS (SELECT t.*, (1 + ln(tf)) * coalesce(idf, (SELECT ln(1 + sqrt(n)) FROM n)) AS x FROM t LEFT JOIN idf USING (term)),
norms AS (SELECT doc_id, kind, block, line, part, sum(tf) AS terms, sqrt(sum(x * x)) AS norm FROM v GROUP BY ALL),
dots AS (SELECT doc_id, kind, block, line, part, k, sum(x * w) AS dot FROM v JOIN weights USING (term) GROUP BY ALL),
best AS (SELECT doc_id, kind, terms, k, round(dot / norm, 4) AS score FROM dots JOIN norms USING (doc_id, kind, block, line, part)
    QUALIFY row_number() OVER (PARTITION BY doc_id, kind, block, line, part ORDER BY round(dot / norm, 4) DESC, k) = 1),
hits AS (SELECT *, sum(terms) OVER (PARTITION BY doc_id, kind) AS inside FROM best WHERE score >= {THRESHOLD}),
own AS (SELECT doc_id, name AS own_license, score AS own_score, max(inside) OVER (PARTITION BY doc_id) AS inside FROM hits JOIN names USING (k)
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY kind = {FILE} DESC, score DESC, k) = 1),
found AS (SELECT f.doc_id, path, folder, own_license, own_score, coalesce(2 * inside >= words, false) AS license_file FROM f LEFT JOIN own USING (doc_id)),
covers AS (SELECT folder AS above, own_license AS license FROM found WHERE license_file
    QUALIFY row_number() OVER (PARTITION BY folder ORDER BY own_score DESC, path) = 1),
near AS (SELECT doc_id, distance, above, license FROM (
        SELECT doc_id, unnest(range(len(s))) AS distance, array_to_string(s[1:len(s) - unnest(range(len(s)))], '/') AS above
        FROM (SELECT doc_id, string_split(folder, '/') AS s FROM found WHERE own_license IS NULL))
    JOIN covers USING (above) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY distance) = 1)
SELECT doc_id, path, own_license, own_score, license_file, coalesce(own_license, license) AS license,
    CASE WHEN own_license IS NOT NULL THEN path ELSE above END AS licensed_by,
    CAST(CASE WHEN own_license IS NOT NULL THEN 0 ELSE distance END AS INTEGER) AS distance
FROM found LEFT JOIN near USING (doc_id)
"""
