"""Operator 7: licence scans by sparse TF-IDF cosine, with inheritance along paths, in DataFrame functions only.

Windows of tokens are compared with the TEMPLATES: headers, tags and the openings of licence files. Tokens weigh term
frequency times inverse document frequency over the templates; tokens that no template has weigh most. A window is laid for
each template on each trigger word in the text, as long as the template and with the trigger where the template has it. So a
notice is found inside a line, over several lines and behind comment marks alike, and words around it don't count. The window
is a notice if its cosine to the template is at least LEAST; the highest cosine of a file decides. Every template has a
trigger; a notice that has lost all of its template's triggers is not found.

Most windows go before anything is scored: by Cauchy's inequality the cosine is at most the length of that part of the
template whose words the window has. Equal windows of all files are scored once.

A file without a notice inherits the licence of the nearest directory above it that has a licence file (LICENSE, COPYING or
NOTICE, with a notice). Directories are resolved first, once each, by joins with their ancestors; files then join on their
directory: licensed directories are broadcast if few (counted), else both sides are salted, since one directory may hold a
third of all files.

Defined results: null texts have no notice; a null path is a file in no directory and inherits nothing; of several notices
the one of highest cosine counts, then by name, so with licence files of a directory; repeated rows get equal results; an
empty table gives an empty result; other columns are ignored. Texts are scanned whole.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofsheet.llm.common import few, written

#: Public licences whose tag is a template, and notices.
TAGGED = ["AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense"]
GNU = "This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} License as published by the Free Software Foundation; either version {v} of the License, or (at your option) any later version."
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3"),
    ("GPL-3.0", GNU.format(what="program", kind="General Public", v="3")),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", GNU.format(what="program", kind="General Public", v="2")),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("AGPL-3.0", GNU.format(what="program", kind="Affero General Public", v="3")),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", GNU.format(what="library", kind="Lesser General Public", v="3")),
    ("LGPL-2.1", GNU.format(what="library", kind="Lesser General Public", v="2.1")),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
] + [(name, f"SPDX-License-Identifier: {name}") for name in TAGGED]
#: Words on which windows are laid.
TRIGGERS = ["cc0", "endorse", "gnu", "hereby", "license", "licensed", "redistribution", "spdx", "unencumbered"]
TOKEN = r"[a-z0-9]+(?:\.[a-z0-9]+)*"
LEAST = 0.85
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)"
#: Directories that may be broadcast; parts of a hot directory beyond that.
FEW_DIRS, SALTS = 100_000, 64


def _tokens(text: str) -> list[str]:
    return re.findall(TOKEN, re.sub("[A-Z]", lambda m: m[0].lower(), text))


def weights() -> tuple[dict[str, float], list[tuple[int, str, str, float]]]:
    """Inverse document frequency by token, and (template, licence, token, weight over the template's length)."""
    bags = [_tokens(t) for _, t in TEMPLATES]
    n = len(bags)
    idf = {w: math.log((1 + n) / (1 + sum(w in b for b in bags))) + 1 for b in bags for w in b}
    out = []
    for i, ((name, _), bag) in enumerate(zip(TEMPLATES, bags, strict=True)):
        raw = {w: bag.count(w) * idf[w] for w in bag}
        length = math.sqrt(sum(v * v for v in raw.values()))
        out += [(i, name, w, v / length) for w, v in raw.items()]
    return idf, out


def trigger_pattern() -> str:
    return "(?i)(^|[^a-z0-9])(" + "|".join(re.escape(w) for w in TRIGGERS) + ")([^a-z0-9]|$)"


def _low(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def places() -> dict[str, list[tuple[int, int, int]]]:
    """For each trigger the templates that have it, after so many tokens and of so many in all."""
    bags = [_tokens(t) for _, t in TEMPLATES]
    return {w: [(k, i, len(bag)) for k, bag in enumerate(bags) for i, x in enumerate(bag) if x == w] for w in TRIGGERS}


def notices(files: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text") -> DataFrame:
    """(key, path, licence, cosine) of the best notice of each file that has one."""
    idf, rows = weights()
    spark = files.sparkSession
    parts = [[{"w": w, "s": v * v} for i, _, w, v in rows if i == k] for k in range(len(TEMPLATES))]
    lies = json.dumps({w: [{"k": k, "o": o, "n": n} for k, o, n in p] for w, p in places().items()})
    lies = F.from_json(F.lit(lies), "map<string,array<struct<k:int,o:int,n:int>>>")
    parts = F.from_json(F.lit(json.dumps(parts)), "array<array<struct<w:string,s:double>>>")

    near = files.select(F.col(key).alias("key"), F.col(path).cast("string").alias("path"), F.col(text).alias("text")).filter(F.col("text").rlike(trigger_pattern()))
    tokens = near.select("key", "path", F.regexp_extract_all(_low(F.col("text")), F.lit(TOKEN), F.lit(0)).alias("t"))
    hits = F.filter(F.transform("t", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda h: h["x"].isin(TRIGGERS))

    def laid(i: Column, p: Column) -> Column:
        # a window that begins before the text is cut there; slices end with the text
        a, cut = F.greatest(i - p["o"], F.lit(0)), F.least(i - p["o"], F.lit(0))
        return F.struct(p["k"].alias("k"), F.slice(F.col("t"), a + 1, p["n"] + cut).alias("w"))

    def may_reach(x: Column) -> Column:
        had = F.filter(F.element_at(parts, x["k"] + 1), lambda q: F.array_contains(x["w"], q["w"]))
        return F.aggregate(had, F.lit(0.0), lambda s, q: s + q["s"]) >= LEAST * LEAST - 1e-9

    windows = F.flatten(F.transform(hits, lambda h: F.filter(F.transform(F.element_at(lies, h["x"]), lambda p: laid(h["i"], p)), may_reach)))
    each = tokens.select("key", "path", F.explode(F.array_distinct(windows)).alias("x")).select("key", "path", "x.k", "x.w", F.xxhash64("x.w").alias("h"))
    each = written(each, "windows")

    # equal windows are scored once
    one = each.groupBy("k", "h").agg(F.first("w").alias("w"))
    tf = one.select("k", "h", F.explode("w").alias("token")).groupBy("k", "h", "token").agg(F.count("*").alias("tf"))
    vocabulary = spark.createDataFrame(sorted(idf.items()), "token string, idf double")
    shares = spark.createDataFrame([(k, w, v) for k, _, w, v in rows], "k int, token string, share double")
    weighed = tf.join(F.broadcast(vocabulary), "token", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(math.log(1 + len(TEMPLATES)) + 1)))
    scored = weighed.join(F.broadcast(shares), ["k", "token"], "left").groupBy("k", "h").agg((F.sum(F.col("w") * F.coalesce("share", F.lit(0.0))) / F.sqrt(F.sum(F.col("w") * F.col("w")))).alias("cosine"))
    names = F.array(*[F.lit(n) for n, _ in TEMPLATES])
    best = scored.select("k", "h", F.element_at(names, F.col("k") + 1).alias("licence"), F.round("cosine", 9).alias("cosine")).filter(F.col("cosine") >= LEAST)
    found = each.select("key", "path", "k", "h").join(best, ["k", "h"])
    return found.groupBy("key", "path").agg(F.min_by(F.struct("licence", "cosine"), F.struct(-F.col("cosine"), F.col("licence"))).alias("b")).select("key", "path", "b.licence", "b.cosine")


def folder(path: Column) -> Column:
    """The directory of a path; '' at the top, null for null."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def ancestors(directory: Column) -> Column:
    """The directory and those above it, nearest first, with ''."""
    parts = F.filter(F.split(directory, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def licence_scan(files: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text") -> DataFrame:
    """doc_id, path, licence, how (own or inherited) and from_dir of each file."""
    own = written(notices(files, key, path, text), "notices")
    names = files.select(F.col(key).alias("doc_id"), F.col(path).cast("string").alias("path"))
    mine = own.select(F.col("key").alias("k_"), F.col("path").alias("p_"), F.col("licence").alias("own"))
    marked = names.join(mine, F.col("doc_id").eqNullSafe(F.col("k_")) & F.col("path").eqNullSafe(F.col("p_")), "left").select("doc_id", "path", "own").withColumn("dir", folder(F.col("path")))

    named = own.filter(F.regexp_extract("path", "[^/]*$", 0).rlike(LICENCE_FILE))
    licensed = named.groupBy(folder(F.col("path")).alias("from_dir")).agg(F.min_by("licence", F.struct(-F.col("cosine"), F.col("licence"))).alias("granted"))
    above = marked.filter("own is null and dir is not null").select("dir").distinct().select("dir", F.posexplode(ancestors(F.col("dir"))).alias("up", "from_dir"))
    resolved = above.join(licensed, "from_dir").groupBy("dir").agg(F.min_by(F.struct("granted", "from_dir"), "up").alias("g")).select(F.col("dir").alias("dir_"), "g.granted", "g.from_dir")
    resolved = written(resolved, "directories")
    if few(resolved, FEW_DIRS):
        out = marked.join(F.broadcast(resolved), F.col("dir") == F.col("dir_"), "left")
    else:
        salted = resolved.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("doc_id", "path"), F.lit(SALTS)).cast("int")
        out = marked.withColumn("salt", salt).join(salted, (F.col("dir") == F.col("dir_")) & (F.col("salt") == F.col("salt_")), "left")
    how = F.when(F.col("own").isNotNull(), "own").when(F.col("granted").isNotNull(), "inherited")
    return out.select("doc_id", "path", F.coalesce("own", "granted").alias("licence"), how.alias("how"), F.when(F.col("own").isNull(), F.col("from_dir")).alias("from_dir"))


def document_path() -> Column:
    """Stand-in paths, since the tables have none: source/lang/file, where a document under 600 characters is a licence file."""
    name = F.when(F.length(F.coalesce("text", F.lit(""))) < 600, F.concat(F.lit("LICENSE-"), F.col("doc_id"))).otherwise(F.concat(F.lit("file-"), F.col("doc_id")))
    return F.concat_ws("/", F.col("source"), F.concat(F.col("lang"), F.floor(F.col("doc_id") / 500)), name)


def _sql() -> str:
    values = ", ".join(f"({i}, '{n}', '{t.replace(chr(39), chr(39) * 2)}')" for i, (n, t) in enumerate(TEMPLATES))
    token = TOKEN
    trigger = trigger_pattern()
    lies = ", ".join(f"('{w}', {k}, {o}, {n})" for w, p in places().items() for k, o, n in p)
    n = len(TEMPLATES)
    return f"""WITH tpl(i, licence, t) AS (VALUES {values}),
lies(w, tk, o, n) AS (VALUES {lies}),
tt AS (SELECT i, licence, unnest(regexp_extract_all(lower(t), '{token}')) AS w FROM tpl),
tf AS (SELECT i, licence, w, count(*) AS c FROM tt GROUP BY ALL),
idf AS (SELECT w, ln({1 + n}.0 / (1 + count(DISTINCT i))) + 1 AS idf FROM tf GROUP BY w),
raw AS (SELECT tf.i, tf.licence, tf.w, c * idf AS v FROM tf JOIN idf ON tf.w = idf.w),
share AS (SELECT i, licence, w, v / sqrt(sum(v * v) OVER (PARTITION BY i)) AS share FROM raw),
f AS (SELECT doc_id, text, concat_ws('/', source, lang || CAST(CAST(floor(doc_id / 500) AS BIGINT) AS VARCHAR), CASE WHEN length(coalesce(text, '')) < 600 THEN 'LICENSE-' ELSE 'file-' END || doc_id) AS path FROM documents),
l AS (SELECT doc_id, regexp_extract_all(lower(text), '{token}') AS t FROM f WHERE regexp_matches(text, '{trigger}')),
p AS (SELECT doc_id, t, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM l),
s AS (SELECT DISTINCT doc_id, tk, greatest(i - o, 1) AS a, n + least(i - o - 1, 0) AS k, t[greatest(i - o, 1) : greatest(i - o, 1) + n + least(i - o - 1, 0) - 1] AS seg FROM p JOIN lies ON p.w = lies.w),
u AS (SELECT doc_id, tk, a, k, unnest(seg) AS w FROM s),
c AS (SELECT doc_id, tk, a, k, w, count(*) AS c FROM u GROUP BY ALL),
cw AS (SELECT doc_id, tk, a, k, c.w, c * coalesce(idf, ln({1 + n}.0) + 1) AS v FROM c LEFT JOIN idf ON c.w = idf.w),
dot AS (SELECT doc_id, tk, a, k, sum(v * coalesce(share, 0)) / sqrt(sum(v * v)) AS d FROM cw LEFT JOIN share ON cw.w = share.w AND share.i = tk GROUP BY ALL),
hit AS (SELECT doc_id, licence, round(d, 9) AS cosine FROM dot JOIN tpl ON tpl.i = tk WHERE round(d, 9) >= {LEAST}),
own AS (SELECT doc_id, licence, cosine FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, licence) AS rn FROM hit) WHERE rn = 1),
m AS (SELECT f.doc_id, path, licence AS own, cosine, regexp_replace(path, '/?[^/]*$', '') AS dir FROM f LEFT JOIN own ON f.doc_id = own.doc_id),
g AS (SELECT dir AS from_dir, own AS granted FROM (SELECT dir, own, row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, own) AS rn FROM m WHERE own IS NOT NULL AND regexp_matches(regexp_extract(path, '[^/]*$'), '{LICENCE_FILE}')) WHERE rn = 1),
r AS (SELECT doc_id, granted, from_dir, row_number() OVER (PARTITION BY doc_id ORDER BY length(from_dir) DESC) AS rn FROM m JOIN g ON m.dir = g.from_dir OR starts_with(m.dir, g.from_dir || '/') OR g.from_dir = '' WHERE own IS NULL)
SELECT m.doc_id, path, coalesce(own, granted) AS licence, CASE WHEN own IS NOT NULL THEN 'own' WHEN granted IS NOT NULL THEN 'inherited' END AS how, from_dir FROM m LEFT JOIN r ON m.doc_id = r.doc_id AND r.rn = 1"""


SQL = _sql()
