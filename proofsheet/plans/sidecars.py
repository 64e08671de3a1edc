"""Queries over sidecars: texts made from rows are read, and written ones read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from proofsheet.plans.catalog import query
from proofsheet.plans.views import table
from proofsheet.session import shared_folder
from proofsheet.sources import sidecars as S


def _photos(spark, sf):
    i = F.col("c_custkey")
    name = F.concat(F.lit("img"), i)
    return table(spark, sf, "customer").select(i.alias("photo_id"), F.concat(F.lit("/shoot"), (i % 7).cast("string"), F.lit("/"), name, F.lit(".v2.jpg")).alias("path"), F.abs(F.floor("c_acctbal")).alias("n"), F.col("c_name").alias("title"))


def _files(spark, sf):
    """Tags, attributes, texts that end too early, session files beside them and alone; some say nothing."""
    p = _photos(spark, sf)
    stars, label = F.col("n") % 6, F.get(F.array(*map(F.lit, S.LABELS)), (F.floor(F.col("n") / 7) % 6).cast("int"))
    tags = S.document(stars, label, F.array("title"), F.col("title"))
    head = f'<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="{S.RDF}"><rdf:Description xmlns:xmp="{S.XMP}" xmp:Rating="'
    attributes = F.concat(F.lit(head), stars, F.lit('" xmp:Label="'), label, F.lit('"/></rdf:RDF></x:xmpmeta>'))
    kind = F.col("photo_id") % 5
    common = p.filter(kind < 4).select(F.concat(F.substring_index("path", ".", 2), F.lit(".xmp")).alias("path"), F.when(kind == 0, tags).when(kind == 1, attributes).when(kind == 2, F.substring(attributes, F.lit(1), F.length(attributes) - 12)).otherwise("<x:xmpmeta/>").alias("text"))
    own = F.concat(F.lit("<SO><Rating V='1'>"), (F.col("n") % 9).cast("string"), F.lit('</Rating><E ColorTag="'), (F.col("n") % 8).cast("string"), F.lit('"/></SO>'))
    where = F.concat(F.regexp_extract("path", r"^(.*)/", 1), F.when(F.col("photo_id") % 2 == 0, "/CaptureOne/Settings153/").otherwise("/CaptureOne/Cache/"), F.regexp_extract("path", r"([^/]*)$", 1), F.lit(".cos"))
    return common.unionByName(p.filter(F.col("photo_id") % 3 > 0).select(where.alias("path"), own.alias("text")))


@query("""WITH p AS (SELECT c_custkey AS photo_id, CAST(abs(floor(c_acctbal)) AS BIGINT) AS n FROM customer),
 a AS (SELECT photo_id, n % 6 AS rating, ['', 'Red', 'Yellow', 'Green', 'Blue', 'Purple'][(n // 7) % 6 + 1] AS label FROM p WHERE photo_id % 5 < 3),
 b AS (SELECT photo_id, n % 9 AS rating, ['', 'Red', 'Yellow', 'Green', 'Blue', 'Purple', 'Pink', 'Orange'][n % 8 + 1] AS label FROM p WHERE photo_id % 3 > 0),
 x AS (SELECT p.photo_id, coalesce(a.rating > 0 OR a.label <> '', false) AS one, coalesce(b.rating > 0 OR b.label <> '', false) AS two, a.rating AS ar, a.label AS al, b.rating AS br, b.label AS bl FROM p LEFT JOIN a USING (photo_id) LEFT JOIN b USING (photo_id))
 SELECT photo_id, CAST(CASE WHEN one THEN ar WHEN two THEN br ELSE 0 END AS INT) AS rating, CASE WHEN one THEN al WHEN two THEN bl ELSE '' END AS color_label, CASE WHEN one THEN 'xmp' WHEN two THEN 'c1_session' ELSE '' END AS source FROM x""")
def sidecar_ratings(spark, sf):
    return S.sidecars(_photos(spark, sf), _files(spark, sf)).select("photo_id", "rating", "color_label", "source")


@query("""SELECT 'supplier' || s_suppkey || '.xmp' AS file, CAST(CASE s_nationkey % 4 WHEN 0 THEN 5 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 0 END AS INT) AS rating, CASE s_nationkey % 4 WHEN 0 THEN 'Green' WHEN 1 THEN 'Yellow' WHEN 2 THEN 'Red' ELSE '' END AS color_label,
 [s_name, 'a<b & "c" ' || s_nationkey] AS keywords, s_name || ' > ' || s_acctbal AS description, s_name AS headline FROM supplier""")
def sidecar_export(spark, sf):
    """Written by the data source, one file per row, and read back."""
    s = table(spark, sf, "supplier")
    decision = F.get(F.array(F.lit("keep"), F.lit("maybe"), F.lit("cull"), F.lit("none")), (F.col("s_nationkey") % 4).cast("int"))
    rating, label = S.decided(F.col("decision"))
    words = F.array("s_name", F.concat(F.lit('a<b & "c" '), F.col("s_nationkey")))
    folder = f"{shared_folder(spark)}/sidecars-{uuid.uuid4().hex}"
    rows = s.withColumns({"decision": decision, "filename": F.concat(F.lit("supplier"), F.col("s_suppkey"), F.lit(".raw"))})
    S.export(rows, folder, S.document(rating, label, words, F.concat("s_name", F.lit(" > "), "s_acctbal"), F.col("s_name")))
    return S.parsed(S.texts(spark, folder)).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), "rating", "color_label", "keywords", "description", "headline")
