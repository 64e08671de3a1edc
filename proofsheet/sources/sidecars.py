"""Sidecar files of photos: ratings, labels and captions in XML, in and out.

In: files are read whole, parsed by `from_xml` into a struct of what sidecars hold (tags or attributes, any prefix), and
matched to photos by folder and name. A file that is no XML is searched by patterns, since tools write odd ones. Two formats
by priority: the common one beside the photo, then that of a session's settings folder.

Out: a Python data source, one file per row. A task writes each file under a temporary name and, at its end, renames all;
a task that fails takes its files away. The driver commits by _SUCCESS.json, with counts by decision, and aborts by removing
what finished tasks have written. What a task has written is listed in a file, so no list of names goes to the driver.

Defined results: without a file, or with one that says nothing, rating 0 and empty label and source; a rating that is not
one digit is none; null texts are files without content. A photo without a path is skipped and counted; of rows with one
target the last by the given order stays; an empty table writes no file but the totals.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Labels that tools know, those by a session's number, and what decisions mean.
LABELS = ["", "Red", "Yellow", "Green", "Blue", "Purple"]
NUMBERED = ["", "Red", "Yellow", "Green", "Blue", "Purple", "Pink", "Orange"]
DECISIONS = {"keep": (5, "Green"), "maybe": (3, "Yellow"), "cull": (1, "Red")}
#: Fixed value: marks a packet for the tools.
PACKET = "W5M0MpCehiHzreSzNTczkc9d"
#: Namespaces.
XMP, DC, PHOTOSHOP, RDF = "http://ns.adobe.com/xap/1.0/", "http://purl.org/dc/elements/1.1/", "http://ns.adobe.com/photoshop/1.0/", "http://www.w3.org/1999/02/22-rdf-syntax-ns#"

_BODY = "RDF struct<Description: array<struct<_Rating string, Rating string, _Label string, Label string, subject struct<Bag: struct<li: array<string>>>, description struct<Alt: struct<li: array<struct<_VALUE: string, _lang: string>>>>, Headline string>>>"


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """path and text of each sidecar under a folder."""
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{xmp,cos}").format("binaryFile").load(folder)
    return found.select("path", F.decode("content", "utf-8").alias("text"))


def _first(text: Column, *patterns: str) -> Column:
    """What the first pattern that is found holds."""
    return F.coalesce(*[F.when(text.rlike(p), F.regexp_extract(text, p, 1)) for p in patterns])


def _digit(x: Column) -> Column:
    return F.coalesce(F.when(x.rlike(r"^[0-9]$"), x.cast("int")), F.lit(0))


def parsed(files: DataFrame, text: str = "text") -> DataFrame:
    """files with rating, color_label, keywords, description and headline of the common format."""
    known = files.withColumn("_xml", F.from_xml(F.col(text), _BODY, {"ignoreNamespace": "true"}))
    parts = F.coalesce(F.col("_xml.RDF.Description"), F.array())

    def each(field: str) -> Column:
        return F.filter(F.transform(parts, lambda d: d[field]), lambda v: v.isNotNull())

    said = lambda *names: F.coalesce(*[F.get(each(n), F.lit(0)) for n in names])
    odd = F.size(parts) == 0
    rating = F.when(odd, _first(F.col(text), r'xmp:Rating="([0-9])"', r"xmp:Rating>([0-9])</xmp:Rating>")).otherwise(said("_Rating", "Rating"))
    label = F.when(odd, _first(F.col(text), r'xmp:Label="([^"]*)"', r"xmp:Label>([^<]*)</xmp:Label>")).otherwise(said("_Label", "Label"))
    words = F.filter(F.flatten(F.transform(parts, lambda d: F.coalesce(d["subject"]["Bag"]["li"], F.array().cast("array<string>")))), lambda w: w.isNotNull())
    told = F.filter(F.flatten(F.transform(parts, lambda d: F.coalesce(F.transform(d["description"]["Alt"]["li"], lambda x: x["_VALUE"]), F.array().cast("array<string>")))), lambda w: w.isNotNull())
    return known.select("*", _digit(rating).alias("rating"), F.trim(F.coalesce(label, F.lit(""))).alias("color_label"), words.alias("keywords"), F.coalesce(F.get(told, F.lit(0)), F.lit("")).alias("description"), F.coalesce(said("Headline"), F.lit("")).alias("headline")).drop("_xml")


def session_parsed(files: DataFrame, text: str = "text") -> DataFrame:
    """files with rating and color_label of the session format, whose tags stand anywhere and know no prefix."""
    t = F.col(text)
    number = _first(t, r"<ColorTag[^>]*>([0-9])</ColorTag>", r'ColorTag="([0-9])"').cast("int")
    label = F.coalesce(F.get(F.array(*map(F.lit, NUMBERED)), number), F.lit(""))
    return files.withColumns({"rating": _digit(_first(t, r"<Rating[^>]*>([0-9])</Rating>", r'Rating="([0-9])"')), "color_label": label})


def _place(path: Column) -> tuple[Column, Column]:
    """Folder and name."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1), F.regexp_extract(path, r"([^/]*)$", 1)


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def sidecars(photos: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """photos with rating, color_label and source (xmp, c1_session or empty). files: path and text."""
    folder, name = _place(F.col(path))
    mine = photos.withColumns({"_folder": folder, "_name": name, "_stem": _stem(name)})
    at, file = _place(F.col("path"))
    there = files.select("path", "text", at.alias("at"), file.alias("file"))
    common = parsed(there.filter(F.col("path").endswith(".xmp"))).filter("rating > 0 or color_label != ''")
    common = common.groupBy(F.col("at").alias("_folder"), _stem(F.col("file")).alias("_stem")).agg(F.min(F.struct("path", "rating", "color_label")).alias("_a"))
    inside = r"^(.*)/CaptureOne/(Settings[^/]*|Cache)$"
    own = there.filter(F.col("path").endswith(".cos") & F.col("at").rlike(inside))
    # of several the first settings folder, then the cache
    first = F.min(F.struct(F.col("at").endswith("/Cache"), "path", "text")).alias("one")
    own = own.groupBy(F.regexp_extract("at", inside, 1).alias("_folder"), F.regexp_replace("file", r"\.cos$", "").alias("_name")).agg(first)
    own = session_parsed(own.select("_folder", "_name", F.col("one.text").alias("text"))).filter("rating > 0 or color_label != ''")
    own = own.select("_folder", "_name", F.struct("rating", "color_label").alias("_b"))
    both = mine.join(common, ["_folder", "_stem"], "left").join(own, ["_folder", "_name"], "left")
    said = lambda field, none: F.coalesce(F.col(f"_a.{field}"), F.col(f"_b.{field}"), F.lit(none))
    source = F.when(F.col("_a").isNotNull(), "xmp").when(F.col("_b").isNotNull(), "c1_session").otherwise("")
    return both.select(*[F.col(c) for c in photos.columns], said("rating", 0).alias("rating"), said("color_label", "").alias("color_label"), source.alias("source"))


# -- out ------------------------------------------------------------------------------------------------------------------


def _escaped(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def document(rating: Column, label: Column, keywords: Column | None = None, description: Column | None = None, headline: Column | None = None) -> Column:
    """A sidecar's text. Ratings are held to 0..5; an unknown label is an error; blank keywords and empty fields are left out."""
    label = F.coalesce(label, F.lit(""))
    label = F.when(label.isin(LABELS), label).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), label)))
    words = F.filter(F.coalesce(keywords, F.array().cast("array<string>")) if keywords is not None else F.array().cast("array<string>"), lambda w: F.trim(w) != "")
    told, head = (F.coalesce(c, F.lit("")) if c is not None else F.lit("") for c in (description, headline))
    line = lambda x, *text: F.when(x, F.concat(*[F.lit(t) if isinstance(t, str) else t for t in text])).otherwise("")
    items = F.array_join(F.transform(words, lambda w: F.concat(F.lit("          <rdf:li>"), _escaped(w), F.lit("</rdf:li>\n"))), "")
    return F.concat(
        F.lit(f'<?xpacket begin="﻿" id="{PACKET}"?>\n<x:xmpmeta xmlns:x="adobe:ns:meta/">\n  <rdf:RDF xmlns:rdf="{RDF}">\n    <rdf:Description rdf:about="" xmlns:xmp="{XMP}" xmlns:dc="{DC}" xmlns:photoshop="{PHOTOSHOP}">\n      <xmp:Rating>'),
        F.least(F.greatest(F.coalesce(rating.cast("int"), F.lit(0)), F.lit(0)), F.lit(5)).cast("string"), F.lit("</xmp:Rating>\n"),
        line(label != "", "      <xmp:Label>", label, "</xmp:Label>\n"),
        line(F.size(words) > 0, "      <dc:subject>\n        <rdf:Bag>\n", items, "        </rdf:Bag>\n      </dc:subject>\n"),
        line(told != "", '      <dc:description>\n        <rdf:Alt>\n          <rdf:li xml:lang="x-default">', _escaped(told), "</rdf:li>\n        </rdf:Alt>\n      </dc:description>\n"),
        line(head != "", "      <photoshop:Headline>", _escaped(head), "</photoshop:Headline>\n"),
        F.lit('    </rdf:Description>\n  </rdf:RDF>\n</x:xmpmeta>\n<?xpacket end="w"?>\n'),
    )


def decided(decision: Column) -> tuple[Column, Column]:
    """Rating and label of a decision."""
    rating, label = F.lit(0), F.lit("")
    for name, (stars, colour) in DECISIONS.items():
        rating, label = F.when(decision == name, stars).otherwise(rating), F.when(decision == name, colour).otherwise(label)
    return rating, label


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class _Done(WriterCommitMessage):
    """One finished task: its list of files, files by decision, rows skipped."""

    def __init__(self, listed: str, written: dict[str, int], skipped: int):
        self.listed, self.written, self.skipped = listed, written, skipped


class _Writer(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, rows: Iterator[Row]) -> _Done:
        fs, home = _open(self.folder)
        attempt = uuid.uuid4().hex
        scratch = f"{home}/_temporary/{attempt}"
        fs.create_dir(scratch, recursive=True)
        held: dict[str, str] = {}  # names only; the last row of a target stays
        written, skipped = Counter(), 0
        try:
            for n, row in enumerate(rows):
                if row["target"] is None:
                    skipped += 1
                    continue
                with fs.open_output_stream(f"{scratch}/{n}") as out:
                    out.write((row["content"] or "").encode())
                held[row["target"]] = f"{scratch}/{n}"
                written[row["decision"] or ""] += 1
            for target, temporary in held.items():
                where = _open(target)[1]
                fs.create_dir(where.rpartition("/")[0], recursive=True)
                fs.move(temporary, where)
            with fs.open_output_stream(f"{scratch}.list") as out:
                out.write("\n".join(json.dumps(t) for t in held).encode())
        except BaseException:
            for target, temporary in held.items():  # moved ones are no longer under their temporary names
                if fs.get_file_info(temporary).type == pafs.FileType.NotFound and fs.get_file_info(_open(target)[1]).type == pafs.FileType.File:
                    fs.delete_file(_open(target)[1])
            raise
        finally:
            fs.delete_dir(scratch)
        return _Done(f"{scratch}.list", dict(written), skipped)

    def commit(self, messages: list[_Done | None]) -> None:
        fs, home = _open(self.folder)
        done, total = [m for m in messages if m], Counter()
        for m in done:
            total.update(m.written)
        fs.create_dir(home, recursive=True)
        with fs.open_output_stream(f"{home}/_SUCCESS.json") as out:
            out.write(json.dumps({"written": sum(total.values()), "skipped": sum(m.skipped for m in done), "decisions": dict(sorted(total.items()))}).encode())
        for m in done:
            fs.delete_file(m.listed)

    def abort(self, messages: list[_Done | None]) -> None:
        fs, _ = _open(self.folder)
        for m in messages:
            if m:
                with fs.open_input_stream(m.listed) as listed:
                    names = [json.loads(x) for x in listed.read().decode().splitlines()]
                for name in names:
                    if fs.get_file_info(_open(name)[1]).type == pafs.FileType.File:
                        fs.delete_file(_open(name)[1])
                fs.delete_file(m.listed)


class SidecarSource(DataSource):
    """df.write.format("sidecars").mode("append").save(folder): rows of target, content and decision."""

    @classmethod
    def name(cls) -> str:
        return "sidecars"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def export(rows: DataFrame, folder: str, content: Column, decision: str = "decision", filename: str = "filename", path: str | None = None, order: str | None = None) -> dict:
    """Write a sidecar for each row: into folder by the photo's name, or beside the photos where `path` names their place (null: skipped).

    Gives written, skipped and decisions, the counts of _SUCCESS.json. Rows without a file name are left out.
    """
    place = F.concat(F.lit(f"{folder}/"), _stem(_place(F.col(filename))[1])) if path is None else F.concat(_place(F.col(path))[0], F.lit("/"), _stem(_place(F.col(path))[1]))
    named = rows.filter(F.coalesce(F.col(filename), F.lit("")) != "")
    table = named.select(F.concat(place, F.lit(".xmp")).alias("target"), content.alias("content"), F.trim(F.coalesce(F.col(decision), F.lit(""))).alias("decision"), F.col(order or filename).alias("_order"))
    # rows without a target are spread; those of one target come in order
    spread = F.coalesce(F.col("target"), F.xxhash64("_order").cast("string"))
    table = table.repartition(spread).sortWithinPartitions("target", "_order").drop("_order")
    rows.sparkSession.dataSource.register(SidecarSource)
    table.write.format("sidecars").mode("append").save(folder)
    fs, home = _open(folder)
    with fs.open_input_stream(f"{home}/_SUCCESS.json") as f:
        return json.loads(f.read())
