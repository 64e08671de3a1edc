import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from proofsheet.sources import sidecars as op

HEAD = f'<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="{op.RDF}"><rdf:Description xmlns:xmp="{op.XMP}" '


def put(folder, files):
    for name, text in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def test_formats_by_priority(spark, tmp_path):
    put(tmp_path, {
        "a.xmp": HEAD + 'xmp:Rating="4" xmp:Label=" Red "/></rdf:RDF></x:xmpmeta>', "b.xmp": HEAD + "><xmp:Rating>2</xmp:Rating></rdf:Description></rdf:RDF></x:xmpmeta>",
        "c.xmp": HEAD + 'xmp:Rating="0"/></rdf:RDF></x:xmpmeta>', "CaptureOne/Settings9/c.jpg.cos": "<Rating>3</Rating>", "CaptureOne/Cache/c.jpg.cos": "<Rating>1</Rating>",
        "CaptureOne/Cache/d.jpg.cos": '<V Rating="5" ColorTag="6"/>', "e.xmp": HEAD + 'xmp:Rating="5" xmp:Lab', "f.xmp": "", "g.xmp": HEAD + 'xmp:Rating="12" xmp:Label="Blue"/></rdf:RDF></x:xmpmeta>',
        "CaptureOne/Settings9/a.jpg.cos": "<Rating>1</Rating>", "i.xmp": "Rating nonsense", "CaptureOne/Settings9/j.jpg.cos": "<Rating>x</Rating><ColorTag>9</ColorTag>", "other/k.cos": "<Rating>5</Rating>",
    })
    files = op.texts(spark, str(tmp_path))
    photos = spark.createDataFrame([(f"file:{tmp_path}/{n}", "x") for n in ["a.jpg", "a.raw", "b.jpg", "c.jpg", "d.jpg", "e.jpg", "f.jpg", "g.jpg", "h.jpg", "i.jpg", "j.jpg", "k"]], "path string, text string")
    got = {r.path.rpartition("/")[2]: (r.rating, r.color_label, r.source) for r in op.sidecars(photos, files).collect()}
    assert got == {
        "a.jpg": (4, "Red", "xmp"), "a.raw": (4, "Red", "xmp"), "b.jpg": (2, "", "xmp"), "c.jpg": (3, "", "c1_session"), "d.jpg": (5, "Pink", "c1_session"), "e.jpg": (5, "", "xmp"),
        "f.jpg": (0, "", ""), "g.jpg": (0, "Blue", "xmp"), "h.jpg": (0, "", ""), "i.jpg": (0, "", ""), "j.jpg": (0, "", ""), "k": (0, "", ""),
    }


def test_export_counts_and_skips(spark, tmp_path):
    rows = [("x/a.jpg", "keep", f"{tmp_path}/s/a.jpg"), ("a.raw", "cull", f"{tmp_path}/s/a.raw"), ("b.jpg", " maybe ", None), (None, "keep", f"{tmp_path}/s/c.jpg"), ("d.e.jpg", None, f"{tmp_path}/s/d.e.jpg"), ("", "keep", "y")]
    df = spark.createDataFrame(rows, "filename string, decision string, place string")
    stars, label = op.decided(F.trim(F.col("decision")))
    beside = op.export(df, str(tmp_path / "log"), op.document(stars, label), path="place")
    assert beside == {"written": 3, "skipped": 1, "decisions": {"": 1, "cull": 1, "keep": 1}}
    assert sorted(p.name for p in (tmp_path / "s").iterdir()) == ["a.xmp", "d.e.xmp"]
    assert "<xmp:Rating>5<" in (tmp_path / "s/a.xmp").read_text()  # the last by name
    collected = op.export(df, str(tmp_path / "all"), op.document(stars, label))
    assert collected["written"] == 4 and sorted(p.name for p in (tmp_path / "all").glob("*.xmp")) == ["a.xmp", "b.xmp", "d.e.xmp"]
    assert op.export(df.filter("false"), str(tmp_path / "none"), op.document(stars, label)) == {"written": 0, "skipped": 0, "decisions": {}}
    for folder in ("log", "all"):
        assert not list((tmp_path / folder / "_temporary").iterdir())


def test_a_failed_export_leaves_no_file(spark, tmp_path):
    rows = [(f"p{i}.jpg", "keep", "Green") for i in range(40)] + [("bad.jpg", "keep", "Chartreuse")]
    df = spark.createDataFrame(rows, "filename string, decision string, label string").repartition(4)
    with pytest.raises(Exception, match="unknown label"):
        op.export(df, str(tmp_path / "out"), op.document(F.lit(5), F.col("label")))
    assert not list(Path(tmp_path).rglob("*.xmp")) and not list(Path(tmp_path).rglob("_SUCCESS.json"))


def test_abort_removes_what_finished_tasks_wrote(tmp_path):
    writer = op._Writer(str(tmp_path))
    done = writer.write(iter([{"target": f"{tmp_path}/q/a.xmp", "content": "1", "decision": "keep"}, {"target": None, "content": "2", "decision": "cull"}]))
    assert (tmp_path / "q/a.xmp").read_text() == "1" and (done.written, done.skipped) == ({"keep": 1}, 1)
    writer.abort([done, None])
    assert not list(tmp_path.rglob("*.xmp")) and not list((tmp_path / "_temporary").iterdir())


def test_round_trip_of_odd_texts(spark, tmp_path):
    rows = [("a.jpg", 9, "", ["a&b", " ", None, "<x>"], 'he said "no" & left', "é 日本"), ("b.jpg", -3, "Purple", [], "", ""), ("c.jpg", None, None, None, None, None)]
    df = spark.createDataFrame([(*r, "keep") for r in rows], "filename string, n int, label string, words array<string>, told string, head string, decision string")
    op.export(df, str(tmp_path), op.document(F.col("n"), F.col("label"), F.col("words"), F.col("told"), F.col("head")))
    got = {r.path.rpartition("/")[2]: (r.rating, r.color_label, r.keywords, r.description, r.headline) for r in op.parsed(op.texts(spark, str(tmp_path))).collect()}
    assert got == {"a.xmp": (5, "", ["a&b", "<x>"], 'he said "no" & left', "é 日本"), "b.xmp": (0, "Purple", [], "", ""), "c.xmp": (0, "", [], "", "")}
    assert json.loads((tmp_path / "_SUCCESS.json").read_text())["written"] == 3
