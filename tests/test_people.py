import json

from proofsheet.operators import people as op


def test_annotators_in_order(spark):
    rows = [(1, None, "b"), (2, "", "b"), (3, "a", "b"), (4, "c", None), (5, "a", None), (6, None, None), (7, "", "")]
    got = op.annotators(spark.createDataFrame(rows, "line int, edited_by string, user_id string"), ["edited_by", "user_id"], "line").collect()
    assert [tuple(r) for r in got] == [("b", 2), ("a", 2), ("c", 1)]


def test_tastes(spark, tmp_path):
    files = {"ann": {"axis_weights": {"light": 0.5, "pose": "0.25", "odd": 9}}, "bob": {"axis_weights": {"odd": 1}}, "cy": [1], "dee": {"axis_weights": {"light": None, "pose": "x"}}}
    for user, held in files.items():
        (tmp_path / user).mkdir()
        (tmp_path / user / "preferences.json").write_text(json.dumps(held))
    (tmp_path / "eve").mkdir()
    (tmp_path / "eve" / "preferences.json").write_text("{broken")
    got = {r.user: r.weights for r in op.tastes(spark, str(tmp_path), ["light", "pose"]).collect()}
    assert got == {"ann": {"light": 0.5, "pose": 0.25}, "dee": {"light": 0.0, "pose": 0.0}}


def test_by_token(spark):
    sessions = spark.createDataFrame([(1, "x"), (2, "y"), (3, ""), (4, None)], "id int, token string")
    tokens = spark.createDataFrame([("y",), ("y",), ("",), (None,), ("z",)], "token string")
    assert [r.id for r in op.by_token(sessions, tokens).collect()] == [2]
