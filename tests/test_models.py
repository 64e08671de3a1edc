"""Models against the rules that made their labels."""

from proofsheet.operators import models as O
from proofsheet.plans import catalog
from proofsheet.plans import models as P

SF = "/root/testdata/sf0.01"


def test_cross_validation_finds_the_rule(spark):
    got = catalog.queries()["cross_validation"](spark, SF).collect()
    n = sum(r.n for r in got)
    assert n == P.examples(spark, SF).count() and 0.85 < sum(r.accuracy * r.n for r in got) / n < 0.95 and all(r.auc > 0.75 for r in got)


def test_stars_follow_and_a_thin_axis_is_left_out(spark):
    got = catalog.queries()["learned_stars"](spark, SF).collect()
    assert all(1 <= r.clear_stars <= 5 for r in got) and sum(abs(r.clear - r.clear_stars) for r in got) / len(got) < 0.3


def test_auc_by_pairs(spark):
    rows = [("a", y, s) for y, s in [(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1), (1, 0.7), (0, 0.3)]] + [("b", 1, 0.5), ("b", 0, 0.2)]
    pairs = [(p, n) for _, y, p in rows[:6] if y for _, z, n in rows[:6] if not z]
    want = sum((p > n) + (p == n) / 2 for p, n in pairs) / len(pairs)
    got = {r.k: r.auc for r in O.auc(spark.createDataFrame(rows, "k string, y int, s double"), ["k"], "y", "s").collect()}
    assert abs(got["a"] - want) < 1e-12 and got["b"] is None


def test_missing_values_are_marked(spark):
    d = spark.createDataFrame([(1, float("nan")), (2, None), (3, 1.5)], "i int, x double")
    assert [(r.i, r.x, r.x__missing) for r in O.feature_table(d, ["x"]).orderBy("i").collect()] == [(1, None, 1), (2, None, 1), (3, 1.5, 0)]


def test_folds_are_even_within_labels(spark):
    rows = [(i, "x" if i % 3 == 0 else "y" if i % 50 else None, i) for i in range(1003)] + [(5000, "rare", 1)] * 7
    for k, parts in ((5, 8), (3, 1)):
        df = spark.createDataFrame(rows, "key int, label string, fold int").withColumnRenamed("fold", "other").repartition(parts)
        got = O.folds(df, "key", "label", k).groupBy("label", "fold").count().collect()
        for label in ("x", "y", None, "rare"):
            sizes = [r["count"] for r in got if r.label == label]
            assert len(sizes) == k and max(sizes) - min(sizes) <= 1 and sum(sizes) == sum(r[1] == label for r in rows)
        again = [{(r.key, r.other): r.fold for r in O.folds(df.filter("key < 5000"), "key", "label", k).collect()} for _ in range(2)]
        assert again[0] == again[1]


def test_weights_find_the_rare_class(spark, tmp_path):
    import random

    rnd = random.Random(30)
    rows = [(i, rare := int(rnd.random() < 0.06), rnd.gauss(1.2 if rare else 0.0, 1.0), rnd.choice("ab")) for i in range(1500)]
    df = O.feature_table(spark.createDataFrame(rows, "key int, y int, x double, scene string"), ["x"])
    weight = {r.y: r.weight for r in O.balanced(df, "y").select("y", "weight").distinct().collect()}
    n = sum(r[1] for r in rows)
    assert abs(weight[1] - 1500 / (2 * n)) < 1e-9 and abs(weight[0] - 1500 / (2 * (1500 - n))) < 1e-9
    recall = {}
    for even in (True, False):
        model = O.train_classifier(df, "y", ["x"], ["scene"], even)
        out = O.scored(model, df)
        recall[even] = out.filter("y = 1 and pred = 'keep'").count() / n
    assert recall[True] > 0.6 > 0.4 > recall[False]
    model = O.train_classifier(df, "y", ["x"], ["scene"])
    O.saved(model, str(tmp_path / "m"))
    O.saved(model, str(tmp_path / "m"))
    a, b = ({r.key: r.prob_keep for r in O.scored(m, df).collect()} for m in (model, O.loaded(str(tmp_path / "m"))))
    assert a == b


def test_an_axis_whose_rows_all_miss_a_number_is_trained(spark):
    rows = O.feature_table(spark.range(200).selectExpr("id", "cast(null as double) as lap", "id / 200 as sharp", "1 + 4 * id / 200 as clear"), ["lap", "sharp"])
    got = O.axis_stars(O.train_axes(rows, ["clear"], ["lap", "sharp"]), rows).collect()
    assert len(got) == 200 and max(abs(r.clear - r.clear_stars) for r in got) < 1
