"""Verbs, rows, joins, groups, sets and reshaping on small frames with exact results."""

import pytest
from pyspark.sql import functions as F

from lattica import core
from lattica.operators import groups, joins, reshape, rows, sets, verbs


def vals(df, *cols):
    got = [tuple(r[c] for c in (cols or df.columns)) for r in df.collect()]
    return [g[0] for g in got] if len(cols) == 1 else got


def key(v):
    return [(x is not None, x) for x in (v if isinstance(v, tuple) else (v,))]


def some(df, *cols):
    return sorted(vals(df, *cols), key=key)


@pytest.fixture(scope="module")
def make(spark):
    return lambda rows_, schema: spark.createDataFrame(rows_, schema)


def test_columns(make):
    df = make([(1, 2, 3)], "a int, b int, c int")
    assert verbs.pick(df, ["c", "a"]).columns == ["c", "a"]
    assert verbs.drop(df, "b").columns == ["a", "c"]
    with pytest.raises(ValueError, match="Unknown columns: x, y"):
        verbs.drop(df, ["x", "y"])
    with pytest.raises(TypeError):
        core.resolve_cols([1], "a")
    assert verbs.move(df, "a", after="b").columns == ["b", "a", "c"]
    assert verbs.move(df, "c", before=2).columns == ["a", "c", "b"]
    with pytest.raises(ValueError, match="only one"):
        verbs.relocate(df, "a", "b", "c")
    assert verbs.lastcols(df, ["a", "b"]).columns == ["c", "a", "b"]
    assert verbs.rename(df, z="a").columns == ["z", "b", "c"]
    with pytest.raises(ValueError, match="Unknown"):
        verbs.rename(df, z="q")
    assert core.clean_names(["A b", "a-b", "", "a_b_1", "A b"]) == ["a_b", "a_b_2", "x", "a_b_1", "a_b_3"]
    assert core.clean_names(["1x"], "universal") == ["X1x"]


def test_transform_sees_earlier_columns(make):
    df = make([(1, 10)], "a int, b int")
    out = verbs.transform(df, a="a + 1", c="a * 10", b=None)
    assert out.columns == ["a", "c"] and vals(out) == [(2, 20)]
    assert verbs.transmute(df, c="a + b").columns == ["c"]
    assert vals(verbs.replacewhere(make([(1,), (None,)], "a int"), "a = 1", "a", 9)) == [(9,), (None,)]


def test_subset_treats_null_as_false(make):
    df = make([(1,), (None,), (3,)], "a int")
    assert vals(verbs.subset(df, "a > 1")) == [(3,)]
    assert verbs.filter(df).count() == 3


def test_unite_and_separate(make):
    df = make([("x", "y"), (None, "z")], "a string, b string")
    assert vals(verbs.unite(df, "c", ["a", "b"]), "c") == ["x_y", "NA_z"]
    assert vals(verbs.unite(df, "c", ["a", "b"], na_rm=True), "c") == ["x_y", "z"]
    parts = make([("a-b-c",), ("d-e",)], "t string")
    assert vals(verbs.separate(parts, "t", ["p", "q", "r"], "-")) == [("a", "b", "c"), ("d", "e", None)]
    assert vals(verbs.separate(parts, "t", ["p", "q", "r"], "-", fill="left"))[1] == (None, "d", "e")
    assert vals(verbs.separate(parts, "t", ["p", "q"], "-", extra="merge"))[0] == ("a", "b-c")


def test_blank_family(make):
    df = make([(1, "a"), (2, None), (3, " ")], "id int, value string")
    assert some(rows.missingrows(df, "value"), "id") == [2, 3]
    assert some(rows.omitmissing(df), "id") == [1]
    assert rows.missingrows(df, []).count() == 0
    assert vals(verbs.missingindicator(df, "value"), "missing_value") == [False, True, True]


def test_order_dependent_verbs_need_order(make):
    df = make([(1,)], "a int")
    with pytest.raises(ValueError, match="order"):
        rows.firstby(df, "a", None)


def test_rows(make, spark):
    df = make([(1, "a"), (1, "b"), (2, "c")], "id int, v string")
    assert some(rows.removeduplicates(df, "id", "first", "v"), "v") == ["a", "c"]
    assert some(rows.removeduplicates(df, "id", "last", "v"), "v") == ["b", "c"]
    assert some(rows.removeduplicates(df, "id", "none"), "v") == ["c"]
    assert vals(rows.slice(df, [3, 1, 4], "v"), "v") == ["c", "a", None]
    assert vals(rows.lastrows(df, 2, order="v"), "v") == ["b", "c"]
    assert some(rows.expandrows(make([(1, 2), (2, 0), (3, 1)], "id int, n int"), "n"), "id") == [1, 1, 3]
    with pytest.raises(ValueError):
        rows.expandrows(df, -1)
    with pytest.raises(ValueError):
        rows.samplerows(df, 9)
    assert rows.samplefrac(df, 0.5).count() == 2
    numbered = core.with_row_id(spark.range(1000).repartition(7), "id")
    assert all(r["row_id"] == r["id"] + 1 for r in numbered.collect())
    holes = core.with_row_id(spark.range(600).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("a"), F.col("id").alias("b")), ["a", "b"], buckets=16).collect()
    want = sorted(((r["a"], r["b"]) for r in holes), key=lambda v: (v[0] is None, v[0] or 0, v[1]))
    assert [(r["a"], r["b"]) for r in sorted(holes, key=lambda r: r["row_id"])] == want
    assert vals(rows.reorder(make([(1,), (None,), (2,)], "a int"), "a", True), "a") == [2, 1, None]


def test_fills(make):
    df = make([(1, 1, "A"), (1, 2, None), (1, 3, None), (2, 1, None), (2, 2, "B")], "id int, visit int, t string")
    order = ["id", "visit"]
    assert vals(rows.filldown(df, "t", "id", order="visit").orderBy(*order), "t") == ["A", "A", "A", None, "B"]
    assert vals(rows.fillup(df, "t", "id", order="visit").orderBy(*order), "t") == ["A", None, None, "B", "B"]
    assert vals(rows.fillboth(df, "t", "id", order="visit").orderBy(*order), "t") == ["A", "A", "A", "B", "B"]


def test_completegrid(make):
    df = make([("A", "M", 1), ("A", "F", 2), ("B", "M", 3)], "site string, sex string, value int")
    out = rows.completegrid(df, ["site", "sex"])
    assert out.count() == 4 and out.filter("value is null").count() == 1


def test_equi_joins(make):
    x = make([(1, "a"), (2, "b"), (None, "n")], "id int, v string")
    y = make([(1, "c"), (3, "d"), (None, "m")], "id int, v string")
    assert joins.merge(x, y, "id").columns == ["id", "v.x", "v.y"]
    assert some(joins.merge(x, y, "id")) == [(None, "n", "m"), (1, "a", "c")]
    assert joins.merge(x, y, "id", all=True).count() == 4
    assert some(joins.merge(x, y, "id", all_y=True), "id") == [None, 1, 3]
    assert some(joins.semimerge(x, y, "id"), "v") == ["a", "n"]
    assert some(joins.antimerge(x, y, "id"), "v") == ["b"]
    with pytest.raises(ValueError):
        joins.merge(x, make([(1,)], "z int"))
    dup = make([(1,), (1,), (2,)], "id int")
    one = make([(1,), (2,)], "id int")
    assert [joins.joinrelationship(a, b, "id") for a in (one, dup) for b in (one, dup)] == ["one-to-one", "one-to-many", "many-to-one", "many-to-many"]


def test_rolling_join(make):
    x = make([(1, 5), (1, 10), (1, 15), (1, 1)], "id int, time int")
    y = make([(1, 3, "a"), (1, 8, "b"), (1, 14, "c")], "id int, time int, value string")
    at = lambda **k: dict(vals(joins.rollingmerge(x, y, ["id", "time"], **k), "time", "value"))
    assert at() == {1: None, 5: "a", 10: "b", 15: "c"}
    assert at(direction="forward") == {1: "a", 5: "b", 10: "c", 15: None}
    assert at(direction="nearest") == {1: "a", 5: "a", 10: "b", 15: "c"}
    assert at(tolerance=1) == {1: None, 5: None, 10: None, 15: "c"}


def test_range_joins(make):
    x = make([(1, 0, 10), (1, 0, 10), (2, 0, 20)], "id int, lower int, upper int")
    y = make([(1, 5, "a"), (1, 15, "b"), (2, 5, "c")], "id int, val int, label string")
    assert some(joins.rangemerge(x, y, "id", "lower", "upper", "val"), "label") == ["a", "a", "c"]
    a = make([(1, 1, 4), (1, 10, 14), (2, 50, 60)], "id int, s int, e int")
    b = make([(1, 3, 5, "a"), (1, 12, 15, "b")], "id int, s2 int, e2 int, v string")
    assert some(joins.overlapmerge(a, b, "s", "e", "s2", "e2", "id"), "v") == [None, "a", "b"]
    assert some(joins.overlapmerge(a, b.drop("id"), "s", "e", "s2", "e2"), "v") == [None, "a", "b"]
    d = make([(1, 15)], "id int, date int")
    p = make([(1, 1, 31, "Jan"), (1, 32, 60, "Feb")], "id int, s int, e int, period string")
    assert vals(joins.nonequimerge(d, p, ["id", "date>=s", "date<=e"]), "period") == ["Jan"]


def test_updatemerge(make):
    x = make([(1, "a"), (2, "b"), (3, "c")], "id int, value string")
    y = make([(2, "z"), (3, None)], "id int, value string")
    assert some(joins.updatemerge(x, y, "id")) == [(1, "a"), (2, "z"), (3, None)]


def test_aggregates(make):
    df = make([("a", 1.0), ("a", None), ("b", 2.0), ("b", 4.0)], "g string, v double")
    assert vals(groups.aggregate(df, "g", "v", "mean")) == [("a", None), ("b", 3.0)]
    assert vals(groups.aggregate(df, "g", "v", "sum", na_rm=True)) == [("a", 1.0), ("b", 6.0)]
    assert vals(groups.count(df, "g")) == [("a", 2), ("b", 2)]
    assert some(groups.propcount(df, "g"), "prop") == [0.5, 0.5]
    assert list(groups.split(df, "g")) == ["a", "b"]
    out = groups.applyby(df, "g", lambda f: f.assign(n=len(f))[["n"]].head(1), "n long", bind=True)
    assert some(out) == [("a", 2), ("b", 2)]
    with pytest.raises(ValueError):
        groups.aggregate(df, "g", "v", "nonsense")


def test_sets(make):
    old = make([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    new = make([(2, "b"), (3, "c2"), (4, "d")], "id int, v string")
    assert some(sets.addedrows(old, new, "id"), "id") == [4]
    assert some(sets.removedrows(old, new, "id"), "id") == [1]
    assert some(sets.changedrows(old, new, "id"), "id") == [3]
    assert some(sets.unionrows(old, new, "id"), "v") == ["a", "b", "c", "d"]
    assert some(sets.bind_rows(make([(1,)], "a int"), make([(2, 3)], "a int, b int")), "b") == [None, 3]
    with pytest.raises(TypeError):
        sets.rbindfill(make([(1,)], "a int"), make([("x",)], "a string"))
    assert some(sets.rbindfill(make([(1,)], "a int"), make([("x",)], "a string"), typeconflict="coerce"), "a") == ["1", "x"]


def test_reshape(make):
    df = make([(1, 10, 30), (2, 20, 40)], "id int, x int, y int")
    long = reshape.tolong(df, ["x", "y"])
    assert some(long) == [(1, "x", 10), (1, "y", 30), (2, "x", 20), (2, "y", 40)]
    assert vals(reshape.towide(long, "variable", "value", fun="sum")) == [(1, 10, 30), (2, 20, 40)]
    assert vals(reshape.towide(long.filter("value <> 40"), "variable", "value", fill=0)) == [(1, 1, 1), (2, 1, 0)]
    assert some(reshape.stack(df, ["x", "y"]), "values") == [10, 20, 30, 40]
    assert vals(reshape.unstack(long, "value", "variable", order="id")) == [(10, 30), (20, 40)]
    assert vals(reshape.transpose(df, order="id")) == [(1, 2), (10, 20), (30, 40)]
    spread = df.select(reshape.rowapply(df, lambda a: F.array_max(a), ["x", "y"]).alias("m"))
    assert vals(spread, "m") == [30, 40]


def test_streams_refuse_row_order(spark):
    stream = spark.readStream.format("rate").load()
    with pytest.raises(ValueError, match="stream"):
        rows.firstby(stream, "value", "timestamp")
