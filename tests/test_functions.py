"""Column functions on literals and small frames with exact results."""

import datetime as dt
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lattica.functions import dates, distributions, listops, numeric, parsing, recode, rowwise, text, windows


@pytest.fixture(scope="module")
def one(spark):
    """The value of a Column built from values."""

    def value(make, *args):
        return spark.range(1).select(make(*(F.lit(a) for a in args)).alias("v")).first()["v"]

    return value


def test_text(one):
    assert one(text.trim, " \ta b\n") == "a b"
    assert one(text.squish, "  a   b ") == "a b"
    assert one(text.titlecase, "the lord OF the rings") == "The Lord of the Rings"
    assert one(text.sentencecase, "hELLO World") == "Hello world"
    assert one(lambda c: text.padleft(c, 5), "abc") == "  abc" and one(lambda c: text.padleft(c, 2), "abc") == "abc"
    assert one(lambda c: text.padcenter(c, 6, "*"), "abc") == "*abc**"
    assert one(lambda c: text.truncate(c, 6), "abcdefgh") == "abc..."
    assert one(lambda c: text.contains(c, "b"), None) is False
    assert one(lambda c: text.matches(c, "a.c"), "abc") is True
    assert one(lambda c: text.locate(c, "z"), "abc") == -1
    assert one(lambda c: text.locateall(c, "X"), "aXaXa") == [2, 4] and one(lambda c: text.locateall(c, "z"), "a") == [-1]
    assert one(lambda c: text.extract(c, "[0-9]+"), "ab12c3") == "12" and one(lambda c: text.extract(c, "[0-9]+"), "x") is None
    assert one(text.extractnum, "a-1.5b") == -1.5 and one(text.extractnum, "x") is None
    assert one(lambda c: text.extractbetween(c, "<", ">"), "a<b>c") == "b"
    assert one(lambda c: text.splittext(c, ","), "a,b,") == ["a", "b"] and one(lambda c: text.splittext(c, ","), "") == []
    assert one(lambda c: text.splitlast(c, "-"), "a-b-c") == "c"
    assert one(lambda c: text.replacetext(c, "(b)", "[\\1]"), "abc") == "a[b]c"
    assert one(lambda c: text.replacetext(c, "$", "€", True), "$1") == "€1"
    assert one(text.removeaccents, "Éñß") == "Enss"
    assert one(lambda c: text.nearesttext(c, ["apple", "maple"]), "aple") == "apple"
    assert one(text.isemail, "a@b.co") and not one(text.isemail, "a b@c") and not one(text.isalpha, None)
    assert one(text.jointext, "a", None) == "aNA"
    assert one(text.isblank, " ") and one(text.isblank, None) and not one(text.isblank, "x")


def test_collapsetext(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (3, None)], "k int, v string")
    assert df.agg(text.collapsetext("v", "-", order="k").alias("v")).first()["v"] == "a-b-NA"


def test_recode(one, spark):
    assert one(lambda c: recode.naif(c, ["x"]), "x") is None
    assert one(lambda c: recode.nato(c, 0.0), float("nan")) == 0.0
    assert one(lambda c: recode.replacevalues(c, ["a", "b"], ["b", "c"]), "a") == "b"
    assert one(lambda c: recode.collapsevalues(c, {"p": ["a"], "q": ["a"]}), "a") == "q"
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,)], "v string")
    assert sorted(r[0] for r in recode.lump(df, "v", 1).collect()) == ["Other", "Other", "Other", "a", "a"]
    assert recode.levels_of(recode.expandlevels(df, "v", ["z"]), "v") == ["a", "b", "c", "z"]
    assert one(lambda c: recode.reorderlevels(c, ["y", "x"])["code"], "x") == 2


def test_expandlevels_refuses_to_cut(spark):
    many = spark.range(10_001).selectExpr("cast(id as string) AS v")
    with pytest.raises(ValueError, match="10,000 levels"):
        recode.expandlevels(many, "v", ["z"])
    assert len(recode.levels_of(recode.expandlevels(many.filter("v <> '7'"), "v", ["z"]), "v")) == 10_001


def test_parsing(one, spark):
    assert one(parsing.parseint, "12.7") == 12 and one(parsing.parseint, "x") is None
    assert one(parsing.parsenum, "1,234.5") == 1234.5
    assert one(lambda c: parsing.parsenum(c, ",", "."), "1.234,5") == 1234.5
    assert one(parsing.parsepercent, "42%") == 0.42 and one(parsing.parsecurrency, "$1,234.50") == 1234.5
    assert one(parsing.parselogical, "T") is True and one(parsing.parselogical, "maybe") is None
    assert one(lambda c: parsing.parsedate(c, ["%Y-%m-%d", "%d/%m/%Y"]), "16/04/2023") == dt.date(2023, 4, 16)
    with pytest.raises(PySparkException, match="Parse failure"):
        one(lambda c: parsing.parsenum(c, strict=True), "x")
    df = spark.createDataFrame([(1, "1"), (2, "x"), (3, None)], "k int, v string")
    assert [tuple(r) for r in parsing.parsefailures(df, "v", parsing.parsenum, order="k").collect()] == [(2, "x")]


def test_dates(one):
    day = dt.date
    assert one(lambda c: dates.floordate(c, "week"), day(2024, 3, 15)) == day(2024, 3, 11)
    assert one(lambda c: dates.ceilingdate(c, "month"), day(2024, 3, 1)) == day(2024, 4, 1)
    assert one(lambda c: dates.rounddate(c, "month"), day(2024, 3, 17)) == day(2024, 4, 1)
    assert one(lambda c: dates.addmonths(c, 1), day(2024, 1, 31)) == day(2024, 2, 29)
    assert one(lambda c: dates.addmonths(c, 1, "next"), day(2024, 1, 31)) == day(2024, 3, 2)
    assert one(lambda c: dates.addmonths(c, 1, "missing"), day(2024, 1, 31)) is None
    with pytest.raises(PySparkException, match="Invalid date"):
        one(lambda c: dates.addmonths(c, 1, "error"), day(2024, 1, 31))
    assert one(dates.week, day(2024, 3, 15)) == 10 and one(dates.weekday, day(2024, 3, 15)) == "Friday"
    assert one(lambda a, b: dates.datediff(a, b, "hours"), day(2024, 1, 2), day(2024, 1, 1)) == 24.0


def test_dateseq(spark):
    assert [r[0].day for r in dates.dateseq(spark, "2024-01-01", "2024-01-10", "3 days").collect()] == [1, 4, 7, 10]
    assert [r[0].day for r in dates.dateseq(spark, "2024-01-01", "2024-01-09", length_out=3).collect()] == [1, 5, 9]


def test_row_functions(spark):
    df = spark.createDataFrame([(1, 2, 3), (None, 2, 1), (3, None, 1)], "a int, b int, c int")
    run = lambda c: [r[0] for r in df.select(c).collect()]
    assert run(rowwise.rowmin(df)) == [1, None, None] and run(rowwise.rowmin(df, na_rm=True)) == [1, 1, 1]
    assert run(rowwise.rowmax(df, na_rm=True)) == [3, 2, 3]
    assert run(rowwise.rowcount(df, value=1, na_rm=True)) == [1, 1, 1] and run(rowwise.rowcount(df, value=1)) == [1, None, None]
    assert run(rowwise.rowfirst(df, na_rm=True)) == [1, 2, 3] and run(rowwise.rowlast(df)) == [3, 1, 1]
    flags = spark.createDataFrame([(True, False), (False, False), (None, None), (True, None), (None, True)], "x boolean, y boolean")
    assert [r[0] for r in flags.select(rowwise.rowany(flags)).collect()] == [True, False, None, True, True]
    assert [r[0] for r in flags.select(rowwise.rowall(flags)).collect()] == [False, False, None, None, None]


def test_windows(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, None, 3.0, 4.0, 5.0])], "k int, v double")
    run = lambda c: [r["x"] for r in df.select("k", c.alias("x")).orderBy("k").collect()]
    assert run(windows.rollmean("v", 3, order="k")) == [None, None, None, None, 4.0]
    assert run(windows.rollmean("v", 3, na_rm=True, order="k")) == [None, None, 2.0, 3.5, 4.0]
    assert run(windows.rollsum("v", 2, "left", partial=True, na_rm=True, order="k")) == [1.0, 3.0, 7.0, 9.0, 5.0]
    assert run(windows.rollprod("v", 2, order="k", fill=-1.0)) == [-1.0, None, None, 12.0, 20.0]
    assert run(windows.rollmedian("v", 4, "center", partial=True, na_rm=True, order="k")) == [2.0, 3.0, 4.0, 4.0, 4.5]
    assert run(windows.cummean("v", order="k")) == [1.0, None, None, None, None]
    ranks = spark.createDataFrame([(1, 30), (2, 10), (3, 20), (4, 10), (5, 30)], "k int, v int")
    assert [r[0] for r in ranks.select(windows.denserank("v").alias("x"), "k").orderBy("k").collect()] == [3, 1, 2, 1, 3]
    gaps = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "k int, v int")
    assert [r[0] for r in gaps.select(windows.percentrank("v").alias("x"), "k").orderBy("k").collect()] == [None, 0.5, 1.0]
    seen = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "k int, v string")
    assert [round(r[0], 4) for r in seen.select(windows.cumedist("v", order="k").alias("x"), "k").orderBy("k").collect()] == [1.0, 0.5, 0.6667]
    assert [r["cumedist"] for r in windows.running_distinct(seen, "v", order="k").orderBy("k").collect()][1] == 0.5


def test_numeric(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 6)] + [(None,)], "v double")
    run = lambda d: sorted((r["v"] for r in d.collect()), key=lambda x: (x is not None, x))
    assert run(numeric.rescale(df, "v")) == [None, 0.0, 0.25, 0.5, 0.75, 1.0]
    assert run(numeric.center(df, "v")) == [None, -2.0, -1.0, 0.0, 1.0, 2.0]
    assert run(numeric.winsorize(df, "v", (0.25, 0.75))) == [None, 2.0, 2.0, 3.0, 4.0, 4.0]
    assert run(numeric.quantilegroup(df, "v", 2, labels=False)) == [None, 1, 1, 1, 2, 2]
    with pytest.raises(ValueError):
        numeric.quantilegroup(df.withColumn("v", F.lit(1.0)), "v")


def test_lists(spark):
    assert listops.map([1, 2], lambda v: v + 1) == [2, 3]
    assert listops.traverse([[1, 2], [3, 4]], lambda a, b: a * b) == [3, 8]
    assert listops.foldr([1, 2, 3], lambda v, acc: v - acc) == 2
    assert listops.foldr([1, 2, 3], lambda v, acc: v + acc, 0, accumulate=True) == [6, 5, 3, 0]
    df = spark.createDataFrame([([1, 2, 3],)], "a array<int>")
    assert df.select(listops.foldr("a", lambda v, acc: v - acc, 0)).first()[0] == 2


def test_distributions():
    assert math.isclose(distributions.t_two_sided(2.228, 10), 0.05, abs_tol=1e-4)
    assert math.isclose(distributions.f_upper(4.10, 2, 10), 0.05, abs_tol=1e-3)
    assert math.isclose(distributions.chi2_upper(3.841, 1), 0.05, abs_tol=1e-4)
    assert math.isclose(distributions.chi2_upper(18.307, 10), 0.05, abs_tol=1e-4)
    assert distributions.welch([(5, 1.0, 1.0)]) is None
    assert math.isclose(distributions.welch([(10, 0.0, 1.0), (10, 0.0, 1.0), (10, 0.0, 1.0)]), 1.0, abs_tol=1e-9)
    assert distributions.chi_squared([[10, 10], [10, 10]]) > 0.99
