"""Summaries, checks, sources, streams and the driver contract."""

import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from lattica import sources, streaming
from lattica.operators import checks, eda
from lattica.plans import catalogue


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(1.0, "", "open"), (None, "y", "closed"), (3.0, None, None), (None, "z", "bogus")], "a double, b string, status string")


def test_missingness(frame):
    got = {r["column"]: r["missing"] for r in eda.missingness(frame.select("a", "b")).collect()}
    assert got == {"a": 2, "b": 2}
    rows = eda.missingness(frame.select("a", "b").withColumn("k", F.monotonically_increasing_id()), "row", "k").collect()
    assert [r["missing"] for r in rows] == [1, 1, 1, 1]


def test_describe(frame):
    got = {r["column"]: r for r in eda.describe(frame).collect()}
    assert got["a"]["mean"] == 2.0 and got["a"]["missing"] == 2 and got["a"]["distinct"] == 3
    assert got["status"]["top"] == "<NA> (1), bogus (1), closed (1)"


def test_summarytab(spark):
    df = spark.createDataFrame([("x", 1.0, "u"), ("x", 2.0, "v"), ("x", 3.0, "u"), ("y", 4.0, "v"), ("y", 5.0, None), ("y", 9.0, "v")], "g string, n double, c string")
    got = {(r["variable"], r["level"]): r.asDict() for r in eda.summarytab(df, by="g", p_value=True).collect()}
    assert got["n", ""]["x"] == "2.0 (1.0)" and got["n", ""]["Overall"].startswith("4.0")
    assert got["c", "v"]["y"] == "2 (100.0%)" and got["c", "Missing"]["y"] == "1"
    assert 0 < float(got["n", ""]["p_value"]) < 1


def test_checks(frame):
    assert checks.assertvalues(frame, "status", ["open", "closed", "bogus"]) is frame
    for call, message in (
        (lambda: checks.assertvalues(frame, "status", ["open"]), "Some values are not allowed."),
        (lambda: checks.assertrange(frame, "a", 0, 2), "Values out of range."),
        (lambda: checks.assertrows(frame, "a > 0"), "Some rows failed the assertion."),
        (lambda: checks.assertcomplete(frame), "Missing values found."),
        (lambda: checks.assertnames(frame, ["q"]), "Missing required names."),
        (lambda: checks.asserttype(frame, "a", "integer"), "Unexpected type."),
        (lambda: checks.assert_key(frame.unionAll(frame), "status"), "`by` does not identify unique rows."),
    ):
        with pytest.raises(AssertionError, match=message.rstrip(".")):
            call()
    assert checks.assertcomplete(frame.select("b").filter("b is not null")).count() == 3
    assert checks.outofrange(frame, "a", 2, 4).count() == 1


def test_equality(spark):
    x = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    y = spark.createDataFrame([(2, 2.0 + 1e-10), (1, 1.0)], "k int, v double")
    assert checks.equaldata(x, y, ignoreorder=True) and checks.equaldata(x, y, order="k")
    assert not checks.equalrows(x, y, "k") and checks.equalrows(x, x.orderBy(F.desc("k")), "k")
    assert not checks.equalrows(x, x.unionAll(x.limit(1)), "k")


def test_sources(spark, tmp_path):
    df = spark.range(10).withColumn("g", F.col("id") % 2)
    for form in sources.tables.FORMATS:
        sources.write_table(df, f"file://{tmp_path}/t.{form}", form)
        assert sources.read_table(spark, f"file://{tmp_path}", "t", form).count() == 10
    sources.write_table(df, f"file://{tmp_path}/parts", partition_by="g")
    plan = spark.read.parquet(f"file://{tmp_path}/parts").filter("g = 1")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(g" in plan


def test_streams(spark, tmp_path):
    rows = [(f"2024-01-01 00:00:{s:02d}", k) for s, k in ((1, "a"), (2, "b"), (12, "a"), (13, "a"))]
    df = spark.createDataFrame(rows, "t string, k string").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")
    for name, out in (("w", streaming.summarise_windows(stream, "t", "10 seconds", "1 second", "k", n="count(*)")), ("d", streaming.removeduplicates_within(stream, "k", "t", "1 hour"))):
        query = out.writeStream.format("memory").queryName(name).outputMode("append").start()
        query.processAllAvailable()
        query.stop()
    assert sorted(r["k"] for r in spark.table("d").collect()) == ["a", "b"]
    assert {(r["k"], r["n"]) for r in spark.table("w").collect()} <= {("a", 1), ("b", 1), ("a", 2)}


def test_every_query_has_rows_of_stable_schema():
    assert len(catalogue.QUERIES) > 250 and set(catalogue.ORACLES) <= set(catalogue.QUERIES)


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    code = "import sys; sys.modules['lattica.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'flagship' in q and 'pipeline' not in q and not any(n.startswith('op1') for n in q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])


def test_plans_push_filters_and_prune_columns(spark):
    df = catalogue.QUERIES["flagship"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThanOrEqual(l_quantity,25.0)]" in plan
    assert "l_comment" not in plan and "l_shipdate" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_one_namespace_holds_all_verbs(frame):
    import lattica.api as la

    for name in ("subset", "summarise", "merge", "rollingmerge", "tolong", "rollmean", "titlecase", "parsedate", "addmonths", "assertkey", "lump", "rowmin", "foldr", "describe", "unionrows", "winsorize"):
        assert callable(getattr(la, name))
    assert la.filter(frame, "a > 1").count() == 1
