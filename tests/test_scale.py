"""Plans and bounds: what must not gather all rows in one task, and what must not depend on size."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.core import exact_quantiles, with_row_id
from lattica.functions import text, windows
from lattica.operators import groups, joins, reshape, rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_as_of_join_without_equal_keys_equals_brute_force(spark):
    rng = random.Random(1)
    x = [(i, rng.choice([None, *range(400)])) for i in range(500)]
    y = [(t, rng.randrange(1000)) for t in rng.sample(range(400), 40)] + [(7, 5), (7, 900)]
    left, right = spark.createDataFrame(x, "id int, t int"), spark.createDataFrame(y, "t int, v int")
    last = {t: max(v for s, v in y if s == t) for t, _ in y}
    for direction in ("backward", "forward", "nearest"):
        got = {r["id"]: r["v"] for r in joins.rollingmerge(left, right, "t", direction).collect()}
        for i, t in x:
            fits = [s for s in last if t is not None and (s <= t if direction == "backward" else s >= t if direction == "forward" else True)]
            best = min(fits, key=lambda s: (abs(s - t), s), default=None)
            assert got[i] == last.get(best), (direction, t)
    sorts = [line for line in plan(joins.rollingmerge(left, right, "t")).split("\n") if "Exchange" in line and "SinglePartition" in line]
    assert len(sorts) <= 2  # a row for each range


def test_interval_joins_equal_brute_force_with_long_intervals(spark):
    rng = random.Random(2)
    x = [(i, rng.choice(["a", None]), s, s + rng.choice([0.0, 1.5, 3.0, 5000.0, -1.0])) for i in range(150) for s in [rng.uniform(0, 300)]]
    y = [(i, rng.choice(["a", None]), s, s + rng.choice([0.0, 2.0, 900.0])) for i in range(150) for s in [rng.uniform(-50, 300)]] + [(999, None, None, 3.0)]
    left, right = spark.createDataFrame(x, "i int, k string, s double, e double"), spark.createDataFrame(y, "j int, k string, p double, q double")
    got = sorted((r["i"], -1 if r["j"] is None else r["j"]) for r in joins.overlapmerge(left, right, "s", "e", "p", "q", "k").collect())
    pairs = [(i, j) for i, k, s, e in x for j, m, p, q in y if k == m and p is not None and s <= e and s <= q and e >= p]
    alone = [(i, -1) for i, *_ in x if i not in {i for i, _ in pairs}]
    assert got == sorted(pairs + alone)
    inside = sorted((r["i"], -1 if r["j"] is None else r["j"]) for r in joins.rangemerge(left, right, "k", "s", "e", "p").collect())
    pairs = [(i, j) for i, k, s, e in x for j, m, p, q in y if k == m and p is not None and s <= p <= e]
    assert inside == sorted(pairs + [(i, -1) for i, *_ in x if i not in {i for i, _ in pairs}])


def test_windows_hand_missing_values_to_the_function(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "k int, v double")
    got = df.select("k", windows.rollapply("v", 2, F.size, order="k").alias("n")).orderBy("k").collect()
    assert [r["n"] for r in got] == [None, 2, 2]


@pytest.mark.parametrize("values", ["spread", "ties", "two"])
def test_quantiles_of_many_values(spark, values):
    rng = np.random.default_rng(1)
    v = {"spread": rng.normal(size=20_000), "ties": rng.integers(0, 5, 20_000).astype(float), "two": np.repeat([1.0, 2.0], 10_000)}[values]
    df = spark.createDataFrame([(float(a),) for a in v] + [(None,)] * 5, "v double").repartition(4)
    probs = [0.0, 0.013, 0.25, 0.5, 0.99, 1.0]
    assert exact_quantiles(df, "v", probs, few=300) == pytest.approx(np.quantile(v, probs).tolist())
    assert exact_quantiles(df.limit(0), "v", probs) is None


def test_samples_have_their_size_and_no_repeats(spark):
    df = spark.range(10_000).withColumn("_draw", F.lit("x")).repartition(5)
    for n in (0, 1, 777, 9_999, 10_000):
        got = rows.samplerows(df, n, seed=n)
        assert got.columns == ["id", "_draw"] and got.count() == n == got.select("id").distinct().count()
    assert rows.samplefrac(df, 0.1234).count() == 1234
    mean = statistics.mean(r["id"] for r in rows.samplerows(df, 2000, seed=3).collect())
    assert 4700 < mean < 5300
    with pytest.raises(ValueError, match="larger"):
        rows.samplerows(df, 10_001)


def test_row_numbers_spread_ties(spark):
    df = spark.range(5000).select(F.lit(1).alias("same"), F.col("id").alias("v"))
    got = with_row_id(df, "same", buckets=16)
    assert sorted(r["row_id"] for r in got.collect()) == list(range(1, 5001))
    assert {r["v"]: r["row_id"] for r in got.collect()} == {r["v"]: r["row_id"] for r in with_row_id(df.repartition(7), "same", buckets=16).collect()}


def test_shares_need_no_window_over_all_rows(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    got = groups.propcount(df, "k")
    assert {r["k"]: (r["n"], r["prop"]) for r in got.collect()} == {"a": (2, 0.5), "b": (1, 0.25), None: (1, 0.25)} and "Window" not in plan(got)


def test_letters_become_ascii(spark):
    df = spark.createDataFrame([("čłőāẞßŒÆøđĐı ǅ Ḁ ế é日",)], "x string")
    assert df.select(text.transliterate("x").alias("v")).first()["v"] == "cloaSSssOEAEodDi ǅ A e e日"


def test_full_sorts(spark):
    rng = random.Random(5)
    data = [(rng.choice([None, 1, 2, 3]), rng.random()) for _ in range(500)]
    df = spark.createDataFrame(data, "a int, b double").repartition(6)
    got = [(r["a"], r["b"]) for r in rows.reorder(df, ["a", "b"], [False, True]).collect()]
    assert got == sorted(data, key=lambda r: (r[0] is None, r[0] or 0, -r[1]))


@pytest.fixture
def cut_joins(monkeypatch):
    """Joins of few rows take the way of many, and groups of over 5,000 pairs are cut."""
    monkeypatch.setattr(joins, "_FEW_PAIRS", 0, raising=False)
    monkeypatch.setattr(joins, "_TASK_PAIRS", 5000, raising=False)


def test_interval_joins_of_many_pairs_equal_brute_force(spark, cut_joins):
    test_interval_joins_equal_brute_force_with_long_intervals(spark)


@pytest.mark.parametrize("by", [["k", "a>=b"], ["a<b", "k==m"], ["k", "lo<=b", "a>=b"], ["s<=t", "a>b"]])
def test_inequality_joins_equal_brute_force(spark, cut_joins, by):
    rng = random.Random(len(by[0]))
    x = [(i, rng.choice(["p", None]), rng.choice([None, float("nan"), *map(float, range(40))]), rng.choice("abc"), rng.uniform(0, 40)) for i in range(700)]
    y = [(i, rng.choice(["p", None, "q"]), rng.choice([None, *range(40)]), rng.choice("abc"), rng.uniform(0, 60)) for i in range(900)]
    left = spark.createDataFrame(x, "i int, k string, a double, s string, lo double").coalesce(1)
    right = spark.createDataFrame(y, "j int, k string, b int, t string, c double").withColumn("m", F.col("k"))
    out = joins.nonequimerge(left, right, by)
    same = lambda u, v: u.eqNullSafe(v)
    r = right.withColumnsRenamed({"k": "k2"})
    conditions = [same(F.col("k"), F.col("k2")) if c == "k" else same(F.col("k"), F.col("m")) if "==" in c else F.expr(c) for c in by]
    want = left.crossJoin(r)
    for c in conditions:
        want = want.filter(c)
    assert sorted(map(tuple, out.select("i", "j").collect())) == sorted(map(tuple, want.select("i", "j").collect()))


def test_pairs_are_made_by_more_tasks_than_read_the_left_side(spark, cut_joins):
    x = spark.range(3000).select(F.lit(1).alias("k"), (F.col("id") % 97).cast("double").alias("a"), (F.col("id") % 97 + 2.0).alias("e"), "id").coalesce(1)
    y = spark.range(500).select(F.lit(1).alias("k"), (F.col("id") % 89).cast("double").alias("b"), F.col("id").alias("j")).coalesce(1)
    for out in (joins.nonequimerge(x, y, ["k", "a>=b"]), joins.rangemerge(x, y, "k", "a", "e", "b"), joins.overlapmerge(x, y, "a", "e", "b", "b")):
        tasks = out.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()
        assert len(tasks) > 8 and max(r["n"] for r in tasks) < sum(r["n"] for r in tasks) / 4, sorted(r["n"] for r in tasks)


def test_average_ranks_equal_the_window_and_need_no_task_for_a_group(spark):
    rng = random.Random(7)
    data = [(i, rng.choice(["a", "b", None]), rng.choice([None, float("nan"), -0.0, *map(float, range(30))])) for i in range(900)]
    df = spark.createDataFrame(data, "i int, k string, v double")
    got = windows.averaged_rank(df, "v", "k", ranges=8)
    want = df.select("i", windows.percentrank("v", "k").alias("w"))
    both = got.join(want, "i").collect()
    assert len(both) == 900 and all(r["percentrank"] == pytest.approx(r["w"]) if r["w"] is not None else r["percentrank"] is None for r in both)
    alone = windows.averaged_rank(df, "v").join(df.select("i", windows.percentrank("v").alias("w")), "i").filter("not percentrank <=> w").count()
    assert alone == 0 and "rank(" not in plan(got)


def test_wide_form_of_many_rows_is_dealt_by_key(spark):
    df = spark.range(1_200_000).select((F.col("id") / 4).cast("long").alias("k"), (F.col("id") % 4).alias("t"), F.col("id").alias("v")).coalesce(1)
    wide = reshape.towide(df, "t", "v", "k", "first")
    assert "REPARTITION_BY_NUM" in plan(wide)
    sums = wide.agg(F.count(F.lit(1)), *(F.sum(str(i)) for i in range(4))).first()
    assert list(sums) == [300_000, *(sum(range(i, 1_200_000, 4)) for i in range(4))]


def test_short_intervals_do_not_meet_in_the_bins_of_long_ones(spark):
    x = spark.range(2000).select(F.col("id").cast("double").alias("s"), F.when(F.col("id") % 500 == 0, F.col("id") + 1500.0).otherwise(F.col("id") + 1.0).alias("e"))
    y = spark.range(2000).select(F.col("id").cast("double").alias("p"))
    left, right, on, *_ = joins._in_bins(x, y, [], ("s", "e", "p", "p"), None)
    met = left.join(right, joins.all_of(F.col(a) == F.col(b) for a, b in on)).count()
    matches = joins.overlapmerge(x, y, "s", "e", "p", "p").count()
    assert met < 6 * matches
