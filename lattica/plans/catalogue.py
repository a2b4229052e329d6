"""The registered queries of the table operators, with the SQL that gives the same rows.

Each query reads whole tables. Where the driver's tables lack what an operator is about (missing values, ties, text to
parse), both sides make it in the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.core import dealt_by, with_row_id
from lattica.functions import dates, listops, numeric, parsing, recode, rowwise, text, windows
from lattica.operators import checks, eda, groups, joins, reshape, rows, sets, verbs
from lattica.sources import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables below a folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of ``Tables`` under its name, with its SQL."""

    def register(build: Callable[[Tables], DataFrame]):
        key = name or build.__name__.rstrip("_")
        QUERIES[key] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql:
            ORACLES[key] = sql
        return build

    return register


def add(name: str, build: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    query(sql, name)(build)


def small(t: Tables, rows_: list, schema: str) -> DataFrame:
    return t.spark.createDataFrame(rows_, schema)


# --- flagship -------------------------------------------------------------------------------------------------------


@query("""SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice * (1 - l_discount)), 4) AS rev
          FROM lineitem WHERE l_quantity >= 25 GROUP BY ALL""")
def flagship(t):
    kept = verbs.subset(t.lineitem, "l_quantity >= 25", ["l_returnflag", "l_linestatus", "l_extendedprice", "l_discount"])
    rev = verbs.transform(kept, rev="l_extendedprice * (1 - l_discount)")
    mean = groups.aggregate(rev, ["l_returnflag", "l_linestatus"], "rev", "mean")
    return verbs.transform(mean, rev="round(rev, 4)")


# --- projection, filters, columns -----------------------------------------------------------------------------------

add("subset", lambda t: verbs.subset(t.lineitem, "l_quantity > 45 and l_discount > 0.05", ["l_orderkey", "l_linenumber", "l_quantity"]), "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount > 0.05")
add("filter", lambda t: verbs.filter(t.orders, "o_totalprice > 200000", F.col("o_orderstatus") == "F"), "SELECT * FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F'")
add("filter_null", lambda t: verbs.filter(t.lineitem.select("l_orderkey", F.nullif("l_linenumber", F.lit(3)).alias("n")), "n > 2"), "SELECT l_orderkey, nullif(l_linenumber, 3) AS n FROM lineitem WHERE nullif(l_linenumber, 3) > 2")
add("pick", lambda t: verbs.pick(t.customer, ["c_name", "c_custkey"]), "SELECT c_name, c_custkey FROM customer")
add("select", lambda t: verbs.select(t.supplier, "s_name"), "SELECT s_name FROM supplier")
add("drop", lambda t: verbs.drop(t.part, ["p_type", "p_brand"]), "SELECT * EXCLUDE (p_type, p_brand) FROM part")
add("transform", lambda t: verbs.transform(t.lineitem, l_tax="l_tax + 1", gross="l_extendedprice * l_tax", l_discount=None), "SELECT * EXCLUDE (l_discount, l_tax), l_tax + 1 AS l_tax, l_extendedprice * (l_tax + 1) AS gross FROM lineitem")
add("mutate", lambda t: verbs.mutate(t.part, double_size=F.col("p_size") * 2), "SELECT *, p_size * 2 AS double_size FROM part")
add("transmute", lambda t: verbs.transmute(t.part, big="p_size > 25", bigger="not big"), "SELECT p_size > 25 AS big, NOT p_size > 25 AS bigger FROM part")


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size + 1 AS p_size, (p_size + 1) * 2 AS twice FROM part")
def within(t):
    def block(s):
        s.p_size = s.p_size + 1
        s.twice = s.p_size * 2
        del s.p_retailprice

    return verbs.within(t.part, block)


add("rename", lambda t: verbs.rename(t.region, key="r_regionkey", label="r_name"), 'SELECT r_regionkey AS "key", r_name AS label FROM region')
add("renamewith", lambda t: verbs.renamewith(t.region, ["r_name"], str.upper), "SELECT r_regionkey, r_name AS R_NAME FROM region")
add("relocate", lambda t: verbs.relocate(t.nation, "n_regionkey", before="n_name"), "SELECT n_nationkey, n_regionkey, n_name FROM nation")
add("move", lambda t: verbs.move(t.nation, "n_nationkey", after=2), "SELECT n_name, n_regionkey, n_nationkey FROM nation")
add("firstcols", lambda t: verbs.firstcols(t.nation, "n_name"), "SELECT n_name, n_nationkey, n_regionkey FROM nation")
add("lastcols", lambda t: verbs.lastcols(t.nation, "n_nationkey"), "SELECT n_name, n_regionkey, n_nationkey FROM nation")
add("cleannames", lambda t: verbs.cleannames(t.region.toDF(" Region  Key!", "R.name")), "SELECT r_regionkey AS region_key, r_name AS r_name FROM region")
add("repairnames", lambda t: verbs.repairnames(t.region.toDF("2 keys", "2-keys"), "universal"), "SELECT r_regionkey AS X2_keys, r_name AS X2_keys_1 FROM region")
add("applycols", lambda t: verbs.applycols(t.nation, "n_name", F.lower), "SELECT n_nationkey, lower(n_name) AS n_name, n_regionkey FROM nation")
add("convertcols", lambda t: verbs.convertcols(t.nation.withColumn("n_name", F.concat(F.col("n_nationkey").cast("string"), F.when(F.col("n_regionkey") == 1, "x").otherwise(""))), "n_name", "int"), "SELECT n_nationkey, TRY_CAST(n_nationkey || CASE WHEN n_regionkey = 1 THEN 'x' ELSE '' END AS INTEGER) AS n_name, n_regionkey FROM nation")
add("replacecols", lambda t: verbs.replacecols(t.nation, ["n_name", "n_regionkey"], ["same", F.col("n_regionkey") + 10]), "SELECT n_nationkey, 'same' AS n_name, n_regionkey + 10 AS n_regionkey FROM nation")
add("replacewhere", lambda t: verbs.replacewhere(t.orders, "nullif(o_orderstatus, 'P') = 'F'", "o_totalprice", 0.0), "SELECT * REPLACE (CASE WHEN o_orderstatus = 'F' THEN 0.0 ELSE o_totalprice END AS o_totalprice) FROM orders")
add("unite", lambda t: verbs.unite(t.nation.withColumn("n_name", F.nullif("n_name", F.lit("CHINA"))), "both", ["n_name", "n_regionkey"], "-"), "SELECT n_nationkey, coalesce(nullif(n_name, 'CHINA'), 'NA') || '-' || n_regionkey AS both FROM nation")
add("unite_na_rm", lambda t: verbs.unite(t.nation.withColumn("n_name", F.nullif("n_name", F.lit("CHINA"))), "both", ["n_name", "n_regionkey"], "-", remove=False, na_rm=True), "SELECT n_nationkey, nullif(n_name, 'CHINA') AS n_name, n_regionkey, concat_ws('-', nullif(n_name, 'CHINA'), n_regionkey) AS both FROM nation")
add("separate", lambda t: verbs.separate(t.part, "p_type", ["a", "b", "c", "d"], " "), "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice, split_part(p_type, ' ', 1) AS a, CASE WHEN len(string_split(p_type, ' ')) >= 2 THEN split_part(p_type, ' ', 2) END AS b, CASE WHEN len(string_split(p_type, ' ')) >= 3 THEN split_part(p_type, ' ', 3) END AS c, CASE WHEN len(string_split(p_type, ' ')) >= 4 THEN split_part(p_type, ' ', 4) END AS d FROM part")
add("bind_cols", lambda t: verbs.bind_cols(t.nation.select("n_nationkey", "n_name"), t.nation.select(F.col("n_nationkey").alias("k"), "n_regionkey"), order=["n_nationkey", "k"]), "SELECT n_nationkey, n_name, n_nationkey AS k, n_regionkey FROM nation")
add("missingindicator", lambda t: verbs.missingindicator(t.nation.select("n_nationkey", F.when(F.col("n_regionkey") == 1, " ").otherwise(F.nullif("n_name", F.lit("CHINA"))).alias("n_name"))), "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN ' ' ELSE nullif(n_name, 'CHINA') END AS n_name, FALSE AS missing_n_nationkey, n_regionkey = 1 OR n_name = 'CHINA' AS missing_n_name FROM nation")

# --- rows -----------------------------------------------------------------------------------------------------------

EVENT_ORDER = ["ts", "event_id"]
HOLED = "CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END"


def holed(t: Tables) -> DataFrame:
    """Events in which every third value is missing."""
    return t.events.select("event_id", "user_id", "ts", F.expr(HOLED).alias("value"))


HOLED_SQL = f"(SELECT event_id, user_id, ts, {HOLED} AS value FROM events)"

add("reorder", lambda t: rows.reorder(t.customer, ["c_nationkey", "c_acctbal"], [False, True]), "SELECT * FROM customer ORDER BY c_nationkey, c_acctbal DESC")
add("arrange", lambda t: rows.arrange(t.customer.withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("MACHINERY"))), ["c_mktsegment", "c_custkey"], True), "SELECT * REPLACE (nullif(c_mktsegment, 'MACHINERY') AS c_mktsegment) FROM customer ORDER BY nullif(c_mktsegment, 'MACHINERY') DESC NULLS LAST, c_custkey DESC")
add("orderrows", lambda t: rows.orderrows(t.nation.withColumn("n_regionkey", F.nullif("n_regionkey", F.lit(2))), "n_regionkey", na_last=None), "SELECT n_nationkey, n_name, nullif(n_regionkey, 2) AS n_regionkey FROM nation WHERE n_regionkey <> 2")
add("slice", lambda t: rows.slice(t.nation, [3, 1, 1, 25], "n_nationkey"), "SELECT n.* FROM (VALUES (2), (0), (0), (24)) v(k) JOIN nation n ON n.n_nationkey = v.k")
add("slice_exclude", lambda t: rows.slice(t.nation, [-1, -2], "n_nationkey"), "SELECT * FROM nation WHERE n_nationkey >= 2")
add("firstrows", lambda t: rows.firstrows(t.orders, 7, order=["o_orderdate", "o_orderkey"]), "SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 7")
add("lastrows", lambda t: rows.lastrows(t.orders, 7, order=["o_orderdate", "o_orderkey"]), "SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 7")
add("headtail", lambda t: rows.headtail(t.orders, 3, order="o_orderkey"), "(SELECT * FROM orders ORDER BY o_orderkey LIMIT 3) UNION ALL (SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 3)")
add("reverse", lambda t: rows.reverse(t.nation, "n_nationkey"), "SELECT * FROM nation ORDER BY n_nationkey DESC")


def drawn(sample: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """What holds of any sample: its size, its distinct keys, and how many of its rows the table has."""
    return sample.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("keys")).crossJoin(sample.join(table, table.columns, "left_semi").agg(F.count(F.lit(1)).alias("members")))


add("samplerows", lambda t: drawn(rows.samplerows(t.orders, 1000, seed=1), t.orders, "o_orderkey"), "SELECT CAST(1000 AS BIGINT) AS n, CAST(1000 AS BIGINT) AS keys, CAST(1000 AS BIGINT) AS members")
add("samplefrac", lambda t: drawn(rows.samplefrac(t.orders, 0.3, seed=1), t.orders, "o_orderkey"), "SELECT n, n AS keys, n AS members FROM (SELECT CAST(ceil(count(*) * 0.3) AS BIGINT) AS n FROM orders)")
add("firstby", lambda t: rows.firstby(t.events, "user_id", EVENT_ORDER), "SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
add("lastby", lambda t: rows.lastby(t.events, "user_id", EVENT_ORDER), "SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
add("distinct", lambda t: rows.distinct(t.lineitem, ["l_returnflag", "l_linestatus"]), "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
add("distinct_keep_all", lambda t: rows.distinct(t.orders, "o_custkey", True, ["o_orderdate", "o_orderkey"]), "SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
add("removeduplicates_first", lambda t: rows.removeduplicates(t.orders, "o_custkey", "first", "o_orderkey"), "SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
add("removeduplicates_last", lambda t: rows.removeduplicates(t.orders, "o_custkey", "last", "o_orderkey"), "SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
add("removeduplicates_none", lambda t: rows.removeduplicates(t.orders.select("o_custkey", "o_orderkey", "o_orderpriority"), ["o_custkey", "o_orderpriority"], "none"), "SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey, o_orderpriority) = 1")
add("duplicaterows", lambda t: rows.duplicaterows(t.documents.select("text", "lang")), "SELECT text, lang FROM documents QUALIFY count(*) OVER (PARTITION BY text, lang) > 1")

BLANKS = "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN ' ' WHEN n_regionkey = 2 THEN NULL ELSE n_name END AS a, CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE n_regionkey END AS b FROM nation"


def blanks(t: Tables) -> DataFrame:
    return t.nation.selectExpr("n_nationkey", "CASE WHEN n_regionkey = 1 THEN ' ' WHEN n_regionkey = 2 THEN NULL ELSE n_name END AS a", "CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE n_regionkey END AS b")


A, B = "(a IS NULL OR trim(a) = '')", "b IS NULL"
add("emptyrows", lambda t: rows.emptyrows(blanks(t).select("a", "b")), f"SELECT a, b FROM ({BLANKS}) WHERE {A} AND {B}")
add("missingrows", lambda t: rows.missingrows(blanks(t)), f"SELECT * FROM ({BLANKS}) WHERE {A} OR {B}")
add("keepmissing", lambda t: rows.keepmissing(blanks(t), ["a", "b"], "all"), f"SELECT * FROM ({BLANKS}) WHERE {A} AND {B}")
add("omitmissing", lambda t: rows.omitmissing(blanks(t)), f"SELECT * FROM ({BLANKS}) WHERE NOT ({A} OR {B})")
add("expandrows", lambda t: rows.expandrows(t.nation, "n_regionkey"), "SELECT n.* FROM nation n, range(1, 10) r(i) WHERE r.i <= n.n_regionkey")
add("completegrid", lambda t: rows.completegrid(t.orders.groupBy("o_orderstatus", "o_orderpriority").count().filter("count > 0 and o_orderstatus <> 'P'").unionByName(t.orders.groupBy("o_orderstatus", "o_orderpriority").count().filter("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'")), ["o_orderstatus", "o_orderpriority"], {"count": 0}), "WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL), k AS (SELECT * FROM c WHERE o_orderstatus <> 'P' OR o_orderpriority = '1-URGENT') SELECT a.o_orderstatus, b.o_orderpriority, coalesce(k.n, 0) AS count FROM (SELECT DISTINCT o_orderstatus FROM k) a CROSS JOIN (SELECT DISTINCT o_orderpriority FROM k) b LEFT JOIN k USING (o_orderstatus, o_orderpriority)")
DOWN = "last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
UP = "first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
add("filldown", lambda t: rows.filldown(holed(t), "value", "user_id", order=EVENT_ORDER), f"SELECT event_id, user_id, ts, {DOWN} AS value FROM {HOLED_SQL}")
add("fillup", lambda t: rows.fillup(holed(t), "value", "user_id", order=EVENT_ORDER), f"SELECT event_id, user_id, ts, {UP} AS value FROM {HOLED_SQL}")
add("fillboth", lambda t: rows.fillboth(holed(t), "value", "user_id", order=EVENT_ORDER), f"SELECT event_id, user_id, ts, coalesce({DOWN}, {UP}) AS value FROM {HOLED_SQL}")
add("with_row_id", lambda t: with_row_id(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]), "SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS row_id FROM orders")

# --- joins ----------------------------------------------------------------------------------------------------------


def cust(t: Tables) -> DataFrame:
    """All customers, with a key of orders and a name that orders have as well; a third of the keys have no order."""
    return t.customer.select(F.expr(UNLIKE_CUST).alias("o_custkey"), F.col("c_name").alias("o_orderstatus"), "c_nationkey")


UNLIKE_CUST, UNLIKE_ORDER = "CASE WHEN c_custkey % 3 = 0 THEN -1 - c_custkey ELSE c_custkey END", "CASE WHEN o_custkey % 5 = 0 THEN o_custkey + 1000000000 ELSE o_custkey END"
ORDER = f"SELECT o_orderkey, {UNLIKE_ORDER} AS o_custkey, o_orderstatus FROM orders"
CUST = f"SELECT {UNLIKE_CUST} AS c_custkey, c_name, c_nationkey FROM customer"


def ords(t: Tables) -> DataFrame:
    """All orders; a fifth of the keys have no customer."""
    return t.orders.select("o_orderkey", F.expr(UNLIKE_ORDER).alias("o_custkey"), "o_orderstatus")


for kind, flags in (("inner", {}), ("left", {"all_x": True}), ("right", {"all_y": True}), ("full", {"all": True})):
    add(f"merge_{kind}", lambda t, f=flags: joins.merge(ords(t), cust(t), "o_custkey", **f), f'SELECT coalesce(o.o_custkey, c.c_custkey) AS o_custkey, o.o_orderkey, o.o_orderstatus AS "o_orderstatus.x", c.c_name AS "o_orderstatus.y", c.c_nationkey FROM ({ORDER}) o {kind} JOIN ({CUST}) c ON o.o_custkey = c.c_custkey')
add("merge_nullkey", lambda t: joins.merge(t.nation.select(F.nullif("n_regionkey", F.lit(1)).alias("k"), "n_name"), t.region.select(F.nullif("r_regionkey", F.lit(1)).alias("k"), "r_name")), "SELECT nullif(n_regionkey, 1) AS k, n_name, r_name FROM nation JOIN region ON nullif(n_regionkey, 1) IS NOT DISTINCT FROM nullif(r_regionkey, 1)")
add("semimerge", lambda t: joins.semimerge(t.documents.select("doc_id", "lang"), t.labels, "doc_id"), "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
add("antimerge", lambda t: joins.antimerge(t.documents.select("doc_id", "lang"), t.labels, "doc_id"), "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
add("matchedkeys", lambda t: joins.matchedkeys(t.orders.select("o_custkey", "o_orderkey"), t.customer.filter("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey")), "o_custkey"), "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
add("unmatchedkeys", lambda t: joins.unmatchedkeys(t.orders.select("o_custkey", "o_orderkey"), t.customer.filter("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "o_orderkey"), "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5) GROUP BY o_custkey")
add("crossmerge", lambda t: joins.crossmerge(t.region, t.nation.select("n_name")), "SELECT r_regionkey, r_name, n_name FROM region CROSS JOIN nation")


def sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Events of one type, and the values of another."""
    kinds = ["click", "purchase"] if t.events.filter("event_type = 'purchase'").limit(1).count() else [r[0] for r in t.events.select("event_type").distinct().orderBy("event_type").limit(2).collect()]
    x = t.events.filter(F.col("event_type") == kinds[0]).select("user_id", "ts", "event_id")
    y = t.events.filter(F.col("event_type") == kinds[1]).select("user_id", "ts", "value")
    return x, y


def moments(t: Tables) -> DataFrame:
    """The largest value at each time of purchases, of whatever user."""
    return sides(t)[1].groupBy("ts").agg(F.max("value").alias("value"))


def asof_sql(op: str) -> str:
    return f"SELECT x.user_id, x.ts, x.event_id, y.value FROM (SELECT * FROM events WHERE event_type = 'click') x ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase') y ON x.user_id = y.user_id AND x.ts {op} y.ts"


NEAREST = """WITH x AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'click'), y AS (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase'),
    m AS (SELECT x.*, y.value, epoch_us(x.ts) - epoch_us(y.ts) AS gap FROM x LEFT JOIN y ON x.user_id = y.user_id)
    SELECT user_id, ts, event_id, {} AS value FROM m QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(gap), gap DESC) = 1"""
add("rollingmerge_backward", lambda t: joins.rollingmerge(*sides(t), ["user_id", "ts"]), asof_sql(">="))
add("rollingmerge_forward", lambda t: joins.rollingmerge(*sides(t), ["user_id", "ts"], "forward"), asof_sql("<="))
add("rollingmerge_tolerance", lambda t: joins.rollingmerge(*sides(t), ["user_id", "ts"], tolerance=86400), "SELECT x.user_id, x.ts, x.event_id, CASE WHEN epoch_us(x.ts) - epoch_us(y.ts) <= 86400000000 THEN y.value END AS value FROM (SELECT * FROM events WHERE event_type = 'click') x ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase') y ON x.user_id = y.user_id AND x.ts >= y.ts")
add("rollingmerge_nearest", lambda t: joins.rollingmerge(*sides(t), ["user_id", "ts"], "nearest"), NEAREST.format("value"))
for direction, op in (("backward", ">="), ("forward", "<=")):
    add(f"rollingmerge_nokey_{direction}", lambda t, d=direction: joins.rollingmerge(sides(t)[0].drop("user_id"), moments(t), "ts", d), f"SELECT x.ts, x.event_id, y.value FROM (SELECT * FROM events WHERE event_type = 'click') x ASOF LEFT JOIN (SELECT ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ts) y ON x.ts {op} y.ts")
add("nearestmerge", lambda t: joins.nearestmerge(*sides(t), ["user_id", "ts"], 86400), NEAREST.format("CASE WHEN abs(gap) <= 86400000000 THEN value END"))
add("nonequimerge", lambda t: joins.nonequimerge(t.customer.select(F.col("c_nationkey").alias("k"), "c_custkey", "c_acctbal"), t.supplier.select(F.col("s_nationkey").alias("k"), "s_suppkey", "s_acctbal"), ["k", "c_acctbal>=s_acctbal"]), "SELECT c_nationkey AS k, c_custkey, c_acctbal, s_suppkey, s_acctbal FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal >= s_acctbal")
add("rangemerge", lambda t: joins.rangemerge(t.customer.select(F.col("c_nationkey").alias("k"), "c_custkey", (F.col("c_acctbal") - 100).alias("lo"), (F.col("c_acctbal") + 100).alias("hi")), t.supplier.select(F.col("s_nationkey").alias("k"), "s_suppkey", "s_acctbal"), "k", "lo", "hi", "s_acctbal"), "SELECT c_nationkey AS k, c_custkey, c_acctbal - 100 AS lo, c_acctbal + 100 AS hi, s_suppkey, s_acctbal FROM customer LEFT JOIN supplier ON c_nationkey = s_nationkey AND s_acctbal BETWEEN c_acctbal - 100 AND c_acctbal + 100")
add("rangemerge_hotkey", lambda t: joins.rangemerge(t.customer.select(F.lit(1).alias("k"), "c_custkey", (F.col("c_acctbal") - 5).alias("lo"), F.expr("CASE WHEN c_custkey % 500 = 0 THEN c_acctbal + 5000 ELSE c_acctbal + 5 END").alias("hi")), t.supplier.select(F.lit(1).alias("k"), "s_suppkey", "s_acctbal"), "k", "lo", "hi", "s_acctbal"), "SELECT 1 AS k, c_custkey, c_acctbal - 5 AS lo, CASE WHEN c_custkey % 500 = 0 THEN c_acctbal + 5000 ELSE c_acctbal + 5 END AS hi, s_suppkey, s_acctbal FROM customer LEFT JOIN supplier ON s_acctbal BETWEEN c_acctbal - 5 AND CASE WHEN c_custkey % 500 = 0 THEN c_acctbal + 5000 ELSE c_acctbal + 5 END")
OVERLAP = "SELECT c_nationkey AS k, c_custkey, c_acctbal AS sx, c_acctbal + 50 AS ex, s_suppkey, s_acctbal AS sy, s_acctbal + 20 AS ey FROM customer LEFT JOIN supplier ON {}c_acctbal <= s_acctbal + 20 AND c_acctbal + 50 >= s_acctbal"


def spans(t: Tables) -> tuple[DataFrame, DataFrame]:
    return t.customer.select(F.col("c_nationkey").alias("k"), "c_custkey", F.col("c_acctbal").alias("sx"), (F.col("c_acctbal") + 50).alias("ex")), t.supplier.select(F.col("s_nationkey").alias("k"), "s_suppkey", F.col("s_acctbal").alias("sy"), (F.col("s_acctbal") + 20).alias("ey"))


add("overlapmerge", lambda t: joins.overlapmerge(*spans(t), "sx", "ex", "sy", "ey", "k"), OVERLAP.format("c_nationkey = s_nationkey AND "))
add("overlapmerge_nokey", lambda t: joins.overlapmerge(spans(t)[0].drop("k"), spans(t)[1].drop("k"), "sx", "ex", "sy", "ey"), OVERLAP.format("").replace("c_nationkey AS k, ", ""))
add("updatemerge", lambda t: joins.updatemerge(t.customer, t.customer.filter("c_custkey % 4 = 0").select("c_custkey", F.lit(None).cast("string").alias("c_name"), (F.col("c_acctbal") * 2).alias("c_acctbal")), "c_custkey"), "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name END AS c_name, c_nationkey, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
add("joinrelationship", lambda t: small(t, [(joins.joinrelationship(t.orders.withColumnRenamed("o_custkey", "c_custkey"), t.customer, "c_custkey"),)], "relationship string"), "SELECT 'many-to-one' AS relationship")
add("common_names", lambda t: small(t, [(c,) for c in joins.common_names(t.documents, t.labels)], "name string"), "SELECT 'doc_id' AS name")
add("commonnames", lambda t: small(t, [(c,) for c in joins.commonnames(t.documents, t.labels)], "name string"), "SELECT 'doc_id' AS name")

# --- groups ---------------------------------------------------------------------------------------------------------

add("aggregate_mean", lambda t: verbs.applycols(groups.aggregate(t.lineitem, "l_returnflag", ["l_quantity", "l_discount"], "mean"), ["l_quantity", "l_discount"], lambda c: F.round(c, 6)), "SELECT l_returnflag, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_discount), 6) AS l_discount FROM lineitem GROUP BY ALL")
add("aggregate_poison", lambda t: groups.aggregate(t.orders.select("o_custkey", F.expr("CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderkey END").alias("v")), "o_custkey", "v", "max"), "SELECT o_custkey, CASE WHEN count(*) = count(v) THEN max(v) END AS v FROM (SELECT o_custkey, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderkey END AS v FROM orders) GROUP BY o_custkey")
add("aggregate_na_rm", lambda t: groups.aggregate(t.orders.select("o_custkey", F.expr("CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderkey END").alias("v")), "o_custkey", "v", "sum", na_rm=True), "SELECT o_custkey, CAST(coalesce(sum(v), 0) AS BIGINT) AS v FROM (SELECT o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderkey END AS v FROM orders) GROUP BY o_custkey")
add("aggregate_median", lambda t: groups.aggregate(t.lineitem, ["l_returnflag", "l_linestatus"], "l_quantity", "median"), "SELECT l_returnflag, l_linestatus, median(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL")
add("count", lambda t: groups.count(t.orders, ["o_orderstatus", "o_orderpriority"]), "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
add("summarise", lambda t: groups.summarise(t.orders, "o_orderstatus", n="count(*)", top=F.max("o_totalprice"), customers="count(distinct o_custkey)"), "SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY ALL")
add("summarize", lambda t: groups.summarize(t.part, n="count(*)", least="min(p_size)"), "SELECT count(*) AS n, min(p_size) AS least FROM part")
add("summaries", lambda t: groups.summaries(t.customer, "c_mktsegment", poorest="min(c_acctbal)"), "SELECT c_mktsegment, min(c_acctbal) AS poorest FROM customer GROUP BY ALL")
add("propcount", lambda t: groups.propcount(t.lineitem, ["l_returnflag", "l_linestatus"]), "SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) / sum(count(*)) OVER () AS prop FROM lineitem GROUP BY ALL")
add("propcount_margin", lambda t: groups.propcount(t.lineitem, ["l_returnflag", "l_linestatus"], "l_returnflag"), "SELECT *, n / sum(n) OVER (PARTITION BY l_returnflag) AS prop FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL)")
add("freq", lambda t: groups.freq(t.customer, "c_mktsegment"), "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY ALL")
add("freq_prop", lambda t: groups.freq(t.customer, "c_mktsegment", "c_nationkey", prop=True), "SELECT *, n / sum(n) OVER (PARTITION BY c_nationkey) AS prop FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL)")
add("duplicated_keys", lambda t: groups.duplicated_keys(t.orders, "o_custkey"), 'SELECT o_custkey, count(*) AS "N" FROM orders GROUP BY ALL HAVING count(*) > 1')
add("duplicatekeys", lambda t: groups.duplicatekeys(t.nation, "n_regionkey"), 'SELECT n_regionkey, count(*) AS "N" FROM nation GROUP BY ALL HAVING count(*) > 1')
add("split", lambda t: sets.bind_rows({k: v.agg(F.count(F.lit(1)).alias("n")) for k, v in groups.split(t.customer, "c_mktsegment").items()}, id="key"), 'SELECT c_mktsegment AS "key", count(*) AS n FROM customer GROUP BY ALL')
add("applyby", lambda t: groups.applyby(t.orders.select("o_orderpriority", "o_orderkey"), "o_orderpriority", lambda f: f.assign(o_orderkey=f["o_orderkey"].max()).head(1), "o_orderkey long", bind=True), 'SELECT o_orderpriority AS ".group", max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL')

# --- sets -----------------------------------------------------------------------------------------------------------


def low(t: Tables) -> DataFrame:
    return t.nation.filter("n_nationkey < 15")


def high(t: Tables) -> DataFrame:
    return t.nation.filter("n_nationkey >= 10").withColumn("n_name", F.when(F.col("n_nationkey") == 12, "OTHER").otherwise(F.col("n_name")))


LOW, HIGH = "(SELECT * FROM nation WHERE n_nationkey < 15)", "(SELECT * REPLACE (CASE WHEN n_nationkey = 12 THEN 'OTHER' ELSE n_name END AS n_name) FROM nation WHERE n_nationkey >= 10)"
add("bind_rows", lambda t: sets.bind_rows({"a": t.region, "b": t.nation.select(F.col("n_name").alias("r_name"), "n_nationkey")}, id="from"), "SELECT 'a' AS \"from\", r_regionkey, r_name, NULL::INTEGER AS n_nationkey FROM region UNION ALL SELECT 'b', NULL, n_name, n_nationkey FROM nation")
add("rbindfill", lambda t: sets.rbindfill(t.region, t.nation.select(F.col("n_name").alias("r_regionkey")), typeconflict="coerce"), "SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name FROM region UNION ALL SELECT n_name, NULL FROM nation")
add("unionrows", lambda t: sets.unionrows(low(t), high(t)), f"SELECT * FROM {LOW} UNION SELECT * FROM {HIGH}")
add("unionrows_by", lambda t: sets.unionrows(low(t), high(t), "n_nationkey"), f"SELECT * FROM {LOW} UNION ALL SELECT * FROM {HIGH} WHERE n_nationkey >= 15")
add("intersectrows", lambda t: sets.intersectrows(low(t), high(t)), f"SELECT * FROM {LOW} INTERSECT SELECT * FROM {HIGH}")
add("intersectrows_by", lambda t: sets.intersectrows(low(t), high(t), "n_nationkey"), f"SELECT * FROM {LOW} WHERE n_nationkey >= 10")
add("diffrows", lambda t: sets.diffrows(low(t), high(t)), f"SELECT * FROM {LOW} EXCEPT SELECT * FROM {HIGH}")
add("diffrows_by", lambda t: sets.diffrows(low(t), high(t), "n_nationkey"), f"SELECT * FROM {LOW} WHERE n_nationkey < 10")
add("addedrows", lambda t: sets.addedrows(low(t), high(t), "n_nationkey"), f"SELECT * FROM {HIGH} WHERE n_nationkey >= 15")
add("removedrows", lambda t: sets.removedrows(low(t), high(t), "n_nationkey"), f"SELECT * FROM {LOW} WHERE n_nationkey < 10")
add("changedrows", lambda t: sets.changedrows(low(t), high(t), "n_nationkey"), f'SELECT a.n_nationkey, a.n_name AS "n_name.old", a.n_regionkey AS "n_regionkey.old", b.n_name AS "n_name.new", b.n_regionkey AS "n_regionkey.new" FROM {LOW} a JOIN {HIGH} b USING (n_nationkey) WHERE a.n_name <> b.n_name')

# --- reshape --------------------------------------------------------------------------------------------------------

add("tolong", lambda t: reshape.tolong(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"), ["l_quantity", "l_tax"]), "SELECT l_orderkey, l_linenumber, 'l_quantity' AS variable, l_quantity AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem")
add("towide", lambda t: reshape.towide(t.orders, "o_orderstatus", "o_orderkey", "o_orderpriority"), "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY ALL")
add("towide_max", lambda t: reshape.towide(t.orders, "o_orderstatus", "o_orderkey", "o_custkey", "max", -1), "SELECT o_custkey, coalesce(max(o_orderkey) FILTER (o_orderstatus = 'F'), -1) AS F, coalesce(max(o_orderkey) FILTER (o_orderstatus = 'O'), -1) AS O, coalesce(max(o_orderkey) FILTER (o_orderstatus = 'P'), -1) AS P FROM orders GROUP BY ALL")
add("reshape_long", lambda t: reshape.reshape(t.customer.select("c_custkey", "c_nationkey", "c_acctbal"), "long", idvar="c_custkey", timevar="time", v_names="v", varying=["c_nationkey", "c_acctbal"]), "SELECT c_custkey, 1 AS time, CAST(c_nationkey AS DOUBLE) AS v FROM customer UNION ALL SELECT c_custkey, 2, c_acctbal FROM customer")
add("reshape_wide", lambda t: reshape.reshape(dealt_by(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey"], t.lineitem.count()).groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q")), "wide", idvar="l_orderkey", timevar="l_linenumber", v_names="q"), "SELECT l_orderkey, " + ", ".join(f'max(l_quantity) FILTER (l_linenumber = {i}) AS "q.{i}"' for i in range(1, 8)) + " FROM lineitem GROUP BY ALL")
add("stack", lambda t: reshape.stack(t.part, ["p_size", "p_retailprice"]), "SELECT CAST(p_size AS DOUBLE) AS values, 'p_size' AS ind FROM part UNION ALL SELECT p_retailprice, 'p_retailprice' FROM part")
add("unstack", lambda t: reshape.unstack(t.nation, "n_name", "n_regionkey", order="n_nationkey"), "SELECT " + ", ".join(f'max(n_name) FILTER (n_regionkey = {i}) AS "{i}"' for i in range(5)) + " FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation) GROUP BY k")
add("transpose", lambda t: reshape.transpose(t.region, order="r_regionkey"), 'SELECT max(CAST(r_regionkey AS VARCHAR)) FILTER (r_regionkey = 0) AS "V1", max(CAST(r_regionkey AS VARCHAR)) FILTER (r_regionkey = 1) AS "V2", max(CAST(r_regionkey AS VARCHAR)) FILTER (r_regionkey = 2) AS "V3", max(CAST(r_regionkey AS VARCHAR)) FILTER (r_regionkey = 3) AS "V4", max(CAST(r_regionkey AS VARCHAR)) FILTER (r_regionkey = 4) AS "V5" FROM region UNION ALL SELECT max(r_name) FILTER (r_regionkey = 0), max(r_name) FILTER (r_regionkey = 1), max(r_name) FILTER (r_regionkey = 2), max(r_name) FILTER (r_regionkey = 3), max(r_name) FILTER (r_regionkey = 4) FROM region')
add("rowapply", lambda t: t.lineitem.select("l_orderkey", "l_linenumber", reshape.rowapply(t.lineitem, lambda a: F.array_max(a) - F.array_min(a), ["l_quantity", "l_linenumber"]).alias("spread")), "SELECT l_orderkey, l_linenumber, greatest(l_quantity, l_linenumber) - least(l_quantity, l_linenumber) AS spread FROM lineitem")

# --- across the columns of a row ------------------------------------------------------------------------------------

ROW = "SELECT l_orderkey, nullif(l_linenumber, 3) AS a, CAST(l_quantity AS INTEGER) % 7 AS b, CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE CAST(l_partkey % 9 AS INTEGER) END AS c FROM lineitem"
FLAG = "SELECT l_orderkey, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_linenumber > 3 END AS a, CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_partkey % 2 = 0 END AS b FROM lineitem"


def _row(t: Tables) -> DataFrame:
    return t.lineitem.selectExpr("l_orderkey", "nullif(l_linenumber, 3) AS a", "cast(l_quantity AS int) % 7 AS b", "CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE cast(l_partkey % 9 AS int) END AS c")


def _flags(t: Tables) -> DataFrame:
    return t.lineitem.selectExpr("l_orderkey", "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_linenumber > 3 END AS a", "CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_partkey % 2 = 0 END AS b")


ANY_NULL = "a IS NULL OR b IS NULL OR c IS NULL"
for fun, best in (("rowmin", "least(a, b, c)"), ("rowmax", "greatest(a, b, c)")):
    add(fun, lambda t, f=fun: _row(t).select("l_orderkey", *(getattr(rowwise, f)(_row(t), ["a", "b", "c"], na).alias(n) for n, na in (("strict", False), ("loose", True)))), f"SELECT l_orderkey, CASE WHEN {ANY_NULL} THEN NULL ELSE {best} END AS strict, {best} AS loose FROM ({ROW})")
for fun, op, rest in (("rowany", "OR", "false"), ("rowall", "AND", "true")):
    add(fun, lambda t, f=fun: _flags(t).select("l_orderkey", *(getattr(rowwise, f)(_flags(t), ["a", "b"], na).alias(n) for n, na in (("strict", False), ("loose", True)))), f"SELECT l_orderkey, a {op} b AS strict, coalesce(a, {rest}) {op} coalesce(b, {rest}) AS loose FROM ({FLAG})")
add("rowcount", lambda t: _row(t).select("l_orderkey", *(rowwise.rowcount(_row(t), ["a", "b", "c"], 1, na).alias(n) for n, na in (("strict", False), ("loose", True)))), f"SELECT l_orderkey, CAST(a = 1 AS INTEGER) + CAST(b = 1 AS INTEGER) + CAST(c = 1 AS INTEGER) AS strict, coalesce(CAST(a = 1 AS INTEGER), 0) + coalesce(CAST(b = 1 AS INTEGER), 0) + coalesce(CAST(c = 1 AS INTEGER), 0) AS loose FROM ({ROW})")
add("rowfirst", lambda t: _row(t).select("l_orderkey", *(rowwise.rowfirst(_row(t), ["a", "b", "c"], na).alias(n) for n, na in (("strict", False), ("loose", True)))), f"SELECT l_orderkey, a AS strict, coalesce(a, b, c) AS loose FROM ({ROW})")
add("rowlast", lambda t: _row(t).select("l_orderkey", *(rowwise.rowlast(_row(t), ["a", "b", "c"], na).alias(n) for n, na in (("strict", False), ("loose", True)))), f"SELECT l_orderkey, c AS strict, coalesce(c, b, a) AS loose FROM ({ROW})")

# --- windows --------------------------------------------------------------------------------------------------------

OVER = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"
AT = {"order": EVENT_ORDER, "by": "user_id"}


def over_events(name: str, column: Callable[[], Column], sql: str, digits: int | None = None) -> None:
    shown = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    add(name, lambda t: holed(t).select("event_id", shown(column()).alias("v")), f"SELECT event_id, {f'round({sql}, {digits})' if digits is not None else sql} AS v FROM {HOLED_SQL}")


over_events("lagvalue", lambda: windows.lagvalue("value", 2, -1.0, **AT), f"lag(value, 2, -1.0) {OVER}")
over_events("leadvalue", lambda: windows.leadvalue("value", **AT), f"lead(value) {OVER}")
over_events("difference", lambda: windows.difference("value", 2, **AT), f"value - lag(value, 2) {OVER}", 6)
over_events("percentchange", lambda: windows.percentchange("value", **AT), f"CASE WHEN lag(value) {OVER} <> 0 THEN (value - lag(value) {OVER}) / lag(value) {OVER} * 100 END", 4)
over_events("rownumber", lambda: windows.rownumber(**AT).cast("long"), f"row_number() {OVER}")
over_events("cumcount", lambda: windows.cumcount(**AT).cast("long"), f"row_number() {OVER}")
over_events("cummean", lambda: windows.cummean("value", **AT), "CASE WHEN count(*) OVER w = count(value) OVER w THEN avg(value) OVER w END", 6)
ORACLES["cummean"] += " WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
add("denserank", lambda t: t.orders.select("o_orderkey", windows.denserank(F.nullif("o_custkey", F.lit(7)), "o_orderstatus").cast("long").alias("v")), "SELECT o_orderkey, CASE WHEN o_custkey <> 7 THEN dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY nullif(o_custkey, 7) NULLS LAST) END AS v FROM orders")
add("percentrank", lambda t: windows.averaged_rank(t.orders, F.nullif("o_custkey", F.lit(7)), "o_orderstatus").select("o_orderkey", F.round("percentrank", 9).alias("v")), "SELECT o_orderkey, CASE WHEN k IS NOT NULL THEN round((rank() OVER (PARTITION BY o_orderstatus ORDER BY k NULLS LAST) + (count(*) OVER (PARTITION BY o_orderstatus, k) - 1) / 2) / count(k) OVER (PARTITION BY o_orderstatus), 9) END AS v FROM (SELECT *, nullif(o_custkey, 7) AS k FROM orders)")
CUMEDIST = "WITH f AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 AS INTEGER) AS new FROM events) SELECT event_id, round(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) / row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id), 9) AS v FROM f"
add("cumedist", lambda t: t.events.select("event_id", F.round(windows.cumedist("event_type", **AT), 9).alias("v")), CUMEDIST)
add("cumedist_flags", lambda t: windows.running_distinct(t.events, "event_type", **AT).select("event_id", F.round("cumedist", 9).alias("v")), CUMEDIST)
ROLLS = {"rollmean": "avg(value)", "rollsum": "sum(value)", "rollmin": "min(value)", "rollmax": "max(value)", "rollmedian": "median(value)", "rollsd": "stddev_samp(value)", "rollvar": "var_samp(value)", "rollprod": "product(value)"}
FRAMES = {"right": "2 PRECEDING AND CURRENT ROW", "left": "CURRENT ROW AND 2 FOLLOWING", "center": "1 PRECEDING AND 1 FOLLOWING"}
for (fun, agg), align in zip(ROLLS.items(), ["right", "left", "center"] * 3, strict=False):
    w = f"(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {FRAMES[align]})"
    add(fun, lambda t, f=fun, a=align: holed(t).select("event_id", F.round(getattr(windows, f)("value", 3, a, **AT), 6).alias("strict"), F.round(getattr(windows, f)("value", 3, a, partial=True, na_rm=True, **AT), 6).alias("loose")), f"SELECT event_id, round(CASE WHEN count(*) OVER w = 3 AND count(value) OVER w = 3 THEN {agg} OVER w END, 6) AS strict, round({agg} OVER w, 6) AS loose FROM {HOLED_SQL} WINDOW w AS {w}".replace("round(product(value) OVER w, 6) AS loose", "round(coalesce(product(value) OVER w, 1), 6) AS loose"))
add("rollapply", lambda t: t.events.select("event_id", F.round(windows.rollapply("value", 4, lambda a: F.array_max(a) - F.array_min(a), **AT), 6).alias("v")), "SELECT event_id, round(CASE WHEN count(*) OVER w = 4 THEN max(value) OVER w - min(value) OVER w END, 6) AS v FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)")

# --- numbers --------------------------------------------------------------------------------------------------------

PRICE = "o_totalprice"


def over_orders(name: str, table: Callable[[DataFrame], DataFrame], sql: str) -> None:
    add(name, lambda t: table(t.orders).select("o_orderkey", F.round("v", 6).alias("v")), f"SELECT o_orderkey, round({sql}, 6) AS v FROM orders, (SELECT min({PRICE}) AS lo, max({PRICE}) AS hi, avg({PRICE}) AS mean, stddev_samp({PRICE}) AS sd, quantile_cont({PRICE}, 0.05) AS q1, quantile_cont({PRICE}, 0.95) AS q2 FROM orders)")


over_orders("rescale", lambda d: numeric.rescale(d, PRICE, (0, 10), "v"), f"({PRICE} - lo) / (hi - lo) * 10")
over_orders("standardize", lambda d: numeric.standardize(d, PRICE, "v"), f"({PRICE} - mean) / sd")
over_orders("center", lambda d: numeric.center(d, PRICE, "v"), f"{PRICE} - mean")
over_orders("winsorize", lambda d: numeric.winsorize(d, PRICE, (0.05, 0.95), "v"), f"least(greatest({PRICE}, q1), q2)")
over_orders("clamp", lambda d: d.withColumn("v", numeric.clamp(PRICE, 1000.0, 200000.0)), f"least(greatest({PRICE}, 1000.0), 200000.0)")
add("quantilegroup", lambda t: numeric.quantilegroup(t.orders, PRICE, 4, "v", labels=False).select("o_orderkey", "v"), f"WITH q AS (SELECT quantile_cont({PRICE}, [0.25, 0.5, 0.75]) AS q FROM orders) SELECT o_orderkey, 1 + CAST({PRICE} > q[1] AS INTEGER) + CAST({PRICE} > q[2] AS INTEGER) + CAST({PRICE} > q[3] AS INTEGER) AS v FROM orders, q")

# --- text -----------------------------------------------------------------------------------------------------------


def over_text(name: str, column: Callable[[Column], Column], sql: str | None, table: str = "part", source: str = "p_name") -> None:
    key = {"part": "p_partkey", "documents": "doc_id", "pages": "page_id", "customer": "c_custkey"}[table]
    add(name, lambda t: getattr(t, table).select(key, F.expr(source).alias("x")).select(key, column(F.col("x")).alias("v")), f"SELECT {key}, {sql} AS v FROM (SELECT {key}, {source} AS x FROM {table})" if sql else None)


PADDED = "concat('  ', p_name, '\t ', p_type, ' ')"
over_text("trim", text.trim, "regexp_replace(x, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')", source=PADDED)
over_text("squish", text.squish, "regexp_replace(regexp_replace(x, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g'), '\\s+', ' ', 'g')", source=PADDED)
over_text("lower", text.lower, "lower(x)", source="p_type")
over_text("upper", text.upper, "upper(x)")
over_text("titlecase", lambda c: text.titlecase(F.concat(c, F.lit(" of THE sea"))), "array_to_string(list_transform(string_split(lower(x || ' of THE sea'), ' '), lambda w, i: CASE WHEN i > 1 AND w IN ('of', 'the') THEN w ELSE upper(left(w, 1)) || substr(w, 2) END), ' ')")
over_text("sentencecase", text.sentencecase, "upper(left(x, 1)) || lower(substr(x, 2))", source="p_type")
over_text("textlen", text.textlen, "CAST(length(x) AS INTEGER)", "documents", "text")
over_text("left", lambda c: text.left(c, 5), "left(x, 5)")
over_text("right", lambda c: text.right(c, 5), "right(x, 5)")
over_text("middle", lambda c: text.middle(c, 2, 6), "substr(x, 2, 5)")
over_text("truncate", lambda c: text.truncate(c, 12), "CASE WHEN length(x) > 12 THEN left(x, 9) || '...' ELSE x END")
over_text("padleft", lambda c: text.padleft(c, 22, "*"), "repeat('*', CAST(greatest(22 - length(x), 0) AS INTEGER)) || x", source="p_type")
over_text("padright", lambda c: text.padright(c, 22, "ab"), "x || repeat('ab', CAST(greatest(22 - length(x), 0) AS INTEGER))", source="p_type")
over_text("padcenter", lambda c: text.padcenter(c, 25, "-"), "repeat('-', CAST(greatest(25 - length(x), 0) // 2 AS INTEGER)) || x || repeat('-', CAST(greatest(25 - length(x), 0) - greatest(25 - length(x), 0) // 2 AS INTEGER))", source="p_type")
over_text("contains", lambda c: text.contains(c, "[[:digit:]]{2}"), "coalesce(regexp_matches(x, '[0-9]{2}'), false)", source="nullif(p_brand, 'Brand#11')")
over_text("contains_fixed", lambda c: text.contains(c, "#1", True), "contains(x, '#1')", source="p_brand")
over_text("matches", lambda c: text.matches(c, "Brand#[1-3]."), "regexp_matches(x, '^Brand#[1-3].$')", source="p_brand")
over_text("startswith", lambda c: text.startswith(c, "[A-P]"), "regexp_matches(x, '^[A-P]')", source="p_type")
over_text("endswith", lambda c: text.endswith(c, "[1-3]"), "regexp_matches(x, '[1-3]$')", source="p_brand")
over_text("countmatch", lambda c: text.countmatch(c, "[aeiou]"), "CAST(len(regexp_extract_all(x, '[aeiou]')) AS INTEGER)", "documents", "text")
over_text("locate", lambda c: text.locate(c, "e"), "CASE WHEN strpos(x, 'e') = 0 THEN -1 ELSE CAST(strpos(x, 'e') AS INTEGER) END")
over_text("locateall", lambda c: F.array_join(text.locateall(c, "a"), ","), "CASE WHEN contains(x, 'a') THEN array_to_string(list_filter(range(1, length(x) + 1), lambda i: substr(x, i, 1) = 'a'), ',') ELSE '-1' END")
over_text("extract", lambda c: text.extract(c, "[A-Z]+[0-9]"), "CASE WHEN regexp_matches(x, '[A-Z]+[0-9]') THEN regexp_extract(x, '[A-Z]+[0-9]') END", source="upper(concat(p_name, p_size))")
over_text("extractall", lambda c: F.array_join(text.extractall(c, "https?://[a-z.]+"), "|"), "array_to_string(regexp_extract_all(x, 'https?://[a-z.]+'), '|')", "pages", "html")
over_text("extractnum", text.extractnum, "TRY_CAST(regexp_replace(x, '[^0-9.-]', '', 'g') AS DOUBLE)", source="p_brand")
over_text("extractint", text.extractint, "TRY_CAST(regexp_replace(x, '[^0-9-]', '', 'g') AS INTEGER)", source="p_brand")
over_text("extractbetween", lambda c: text.extractbetween(c, "//", "/"), "regexp_replace(x, '.*//(.*)/.*', '\\1')", "pages", "url")
over_text("replacetext", lambda c: text.replacetext(c, "([a-z])1", "\\1x"), "regexp_replace(x, '([a-z])1', '\\1x', 'g')", source="lower(concat(p_name, '1'))")
over_text("replacetext_fixed", lambda c: text.replacetext(c, "#", "$", True), "replace(x, '#', '$')", source="p_brand")
over_text("removetext", lambda c: text.removetext(c, "[0-9]+"), "regexp_replace(x, '[0-9]+', '', 'g')", source="p_brand")
over_text("removeall", lambda c: text.removeall(c, "n", True), "replace(x, 'n', '')", source="p_brand")
over_text("splittext", lambda c: F.array_join(text.splittext(c, "#", True), "|"), "replace(x, '#', '|')", source="p_brand")
over_text("splitfirst", lambda c: text.splitfirst(c, " "), "split_part(x, ' ', 1)", source="p_type")
over_text("splitlast", lambda c: text.splitlast(c, " "), "split_part(x, ' ', -1)", source="p_type")
over_text("jointext", lambda c: text.jointext(F.nullif(c, F.lit("Brand#11")), F.lit("-"), c), "coalesce(nullif(x, 'Brand#11'), 'NA') || '-' || x", source="p_brand")
add("collapsetext", lambda t: t.conversations.groupBy("conv_id").agg(text.collapsetext("role", ">", order="turn").alias("v")), "SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS v FROM conversations GROUP BY ALL")
over_text("isblank", text.isblank, "x IS NULL OR trim(x) = ''", source="CASE p_size % 3 WHEN 0 THEN '  ' WHEN 1 THEN NULL ELSE p_name END")
over_text("removeaccents", text.removeaccents, "replace(strip_accents(x), 'ß', 'ss')", "documents", "text")
over_text("transliterate", lambda c: text.transliterate(F.lower(c)), "replace(strip_accents(lower(x)), 'ß', 'ss')", "documents", "text")
over_text("normalizeunicode", text.normalizeunicode, "x")
over_text("normalizeencoding", text.normalizeencoding, "x")
add("textdist", lambda t: text.textdist(t.nation, t.region, "n_name", "r_name").withColumn("distance", F.col("distance").cast("long")), "SELECT n_name AS x, r_name AS y, CAST(levenshtein(n_name, r_name) AS BIGINT) AS distance FROM nation CROSS JOIN region")
CHOICES = ["STANDARD TIN", "SMALL BRASS", "PROMO COPPER"]
NEAR = "list_sort([{d: levenshtein(x, 'STANDARD TIN'), i: 0, t: 'STANDARD TIN'}, {d: levenshtein(x, 'SMALL BRASS'), i: 1, t: 'SMALL BRASS'}, {d: levenshtein(x, 'PROMO COPPER'), i: 2, t: 'PROMO COPPER'}])[1].t"
over_text("nearesttext", lambda c: text.nearesttext(c, CHOICES), NEAR, source="p_type")
over_text("similartext", lambda c: text.similartext(c, CHOICES), NEAR, source="p_type")
SHAPES = "CASE p_partkey % 7 WHEN 0 THEN 'abc' WHEN 1 THEN 'ab1' WHEN 2 THEN '-1.5' WHEN 3 THEN '12' WHEN 4 THEN 'a.b@c.org' WHEN 5 THEN 'https://x.org' END"
for fun, shape in {"isalpha": "^[A-Za-z]+$", "isalphanumeric": "^[A-Za-z0-9]+$", "isnumerictext": "^[+-]?([0-9]*[.])?[0-9]+$", "isintegertext": "^[+-]?[0-9]+$", "isemail": "^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$", "isurl": "^(https?|ftp)://"}.items():
    over_text(fun, getattr(text, fun), f"coalesce(regexp_matches(x, '{shape}'), false)", source=SHAPES)

# --- recoding -------------------------------------------------------------------------------------------------------

SEGMENT = "nullif(c_mktsegment, 'MACHINERY')"


def over_segment(name: str, column: Callable[[Column], Column], sql: str, source: str = SEGMENT) -> None:
    over_text(name, column, sql, "customer", source)


over_segment("naif", lambda c: recode.naif(c, ["BUILDING", "FURNITURE"]), "CASE WHEN x NOT IN ('BUILDING', 'FURNITURE') THEN x END")
over_segment("nato", lambda c: recode.nato(c, "none"), "coalesce(x, 'none')")
over_segment("blanktona", recode.blanktona, "CASE WHEN trim(x) <> '' THEN x END", "CASE WHEN c_nationkey % 2 = 0 THEN ' ' ELSE c_mktsegment END")
over_segment("natoblank", recode.natoblank, "coalesce(x, '')")
REPLACED = "CASE x WHEN 'BUILDING' THEN 'b' WHEN 'FURNITURE' THEN 'f' ELSE x END"
for fun in ("replacevalues", "replaceall", "recode"):
    over_segment(fun, lambda c, f=fun: getattr(recode, f)(c, ["BUILDING", "FURNITURE"], ["b", "f"]), REPLACED)
GROUPED = "CASE WHEN x IN ('FURNITURE') THEN 'two' WHEN x IN ('BUILDING', 'AUTOMOBILE') THEN 'one' ELSE x END"
for fun in ("collapsevalues", "collapselevels"):
    over_segment(fun, lambda c, f=fun: getattr(recode, f)(c, {"one": ["BUILDING", "AUTOMOBILE"], "two": ["FURNITURE"]}), GROUPED)
add("lump", lambda t: recode.lump(t.customer.select("c_custkey", F.expr(SEGMENT).alias("v")), "v", 2), f"WITH top AS (SELECT c_mktsegment AS s FROM customer WHERE c_mktsegment <> 'MACHINERY' GROUP BY s ORDER BY count(*) DESC, s LIMIT 2) SELECT c_custkey, CASE WHEN {SEGMENT} IN (SELECT s FROM top) THEN c_mktsegment ELSE 'Other' END AS v FROM customer")
over_segment("reorderlevels", lambda c: recode.reorderlevels(c, ["HOUSEHOLD", "BUILDING"])["code"], "CASE x WHEN 'HOUSEHOLD' THEN 1 WHEN 'BUILDING' THEN 2 END")
add("expandlevels", lambda t: small(t, [(i, v) for i, v in enumerate(recode.levels_of(recode.expandlevels(t.region, "r_name", ["ATLANTIS"]), "r_name"))], "i int, level string"), "SELECT CAST(row_number() OVER (ORDER BY r_name = 'ATLANTIS', r_name) - 1 AS INTEGER) AS i, r_name AS level FROM (SELECT r_name FROM region UNION ALL SELECT 'ATLANTIS')")
over_segment("nalevel", recode.nalevel, "coalesce(x, 'Missing')")

# --- parsing --------------------------------------------------------------------------------------------------------

RAW = "CASE p_partkey % 8 WHEN 0 THEN '12.7' WHEN 1 THEN '1,234.5' WHEN 2 THEN 'n/a' WHEN 3 THEN 'TRUE' WHEN 4 THEN 'f' WHEN 5 THEN '42%' WHEN 6 THEN '$1,234.50' ELSE '7' END"
over_text("parseint", parsing.parseint, "CAST(trunc(TRY_CAST(x AS DOUBLE)) AS INTEGER)", source=RAW.replace("'f'", "'x'").replace("'TRUE'", "'-3.9'"))
over_text("parsenum", lambda c: parsing.parsenum(c, na=["7"]), "TRY_CAST(replace(nullif(x, '7'), ',', '') AS DOUBLE)", source=RAW.replace("'f'", "'x'"))
over_text("parselogical", parsing.parselogical, "CASE WHEN lower(x) IN ('true', 't', '1') THEN true WHEN lower(x) IN ('false', 'f', '0') THEN false END", source=RAW)
over_text("parsepercent", parsing.parsepercent, "TRY_CAST(replace(regexp_replace(x, '%$', ''), ',', '') AS DOUBLE) / 100", source=RAW.replace("'f'", "'x'"))
over_text("parsecurrency", parsing.parsecurrency, "TRY_CAST(regexp_replace(x, '[$,]', '', 'g') AS DOUBLE)", source=RAW.replace("'f'", "'x'"))
RAW_DATE = "CASE p_partkey % 3 WHEN 0 THEN '2024-03-15' WHEN 1 THEN '16/04/2023' ELSE 'soon' END"
over_text("parsedate", lambda c: parsing.parsedate(c, ["%Y-%m-%d", "%d/%m/%Y"]), "CASE x WHEN '2024-03-15' THEN DATE '2024-03-15' WHEN '16/04/2023' THEN DATE '2023-04-16' END", source=RAW_DATE)
over_text("parsedatetime", lambda c: parsing.parsedatetime(c, ["%Y-%m-%d %H:%M:%S"]).cast("timestamp_ntz"), "CASE x WHEN '2024-03-15 01:02:03' THEN TIMESTAMP '2024-03-15 01:02:03' END", source=RAW_DATE.replace("'2024-03-15'", "'2024-03-15 01:02:03'"))
add("parsefailures", lambda t: parsing.parsefailures(t.part.select("p_partkey", F.expr(RAW).alias("x")), "x", parsing.parsenum, order="p_partkey"), f"SELECT row_number() OVER (ORDER BY p_partkey) AS index, {RAW} AS value FROM part QUALIFY value IN ('n/a', 'TRUE', 'f', '42%', '$1,234.50')")

# --- dates ----------------------------------------------------------------------------------------------------------


def over_dates(name: str, column: Callable[[Column], Column], sql: str) -> None:
    add(name, lambda t: t.orders.select("o_orderkey", F.col("o_orderdate").alias("x")).select("o_orderkey", column(F.col("x")).alias("v")), f"SELECT o_orderkey, {sql} AS v FROM (SELECT o_orderkey, o_orderdate AS x FROM orders)")


for fun, sql in {"year": "year(x)", "month": "month(x)", "day": "day(x)", "yearday": "dayofyear(x)", "quarter": "quarter(x)", "week": "CAST(strftime(x, '%U') AS INTEGER)"}.items():
    over_dates(fun, getattr(dates, fun), f"CAST({sql} AS INTEGER)")
over_dates("weekday", dates.weekday, "dayname(x)")
for fun in ("hour", "minute", "second"):
    add(fun, lambda t, f=fun: t.events.select("event_id", getattr(dates, f)("ts").alias("v")), f"SELECT event_id, CAST({fun}(ts) AS INTEGER) AS v FROM events")
NEXT = {"day": "CAST(x AS DATE)", "week": "CAST(date_trunc('week', x) + INTERVAL 7 DAY AS DATE)", "month": "CAST(date_trunc('month', x) + INTERVAL 1 MONTH AS DATE)", "year": "CAST(date_trunc('year', x) + INTERVAL 1 YEAR AS DATE)"}
for unit in dates.UNITS:
    start = f"CAST(date_trunc('{unit}', x) AS DATE)"
    over_dates(f"floordate_{unit}", lambda c, u=unit: dates.floordate(c, u), start)
    over_dates(f"ceilingdate_{unit}", lambda c, u=unit: dates.ceilingdate(c, u), NEXT[unit])
    over_dates(f"rounddate_{unit}", lambda c, u=unit: dates.rounddate(c, u), f"CASE WHEN CAST(x AS DATE) - {start} <= {NEXT[unit]} - CAST(x AS DATE) THEN {start} ELSE {NEXT[unit]} END")
over_dates("adddays", lambda c: dates.adddays(c.cast("date"), 10), "CAST(x AS DATE) + 10")
over_dates("addweeks", lambda c: dates.addweeks(c.cast("date"), -2), "CAST(x AS DATE) - 14")
LATER = "CAST(CAST(x AS DATE) + INTERVAL 1 MONTH AS DATE)"
OVERFLOW = "CAST(date_trunc('month', x) + INTERVAL 1 MONTH AS DATE) + CAST(day(x) AS INTEGER) - 1"
over_dates("addmonths", lambda c: dates.addmonths(c, 1), LATER)
over_dates("addmonths_next", lambda c: dates.addmonths(c, 1, "next"), OVERFLOW)
over_dates("addmonths_missing", lambda c: dates.addmonths(c, 1, "missing"), f"CASE WHEN {OVERFLOW} = {LATER} THEN {LATER} END")
over_dates("addyears", lambda c: dates.addyears(c, 1), "CAST(CAST(x AS DATE) + INTERVAL 1 YEAR AS DATE)")
over_dates("datediff", lambda c: dates.datediff(c, F.lit("1995-01-01"), "hours"), "(epoch_us(x) - epoch_us(TIMESTAMP '1995-01-01')) / 3600000000.0")
add("dateseq", lambda t: dates.dateseq(t.spark, "2024-01-15", "2024-12-31", "month"), "SELECT CAST(d AS DATE) AS date FROM range(TIMESTAMP '2024-01-15', TIMESTAMP '2024-12-31', INTERVAL 1 MONTH) r(d)")
add("dateseq_even", lambda t: dates.dateseq(t.spark, "2024-01-01", "2024-01-31", length_out=4), "SELECT DATE '2024-01-01' + CAST(i * 10 AS INTEGER) AS date FROM range(4) r(i)")
over_dates("betweendates", lambda c: dates.betweendates(c, "1994-01-01", "1996-06-30"), "CAST(x AS DATE) BETWEEN DATE '1994-01-01' AND DATE '1996-06-30'")

# --- summaries ------------------------------------------------------------------------------------------------------

add("dims", lambda t: eda.dims(t.nation), "SELECT count(*) AS rows, CAST(3 AS BIGINT) AS cols FROM nation")
add("nrows", lambda t: small(t, [(eda.nrows(t.lineitem),)], "n long"), "SELECT count(*) AS n FROM lineitem")
add("ncols", lambda t: small(t, [(eda.ncols(t.lineitem),)], "n int"), "SELECT 11 AS n")
add("colnames", lambda t: small(t, [(c,) for c in eda.colnames(t.nation)], "name string"), "SELECT unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS name")
add("rownames", lambda t: eda.rownames(t.nation, "n_nationkey"), "SELECT *, CAST(n_nationkey + 1 AS VARCHAR) AS rowname FROM nation")
add("types", lambda t: eda.types(t.nation), "SELECT * FROM (VALUES ('n_nationkey', 'integer', 'integer'), ('n_name', 'character', 'character'), ('n_regionkey', 'integer', 'integer')) v(\"column\", class, type)")
add("classes", lambda t: eda.classes(t.region), "SELECT * FROM (VALUES ('r_regionkey', 'integer'), ('r_name', 'character')) v(\"column\", class)")
add("glimpse", lambda t: eda.glimpse(t.region), "SELECT * FROM region")
DESCRIBED = "SELECT '{0}' AS \"column\", '{1}' AS class, count(*) AS n, CAST(0 AS BIGINT) AS missing, 0.0::DOUBLE AS missing_prop, count(DISTINCT {0}) AS distinct, round(avg({0}), 6) AS mean, round(stddev_samp({0}), 6) AS sd, CAST(min({0}) AS DOUBLE) AS min, quantile_cont(CAST({0} AS DOUBLE), 0.25) AS q25, quantile_cont(CAST({0} AS DOUBLE), 0.5) AS median, quantile_cont(CAST({0} AS DOUBLE), 0.75) AS q75, CAST(max({0}) AS DOUBLE) AS max, NULL AS top FROM part"
SHOWN = "SELECT 'p_brand', 'character', count(*), 0, 0.0, count(DISTINCT p_brand), NULL, NULL, NULL, NULL, NULL, NULL, NULL, (SELECT string_agg(p_brand || ' (' || n || ')', ', ' ORDER BY n DESC, p_brand) FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 3)) FROM part"
for fun in ("describe", "profile"):
    add(fun, lambda t, f=fun: verbs.applycols(getattr(eda, f)(t.part, ["p_size", "p_retailprice", "p_brand"]), ["mean", "sd"], lambda c: F.round(c, 6)), " UNION ALL ".join([DESCRIBED.format("p_size", "integer"), DESCRIBED.format("p_retailprice", "numeric"), SHOWN]))
add("missingness", lambda t: eda.missingness(blanks(t)), f"SELECT c AS \"column\", m AS missing, m / 25 AS missing_prop, 25 - m AS complete FROM (SELECT unnest(['n_nationkey', 'a', 'b']) AS c, unnest([0, count(*) FILTER ({A}), count(*) FILTER ({B})]) AS m FROM ({BLANKS}))")
add("missingness_row", lambda t: eda.missingness(blanks(t), "row", "n_nationkey"), f'SELECT row_number() OVER (ORDER BY n_nationkey) AS "row", CAST(CAST({A} AS INTEGER) + CAST({B} AS INTEGER) AS BIGINT) AS missing, CAST(3 - CAST({A} AS INTEGER) - CAST({B} AS INTEGER) AS BIGINT) AS complete FROM ({BLANKS})')
add("summarytab", lambda t: eda.summarytab(t.customer, ["c_acctbal", "c_mktsegment"], p_value=True), "SELECT 'c_acctbal' AS variable, '' AS level, 'Mean (SD)' AS statistic, printf('%.1f (%.1f)', avg(c_acctbal), stddev_samp(c_acctbal)) AS Overall, '' AS p_value FROM customer UNION ALL SELECT 'c_acctbal', 'Missing', 'n', '0', '' UNION ALL SELECT 'c_mktsegment', 'Missing', 'n', '0', '' UNION ALL SELECT 'c_mktsegment', c_mktsegment, 'n (%)', printf('%d (%.1f%%)', count(*), 100.0 * count(*) / sum(count(*)) OVER ()), '' FROM customer GROUP BY c_mktsegment")
add("summarytab_by", lambda t: eda.summarytab(t.orders, ["o_totalprice", "o_orderpriority"], "o_orderstatus", p_value=True))
add("compare_dims", lambda t: eda.compare(t.nation, t.region)["dims"], "SELECT 'x' AS \"table\", count(*) AS rows, CAST(3 AS BIGINT) AS cols FROM nation UNION ALL SELECT 'y', count(*), 2 FROM region")
add("compare_keys", lambda t: eda.compare(t.documents.select("doc_id"), t.labels, "doc_id")["key_overlap"], "SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS x_unique, (SELECT count(DISTINCT doc_id) FROM labels) AS y_unique, (SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)) AS common")
add("uniques", lambda t: small(t, list(eda.uniques(t.customer.select("c_nationkey", F.expr(SEGMENT).alias("s"))).items()), "name string, n long"), f"SELECT 'c_nationkey' AS name, count(DISTINCT c_nationkey) AS n FROM customer UNION ALL SELECT 's', count(DISTINCT {SEGMENT}) + 1 FROM customer")
add("cardinality", lambda t: small(t, list(eda.cardinality(t.orders, ["o_custkey"], prop=True).items()), "name string, p double"), "SELECT 'o_custkey' AS name, count(DISTINCT o_custkey) / count(*) AS p FROM orders")
add("constants", lambda t: small(t, [(c,) for c in eda.constants(t.nation.withColumn("k", F.when(F.col("n_nationkey") > 3, 1)))], "name string"), "SELECT 'k' AS name")
add("emptycols", lambda t: small(t, [(c,) for c in eda.emptycols(t.nation.withColumn("k", F.lit(" ")))], "name string"), "SELECT 'k' AS name")
add("duplicatenames", lambda t: small(t, [(c,) for c in eda.duplicatenames(t.region.toDF("a", "a"))], "name string"), "SELECT 'a' AS name")
add("map", lambda t: t.embeddings.select("vec_id", F.aggregate(listops.map("embedding", lambda e: F.when(e > 0, 1).otherwise(0)), F.lit(0), lambda a, b: a + b).alias("v")), "SELECT vec_id, CAST(len(list_filter(embedding, lambda e: e > 0)) AS INTEGER) AS v FROM embeddings")
add("traverse", lambda t: t.embeddings.select("vec_id", F.size(F.filter(listops.traverse(["embedding", F.reverse("embedding")], lambda a, b: a > b), lambda x: x)).alias("v")), "SELECT vec_id, CAST(len(list_filter(list_zip(embedding, list_reverse(embedding)), lambda p: p[1] > p[2])) AS INTEGER) AS v FROM embeddings")
add("foldr", lambda t: t.nation.select("n_nationkey", listops.foldr(F.split("n_name", ""), lambda v, acc: F.concat(acc, v), "").alias("v")), "SELECT n_nationkey, reverse(n_name) AS v FROM nation")
add("setthreads", lambda t: small(t, [(eda.setthreads(t.spark) > 0,)], "set boolean"), 'SELECT true AS "set"')

# --- checks ---------------------------------------------------------------------------------------------------------


def passes(*calls: Callable[[], object]) -> list[tuple[bool]]:
    """Whether each call goes through."""
    out = []
    for call in calls:
        try:
            call()
            out.append(True)
        except (AssertionError, ValueError, TypeError):
            out.append(False)
    return [tuple(out)]


def checked(name: str, good: Callable[[Tables], object], bad: Callable[[Tables], object]) -> None:
    add(name, lambda t: small(t, passes(lambda: good(t), lambda: bad(t)), "good boolean, bad boolean"), "SELECT true AS good, false AS bad")


for fun in ("assert_cols", "assertcols"):
    checked(fun, lambda t, f=fun: getattr(checks, f)(t.nation, "n_name"), lambda t, f=fun: getattr(checks, f)(t.nation, "name"))
checked("assertnames", lambda t: checks.assertnames(t.nation, ["n_name"]), lambda t: checks.assertnames(t.nation, ["x"]))
for fun in ("assert_key", "assertkey", "assertunique"):
    checked(fun, lambda t, f=fun: getattr(checks, f)(t.orders, "o_orderkey"), lambda t, f=fun: getattr(checks, f)(t.orders, "o_custkey"))
checked("assertrows", lambda t: checks.assertrows(t.lineitem, "l_quantity > 0"), lambda t: checks.assertrows(t.lineitem, "nullif(l_linenumber, 3) > 0"))
checked("assertvalues", lambda t: checks.assertvalues(t.orders.withColumn("s", F.nullif("o_orderstatus", F.lit("P"))), "s", ["F", "O"]), lambda t: checks.assertvalues(t.orders, "o_orderstatus", ["F"]))
checked("assertrange", lambda t: checks.assertrange(t.lineitem, "l_discount", 0, 1), lambda t: checks.assertrange(t.lineitem, "l_quantity", 0, 10))
checked("asserttype", lambda t: checks.asserttype(t.nation, "n_name", "character"), lambda t: checks.asserttype(t.nation, "n_name", "numeric"))
checked("assertcomplete", lambda t: checks.assertcomplete(t.nation), lambda t: checks.assertcomplete(blanks(t)))
add("invalidrows", lambda t: checks.invalidrows(t.lineitem.select("l_orderkey", F.nullif("l_linenumber", F.lit(3)).alias("n")), "n > 2"), "SELECT l_orderkey, nullif(l_linenumber, 3) AS n FROM lineitem WHERE l_linenumber <= 3")
add("invalidvalues", lambda t: checks.invalidvalues(t.customer.select("c_custkey", F.expr(SEGMENT).alias("s")), "s", ["BUILDING"]), "SELECT c_custkey, c_mktsegment AS s FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
add("outofrange", lambda t: checks.outofrange(t.customer, "c_acctbal", 0, 5000), "SELECT * FROM customer WHERE c_acctbal < 0 OR c_acctbal > 5000")
checked("equaldata", lambda t: passes(lambda: checks.assertrows(small(t, [(checks.equaldata(t.nation, t.nation.orderBy(F.desc("n_nationkey")), ignoreorder=True),)], "x boolean"), "x")), lambda t: checks.assertrows(small(t, [(checks.equaldata(low(t), high(t), ignoreorder=True),)], "x boolean"), "x"))
checked("equalrows", lambda t: checks.assertrows(small(t, [(checks.equalrows(t.nation, t.nation, "n_nationkey"),)], "x boolean"), "x"), lambda t: checks.assertrows(small(t, [(checks.equalrows(low(t), high(t), "n_nationkey"),)], "x boolean"), "x"))
add("sameschema", lambda t: small(t, [(checks.sameschema(t.nation, low(t)), checks.sameschema(t.nation, t.region))], "a boolean, b boolean"), "SELECT true AS a, false AS b")
COMPARED = "SELECT * FROM (VALUES ('r_regionkey', true, true, 'integer', 'character'), ('r_name', true, false, 'character', NULL), ('x', false, true, NULL, 'double')) v(\"column\", in_x, in_y, type_x, type_y)"
for fun, place in (("compareschema", eda), ("changedcols", eda)):
    add(fun, lambda t, f=fun, m=place: getattr(m, f)(t.region, t.region.select(F.col("r_regionkey").cast("string"), F.lit(1.0).alias("x"))), COMPARED)

