"""Inspection and exploratory summaries.

Each reads the table in one aggregate, or one for each column where values have to be counted; only summaries reach the
driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.core import Names, as_table, exact_quantiles, is_blank, is_missing, quoted, resolve_cols, with_row_id
from lattica.functions.distributions import chi_squared, welch

#: Spark types in the words of the reports: class and storage type.
CLASSES = {"string": ("character", "character"), "boolean": ("logical", "logical"), "tinyint": ("integer", "integer"), "smallint": ("integer", "integer"), "int": ("integer", "integer"), "bigint": ("integer", "integer"), "float": ("numeric", "double"), "double": ("numeric", "double"), "date": ("Date", "double"), "timestamp": ("POSIXct", "double"), "timestamp_ntz": ("POSIXct", "double")}


def _named(kind: str) -> tuple[str, str]:
    return CLASSES.get(kind, ("numeric", "double") if kind.startswith("decimal") else (("list", "list") if kind.startswith(("array", "map", "struct")) else (kind, kind)))


def _small(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def dims(df: DataFrame) -> DataFrame:
    return _small(df.sparkSession, [(nrows(df), ncols(df))], "rows long, cols long")


def nrows(df: DataFrame) -> int:
    return as_table(df).count()


def ncols(df: DataFrame) -> int:
    return len(as_table(df).columns)


def colnames(df: DataFrame) -> list[str]:
    return as_table(df).columns


def rownames(df: DataFrame, order) -> DataFrame:
    """The table with its row numbers as text in ``rowname``: Spark rows have no labels."""
    return with_row_id(df, order, "rowname").withColumn("rowname", F.col("rowname").cast("string"))


def types(df: DataFrame) -> DataFrame:
    return _small(df.sparkSession, [(c, *_named(k)) for c, k in df.dtypes], "column string, class string, type string")


def classes(df: DataFrame) -> DataFrame:
    return types(df).drop("type")


def glimpse(df: DataFrame, width: int = 80) -> DataFrame:
    """Prints the shape and each column's type and first values; gives the table back."""
    rows = df.limit(3).collect()
    print(f"Rows: {nrows(df)}\nColumns: {ncols(df)}")
    for c, k in df.dtypes:
        line = f"$ {c} <{_named(k)[0]}> " + ", ".join("NA" if r[c] is None else str(r[c]) for r in rows)
        print(line if len(line) <= width else line[: width - 3] + "...")
    return df


def distinct_n(c: Column) -> Column:
    """Distinct values, NULL being one."""
    return F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("int")), F.lit(0))


def _is_number(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.NumericType)


def top_values(df: DataFrame, column: str, n: int = 3) -> str:
    """The most frequent values with their counts, ties by value."""
    text = F.coalesce(quoted(column).cast("string"), F.lit("<NA>")).alias("v")
    rows = df.select(text).groupBy("v").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "v").limit(n).collect()
    return ", ".join(f"{r['v']} ({r['n']})" for r in rows)


def describe(df: DataFrame, cols: Names | None = None, top_n: int = 3) -> DataFrame:
    """A row for each column: class, n, missing, distinct; mean, sd and quantiles of numbers, top values of others."""
    found = resolve_cols(df, cols, allow_none=True)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(found):
        x = F.when(~is_missing(df, c), quoted(c))
        aggs += [F.count_if(is_missing(df, c)).alias(f"m{i}"), distinct_n(quoted(c)).alias(f"d{i}")]
        if _is_number(df, c):
            v = x.cast("double")
            aggs += [F.avg(v).alias(f"a{i}"), F.stddev_samp(v).alias(f"s{i}")]
    one = df.agg(*aggs).first()
    rows = []
    for i, c in enumerate(found):
        number = _is_number(df, c)
        n, gone = one["_rows"], one[f"m{i}"]
        q = [None] * 5
        if number:
            q = exact_quantiles(df.select(F.when(~is_missing(df, c), quoted(c)).alias("v")), "v", [0.0, 0.25, 0.5, 0.75, 1.0]) or q
        stats = [one[f"a{i}"], one[f"s{i}"], *q] if number else [None] * 7
        rows.append((c, _named(dict(df.dtypes)[c])[0], n, gone, gone / n if n else None, one[f"d{i}"], *stats, None if number else top_values(df, c, top_n)))
    return _small(df.sparkSession, rows, "column string, class string, n long, missing long, missing_prop double, distinct long, mean double, sd double, min double, q25 double, median double, q75 double, max double, top string")


profile = describe


def missingness(df: DataFrame, margin: str = "column", order=None) -> DataFrame:
    """Blanks by column (missing, missing_prop, complete), or by row (row, missing, complete; needs ``order``)."""
    if margin == "row":
        n = sum((is_blank(df, c).cast("long") for c in df.columns), F.lit(0).cast("long"))
        flagged = with_row_id(df.withColumn("_missing", n), order, "row")
        return flagged.select("row", F.col("_missing").alias("missing"), (F.lit(len(df.columns)).cast("long") - F.col("_missing")).alias("complete"))
    if margin != "column":
        raise ValueError("margin must be column or row.")
    one = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(is_blank(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns))).first()
    rows = [(c, one[f"m{i}"], one[f"m{i}"] / one["n"] if one["n"] else None, one["n"] - one[f"m{i}"]) for i, c in enumerate(df.columns)]
    return _small(df.sparkSession, rows, "column string, missing long, missing_prop double, complete long")


def uniques(df: DataFrame) -> dict[str, int]:
    """Distinct values of each column, NULL being one."""
    one = df.agg(*(distinct_n(quoted(c)).alias(f"d{i}") for i, c in enumerate(df.columns))).first()
    return {c: one[f"d{i}"] for i, c in enumerate(df.columns)}


def cardinality(df: DataFrame, cols: Names, prop: bool = False) -> dict[str, float]:
    found = resolve_cols(df, cols)
    one = df.agg(F.count(F.lit(1)).alias("n"), *(distinct_n(quoted(c)).alias(f"d{i}") for i, c in enumerate(found))).first()
    return {c: one[f"d{i}"] / one["n"] if prop else one[f"d{i}"] for i, c in enumerate(found)}


def constants(df: DataFrame) -> list[str]:
    """Columns with just one value besides NULL."""
    one = df.agg(*(F.count_distinct(F.when(~is_missing(df, c), quoted(c))).alias(f"d{i}") for i, c in enumerate(df.columns))).first()
    return [c for i, c in enumerate(df.columns) if one[f"d{i}"] == 1]


def emptycols(df: DataFrame) -> list[str]:
    """Columns with blanks only."""
    one = df.agg(*(F.count_if(~is_blank(df, c)).alias(f"d{i}") for i, c in enumerate(df.columns))).first()
    return [c for i, c in enumerate(df.columns) if one[f"d{i}"] == 0]


def duplicatenames(df: DataFrame) -> list[str]:
    """Column names that came before."""
    return [c for i, c in enumerate(as_table(df).columns) if c in df.columns[:i]]


def compare(x: DataFrame, y: DataFrame, by: Names | None = None) -> dict[str, DataFrame]:
    """Small tables: dims, names, types, missing and, with ``by``, key_overlap."""
    spark = x.sparkSession
    names = list(dict.fromkeys([*x.columns, *y.columns]))
    kinds = [{c: _named(k)[0] for c, k in df.dtypes} for df in (x, y)]
    gone = [{r["column"]: r["missing"] for r in missingness(df).collect()} for df in (x, y)]
    out = {
        "dims": _small(spark, [("x", nrows(x), ncols(x)), ("y", nrows(y), ncols(y))], "table string, rows long, cols long"),
        "names": _small(spark, [(c, c in x.columns, c in y.columns) for c in names], "column string, in_x boolean, in_y boolean"),
        "types": _small(spark, [(c, kinds[0].get(c), kinds[1].get(c)) for c in names], "column string, type_x string, type_y string"),
        "missing": _small(spark, [(c, gone[0].get(c), gone[1].get(c)) for c in names], "column string, missing_x long, missing_y long"),
    }
    if by is not None:
        keys = resolve_cols(y, resolve_cols(x, by))
        a, b = (df.select(*map(quoted, keys)).distinct() for df in (x, y))
        out["key_overlap"] = _small(spark, [(a.count(), b.count(), a.intersect(b).count())], "x_unique long, y_unique long, common long")
    return out


def compareschema(x: DataFrame, y: DataFrame) -> DataFrame:
    kinds = [{c: _named(k)[1] for c, k in df.dtypes} for df in (x, y)]
    names = list(dict.fromkeys([*x.columns, *y.columns]))
    rows = [(c, c in kinds[0], c in kinds[1], kinds[0].get(c), kinds[1].get(c)) for c in names]
    return _small(x.sparkSession, rows, "column string, in_x boolean, in_y boolean, type_x string, type_y string")


changedcols = compareschema


def _written_p(p: float | None) -> str:
    return "" if p is None else "<0.001" if p < 0.001 else f"{p:.3f}"


def summarytab(df: DataFrame, vars: Names | None = None, by: Names | None = None, overall: bool = True, p_value: bool = False, digits: int = 1, max_levels: int = 1000) -> DataFrame:
    """A table of characteristics: Mean (SD) of numbers, n (pct%) of categories, missing rows, a column for each stratum.

    p values: Welch's test for numbers, chi-squared for categories. Moments and counts are grouped in Spark; formatting
    and tests run on those few rows.
    """
    keys = resolve_cols(df, by) if by is not None else []
    found = [c for c in df.columns if c not in keys] if vars is None else resolve_cols(df, vars)
    stratum = F.concat_ws(" / ", *(F.coalesce(quoted(k).cast("string"), F.lit("NA")) for k in keys)) if keys else F.lit("Overall")
    base = df.withColumn("_stratum", stratum)
    sizes = {r["_stratum"]: r["n"] for r in base.groupBy("_stratum").agg(F.count(F.lit(1)).alias("n")).collect()}
    strata = sorted(sizes)
    shown = [*strata, *(["Overall"] if keys and overall else [])]
    numbers = [c for c in found if _is_number(df, c)]
    moments: dict[str, Row] = {}
    aggs = []
    for i, c in enumerate(numbers):
        x = F.when(~is_missing(df, c), quoted(c).cast("double"))
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"a{i}"), F.stddev_samp(x).alias(f"s{i}")]
    if aggs:
        moments = {r["_stratum"]: r for r in base.groupBy("_stratum").agg(*aggs).collect()}
        if "Overall" in shown and keys:
            moments["Overall"] = base.agg(*aggs).first()
    rows = []

    def add(variable: str, level: str, statistic: str, cells: dict[str, str], p: str = "") -> None:
        rows.append((variable, level, statistic, *(cells.get(s, "") for s in shown), *([p] if p_value else [])))

    total = sum(sizes.values())
    size = lambda s: total if s == "Overall" and keys else sizes[s]
    for c in found:
        if c in numbers:
            i = numbers.index(c)
            parts = {s: (moments[s][f"n{i}"], moments[s][f"a{i}"], moments[s][f"s{i}"]) for s in shown}
            text = {s: f"{a:.{digits}f} ({d:.{digits}f})" if d is not None else f"{a:.{digits}f} (NA)" if a is not None else "NA" for s, (n, a, d) in parts.items()}
            p = welch([(n, a, d * d) for s, (n, a, d) in parts.items() if s in strata and n and d is not None]) if p_value and len(strata) > 1 else None
            add(c, "", "Mean (SD)", text, _written_p(p))
            add(c, "Missing", "n", {s: str(size(s) - n) for s, (n, _, _) in parts.items()})
            continue
        counts = base.groupBy("_stratum", quoted(c).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n")).limit(max_levels * max(1, len(strata)) + 1).collect()
        if len(counts) > max_levels * max(1, len(strata)):
            raise ValueError(f"{c} has more than {max_levels} levels.")
        table = {(r["_stratum"], r["v"]): r["n"] for r in counts}
        levels = sorted({v for _, v in table if v is not None})
        of = lambda s, v: sum(table.get((t, v), 0) for t in strata) if s == "Overall" and keys else table.get((s, v), 0)  # noqa: B023, E731
        p = chi_squared([[table.get((s, v), 0) for v in levels] for s in strata]) if p_value and len(strata) > 1 else None
        for k, v in enumerate(levels):
            known = {s: size(s) - of(s, None) for s in shown}
            add(c, v, "n (%)", {s: f"{of(s, v)} ({100 * of(s, v) / known[s]:.{digits}f}%)" if known[s] else "0 (NA)" for s in shown}, _written_p(p) if k == 0 else "")
        add(c, "Missing", "n", {s: str(of(s, None)) for s in shown})
    names = ["variable", "level", "statistic", *shown, *(["p_value"] if p_value else [])]
    return df.sparkSession.createDataFrame(rows, T.StructType([T.StructField(n, T.StringType()) for n in names]))


def setthreads(spark: SparkSession, threads: int | None = None) -> int:
    """Sets the number of shuffle partitions and gives the one before; cores are fixed when a session starts."""
    before = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if threads is not None:
        spark.conf.set("spark.sql.shuffle.partitions", threads)
    return before
