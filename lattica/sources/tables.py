"""Tables as files. Readers leave filters and columns to the optimizer, which pushes them into the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.core import Names, names_of

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
FORMATS = ("parquet", "orc", "csv", "json")


def read_table(spark: SparkSession, sf_dir: str, name: str, form: str = "parquet", schema: str | None = None) -> DataFrame:
    """``sf_dir/name.form``, by any path that Spark can open."""
    if form not in FORMATS:
        raise ValueError(f"form must be one of {', '.join(FORMATS)}.")
    reader = spark.read.format(form)
    if schema:
        reader = reader.schema(schema)
    return (reader.option("header", True) if form == "csv" else reader).load(f"{sf_dir}/{name}.{form}")


def read_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: read_table(spark, sf_dir, name) for name in TABLES}


def write_table(df: DataFrame, path: str, form: str = "parquet", partition_by: Names | None = None, bucket: tuple[int, Names] | None = None, mode: str = "errorifexists") -> None:
    """Writes files, by the values of some columns if asked for; with ``bucket`` (number, columns) ``path`` is a table's name and later joins on those columns need no shuffle."""
    if form not in FORMATS:
        raise ValueError(f"form must be one of {', '.join(FORMATS)}.")
    writer = df.write.format(form).mode(mode)
    if form == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*names_of(partition_by))
    if bucket:
        number, cols = bucket
        writer.bucketBy(number, *names_of(cols)).sortBy(*names_of(cols)).saveAsTable(path)
    else:
        writer.save(path)
