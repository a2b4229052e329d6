"""A pipeline over ``documents``: toxicity, line dedup, SimHash near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a DataFrame that is
written as Parquet and read again as the next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm import linededup, mixing, packing, simhash, toxicity
from lattica.llm.common import documents, staged, table, unused
from lattica.llm.queries import vocabulary

TOXIC_FROM = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored ``TOXIC_FROM`` or more go."""
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    score = unused("toxicity", docs.columns)
    return toxicity.score_toxicity(docs, model, score).filter(F.col(score) < TOXIC_FROM).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later matching lines are taken out of the texts; every document stays."""
    got = linededup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        got = got.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return got.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: the one with the smallest id, or any if none has an id."""
    return simhash.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is there as many times as the mix takes it; the one of each source that it takes in part counts to the nearest whole number."""
    doc, source, size, row, copies, copy, *others = (unused(n, docs.columns) for n in ("_doc", "_source", "_size", "_row", "_copies", "_copy", "_d", "_s", "_z", "_r"))
    keys = {doc: F.col("doc_id").cast("long"), source: F.col("source").cast("string"), size: mixing.word_count(F.col("text"))}
    # rows of one id, source and size are alike to the mix: any numbering of them will do
    numbered = docs.withColumns(keys).withColumn(row, F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("text"))).cast("long"))
    taken = mixing.mix_documents(docs).select("doc_id", "source", "size", "row", F.round("copies").cast("int").alias("n")).filter("n > 0").toDF(*others, copies)
    same = F.col(doc).eqNullSafe(F.col(others[0])) & F.col(source).eqNullSafe(F.col(others[1])) & (F.col(size) == F.col(others[2])) & (F.col(row) == F.col(others[3]))
    return numbered.join(taken, same).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their places in sequences."""
    return packing.pack_best_fit(packing.token_pieces(docs, vocabulary("byte_bpe_50k.json")))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("simhash", drop_near_copies), ("mixing", mix_sources), ("packing", pack)]

#: Trained trees, random transfers and tokenizers have no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = staged(docs, name)
    return docs
