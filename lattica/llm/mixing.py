"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Each document of a source has the same fractional number of copies, target over size of its source. Whole copies are
given out at once. The fraction that is left is rounded by pivots: two documents meet, and words move from one to the
other, either way at random and with odds that keep both expectations, until one of them has no fraction left. A
chunk of documents ends with one unsettled document at most; those meet in the chunks of the next level of a reduction
tree. Of the last document of a source the mix takes, besides whole copies, just the words that are left, so every source
meets its target to the word. All draws are hashes of the two documents that meet: reruns agree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import SPACES, staged, whole

WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3
UNIT = "struct<doc_id:bigint,row:bigint,size:bigint,mass:double>"


def word_count(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(f"[^{SPACES}]+")).cast("long")


def source_targets(sizes: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, source_size and target from rows (source, size).

    Sources in order of their code points, null last, take ``weights`` in turn and share the total. A target stops at
    ``max_copies`` times its source's size and what exceeds it is shared again by weight: sources are taken by their
    ratio of limit to weight, and the first for which an even level fits, and all after it, get that level times weight.
    """
    sources = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weighed = sources.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (number % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("_limit", (F.col("source_size") * max_copies).cast("double"))
    by_ratio = Window.orderBy(F.col("_limit") / F.col("_weight"), F.asc_nulls_last("source"))
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    filled = F.coalesce(F.sum("_limit").over(before), F.lit(0.0))
    used = F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    total = F.sum("source_size").over(everything)
    level = (total - filled) / (F.sum("_weight").over(everything) - used)
    leveled = weighed.withColumn("_level", level).withColumn("_fits", F.col("_level") * F.col("_weight") <= F.col("_limit"))
    shared = F.min(F.when(F.col("_fits"), F.struct(F.col("_limit") / F.col("_weight"), F.col("_level").alias("_level")))).over(everything)
    target = F.least(F.col("_limit"), F.coalesce(shared["_level"] * F.col("_weight"), F.col("_limit")))
    return leveled.select("source", "source_size", target.alias("target"))


def _rounded(units: Column, seed: int) -> Column:
    """Folds an ordered array of units (doc_id, row, size, mass: words of its fraction) into settled ones and a pivot.

    The state is the pivot and the settled units; mass is 0 or size once settled.
    """
    nothing = F.lit(None).cast(UNIT)

    def meet(state: Column, unit: Column) -> Column:
        pivot = state["pivot"]
        up = F.least(pivot["size"] - pivot["mass"], unit["mass"])  # words that can move to the pivot
        down = F.least(pivot["mass"], unit["size"] - unit["mass"])
        draw = F.pmod(F.xxhash64(pivot["doc_id"], pivot["row"], unit["doc_id"], unit["row"], F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
        moved = F.when(draw * (up + down) < down, up).otherwise(-down)
        first = F.struct(pivot["doc_id"].alias("doc_id"), pivot["row"].alias("row"), pivot["size"].alias("size"), (pivot["mass"] + moved).alias("mass"))
        second = F.struct(unit["doc_id"].alias("doc_id"), unit["row"].alias("row"), unit["size"].alias("size"), (unit["mass"] - moved).alias("mass"))
        pair = F.array(first, second)
        return F.when(pivot.isNull(), F.struct(unit.cast(UNIT).alias("pivot"), state["settled"].alias("settled"))).otherwise(_settled(pair, state["settled"]))

    def _settled(pair: Column, settled: Column) -> Column:
        # less than a millionth of a word is rounding error
        whole_now = F.transform(pair, lambda u: F.when(u["mass"] < 1e-6, F.lit(0)).when(u["size"] - u["mass"] < 1e-6, F.lit(1)))
        return F.transform(
            F.array(F.struct(pair.alias("pair"), whole_now.alias("whole"))),
            lambda x: F.struct(
                F.when(x["whole"][0].isNull(), x["pair"][0]).when(x["whole"][1].isNull(), x["pair"][1]).otherwise(nothing).cast(UNIT).alias("pivot"),
                F.concat(settled, F.filter(F.transform(x["pair"], lambda u, i: F.struct(u["doc_id"].alias("doc_id"), u["row"].alias("row"), u["size"].alias("size"), F.element_at(x["whole"], i + 1).cast("long").alias("extra"))), lambda u: u["extra"].isNotNull())).alias("settled"),
            ),
        )[0]

    empty = F.array().cast("array<struct<doc_id:bigint,row:bigint,size:bigint,extra:bigint>>")
    return F.aggregate(units, F.struct(nothing.alias("pivot"), empty.alias("settled")), meet)


def mix_documents(docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES, chunk_rows: int = 256, seed: int = 8, broadcast_sources: int = 20_000) -> DataFrame:
    """One row for each document: doc_id, row, source, size, source_size, target, copies and taken (words, repeats counted).

    ``copies`` is a whole number but for one document of each source at most, which is taken in part at its end.

    Null texts and texts without words have size 0, move no words and count as taken once. Null sources are a
    source of their own. Repeated rows are told apart by ``row``, their number among rows of one doc_id, source and
    size. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    again = Window.partitionBy("doc_id", "source", "size").orderBy(F.lit(0))
    sized = staged(sized.withColumn("row", F.row_number().over(again).cast("long")), "sizes")
    targets = staged(source_targets(sized, weights=weights, max_copies=max_copies), "targets")
    number, sources = sized.count(), targets.count()
    chunks = max(1, -(-number // chunk_rows))
    bucket = F.pmod(F.xxhash64("doc_id", "row", F.lit(seed)), F.lit(chunks))
    if sources <= broadcast_sources:  # a source's row takes some 100 bytes
        joined = sized.join(F.broadcast(targets), sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    else:
        salt = F.explode(F.sequence(F.lit(0), F.lit(31)))
        salted, many = sized.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(32)).cast("int")), targets.withColumn("_salt", salt)
        joined = salted.join(many, salted["source"].eqNullSafe(many["source"]) & (salted["_salt"] == many["_salt"])).drop(many["source"]).drop("_salt")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    base = F.least(F.floor(rate + 1e-12), F.lit(max_copies)).cast("long")
    rated = joined.withColumn("base", base).withColumn("fraction", F.greatest(rate - F.col("base"), F.lit(0.0)))
    keys = ["source", "source_size", "target", "base"]
    unit = F.struct((-F.col("size")).alias("_down"), "doc_id", "row", "size", (F.col("size") * F.col("fraction")).alias("mass"))
    open_rows = (F.col("size") > 0) & (F.col("fraction") * F.col("size") > 1e-6)
    settled = [rated.filter(~open_rows).select(*keys, "doc_id", "row", "size", F.lit(0).cast("long").alias("words"))]
    level = rated.filter(open_rows).select(*keys, bucket.alias("chunk"), unit.alias("unit"))
    while True:
        # the largest first: what is unsettled at the end is small
        grouped = level.groupBy(*keys, "chunk").agg(F.sort_array(F.collect_list("unit")).alias("units"))
        units = F.transform("units", lambda u: F.struct(u["doc_id"].alias("doc_id"), u["row"].alias("row"), u["size"].cast("long").alias("size"), u["mass"].alias("mass")))
        done = staged(grouped.select(*keys, "chunk", _rounded(units, seed).alias("state")), "level")
        settled.append(done.select(*keys, F.explode("state.settled").alias("u")).select(*keys, "u.doc_id", "u.row", "u.size", (F.col("u.extra") * F.col("u.size")).alias("words")))
        rest = done.filter(F.col("state.pivot").isNotNull()).select(*keys, "chunk", F.col("state.pivot").alias("p"))
        if chunks == 1:
            settled.append(rest.select(*keys, "p.doc_id", "p.row", "p.size", F.round("p.mass").cast("long").alias("words")))
            break
        chunks = -(-chunks // chunk_rows)
        level = rest.select(*keys, F.pmod("chunk", F.lit(chunks)).alias("chunk"), F.struct((-F.col("p.size")).alias("_down"), "p.doc_id", "p.row", "p.size", "p.mass").alias("unit"))
    taken = F.col("base") * F.col("size") + F.col("words")
    copies = F.when(F.col("size") > 0, taken / F.col("size")).otherwise(F.lit(1.0))
    result = reduce(DataFrame.unionByName, settled)
    return result.select("doc_id", "row", "source", "size", "source_size", "target", copies.alias("copies"), taken.alias("taken"))
