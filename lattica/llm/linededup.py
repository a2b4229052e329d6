"""Line deduplication by an exact set-similarity join, in DataFrame operations only.

A line's tokens are its word shingles, hashed; copies are one class of lines. Two classes of n and m tokens can only have
a Jaccard similarity of t or more if they have at least ceil(t n) and ceil(t m) of them in common. So whatever the order
of all tokens, they share k of the first n - ceil(t n) + k and m - ceil(t m) + k.

1. Prefixes in the order of hashes, which costs no counting, tell the classes that don't share enough of theirs with
   others: those match nothing. In prose that leaves a small part.
2. Of the others every shingle's own frequency is counted. Tokens are ordered by rarity (frequency, then hash), prefixes
   are joined on tokens, length and positional filters rule out pairs, the others are verified on the whole sets, and
   later lines that match are removed.

Documents that are copies of an earlier one lose all their lines and aren't looked into, as far as a bounded table of the
texts that occur most often tells. In a posting list each class first meets the list's earliest one only, which settles nearly every member of a large group
of near copies without listing the group's pairs. Classes that stay unmatched meet all earlier members of their lists.
Frequent tokens are combined before they are shuffled, and joins on tokens are plain equi-joins that adaptive execution
splits, so no list has to fit in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import discard, staged, unused

#: The most rows that are broadcast, of a few numbers each; beyond it a shuffle takes over.
BROADCAST_ROWS = 1_000_000
#: The most texts whose copies are set aside at once.
COPIED_TEXTS = 500_000
#: How many tokens of the prefixes in the order of hashes two similar lines share (k).
SHARED = 4


def _order(doc_id: Column) -> Column:
    """Ids in their order, null first, as numbers that can be compared; the smallest of all long numbers isn't told from null."""
    return F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63)))


def _frequent_texts(docs: DataFrame) -> DataFrame:
    """text_hash, text_size and text_first (the smallest id by ``_order``) of texts that several rows hold, with a bounded number of rows."""
    keys = docs.filter("text is not null").select(F.xxhash64("text").alias("text_hash"), F.octet_length("text").alias("text_size"), _order(F.col("doc_id")).alias("id"))
    texts = keys.groupBy("text_hash", "text_size").agg(F.min("id").alias("text_first"), F.count(F.lit(1)).alias("copies"))
    return staged(texts.filter(F.col("copies") > max(1, docs.count() // COPIED_TEXTS)).drop("copies"), "texts")


def _lines(docs: DataFrame) -> DataFrame:
    """A row for each line that has words: doc_id, copy (hash of the text), line_no and line."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), F.split("text", "\n").alias("lines"))
    return texts.select("doc_id", "copy", F.posexplode("lines").alias("line_no", "line")).filter(F.trim("line") != "")


def with_tokens(lines: DataFrame, shingle: int) -> DataFrame:
    """``lines`` with tokens in place of ``line``: the sorted distinct hashes of its shingles; a line of fewer words is one token."""

    def shingles(words: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(words) - shingle)
        return F.when(F.size(words) < shingle, F.array(F.xxhash64(words))).otherwise(F.transform(places, lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(shingle)))))

    # a lambda's variable is read faster than a column
    hashes = F.transform(F.array(F.array_remove(F.split("line", " "), "")), lambda words: F.transform(words, lambda w: F.xxhash64(w)))
    keep = [c for c in lines.columns if c != "line"]
    found = lines.select(*keep, hashes.alias("words")).select(*keep, F.transform("words", shingles)[0].alias("tokens"))
    return found.select(*keep, F.sort_array(F.array_distinct("tokens")).alias("tokens"))


def _least(n: Column, tenths: int) -> Column:
    """The fewest tokens that a set of n has in common with a similar one."""
    return F.floor((n * tenths + 9) / 10).cast("int")


def _needed(n: Column, m: Column, tenths: int) -> Column:
    """The overlap that a pair needs."""
    return F.ceil((n + m) * tenths / (10 + tenths) - 1e-9)


def _possible(n: Column, i: Column, m: Column, j: Column, tenths: int) -> Column:
    """Length and positional filters, for a common token at places i and j."""
    return (n * 10 >= m * tenths) & (m * 10 >= n * tenths) & (1 + F.least(n - i - 1, m - j - 1) >= _needed(n, m, tenths))


def _place() -> Column:
    return F.struct("doc_id", "copy", "line_no").alias("place")


def _broadcast_if_few(df: DataFrame, number: Column | None = None) -> DataFrame:
    """``df`` marked for broadcast if it has few rows, or few items by ``number``. It is counted for that and should be staged."""
    rows = df.count() if number is None else df.agg(number).first()[0] or 0
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _linked(lines: DataFrame, tenths: int) -> DataFrame:
    """h1 and first of the classes of ``lines`` that share enough tokens of their prefixes with others."""
    rows = lines.select("h1", F.explode("prefix").alias("token"))
    shared = rows.groupBy("token").agg(F.min("h1").alias("x"), F.max("h1").alias("y"), F.count(F.lit(1)).alias("rows")).filter("x <> y")
    shared = staged(shared, "shared")
    two = shared.filter("rows = 2").select(F.explode(F.array("x", "y")).alias("h1"))
    more = rows.join(_broadcast_if_few(shared.filter("rows > 2").select("token")), "token", "left_semi").select("h1")
    counts = staged(two.unionByName(more).groupBy("h1").agg(F.count(F.lit(1)).alias("shared")), "counts")
    linked = lines.select("h1", "n", _place()).join(_broadcast_if_few(counts), "h1").filter(F.col("shared") >= F.least(F.lit(SHARED), _least(F.col("n"), tenths)))
    linked = staged(linked.groupBy("h1").agg(F.min("place").alias("first")), "linked")
    discard(shared, counts)
    return linked


def _sets(docs: DataFrame, linked: DataFrame, shingle: int) -> DataFrame:
    """h1, first, n and tokens of the ``linked`` classes."""
    wanted = F.sort_array(F.collect_set(F.struct("first.line_no", "h1"))).alias("wanted")  # a document's lines at most
    places = staged(linked.groupBy("first.doc_id", "first.copy").agg(wanted), "places")
    at = places.toDF("d", "c", "wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), "text")
    picked = texts.join(_broadcast_if_few(at, F.sum(F.size("wanted"))), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("copy") == F.col("c")))
    picked = picked.select("doc_id", "copy", F.split("text", "\n").alias("lines"), "wanted").select("doc_id", "copy", "lines", F.explode("wanted").alias("w"))
    first = F.struct("doc_id", "copy", "w.line_no").alias("first")
    lines = picked.select("w.h1", first, F.get("lines", F.col("w.line_no")).alias("line"))
    sets = staged(with_tokens(lines, shingle).select("h1", "first", F.size("tokens").alias("n"), "tokens"), "sets")
    discard(places)
    return sets


def _entries(sets: DataFrame, tenths: int) -> DataFrame:
    """h1, first, n, token and i (its place) of the prefixes of the classes, the rarest tokens first; tokens of one class alone come first of all and are left out."""
    rows = sets.select("h1", F.explode("tokens").alias("token"))
    frequency = rows.groupBy("token").agg(F.count(F.lit(1)).alias("frequency")).filter("frequency > 1")
    from_end = F.row_number().over(Window.partitionBy("h1").orderBy(F.desc("frequency"), F.desc("token")))
    found = rows.join(frequency, "token").select("h1", "token", from_end.alias("from_end")).join(_broadcast_if_few(sets.select("h1", "first", "n")), "h1")
    found = found.filter(F.col("from_end") >= _least(F.col("n"), tenths))
    return found.select("h1", "first", "n", (F.col("n") - F.col("from_end")).alias("i"), "token")


def _similar(sets: DataFrame, tenths: int) -> DataFrame:
    """h1 and first of the classes of ``sets`` that are similar to an earlier one."""
    entries = staged(_entries(sets, tenths), "entries")
    earlier = entries.select(*(F.col(c).alias(f"e_{c}") for c in ("h1", "first", "n", "i")), "token")
    possible = (F.col("e_first") < F.col("first")) & _possible(F.col("n"), F.col("i"), F.col("e_n"), F.col("e_i"), tenths)

    leaders = entries.groupBy("token").agg(F.min(F.struct("first", "h1", "n", "i")).alias("e")).select("token", *(F.col(f"e.{c}").alias(f"e_{c}") for c in ("h1", "first", "n", "i")))
    led = staged(entries.join(leaders, "token").filter(possible).select(F.col("e_h1").alias("x"), F.col("h1").alias("y")).distinct(), "led")
    settled = staged(_verified(led, sets, tenths), "settled")

    pairs = entries.join(settled, "h1", "left_anti").join(earlier, "token").filter(possible)
    # common tokens up to the last possible one all count, and after it no more can follow than either set has left
    pairs = pairs.groupBy(F.col("e_h1").alias("x"), F.col("h1").alias("y")).agg(F.count(F.lit(1)).alias("c"), *(F.max(c).alias(c) for c in ("n", "i", "e_n", "e_i")))
    pairs = pairs.filter(F.col("c") + F.least(F.col("n") - F.col("i"), F.col("e_n") - F.col("e_i")) - 1 >= _needed(F.col("n"), F.col("e_n"), tenths))
    rest = _verified(staged(pairs.select("x", "y").join(led, ["x", "y"], "left_anti"), "pairs"), sets, tenths)
    similar = staged(sets.select("h1", "first").join(settled.unionByName(rest).distinct(), "h1"), "similar")
    discard(entries, led, settled)
    return similar


def _verified(pairs: DataFrame, sets: DataFrame, tenths: int) -> DataFrame:
    """h1 of the later class of those ``pairs`` (x, y) whose whole sets are similar enough."""
    members = pairs.select(F.explode(F.array("x", "y")).alias("h1")).distinct()
    some = sets.join(_broadcast_if_few(members), "h1", "left_semi").select("h1", "tokens")
    both = pairs.join(some.toDF("x", "xs"), "x").join(some.toDF("y", "ys"), "y")
    common = F.size(F.array_intersect("xs", "ys"))
    return both.filter(common * (10 + tenths) >= (F.size("xs") + F.size("ys")) * tenths).select(F.col("y").alias("h1")).distinct()


def removed_lines(docs: DataFrame, *, tenths: int = 8, shingle: int = 5) -> DataFrame:
    """doc_id, copy (hash of the text) and gone: the numbers (from 0) of the lines to remove from a document.

    A line goes if an earlier line is equal or has a Jaccard similarity of ``tenths`` / 10 or more with it, be that
    line kept or not; earlier is by (doc_id, hash of the text, line number), null ids first. A line of fewer words than
    ``shingle`` is one token. Lines without words stay. Repeated rows are one document.
    """
    keyed = _lines(docs).withColumns({"h1": F.xxhash64("line"), "h2": F.hash("line")})
    n = F.size("tokens")
    prefix = F.slice("tokens", F.lit(1), n - _least(n, tenths) + SHARED)
    lines = staged(with_tokens(keyed, shingle).select("doc_id", "copy", "line_no", "h1", "h2", n.alias("n"), prefix.alias("prefix")), "lines")
    linked = _linked(lines, tenths)
    sets = _sets(docs, linked, shingle)
    similar = _similar(sets, tenths)
    # of copies the first stays, unless it goes for its likeness to an earlier line
    copied = lines.groupBy("h1", "h2").agg(F.min(_order(F.col("doc_id"))).alias("first_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    copied = staged(copied.drop("copies"), "copied")
    copies = lines.join(_broadcast_if_few(copied), ["h1", "h2"])
    later = copies.filter(_order(F.col("doc_id")) > F.col("first_id")).select("doc_id", "copy", "line_no")
    ties = staged(copies.filter(_order(F.col("doc_id")) == F.col("first_id")).select("h1", "h2", _place()), "ties")
    firsts = staged(ties.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("lines")).filter("lines > 1").drop("lines"), "firsts")
    again = ties.join(_broadcast_if_few(firsts), ["h1", "h2"]).filter(F.col("place") != F.col("first")).select("place.*")
    found = later.unionByName(again).unionByName(similar.select("first.*"))
    gone = staged(found.groupBy("doc_id", "copy").agg(F.collect_set("line_no").alias("gone")), "gone")
    discard(lines, linked, sets, similar, copied, ties, firsts)
    return gone


def dedup_lines(docs: DataFrame, *, tenths: int = 8, shingle: int = 5) -> DataFrame:
    """``docs`` with later matching lines taken out of ``text``, and n_lines and n_removed.

    Every row stays, with all its other columns; a text may lose all its lines and is then empty. A null text stays null
    and has no lines. An empty table stays empty. If ``docs`` has columns called n_lines or n_removed, they stay what
    they are and underscores are appended to the names of the results.
    """
    names = ("_doc", "_copy", "_size", "_first", "_of_doc", "_of_copy", "_gone", "n_lines", "n_removed")
    doc, copy, size, first, of_doc, of_copy, gone, n_lines, n_removed = (unused(name, docs.columns) for name in names)
    texts = _frequent_texts(docs).withColumnsRenamed({"text_hash": of_copy, "text_size": size, "text_first": first})
    keyed = docs.withColumns({doc: F.col("doc_id").cast("long"), copy: F.xxhash64("text")})
    keyed = keyed.join(F.broadcast(texts), (F.col(copy) == F.col(of_copy)) & (F.octet_length("text") == F.col(size)), "left").drop(of_copy, size)
    again = F.coalesce(F.col(first) < _order(F.col(doc)), F.lit(False))
    found = removed_lines(keyed.filter(~again).select("doc_id", "text"), tenths=tenths, shingle=shingle).toDF(of_doc, of_copy, gone)
    joined = keyed.join(_broadcast_if_few(found, F.sum(F.size(gone))), F.col(doc).eqNullSafe(F.col(of_doc)) & (F.col(copy) == F.col(of_copy)), "left")

    lines = F.split("text", "\n")
    blank = F.filter(lines, lambda line: F.trim(line) == "")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    text = F.transform(F.array(lines), lambda all_lines: F.array_join(F.transform(kept, lambda i: F.get(all_lines, i)), "\n"))[0]
    text = F.when(again, F.array_join(blank, "\n")).when(F.col(gone).isNotNull(), text).otherwise(F.col("text"))
    feeds = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    number = F.coalesce(feeds + 1, F.lit(0)).cast("long")
    removed = F.when(again, F.size(lines) - F.size(blank)).otherwise(F.coalesce(F.size(gone), F.lit(0))).cast("long")
    others = [text.alias(c) if c.lower() == "text" else F.col(c) for c in docs.columns]
    return joined.select(*others, number.alias(n_lines), removed.alias(n_removed))
