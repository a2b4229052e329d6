"""SimHash near-duplicates, linked through pivot distance tables.

A table holds the Hamming distances of every distinct fingerprint to many reference fingerprints: its coordinates,
computed once. Distinct fingerprints meet in cells: of four blocks of 16 bits two linked fingerprints (3 differing bits
or fewer) share one, and of the four parts of the other 48 bits they share one as well, so each fingerprint goes to 16
cells of 28 fixed bits, with its coordinates. By the triangle inequality the coordinates of linked fingerprints differ by
3 at most: a pair with a larger difference anywhere is discarded, and survivors are verified bit by bit. A cell
sends on a spanning forest of its links, never all pairs; a cell with very many fingerprints is split by further bits
in the same way before it is searched. Components of the forests give the near-duplicate classes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import staged, unused, whole
from lattica.llm.components import component_stars

BITS, LIMIT, PIVOTS, SPLIT_ABOVE = 64, 3, 24, 2048


def reference_fingerprints(number: int = PIVOTS, seed: int = 7) -> np.ndarray:
    """Random 64-bit words, the same in every process."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, number, np.uint64, endpoint=False)


def pivot_distances(fp: Column) -> Column:
    """The coordinates of a fingerprint: its Hamming distances to the reference fingerprints."""
    return F.array(*(F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("tinyint") for p in reference_fingerprints().view(np.int64).tolist()))


def close(coordinates: np.ndarray, values: np.ndarray, left: np.ndarray, right: np.ndarray, limit: int = LIMIT, tally: Counter | None = None) -> np.ndarray:
    """Which pairs of rows are linked: those whose coordinates differ too much anywhere are discarded before their bits are compared.

    ``tally`` counts the pairs, and those that are verified.
    """
    linked, alive = np.zeros(len(left), bool), np.arange(len(left))
    for p in range(coordinates.shape[1]):
        alive = alive[np.abs(coordinates[left[alive], p] - coordinates[right[alive], p]) <= limit]
        if not len(alive):
            break
    linked[alive] = np.bitwise_count(values[left[alive]] ^ values[right[alive]]) <= limit
    if tally is not None:
        tally.update(pairs=len(left), verified=len(alive))
    return linked


def fingerprint(raw: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned SimHash of UTF-8 text: majority bits of the XXH64 of its word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    words = raw.lower().split()  # of bytes: A-Z only, and the six ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, seed)
    ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    starts = [0, *(e + 1 for e in ends)]
    total, votes = len(words) - shingle + 1, np.zeros(BITS, np.int64)
    for at in range(0, total, 1 << 15):
        some = range(at, min(total, at + (1 << 15)))
        hashes = np.fromiter((xxh64_intdigest(joined[starts[i] : ends[i + shingle - 1]], seed) for i in some), np.uint64, len(some))
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, shingle: int = 3, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``keep`` and fp (the fingerprint as a signed long). Null texts count as empty: fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(t.as_buffer().to_pybytes(), shingle, seed) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got.view(np.int64))], ["doc_id", *keep, "fp"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, whole(F.col("text")).alias("text"))
    kinds = ", ".join(f"{c} {source.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(run, f"doc_id long, {kinds + ', ' if kinds else ''}fp long")


def _cells(fp: Column) -> Column:
    """The keys of the 16 cells of a fingerprint."""
    blocks = [F.shiftrightunsigned(fp, 16 * a).bitwiseAND(F.lit(0xFFFF)) for a in range(4)]
    keys = []
    for a in range(4):
        x, y, z = (blocks[b] for b in range(4) if b != a)
        rest = x.bitwiseOR(F.shiftleft(y, 16)).bitwiseOR(F.shiftleft(z, 32))
        for b in range(4):
            part = F.shiftrightunsigned(rest, 12 * b).bitwiseAND(F.lit(0xFFF))
            keys.append(F.shiftleft(F.lit(4 * a + b).cast("long"), 28).bitwiseOR(F.shiftleft(blocks[a], 12)).bitwiseOR(part))
    return F.array(*keys)


def _root(parents: np.ndarray, i: int) -> int:
    while parents[i] != i:
        parents[i] = parents[parents[i]]
        i = parents[i]
    return i


def link_forest(values: np.ndarray, coordinates: np.ndarray, limit: int = LIMIT, parents: np.ndarray | None = None, rows: np.ndarray | None = None, free: np.ndarray | None = None, tally: Counter | None = None) -> np.ndarray:
    """Roots of ``values`` (distinct uint64, with their ``coordinates``) where those within ``limit`` bits of each other are united.

    ``free``: bits that aren't known to be equal in all; a large set is split by parts of them, which loses no pair.
    """
    if parents is None:
        parents, rows, free = np.arange(len(values)), np.arange(len(values)), np.arange(BITS)
    if len(rows) > SPLIT_ABOVE and len(free) > 12:
        for part in np.array_split(free, limit + 1):
            mask = np.uint64(sum(1 << int(b) for b in part))
            key = values[rows] & mask
            order = np.argsort(key, kind="stable")
            for same in np.split(rows[order], np.flatnonzero(np.diff(key[order])) + 1):
                if len(same) > 1:
                    link_forest(values, coordinates, limit, parents, same, np.setdiff1d(free, part), tally)
        return parents
    rows = rows[np.argsort(coordinates[rows, 0], kind="stable")]
    first = coordinates[rows, 0]
    last = np.searchsorted(first, first + limit, side="right")  # within the limit of the first pivot
    for at in range(0, len(rows), 256):
        i = np.arange(at, min(len(rows), at + 256))
        counts = np.maximum(last[i] - i - 1, 0)
        left = np.repeat(i, counts)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(counts) - counts, counts)
        linked = close(coordinates, values, rows[left], rows[right], limit, tally)
        for a, b in zip(rows[left[linked]].tolist(), rows[right[linked]].tolist(), strict=True):
            a, b = _root(parents, a), _root(parents, b)
            if a != b:
                parents[max(a, b)] = min(a, b)
    return parents


def fingerprint_links(classes: DataFrame) -> DataFrame:
    """(u, v) between nodes of ``classes`` (fp, coordinates, node): for each cell a spanning forest of its links."""

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(cell, fp, node, coordinates):
            if not len(cell):
                return
            edge = np.flatnonzero(np.diff(cell)) + 1
            starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(cell)]])
            two = starts[ends - starts == 2]
            two = two[close(coordinates, fp, two, two + 1)]
            u, v = node[two].tolist(), node[two + 1].tolist()
            for a, b in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist(), strict=True):
                parents = link_forest(fp[a:b], coordinates[a:b])
                joined = np.flatnonzero(parents != np.arange(b - a))
                u += node[a:b][joined].tolist()
                v += node[a:b][parents[joined]].tolist()
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(u, np.int64)), pa.array(np.array(v, np.int64))], ["u", "v"])

        held = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, PIVOTS), np.int8)]
        for batch in batches:
            new = [batch.column("cell").to_numpy(), batch.column("fp").to_numpy().view(np.uint64), batch.column("node").to_numpy(), batch.column("coordinates").flatten().to_numpy().reshape(-1, PIVOTS)]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            if not len(held[0]):
                continue
            whole_cells = int(np.searchsorted(held[0], held[0][-1]))  # the last cell may go on
            yield from links(*(x[:whole_cells] for x in held))
            held = [x[whole_cells:] for x in held]
        yield from links(*held)

    dealt = classes.select(F.explode(_cells(F.col("fp"))).alias("cell"), "fp", "node", "coordinates")
    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(forest, "u long, v long")


def near_duplicates(docs: DataFrame, *, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id: the smallest doc_id reachable over links.

    Null and empty texts have fingerprint zero and are linked like others. Repeated rows give repeated results; rows
    with a null doc_id keep it and join the component of their fingerprint. An empty table gives an empty result.
    """
    found = staged(fingerprints(docs, shingle=shingle), "fingerprints")
    classes = found.groupBy("fp").agg(F.min("doc_id").alias("node")).filter("node is not null")
    classes = staged(classes.withColumn("coordinates", pivot_distances(F.col("fp"))), "classes")
    stars = component_stars(fingerprint_links(classes))
    labelled = classes.join(stars.select(F.col("u").alias("node"), F.col("v").alias("component_id")), "node", "left")
    labelled = labelled.select("fp", F.coalesce("component_id", "node").alias("component_id"))
    return found.join(labelled, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, *, shingle: int = 3) -> DataFrame:
    """One row of each component of ``docs``: the one with the smallest doc_id, null last, then with the smallest hash of its text.

    Rows count by doc_id and text: those without a doc_id or with one that repeats go only if another row resembles them.
    """
    none, number, text = (unused(n, docs.columns) for n in ("_none", "_id", "_hash"))
    key = {none: F.col("doc_id").isNull(), number: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), text: F.xxhash64("text", F.length("text"))}
    found = fingerprints(docs.withColumn(text, key[text]), shingle=shingle, keep=(text,)).withColumns({k: key[k] for k in (none, number)})
    classes = found.groupBy("fp").agg(F.min(F.struct(*key)).alias("best")).withColumns({"node": F.col("fp"), "coordinates": pivot_distances(F.col("fp"))})
    classes = staged(classes, "classes")
    stars = component_stars(fingerprint_links(classes)).select(F.col("u").alias("node"), F.col("v").alias("component"))
    labelled = classes.join(stars, "node", "left").groupBy(F.coalesce("component", "node")).agg(F.min("best").alias("best"))
    return docs.withColumns(key).join(labelled.select("best.*"), list(key), "left_semi").dropDuplicates(list(key)).select(*docs.columns)
