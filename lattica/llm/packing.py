"""Best-fit packing with certified bin counts.

Documents are cut into pieces of at most ``capacity`` tokens and pieces are packed into sequences. Groups of
``group_rows`` pieces, dealt by a hash, are packed by best-fit decreasing. Dual feasible functions give a lower bound
of each group's number of sequences. Groups whose count equals the bound are certified and stay; the others hand the
pieces of their sequences that aren't full to a common pool, which is dealt anew into fewer groups and packed again,
for as long as that saves sequences. Only (id, length) rows move; one group's rows are all that a task holds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import discard, staged, unused, whole
from lattica.llm.tokenizing import LEADING_BLANK, documents_with_end, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, *, end_id: int = 2, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A document longer than ``capacity`` is cut from its end, so that only its first piece may be shorter. Null texts
    count as empty: one piece that holds the end id. Repeated documents give repeated pieces; an empty table gives none.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, LEADING_BLANK)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for first, ids, lengths in documents_with_end(coder, texts, end_id):
                counts = -(-lengths // capacity)
                doc = np.repeat(np.arange(len(lengths)), counts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
                head = (lengths - (counts - 1) * capacity)[doc]
                start = np.where(piece == 0, 0, head + (piece - 1) * capacity)
                length = np.where(piece == 0, head, capacity)
                begin = (np.cumsum(lengths) - lengths)[doc] + start
                raw = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), length.tolist(), strict=True)]
                columns = [keys.take(pa.array(doc + first)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin, len(ids)), pa.int32()), pa.array(ids, pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, [*(x.split()[0] for x in PIECES.split(", ")), "ids"][: len(columns)])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).alias("text"))
    return source.mapInArrow(cut, PIECES + (", ids array<int>" if with_ids else ""))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each item's bin and its place there, and each bin's filling. Ties go to the earlier item and the latest bin.

    Open bins are kept by the room they have left, with one bit for each room in use, so an item finds the tightest bin at once.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, places = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, filled = 0, []
    for item, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            chosen = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            room, chosen = capacity, len(filled)
            filled.append(0)
        bins[item], places[item] = chosen, capacity - room
        filled[chosen] += length
        left = room - length
        if left:
            open_bins[left].append(chosen)
            rooms |= 1 << left
    return bins, places, np.array(filled, np.int64)


def bin_bound(lengths: np.ndarray, capacity: int, steps: int = 12) -> int:
    """A lower bound of the bins that any packing of ``lengths`` needs: the best of two families of dual feasible functions."""
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1, dtype=np.int64)
    mass, number = np.cumsum(counts * sizes), np.cumsum(counts)
    cut = np.arange(0, capacity // 2 + 1)  # items under the cut weigh nothing, items above capacity - cut a whole bin
    below = np.where(cut > 0, mass[np.maximum(cut - 1, 0)], 0)
    cut_off = (mass[capacity - cut] - below) + (number[-1] - number[capacity - cut]) * capacity
    best = int(-(-cut_off.max() // capacity))
    for k in range(1, steps + 1):  # rounded to multiples of 1 / k unless a multiple of 1 / (k + 1)
        scaled = np.where((k + 1) * sizes % capacity == 0, k * sizes, (k + 1) * sizes // capacity * capacity)
        best = max(best, int(-(-(counts * scaled).sum() // (k * capacity))))
    return best


def _packed(first_group: int, capacity: int, own: dict[str, str]):
    """``own``: the names that the columns of the work have beside those of the pieces."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([own["_key"], *[c for c in ("doc_id", "piece") if c in group]], kind="stable").reset_index(drop=True)
        lengths = group["length"].to_numpy(np.int64)
        bins, places, filled = best_fit_decreasing(lengths, capacity)
        bound = bin_bound(lengths, capacity)
        group[own["sequence_id"]] = ((first_group + int(group[own["_group"]].iloc[0])) << 28) + bins
        group[own["offset"]] = places
        group[own["_first"]] = places == 0
        group[own["_gap"]] = len(filled) - bound
        group[own["_room"]] = capacity - filled[bins]
        return group

    return pack


def pack_best_fit(pieces: DataFrame, *, capacity: int = 1024, group_rows: int = 100_000) -> DataFrame:
    """``pieces`` with sequence_id, offset and certified (its group's count of sequences equals the lower bound).

    ``pieces`` needs a column ``length`` from 1 to ``capacity``; other columns are carried along. Every row is placed,
    repeated rows once each; an empty table stays empty. Ties are broken by a hash of the whole row, so reruns agree
    up to equal rows. If ``pieces`` has columns with names of results, they stay and underscores are appended to the
    names of the results.
    """
    names = pieces.columns
    own = {n: unused(n, names) for n in ("_key", "_group", "_first", "_gap", "_room", "sequence_id", "offset", "certified")}
    key, gap, room, first = (F.col(own[n]) for n in ("_key", "_gap", "_room", "_first"))
    items = staged(pieces.withColumn(own["_key"], F.xxhash64(*names)), "pieces")
    done: list[DataFrame] = []
    pool, number = items, items.count()
    first_group = 0
    for turn in count():
        groups = max(1, -(-number // group_rows))
        dealt = pool.select(*names, key, F.pmod(F.xxhash64(key, F.lit(turn)), F.lit(groups)).alias(own["_group"]))
        schema = T.StructType([*dealt.schema.fields, *(T.StructField(own[n], T.BooleanType() if n == "_first" else T.LongType()) for n in ("sequence_id", "offset", "_first", "_gap", "_room"))])
        tried = staged(dealt.groupBy(own["_group"]).applyInPandas(_packed(first_group, capacity, own), schema), f"round{turn}")
        if not turn:
            discard(items)
        first_group += groups
        if turn:
            saved = before - tried.filter(first).count()
            if saved <= 0:
                done.append(kept)
                break
        loose = (gap > 0) & (room > 0)
        totals = tried.filter(loose).agg(F.count(F.lit(1)).alias("rows"), F.count_if(first).alias("bins")).first()
        number, before = totals["rows"], totals["bins"]
        if not number or groups == 1:  # loose pieces of a single group are packed again as they were
            done.append(tried)
            break
        done.append(tried.filter(~loose))
        kept = tried.filter(loose)
        pool = kept.select(*names, key)
    result = reduce(DataFrame.unionByName, done)
    return result.select(*names, own["sequence_id"], own["offset"], (gap == 0).alias(own["certified"]))
