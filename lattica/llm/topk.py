"""Exact top-k inner products by best-first search of a paged M-tree.

Vectors go to pages of bounded size, by the nearest of some routing vectors; each page holds an M-tree, and the upper
levels of the tree, whose leaves are pages, go to every worker. Entries keep a routing object, a covering radius and the
distance to the parent's routing object. For a query q and an entry with routing object c and radius r no inner product
exceeds q.c + |q| r, and by the triangle inequality q.c itself is at most q.p + |q| d(c, p) for the parent p: with that
stored distance most entries are ruled out before their own product is computed. Nodes are visited in the order of
their bounds. A query starts from its k-th best score among the routing vectors, a lower bound of its true one; it
searches its most promising page, and with the k-th best score found there all other pages that could hold better ones.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import staged

LEAF, FAN_OUT, SLACK = 128, 12, 1e-6
#: The most pages by size, besides one for each routing vector: the upper levels have so many entries at most.
MAX_PAGES = 8192


def spread(points: np.ndarray, rows: np.ndarray, centre: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """``rows`` of ``points`` in parts, each around a routing object, those objects far from each other."""
    own = points[rows]
    chosen = [int(((own - centre) ** 2).sum(axis=1).argmax())]
    gap = np.sqrt(((own - own[chosen[0]]) ** 2).sum(axis=1))
    nearest = np.zeros(len(rows), np.int64)
    while len(chosen) < FAN_OUT and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        new = np.sqrt(((own - own[chosen[-1]]) ** 2).sum(axis=1))
        nearest[new < gap] = len(chosen) - 1
        gap = np.minimum(gap, new)
    used = np.unique(nearest)
    return [rows[nearest == c] for c in used], own[np.array(chosen)[used]]


class MTree:
    """An M-tree over integer vectors, built in bulk; ties are settled by smaller ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.real, self.nodes, self.order = vectors.astype(np.float64), [], []
        root = np.round(self.real.mean(axis=0))
        self.root = (root, self._build(np.arange(len(ids)), root))
        rows = np.concatenate(self.order)  # the rows of a leaf lie in a row
        self.ids, self.vectors, self.real = ids.astype(np.int64)[rows], vectors[rows], self.real[rows]
        self.longest = float(np.sqrt((self.real**2).sum(axis=1).max()))

    def stored(self) -> bytes:
        return pickle.dumps((self.ids, self.vectors, self.nodes, self.root, self.longest))

    @classmethod
    def loaded(cls, raw: bytes) -> MTree:
        tree = cls.__new__(cls)
        tree.ids, tree.vectors, tree.nodes, tree.root, tree.longest = pickle.loads(raw)
        tree.real = tree.vectors.astype(np.float64)
        return tree

    def _leaf(self, rows: np.ndarray, distance: np.ndarray) -> int:
        start = sum(map(len, self.order))
        nearest = np.argsort(distance, kind="stable")
        self.order.append(rows[nearest])
        self.nodes.append(("leaf", start, distance[nearest]))
        return len(self.nodes) - 1

    def _build(self, rows: np.ndarray, centre: np.ndarray) -> int:
        """The number of a node for ``rows``, whose entries know their distances to ``centre``."""
        distance = np.sqrt(((self.real[rows] - centre) ** 2).sum(axis=1))
        if len(rows) <= LEAF or not distance.any():
            return self._leaf(rows, distance)
        parts, routing = spread(self.real, rows, centre)
        if len(parts) == 1:  # all in one place as far as distances tell
            return self._leaf(rows, distance)
        radii = np.array([np.sqrt(((self.real[p] - c) ** 2).sum(axis=1)).max() for p, c in zip(parts, routing, strict=True)])
        parent = np.sqrt(((routing - centre) ** 2).sum(axis=1))
        children = [self._build(p, c) for p, c in zip(parts, routing, strict=True)]
        self.nodes.append(("inner", routing, radii, parent, children))
        return len(self.nodes) - 1

    def search(self, query_id: int, query: np.ndarray, k: int, floor: float = -np.inf) -> tuple[list[tuple[int, int]], int]:
        """(score, id) of the best k rows other than the query's with a score of ``floor`` at least; products computed."""
        q = query.astype(np.float64)
        length, whole = float(np.sqrt(q @ q)) * (1 + 1e-12), query.astype(np.int64)
        exact = length * self.longest < 2.0**52  # then sums of products are whole numbers that floating point holds exactly
        best: list[tuple[int, int]] = []  # a heap with the worst on top: (score, -id)
        centre, top = self.root
        entries = self.nodes[top]
        reach = float(np.sqrt(centre @ centre)) + float((entries[2] if entries[0] == "leaf" else entries[3] + entries[2]).max())
        slack = SLACK + 1e-12 * length * reach  # rounding of products grows with them
        waiting = [(-np.inf, 0, top, float(centre @ q))]
        limit, computed, turn = floor, 0, 1
        while waiting:
            bound, _, number, product = heapq.heappop(waiting)
            if -bound < limit - slack:
                break
            node = self.nodes[number]
            if node[0] == "leaf":
                _, start, distance = node
                first = int(np.searchsorted(distance, (limit - slack - product) / length)) if length else 0  # nearer ones can't reach the limit
                computed += len(distance) - first
                part = slice(start + first, start + len(distance))
                scores = self.real[part] @ q if exact else self.vectors[part] @ whole
                good = np.flatnonzero(scores >= limit)
                for score, i in zip(scores[good].tolist(), self.ids[part][good].tolist(), strict=True):
                    score = int(score)
                    if i == query_id or score < limit:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (score, -i))
                    elif (score, -i) > best[0]:
                        heapq.heapreplace(best, (score, -i))
                    if len(best) == k:
                        limit = max(limit, best[0][0])
            else:
                _, routing, radii, parent, children = node
                maybe = np.flatnonzero(product + length * (parent + radii) >= limit - slack)
                computed += len(maybe)
                products = routing[maybe] @ q
                bounds = products + length * radii[maybe]
                for b, c, p in zip(bounds.tolist(), maybe.tolist(), products.tolist(), strict=True):
                    if b >= limit - slack:
                        heapq.heappush(waiting, (-b, turn, children[c], p))
                        turn += 1
        return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1])), computed


class PageTree:
    """The upper levels of the tree: nodes over pages (numbers, centres, covering radii)."""

    def __init__(self, numbers: np.ndarray, centres: np.ndarray, radii: np.ndarray):
        self.numbers, self.centres, self.radii, self.nodes = numbers, centres, radii, []
        self.root = centres.mean(axis=0)
        self.top = self._build(np.arange(len(numbers)), self.root)

    def _build(self, rows: np.ndarray, centre: np.ndarray) -> int:
        parts, routing = spread(self.centres, rows, centre) if len(rows) > FAN_OUT else ([], None)
        if len(parts) < 2:
            self.nodes.append((None, self.centres[rows], self.radii[rows], np.sqrt(((self.centres[rows] - centre) ** 2).sum(axis=1)), rows))
            return len(self.nodes) - 1
        radii = np.array([(np.sqrt(((self.centres[p] - c) ** 2).sum(axis=1)) + self.radii[p]).max() for p, c in zip(parts, routing, strict=True)])
        children = [self._build(p, c) for p, c in zip(parts, routing, strict=True)]
        self.nodes.append((children, routing, radii, np.sqrt(((routing - centre) ** 2).sum(axis=1)), None))
        return len(self.nodes) - 1

    def visit(self, query: np.ndarray, floor: float) -> Iterator[int]:
        """Numbers of pages that may hold a score of ``floor`` or more, the most promising first."""
        q = query.astype(np.float64)
        length = float(np.sqrt(q @ q)) * (1 + 1e-12)
        reach = float(np.sqrt((self.centres**2).sum(axis=1)).max() + self.radii.max())
        least = floor - SLACK - 1e-12 * length * reach  # rounding of products grows with them
        waiting: list[tuple] = [(-np.inf, 0, self.top, float(self.root @ q), None)]
        turn = 1
        while waiting:
            _, _, number, product, page = heapq.heappop(waiting)
            if page is not None:
                yield page
                continue
            children, routing, radii, parent, rows = self.nodes[number]
            maybe = np.flatnonzero(product + length * (parent + radii) >= least)
            products = routing[maybe] @ q
            for i, own, bound in zip(maybe.tolist(), products.tolist(), (products + length * radii[maybe]).tolist(), strict=True):
                if bound >= least:
                    heapq.heappush(waiting, (-bound, turn, children[i] if children else -1, own, None if children else int(self.numbers[rows[i]])))
                    turn += 1


def usable(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, v (floor of ``scale`` times each component) and dim of the vectors that can take part.

    Left out: null ids, vectors that are null or empty, and those with null or non-finite components. A vector whose ``v``
    has a squared length of 2**63 or more is an error: its scores might not fit a long.
    """
    x = F.transform("embedding", lambda e: e.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter("vec_id is not null and x is not null and size(x) > 0")
    fine = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    floors = rows.filter(fine).select("vec_id", F.transform("x", lambda e: F.floor(e * scale)).alias("v"), F.size("x").alias("dim"))
    squared = F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))
    large = F.raise_error(F.concat(F.lit("vector "), F.col("vec_id").cast("string"), F.lit(" is too long: its scores might not fit a long")))
    return floors.select("vec_id", F.when(squared < (1 - 1e-9) * 2.0**63, F.col("v")).otherwise(large).alias("v"), "dim")


def _matrix(values) -> np.ndarray:
    return np.stack([np.asarray(v, np.int64) for v in values])


def top_k(candidates: DataFrame, queries: DataFrame, *, k: int = 10, page_rows: int = 4096, block_rows: int = 512, routing_rows: int = 256) -> DataFrame:
    """query_id, rank, vec_id and score: the ``k`` highest inner products of each query with candidates other than itself.

    Both inputs are as ``usable`` returns them; only vectors of equal dimension meet. Fewer candidates than ``k`` give
    all of them. A vec_id that repeats among candidates counts as often as it occurs. A page meets only the queries that
    it may have something for, in blocks of some ``block_rows``, and no more than ``k`` rows a query come out of it.
    """
    rows = staged(candidates.select("vec_id", "v", "dim"), "vectors")
    page_rows = max(page_rows, -(-rows.count() // MAX_PAGES))
    # a bounded sample: routing_rows vectors of whatever dimension, those with the smallest hashes
    sample = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(routing_rows).collect()
    routing = {d: (np.array([r["vec_id"] for r in sample if r["dim"] == d], np.int64), _matrix([r["v"] for r in sample if r["dim"] == d])) for d in {r["dim"] for r in sample}}

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = np.zeros(len(batch), np.int64)
            for dim in batch["dim"].unique():
                if dim in routing:
                    at = np.flatnonzero(batch["dim"] == dim)
                    points, objects = _matrix(batch["v"].iloc[at]).astype(float), routing[dim][1].astype(float)
                    out[at] = ((objects**2).sum(axis=1)[None, :] - 2 * points @ objects.T).argmin(axis=1)
            yield batch.assign(route=out)

    routed = staged(rows.mapInPandas(route, "vec_id long, v array<long>, dim int, route long"), "routed")
    counts = routed.groupBy("dim", "route").count().collect()  # a row for each routing vector
    parts = {(r["dim"], r["route"]): -(-r["count"] // page_rows) for r in counts}
    # small neighbours share a page, large ones take several
    number = F.coalesce(*[F.when((F.col("dim") == d) & (F.col("route") == r), F.pmod(F.xxhash64("vec_id", F.lit("page")), F.lit(n))) for (d, r), n in parts.items() if n > 1], F.lit(0))
    page_of, fill, last = {}, 0, 0
    for r in sorted(counts, key=lambda r: (r["dim"], r["route"])):
        key = (r["dim"], r["route"])
        if parts[key] == 1:
            if fill and (fill + r["count"] > page_rows or page_dim != r["dim"]):
                last, fill = last + 1, 0
            page_of[key], fill, page_dim = last, fill + r["count"], r["dim"]
    own = F.coalesce(*[F.when((F.col("dim") == d) & (F.col("route") == r), F.lit(p)) for (d, r), p in page_of.items()], F.lit(-1) - F.col("route"))
    paged = routed.withColumn("page", own.cast("long")).withColumn("part", number.cast("long"))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id", kind="stable")
        tree = MTree(group["vec_id"].to_numpy(), _matrix(group["v"]))
        centre = tree.root[0]
        radius = float(np.sqrt(((tree.real - centre) ** 2).sum(axis=1)).max())
        number = int(group["page"].iloc[0]) * (1 << 20) + int(group["part"].iloc[0])
        return pd.DataFrame({"dim": [int(group["dim"].iloc[0])], "page_no": [number], "centre": [centre], "radius": [radius], "tree": [tree.stored()]})

    pages = staged(paged.groupBy("dim", "page", "part").applyInPandas(build, "dim int, page_no long, centre array<double>, radius double, tree binary"), "pages")
    summary = pages.select("dim", "page_no", "centre", "radius").orderBy("page_no").collect()  # MAX_PAGES + routing_rows at most
    upper = {d: PageTree(*(np.array([r[c] for r in summary if r["dim"] == d]) for c in ("page_no", "centre", "radius"))) for d in {r["dim"] for r in summary}}
    asked = queries.select("vec_id", "v", "dim")
    blocks = max(1, -(-asked.count() // block_rows))

    def seeds(vec_id: int, v: np.ndarray) -> float:
        """The k-th best score of a query among the routing vectors."""
        known, objects = routing.get(len(v), (np.zeros(0, np.int64), np.zeros((0, len(v)), np.int64)))
        others = np.sort((objects @ v)[known != vec_id])
        return float(others[-k]) if len(others) >= k else -np.inf

    def promising(first: bool):
        def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for i, v, dim, floor in zip(batch["vec_id"].tolist(), batch["v"], batch["dim"].tolist(), batch["floor"].tolist(), strict=True):
                    if dim in upper:
                        q, tree = np.asarray(v, np.int64), upper[dim]
                        floor = max(seeds(i, q), -np.inf if np.isnan(floor) else floor)
                        best = next(tree.visit(q, -np.inf))
                        found = [best] if first else [p for p in tree.visit(q, floor) if p != best]
                        out += [(dim, p, i, q, floor) for p in found]
                yield pd.DataFrame(out, columns=["dim", "page_no", "vec_id", "v", "floor"])

        return choose

    def block(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id", kind="stable")
        return pd.DataFrame({"dim": [int(group["dim"].iloc[0])], "page_no": [int(group["page_no"].iloc[0])], "queries": [pickle.dumps((group["vec_id"].to_numpy(), _matrix(group["v"]), group["floor"].to_numpy()))]})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, questions in zip(batch.column("tree"), batch.column("queries"), strict=True):
                tree = MTree.loaded(blob.as_py())
                found = [(i, v, score) for i, q, floor in zip(*pickle.loads(questions.as_py()), strict=True) for score, v in tree.search(int(i), q, k, floor)[0]]
                columns = [[f[c] for f in found] for c in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    def searched(wanted: DataFrame, first: bool) -> DataFrame:
        """The best rows of one page, or of the others, for queries (vec_id, v, dim, floor)."""
        sent = wanted.mapInPandas(promising(first), "dim int, page_no long, vec_id long, v array<long>, floor double")
        sent = sent.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)))
        sent = sent.groupBy("dim", "page_no", "block").applyInPandas(block, "dim int, page_no long, queries binary")
        meeting = sent.join(pages.select("dim", "page_no", "tree"), ["dim", "page_no"])
        return meeting.select("tree", "queries").mapInArrow(search, "query_id long, vec_id long, score long")

    nearest = staged(searched(asked.withColumn("floor", F.lit(None).cast("double")), True), "nearest")
    floors = nearest.groupBy("query_id").agg(F.min("score").cast("double").alias("floor"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
    rest = searched(asked.join(floors.select(F.col("query_id").alias("vec_id"), "floor"), "vec_id", "left"), False)
    found = nearest.unionByName(rest)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
