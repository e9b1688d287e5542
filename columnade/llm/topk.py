"""Exact top-k inner products from an impact-ordered index, score at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from columnade.llm.common import map_batches

#: Components of one index shard at most, and rows that are not cut into more shards for their own sake; queries of one block.
SHARD, FEW, QUERIES = 1 << 21, 4096, 1024
#: Impact levels of each dimension; after these shares of the postings a search looks what it has proved.
LEVELS, LOOKS = 256, (0.5, 0.75, 1.0)
#: Accumulators of one search at most.
_CELLS = 1 << 22
_TOP = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


class ImpactIndex:
    """Postings of integer vectors by dimension, cut into levels of equal width.

    A query with a positive weight reads a dimension's levels from the top,
    one with a negative weight from the bottom; either way an impact is the
    level's distance from the far end, so impacts are never negative.
    """

    def __init__(self, ids: np.ndarray, values: np.ndarray, levels: int = LEVELS):
        self.ids, self.values, self.levels = ids, values, levels
        self.low, self.high = values.min(0), values.max(0)
        self.width = np.maximum(1, -(-(self.high - self.low + 1) // levels))
        self.level = ((values - self.low) // self.width).T.astype(np.int16)  # 0 .. levels-1, a dimension a row
        #: Rows of each dimension by level, and how many of them each level has
        self.postings = np.argsort(self.level, axis=1, kind="stable")
        self.sizes = np.stack([np.bincount(d, minlength=levels) for d in self.level])
        self.early = True  # whether a look before the last one may still pay

    def search(self, queries: np.ndarray, k: int, skips: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (row) the k best (ids, scores), ties to the smaller id; rows with its id of ``skips`` take no part."""
        step = max(1, _CELLS // max(len(self.ids), 2 * k * self.values.shape[1]))
        return [x for i in range(0, len(queries), step) for x in self._search(queries[i : i + step], k, skips[i : i + step])]

    def _search(self, queries: np.ndarray, k: int, skips: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """A block of queries.

        Segments (dimension, level) are processed by descending impact, the
        largest that any query of the block gives them; each adds the least
        its postings can be worth to each query, all of a share of the
        postings by one product of matrices whose sums are whole numbers that
        the float type holds. What is left can add no more than the best open
        level of every dimension. At each look the rows that lead are scored
        exactly; a row that cannot reach the k-th of their scores any more is
        proved out. Once few rows are left, or no segment, the possible
        members are rescored exactly. Where no earlier look ends a block,
        later blocks of this index look at the end only.
        """
        n, levels = len(self.ids), self.levels
        most_left = max(8 * k, n // 8)
        unit = np.abs(queries) * self.width
        at = np.flatnonzero(np.isin(self.ids, skips))
        own = np.nonzero(skips[:, None] == self.ids[at])
        own = own[0], at[own[1]]
        bound = float(unit.astype(float).sum(1).max(initial=0)) * levels
        possible = None
        if n - np.bincount(own[0], minlength=len(queries)).max(initial=0) > most_left and bound < 2.0**52:
            kind = np.float32 if bound < 2.0**23 else np.float64
            up = queries > 0
            rising, falling = np.where(up, unit, 0).astype(kind), np.where(up, 0, unit).astype(kind)
            worth = np.arange(levels)
            impact = np.maximum(rising.max(0)[:, None] * worth, falling.max(0)[:, None] * worth[::-1])
            base = (queries * np.where(up, self.low, self.low + self.width * levels - 1)).sum(1)
            slack = (np.abs(queries) * (self.width - 1)).sum(1)
            order = np.argsort(-impact.ravel(), kind="stable")
            done = np.cumsum(self.sizes.ravel()[order])
            open_ = np.ones(impact.shape, bool)
            acc = np.zeros((len(queries), n), kind)
            for part in np.split(order, np.searchsorted(done, np.array(LOOKS[:-1]) * done[-1])) if self.early else [order]:
                acc += self._gains(part, rising, falling)
                open_.ravel()[part] = False
                top = np.where(open_, worth, 0).max(1)
                rest = unit * np.where(up, top, np.where(open_, worth[::-1], 0).max(1))
                acc[own] = -1
                lead = _leaders(acc, 2 * k, 8 * k)
                exact = np.einsum("qrd,qd->qr", self.values[lead], queries) - base[:, None]
                exact[np.take_along_axis(acc, lead, 1) < 0] = -1
                least = np.sort(exact, axis=1)[:, -k] - slack - rest.sum(1)
                possible = acc >= np.clip(least, 0, 1 << 52).astype(kind)[:, None]
                if possible.sum(1).max() <= most_left:
                    break
            self.early = open_.any()
        if possible is None:
            possible = np.ones((len(queries), n), bool)
            possible[own] = False
        found = []
        for query, hit in zip(queries, possible, strict=True):
            members = np.flatnonzero(hit)
            score, ids = self.values[members] @ query, self.ids[members]
            best = np.lexsort((ids, -score))[:k]
            found.append((ids[best], score[best]))
        return found

    def _gains(self, part: np.ndarray, rising: np.ndarray, falling: np.ndarray) -> np.ndarray:
        """What the postings of some segments add to each row (column) for each query (row)."""
        far = self.levels - 1
        if len(part) == self.sizes.size:
            return (rising - falling) @ self.level.astype(rising.dtype) + far * falling.sum(1)[:, None]
        taken = np.zeros(self.sizes.size, bool)
        taken[part] = True
        dims, at = np.divmod(np.flatnonzero(np.repeat(taken, self.sizes.ravel())), len(self.ids))
        rows = self.postings[dims, at]
        gains = np.zeros((2, *self.level.shape), rising.dtype)
        gains[0, dims, rows] = self.level[dims, rows]
        gains[1, dims, rows] = far - gains[0, dims, rows]
        return rising @ gains[0] + falling @ gains[1]


def _leaders(acc: np.ndarray, count: int, least: int) -> np.ndarray:
    """``count`` different columns of each row that are among its largest: the best of each of ``least`` runs of columns at least, of these the largest."""
    run = min(64, acc.shape[1] // least)
    whole = acc[:, : acc.shape[1] // run * run].reshape(len(acc), -1, run)
    best = whole.max(2)
    lead = np.argpartition(best, best.shape[1] - count, axis=1)[:, -count:]
    return lead * run + np.take_along_axis(whole, lead[:, :, None], 1).argmax(2)


def _gathered(rows: DataFrame, count: int, name: str) -> DataFrame:
    """Rows (vec_id, dims, v) gathered by a hash of vec_id into ``count`` blocks of each vector length."""
    block = F.pmod(F.xxhash64("vec_id"), F.lit(count)).alias(name)
    return rows.select("dims", block, "vec_id", "v").groupBy("dims", name).agg(F.collect_list(F.struct("vec_id", "v")).alias(f"{name}_rows"))


def _matrix(column: pa.ListArray, row: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of one gathered block."""
    part = column[row].values
    return part.field(0).to_numpy(), part.field(1).flatten().to_numpy().reshape(-1, dims)


def top_k(vectors: DataFrame, k: int = 5, queries_where: str = "vec_id % 50 = 0", scale: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best rows by integer inner product, ties to the smaller vec_id.

    Components become floor(scale * x) in double precision. Queries are the
    rows that ``queries_where`` names, candidates all rows but the query's own.
    Rows are dealt by a hash of their id to shards, each with an index of its
    own; every block of queries is sent to every shard, each meeting gives its
    own k best, and the k best of those are the result.

    Vectors that are null, empty or hold null or non-finite components take no
    part, nor do rows without an id; vectors of different length do not meet.
    Nor do vectors whose scores could leave 64 bits: those of d components with
    one of sqrt(2^62 / d) or more after scaling. A repeated vec_id is candidates of their own for other queries, and
    once a query: its shortest vector, of these the smallest. Fewer candidates
    than k: all of them. No rows give no rows; other columns are not read.
    """
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fits = F.forall(e, lambda x: F.abs(F.floor(x * scale).cast("double")) < F.sqrt(F.lit(2.0**62) / F.size("embedding")))
    usable = vectors.where(F.col("vec_id").isNotNull() & F.coalesce(finite & fits, F.lit(False)) & (F.size("embedding") > 0))
    rows = usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dims"), F.transform(e, lambda x: F.floor(x * scale).cast("long")).alias("v"))
    size = usable.agg(F.count("*").alias("n"), F.sum(F.expr(queries_where).cast("long")).alias("asked"), F.max(F.size("embedding")).alias("dims")).first()
    most = max(1, SHARD // (size.dims or 1))
    most = min(most, max(FEW, size.n // 64))  # smaller tables are cut too, so that tasks can share the work
    n_shards, n_asks = max(1, -(-size.n // most)), max(1, -(-(size.asked or 0) // min(most, QUERIES)))
    shards = _gathered(rows, n_shards, "shard")
    asked = _gathered(rows.where(queries_where).groupBy("vec_id").agg(F.min(F.struct("dims", "v")).alias("q")).select("vec_id", "q.dims", "q.v"), n_asks, "ask")
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, index = None, None
        for b in batches:
            for i, (d, shard) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if held != (d, shard):
                    index, held = ImpactIndex(*_matrix(b.column(2), i, d)), (d, shard)
                asks, weights = _matrix(b.column(3), i, d)
                found = index.search(weights, k, asks)
                out = [np.repeat(asks, [len(f[0]) for f in found])], [f[0] for f in found], [f[1] for f in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], schema=_TOP)

    meetings = shards.join(asked, ["dims", "shard"]).select("dims", "shard", "shard_rows", "ask_rows")
    found = map_batches(meetings, run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
