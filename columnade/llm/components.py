"""Connected components of a large graph, by rounds of star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from columnade.llm.common import batch, discard, map_batches, written

_PAIR = pa.schema([("u", pa.int64()), ("v", pa.int64())])
#: A task contracts so many links at a time.
_HELD = 2_000_000
#: A file of links holds about so many at least: a store makes, and a local one starts a process for, every file.
_FILE = 1 << 17


def contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component) that say the same as the links u-v."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        open_ = low != high
        if not open_.any():
            break
        np.minimum.at(root, high[open_], low[open_])
        while True:  # jump until every node points at a root
            up = root[root]
            if (up == root).all():
                break
            root = up
    member = root != np.arange(len(nodes))
    return nodes[member], nodes[root[member]]


def _contract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        size += b.num_rows
        if size >= _HELD:
            u, v = contract(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield batch(_PAIR, u, v)
            held, size = [], 0
    if size:
        u, v = contract(*(np.concatenate(x) for x in zip(*held, strict=True)))
        for i in range(0, len(u), 100_000):
            yield batch(_PAIR, u[i : i + 100_000], v[i : i + 100_000])


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component_id`` for every node that occurs in ``links`` (columns u, v: long).

    component_id is the smallest node reachable. Each round contracts the links
    that lie in one task to stars, then hangs every neighbour of a node on the
    smallest one (first the larger neighbours, then the rest). A node with very
    many links is a row of partial minima and a join that Spark can split; the
    links of one star go to as many tasks as there are millions of links
    (``_HELD``), so no task or driver ever needs a whole component. An empty
    table gives an empty table; links of a node with itself are ignored,
    repeated links count once.
    The result can be given to :func:`columnade.llm.common.discard`.
    """
    ordered = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = written(map_batches(ordered.distinct(), _contract_batches, "u long, v long"), "links")
    sign = None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if mark == sign or mark[0] == 0:
            break
        sign = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        larger = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = larger.groupBy("u").agg(F.min("v").alias("m"))
        hung = larger.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        last, now = now, written(map_batches(stars.repartition("v", F.pmod(F.xxhash64("u"), F.lit(1 + mark[0] // _HELD))), _contract_batches, "u long, v long").distinct().coalesce(1 + mark[0] // _FILE), "links")
        discard(last)
    roots = now.select(F.col("v").alias("node")).distinct()
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component_id")).unionByName(roots.select("node", F.col("node").alias("component_id")))
    found._columnade_path = now._columnade_path  # what stands behind it can be discarded
    return found
