"""Embedding near-duplicates: epsilon grid order join on leading principal dimensions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from columnade.llm.common import bounded_sample, discard, map_batches, written
from columnade.llm.components import connected_components, contract

#: Vectors of one sequence interval that is stored and joined as a whole, and intervals that are sent to another one together.
BLOCK, _PARTNERS = 4096, 16
#: Pairs of intervals are looked up by cells of at least this side on so many leading directions.
_SIDE, _LEADING = 0.25, 3
#: Intervals this short are compared by products; longer ones are halved first.
_LEAF = 128
_BLOCKS = pa.schema([("label", pa.string()), ("dims", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("ids", pa.binary()), ("sizes", pa.binary()), ("vectors", pa.binary())])
_FOUND = pa.schema([("kind", pa.int32()), ("u", pa.int64()), ("v", pa.int64())])


def principal(sample: np.ndarray, most: int = 6) -> np.ndarray:
    """Orthonormal leading principal directions of unit vectors (columns)."""
    if not len(sample):
        return np.zeros((sample.shape[1] if sample.ndim == 2 else 0, 0))
    x = sample - sample.mean(0)
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    return np.ascontiguousarray(vt[:most].T)


def join_blocks(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, same: bool, least: float, eps: float, hit) -> None:
    """Recursive join of two intervals of the sequence; ``hit(i, j)`` gets the row numbers of the pairs found.

    a, b: unit vectors; pa_, pb: their leading principal coordinates. Two
    intervals whose boxes lie more than eps apart hold no pair. ``same``: both
    are one interval, of which only pairs i < j are wanted.
    """

    def walk(i0: int, i1: int, j0: int, j1: int, own: bool) -> None:
        if not own:
            gap = np.maximum(0, np.maximum(pa_[i0:i1].min(0) - pb[j0:j1].max(0), pb[j0:j1].min(0) - pa_[i0:i1].max(0)))
            if (gap * gap).sum() > eps * eps:
                return
        if i1 - i0 <= _LEAF and j1 - j0 <= _LEAF:
            i, j = np.nonzero(a[i0:i1] @ b[j0:j1].T >= least)
            if own:
                keep = i < j
                i, j = i[keep], j[keep]
            if len(i):
                hit(i + i0, j + j0)
            return
        im, jm = (i0 + i1) // 2, (j0 + j1) // 2
        if own:
            walk(i0, im, i0, im, True)
            walk(i0, im, im, i1, False)
            walk(im, i1, im, i1, True)
        elif i1 - i0 >= j1 - j0:
            walk(i0, im, j0, j1, False)
            walk(im, i1, j0, j1, False)
        else:
            walk(i0, i1, j0, jm, False)
            walk(i0, i1, jm, j1, False)

    if len(a) and len(b):
        walk(0, len(a), 0, len(b), same)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; components of any finite size."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _block_batches(bases: dict[int, np.ndarray], size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made, held, key = TaskContext.get().partitionId() << 32, [], None

        def closed():
            label, dims = key
            ids, sizes, raw = (np.concatenate(x) for x in zip(*held, strict=True))
            p = _unit(raw) @ _basis(bases, dims)
            row = [label, dims, made, len(ids), p.min(0).tolist(), p.max(0).tolist(), ids.astype("<i8").tobytes(), sizes.astype("<i8").tobytes(), raw.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _BLOCKS.types, strict=True)], schema=_BLOCKS)

        count = 0
        for b in batches:
            col = {n: b.column(b.schema.get_field_index(n)) for n in ("label", "dims", "cls", "size", "embedding")}
            keys = list(zip(col["label"].to_pylist(), col["dims"].to_pylist(), strict=True))
            i = 0
            while i < len(keys):
                if key is not None and (keys[i] != key or count == size):
                    yield closed()
                    made, held, count = made + 1, [], 0
                key = keys[i]
                j = i
                while j < len(keys) and keys[j] == key and count + j - i < size:
                    j += 1
                e = col["embedding"].slice(i, j - i)
                held.append((col["cls"].slice(i, j - i).to_numpy(), col["size"].slice(i, j - i).to_numpy(), e.flatten().to_numpy().reshape(j - i, -1)))
                count += j - i
                i = j
        if count:
            yield closed()

    return run


def _basis(bases: dict[int, np.ndarray], dims: int) -> np.ndarray:
    return bases[dims] if dims in bases else np.zeros((dims, 0))


def _pair_batches(bases: dict[int, np.ndarray], kind: str, least: float, eps: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by home, part and role: one home block (role 0), then its partners; the home joins itself in part 0."""

        def read(r: dict):
            x = _unit(np.frombuffer(r["vectors"], kind).reshape(r["n"], -1))
            return x, x @ _basis(bases, r["dims"]), np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["sizes"], "<i8")

        def joined(home, other, same: bool) -> Iterator[pa.RecordBatch]:
            (a, p, ids, sizes), (c, q, ids2, sizes2) = home, other
            links, links2 = np.zeros(len(ids), np.int64), np.zeros(len(ids2), np.int64)
            forest: list[np.ndarray] = []

            def hit(i, j):
                np.add.at(links, i, sizes2[j])
                np.add.at(links2, j, sizes[i])
                forest.append(np.stack(contract(ids[i], ids2[j])))

            join_blocks(a, c, p, q, same, least, eps, hit)
            if forest:
                u, v = contract(*np.concatenate(forest, axis=1))
                who, n = np.concatenate([ids, ids2]), np.concatenate([links, links2])
                who, n = who[n > 0], n[n > 0]
                told = np.repeat(np.array([0, 1], np.int32), [len(who), len(u)])
                yield pa.RecordBatch.from_arrays([pa.array(told), pa.array(np.concatenate([who, u])), pa.array(np.concatenate([n, v]))], schema=_FOUND)

        home = None
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                if r["role"] == 0:
                    home = read(r)
                    if r["part"] == 0:
                        yield from joined(home, home, True)
                else:
                    yield from joined(home, read(r), False)

    return run


def _pairs_of_blocks(boxes: DataFrame, directions: int, eps: float) -> DataFrame:
    """``block, block2`` (block < block2): pairs of one label whose boxes lie within eps, looked up by neighbouring cells on the leading directions."""
    side = max(eps, _SIDE)
    cell = lambda x, k, more: (F.floor(F.coalesce(F.get(x, F.lit(k)), F.lit(0.0)) / side) + more).cast("long")
    keys = [f"cell{k}" for k in range(min(_LEADING, directions))]
    left = boxes
    right = boxes.select("label", "dims", F.col("block").alias("block2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    for k, name in enumerate(keys):
        left = left.withColumn(name, F.explode(F.sequence(cell("lo", k, -1), cell("hi", k, 1))))
        right = right.withColumn(name, F.explode(F.sequence(cell("lo2", k, 0), cell("hi2", k, 0))))
    gaps = F.zip_with(F.zip_with("lo", "hi2", lambda x, y: x - y), F.zip_with("lo2", "hi", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    near = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x) <= eps * eps
    return left.join(right, ["label", "dims", *keys]).where((F.col("block") < F.col("block2")) & near).select("block", "block2").distinct()


def near_duplicates(vectors: DataFrame, least: float = 0.98, block: int = BLOCK, sample: int = 4096, dims: int = 6) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors`` (vec_id, embedding, label).

    Rows link when their labels are equal and not null and their cosine, in
    double precision, is ``least`` or more. Equal vectors of one label (by 128
    bits of hash) are one class: its rows link with each other, and count in
    n_links as many times as they are. Vectors that are null, empty, zero or
    hold null or non-finite components link with nothing, nor do vectors of
    different length or rows with a null label or id.

    The classes are put in epsilon grid order: by label, then by cells of side
    eps (the distance of unit vectors at that cosine) on the leading principal
    directions, which come from a bounded sample (``sample`` classes by hash).
    The sequence is cut into blocks; pairs of blocks whose boxes lie within
    eps, found by cells on several directions, are joined recursively, skipping
    what is provably farther apart. A block is sent once to at most 16 partners
    together; a block pair gives counts and a forest, never its pairs.

    Rows that share a vec_id are rows of their own, linked by their own
    vectors only; component_id is the smallest vec_id of any row reachable. No
    rows give no rows; other columns are not read.
    """
    eps = float(np.sqrt(max(0.0, 2 - 2 * least))) * (1 + 1e-9) + 1e-12
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind, form = ("<f4", "float") if single else ("<f8", "double")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(f"array<{form}>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    # adding zero makes -0.0 and 0.0 one value
    rows = rows.withColumn("usable", usable).withColumn("embedding", F.when(usable, F.transform("embedding", lambda x: x + F.lit(0.0).cast(form))))
    keyed = rows.where("usable").select("vec_id", "label", F.size("embedding").alias("dims"), F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"), "embedding")
    key = ["label", "dims", "h1", "h2"]
    classes = keyed.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.first("embedding").alias("embedding"))
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
    got = bounded_sample(classes.select("h1", "dims", "embedding"), "h1", sample).select("dims", "embedding").toArrow()
    sizes = got.column("dims").to_numpy()
    some = got.column("embedding").to_pylist()
    bases = {int(d): principal(_unit(np.array([some[i] for i in np.flatnonzero(sizes == d)])), dims) for d in np.unique(sizes)}
    deep = max([b.shape[1] for b in bases.values()], default=0)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    cells = []
    for k in range(deep):
        axis = None
        for d, basis in bases.items():
            if k < basis.shape[1]:
                weights = F.array(*[F.lit(float(w)) for w in basis[:, k]])
                dot = F.aggregate(F.zip_with("embedding", weights, lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
                cell = F.floor(dot / norm / eps)
                axis = F.when(F.col("dims") == d, cell) if axis is None else axis.when(F.col("dims") == d, cell)
        cells.append(axis.alias(f"c{k}"))
    placed = classes.select("label", "dims", "cls", "size", "embedding", *cells)
    order = ["label", "dims", *[f"c{k}" for k in range(deep)], "cls"]
    ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = written(map_batches(ranged, _block_batches(bases, block), "label string, dims int, block long, n int, lo array<double>, hi array<double>, ids binary, sizes binary, vectors binary"), "vector-blocks")
    pairs = written(_pairs_of_blocks(blocks.select("label", "dims", "block", "lo", "hi"), deep, eps), "block-pairs")
    parts = pairs.groupBy("block").agg(F.ceil(F.count("*") / _PARTNERS).cast("int").alias("parts"))
    body = ["dims", "n", "ids", "sizes", "vectors"]
    homes = blocks.join(parts, "block", "left").select("block", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), F.lit(0).alias("role"), *body)
    sent = pairs.join(parts, "block").select(F.col("block").alias("home"), F.pmod(F.xxhash64("block2"), F.col("parts")).cast("int").alias("part"), F.col("block2").alias("block"))
    partners = sent.join(blocks, "block").select(F.col("home").alias("block"), "part", F.lit(1).alias("role"), *body)
    both = homes.unionByName(partners).repartition("block", "part").sortWithinPartitions("block", "part", "role")
    found = written(map_batches(both, _pair_batches(bases, kind, least, eps), "kind int, u long, v long"), "vector-links")
    counts = found.where("kind = 0").groupBy(F.col("u").alias("cls")).agg(F.sum("v").alias("links"))
    tied = connected_components(found.where("kind = 1").select("u", "v"))
    joined = tied.withColumnRenamed("node", "cls")
    known = classes.drop("embedding").join(counts, "cls", "left").join(joined, "cls", "left")
    known = written(known.select(*key, "rep", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "cls").alias("component")), "vector-components")
    discard(classes, blocks, pairs, found, tied)
    least_id = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = keyed.drop("embedding").join(known.join(least_id, "component").select(*key, "n_links", "component_id"), key).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
