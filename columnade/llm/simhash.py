"""SimHash near-duplicates by deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from columnade.llm.common import batch, discard, map_batches, written
from columnade.llm.components import connected_components

_FINGER = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_LINK = pa.schema([("u", pa.int64()), ("v", pa.int64())])
#: Groups up to this size are compared at every distance in one sweep over all groups.
_SWEEP = 16
#: Larger groups than this are first cut by the other half's variants.
_DIRECT = 4096
_PART = 1 << 16
#: A half that more different fingerprints share has its variants cut further, over tasks.
_HOT = 1 << 15


def _set_bits(hashes: np.ndarray) -> np.ndarray:
    """In how many of the hashes each bit is set."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def majority(hashes: np.ndarray) -> int:
    """The SimHash of 64-bit hashes: the bits that are set in over half of them; of none: zero."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _PART):
        counts += _set_bits(hashes[i : i + _PART])
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of word shingles.

    A-Z are lower-cased, words are runs of anything but ASCII white space, and
    every occurrence of a shingle counts. Fewer words than a shingle: the whole
    sequence is the one shingle. No word (null and empty texts too): zero.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    m = n - shingle + 1
    first, last = starts[:m].tolist(), ends[shingle - 1 :].tolist()
    for i in range(0, m, _PART):
        h = np.fromiter([digest(view[a:b], seed) for a, b in zip(first[i : i + _PART], last[i : i + _PART], strict=True)], np.uint64)
        counts += _set_bits(h)
    return int(np.packbits(counts * 2 > m, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
        yield batch(_FINGER, b.column(0), found.view(np.int64))


def _canonical(a: np.ndarray, b: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether a-b link (3 bits at most) and ``key`` is the one variant that speaks for the pair.

    Each link belongs to exactly one of the variants that its two ends share:
    of the first half that differs in at most one bit, that bit (bit 0 where
    the halves agree).
    """
    x = a ^ b
    halves = (x >> np.uint64(32), x & np.uint64(0xFFFFFFFF))
    near = np.bitwise_count(x) <= 3
    high = np.bitwise_count(halves[0]) <= 1
    half = np.where(high, halves[0], halves[1])
    bit = np.where(half == 0, 0, np.bitwise_count(half - np.uint64(1)))
    return near & (key == np.where(high, 0, 32) + bit)


def _bfs(values: np.ndarray, ids: np.ndarray, key: int, out: list) -> None:
    """A spanning forest of one group: every value is taken out of the rest once."""
    rest = np.arange(len(values))
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            i = front.pop()
            hit = _canonical(values[i], values[rest], np.int64(key))
            if hit.any():
                new = rest[hit]
                out.append(np.stack([np.full(len(new), ids[i]), ids[new]]))
                front.extend(new.tolist())
                rest = rest[~hit]


def _link_group(values: np.ndarray, ids: np.ndarray, key: int, out: list) -> None:
    """The forest of one large group, exactly: a group of over _DIRECT values is cut by variants of the other half.

    That half differs by at most three bits in a link, so one of its two
    16-bit quarters differs in at most one: each of the 32 one-wildcard
    variants of the quarters gives smaller groups that hold every link.
    """
    if len(values) <= _DIRECT:
        _bfs(values, ids, key, out)
        return
    other = 0 if key < 32 else 32
    for quarter in (0, 16):
        part = (values >> np.uint64(other + quarter)) & np.uint64(0xFFFF)
        for bit in range(16):
            masked = part & ~np.uint64(1 << bit)
            order = np.argsort(masked, kind="stable")
            cuts = np.flatnonzero(np.diff(masked[order])) + 1
            for group in np.split(order, cuts):
                if len(group) > 1:
                    _bfs(values[group], ids[group], key, out)


def _sweep(keys: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """Links (pairs of fingerprints) of rows that are sorted by key and hold whole groups."""
    ids = fps.view(np.int64)
    out: list[np.ndarray] = []
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    size = np.repeat(sizes, sizes)
    small = (size > 1) & (size <= _SWEEP)
    k, f, n = keys[small], fps[small], ids[small]
    for step in range(1, _SWEEP):
        if step >= len(k):
            break
        at = np.flatnonzero(k[step:] == k[:-step])
        if not len(at):
            break
        hit = at[_canonical(f[at], f[at + step], k[at] >> 32)]
        out.append(np.stack([n[hit], n[hit + step]]))
    for s in np.flatnonzero(sizes > _SWEEP):
        a, b = starts[s], starts[s] + sizes[s]
        _link_group(fps[a:b], ids[a:b], int(keys[a] >> 32), out)
    return np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [np.zeros(0, np.int64)] * 2
    for b in batches:
        held = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, b.columns, strict=True)]
        if len(held[0]) < 200_000:
            continue
        whole = np.searchsorted(held[0], held[0][-1])  # the last group may go on in the next batch
        if whole:
            yield batch(_LINK, *_sweep(held[0][:whole], held[1][:whole].view(np.uint64)))
            held = [h[whole:] for h in held]
    if len(held[0]):
        yield batch(_LINK, *_sweep(held[0], held[1].view(np.uint64)))


def _hot_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows (key, part, fp) that are sorted by key and part."""

    def linked(key: int, parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        values, out = np.concatenate(parts), []
        _bfs(values.view(np.uint64), values, key >> 32, out)
        if out:
            yield batch(_LINK, *np.concatenate(out, axis=1))

    last, held = None, []
    for b in batches:
        key, part, fp = (c.to_numpy() for c in b.columns)
        cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(part) != 0)) + 1
        for i, j in pairwise([0, *cuts.tolist(), b.num_rows]):
            here = (int(key[i]), int(part[i])) if i < j else last
            if here != last and held:
                yield from linked(last[0], held)
                held = []
            last = here
            held.append(fp[i:j])
    if held:
        yield from linked(last[0], held)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) for every row."""
    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), _fingerprints, "doc_id long, fp long")


def _halves(fp: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF))


def _without(value: Column, bit: Column) -> Column:
    return value.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), bit)))


def _variant(k: Column, half: Column) -> Column:
    """Variant k (0 to 63) of a fingerprint as one number: k and the high (k < 32) or low half without bit k mod 32."""
    return F.shiftleft(k.cast("long"), 32).bitwiseOR(_without(half, k % 32))


def fingerprint_components(nodes: DataFrame, hot: int = _HOT) -> DataFrame:
    """``node, component_id`` (fingerprints as signed longs, the component's smallest) of every different ``fp`` of ``nodes`` that links with another.

    A variant holds the fingerprints of two values of a half. Where a value is
    shared by more than ``hot`` of them, its variants are cut once more, by the
    32 one-wildcard variants of the other half's quarters, of which every link
    has one in common; so no task takes a whole hot variant.
    """
    high, low = _halves(F.col("fp"))
    values = nodes.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("first"), high.alias("half")), F.struct(F.lit(32).alias("first"), low.alias("half")))).alias("v"))
    crowded = values.groupBy("v").count().where(F.col("count") > hot).select("v.first", "v.half")
    crowded = written(crowded.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: _variant(F.col("first") + i, F.col("half")))).alias("key")).distinct(), "hot-variants")
    keys = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: _variant(k, F.when(k < 32, high).otherwise(low)))
    index = nodes.select(F.explode(keys).alias("key"), "fp")
    if crowded.isEmpty():
        return connected_components(map_batches(index.repartition("key").sortWithinPartitions("key"), _links, "u long, v long"))
    cold = index.join(crowded, "key", "left_anti")
    links = map_batches(cold.repartition("key").sortWithinPartitions("key"), _links, "u long, v long")
    other = F.when(F.shiftright("key", 32) < 32, low).otherwise(high)
    quarter = lambda i: F.when(i < 16, other.bitwiseAND(F.lit(0xFFFF))).otherwise(F.shiftright(other, 16))
    part = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.shiftleft(i.cast("long"), 16).bitwiseOR(_without(quarter(i), i % 16)))
    cut = index.join(crowded, "key", "left_semi").select("key", F.explode(part).alias("part"), "fp")
    hot_links = map_batches(cut.repartition("key", "part").sortWithinPartitions("key", "part"), _hot_links, "u long, v long")
    return connected_components(links.unionByName(hot_links))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``.

    Fingerprints link at three or fewer differing bits. A fingerprint is cut
    into two halves, of which one differs in at most one bit in any link; each
    half is indexed under its 32 variants with one bit left out, rows are
    joined on equal variants and verified. Equal fingerprints are one node, so
    copies never meet in a group; groups of any size give a spanning forest,
    never all their pairs.

    Null and empty texts have fingerprint zero and link like any other; a null
    doc_id stays a row of its own fingerprint's component, makes no links and
    is never its smallest id; rows that share a doc_id are kept apart, each
    with the component of its own fingerprint; no rows give no rows; other
    columns of ``docs`` are not read.
    """
    prints = written(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprint-nodes")
    found = fingerprint_components(nodes.where("rep is not null").select("fp"))
    known = written(nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "rep", F.coalesce("component_id", "fp").alias("component")), "fingerprint-components")
    discard(nodes, found)
    least = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    return prints.join(known.join(least, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id``: the fingerprint as 16 hex digits."""
    return simhash_components(docs, id_col, text_col).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (columns as given) whose doc_id is the smallest of its component.

    Rows that share a doc_id stay or go together: they stay where the id is
    the smallest of the component of any of their texts. Rows without an id
    stay; no rows give no rows.
    """
    found = simhash_components(docs).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
