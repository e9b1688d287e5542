"""Repeated passages: exact substring dedup on words, by difference-cover anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from columnade.llm.common import batch, map_batches, written
from columnade.llm.hashing import rolled, word_hashes

#: Difference covers: of any two positions, some shift below the period puts both on the cover.
COVERS = {7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: A task dedups so many anchors or windows in memory before it sends them.
_HELD = 3_000_000
#: Rows of one range of the hash at most, and characters of text that give one row at least.
_RANGE, _CHARS = 1_000_000, 8

_SENT = pa.schema([("bucket", pa.int32()), ("settled", pa.bool_()), ("data", pa.binary())])
_SPOT = pa.schema([("doc_id", pa.int64()), ("nth", pa.int32()), ("pos", pa.int32())])
_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The cover that needs the fewest anchors and leaves them at least a third of the window long."""
    period = max([p for p in COVERS if window - p + 1 >= max(1, window // 3)], default=0)
    return (period, COVERS[period]) if period else (1, (0,))


def _planes(rows: np.ndarray) -> bytes:
    """Rows of numbers as byte planes: the high bytes, mostly equal, lie together and shrink in the shuffle."""
    return np.ascontiguousarray(rows.view(np.uint8).reshape(len(rows), -1).T).tobytes()


def _from_planes(data: bytes, kind: np.dtype) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


#: A place is a document (its id, and the number of its text among the texts of that id) and a word in it.
_PLACE = np.dtype([("doc", "<i8"), ("nth", "<i4"), ("pos", "<i4")])
_KEYED = np.dtype([("h", "<u8"), ("g", "<u4"), *_PLACE.descr])


def _places(doc: int, nth: int, pos: np.ndarray) -> np.ndarray:
    out = np.empty(len(pos), _PLACE)
    out["doc"], out["nth"], out["pos"] = doc, nth, pos
    return out


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a["doc"] != b["doc"]) | (a["nth"] != b["nth"]) | (a["pos"] != b["pos"])


def _sent(h: np.ndarray, g: np.ndarray, place: np.ndarray, buckets: int, several: bool) -> Iterator[pa.RecordBatch]:
    """What a task has seen, by ranges of the hash.

    Of rows with one hash only the first goes out under it. The others recur
    for certain (the first too where ``several`` hashes alike are what counts):
    they go out as mere places, scattered evenly.
    """
    order = np.lexsort((place["pos"], place["nth"], place["doc"], g, h))
    h, g, place = h[order], g[order], place[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    at = np.flatnonzero(new)
    of = np.repeat(at, np.diff(np.append(at, len(h))))
    known = ~new & _differ(place, place[of])
    if several:
        known[of[known]] = True
    rows = np.zeros(len(at), _KEYED)
    rows["h"], rows["g"] = h[at], g[at]
    for name in _PLACE.names:
        rows[name] = place[name][at]
    places = place[known]
    bucket = (rows["h"] >> np.uint64(40)).astype(np.int64) * buckets >> 24
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    data = [(int(bucket[a]), False, _planes(rows[a:b])) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)], strict=True) if a < b]
    share = max(1000, -(-len(places) // buckets))
    shift = int(h[0] % np.uint64(buckets)) if len(h) else 0
    data += [((shift + i // share) % buckets, True, _planes(places[i : i + share])) for i in range(0, len(places), share)]
    for i in range(0, len(data), 500):
        yield batch(_SENT, *zip(*data[i : i + 500], strict=True))


def _met_batches(several: bool):
    """Places whose hash recurs, from rows that are sorted by bucket: every place of it, or all but the first."""

    def met(parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate([_from_planes(p, _KEYED) for p in parts])
        rows = rows[np.lexsort((rows["pos"], rows["nth"], rows["doc"], rows["g"], rows["h"]))]
        new = np.ones(len(rows), bool)
        new[1:] = (rows["h"][1:] != rows["h"][:-1]) | (rows["g"][1:] != rows["g"][:-1])
        at = np.flatnonzero(new)
        sizes = np.diff(np.append(at, len(rows)))
        differ = _differ(rows, rows[np.repeat(at, sizes)])
        # equal places are one row of the table met twice, and no recurrence
        yield from out(rows[np.repeat(np.logical_or.reduceat(differ, at), sizes) if several else differ])

    def out(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(rows), 100_000):
            yield batch(_SPOT, *(np.ascontiguousarray(rows[n][i : i + 100_000]) for n in _PLACE.names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts = None, []
        for b in batches:
            for k, settled, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if settled:
                    yield from out(_from_planes(data, _PLACE))
                    continue
                if k != bucket:
                    if parts:
                        yield from met(parts)
                    bucket, parts = k, []
                parts.append(data)
        if parts:
            yield from met(parts)

    return run


def _anchor_batches(window: int, buckets: int):
    period, cover = cover_for(window)
    width = window - period + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush():
            h, place = (np.concatenate(x) for x in zip(*held, strict=True))
            return _sent(h, np.zeros(len(h), np.uint32), place, buckets, True)

        for b in batches:
            for doc_id, nth, text, copy in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                words = [] if copy else words_of(text.as_py())
                if len(words) < window:
                    continue
                found = rolled(word_hashes(words, 0), width)
                at = np.arange(len(found))
                at = at[np.isin(at % period, cover)]
                held.append((found[at], _places(doc_id, nth, at)))
                size += len(at)
                if size >= _HELD:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return run


def _window_batches(window: int, buckets: int):
    period, _ = cover_for(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush():
            return _sent(*(np.concatenate(x) for x in zip(*held, strict=True)), buckets, False)

        for b in batches:
            for doc_id, nth, text, anchors in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                words = words_of(text.as_py())
                at = np.asarray(anchors.values.to_numpy(zero_copy_only=False), np.int64)
                n = len(words) - window + 1
                if n <= 0:
                    continue
                # every window that an anchor of its first `period` positions lies in
                mark = np.zeros(n + 1, np.int32)
                np.add.at(mark, np.clip(at - period + 1, 0, n), 1)
                np.add.at(mark, np.clip(at + 1, 0, n), -1)
                starts = np.flatnonzero(np.cumsum(mark)[:n] > 0)
                if not len(starts):
                    continue
                second = (rolled(word_hashes(words, 1), window)[starts] >> np.uint64(32)).astype(np.uint32)
                held.append((rolled(word_hashes(words, 0), window)[starts], second, _places(doc_id, nth, starts)))
                size += len(starts)
                if size >= _HELD:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return run


def covered(n_words: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which words the windows at ``starts`` cover."""
    mark = np.zeros(n_words + 1, np.int32)
    np.add.at(mark, starts, 1)
    np.add.at(mark, np.minimum(starts + window, n_words), -1)
    return np.cumsum(mark)[:n_words] > 0


def _kept_batches(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, sha = [], [], []
            for text, starts, copy in zip(b.column(1), b.column(2), b.column(3).to_pylist(), strict=True):
                words = words_of(text.as_py())
                total = len(words)
                if copy:
                    words = words if total < window else []
                elif starts.is_valid:
                    gone = covered(total, np.asarray(starts.values.to_numpy(zero_copy_only=False), np.int64), window)
                    words = [words[i] for i in np.flatnonzero(~gone).tolist()]
                n_words.append(total)
                n_removed.append(total - len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield batch(_KEPT, b.column(0), n_words, n_removed, sha)

    return run


def kept_text(text: str | None, starts: np.ndarray | None, window: int) -> str | None:
    """``text`` without the words that the windows at ``starts`` cover; what stays between two cuts keeps its white space."""
    if text is None or starts is None or not len(starts):
        return text
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    gone = covered(len(words), np.asarray(starts, np.int64), window)
    cuts = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]]).astype(np.int8)))  # run borders: kept runs are pairs
    parts, end, offsets = [], 0, []
    for w in words:
        begin = raw.index(w, end)
        end = begin + len(w)
        offsets.append((begin, end))
    for a, b in zip(cuts[::2].tolist(), cuts[1::2].tolist(), strict=True):
        parts.append(raw[offsets[a][0] : offsets[b - 1][1]])
    return b" ".join(parts).decode("utf-8", "surrogatepass")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text); columns that are so named and typed stay as they are, so that all uses of the table share one exchange."""
    want = ((id_col, "doc_id", "bigint"), (text_col, "text", "string"))
    kinds = dict(docs.dtypes)
    return docs.select(*[F.col(old) if (old, kinds[old]) == (new, kind) else F.col(old).cast(kind).alias(new) for old, new, kind in want])


def _shared_ids(keys: DataFrame) -> DataFrame | None:
    """``doc_id, k, nth``: the numbers of the different texts of each doc_id that has several; None where none has."""
    shared = keys.groupBy("doc_id").agg(F.min("k").alias("a"), F.max("k").alias("b")).where("a < b").select("doc_id")
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("k"))
    nth = written(keys.join(shared, "doc_id", "left_semi").select("doc_id", "k").distinct().withColumn("nth", order - 1), "shared-ids")
    return None if nth.isEmpty() else nth


def _numbered(rows: DataFrame, shared: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", name: str = "nth") -> DataFrame:
    """``rows`` with the number of each one's text among those of its id (0 where the id has one text) as column ``name``."""
    if shared is None:
        return rows.withColumn(name, F.lit(0))
    told = shared.select(F.col("doc_id").alias(f"{name}__id"), F.col("k").alias(f"{name}__k"), F.col("nth").alias(f"{name}__nth"))
    met = (rows[id_col].cast("long") == told[f"{name}__id"]) & (F.unhex(F.sha2(rows[text_col].cast("string"), 256)) == told[f"{name}__k"])
    return rows.join(told, met, "left").withColumn(name, F.coalesce(f"{name}__nth", F.lit(0))).drop(*told.columns)


def repeated_windows(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(doc_id, nth, text) without null ids, (doc_id, nth, starts, copy) of the documents that repeat something, and :func:`_shared_ids`.

    A document is an id and one text of it; nth numbers the texts of one id. A
    document with the text of a smaller doc_id is a copy; it is named, and
    takes no further part (its first has every window earlier). Of the others,
    starts lists the windows whose words also start earlier.

    Anchors are runs of ``window - period + 1`` words at the positions of a
    difference cover modulo the period. Two equal windows share an anchor at
    one shift below the period, so only windows that hold an anchor that
    recurs can recur. Those are compared whole, by 96 bits of hash. Each task
    first settles what recurs within it and sends one row per different anchor
    or window under its hash, so the commonest passage is as many rows of one
    key as there are tasks. A task takes one range of the hash at a time; there
    are so many ranges that each holds about ``_RANGE`` rows at most.
    """
    text = _texts(docs, id_col, text_col).where("doc_id is not null")
    keys = written(text.where("text is not null").select("doc_id", F.unhex(F.sha2("text", 256)).alias("k"), F.length("text").cast("long").alias("chars")), "text-keys")
    shared = _shared_ids(keys)
    text = _numbered(text, shared).select("doc_id", "nth", "text")
    if shared is None:
        keys = keys.withColumn("nth", F.lit(0))
    else:
        keys = keys.join(shared, ["doc_id", "k"], "left").fillna(0, "nth")
    firsts = written(keys.groupBy("k").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last"), "first-copies")
    copies = written(keys.join(firsts, "k").where("doc_id > first").select("doc_id", "nth").distinct(), "copies")
    chars = keys.agg(F.sum("chars")).first()[0] or 0
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(1 << 22, max(4 * partitions, -(-chars // (_CHARS * _RANGE)), 1))
    marked = text.join(copies.withColumn("copy", F.lit(True)), ["doc_id", "nth"], "left").select("doc_id", "nth", "text", "copy")
    by_range = lambda sent: sent.repartition("bucket").sortWithinPartitions("bucket")
    anchors = by_range(map_batches(marked, _anchor_batches(window, buckets), "bucket int, settled boolean, data binary"))
    spots = map_batches(anchors, _met_batches(True), "doc_id long, nth int, pos int").groupBy("doc_id", "nth").agg(F.collect_list("pos").alias("anchors"))
    windows = by_range(map_batches(text.join(spots, ["doc_id", "nth"]).select("doc_id", "nth", "text", "anchors"), _window_batches(window, buckets), "bucket int, settled boolean, data binary"))
    starts = map_batches(windows, _met_batches(False), "doc_id long, nth int, pos int").groupBy("doc_id", "nth").agg(F.collect_list("pos").alias("starts"))
    known = starts.select("doc_id", "nth", "starts", F.lit(False).alias("copy")).unionByName(copies.select("doc_id", "nth", F.lit(None).cast("array<int>").alias("starts"), F.lit(True).alias("copy")))
    return text, known, shared


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row.

    A word goes if a window of ``window`` consecutive words covers it whose
    word sequence also starts earlier: in a smaller doc_id, or before it in the
    same document; windows are judged on the input. Null and empty texts have
    no words (digest of the empty string); a null doc_id takes no part and
    loses nothing. Rows that share a doc_id and a text are one document, and
    get the same result each; those of one doc_id with different texts are
    documents of their own, none of them earlier by its id: between them a
    fixed order of the texts (by a hash) decides which comes first. No rows
    give no rows; other columns are not read.
    """
    text, known, _ = repeated_windows(docs, window, id_col, text_col)
    nameless = docs.where(F.col(id_col).isNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.lit(None).cast("array<int>").alias("starts"), F.lit(None).cast("boolean").alias("copy"))
    rows = text.join(known, ["doc_id", "nth"], "left").select("doc_id", "text", "starts", "copy").unionByName(nameless)
    return map_batches(rows, _kept_batches(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """``docs`` (columns of documents) with repeated passages cut out of ``text`` and ``n_chars`` renewed; a document of which nothing stays goes.

    Documents that lose nothing keep their text unchanged, white space and
    all; null and empty texts and rows without an id stay as they are; rows
    that share a doc_id are taken as :func:`remove_repeats` takes them; other
    columns may have any name; no rows give no rows.
    """
    _, known, shared = repeated_windows(docs, window)
    fields = list(docs.schema.fields)
    names = [f.name for f in fields]
    schema = pa.schema([("text", pa.string()), ("n_chars", pa.int64()), ("stays", pa.bool_())])
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, sizes, stays = [], [], []
            for t, s, copy in zip(b.column(at), b.column(len(names)), b.column(len(names) + 1).to_pylist(), strict=True):
                old = t.as_py()
                starts = np.asarray(s.values.to_numpy(zero_copy_only=False)) if s.is_valid else None
                new = "" if copy and len(words_of(old)) >= window else kept_text(old, starts, window)
                texts.append(new)
                sizes.append(None if new is None else len(new))
                stays.append(new != "" or not old)
            made = batch(schema, texts, sizes, stays)
            columns = [made.column(0) if n == "text" else made.column(1) if n == "n_chars" else b.column(i) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(made.column(2))

    types = {"text": "string", "n_chars": "long"}
    out = ", ".join(f"`{f.name.replace('`', '``')}` {types.get(f.name, f.dataType.simpleString())}" for f in fields)
    lead = "cut"
    while any(n.lower().startswith(lead) for n in names):
        lead += "_"
    mine = known.select(F.col("doc_id").alias(f"{lead}id"), F.col("nth").alias(f"{lead}n"), F.col("starts").alias(f"{lead}starts"), F.col("copy").alias(f"{lead}copy"))
    told = _numbered(docs, shared, name=f"{lead}nth")
    joined = told.join(mine, (told["doc_id"].cast("long") == mine[f"{lead}id"]) & (told[f"{lead}nth"] == mine[f"{lead}n"]), "left")
    return map_batches(joined.select(*[F.col(f"`{n.replace('`', '``')}`") for n in names], f"{lead}starts", f"{lead}copy"), run, out)
