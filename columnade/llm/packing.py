"""Packing documents into training sequences: bounded-space online best fit."""

from __future__ import annotations

import bisect
import functools
import itertools
import json
import os
import sys
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from columnade.llm.common import keeps, map_batches, written
from columnade.llm.remembered import Remembered, blocks

#: What the word-by-word way relies on, as the tokenizer file states it; a file that states other steps is refused.
_NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENISER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: Words remembered, and bytes of text looked at together (one text at least).
_MEMO, _AT_ONCE = 400_000, 4 << 20
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
#: Closed sequences that are sent together.
_CLOSED = 256
#: Leftover pieces are merged in groups of about so many.
_GROUP = 2000
_PIECE_TYPES = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("left", pa.bool_())]
_PIECE = pa.schema(_PIECE_TYPES)
_PIECE_IDS = pa.schema([*_PIECE_TYPES, ("ids", pa.binary())])


def _byte_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower case of each byte, its class, and the classes of what follows the lead bytes C2 and C3 (U+0080 to U+00FF)."""
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    kind = np.full(256, _OTHER, np.uint8)
    kind[97:123], kind[48:58], kind[9:14], kind[32] = _LETTER, _NUMBER, _SPACE, _SPACE
    after_c2, after_c3 = np.full(256, _OTHER, np.uint8), np.full(256, _LETTER, np.uint8)
    after_c2[[0xAA, 0xB5, 0xBA]] = _LETTER
    after_c2[[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = _NUMBER
    after_c2[[0x85, 0xA0]] = _SPACE
    after_c3[[0x97, 0xB7]] = _OTHER
    return low, kind, after_c2, after_c3


_LOW, _KIND, _AFTER_C2, _AFTER_C3 = _byte_tables()


def pre_tokens(raw: np.ndarray, cuts: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """What the pre-tokenizer makes of UTF-8 texts that stand end to end in ``raw``, text i from cuts[i] to cuts[i + 1].

    Returns the pre-tokens, A-Z in lower case, and how many come before each
    cut. A run between white space that holds a character beyond U+00FF is
    left whole, for the library to cut.
    """
    size = len(raw)
    low = _LOW[raw]
    kind = _KIND[low]
    odd = np.flatnonzero(low >= 0x80)
    if len(odd):
        lead = low[odd]
        for mark, after in ((0xC2, _AFTER_C2), (0xC3, _AFTER_C3)):
            at = odd[lead == mark]
            kind[at] = kind[at + 1] = after[low[at + 1]]
        at = odd[(lead >= 0xE1) & (lead <= 0xE3)]
        code = (low[at].astype(np.int32) & 15) << 12 | (low[at + 1].astype(np.int32) & 63) << 6 | (low[at + 2] & 63)
        blank = (code == 0x1680) | ((code >= 0x2000) & (code <= 0x200A)) | (code == 0x2028) | (code == 0x2029) | (code == 0x202F) | (code == 0x205F) | (code == 0x3000)
        at = at[blank]
        kind[at] = kind[at + 1] = kind[at + 2] = _SPACE
    ink = kind != _SPACE
    start = np.ones(size, bool)
    start[1:] = ~ink[:-1]
    start[cuts[(cuts > 0) & (cuts < size)]] = True
    first = np.flatnonzero(start & ink)  # of each run between white space
    start[1:] |= kind[1:] != kind[:-1]
    number = kind == _NUMBER
    start |= number & (low & 0xC0 != 0x80)
    start &= ink
    # 's 't 'm 'd 're 've 'll where the apostrophe starts a pre-token
    at = np.flatnonzero(start & (low == 0x27))
    at = at[at < size - 1]
    one, two = low[at + 1], low[np.minimum(at + 2, size - 1)]
    edge = np.zeros(size + 3, bool)
    edge[cuts] = True
    short = np.isin(one, list(b"stmd"))
    long = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    short &= ~edge[at + 1]
    long &= ~edge[at + 1] & ~edge[at + 2] & (at + 2 < size)
    start[at[short | long] + 1] = False
    after = np.concatenate([at[short] + 2, at[long] + 3])
    after = after[after < size]
    start[after[ink[after]]] = True
    foreign = odd[low[odd] >= 0xC4] if len(odd) else odd
    if len(foreign):
        run = np.unique(np.searchsorted(first, foreign, "right") - 1)
        run = run[run >= 0]
        ends = np.append(first, size)
        inside = np.zeros(size + 1, np.int32)
        inside[first[run]] += 1
        inside[ends[run + 1]] -= 1
        start &= np.cumsum(inside[:-1]) == 0
        start[first[run]] = True
    place = np.cumsum(ink, dtype=np.int32 if size < 1 << 31 else np.int64)
    begins = np.flatnonzero(start)
    offsets = np.append(place[begins] - 1, place[-1] if size else 0).astype(np.int32)
    return pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(low[ink])), np.searchsorted(begins, cuts)


class WordTokenizer:
    """A tokenizers file whose pre-tokens never span white space, with the ids of words remembered.

    Word by word gives the library's own ids: the normaliser works within
    words, and merges stay inside pre-tokens. Files that state other steps are
    refused. Texts that hold one of the file's special strings go through the
    library whole. What is remembered lies in flat arrays and is bounded; when
    it is full, the words of the most batches stay.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        if sys.byteorder != "little":
            raise RuntimeError("ids are written in this machine's order, which must be little-endian")
        self.library = Tokenizer.from_file(path)
        stated = json.loads(self.library.to_str())
        if stated["normalizer"] != _NORMALISER or stated["pre_tokenizer"] != _PRE_TOKENISER or stated["truncation"] or stated["padding"]:
            raise ValueError("the tokenizer's normaliser or pre-tokenizer is not the one that texts are cut for here")
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.words = Remembered([np.uint32], self._learn, _MEMO)

    def _learn(self, new: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        found = [e.ids for e in self.library.encode_batch_fast(new, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return [(np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(size.sum())), size)]

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Unsigned 32-bit ids of each text (null: none)."""
        for some, raw, cuts in blocks(texts, _AT_ONCE):
            words, bounds = pre_tokens(raw, cuts)
            ids, ends = self.words.columns[0].of(self.words.numbers(words), bounds)
            whole = np.zeros(len(some), bool)
            for s in self.special:
                whole |= pc.match_substring(some, s).to_numpy(zero_copy_only=False)
            for k, (a, b) in enumerate(pairwise(ends.tolist())):
                yield np.array(self.library.encode(some[k].as_py(), add_special_tokens=False).ids, np.uint32) if whole[k] else ids[a:b]


@functools.lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    keeps(__name__, word_tokenizer.cache_clear)
    return WordTokenizer(path)


class Windows:
    """Open windows of one size; the one with the least room that is enough takes a piece."""

    def __init__(self, size: int, most_open: int):
        self.size, self.most_open = size, most_open
        self.rooms: list[tuple[int, int]] = []  # (room, window), sorted
        self.pieces: dict[int, list] = {}
        self.made = 0

    def place(self, piece, length: int) -> list | None:
        """Put ``piece`` into a window; the window that this closes, if any."""
        at = bisect.bisect_left(self.rooms, (length, -1))
        closed = None
        if at == len(self.rooms):
            if len(self.rooms) >= self.most_open:
                closed = self.pieces.pop(self.rooms.pop(0)[1])
            room, window = self.size, self.made
            self.made += 1
            self.pieces[window] = []
        else:
            room, window = self.rooms.pop(at)
        self.pieces[window].append(piece)
        if room == length:
            return self.pieces.pop(window) if closed is None else self._both(closed, window)
        bisect.insort(self.rooms, (room - length, window))
        return closed

    def _both(self, closed: list, window: int) -> list:
        self.full = self.pieces.pop(window)
        return closed

    full: list | None = None

    def closed(self, piece, length: int) -> Iterator[list]:
        one = self.place(piece, length)
        if one is not None:
            yield one
        if self.full is not None:
            full, self.full = self.full, None
            yield full

    def rest(self) -> Iterator[list]:
        yield from self.pieces.values()
        self.rooms, self.pieces = [], {}


def _emit(windows: list[list], first_id: int, left: bool, keep_ids: bool) -> pa.RecordBatch:
    rows = []
    for k, pieces in enumerate(windows):
        offset = 0
        for piece in pieces:
            rows.append((*piece[:5], first_id + k, offset, left, *piece[5:]))
            offset += piece[2]
    schema = _PIECE_IDS if keep_ids else _PIECE
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _pack_batches(path: str, size: int, most_open: int, end_id: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        tokens, windows, done, made = word_tokenizer(path), Windows(size, most_open), [], 0
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            for doc_id, found in zip(b.column(0).to_pylist(), tokens.encode(b.column(1)), strict=True):
                ids = found.tobytes() + end
                total = len(ids) // 4
                for start in range(0, total, size):
                    part = ids[4 * start : 4 * (start + size)]
                    piece = (doc_id, start, len(part) // 4, zlib.crc32(part), total, *((part,) if keep_ids else ()))
                    if len(part) == 4 * size:
                        done.append([piece])
                    else:
                        done.extend(windows.closed(piece, len(part) // 4))
                if len(done) >= _CLOSED:
                    yield _emit(done, base + made, False, keep_ids)
                    made += len(done)
                    done = []
        if done:
            yield _emit(done, base + made, False, keep_ids)
            made += len(done)
        done = list(windows.rest())
        if done:
            yield _emit(done, base + made, True, keep_ids)

    return run


def _merge_group(size: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by group: each group's pieces, longest first, best fit without a bound on open windows."""
        group, held = None, []

        def merged():
            windows, done = Windows(size, 1 << 60), []
            for piece in sorted(held, key=lambda p: (-p[2], p[0] is None, p[0] or 0, p[1])):
                done.extend(windows.closed(piece, piece[2]))
            done.extend(windows.rest())
            return _emit(done, (1 << 62) + (group << 24), True, keep_ids)

        for b in batches:
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if keep_ids else [])]
            columns = [b.column(b.schema.get_field_index(n)).to_pylist() for n in names]
            for g, piece in zip(b.column(b.schema.get_field_index("grp")).to_pylist(), zip(*columns, strict=True), strict=True):
                if g != group:
                    if held:
                        yield merged()
                    group, held = g, []
                held.append(piece)
        if held:
            yield merged()

    return run


def pack(docs: DataFrame, tokenizer_path: str, size: int = 4096, most_open: int = 64, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most ``size`` ids.

    Columns: doc_id, start (the document's ids before the piece), length,
    ids_crc32, doc_tokens (with the end id), sequence_id, offset (in the
    sequence, without gaps); with ``keep_ids`` also ids (binary, little-endian
    unsigned 32-bit), which :func:`sequences` joins to whole sequences.

    The tokenizer's file must state the steps that :class:`WordTokenizer` cuts
    texts for. Each task keeps ``most_open`` windows open. Pieces of ``size`` ids fill one
    alone; the rest of a document goes to the window whose room it fills best;
    if it fits in none, the fullest window is emitted and a new one opened.
    What tasks have open at their end is merged once over all tasks, in groups
    of bounded size, longest pieces first.

    Null texts count as empty: one piece, the end id. Null doc_ids are packed
    like any other; rows that share a doc_id are packed each for itself; texts
    of any length are cut; no rows give no rows; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, left boolean" + ", ids binary" * keep_ids
    first = written(map_batches(rows, _pack_batches(tokenizer_path, size, most_open, end_id, keep_ids), schema), "pieces")
    left = first.where("left")
    groups = max(1, -(-left.count() // _GROUP))
    grouped = left.withColumn("grp", F.pmod(F.xxhash64("sequence_id", "offset"), F.lit(groups)).cast("long"))
    merged = map_batches(grouped.repartition(min(groups, 10_000), "grp").sortWithinPartitions("grp"), _merge_group(size, keep_ids), schema)
    return first.where("not left").unionByName(merged).drop("left")


def sequences(pieces: DataFrame, pad_id: int = 0, size: int = 4096) -> DataFrame:
    """``sequence_id, ids, n_tokens`` from pieces that keep their ids: joined in order and padded to ``size``, except at a power of two."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_join(F.transform(parts, lambda p: F.hex(p.ids)), "").alias("hex"))
    pad = F.lit(pad_id.to_bytes(4, "little").hex().upper())
    exact = F.bin("n_tokens").rlike("^10*$")
    padded = F.when(exact, F.col("hex")).otherwise(F.concat("hex", F.repeat(pad, (F.lit(size) - F.col("n_tokens")).cast("int"))))
    return whole.select("sequence_id", F.unhex(padded).alias("ids"), "n_tokens")
