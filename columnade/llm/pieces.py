"""SentencePiece encoding for merge-type vocabularies, and decoding."""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from columnade.llm.common import batch, keeps, map_batches
from columnade.llm.remembered import Remembered, blocks

_SPACE = "▁"
#: Segments remembered, and bytes of text looked at together (one text at least).
_MEMO, _AT_ONCE = 600_000, 4 << 20
#: One row in so many of a batch has its whole text held against the library.
CHECK_EVERY = 16
#: Segments longer than this go through a heap of pairs, not through the table of all segments.
_LONG = 64
_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


class PieceEncoder:
    """Byte-pair merges of a sentencepiece model, best score first, leftmost among equals.

    Only models with an identity normaliser, a leading space mark and byte
    fallback are taken; others are refused. Texts are cut where no piece can
    reach across; what lies between is merged once and remembered.
    """

    def __init__(self, path: str, verify: bool = True):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.verify = verify
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        if "".join(sp.encode("  a  b ", out_type=str)) != f"{_SPACE * 3}a{_SPACE * 2}b{_SPACE}":
            raise ValueError("the model's normaliser changes texts")
        if not all(sp.is_byte(sp.piece_to_id(f"<0x{b:02X}>")) for b in range(256)):
            raise ValueError("the model has no byte fallback")
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.symbol = {pieces[i]: i for i in normal}
        if any(re.search(f"[^{_SPACE}]{_SPACE}", p) for p in self.symbol):
            raise ValueError("the model has pieces that reach across words")
        inner = {c for p in self.symbol if len(p) > 1 for c in p}
        self.size, self.names, self.decimal = n, pieces, [b"%d," % i for i in range(n)]
        self.digits = np.fromiter(map(len, self.decimal), np.int64, n)
        for k, c in enumerate(sorted(inner - set(self.symbol))):  # characters that occur in pieces only
            self.symbol[c] = n + k
        self.of_char = np.full(0x110000, -2, np.int64)
        for c, k in self.symbol.items():
            if len(c) == 1:
                self.of_char[ord(c)] = k
        self.width = 1 << 17
        by_score = sorted({sp.get_score(i) for i in normal}, reverse=True)
        rank = {s: k for k, s in enumerate(by_score)}
        table = {}
        for p in (pieces[i] for i in normal if len(pieces[i]) > 1):
            for cut in range(1, len(p)):
                a, b = self.symbol.get(p[:cut]), self.symbol.get(p[cut:])
                if a is not None and b is not None:
                    table[a * self.width + b] = (rank[sp.get_score(self.symbol[p])], self.symbol[p])
        self.keys = np.array(sorted(table), np.int64)
        self.ranks = np.array([table[k][0] for k in self.keys.tolist()], np.int64)
        self.merged = np.array([table[k][1] for k in self.keys.tolist()], np.int64)
        self.table = table
        # a character that no longer piece holds ends a segment on both sides
        self.kind = np.full(0x110000, 2, np.uint8)
        self.kind[[ord(c) for c in inner]] = 1
        self.kind[[ord(" "), ord(_SPACE)]] = 0
        self.known = Remembered([np.int32, np.uint8], self._learn, _MEMO)

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the merge of each pair (the largest number: none) and what it makes."""
        key = np.where((a < 0) | (b < 0), -1, a * self.width + b)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], 1 << 40), self.merged[at]

    def _finish(self, text: str, symbols: list[int]) -> list[int]:
        """Ids of a segment's final symbols; characters outside the vocabulary give their bytes."""
        ids, at = [], 0
        for s in symbols:
            if 0 <= s < self.size:
                ids.append(s)
                at += len(self.names[s])
            else:
                ids.extend(self.bytes[x] for x in text[at].encode("utf-8", "surrogatepass"))
                at += 1
        return ids

    def _agenda_table(self, segments: list[str]) -> list[list[int]]:
        """All segments at once: each round makes the best merge of every segment that has one."""
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        wide = int(sizes.max())
        s = np.full((len(segments), wide + 1), -1, np.int64)
        flat = self.of_char[np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)]
        inside = np.arange(wide + 1) < sizes[:, None]
        s[inside] = flat
        rank, made = self._pairs(s[:, :-1].ravel(), s[:, 1:].ravel())
        rank, made = rank.reshape(len(s), wide), made.reshape(len(s), wide)
        live = np.arange(len(s))
        out = s.copy()
        while len(live):
            best = rank.argmin(1)
            go = rank[np.arange(len(live)), best] < 1 << 40
            if not go.all():
                out[live[~go]] = s[~go]
                live, s, rank, made, best = live[go], s[go], rank[go], made[go], best[go]
                if not len(live):
                    break
            rows = np.arange(len(live))
            s[rows, best] = made[rows, best]
            # close the gap: what stands right of the merge moves one place to the left
            place = np.arange(wide + 1)
            src = np.minimum(place + (place > best[:, None]), wide)
            s = np.take_along_axis(s, src, 1)
            s[:, wide] = -1
            rank, made = np.take_along_axis(rank, src[:, :wide].clip(max=wide - 1), 1), np.take_along_axis(made, src[:, :wide].clip(max=wide - 1), 1)
            rank[:, wide - 1] = np.where(src[:, wide - 1] >= wide, 1 << 40, rank[:, wide - 1])
            for side in (best - 1, best):
                at = np.maximum(side, 0)
                r, m = self._pairs(s[rows, at], s[rows, at + 1])
                ok = side >= 0
                rank[rows[ok], at[ok]], made[rows[ok], at[ok]] = r[ok], m[ok]
        held = out != -1
        odd = ((out == -2) | (out >= self.size)).any(1)
        flat, ends = out[held].tolist(), np.cumsum(held.sum(1)).tolist()
        rows = [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        for i in np.flatnonzero(odd).tolist():
            rows[i] = self._finish(segments[i], rows[i])
        return rows

    def _agenda_heap(self, segment: str) -> list[int]:
        """One long segment: a heap of adjacent pairs, best score first."""
        import heapq

        s = [self.symbol.get(c, -2) for c in segment]
        n = len(s)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j < n and s[i] >= 0 and s[j] >= 0 and (found := self.table.get(s[i] * self.width + s[j])):
                heapq.heappush(heap, (found[0], i, s[i], s[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if s[i] != a or j >= n or s[j] != b:
                continue
            s[i], s[j] = self.table[a * self.width + b][1], None
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            if left[i] >= 0:
                offer(left[i])
            offer(i)
        return self._finish(segment, [x for x in s if x is not None])

    def _learn(self, new: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of segments, and their decimal text with a comma behind each."""
        order = sorted(range(len(new)), key=lambda k: len(new[k]))
        texts = [new[k].replace(" ", _SPACE) for k in order]
        cut = bisect.bisect_right(texts, _LONG, key=len)
        found: list[list[int]] = []
        for i in range(0, cut, 5000):
            found.extend(self._agenda_table(texts[i : min(cut, i + 5000)]))
        found.extend(map(self._agenda_heap, texts[cut:]))
        if self.verify:  # against the library: every segment that starts with a space mark is a text of its own
            whole = [k for k, t in enumerate(texts) if t[0] == _SPACE and len(t) > 1]
            for k, ids in zip(whole, self.library.encode([texts[k][1:].replace(_SPACE, " ") for k in whole]), strict=True):
                if ids != found[k]:
                    raise ValueError(f"merges of {texts[k]!r} differ from the sentencepiece library")
        back = [found[k] for k in np.argsort(order).tolist()]
        size = np.fromiter(map(len, back), np.int64, len(back))
        ids = np.fromiter(itertools.chain.from_iterable(back), np.int32, int(size.sum()))
        digits = self.digits[ids]
        ends = np.concatenate([[0], np.cumsum(digits)])
        behind = np.cumsum(size)
        told = np.frombuffer(b"".join([self.decimal[i] for i in ids.tolist()]), np.uint8)
        return [(ids, size), (told, ends[behind] - ends[behind - size])]

    def segments(self, raw: np.ndarray, cuts: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
        """The segments of UTF-8 texts that stand end to end, each text that is not empty with a space before it, and how many come before each cut."""
        full = cuts[:-1] < cuts[1:]
        data = np.full(len(raw) + int(full.sum()), 32, np.uint8)
        begin = cuts + np.concatenate([[0], np.cumsum(full)])
        ink = np.ones(len(data), bool)
        ink[begin[:-1][full]] = False
        data[ink] = raw
        lead = data & 0xC0 != 0x80
        at = np.flatnonzero(lead)
        code = data[at].astype(np.int32)
        wide = np.flatnonzero(code >= 0x80)
        if len(wide):
            d = np.concatenate([data, np.zeros(3, np.uint8)])
            k, top = at[wide], code[wide]
            one, two, three = (d[k + j].astype(np.int32) & 63 for j in (1, 2, 3))
            code[wide] = np.where(top < 0xE0, (top & 31) << 6 | one, np.where(top < 0xF0, (top & 15) << 12 | one << 6 | two, (top & 7) << 18 | one << 12 | two << 6 | three))
        kind = self.kind[code]
        start = np.ones(len(at), bool)
        start[1:] = (kind[1:] != kind[:-1]) & ~((kind[1:] == 1) & (kind[:-1] == 0))
        start |= ~ink[at]
        begins = at[start]
        offsets = np.append(begins, len(data)).astype(np.int32)
        return pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(data)), np.searchsorted(begins, begin)

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, memoryview]]:
        """Of each text (null: empty), its ids and the decimal ids joined by commas, as bytes."""
        for _, raw, cuts in blocks(texts, _AT_ONCE):
            found, bounds = self.segments(raw, cuts)
            number = self.known.numbers(found)
            ids, ends = self.known.columns[0].of(number, bounds)
            told, stops = self.known.columns[1].of(number, bounds)
            shown = memoryview(told)
            for (a, b), (c, d) in zip(pairwise(ends.tolist()), pairwise(stops.tolist()), strict=True):
                yield ids[a:b], shown[c : max(c, d - 1)]

    def ids(self, text: str) -> list[int]:
        return next(self.encode(pa.array([text])))[0].tolist()


@functools.lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    keeps(__name__, piece_encoder.cache_clear)
    return PieceEncoder(path)


def _digest_batches(path: str, check_every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(path)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for b in batches:
            encoded = encoder.encode(b.column(1))
            for i in range(0, b.num_rows, 256):
                some = list(itertools.islice(encoded, 256))
                ids = [f[0].tolist() for f in some]
                if check_every:
                    held = range((-i) % check_every, len(ids), check_every)
                    if [ids[k] for k in held] != encoder.library.encode([b.column(1)[i + k].as_py() or "" for k in held]):
                        raise ValueError("ids differ from the sentencepiece library")
                decoded = encoder.library.decode(ids)
                yield batch(_OUT, b.column(0).slice(i, 256), [len(x) for x in ids], [sha(f[1]) for f in some], [sha(t.encode("utf-8", "surrogatepass")) for t in decoded])

    return run


def _id_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(path)
        for b in batches:
            encoded = encoder.encode(b.column(1))
            for i in range(0, b.num_rows, 256):
                yield batch(_IDS, b.column(0).slice(i, 256), [f[0] for f in itertools.islice(encoded, 256)])

    return run


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, ids`` (array of int) of every whole text; null texts count as empty and give no ids."""
    return map_batches(_rows(docs), _id_batches(model_path), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids`` with the library's decode; null ids give a null text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = piece_encoder(model_path).library
        for b in batches:
            yield batch(schema, b.column(0), [None if x is None else library.decode(x) for x in b.column(1).to_pylist()])

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def digests(docs: DataFrame, model_path: str, check_every: int = CHECK_EVERY) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every whole text.

    In each Arrow batch new segments that start with a space, and the whole
    text of one row in ``check_every`` (0: none, 1: all), are held against the
    sentencepiece library; a difference fails the task. Null and empty texts
    have no ids and decode to the empty text; repeated rows give repeated rows;
    a null doc_id stays null; no rows give no rows; other columns are not read.
    """
    return map_batches(_rows(docs), _digest_batches(model_path, check_every), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
