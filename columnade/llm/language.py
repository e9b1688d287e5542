"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from columnade.llm.common import batch, map_batches

#: Runs of word characters without decimal digits: letters, and numbers such as superscripts and fractions.
_WORD = re.compile(r"[^\W\d_]+")
_MEMO = 400_000
_START, _END = 1, 2
_BITS = 21
#: Of the way from a language's own cross-entropy to that of foreign texts, the part that a text may stray; with deviations on top.
_STRAY, _DEVIATIONS = 0.4, 4.0
_OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_()), ("cross_entropy", pa.float64())])


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower case; everything else is no evidence of a language."""
    words = _WORD.findall(text.lower()) if text else []
    if not words or text.isascii() or all(map(str.isalpha, words)):
        return words
    return "".join(c if c.isalpha() else " " for c in " ".join(words)).split()


def _codes(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Each n-gram of each word as one integer (the last character in the low bits), and n-grams per word.

    A word is led by order - 1 start marks and closed by an end mark, so every
    n-gram is of full order.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + order
    text = np.zeros(int(sizes.sum()), np.int64)
    ends = np.cumsum(sizes)
    begin = ends - sizes
    lead = begin[:, None] + np.arange(order - 1)
    text[lead.ravel()] = _START
    text[ends - 1] = _END
    text[text == 0] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    grams = np.zeros(len(text), np.int64)
    for j in range(order):
        back = order - 1 - j
        grams[order - 1 :] = (grams[order - 1 :] << _BITS) | text[order - 1 - back : len(text) - back]
    keep = np.ones(len(text), bool)
    keep[lead.ravel()] = False
    return grams[keep], sizes - (order - 1)


def _hash(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash that no two n-grams share: every step can be undone."""
    with np.errstate(over="ignore"):
        x = codes.astype(np.int64).view(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _find(hashes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of n-grams in a sorted array of hashes, and whether they are in it."""
    wanted = _hash(wanted)
    at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
    return at, hashes[at] == wanted


@dataclass
class Models:
    """One model per language over shared sorted arrays of hashed n-grams and contexts.

    grams[n] are the hashes of the n-grams that occur, alpha[n] their
    discounted share under each language; contexts[n] the hashed contexts of
    order n, gamma[n] what each leaves to the next lower order. seen is alpha
    and gamma worked out for every n-gram of full order: -log p under each
    language. mean is what texts of each language cost when every word is
    charged to the language that it suits best; stray, spread and spread_char
    (the part that falls with the length) say how far above it a text may lie.
    """

    langs: list[str]
    order: int
    grams: list[np.ndarray]
    alpha: list[np.ndarray]
    contexts: list[np.ndarray]
    gamma: list[np.ndarray]
    seen: np.ndarray
    floor: float
    mean: np.ndarray
    stray: float
    spread: float
    spread_char: float
    scale: float

    def losses(self, grams: np.ndarray) -> np.ndarray:
        """-log p of each n-gram's last character given the rest, under each language."""
        at, hit = _find(self.grams[-1], grams)
        out = self.seen[at]
        if not hit.all():
            out[~hit] = self._worked_out(grams[~hit])
        return out

    def _worked_out(self, grams: np.ndarray) -> np.ndarray:
        p = np.full((len(grams), len(self.langs)), self.floor)
        for n in range(1, self.order + 1):
            part = grams & ((1 << (_BITS * n)) - 1) if n < 3 else grams & np.int64((1 << (_BITS * n)) - 1 if n * _BITS < 63 else -1)
            at, hit = _find(self.contexts[n - 1], part >> _BITS)
            left = np.where(hit[:, None], self.gamma[n - 1][at], 1.0)
            at, hit = _find(self.grams[n - 1], part)
            p = np.where(hit[:, None], self.alpha[n - 1][at], 0.0) + left * p
        return -np.log(p)


def _share(grams: np.ndarray, counts: np.ndarray, discount: float):
    """Discounted shares and left-over weights of one order; counts: n-grams x languages."""
    context, at = np.unique(grams >> _BITS, return_inverse=True)
    total = np.zeros((len(context), counts.shape[1]))
    kinds = np.zeros_like(total)
    np.add.at(total, at, counts)
    np.add.at(kinds, at, counts > 0)
    safe = np.where(total > 0, total, 1)
    alpha = np.maximum(counts - discount, 0) / safe[at]
    gamma = np.where(total > 0, discount * kinds / safe, 1.0)
    return alpha, context, gamma


def train(rows: list[tuple[str, str, int]], order: int = 3, discount: float = 0.75) -> Models:
    """Models from (language, word, count); calibration is set by :func:`calibrate`.

    An n-gram is one 63-bit integer before it is hashed, so ``order`` is 3 at most.
    """
    if not 1 <= order * _BITS <= 63:
        raise ValueError("order must be 1, 2 or 3")
    langs = sorted({r[0] for r in rows})
    if not langs:
        return Models([], order, [], [], [], [], np.zeros((0, 0)), 1.0, np.zeros(0), np.inf, 0.0, 0.0, 1.0)
    number = {lang: k for k, lang in enumerate(langs)}
    grams, sizes = _codes([r[1] for r in rows], order)
    who = np.repeat(np.array([number[r[0]] for r in rows]), sizes)
    times = np.repeat(np.array([r[2] for r in rows], float), sizes)
    keys, at = np.unique(grams, return_inverse=True)
    counts = np.zeros((len(keys), len(langs)))
    np.add.at(counts, (at, who), times)
    top = keys
    found = []
    for n in range(order, 0, -1):
        alpha, contexts, gamma = _share(keys, counts, discount)
        here, there = np.argsort(_hash(keys)), np.argsort(_hash(contexts))
        found.append((_hash(keys)[here], alpha[here], _hash(contexts)[there], gamma[there]))
        # continuation counts: in how many contexts does the shorter n-gram follow a different character
        shorter, at = np.unique(keys & np.int64((1 << (_BITS * (n - 1))) - 1), return_inverse=True)
        lower = np.zeros((len(shorter), len(langs)))
        np.add.at(lower, at, counts > 0)
        keys, counts = shorter, lower
    found.reverse()
    alphabet = len(found[0][0]) + 1
    m = Models(langs, order, [f[0] for f in found], [f[1] for f in found], [f[2] for f in found], [f[3] for f in found], np.zeros((0, 0)), 1.0 / alphabet, np.full(len(langs), np.inf), 0.0, 0.0, 0.0, 1.0)
    m.seen = m._worked_out(top[np.argsort(_hash(top))]).astype(np.float32)
    return m


class Scorer:
    """Length-normalised cross-entropies of documents; the losses of words are remembered."""

    def __init__(self, models: Models):
        self.models = models
        self._reset()

    def _reset(self) -> None:
        self.at: dict[str, int] = {}
        # under each language, under the best one for the word, and characters
        self.rows = np.zeros((1024, len(self.models.langs) + 2), np.float32)

    def _learn(self, new: list[str]) -> None:
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            grams, sizes = _codes(part, self.models.order)
            loss = np.add.reduceat(self.models.losses(grams), np.cumsum(sizes) - sizes, axis=0)
            first = len(self.at)
            while first + len(part) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            here = self.rows[first : first + len(part)]
            here[:, :-2], here[:, -2], here[:, -1] = loss, loss.min(1), sizes
            self.at.update(zip(part, range(first, first + len(part)), strict=True))

    def _found(self, texts: list[str | None]) -> Iterator[Iterator[np.ndarray]]:
        """The rows of each text's words, in parts."""
        if len(self.at) > _MEMO:
            self._reset()
        split = [words_of(t) for t in texts]
        at = self.at
        new = [w for w in set().union(*split) if w not in at]
        if new:
            self._learn(new)
        for words in split:
            yield (self.rows[np.fromiter(map(at.__getitem__, part), np.int64, len(part))] for part in (words[i : i + (1 << 16)] for i in range(0, len(words), 1 << 16)))

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy of each text under each language, word by word under the best one, and its characters (0: no letter)."""
        total = np.zeros((len(texts), self.rows.shape[1]))
        for k, parts in enumerate(self._found(texts)):
            for rows in parts:
                total[k] += rows.sum(0, dtype=np.float64)
        size = total[:, -1]
        loss = total[:, :-1] / np.maximum(size, 1)[:, None]
        return loss[:, :-1], loss[:, -1], size

    def foreign(self, texts: list[str | None], langs: list[str]) -> np.ndarray:
        """Cross-entropy of each text, word by word under the best of the languages but its own; infinite without another or a letter."""
        out = np.full(len(texts), np.inf)
        for k, parts in enumerate(self._found(texts)):
            others = [i for i, lang in enumerate(self.models.langs) if lang != langs[k]]
            cost = size = 0.0
            for rows in parts:
                cost += float(rows[:, others].min(1).sum(dtype=np.float64)) if others else np.inf
                size += float(rows[:, -1].sum(dtype=np.float64))
            if size:
                out[k] = cost / size
        return out

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language (`und` without a letter or model), score, rejection and cross-entropy of each text."""
        m = self.models
        if not m.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool), np.zeros(len(texts))
        loss, mixed, size = self.score(texts)
        best = loss.argmin(1)
        low = loss[np.arange(len(texts)), best]
        weight = np.exp(-m.scale * np.sqrt(np.maximum(size, 1))[:, None] * (loss - low[:, None]))
        none = size == 0
        score = np.where(none, 0.0, 1.0 / weight.sum(1))
        limit = m.mean[best] + m.stray + _DEVIATIONS * np.sqrt(m.spread**2 + m.spread_char**2 / np.maximum(size, 1))
        return ["und" if n else m.langs[b] for n, b in zip(none, best, strict=True)], score, none | (mixed > limit), np.where(none, 0.0, low)


def calibrate(models: Models, langs: list[str], own: np.ndarray, foreign: np.ndarray, size: np.ndarray) -> Models:
    """Set the limits of rejection from texts that the models have not seen: their languages, what they cost and their sizes.

    A text costs what its words do under the language that suits each best, so
    that a text in several learned languages is none too foreign. Foreign
    texts are learned from too: ``foreign`` is what each text costs without
    the model of its own language. A text is rejected that strays from its
    language by ``_STRAY`` of the median difference of the two, and by
    ``_DEVIATIONS`` standard deviations more. The deviation is common to all
    languages; it has a part between documents (of the longer half) and one
    that falls with the root of the length, both from medians, which a few odd
    documents do not move. With one language, a foreign text is one of letters
    drawn evenly. Languages without such texts reject nothing.
    """
    who = np.array([models.langs.index(x) if x in models.langs else -1 for x in langs], np.int64)
    use = (who >= 0) & (size > 0)
    who, own, foreign, size = who[use], own[use], foreign[use], size[use]
    for k in range(len(models.langs)):
        models.mean[k] = np.median(own[who == k]) if (who == k).any() else np.inf
    if not len(who):
        return models
    off = np.abs(own - models.mean[who])
    models.spread = 1.4826 * float(np.median(off[size >= np.median(size)]))
    models.spread_char = 1.4826 * float(np.median(off * np.sqrt(size)))
    apart = foreign - own
    apart = apart[np.isfinite(apart)]
    even = max(0.0, -float(np.log(models.floor)) - float(np.median(own)))
    models.stray = _STRAY * float(np.median(apart) if len(apart) else even)
    return models


def _chosen(docs: DataFrame, per_language: int, most_languages: int) -> DataFrame:
    """``doc_id, lang, text`` of at most ``per_language`` different rows of each language, by a hash of doc_id and lang.

    First go those whose hash lies above a share that leaves about four times
    as many, so that ranking moves few rows, however many a language has.
    """
    part = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 40)) / float(1 << 40)
    rows = docs.where("lang is not null and text is not null and doc_id is not null").select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("doc_id", "lang")).alias("size")).limit(most_languages + 1).collect()
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, min(1.0, (4.0 * per_language + 100) / max(1, r.size)))]) if sizes else F.lit(None).cast("map<string,double>")
    some = rows.where(part < F.element_at(share, F.col("lang"))).select("doc_id", "lang", F.xxhash64("text").alias("t")).distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "lang"), "doc_id", "t"))
    best = some.withColumn("rank", rank).where(F.col("rank") <= per_language).select("doc_id", "lang", "t")
    met = rows.withColumn("t", F.xxhash64("text")).join(F.broadcast(best), ["doc_id", "lang", "t"])
    return met.groupBy("doc_id", "lang", "t").agg(F.first("text").alias("text")).select("doc_id", "lang", "text")


def fit(docs: DataFrame, per_language: int = 400, order: int = 3, most_languages: int = 500) -> Models:
    """Learn from at most ``per_language`` different rows (doc_id, lang, text) of each value of ``lang``, chosen by a hash.

    A quarter of them (another hash) sets the limits of rejection only. Words
    are counted and those texts are scored on the executors; what reaches the
    driver is the words of the sample and a row of numbers for each scored
    text. Rows with a null lang, text or doc_id teach nothing; repeated rows
    teach once; of rows that share a doc_id each teaches its own lang; no row
    gives a model without languages; more than ``most_languages`` values of
    lang are refused.
    """
    texts = _chosen(docs, per_language, most_languages)
    aside = F.pmod(F.crc32(F.concat(F.lit("calibrate "), F.col("doc_id").cast("string")).cast("binary")), F.lit(4)) == 0
    words = pa.schema([("lang", pa.string()), ("word", pa.string())])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = words_of(text.as_py())
                for i in range(0, len(found), 100_000):
                    part = found[i : i + 100_000]
                    yield batch(words, [lang] * len(part), part)

    counts = map_batches(texts.where(~aside).select("lang", "text"), spell, "lang string, word string").groupBy("lang", "word").count().toArrow()
    models = train(sorted(zip(*(c.to_pylist() for c in counts.columns), strict=True)), order)
    if not models.langs:
        return models
    held = docs.sparkSession.sparkContext.broadcast(models)
    scored = pa.schema([("lang", pa.string()), ("own", pa.float64()), ("other", pa.float64()), ("size", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                some, of = b.column(1).slice(i, 256).to_pylist(), b.column(0).slice(i, 256)
                _, own, size = scorer.score(some)
                yield batch(scored, of, own, scorer.foreign(some, of.to_pylist()), size)

    rows = map_batches(texts.where(aside).select("lang", "text"), score, "lang string, own double, other double, size double").toArrow()
    return calibrate(models, rows.column("lang").to_pylist(), *(rows.column(n).to_numpy().astype(float) for n in ("own", "other", "size")))


def predict(docs: DataFrame, models: Models) -> DataFrame:
    """``doc_id, lang_pred, score, rejected, cross_entropy`` of every whole text.

    lang_pred is the language whose model gives the lowest cross-entropy per
    character (ties: the first in order), `und` where the text is null or has
    no letter (score 0, rejected). score: the share of that language among all,
    by a weight that falls with the excess cross-entropy times the root of the
    length. rejected: the text, each word under the language that suits it
    best, is unlike the documents of every learned language.
    Repeated rows give repeated rows; a null doc_id stays null; no rows give no
    rows; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i in range(0, len(texts), 256):
                lang, score, rejected, loss = scorer.decide(texts[i : i + 256])
                yield batch(_OUT, b.column(0).slice(i, 256), lang, score, rejected, loss)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, lang_pred string, score double, rejected boolean, cross_entropy double")


def keep_known(docs: DataFrame, models: Models) -> DataFrame:
    """The rows of ``docs`` (all columns, in any number and of any name but a second ``text``) that are not rejected.

    Null and empty texts and those without a letter go; so do all where no
    language was learned. Repeated rows stay or go together; no rows give none.
    """
    held = docs.sparkSession.sparkContext.broadcast(models)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                yield part.filter(pa.array(~scorer.decide(part.column(at).to_pylist())[2]))

    return map_batches(docs, run, docs.schema)
