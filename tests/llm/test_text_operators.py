"""Operators on documents, against brute force and on hard small tables."""

import hashlib
import math
import random
import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from columnade.llm import components, language, packing, pieces, quality, registry, simhash, substrings
from columnade.llm.components import connected_components

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def docs_of(spark, rows, extra=()):
    """Documents from (doc_id, text); ``extra`` names columns that operators use themselves."""
    schema = T.StructType([*DOCS.fields, *[T.StructField(n, T.StringType()) for n in extra]])
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *(["x"] * len(extra))) for i, t in rows], schema)


rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(300)]
PASSAGE = " ".join(rng.choice(WORDS) for _ in range(60))
LONG = " ".join(rng.choice(WORDS) for _ in range(30_000))
HARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, PASSAGE), (7, PASSAGE), (8, f"start {PASSAGE} middle {PASSAGE} end"), (9, LONG),
    (10, PASSAGE.upper()), (11, " é ŝ 日本 👍🏽 a\u0000b"), (12, " ".join(["same"] * 100)), (13, f"{LONG} more"), (14, "<|endoftext|> x"), (None, PASSAGE), (15, "x" * 50_000),
]
CLASH = ("starts", "copy", "bucket", "fp", "rep", "key", "component_id", "n", "grp", "left", "word", "terms", "score", "h", "k")


def removed_by_hand(rows, window=20):
    """(n_words, n_removed, digest) by id, with every window looked up."""
    seen, out = set(), {}
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out[i] = (len(words), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize("window", [20, 7, 3])
def test_substrings_like_brute_force(spark, window):
    got = {r.doc_id: tuple(r)[1:] for r in substrings.remove_repeats(docs_of(spark, HARD, CLASH).repartition(3), window).collect()}
    alone = got.pop(None)
    assert got == removed_by_hand(HARD, window) and alone[:2] == (60, 0)


def test_substrings_shifted_by_any_amount(spark):
    rows = [(i, " ".join([f"w{i}_{k}" for k in range(i)] + PASSAGE.split()[:20] + [f"v{i}_{k}" for k in range(5)])) for i in range(40)]
    got = {r.doc_id: tuple(r)[1:] for r in substrings.remove_repeats(docs_of(spark, rows)).collect()}
    assert got == removed_by_hand(rows) and sum(g[1] for g in got.values()) == 39 * 20


def test_substrings_registered_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in registry.op8_substring_dedup(spark, sf_dir).collect()}
    assert got == removed_by_hand(rows) and sum(g[1] for g in got.values()) > 0


def test_substrings_of_shared_ids(spark):
    """Different texts of one id are documents of their own; repeated rows are one; nothing crashes on short ones."""
    rows = [(5, PASSAGE), (5, "short"), (5, f"{PASSAGE} {PASSAGE}"), (6, PASSAGE), (6, PASSAGE), (7, f"new {PASSAGE}"), (8, None), (8, "x"), (8, "")]
    got = {}
    for r in substrings.remove_repeats(docs_of(spark, rows)).collect():
        got.setdefault((r.doc_id, r.n_words), []).append(r.n_removed)
    first = [got[5, 60], got[5, 120]]
    assert first in ([[0], [120]], [[60], [60]]) and got[6, 60] == [60, 60] and got[7, 61] == [60] and got[5, 1] == [0] and sorted(got[8, 0] + got[8, 1]) == [0, 0, 0]
    kept = substrings.cut_repeats(docs_of(spark, rows, ("__starts", "cut", "cutid", "nth")))
    assert kept.columns == [*DOCS.names, "__starts", "cut", "cutid", "nth"]
    assert sorted((r.doc_id, len((r.text or "").split())) for r in kept.collect()) == sorted([(5, 60), (5, 1), *[(8, 0), (8, 0), (8, 1)], (7, 1)])


def test_covers():
    for period, cover in substrings.COVERS.items():
        for d in range(period):
            assert any((x + d) % period in cover for x in cover)


def test_cut_repeats_keeps_columns(spark):
    made = substrings.cut_repeats(docs_of(spark, HARD, CLASH))
    got = {r.doc_id: r for r in made.collect()}
    want = removed_by_hand(HARD)
    assert made.columns == [*DOCS.names, *CLASH] and 7 not in got and got[1].text is None and got[3].text == " \n\t "
    for i, r in got.items():
        if i is not None:
            assert hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest() == want[i][2]
            assert r.n_chars == (None if r.text is None else len(r.text))


def fingerprint_by_hand(text):
    import xxhash

    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprints(spark):
    for _, text in HARD:
        if text is None or len(text) < 20_000:
            assert simhash.fingerprint(text) == fingerprint_by_hand(text)


def components_by_hand(links, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_simhash_like_brute_force(spark, sf_dir):
    rows = HARD + [(100 + i, LONG[: 3000 + 10 * i]) for i in range(60)]
    got = simhash.near_duplicates(docs_of(spark, rows, CLASH)).collect()
    prints = {r.doc_id: int(r.fingerprint, 16) for r in got if r.doc_id is not None}
    assert all(prints[i] == fingerprint_by_hand(t) for i, t in rows if i is not None and len(t or "") < 20_000)
    want = components_by_hand([(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3], prints)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert [r.component_id for r in got if r.doc_id is None] == [6]


def test_simhash_large_groups():
    """Groups above every size limit still give all links."""
    r = np.random.default_rng(2)
    base = r.integers(0, 1 << 63, dtype=np.uint64)
    flips = np.zeros(6000, np.uint64)
    for _ in range(5):
        flips ^= np.uint64(1) << r.integers(0, 32, 6000).astype(np.uint64)
    values = np.unique(base ^ flips)
    ids = np.arange(len(values))
    found = []
    simhash._link_group(values, ids, 0, found)
    u, v = np.concatenate(found, axis=1)
    links = [(a, b) for a in range(len(values)) for b in (np.flatnonzero(np.bitwise_count(values[a + 1 :] ^ values[a]) <= 3) + a + 1).tolist()]
    assert components_by_hand(zip(u.tolist(), v.tolist(), strict=True), ids.tolist()) == components_by_hand(links, ids.tolist())


def test_simhash_registered_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    prints = {i: fingerprint_by_hand(t) for i, t in rows}
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in registry.op10_simhash(spark, sf_dir).collect()}
    part = components_by_hand([(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3], prints)
    assert got == {i: (prints[i], part[i]) for i in prints}


def test_few_links_are_few_files(spark, monkeypatch):
    """However many partitions a shuffle has, rounds over few links write one file each."""
    files, write = [], components.written

    def seen(df, what):
        made = write(df, what)
        files.append(len(made.inputFiles()))
        return made

    monkeypatch.setattr(components, "written", seen)
    for key, value in (("spark.sql.shuffle.partitions", "40"), ("spark.sql.adaptive.coalescePartitions.enabled", "false")):
        spark.conf.set(key, value)
    try:
        links = spark.range(300).selectExpr("id + 1 u", "id v")
        got = {r.node: r.component_id for r in components.connected_components(links).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == dict.fromkeys(range(301), 0)
    assert len(files) > 1 and set(files[1:]) == {1}


def test_simhash_of_shared_ids(spark):
    """Different texts under one id link as the texts do, and do not link what their id alone has in common."""
    base = [f"{LONG[k * 9000 : k * 9000 + 6000]}" for k in range(3)]
    rows = [(5, base[0]), (5, base[1]), (6, f"{base[0]} z"), (3, f"{base[1]} z"), (9, base[2]), (4, base[2]), (9, base[2])]
    got = sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs_of(spark, rows)).collect())
    assert got == [(3, 3), (4, 4), (5, 3), (5, 5), (6, 5), (9, 4), (9, 4)]


@pytest.mark.parametrize("hot", [1 << 15, 40])
def test_simhash_huge_variant_group(spark, hot):
    """Fingerprints that share a half, by way of one task and cut over tasks."""
    r = np.random.default_rng(2)
    flips = np.zeros(700, np.uint64)
    for _ in range(4):
        flips ^= np.uint64(1) << r.integers(0, 32, 700).astype(np.uint64)
    values = np.unique(np.concatenate([r.integers(0, 1 << 63, dtype=np.uint64) ^ flips, r.integers(0, 1 << 63, 300, dtype=np.uint64), np.arange(40, dtype=np.uint64) << np.uint64(40)])).view(np.int64)
    got = {x.node: x.component_id for x in simhash.fingerprint_components(spark.createDataFrame([(v,) for v in values.tolist()], "fp long").repartition(3), hot).collect()}
    bits = values.view(np.uint64)
    links = [(int(values[a]), int(values[a + 1 + b])) for a in range(len(values)) for b in np.flatnonzero(np.bitwise_count(bits[a + 1 :] ^ bits[a]) <= 3).tolist()]
    assert got == {n: c for n, c in components_by_hand(links, values.tolist()).items() if n in {x for link in links for x in link}}


def test_keep_one(spark):
    kept = simhash.keep_one(docs_of(spark, HARD, ("fp", "rep")))
    ids = [r.doc_id for r in kept.collect()]
    assert 6 in ids and 7 not in ids and 10 not in ids and 1 in ids and 2 not in ids and None in ids and kept.columns == [*DOCS.names, "fp", "rep"]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)] + [(5000, 5000), (7, 3), (7, 3)]
    got = {r.node: r.component_id for r in connected_components(spark.createDataFrame(links, "u long, v long").repartition(7)).collect()}
    want = components_by_hand([x for x in links if x[0] != x[1]], {n for link in links for n in link if n != 5000})
    assert got == want
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.fixture(scope="module")
def bpe():
    return registry.tokenizer_path("word_bpe_49k.json")


def check_pieces(rows, texts, bpe, size):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe)
    left = []
    for i, text in texts:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        left.append((i, ids))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, ids in left:
        own = sorted(by_doc[i], key=lambda r: r.start)
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1].tolist()] and sum(r.length for r in own) == len(ids)
        assert all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert own[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in pairwise(own)) and own[-1].offset + own[-1].length <= size
    return sum(r.length for r in rows) / size / len(by_sequence)


def test_packing(spark, bpe, sf_dir):
    rows = [r for r in HARD if r[0] is not None]
    made = packing.pack(docs_of(spark, HARD, CLASH).repartition(3), bpe, size=512, most_open=2, keep_ids=True)
    got = made.collect()
    assert check_pieces(got, [*rows, (None, PASSAGE)], bpe, 512) > 0.8
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(made, pad_id=9, size=512).collect()}
    for r in got:
        assert whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)
    used = {r.sequence_id: max(x.offset + x.length for x in got if x.sequence_id == r.sequence_id) for r in got}
    assert all(len(w) == 4 * (used[s] if used[s] & (used[s] - 1) == 0 else 512) for s, w in whole.items())


def test_packing_query(spark, bpe, sf_dir):
    got = registry.op1_packing(spark, sf_dir).collect()
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert check_pieces(got, texts, bpe, 4096) > 0.95


def test_tokenizer_word_by_word(bpe):
    words = packing.WordTokenizer(bpe)
    odd = ["Aé ΑΣ Σας\x1cfoo\x85bar x İI", "it's don't 'Some've x'LL", "x²y ½ª µ ÿŸ É!!'s", "á ́x q᠎1", "日本 語 한국어　q 👍🏽", "", " ", "a<|startoftext|>b C"]
    r = random.Random(1)
    odd += ["".join(r.choice("ab'sTlredvem1²é ß.,!×\n  _ ") for _ in range(60)) for _ in range(2000)]
    odd += ["".join(r.choice("'sÉ日Σ\u0301\u2009\u3000 K'llñ9½a") for _ in range(30)) for _ in range(1000)] + [None, "'", "'s", "x'", "'l", "l", "'re", "'r", "e"]
    want = [np.array(words.library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in odd]
    assert [x.tobytes() for x in words.encode(pa.array(odd))] == want
    assert [x.tobytes() for x in words.encode(pa.array(odd, pa.large_string())[3:400])] == want[3:400]


def test_tokenizer_forgets(bpe, monkeypatch):
    monkeypatch.setattr(packing, "_MEMO", 40)
    monkeypatch.setattr(packing, "_AT_ONCE", 200)
    words, r = packing.WordTokenizer(bpe), random.Random(2)
    texts = [" ".join(r.choice(WORDS) for _ in range(r.randint(0, 30))) for _ in range(300)]
    assert [x.tolist() for x in words.encode(pa.array(texts))] == [words.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_tokenizer_refuses_other_steps(bpe, tmp_path):
    other = tmp_path / "other.json"
    with open(bpe) as f:
        other.write_text(f.read().replace('"NFC"', '"NFKC"', 1))
    with pytest.raises(ValueError):
        packing.WordTokenizer(str(other))


@pytest.fixture(scope="module")
def piece_model():
    return registry.tokenizer_path("piece_bpe_32k.model")


def test_pieces_like_the_library(piece_model, monkeypatch):
    encoder = pieces.PieceEncoder(piece_model)
    odd = ["a  b", " a", "a ", "▁x ▁▁ y", "\n\n x\n", "<s>hi</s><0x41>", "日本語 👍🏽\x00z", "a" * 300 + " b" * 3, "  ", "\t\tif x==1:\n        return  y", "", LONG, "x" * 5000]
    r = random.Random(1)
    odd += ["".join(r.choice("abthe rin▁ \n.,19é日") for _ in range(r.randint(0, 120))) for _ in range(500)]
    odd += ["".join(r.choice(" ▁ab😀ñé\U0001f600\u00a0語") for _ in range(r.randint(0, 12))) for _ in range(500)]
    want = encoder.library.encode(odd)
    assert [encoder.ids(t) for t in odd] == want
    for at_once in (200, 1 << 30):
        monkeypatch.setattr(pieces, "_AT_ONCE", at_once)
        got = list(encoder.encode(pa.array([*odd, None])))
        assert [g[0].tolist() for g in got] == [*want, []] and [bytes(g[1]).decode() for g in got] == [",".join(map(str, w)) for w in [*want, []]]


def test_pieces_query(spark, piece_model):
    library = pieces.piece_encoder(piece_model).library
    rows = [(i, None if t is None else t.replace("\x00", "")) for i, t in HARD]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = library.encode(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    got = [tuple(r) for r in pieces.digests(docs_of(spark, rows, ("ids",)), piece_model, check_every=1).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    back = pieces.decode(pieces.encode(docs_of(spark, rows), piece_model), piece_model)
    assert all(r.text == (t or "") for r, (_, t) in zip(back.collect(), rows, strict=True) if "日" not in (t or ""))


def test_pieces_registered_query(spark, piece_model, sf_dir):
    """The registered query over the whole table against the library, row by row."""
    library = pieces.piece_encoder(piece_model).library
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = library.encode(r.text or "")
        want[r.doc_id] = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
    assert {r.doc_id: tuple(r)[1:] for r in registry.op5_sentencepiece(spark, sf_dir).collect()} == want


def test_words_are_runs_of_letters():
    assert language.words_of("½ ² a²b Ⅷ 12 É_x") == ["a", "b", "é", "x"] and language.words_of(None) == language.words_of("½") == []


def test_kneser_ney_sums_to_one():
    models = language.train([("aa", "banana", 3), ("aa", "band", 1), ("bb", "cabin", 2), ("bb", "abba", 5)])
    letters = sorted(set("banancidbaboveq"))
    known = [c for c in letters if c in "bandci"]
    for head in ("ba", "an", "ab"):
        grams, _ = language._codes([head + c for c in known], 3)
        ends = np.cumsum([len(head) + 2] * len(known)) - 2
        p = np.exp(-models.losses(grams[ends]))
        end, _ = language._codes([head], 3)
        unknown, _ = language._codes([head + "￿"], 3)
        assert np.allclose(p.sum(0) + np.exp(-models.losses(end[-1:])[0]) + np.exp(-models.losses(unknown[-2:-1])[0]), 1, atol=1e-3)


def kneser_ney_by_hand(rows, discount=0.75):
    """-log p of the last character of each n-gram of a word, by the textbook: nested dictionaries, one language."""
    counts = [{}, {}, {}]
    for word, times in rows:
        chars = ["<", "<", *word, ">"]
        for i in range(2, len(chars)):
            head, c = tuple(chars[i - 2 : i]), chars[i]
            counts[2].setdefault(head, {})[c] = counts[2].get(head, {}).get(c, 0) + times
    for n in (2, 1):
        for head, after in counts[n].items():
            for c in after:
                lower = counts[n - 1].setdefault(head[1:], {})
                lower[c] = lower.get(c, 0) + 1
    size = len(counts[0][()]) + 1

    def p(head, c):
        rest = 1 / size if not head else p(head[1:], c)
        after = counts[len(head)].get(head)
        if not after:
            return rest
        total = sum(after.values())
        return max(after.get(c, 0) - discount, 0) / total + discount * len(after) / total * rest

    return lambda word: -sum(math.log(p(tuple(["<", "<", *word, ">"][i - 2 : i]), ["<", "<", *word, ">"][i])) for i in range(2, len(word) + 3))


def test_kneser_ney_by_the_textbook():
    rows = {"aa": [("banana", 3), ("band", 1), ("an", 2)], "bb": [("cabin", 2), ("abba", 5), ("nab", 1)]}
    models = language.train([(k, w, n) for k, v in rows.items() for w, n in v])
    # the alphabet is that of all languages: teach each hand-made model the size it has there
    letters = {c for v in rows.values() for w, _ in v for c in w} | {">"}
    for k, lang in enumerate(models.langs):
        hand = kneser_ney_by_hand(rows[lang])
        own = {c for w, _ in rows[lang] for c in w} | {">"}
        for word in ("banana", "band", "abba", "nan", "bad"):
            grams, _ = language._codes([word], 3)
            got = float(models.losses(grams)[:, k].sum())
            if own == letters:
                assert math.isclose(got, hand(word), rel_tol=1e-5)
    one = language.train([("aa", w, n) for v in rows.values() for w, n in v])
    hand = kneser_ney_by_hand([x for v in rows.values() for x in v])
    for word in ("banana", "band", "abba", "nan", "cab", "xyz", "q"):
        grams, _ = language._codes([word], 3)
        assert math.isclose(float(one.losses(grams)[:, 0].sum()), hand(word), rel_tol=1e-5), word


def test_language_order_is_bounded():
    with pytest.raises(ValueError):
        language.train([("aa", "word", 1)], order=4)


FOREIGN = [
    "Det är en vacker dag i dag och jag tänker gå ut och promenera i skogen med min hund innan solen går ner bakom bergen",
    "Jesteśmy bardzo zadowoleni z wyników naszej pracy i chcielibyśmy podziękować wszystkim za pomoc w tym roku",
    "Kami pergi ke pasar untuk membeli sayur dan buah segar setiap pagi hari minggu bersama keluarga",
    "zxcv qwrt plmk bnvc xzqw kjhg wqpz mnbv lkjh zzxq wvbn hjkl qqpw mznx", "xkcdq zzyq vvwkx jjqh xkq zpt qqvbn wxzt kpq jvx xxq zzt",
    "한국어 문장 하나 더 있습니다 그리고 또", "日本語の文章がここに書かれていますので読んでください",
]


def test_language_rejection(spark, sf_dir):
    """Foreign and junk texts are rejected, also after half a text of a learned language; what is of the learned languages stays."""
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    models = language.fit(docs)
    assert 0.1 < models.stray < 2 and np.isfinite(models.mean).all() and 0 < models.spread < 0.2 and 0 < models.spread_char < 3
    known = [r.text for r in docs.where("length(text) > 200").orderBy("doc_id").limit(40).collect()]
    mixed = [f"{t[:120]} {f} {f[:40]}" for t, f in zip(known, FOREIGN[:3] * 8, strict=False)]
    scorer = language.Scorer(models)
    assert scorer.decide(FOREIGN)[2].all() and scorer.decide(mixed)[2].mean() >= 0.9
    texts = [r.text for r in docs.collect()]
    assert (~scorer.decide(texts)[2]).mean() >= 0.998
    halves = [f"{a[:200]} {b[:200]}" for a, b in zip(known, reversed(known), strict=True)]
    assert (~scorer.decide(halves)[2]).mean() >= 0.97


def test_language_learns_from_rows(spark):
    """Rows without a language teach nothing, and each row of an id teaches its own language."""
    rows = [(1, "banana band", "aa"), (1, "cabin abba", "bb"), (1, "qqqq xxxx", None), (2, None, "aa"), (None, "zzzz", "aa")] + [(3 + i, w, "aa") for i, w in enumerate(["banana", "nab"] * 4)] * 2
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string, t string")
    words = {r.lang: set() for r in docs.where("lang is not null").collect()}
    models = language.fit(docs, per_language=100)
    assert models.langs and set(models.langs) <= set(words)
    q, _ = language._codes(["q"], 3)
    assert not language._find(models.grams[0], q[:1] & ((1 << 21) - 1))[1].any()
    with pytest.raises(ValueError):
        language.fit(docs, most_languages=1)


def test_language_query(spark, sf_dir):
    got = {r.doc_id: r for r in registry.op6_language_id(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    held = [(r.lang, got[r.doc_id].lang_pred) for r in docs if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(got) == len(docs) and sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(g.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= g.score <= 1 for i, g in got.items())
    assert sum(g.rejected for g in got.values()) <= 0.01 * len(got)


def test_language_hard(spark, sf_dir):
    models = language.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), per_language=50)
    got = {r.doc_id: r for r in language.predict(docs_of(spark, [*HARD, (50, "123 ---"), (51, "한국어 문장 하나 더 있습니다 그리고 또")], CLASH), models).collect()}
    assert all(got[i].lang_pred == "und" and got[i].rejected and got[i].score == 0 for i in (1, 2, 3, 50))
    assert got[51].rejected and got[9].lang_pred in models.langs
    assert language.predict(docs_of(spark, []), models).count() == 0
    none = language.fit(docs_of(spark, [(1, None), (None, "abc")]))
    assert [r.lang_pred for r in language.predict(docs_of(spark, [(1, "abc")]), none).collect()] == ["und"]
    assert [r.doc_id for r in language.keep_known(docs_of(spark, [(1, None), (2, "1 2")], CLASH), models).collect()] == []


def test_quality_query(spark, sf_dir):
    got = {r.doc_id: r for r in registry.op7_quality(spark, sf_dir.replace("sf0.001", "sf0.01")).collect()}
    labels = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/labels.parquet").collect()
    held = [(r.quality, got[r.doc_id]) for r in labels if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(g.held_out for _, g in held) and all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.3) for g in got.values())
    assert sum(q == g.predicted for q, g in held) >= 0.95 * len(held)


def test_quality_hard(spark):
    labels = spark.createDataFrame([(6, 1), (6, None), (9, 1), (12, 0), (None, 0), (99, 1)], "doc_id long, quality int")
    model = quality.fit(docs_of(spark, HARD), labels)
    got = {r.doc_id: r for r in quality.predict(docs_of(spark, HARD, CLASH), model).collect()}
    assert len(got) == len(HARD) and got[12].predicted == 0 and got[7].predicted == 1 and got[1].score == got[2].score == pytest.approx(2 / 3)
    empty = quality.fit(docs_of(spark, HARD), labels.where("doc_id = 99"))
    assert {r.score for r in quality.predict(docs_of(spark, HARD), empty).collect()} == {0.5}
    assert quality.predict(docs_of(spark, []), model).count() == 0
    assert 12 not in [r.doc_id for r in quality.keep_good(docs_of(spark, HARD, CLASH), model).collect()]


def test_bounded_sample(spark):
    from columnade.llm.common import bounded_sample

    df = spark.range(5000).withColumnRenamed("id", "k")
    some = [r.k for r in bounded_sample(df, "k", 20).collect()]
    assert len(set(some)) == 20 and some == [r.k for r in bounded_sample(df.repartition(7), "k", 20).collect()]
    assert {r.k for r in bounded_sample(df.where("k < 30"), "k", 40).collect()} == set(range(30)) and bounded_sample(df.where("false"), "k", 5).count() == 0


def test_empty_tables(spark, bpe, piece_model):
    none = docs_of(spark, [])
    assert substrings.remove_repeats(none).count() == simhash.near_duplicates(none).count() == packing.pack(none, bpe).count() == pieces.digests(none, piece_model).count() == 0
    assert substrings.cut_repeats(none).count() == simhash.keep_one(none).count() == 0


def test_score_is_a_share():
    assert math.isclose(quality.Neighbours(np.ones(1), np.ones((1, 1)), np.ones((2, 1)), np.array([1.0, 0.0]), 0.5, 2).score(np.ones((1, 1)))[0], 0.5)


def test_votes_like_brute_force():
    """Plain k nearest neighbours, ties at the last place included."""
    r = np.random.default_rng(8)
    vectors = r.integers(-2, 3, (60, 3)).astype(float)
    vectors = vectors[np.linalg.norm(vectors, axis=1) > 0]
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    labels = r.integers(0, 2, len(vectors)).astype(float)
    asked = np.concatenate([vectors[:20], np.zeros((1, 3))])
    got = quality.Neighbours(np.ones(1), np.ones((1, 1)), vectors, labels, 0.4, 5).score(asked)
    for x, score in zip(asked, got, strict=True):
        cos = [float(c) for c in vectors @ x]
        last = sorted(cos, reverse=True)[4]
        votes = [(max(c, 0) ** 8, y) for c, y in zip(cos, labels, strict=True) if c >= last - 1e-12]
        assert math.isclose(score, (sum(w * y for w, y in votes) + 0.05 * 0.4) / (sum(w for w, _ in votes) + 0.05), rel_tol=1e-9)


def test_shape_of_a_word_is_whole():
    a, b = quality._terms([b"a-" * 20 + b"a", b"a-" * 20 + b"7"])
    assert a[1] != b[1]
