"""Operators on embeddings, conversations and pages, and the pipeline."""

import hashlib
import re
import subprocess
import sys
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from columnade.llm import chat, embeddings, language, quality, registry, shingles, topk, urls

ROOT = corpus_pipeline.__file__.rsplit("/", 1)[0]
VECTORS = "vec_id long, embedding array<float>, label int, rep long, size long, block long, cell long, n_links long, dims int, rank int"


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_same_as_duckdb(name, same_rows):
    same_rows(registry.queries()[name], registry.oracle_sql()[name])


def vectors_of(spark, rows):
    """Vectors with columns that the operators use themselves."""
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, 1, 1, 1, 1, 1, 1, 1) for i, v, label in rows], VECTORS)


def hard_vectors():
    r = np.random.default_rng(4)
    rows, base = [], r.standard_normal((6, 12))
    for i in range(400):
        v = base[i % 6] + r.standard_normal(12) * (0.02, 0.05, 0.09, 0.3)[i % 4]
        rows.append((i, v.astype(np.float32).tolist(), i % 3 if i % 7 else None))
    same = base[0].astype(np.float32).tolist()
    rows += [(1000 + i, same, 0) for i in range(80)] + [(2000 + i, [2 * x for x in same], 0) for i in range(5)]
    rows += [(3000, None, 0), (3001, [0.0] * 12, 0), (3002, [float("nan")] * 12, 0), (3003, [None, *same[1:]], 0), (3004, [float("inf")] * 12, 0), (3005, [], 0), (3006, same[:3], 0), (3007, same[:3], 0), (3010, [-0.0, 1.0, 0.0], 1), (3011, [0.0, 1.0, -0.0], 1)]
    return rows


def whole(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("least", [0.98, 0.5])
def test_embeddings_like_brute_force(spark, least):
    rows = hard_vectors()
    links = {i: set() for i, _, _ in rows}
    good = [(i, np.array(v, float) / np.linalg.norm(v), k) for i, v, k in rows if whole(v) and any(v) and k is not None]
    for a, (i, x, p) in enumerate(good):
        for j, y, q in good[a + 1 :]:
            if p == q and len(x) == len(y) and x @ y >= least:
                links[i].add(j)
                links[j].add(i)
    part = {}
    for i in sorted(links):
        todo = [i]
        while todo:
            n = todo.pop()
            if n not in part:
                part[n] = i
                todo.extend(links[n])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(vectors_of(spark, rows).repartition(3), least, block=64).collect()}
    assert got == {i: (len(links[i]), part[i], part[i] == i) for i in links}


def test_embeddings_of_shared_ids(spark):
    """Rows of one id link by their own vectors and labels only."""
    a, b, c = [1.0, 0.0, 0.1], [0.0, 1.0, 0.1], [0.0, 0.1, 1.0]
    rows = [(5, a, 1), (6, a, 1), (5, b, 1), (9, b, 1), (5, a, 2), (3, c, 2), (3, a, 2), (7, c, 1), (5, a, 1)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(vectors_of(spark, rows)).collect())
    assert got == sorted([(5, 2, 5, True), (6, 2, 5, False), (5, 1, 5, True), (9, 1, 5, False), (5, 1, 3, False), (3, 0, 3, True), (3, 1, 3, True), (7, 0, 7, True), (5, 2, 5, True)])


def test_embeddings_of_many_blocks(spark):
    """Many small blocks with many partners each give the same as one block, in single and in double precision."""
    r = np.random.default_rng(12)
    x = r.standard_normal((40, 8)).repeat(12, 0) + r.standard_normal((480, 8)) * 0.12
    df = spark.createDataFrame([(i, [float(c) for c in v], "s" if i % 9 else None) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label string")
    one = sorted(map(tuple, embeddings.near_duplicates(df).collect()))
    assert one == sorted(map(tuple, embeddings.near_duplicates(df.repartition(5), block=7).collect())) and len({o[2] for o in one}) < 460
    huge = df.withColumn("embedding", F.transform("embedding", lambda c: c * 1e200))
    assert one == sorted(map(tuple, embeddings.near_duplicates(huge, block=50).collect()))


def test_interval_join_skips_nothing_that_is_near():
    r = np.random.default_rng(1)
    x = r.standard_normal((700, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    basis = embeddings.principal(x, 3)
    x = x[np.lexsort(np.floor(x @ basis / 0.2).T[::-1])]
    found = set()
    embeddings.join_blocks(x, x, x @ basis, x @ basis, True, 0.98, 0.2000001, lambda i, j: found.update(zip(i.tolist(), j.tolist(), strict=True)))
    assert found == {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.98), strict=True) if i < j}


def test_top_k_like_brute_force(spark):
    rows = hard_vectors()
    ints = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]) for i, v, _ in rows if whole(v)]
    got = {}
    for r in topk.top_k(vectors_of(spark, rows), k=5, queries_where="vec_id % 20 = 0").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = {}
    for q, x in ints:
        if q % 20 == 0:
            score = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in ints if i != q and len(x) == len(y))[:5]
            if score:
                want[q] = [(k, i, -s) for k, (s, i) in enumerate(score, 1)]
    assert got == want


def test_impact_index_proves_its_stop():
    r = np.random.default_rng(3)
    ids = np.r_[np.arange(2900), [5] * 100]  # an id of many rows
    for spread in (1, 40, 400, 1 << 22):
        values = (r.standard_normal((3000, 8)) ** 3 * spread).astype(np.int64)
        values[2900:] = values[5]
        asked = np.stack([values[5], -values[9], np.zeros(8, np.int64), *values[100:120]])
        skips = np.array([5, 9, 7, *range(100, 120)])
        for q, skip, (got, score) in zip(asked, skips.tolist(), topk.ImpactIndex(ids, values).search(asked, 5, skips), strict=True):
            best = sorted((-int(s), int(i)) for i, s in zip(ids, values @ q, strict=True) if i != skip)[:5]
            assert [(-int(s), int(i)) for i, s in zip(got, score, strict=True)] == best


def test_impact_index_takes_a_block_at_once():
    r = np.random.default_rng(4)
    x = r.standard_normal((16384, 64))
    values = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    ids, asked = np.arange(16384), np.arange(0, 16384, 16)
    index = topk.ImpactIndex(ids, values)
    began = time.thread_time()
    found = index.search(values[asked], 5, asked)
    assert time.thread_time() - began < 1  # 17 million pairs, posting by posting: some 3 seconds
    for q, (got, score) in list(zip(asked.tolist(), found, strict=True))[::64]:
        exact = values @ values[q]
        exact[q] = -(1 << 62)
        best = np.lexsort((ids, -exact))[:5]
        assert got.tolist() == best.tolist() and score.tolist() == exact[best].tolist()


@pytest.mark.parametrize("offset", [0, 1 << 20, -(1 << 29)])
def test_impact_index_far_from_zero(offset):
    r = np.random.default_rng(5)
    values = r.integers(-90, 90, (700, 3)) + offset
    ids = np.r_[np.arange(300), [2] * 400]  # most rows are a query's own
    for asked, skips in ((values[:7], np.arange(7)), (values[3:], ids[3:])):
        for q, skip, (got, score) in zip(asked, skips.tolist(), topk.ImpactIndex(ids, values).search(asked, 5, skips), strict=True):
            best = sorted((-int(s), int(i)) for i, s in zip(ids, values @ q, strict=True) if i != skip)[:5]
            assert [(-int(s), int(i)) for i, s in zip(got, score, strict=True)] == best


def test_top_k_of_huge_components_and_repeated_queries(spark):
    rows = [(0, [1e30, 1.0], 1), (1, [2.0, 1.0], 1), (50, [3e6, -3e6], 1), (2, [-1e7, 0.0], 1), (100, [1.0, 1.0], 1)]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(vectors_of(spark, rows)).collect())
    assert got == [(50, 1, 1, 3 * 10**6 * 65536), (50, 2, 100, 0), (100, 1, 1, 3 * 65536), (100, 2, 50, 0)]
    rows = [(0, [3.0, 1.0], 1), (0, [1.0, 2.0], 1), (1, [2.0, 0.0], 1), (1, [0.0, 2.0], 1), (2, [1e6, -1e6], 1)]
    got = [(r.query_id, r.vec_id, r.score) for r in topk.top_k(vectors_of(spark, rows)).orderBy("rank").collect()]
    assert got == [(0, 1, 262144), (0, 1, 131072), (0, 2, -(256 * 256 * 10**6))]


def test_empty_vectors(spark):
    none = vectors_of(spark, [])
    assert embeddings.near_duplicates(none).count() == topk.top_k(none).count() == 0


def test_chat_hard(spark):
    rows = [
        (1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 3, "assistant", "c"), (1, 4, "user", None), (2, 1, "user", "</turn>\n<and>\\s\\l <turn assistant>x"),
        (2, 2, "assistant", "\\### Assistant: </turn> ok"), (2, 2, "assistant", "\\### Assistant: </turn> ok"), (3, None, None, "👍🏽 x"), (3, 0, "assistant", ""),
        (4, 1, "a>b<", "t"), (None, 1, "assistant", "z" * 20_000), (5, 1, "assistant", "<and><and>"), (5, 2, "assistant", "\n\n"),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, turns string, runs string")
    made = chat.formatted(df)
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    shown = {r.conv_id: r for r in made.collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t, role or "", text or "") for c, t, role, text in rows if c == conv), key=lambda x: (x[0], x[1] or 0, x[2:]))
        loss = "".join(x[3] for x in turns if x[2] == "assistant")
        want = (conv, len(turns), sha("".join(f"{x[2]}\n{x[3]}\n" for x in turns)), len(loss), sha(loss), len(shown[conv].formatted))
        assert tuple(got[conv]) == want
        runs = re.findall(r"<turn ", shown[conv].formatted)
        assert len(runs) == 1 + sum(a[2] != b[2] for a, b in zip(turns, turns[1:], strict=False))
    assert chat.formatted(df.where("false")).count() == 0


URLS = [
    None, "", "no scheme", "http://A.Example.NET/en/x", "https://x.net", "https://x.net/", "http://u@x.net:80/", "http://net/", "http://EXAMPLE.com/de/a?b#c", "http://xexample.com/de/",
    "http://sub.example.net/EN/", "http://a.org/fr/", "http://example.net/en", "a://b://c/d", "http://x.org?/fr/", "http://x.org#/fr/", "://h/p\nq?r", "http:///p", "http://free-casino-bonus.xyz/play", "http://library.city/books", "http://é.net/" + "x" * 20_000,
]


def test_urls_hard(spark):
    df = spark.createDataFrame([(i, u, "h", "r", "g") for i, u in enumerate(URLS)] + [(None, "http://x.net/", "", "", "")], "page_id long, url string, host string, rule string, grams string")
    got = {r.page_id: r for r in urls.judge(df).collect()}
    bias, weights = urls.train()
    for i, url in enumerate(URLS):
        host = path = ""
        if url and "://" in url:
            m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
            host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]
        fits = [(len(r), r, v) for r, v in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        found = urls.grams(host, path)
        score = bias + (int(np.floor(sum(weights[urls._bucket(g)] for g in found) / np.sqrt(len(found)))) if found else 0)
        rule, verdict = max(fits)[1:] if fits else (None, "block" if score > urls.LEAST else "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict, got[i].score) == (host, path, rule, verdict, score), url
    assert got[18].verdict == "block" and got[19].verdict == "allow" and got[None].rule == "net/"
    assert urls.judge(df.where("false")).count() == 0


def test_urls_stay_in_the_jvm(spark, sf_dir):
    plan = registry.op2_url_filter(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan and "html" not in plan


FOREIGN = "Det är en vacker dag i dag och jag tänker gå ut och promenera i skogen med min hund innan solen går ner bakom bergen igen"


def planted(spark, sf_dir, tmp_path):
    """The tables of sf_dir with more documents: foreign and letterless texts, near copies, empty ones, a null id; as (folder, rows)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    long = sorted((r for r in rows if r[1] and len(r[1].split()) > 150), key=lambda r: r[0])[:12]
    more = [(900_000 + i, f"{FOREIGN} {i}", None, "s", 1) for i in range(3)] + [(900_010, "12 34 ---", "en", "s", 1), (900_011, "", None, None, None), (900_012, None, None, None, None)]
    for k, r in enumerate(long):
        words = r[1].split()
        words[5 + k] = "changed"
        more.append((910_000 + k, " ".join(words), r[2], r[3], None))
    more.append((None, long[0][1], "en", None, 1))
    folder = str(tmp_path / "planted")
    spark.createDataFrame(rows + more, docs.schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return folder, rows + more


def votes_by_hand(model, text):
    """Plain nearest-neighbour votes of one text, ties at the last place included."""
    x = model.project(quality.Terms().counts([text]))[0].astype(float)
    cos = [float(v.astype(float) @ x) for v in model.vectors]
    last = sorted(cos, reverse=True)[: model.k][-1]
    votes = [(max(c, 0.0) ** 8, y) for c, y in zip(cos, model.labels, strict=True) if c >= last - 1e-7]
    return (sum(w * y for w, y in votes) + 0.05 * model.prior) / (sum(w for w, _ in votes) + 0.05)


def test_pipeline(spark, sf_dir, tmp_path):
    """Every stage's rows against brute force on what the one before kept, and run() against the stages."""
    from test_text_operators import check_pieces, removed_by_hand

    folder, rows = planted(spark, sf_dir, tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = [s for _, s in corpus_pipeline.STAGES]
    text_of = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)

    def kept(stage, before):
        after = corpus_pipeline.written(stage(spark, before, folder), "test")
        assert after.columns == docs.columns
        return after

    good = kept(stages[0], docs)
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet").where(corpus_pipeline.fold("doc_id", 5) != 0))
    scores = [(r, votes_by_hand(model, r[1])) for r in rows]
    sure = sorted(((r[0], r[1]) for r, s in scores if s >= 0.3 + 1e-4), key=repr)
    possible = {(r[0], r[1]) for r, s in scores if s >= 0.3 - 1e-4}
    assert set(sure) <= set(text_of(good)) <= possible and len(sure) < len(rows)

    known = kept(stages[1], good)
    models = language.fit(good.where(corpus_pipeline.fold("doc_id", 4) != 2))
    scorer = language.Scorer(models)
    want = []
    for i, text in text_of(good):
        (loss,), (mixed,), (size,) = scorer.score([text])
        if size:
            best = int(loss.argmin())
            limit = models.mean[best] + models.stray + language._DEVIATIONS * (models.spread**2 + models.spread_char**2 / size) ** 0.5
            by_word = [scorer.score([w]) for w in language.words_of(text)]
            assert np.isclose(mixed, sum(float(m[0].min() * n[0]) for m, _, n in by_word) / size, rtol=1e-4)
            want += [(i, text)] if mixed <= limit else []
    assert text_of(known) == want
    gone = {i for i, _ in text_of(good)} - {i for i, _ in want}
    assert {900_000, 900_001, 900_002, 900_010} & {i for i, _ in text_of(good)} <= gone and gone

    single = kept(stages[2], known)
    texts = dict(enumerate(text_of(known)))
    part = brute_components({k: t for k, (_, t) in texts.items()})
    least = {}
    for k, (i, _) in texts.items():
        if i is not None:
            least[part[k]] = min(i, least.get(part[k], i))
    ids = {i for k, (i, _) in texts.items() if i is not None and least[part[k]] == i}
    assert text_of(single) == [(i, t) for i, t in text_of(known) if i is None or i in ids]
    assert any(i and 910_000 <= i < 911_000 for i, _ in text_of(known)) and len(text_of(single)) < len(text_of(known)) - 5

    cut = kept(stages[3], single)
    by_hand = removed_by_hand(text_of(single))
    left = dict(text_of(cut))
    digest = lambda t: hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest()
    assert {i: digest(t) for i, t in left.items() if i is not None} == {i: h for i, (n, m, h) in by_hand.items() if n > m or n == 0}

    path = registry.tokenizer_path("word_bpe_49k.json")
    assert check_pieces(stages[4](spark, cut, folder).collect(), text_of(cut), path, 4096) > 0.9
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(((r.doc_id, r.start, r.length, r.ids_crc32) for r in stages[4](spark, cut, folder).collect()), key=repr)


def test_pipeline_of_nothing(spark, sf_dir, tmp_path):
    """No documents and no labels: no rows, from every stage."""
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    none = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def brute_shingles(text, k=5):
    words = [w for w in re.split("[ \\t\\n\\r\\x0b\\x0c]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_components(texts, least=(4, 5)):
    """Smallest id of each id's component under Jaccard similarity of 5-word shingles, all pairs compared."""
    sets, part = {i: brute_shingles(t) for i, t in texts.items()}, {}
    near = lambda a, b: a == b or len(a & b) * least[1] >= least[0] * len(a | b)
    for i in sorted(texts):
        todo = [i]
        while todo:
            n = todo.pop()
            if n not in part:
                part[n] = i
                todo.extend(j for j in texts if j not in part and near(sets[n], sets[j]))
    return part


def near_copies():
    r = np.random.default_rng(7)
    letter = [" ".join(f"hello{j}" for j in range(30))]  # a passage of all long texts
    texts = {}
    for base in range(12):
        words = [f"w{x}" for x in r.integers(0, 5000, 120)]
        for copy in range(10):
            changed = list(words)
            for at in r.choice(120, copy, replace=False):
                changed[at] = f"new{r.integers(1 << 30)}"
            texts[100 * base + copy] = " ".join(letter + changed)
        texts[100 * base + 50] = " ".join(letter + words).upper().replace(" ", "\n ")
        texts[100 * base + 51] = " ".join(words[60:] + words[:60])
        texts[100 * base + 52] = " ".join([*words[:8], "x"])  # 5 shingles: 4 of them are those of the next
        texts[100 * base + 53] = " ".join(words[:8])
        texts[100 * base + 54] = " ".join([*words[:7], "x"])
    return texts | {5000: "", 5001: None, 5002: " ", 5003: "one two", 5004: "One  two", 5005: "one two three four five", 5006: "one two three four"}


def test_near_copies_like_brute_force(spark):
    texts = near_copies()
    want = brute_components(texts)
    df = spark.createDataFrame([(i, t, "s") for i, t in texts.items()] + [(None, "one two", "s")], "doc_id long, text string, sig string").repartition(3)
    for together, entry in ((4_000_000, 1000), (500, 5)):  # whole groups and entries, and groups in parts and entries tied unseen
        assert {r.doc_id: r.component_id for r in shingles.similar_components(df, together=together, entry=entry).collect()} == want
    assert 30 < len(set(want.values())) < len(want) - 30
    kept = [r.doc_id for r in shingles.keep_one(df).collect()]
    assert sorted(i for i in kept if i is not None) == sorted(set(want.values())) and kept.count(None) == 1
    assert shingles.keep_one(df.where("false")).count() == 0


def test_runs_of_one_key_end_where_sizes_do_not_fit():
    key, n, sig = np.array([1, 1, 1, 1, 2, 2]), np.array([8, 10, 10, 13, 5, 5]), np.array([4, 3, 3, 9, 4, 3])
    assert sig[shingles._chained(key, n, sig, 0.8)].tolist() == [4, 4, 4, 9, 4, 4]


def test_sketches_never_rule_out_a_link():
    r = np.random.default_rng(3)
    sets = []
    for size in (1, 3, 60, 200, 250, 270, 1000, 1030, 5000):
        base = r.integers(0, 1 << 63, size, dtype=np.uint64)
        for share in (0, 0.05, 0.1, 0.15, 0.3):
            kept = base[r.random(size) >= share / 2]
            sets.append(np.unique(np.concatenate([kept, r.integers(0, 1 << 63, int(size * share / 2), dtype=np.uint64)])))
    n = np.array([len(x) for x in sets])
    marks = shingles.Marks(n, [shingles.sketch(x, 1 << w).tobytes() for x, w in zip(sets, shingles.width(n).tolist(), strict=True)], 0.8)
    a, b = np.nonzero(np.ones((len(sets), len(sets))))
    may, links = marks.may(a, b), []
    for i, j, m in zip(a.tolist(), b.tolist(), may.tolist(), strict=True):
        both, union = shingles.similarity(sets[i], sets[j])
        links.append(both >= 0.8 * union)
        assert m or not links[-1]
    assert 100 < sum(links) <= may.sum() < 0.3 * len(may)


def test_entries_in_any_batches():
    """Shared entries and ties do not depend on how rows are dealt to batches, nor on what is tied unseen."""
    r = np.random.default_rng(5)
    base = [np.unique(r.integers(0, 1 << 63, 60, dtype=np.uint64)) for _ in range(3)]
    rows = [(int(k), len(base[k % 3]), int(i), shingles.sketch(base[k % 3], 256).tobytes()) for k in range(9) for i in range(1 + 20 * (k % 4 == 0) + k)]
    table = pa.table({n: pa.array(c, t) for n, c, t in zip(("key", "n", "sig", "mark"), zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)})
    for size, most in ((3, 1000), (1000, 1000), (7, 4), (50, 1)):
        shingles._ROWS, old = size, shingles._ROWS
        found = [x for b in shingles._tie_batches(0.8, most)(iter(table.to_batches(max_chunksize=5))) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        kept = [x for b in shingles._shared_entries(0.8)(iter(table.select(["key", "n", "sig"]).to_batches(max_chunksize=5))) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        shingles._ROWS = old
        assert kept == [x[:3] for x in rows]
        assert {v for _, v in found} | {u for u, _ in found} == {x[2] for x in rows} and len({u for u, v in found} - {v for u, v in found}) == 1


def test_near_copies_of_shared_ids(spark):
    a, b = (" ".join(f"{k}{i}" for i in range(60)) for k in "ab")
    rows = [(5, a), (5, b), (7, f"{a} x"), (3, f"{b} x"), (9, "other")]
    got = sorted((r.doc_id, r.component_id) for r in shingles.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 3), (5, 3), (5, 5), (7, 5), (9, 9)]


def test_pipeline_drops_near_copies(spark, sf_dir):
    texts = near_copies()
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars int")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, sf_dir).collect()} == set(brute_components(texts).values())


def test_pipeline_goes_through_simhash(spark, sf_dir, monkeypatch):
    """Fingerprints of 5-word shingles reach operator 10's deletion variants; what these tie is compared even if the index ties nothing."""
    found, tie = {}, shingles.fingerprint_components

    def seen(nodes):
        found["fps"] = {r.fp % 2**64 for r in nodes.collect()}
        found["classes"] = tie(nodes)
        return found["classes"]

    monkeypatch.setattr(shingles, "fingerprint_components", seen)
    monkeypatch.setattr(shingles, "_tie_batches", lambda least, most: lambda batches: iter(()))
    long = [f"w{i * 7919 % 1009}" for i in range(900)]
    texts = {1: " ".join(long), 2: " ".join([*long[:-1], "x"]), 3: " ".join(["y", *long[1:]]), 4: " ".join(f"v{i}" for i in range(300)), 5: None}
    sets = {i: shingles.shingle_set(shingles._words(t)) for i, t in texts.items()}
    prints = {i: sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in s) > len(s)) for i, s in sets.items()}
    assert (prints[1] ^ prints[2]).bit_count() <= 3 and (prints[1] ^ prints[3]).bit_count() <= 3 and (prints[1] ^ prints[4]).bit_count() > 3
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars int")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, sf_dir).collect()} == {1, 4, 5}
    assert found["fps"] == set(prints.values())


def test_rest_stands_without_the_subpackage(tmp_path):
    code = f"import sys; sys.path.insert(0, {ROOT!r}); sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'flagship_filter' in q and 'pipeline' not in q and not any(k.startswith('op1_') for k in q)"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=60)
    names = subprocess.run(["grep", "-rlE", "columnade.llm|from columnade import llm", f"{ROOT}/columnade", "--include=*.py"], capture_output=True, text=True).stdout.split()
    assert all("/columnade/llm/" in n for n in names)


def test_urls_of_hosts_never_seen(spark, sf_dir):
    """Hosts of ``pages`` are not in the labelled table; those of spam are told from the others."""
    spam = {"ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"}
    table = {h.split(".example")[0].split(".")[-1] for h, _, _ in urls.LABELLED}
    big = sf_dir.replace("sf0.001", "sf0.01")
    rows = urls.judge(spark.read.parquet(f"{big}/pages.parquet")).where("host <> ''").collect()
    names = {r.host: set(r.host.split(".")) for r in rows}
    assert not table & set().union(*names.values())
    good = [r.score > urls.LEAST for r in rows if not names[r.host] & spam]
    bad = [r.score > urls.LEAST for r in rows if names[r.host] & spam]
    assert len(good) > 100 and len(bad) > 10 and sum(good) <= 0.01 * len(good) and sum(bad) >= 0.9 * len(bad)
