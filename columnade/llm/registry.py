"""The queries of this subpackage and, where SQL can express them, their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from columnade.llm import chat, embeddings, language, packing, pieces, quality, simhash, substrings, topk, urls
from columnade.llm.common import fold, table, tune


def tokenizer_path(name: str) -> str:
    """Where the installed public vocabulary file ``name`` lies (the operators take any path)."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all ``documents`` packed to sequences of 4096 ids, 64 windows open a task. Null texts are empty; no rows give none (see :func:`packing.pack`)."""
    return packing.pack(table(tune(spark), sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), size=4096, most_open=64, end_id=2)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on the url of every row of ``pages``; null urls have an empty host and path (see :func:`urls.judge`)."""
    return urls.judge(table(tune(spark), sf_dir, "pages"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and the row kept for every row of ``embeddings``, cosine 0.98 or more within a label (see :func:`embeddings.near_duplicates`)."""
    return embeddings.near_duplicates(table(tune(spark), sf_dir, "embeddings"), least=0.98)


_HARD = "\\### Assistant: </turn> ok"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests read back from all formatted ``conversations`` and from conversation -7, whose texts hold control strings (see :func:`chat.formatted`)."""
    rows = table(tune(spark), sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    turns = F.array(*[F.struct(F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role")) for k, role in enumerate(("user", "assistant"))])
    hard = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(turns).alias("t")).select("conv_id", "t.turn", "t.role", F.lit(_HARD).alias("text"))
    return chat.digests(chat.formatted(rows.unionByName(hard)))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and digests of the ids of every text of ``documents``, and of what they decode to (see :func:`pieces.digests`)."""
    return pieces.digests(table(tune(spark), sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text of ``documents``, learned from those whose crc32(doc_id) mod 4 is not 2 (see :func:`language.fit`, :func:`language.predict`)."""
    docs = table(tune(spark), sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    models = language.fit(docs.where(~held_out))
    found = language.predict(docs, models)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected", "cross_entropy")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every text of ``documents``, learned from labels whose crc32(doc_id) mod 5 is not 0 (see :func:`quality.fit`, :func:`quality.predict`)."""
    docs, labels = table(tune(spark), sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold("doc_id", 5) == 0
    model = quality.fit(docs, labels.where(~held_out))
    return quality.predict(docs, model, threshold=0.3).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text of ``documents`` without the windows of 20 words that start earlier too (see :func:`substrings.remove_repeats`)."""
    return substrings.remove_repeats(table(tune(spark), sf_dir, "documents"), window=20)


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of each row of ``embeddings`` whose vec_id is divisible by 50, against all rows (see :func:`topk.top_k`)."""
    return topk.top_k(table(tune(spark), sf_dir, "embeddings"), k=5, queries_where="vec_id % 50 = 0", scale=256)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 3-word shingles of every text of ``documents`` and their components at three or fewer differing bits (see :func:`simhash.near_duplicates`)."""
    return simhash.near_duplicates(table(tune(spark), sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_packing, op2_url_filter, op3_embedding_dedup, op4_chat_format, op5_sentencepiece,
        op6_language_id, op7_quality, op8_substring_dedup, op9_topk, op10_simhash,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    hard = _HARD.replace("'", "''")
    return {
        "op2_url_filter": urls.sql(),
        "op3_embedding_dedup": """
    WITH RECURSIVE r AS (SELECT row_number() OVER () AS rid, vec_id, label, embedding FROM embeddings),
    u AS (SELECT rid, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM r
               WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    n AS (SELECT rid, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM u),
    link AS (SELECT a.rid AS a, b.rid AS b FROM n a JOIN n b ON a.label = b.label AND a.rid <> b.rid AND len(a.e) = len(b.e)
             WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
    reach AS (SELECT rid AS a, rid AS b FROM r UNION SELECT reach.a, l.b FROM reach JOIN link l ON reach.b = l.a),
    comp AS (SELECT a, min(vec_id) AS component_id FROM reach JOIN r ON r.rid = reach.b GROUP BY a),
    cnt AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
    SELECT r.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, r.vec_id = component_id AS kept
    FROM r JOIN comp ON comp.a = r.rid LEFT JOIN cnt ON cnt.a = r.rid""",
        "op4_chat_format": f"""
    WITH chat_rows AS (SELECT conv_id, turn, role, text FROM conversations
                       UNION ALL SELECT -7, 0, 'user', '{hard}' UNION ALL SELECT -7, 1, 'assistant', '{hard}'),{chat.SQL}""",
        "op9_topk": """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
               WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                 AND len(list_filter(embedding, lambda x: abs(floor(256 * x::DOUBLE)) >= sqrt(4611686018427387904.0::DOUBLE / len(embedding)))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
          FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    }
