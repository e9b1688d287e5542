r"""Chat formatting with Spark expressions only.

A conversation becomes runs of equal roles, each ``<turn ROLE>TEXT</turn>``
and a line feed; texts of one run stand between ``<and>`` marks. In roles and
texts ``\`` is written ``\s``, ``<`` ``\l`` and ``>`` ``\g``, so that no text
can hold a mark and every text can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ESCAPES = (("\\", "\\s"), ("<", "\\l"), (">", "\\g"))
_OPEN, _CLOSE, _AND = "<turn ", "</turn>\n", "<and>"


def escape(c: Column) -> Column:
    for plain, safe in _ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def unescape(c: Column) -> Column:
    for plain, safe in reversed(_ESCAPES):
        c = F.replace(c, F.lit(safe), F.lit(plain))
    return c


def formatted(rows: DataFrame, learned_role: str = "assistant") -> DataFrame:
    """``conv_id, formatted, loss_spans`` of every conversation of ``rows`` (conv_id, turn, role, text).

    Turns are sorted by turn (null first), then role and text; null roles and
    texts count as empty, and repeated rows are turns of their own. Adjacent
    turns of one role are merged to a run. loss_spans are the (start, length)
    in characters of each text of ``learned_role``, without marks. Rows with a
    null conv_id are one conversation; no rows give no rows; other columns are
    not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    turns = rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text)
    # where each text starts in the output: a running sum over the turns, with what stands before each text
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    before = F.lag("role").over(order)
    opened = F.length(escape(F.col("role"))) + F.lit(len(_OPEN) + 1) + F.when(before.isNull(), F.lit(0)).otherwise(F.lit(len(_CLOSE)))
    size = F.length(escape(F.col("text"))).cast("long")
    laid = turns.withColumn("size", size).withColumn("lead", F.when(before == F.col("role"), F.lit(len(_AND))).otherwise(opened).cast("long"))
    laid = laid.withColumn("start", F.sum(F.col("lead") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    sorted_turns = laid.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "start", "size"))).alias("turns"))
    n = F.size("turns")
    role = lambda i: F.get("turns", i).role
    numbers = F.sequence(F.lit(0), n - 1)
    starts = F.filter(numbers, lambda i: (i == 0) | (role(i) != role(i - 1)))
    cut = sorted_turns.withColumn("starts", starts).withColumn("ends", F.concat(F.slice("starts", 2, F.size("starts")), F.array(n)))
    runs = F.zip_with("starts", "ends", lambda a, b: F.struct(role(a).alias("role"), F.transform(F.slice("turns", a + 1, b - a), lambda t: escape(t.text)).alias("texts")))
    said = F.array_join(F.transform(runs, lambda r: F.concat(F.lit(_OPEN), escape(r.role), F.lit(">"), F.array_join(r.texts, _AND), F.lit(_CLOSE))), "")
    learned = F.transform(F.filter("turns", lambda t: t.role == learned_role), lambda t: F.struct(t.start.alias("start"), t["size"].alias("length")))
    return cut.select("conv_id", said.alias("formatted"), learned.alias("loss_spans"))


def _turns_of(run: Column) -> Column:
    role = unescape(F.regexp_extract(run, r"^<turn ([^>]*)>", 1))
    texts = F.split(F.regexp_replace(run, r"^<turn [^>]*>", ""), _AND)
    return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))


def turns_of(formatted: Column) -> Column:
    """Array of (role, text), read back from a formatted conversation."""
    runs = F.filter(F.split(formatted, _CLOSE), lambda r: r != "")
    return F.flatten(F.transform(runs, _turns_of))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    cut = F.transform(spans, lambda s: F.substring(formatted, (s.start + 1).cast("int"), s.length.cast("int")))
    return unescape(F.array_join(cut, ""))


def digests(chats: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, all read back from ``formatted`` and ``loss_spans``."""
    read = chats.select("conv_id", turns_of(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


#: DuckDB SQL for the digests over a table ``chat_rows`` (conv_id, turn, role, text).
SQL = r"""
    t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM chat_rows),
    e AS (SELECT *, replace(replace(replace(role, '\', '\s'), '<', '\l'), '>', '\g') AS er, replace(replace(replace(text, '\', '\s'), '<', '\l'), '>', '\g') AS et,
                 coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) = role, false) AS goes_on FROM t),
    d AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
                 coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
                 sum(length(et) + CASE WHEN goes_on THEN 5 ELSE 15 + length(er) END) AS chars FROM e GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars FROM d"""
