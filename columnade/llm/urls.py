"""URL filters: rules, and logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import functools
import hashlib
import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: N-grams of 3 and 4 characters go to so many buckets (the first three hex digits of their MD5).
BUCKETS = 4096
_SIZES = (3, 4)
#: Weights are whole millionths, so that a sum is the same in any order.
_UNIT = 1_000_000
#: A URL is blocked above these log-odds (millionths): in doubt it stays.
LEAST = 250_000

#: Everyday words of harmless hosts, and words that hosts of advertising, gambling, fraud and smut are put together from.
_GOOD = (
    "library archive encyclopedia news garden docs project university museum weather health recipes forum astronomy city kids journal radio history "
    "science maps theatre school books choir trains farm bread bookshop harvest mathematics athletics hikes shopping parents winter sport alphabet "
    "addresses advice roads education pilots silk golf thread thunder there therapy thousand thin mother weather other together earth north south "
    "nation station tension mention action ocean river mountain kitchen painting morning evening reading writing music letters house street "
    "information translation stone island forest tower inner interest inherit western eastern ribbon orchard fisher baker shepherd tiny tide"
).split()
_BAD = "spam casino bets porn xxx viagra pills adult ads bonus jackpot poker slots escorts warez crack torrent malware phish payday loans scam replica lottery popup cheap free win track farm".split()
_LEADS = ("", "www.", "blog.", "m.")
_PATHS = ("/", "/en/12", "/de/853/", "/fr/474.html", "/es/71250")


def _labelled() -> tuple[tuple[str, str, int], ...]:
    """Harmless words, alone and in pairs, and pairs of the others; both kinds stand behind the same leads and before the same neutral paths."""
    hosts = [(w, 0) for w in _GOOD] + [(f"{a}-{b}", 0) for a, b in zip(_GOOD, _GOOD[7:], strict=False)]
    hosts += [(f"{_BAD[i]}-{_BAD[(i + step) % len(_BAD)]}", 1) for step in (1, 4, 9, 14) for i in range(len(_BAD))]
    rows = [(f"{_LEADS[i % 4]}{h}.example", _PATHS[i % 5], bad) for i, (h, bad) in enumerate(hosts)]
    rows += [(f"{_LEADS[(i + 1) % 4]}{h}.example", _PATHS[(i + 2) % 5], bad) for i, (h, bad) in enumerate(hosts)]
    rows += [("store.example", f"/{a}/{b}", 1) for a, b in zip(_BAD, _BAD[5:], strict=False)] + [("store.example", f"/{a}/{b}", 0) for a, b in zip(_GOOD, _GOOD[5:30], strict=False)]
    return tuple(rows)


#: (host, path, blocked): the small labelled table that the weights are learned from, made by a rule from everyday words.
LABELLED = _labelled()

#: (rule, verdict): host and path prefix in one string.
RULES: tuple[tuple[str, str], ...] = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def grams(host: str, path: str) -> list[str]:
    """All n-grams of ``^host$`` under h and of ``^path$`` under p; repeats count."""
    out = []
    for mark, text in (("h", host), ("p", path)):
        if text:
            whole = f"^{text}$"
            out += [mark + whole[i : i + n] for n in _SIZES for i in range(len(whole) - n + 1)]
    return out


def _bucket(gram: str) -> int:
    return int(hashlib.md5(gram.encode("utf-8", "surrogatepass")).hexdigest()[:3], 16)


@functools.cache
def train(rows: tuple[tuple[str, str, int], ...] = LABELLED, rounds: int = 120, rate: float = 1.0, decay: float = 1e-3) -> tuple[int, tuple[int, ...]]:
    """Bias and bucket weights in millionths, by full-batch gradient steps on the small labelled table.

    Each URL's counts are divided by the root of their number, as in
    :func:`judge`; the table is data of the program, at most a few thousand rows.
    """
    features = []
    for host, path, blocked in rows:
        counts: dict[int, float] = {}
        found = grams(host, path)
        for g in found:
            counts[_bucket(g)] = counts.get(_bucket(g), 0.0) + 1 / math.sqrt(len(found))
        features.append((counts, blocked))
    bias, weights = 0.0, [0.0] * BUCKETS
    for _ in range(rounds):
        slope, slopes = 0.0, {}
        for counts, y in features:
            z = bias + sum(weights[b] * v for b, v in counts.items())
            error = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y) / len(features)
            slope += error
            for b, v in counts.items():
                slopes[b] = slopes.get(b, 0.0) + error * v
        bias -= rate * slope
        weights = [w * (1 - rate * decay) for w in weights]
        for b, s in slopes.items():
            weights[b] -= 10 * rate * s
    return round(bias * _UNIT), tuple(round(w * _UNIT) for w in weights)


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or none: empty."""
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits (of equal length the first), or null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        of, slash, prefix = rule.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(slash + prefix)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _grams(mark: str, text: Column) -> Column:
    whole = F.concat(F.lit("^"), text, F.lit("$"))

    def of_size(n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(whole) - n + 1, F.lit(1)))
        cut = F.transform(places, lambda i: F.concat(F.lit(mark), F.substring(whole, i, F.lit(n))))
        return F.when((text != "") & (F.length(whole) >= n), cut).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of_size(n) for n in _SIZES])


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, labelled: tuple[tuple[str, str, int], ...] = LABELLED, id_col: str = "page_id", url_col: str = "url", least: int = LEAST) -> DataFrame:
    """``page_id, host, path, rule, verdict, by_rule, score`` for every row; built-in expressions only.

    verdict is the rule's where one fits, else `block` where the model's
    score (log-odds in millionths, of n-gram weights over the root of their
    number) is above ``least``. A null url or one without ``://`` has an empty host
    and path, no n-gram, and the bias as its score. Repeated rows give repeated
    rows; a null id stays null; no rows give no rows; other columns are not read.
    """
    bias, weights = train(tuple(labelled))
    table = F.from_json(F.lit(json.dumps(list(weights))), "array<bigint>")
    url = F.col(url_col)
    parts = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    found = parts.withColumn("grams", F.concat(_grams("h", F.col("host")), _grams("p", F.col("path"))))
    weight = lambda g: F.element_at(table, (F.conv(F.substring(F.md5(g.cast("binary")), 1, 3), 16, 10).cast("int") + 1))
    total = F.aggregate("grams", F.lit(0).cast("long"), lambda s, g: s + weight(g))
    count = F.size("grams")
    score = F.lit(bias) + F.when(count > 0, F.floor(total / F.sqrt(count.cast("double")))).otherwise(F.lit(0)).cast("long")
    rule = best_rule(F.col("host"), F.col("path"), rules)
    verdicts = F.lit(None).cast("string")
    for name, verdict in rules:
        verdicts = F.when(F.col("rule") == name, F.lit(verdict)).otherwise(verdicts)
    judged = found.select(id_col, "host", "path", rule.alias("rule"), score.alias("score"))
    return judged.select(id_col, "host", "path", "rule", F.coalesce(verdicts, F.when(F.col("score") > least, "block").otherwise("allow")).alias("verdict"), F.col("rule").isNotNull().alias("by_rule"), "score")


def sql(rules: tuple[tuple[str, str], ...] = RULES, labelled: tuple[tuple[str, str, int], ...] = LABELLED, least: int = LEAST) -> str:
    """DuckDB SQL for the rows of :func:`judge` over pages."""
    bias, weights = train(tuple(labelled))
    case, verdict = "NULL", "NULL"
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        of, slash, prefix = rule.partition("/")
        case = f"CASE WHEN (host = '{of}' OR ends_with(host, '.{of}')) AND starts_with(path, '{slash + prefix}') THEN '{rule}' ELSE {case} END"
    for rule, said in rules:
        verdict = f"CASE WHEN rule = '{rule}' THEN '{said}' ELSE {verdict} END"
    lists = " || ".join(f"CASE WHEN {c} <> '' AND length({c}) + 2 >= {n} THEN list_transform(range(1, length({c}) + 4 - {n}), lambda i: '{m}' || substring('^' || {c} || '$', i, {n})) ELSE [] END" for m, c in (("h", "host"), ("p", "path")) for n in _SIZES)
    return f"""
    WITH parts AS (
      SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    found AS (SELECT *, {lists} AS grams FROM parts),
    weights AS (SELECT {list(weights)}::BIGINT[] AS w),
    summed AS (SELECT page_id, host, path, {case} AS rule, len(grams) AS n,
             list_sum(list_transform(grams, lambda g: w[('0x' || substr(md5(g), 1, 3))::INT + 1])) AS total FROM found, weights),
    scored AS (SELECT *, {bias} + CASE WHEN n > 0 THEN floor(total::DOUBLE / sqrt(n::DOUBLE)) ELSE 0 END::BIGINT AS score FROM summed)
    SELECT page_id, host, path, rule, coalesce({verdict}, CASE WHEN score > {least} THEN 'block' ELSE 'allow' END) AS verdict, rule IS NOT NULL AS by_rule, score::BIGINT AS score FROM scored"""
