"""One query per operator and function, over whole tables, each with its DuckDB form."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from columnade.functions.spec import user_function
from columnade.operators import Engine
from columnade.plans.errors import AnalysisError, ParseError
from columnade.sources import json_document, json_documents, json_rows, read_table, write_ids

_KEYS = {
    "lineitem": ("l_orderkey", "l_linenumber"), "orders": ("o_orderkey",), "part": ("p_partkey",), "events": ("event_id",),
    "customer": ("c_custkey",), "supplier": ("s_suppkey",), "documents": ("doc_id",),
}


@dataclass(frozen=True)
class Query:
    """``text`` goes through the engine; ``duck`` is the same for DuckDB. ``kind`` is the type of a projected value, or empty for a filter.

    ``derived`` columns (plain SQL of both engines) are added to the table before.
    """

    table: str
    text: str
    duck: str
    kind: str = ""
    derived: tuple[tuple[str, str], ...] = ()

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark)
        df = read_table(spark, sf_dir, self.table)
        for name, sql in self.derived:
            df = df.withColumn(name, F.expr(sql))
        keys = [*_KEYS[self.table]]
        if not self.kind:
            return engine.filter(df, self.text).select(*keys)
        return engine.project(df, {"v": self.text}, keys)

    def oracle(self) -> str:
        own = "".join(f", {sql} AS {name}" for name, sql in self.derived)
        source = f"(SELECT *{own} FROM {self.table})"
        keys = ", ".join(_KEYS[self.table])
        if not self.kind:
            return f"SELECT {keys} FROM {source} WHERE {self.duck}"
        return f"SELECT {keys}, CAST({self.duck} AS {self.kind}) AS v FROM {source}"


_NL = (("n_line", "nullif(l_linenumber, 3)"), ("n_qty", "nullif(l_quantity, 10)"), ("n_flag", "nullif(l_returnflag, 'R')"))
_NB = (("small", "nullif(l_linenumber, 3) < 2"), ("cheap", "nullif(l_quantity, 10) < 20"))
_NE = (("kind", "nullif(event_type, 'click')"), ("worth", "nullif(event_type, 'click') = 'view'"))
_NUMS = (("num_text", "concat(cast(l_linenumber AS varchar(9)), 'x')"), ("dec_text", "concat(cast(l_linenumber AS varchar(9)), '.5')"), ("bool_text", "CASE WHEN l_linenumber = 1 THEN 'TRUE' WHEN l_linenumber = 2 THEN '0' ELSE 'maybe' END"))
_DATES = (
    ("iso", "concat(concat('1997-03-', lpad(cast(l_linenumber AS varchar(9)), 2, '0')), 'T10:20:30')"),
    ("us", "concat(concat('03-', lpad(cast(l_linenumber AS varchar(9)), 2, '0')), '-1997 10:20')"),
)
#: Values beyond 64-bit numbers, not a number, and texts of numbers on both sides of what an INT holds.
_HUGE = (("huge", "CASE WHEN c_custkey % 4 = 0 THEN 1e300 WHEN c_custkey % 4 = 1 THEN -1e300 WHEN c_custkey % 4 = 2 THEN cast('NaN' AS double) ELSE c_acctbal END"), ("places", "CASE WHEN c_custkey % 3 = 0 THEN 400 WHEN c_custkey % 3 = 1 THEN 1 ELSE -1 END"))
_WIDE = (("wide", "concat('21474836', cast(46 + l_linenumber % 3 AS varchar(9)))"),)
_ZONES = (("zone", "CASE WHEN event_id % 3 = 0 THEN 'Asia/Tokyo' WHEN event_id % 3 = 1 THEN 'America/New_York' ELSE 'Europe/Berlin' END"),)
_OLD = (("old", "cast(concat('18', cast(10 + l_linenumber * 9 AS varchar(9)), '-07-05 03:04:05') AS timestamp)"),)
_SPACES = (("spaced", "concat(concat('  ', c_mktsegment), '   ')"),)
_GEO = (("lat", "20.0 + cast(s_suppkey AS double) / 500"), ("lon", "-80.0 + cast(s_nationkey AS double)"))
_ORDER_SECONDS = "epoch(date_trunc('second', o_orderdate))::BIGINT"
_EVENT = "date_trunc('second', ts)"
_ORDER = "date_trunc('second', o_orderdate)"
_CLOCK = f"({_ORDER} - date_trunc('day', o_orderdate))"


def _shift(months: int, rest: str = "") -> str:
    sign = "+" if months >= 0 else "-"
    return f"date_trunc('month', o_orderdate) {sign} INTERVAL {abs(months)} MONTH + (day(o_orderdate) - 1) * INTERVAL 1 DAY + {_CLOCK}{rest}"


_HAVERSINE = (
    "2 * 3958.8 * atan2(sqrt(pow(sin(radians(40.0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(40.0)) * pow(sin(radians(-83.0 - lon) / 2), 2)), "
    "sqrt(1 - (pow(sin(radians(40.0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(40.0)) * pow(sin(radians(-83.0 - lon) / 2), 2))))"
)

CATALOGUE: dict[str, Query] = {
    "flagship_filter": Query("lineitem", "l_quantity < 10 AND l_returnflag = 'a' AND l_shipdate >= '1997-01-01'", "l_quantity < 10 AND lower(l_returnflag) = 'a' AND l_shipdate >= TIMESTAMP '1997-01-01'"),
    "cmp_lt": Query("lineitem", "l_quantity < 10", "l_quantity < 10"),
    "cmp_le": Query("lineitem", "l_quantity <= 10", "l_quantity <= 10"),
    "cmp_gt": Query("lineitem", "l_quantity > 40", "l_quantity > 40"),
    "cmp_ge": Query("lineitem", "l_linenumber >= 3", "l_linenumber >= 3"),
    "cmp_eq": Query("lineitem", "l_linenumber = 3", "l_linenumber = 3"),
    "cmp_ne": Query("lineitem", "l_linenumber <> 3", "l_linenumber <> 3"),
    "cmp_column_column": Query("lineitem", "l_linenumber > l_tax * 100", "l_linenumber > l_tax * 100"),
    "eq_double_equals": Query("lineitem", "l_linenumber == 3", "l_linenumber = 3"),
    "int_column_double_literal": Query("lineitem", "l_linenumber < 2.5", "l_linenumber < 2.5"),
    "str_ci_eq": Query("lineitem", "l_returnflag = 'a'", "lower(l_returnflag) = 'a'"),
    "str_ci_lt": Query("part", "p_brand < 'brand#3'", "lower(p_brand) < 'brand#3'"),
    "str_ci_ne": Query("part", "p_brand != 'BRAND#11'", "lower(p_brand) <> 'brand#11'"),
    "str_number_literal": Query("lineitem", "num = 3", "num = '3'", derived=(("num", "cast(l_linenumber AS varchar(9))"),)),
    "datetime_eq": Query("orders", "o_orderdate = '1996-01-02'", f"{_ORDER} = TIMESTAMP '1996-01-02'"),
    "datetime_epoch_literal": Query("orders", "o_orderdate >= 852076800", f"{_ORDER} >= TIMESTAMP '1997-01-01'"),
    "datetime_beyond": Query("orders", "o_orderdate < 1e18 AND NOT o_orderdate > 99999999999999 AND o_orderdate BETWEEN -1e18 AND 1e18", "TRUE"),
    "datetime_beyond_none": Query("orders", "o_orderdate >= 1e18 OR o_orderdate < -99999999999999", "FALSE"),
    "datetime_le_seconds": Query("events", "ts <= '2024-01-03T12:00:00'", f"{_EVENT} <= TIMESTAMP '2024-01-03 12:00:00'"),
    "datetime_gt_seconds": Query("events", "ts > '2024-01-03T12:00:00'", f"{_EVENT} > TIMESTAMP '2024-01-03 12:00:00'"),
    "bool_and": Query("lineitem", "l_quantity < 10 AND l_tax > 0.05", "l_quantity < 10 AND l_tax > 0.05"),
    "bool_or": Query("lineitem", "l_quantity < 10 OR l_tax > 0.05", "l_quantity < 10 OR l_tax > 0.05"),
    "bool_not": Query("lineitem", "NOT l_returnflag = 'A'", "NOT lower(l_returnflag) = 'a'"),
    "bool_nested": Query("lineitem", "NOT (l_quantity < 10 OR l_tax > 0.05) AND (l_linenumber = 1 OR l_linenumber = 2)", "NOT (l_quantity < 10 OR l_tax > 0.05) AND (l_linenumber = 1 OR l_linenumber = 2)"),
    "and_strict_null": Query("lineitem", "(n_line < 2 AND n_qty < 20) IS NULL", "n_line IS NULL OR n_qty IS NULL", derived=_NL),
    "or_strict_null": Query("lineitem", "n_line < 2 OR n_qty < 20", "(n_line < 2 OR n_qty < 20) AND n_line IS NOT NULL AND n_qty IS NOT NULL", derived=_NL),
    "not_null_dropped": Query("lineitem", "NOT n_line < 2", "n_line >= 2", derived=_NL),
    "fold_or_true": Query("lineitem", "n_line < 2 OR 1 = 1", "TRUE", derived=_NL),
    "fold_and_false": Query("lineitem", "(n_line < 2 AND 1 = 2) IS FALSE", "TRUE", derived=_NL),
    "between_int": Query("part", "p_size BETWEEN 10 AND 20", "p_size BETWEEN 10 AND 20"),
    "between_double": Query("part", "p_size BETWEEN 10.5 AND p_retailprice", "p_size BETWEEN 10.5 AND p_retailprice"),
    "between_string": Query("part", "p_brand BETWEEN 'brand#2' AND 'BRAND#4'", "lower(p_brand) BETWEEN 'brand#2' AND 'brand#4'"),
    "between_datetime": Query("orders", "o_orderdate BETWEEN '1996-01-01' AND '1996-12-31'", f"{_ORDER} BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'"),
    "between_null": Query("lineitem", "(n_line BETWEEN 1 AND n_qty) IS NULL", "n_line IS NULL OR n_qty IS NULL", derived=_NL),
    "not_between_int": Query("part", "p_size NOT BETWEEN 10 AND 20", "p_size NOT BETWEEN 10 AND 20"),
    "not_between_double": Query("part", "p_retailprice NOT BETWEEN 950.5 AND 1000.5", "p_retailprice NOT BETWEEN 950.5 AND 1000.5"),
    "not_between_string": Query("part", "p_brand NOT BETWEEN 'brand#2' AND 'BRAND#4'", "lower(p_brand) NOT BETWEEN 'brand#2' AND 'brand#4'"),
    "not_between_datetime": Query("orders", "o_orderdate NOT BETWEEN '1996-01-01' AND '1996-12-31'", f"{_ORDER} NOT BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'"),
    "not_between_null": Query("lineitem", "n_line NOT BETWEEN 1 AND 2", "n_line NOT BETWEEN 1 AND 2", derived=_NL),
    "in_int": Query("part", "p_size IN (1, 5, 9)", "p_size IN (1, 5, 9)"),
    "in_string": Query("events", "event_type IN ['CLICK', 'view']", "lower(event_type) IN ('click', 'view')"),
    "in_double_promoted": Query("lineitem", "l_quantity IN (1, 2.0, 3)", "l_quantity IN (1.0, 2.0, 3.0)"),
    "in_datetime": Query("orders", "o_orderdate IN ('1996-01-02', '1997-05-05')", f"{_ORDER} IN (TIMESTAMP '1996-01-02', TIMESTAMP '1997-05-05')"),
    "not_in": Query("part", "p_size NOT IN (1, 5, 9)", "p_size NOT IN (1, 5, 9)"),
    "not_in_null_true": Query("lineitem", "n_flag NOT IN ('a')", "coalesce(lower(n_flag) NOT IN ('a'), TRUE)", derived=_NL),
    "like": Query("part", "p_name LIKE '%A%'", "p_name ILIKE '%a%'"),
    "like_prefix": Query("part", "p_brand LIKE 'BRAND#1%'", "p_brand ILIKE 'brand#1%'"),
    "like_space_wildcard": Query("part", "p_type LIKE '% % %'", "p_type ILIKE '%%%%%'"),
    "like_underscore": Query("part", "p_brand LIKE 'brand#_1'", "p_brand ILIKE 'brand#_1'"),
    "not_like": Query("part", "p_brand NOT LIKE 'brand#1%'", "p_brand NOT ILIKE 'brand#1%'"),
    "not_like_null": Query("lineitem", "n_flag NOT LIKE 'a%'", "n_flag NOT ILIKE 'a%'", derived=_NL),
    "is_null": Query("events", "kind IS NULL", "kind IS NULL", derived=_NE),
    "is_not_null": Query("events", "kind IS NOT NULL", "kind IS NOT NULL", derived=_NE),
    "is_true": Query("events", "worth IS TRUE", "worth IS TRUE", derived=_NE),
    "is_not_true": Query("events", "worth IS NOT TRUE", "worth IS NOT TRUE", derived=_NE),
    "is_false": Query("events", "worth IS FALSE", "worth IS FALSE", derived=_NE),
    "is_not_false": Query("events", "worth IS NOT FALSE", "worth IS NOT FALSE", derived=_NE),
    "and_value_null": Query("lineitem", "small AND cheap", "CASE WHEN small IS NOT NULL AND cheap IS NOT NULL THEN small AND cheap END", "BOOLEAN", _NB),
    "or_value_null": Query("lineitem", "small OR cheap", "CASE WHEN small IS NOT NULL AND cheap IS NOT NULL THEN small OR cheap END", "BOOLEAN", _NB),
    "add_int": Query("lineitem", "l_linenumber + 7", "l_linenumber + 7", "INTEGER"),
    "sub_int": Query("lineitem", "l_linenumber - 7", "l_linenumber - 7", "INTEGER"),
    "mul_int": Query("lineitem", "l_linenumber * 7", "l_linenumber * 7", "INTEGER"),
    "div_int": Query("lineitem", "l_linenumber / 2", "l_linenumber / 2", "DOUBLE"),
    "add_double": Query("lineitem", "l_quantity + l_tax", "l_quantity + l_tax", "DOUBLE"),
    "sub_double": Query("lineitem", "l_quantity - l_tax", "l_quantity - l_tax", "DOUBLE"),
    "mul_double": Query("lineitem", "l_extendedprice * (1.0 - l_discount)", "l_extendedprice * (1.0::DOUBLE - l_discount)", "DOUBLE"),
    "div_double": Query("lineitem", "l_extendedprice / l_quantity", "l_extendedprice / l_quantity", "DOUBLE"),
    "div_by_zero_null": Query("lineitem", "l_linenumber / (l_linenumber - 3)", "CASE WHEN l_linenumber <> 3 THEN l_linenumber / (l_linenumber - 3) END", "DOUBLE"),
    "precedence": Query("lineitem", "(l_linenumber + 2) * 3 - -l_linenumber", "(l_linenumber + 2) * 3 + l_linenumber", "INTEGER"),
    "unary_minus": Query("customer", "-c_acctbal", "-c_acctbal", "DOUBLE"),
    "str_plus": Query("lineitem", "l_returnflag + l_linestatus", "l_returnflag || l_linestatus", "VARCHAR"),
    "str_plus_null": Query("lineitem", "n_flag + l_linestatus", "n_flag || l_linestatus", "VARCHAR", _NL),
    "dt_plus_int_days": Query("orders", "o_orderdate + 3", f"{_ORDER} + INTERVAL 3 DAY", "TIMESTAMP"),
    "dt_minus_int_days": Query("orders", "o_orderdate - 3", f"{_ORDER} - INTERVAL 3 DAY", "TIMESTAMP"),
    "dt_plus_double_days": Query("orders", "o_orderdate + 1.5", f"{_ORDER} + INTERVAL 36 HOUR", "TIMESTAMP"),
    "dt_minus_double_days": Query("orders", "o_orderdate - 0.25", f"{_ORDER} - INTERVAL 6 HOUR", "TIMESTAMP"),
    "dt_minus_dt_seconds": Query("events", "ts - TIMESTAMP '2024-01-01'", f"date_diff('second', TIMESTAMP '2024-01-01', {_EVENT})", "DOUBLE"),
    "dt_plus_interval_month": Query("orders", "o_orderdate + INTERVAL '13 months'", _shift(13), "TIMESTAMP"),
    "dt_minus_interval_month": Query("orders", "o_orderdate - INTERVAL '1 month'", _shift(-1), "TIMESTAMP"),
    "dt_plus_interval_day": Query("orders", "o_orderdate + INTERVAL '1 day 2 hours'", f"{_ORDER} + INTERVAL 26 HOUR", "TIMESTAMP"),
    "dt_plus_interval_iso": Query("orders", "o_orderdate + INTERVAL P1Y2M3DT4H5M6S", _shift(14, " + INTERVAL 3 DAY + INTERVAL 4 HOUR + INTERVAL 5 MINUTE + INTERVAL 6 SECOND"), "TIMESTAMP"),
    "dt_interval_predicate": Query("orders", "o_orderdate + INTERVAL 7 DAYS > '1998-01-01'", f"{_ORDER} + INTERVAL 7 DAY > TIMESTAMP '1998-01-01'"),
    "cast_bool_int": Query("lineitem", "COALESCE(CAST(small AS INT), -1)", "coalesce(small::INTEGER, -1)", "INTEGER", _NB),
    "cast_bool_double": Query("lineitem", "CAST(small AS DOUBLE)", "small::INTEGER", "DOUBLE", _NB),
    "cast_bool_string": Query("lineitem", "CAST(small AS STRING)", "small", "VARCHAR", _NB),
    "cast_int_bool": Query("lineitem", "CAST(l_linenumber - 1 AS BOOL)", "l_linenumber <> 1", "BOOLEAN"),
    "cast_int_datetime": Query("orders", "CAST(o_orderkey * 1000 AS DATETIME)", "make_timestamp(o_orderkey * 1000000000)", "TIMESTAMP"),
    "cast_int_double": Query("lineitem", "CAST(l_linenumber AS DOUBLE)", "l_linenumber", "DOUBLE"),
    "cast_int_string": Query("lineitem", "CAST(l_orderkey AS VARCHAR)", "l_orderkey", "VARCHAR"),
    "cast_double_bool": Query("lineitem", "CAST(l_discount AS BOOLEAN)", "l_discount <> 0", "BOOLEAN"),
    "cast_double_datetime": Query("lineitem", "CAST(l_extendedprice AS DATETIME)", "make_timestamp(trunc(l_extendedprice)::BIGINT * 1000000)", "TIMESTAMP"),
    "cast_double_int": Query("customer", "CAST(c_acctbal AS INT)", "trunc(c_acctbal)", "INTEGER"),
    "cast_double_string": Query("customer", "CAST(c_acctbal AS STRING)", "printf('%f', c_acctbal)", "VARCHAR"),
    "cast_string_bool": Query("lineitem", "CAST(bool_text AS BOOL)", "CASE lower(bool_text) WHEN 'true' THEN TRUE WHEN '1' THEN TRUE WHEN 'false' THEN FALSE WHEN '0' THEN FALSE END", "BOOLEAN", _NUMS),
    "cast_string_int": Query("lineitem", "CAST(num_text AS INT)", "regexp_extract(num_text, '^\\s*([+-]?\\d+)', 1)", "INTEGER", _NUMS),
    "cast_string_int_range": Query("lineitem", "COALESCE(CAST(wide AS INT), -1)", "coalesce(TRY_CAST(wide AS INTEGER), -1)", "INTEGER", _WIDE),
    "cast_string_int_range_constant": Query("lineitem", "COALESCE(CAST('2147483648' AS INT), -1) + COALESCE('2147483646'::INT, -1)", "2147483645", "INTEGER"),
    "cast_double_int_range_constant": Query("lineitem", "COALESCE(CAST(3e9 AS INT), -1)", "-1", "INTEGER"),
    "cast_string_double": Query("lineitem", "CAST(dec_text AS NUMERIC)", "dec_text", "DOUBLE", _NUMS),
    "cast_string_datetime": Query("lineitem", "CAST(iso AS DATETIME)", "strptime(iso, '%Y-%m-%dT%H:%M:%S')", "TIMESTAMP", _DATES),
    "cast_string_datetime_us": Query("lineitem", "us::DATETIME", "strptime(us, '%m-%d-%Y %H:%M')", "TIMESTAMP", _DATES),
    "cast_datetime_string": Query("events", "CAST(ts AS STRING)", f"strftime({_EVENT}, '%Y-%m-%dT%H:%M:%S')", "VARCHAR"),
    "cast_operator": Query("lineitem", "l_quantity::INT::STRING", "trunc(l_quantity)::INTEGER", "VARCHAR"),
    "convert_fn": Query("lineitem", "CONVERT(INT, l_quantity)", "trunc(l_quantity)", "INTEGER"),
    "cast_fn": Query("lineitem", "CAST(l_quantity AS INTEGER)", "trunc(l_quantity)", "INTEGER"),
    "concat": Query("lineitem", "CONCAT(n_flag, l_linestatus, l_linenumber)", "nullif(concat(n_flag, l_linestatus, l_linenumber::VARCHAR), '')", "VARCHAR", _NL),
    "concat_all_null": Query("lineitem", "CONCAT(n_flag)", "nullif(n_flag, '')", "VARCHAR", _NL),
    "length": Query("documents", "LENGTH(text)", "strlen(text)", "INTEGER"),
    "lower": Query("part", "LOWER(p_brand)", "lower(p_brand)", "VARCHAR"),
    "lower_unicode": Query("documents", "LOWER(text)", "lower(text)", "VARCHAR"),
    "upper": Query("part", "UPPER(p_name)", "upper(p_name)", "VARCHAR"),
    "substr2": Query("part", "SUBSTR(p_name, 3)", "CASE WHEN 3 <= length(p_name) THEN substr(p_name, 3) END", "VARCHAR"),
    "substr3": Query("part", "SUBSTRING(p_name, 2, 4)", "CASE WHEN 2 <= length(p_name) THEN substr(p_name, 2, 4) END", "VARCHAR"),
    "substr_oob_null": Query("part", "SUBSTR(p_brand, p_size)", "CASE WHEN p_size BETWEEN 1 AND length(p_brand) THEN substr(p_brand, p_size) END", "VARCHAR"),
    "trim": Query("customer", "TRIM(spaced)", "trim(spaced, ' ')", "VARCHAR", _SPACES),
    "ltrim": Query("customer", "LTRIM(spaced)", "ltrim(spaced, ' ')", "VARCHAR", _SPACES),
    "rtrim": Query("customer", "RTRIM(spaced)", "rtrim(spaced, ' ')", "VARCHAR", _SPACES),
    "coalesce": Query("lineitem", "COALESCE(n_line, 0)", "coalesce(n_line, 0)", "INTEGER", _NL),
    "coalesce_string": Query("lineitem", "COALESCE(n_flag, l_linestatus)", "coalesce(n_flag, l_linestatus)", "VARCHAR", _NL),
    "coalesce_promoted": Query("lineitem", "COALESCE(n_line, l_tax)", "coalesce(n_line::DOUBLE, l_tax)", "DOUBLE", _NL),
    "round1": Query("lineitem", "ROUND(l_quantity / 4 + 0.1)", "round(l_quantity / 4 + 0.1::DOUBLE)", "DOUBLE"),
    "round2": Query("lineitem", "ROUND(l_linenumber / 7.0, 3)", "round(l_linenumber / 7.0::DOUBLE, 3)", "DOUBLE"),
    "floor_huge": Query("customer", "FLOOR(huge)", "floor(huge)", "DOUBLE", _HUGE),
    "ceil_huge": Query("customer", "CEIL(huge)", "ceil(huge)", "DOUBLE", _HUGE),
    # adding zero: rounding gives no negative zero here
    "round2_column": Query("customer", "ROUND(c_acctbal, places)", "CASE places WHEN 400 THEN c_acctbal WHEN 1 THEN round(c_acctbal * 10) / 10 ELSE round(c_acctbal * 0.1::DOUBLE) / 0.1::DOUBLE END + 0.0::DOUBLE", "DOUBLE", _HUGE),
    "floor": Query("customer", "FLOOR(c_acctbal)", "floor(c_acctbal)", "DOUBLE"),
    "ceil": Query("customer", "CEIL(c_acctbal)", "ceil(c_acctbal)", "DOUBLE"),
    "sum_row": Query("lineitem", "SUM(l_tax, l_discount)", "l_tax + l_discount", "DOUBLE"),
    "sum_row_null": Query("lineitem", "SUM(n_line, n_qty)", "coalesce(n_line::DOUBLE, 0.0) + coalesce(n_qty, 0.0)", "DOUBLE", _NL),
    "avg_row": Query("lineitem", "AVG(l_tax, l_discount)", "(l_tax + l_discount) / 2", "DOUBLE"),
    "avg_row_null": Query("lineitem", "AVG(n_line, n_qty)", "(n_line::DOUBLE + n_qty) / 2", "DOUBLE", _NL),
    "min_row": Query("lineitem", "MIN(l_tax, l_discount)", "least(l_tax, l_discount)", "DOUBLE"),
    "max_row": Query("lineitem", "MAX(l_tax, l_discount)", "greatest(l_tax, l_discount)", "DOUBLE"),
    "min_row_null": Query("lineitem", "COALESCE(MIN(n_line, 4), -1)", "coalesce(CASE WHEN n_line IS NOT NULL THEN least(n_line, 4) END, -1)", "INTEGER", _NL),
    "max_row_null": Query("lineitem", "COALESCE(MAX(n_line, 4), -1)", "coalesce(CASE WHEN n_line IS NOT NULL THEN greatest(n_line, 4) END, -1)", "INTEGER", _NL),
    "min_row_string": Query("customer", "MIN(c_mktsegment, 'furniture')", "CASE WHEN 'furniture' < lower(c_mktsegment) THEN 'furniture' ELSE c_mktsegment END", "VARCHAR"),
    "max_row_string": Query("customer", "MAX(c_mktsegment, 'furniture')", "CASE WHEN 'furniture' > lower(c_mktsegment) THEN 'furniture' ELSE c_mktsegment END", "VARCHAR"),
    "max_row_datetime": Query("orders", "MAX(o_orderdate, TIMESTAMP '1997-01-01')", f"greatest({_ORDER}, TIMESTAMP '1997-01-01')", "TIMESTAMP"),
    "datepart": Query("orders", "DATEPART(YEAR, o_orderdate)", "year(o_orderdate)", "INTEGER"),
    "datepart_text": Query("orders", "DATEPART('month', o_orderdate)", "month(o_orderdate)", "INTEGER"),
    **{f"extract_{f}": Query("events", f"EXTRACT({f.upper()} FROM ts)", d, "INTEGER") for f, d in (
        ("year", "year(ts)"), ("month", "month(ts)"), ("day", "day(ts)"), ("hour", "hour(ts)"), ("minute", "minute(ts)"), ("second", "second(ts)"),
        ("quarter", "quarter(ts)"), ("week", "week(ts)"), ("doy", "dayofyear(ts)"), ("dow", "dayofweek(ts)"), ("isodow", "isodow(ts)"),
    )},
    **{f"short_{f}": Query("orders", f"{f.upper()}(o_orderdate)", d, "INTEGER") for f, d in (
        ("year", "year(o_orderdate)"), ("month", "month(o_orderdate)"), ("day", "day(o_orderdate)"), ("hour", "hour(o_orderdate)"), ("minute", "minute(o_orderdate)"),
        ("second", "second(o_orderdate)"), ("quarter", "quarter(o_orderdate)"), ("week", "week(o_orderdate)"), ("doy", "dayofyear(o_orderdate)"), ("dayofyear", "dayofyear(o_orderdate)"),
        ("dow", "dayofweek(o_orderdate)"), ("dayofweek", "dayofweek(o_orderdate)"), ("isodow", "isodow(o_orderdate)"), ("isodayofweek", "isodow(o_orderdate)"),
    )},
    **{f"trunc_{p}": Query("events", f"DATE_TRUNC('{p}', ts)", f"date_trunc('{p}', ts)", "TIMESTAMP") for p in ("second", "minute", "hour", "day", "month", "quarter", "year")},
    "trunc_week": Query("events", "DATE_TRUNC('week', ts)", "date_trunc('day', ts) - dayofweek(ts) * INTERVAL 1 DAY", "TIMESTAMP"),
    "trunc_decade": Query("orders", "DATE_TRUNC('decade', o_orderdate)", "make_timestamp(year(o_orderdate) // 10 * 10, 1, 1, 0, 0, 0)", "TIMESTAMP"),
    "trunc_century": Query("orders", "DATE_TRUNC('century', o_orderdate)", "make_timestamp(year(o_orderdate) // 100 * 100, 1, 1, 0, 0, 0)", "TIMESTAMP"),
    "trunc_millennium": Query("events", "DATE_TRUNC('millennium', ts)", "make_timestamp(year(ts) // 1000 * 1000, 1, 1, 0, 0, 0)", "TIMESTAMP"),
    "convert_tz": Query("events", "CONVERT_TZ(ts, 'America/New_York')", f"timezone('America/New_York', ({_EVENT} || '+00')::TIMESTAMPTZ)", "TIMESTAMP"),
    "convert_tz_column": Query("events", "CONVERT_TZ(ts, zone)", f"timezone(zone, ({_EVENT} || '+00')::TIMESTAMPTZ)", "TIMESTAMP", _ZONES),
    **{f"trunc_{p}_before_1900": Query("lineitem", f"DATE_TRUNC('{p}', old)", d, "TIMESTAMP", _OLD) for p, d in (
        ("day", "date_trunc('day', old)"), ("quarter", "date_trunc('quarter', old)"), ("week", "date_trunc('day', old) - dayofweek(old) * INTERVAL 1 DAY"),
        ("century", "make_timestamp(year(old) // 100 * 100, 1, 1, 0, 0, 0)"), ("millennium", "make_timestamp(year(old) // 1000 * 1000, 1, 1, 0, 0, 0)"),
    )},
    **{f"now_{n}": Query("orders", f"DATE_TRUNC('day', {c}) = CURRENT_DATE AND {c} >= CURRENT_DATE AND o_orderdate < {c}", "o_orderdate < current_date") for n, c in (
        ("now", "NOW()"), ("getdate", "GETDATE()"), ("current_timestamp", "CURRENT_TIMESTAMP()"),
    )},
    "now_current_date": Query("orders", "CURRENT_DATE = DATE_TRUNC('day', CURRENT_DATE) AND o_orderdate + 40000 > CURRENT_DATE", f"{_ORDER} + INTERVAL 40000 DAY > current_date"),
    "now_family": Query("orders", "o_orderdate < NOW() AND o_orderdate < GETDATE() AND o_orderdate < CURRENT_TIMESTAMP() AND o_orderdate < CURRENT_DATE", "o_orderdate < current_date"),
    "timestamp_literal": Query("events", "ts >= TIMESTAMP '2024-01-05 06:07:08'", "ts >= TIMESTAMP '2024-01-05 06:07:08'"),
    "timestamp_literal_zone": Query("events", "ts < '2024-01-05T06:07:08+02:00'", "ts < TIMESTAMP '2024-01-05 04:07:08'"),
    "interval_literal_string_compare": Query("lineitem", "span = INTERVAL '3 DAYS'", "lower(span) = '3 days'", derived=(("span", "concat(cast(l_linenumber AS varchar(9)), ' days')"),)),
    "geo_distance": Query("supplier", "ROUND(GEO_DISTANCE(lat, lon, 40.0, -83.0), 6)", f"round({_HAVERSINE}, 6)", "DOUBLE", _GEO),
    "number_underscore": Query("lineitem", "l_orderkey < 1_000", "l_orderkey < 1000"),
    "number_exponent": Query("lineitem", "l_extendedprice < 1.5e4 AND l_quantity > 1e1", "l_extendedprice < 15000 AND l_quantity > 10"),
    "semicolon": Query("lineitem", "l_linenumber = 3;", "l_linenumber = 3"),
    "no_expression": Query("lineitem", "  ", "TRUE"),
    "comment_and_quotes": Query("part", "p_brand = 'brand#11' /* either */ OR p_name = 'it''s' -- or this\n", "lower(p_brand) = 'brand#11' OR lower(p_name) = 'it''s'"),
}


def streaming_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine's filter on a stream of the events table, run to its end; the rows that came out."""
    from columnade.streaming import filter_stream

    like = read_table(spark, sf_dir, "events")
    files = like.inputFiles()
    folder, pattern = (sf_dir, "events.parquet") if len(files) == 1 and files[0].endswith("/events.parquet") else (f"{sf_dir}/events.parquet", "*.parquet")
    name = f"columnade_{uuid.uuid4().hex}"
    stream = filter_stream(spark, folder, like, "event_type = 'CLICK' AND value > 10", pattern).select("event_id", "event_type", "value")
    query = stream.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def _shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; one of this machine only where all tasks run on it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(found or 'file://' + tempfile.mkdtemp()).rstrip('/')}/columnade/{uuid.uuid4().hex}"


#: Columns of ``nation`` as a JSON document defines them.
_NATION = [{"name": "n_nationkey", "type": "INT"}, {"name": "n_regionkey", "type": "INT"}, {"name": "n_name", "type": "STRING"}]


def _nation_rows(spark: SparkSession, sf_dir: str) -> list[dict]:
    """The rows of ``nation``, which a JSON document holds on the driver; a table that is no small one is refused."""
    rows = [r.asDict() for r in read_table(spark, sf_dir, "nation").select(*[c["name"] for c in _NATION]).limit(10_001).collect()]
    if len(rows) > 10_000:
        raise ValueError("nation has too many rows for a document")
    return rows


def json_document_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``nation`` through a JSON document of columns, rows and queries; the document's own query filters it."""
    with tempfile.TemporaryDirectory() as folder:
        path = Path(folder, "nation.json")
        path.write_text(json.dumps({"table": {"name": "nation", "columns": _NATION, "rows": _nation_rows(spark, sf_dir)}, "queries": [{"sql": "n_regionkey IN (1, 3) AND n_name > 'c'"}]}))
        df, asked = json_document(spark, path)
    return Engine(spark).filter(df, asked[0]["sql"]).select("n_nationkey", "n_name")


def json_documents_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder with a document for each region of ``nation``; rows of all that each one's query lets through."""
    rows, found = _nation_rows(spark, sf_dir), []
    with tempfile.TemporaryDirectory() as folder:
        for region in sorted({r["n_regionkey"] for r in rows}):
            path = Path(folder, str(region), "part.json")
            path.parent.mkdir()
            path.write_text(json.dumps({"table": {"name": "part", "columns": _NATION, "rows": [r for r in rows if r["n_regionkey"] == region]}, "queries": [{"sql": f"n_nationkey > {5 * region}"}]}))
        for _, df, asked in json_documents(spark, folder):
            found.append(Engine(spark).filter(df, asked[0]["sql"]))
    return reduce(DataFrame.unionByName, found).select("n_nationkey", "n_name")


def json_rows_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files: the definition of ``supplier``, and its rows as JSON that Spark writes and reads."""
    where = f"{_shared_folder(spark)}-rows"
    read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal").write.json(where)
    with tempfile.TemporaryDirectory() as folder:
        definition = Path(folder, "definition.json")
        definition.write_text(json.dumps({"columns": [{"name": "s_suppkey", "type": "INT"}, {"name": "s_name", "type": "STRING"}, {"name": "s_acctbal", "type": "DOUBLE"}]}))
        df = json_rows(spark, str(definition), where)
    return Engine(spark).filter(df, "s_acctbal > 0").select("s_suppkey", "s_name", "s_acctbal")


def ids_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of a filter through the sink, read back."""
    where = f"{_shared_folder(spark)}-ids"
    write_ids(Engine(spark).filter(read_table(spark, sf_dir, "orders"), "o_totalprice > 200000"), where, "o_orderkey")
    return spark.read.text(where).select(F.col("value").cast("long").alias("o_orderkey"))


def registered_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A host's function with two arguments, in a predicate and in a value."""
    engine = Engine(spark)
    engine.register(user_function("NET", ("DOUBLE", "DOUBLE"), "DOUBLE", lambda price, off: price * (1 - off), "price less discount"))
    df = read_table(spark, sf_dir, "lineitem")
    return engine.project(engine.filter(df, "NET(l_extendedprice, l_discount) > 20000 AND net(1, 0) = 1"), {"v": "NET(l_extendedprice, l_discount)"}, ["l_orderkey", "l_linenumber"])


def replaced_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A host's function in the place of a built-in one, and another engine that still has the built-in."""
    engine = Engine(spark)
    engine.register(user_function("LENGTH", ("STRING",), "INT", lambda c: F.length(c) + 100))
    df = read_table(spark, sf_dir, "part")
    return Engine(spark).project(engine.project(df, {"mine": "LENGTH(p_name)"}, ["p_partkey", "p_name"]), {"built_in": "LENGTH(p_name)"}, ["p_partkey", "mine"])


def reserved_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column's name that a host has reserved is refused; other engines know it. One row says both."""
    engine, df = Engine(spark), read_table(spark, sf_dir, "part")
    engine.reserve("p_size")
    try:
        engine.filter(df, "p_size > 10")
        refused = False
    except (ParseError, AnalysisError):
        refused = True
    return Engine(spark).filter(df, "p_size > 10").agg(F.count("*").alias("n")).select("n", F.lit(refused).alias("refused"))


def resolved_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that the host resolves itself."""
    df = read_table(spark, sf_dir, "lineitem")
    return Engine(spark).filter(df, "l_quantity > 60", columns={"l_quantity": F.col("l_quantity") + 20}).select("l_orderkey", "l_linenumber")


def introspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of some well-known functions and operators an engine lists, each with a description."""
    known, want = Engine(spark).functions(), ("AND", "BETWEEN", "LIKE", "ROUND", "DATE_TRUNC", "GEO_DISTANCE", "CONVERT_TZ", "COALESCE")
    return spark.range(1).select(F.lit(sum(bool(known.get(w)) for w in want)).alias("listed"), F.lit(len(known) >= 67).alias("all_of_them"))


def explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sections the explanation of an expression has; nothing is read but the schema."""
    said = Engine(spark).explain("p_size > 1 AND 1 = 1", read_table(spark, sf_dir, "part").schema)
    return spark.range(1).select(*[F.lit(f"== {w} ==" in said).alias(w.lower()) for w in ("Tokens", "Tree", "Bound", "Folded")])


def refused_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of some wrong expressions are refused with a message before any row is read."""
    schema, wrong = read_table(spark, sf_dir, "orders").schema, ("o_totalprice ? 3", "o_totalprice >", "nothing = 1", "NO_SUCH(1)", "o_orderdate::INT", "ROUND()", "SELECT = 1", "(o_orderkey = 1")
    refused = 0
    for text in wrong:
        try:
            Engine(spark).compile(text, schema)
        except (ParseError, AnalysisError) as e:
            refused += bool(str(e))
    return spark.range(1).select(F.lit(refused).alias("refused"), F.lit(len(wrong)).alias("wrong"))


_HOST: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "streaming_filter": (streaming_filter, "SELECT event_id, event_type, value FROM events WHERE lower(event_type) = 'click' AND value > 10"),
    "json_document_source": (json_document_source, "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 3) AND lower(n_name) > 'c'"),
    "json_documents_source": (json_documents_source, "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey > 5 * n_regionkey"),
    "json_rows_source": (json_rows_source, "SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_acctbal > 0"),
    "ids_sink": (ids_sink, "SELECT o_orderkey FROM orders WHERE o_totalprice > 200000"),
    "registered_function": (registered_function, "SELECT l_orderkey, l_linenumber, l_extendedprice * (1::DOUBLE - l_discount) AS v FROM lineitem WHERE l_extendedprice * (1::DOUBLE - l_discount) > 20000"),
    "replaced_function": (replaced_function, "SELECT p_partkey, length(p_name)::INTEGER + 100 AS mine, strlen(p_name)::INTEGER AS built_in FROM part"),
    "reserved_word": (reserved_word, "SELECT count(*) AS n, TRUE AS refused FROM part WHERE p_size > 10"),
    "resolved_columns": (resolved_columns, "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity + 20 > 60"),
    "introspection": (introspection, "SELECT 8 AS listed, TRUE AS all_of_them"),
    "explained": (explained, "SELECT TRUE AS tokens, TRUE AS tree, TRUE AS bound, TRUE AS folded"),
    "refused_expressions": (refused_expressions, "SELECT 8 AS refused, 8 AS wrong"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**{name: q.run for name, q in CATALOGUE.items()}, **{name: run for name, (run, _) in _HOST.items()}}


def oracle_sql() -> dict[str, str]:
    return {**{name: q.oracle() for name, q in CATALOGUE.items()}, **{name: sql for name, (_, sql) in _HOST.items()}}
