"""The library's functions for SQL users: temporary SQL functions, which Catalyst writes into the query like Columns."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .text import MARKED, NO_TOKEN, PLAIN

_NO_TOKEN = NO_TOKEN.replace("'", "\\'")
_DECADE = "cast(floor(year(d) / 10) * 10 as int)"
FUNCTIONS = {
    "search_text(x string) returns string": f"translate(coalesce(x, ''), '{MARKED}', '{PLAIN}')",
    "search_token(x string) returns string": f"nullif(trim(array_join(split(translate(lower(x), '{MARKED}', '{PLAIN}'), '{_NO_TOKEN}'), ' ')), '')",
    "date_span(d date, precision string) returns struct<lo: date, hi: date>": f"""case when d is not null then named_struct(
        'lo', case precision when 'decade' then make_date({_DECADE}, 1, 1) when 'year' then make_date(year(d), 1, 1) when 'month' then cast(date_trunc('month', d) as date) else d end,
        'hi', case precision when 'decade' then make_date({_DECADE} + 9, 12, 31) when 'year' then make_date(year(d), 12, 31) when 'month' then last_day(d) else d end) end""",
    "hamming_bits(a bigint, b bigint) returns int": "bit_count(a ^ b)",
    "ramp(x double, lo double, hi double) returns double": "least(greatest((x - lo) / (hi - lo), 0), 1)",
}
TABLES = {
    "hash_bands(hexa string) returns table (band int, value string)": "select i, substring(hexa, 4 * i + 1, 4) from explode(sequence(0, 15)) as t(i)",
}


def register(spark: SparkSession) -> None:
    """Makes them known to the session; again does no harm. Aggregates need none: the built-in ones do."""
    for head, body in (FUNCTIONS | TABLES).items():
        spark.sql(f"create or replace temporary function {head} return {body}")
