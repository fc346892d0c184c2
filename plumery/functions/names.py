"""Ids, times and keys that are held in names, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def part(name: Column, n: int) -> Column:
    """The n-th part (from 0) between underscores, or null."""
    return F.get(F.split(name, "_"), F.lit(n))


def flight_id(name: Column) -> Column:
    """``ang20160922t184215`` of ``ang20160922t184215_cmf_v1g_img``."""
    return part(name, 0)


def flight_time(name: Column) -> Column:
    """Time of a flight id: three letters and yyyyMMddtHHmmss, or ``f`` with yyMMddtHHmmss; null if there is none."""
    long = F.regexp_extract(name, r"^[a-z]{3}(\d{8})t(\d{6})", 1), F.regexp_extract(name, r"^[a-z]{3}(\d{8})t(\d{6})", 2)
    short = F.regexp_extract(name, r"^f(\d{6})t(\d{6})", 1), F.regexp_extract(name, r"^f(\d{6})t(\d{6})", 2)
    text = F.when(long[0] != "", F.concat(*long)).when(short[0] != "", F.concat(F.lit("20"), *short))
    return F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss"))


def year_tag(name: Column) -> Column:
    """The id's instrument letters and two-digit year, as ``ang16``."""
    return F.concat(F.regexp_extract(name, r"^([a-z]+)\d", 1), F.date_format(flight_time(name), "yy"))


def product_id(name: Column) -> Column:
    return part(name, 1)


def calibration_id(name: Column) -> Column:
    """The third part; names that start with ``f`` have it in two parts."""
    return F.when(name.startswith("f"), F.concat_ws("_", part(name, 2), part(name, 3))).otherwise(part(name, 2))


def candidate_time(candidate: Column) -> Column:
    """Time in a candidate id such as ``ang20200906t195820-A``; null if the id is malformed."""
    return F.try_to_timestamp(F.concat(F.substring(candidate, 4, 8), F.substring(candidate, 13, 6)), F.lit("yyyyMMddHHmmss"))


def candidate_minute(candidate: Column) -> Column:
    """Time to the minute, by the first ``yyyyMMddtHHmm`` in the id."""
    m = [F.regexp_extract(candidate, r"(\d{8})t(\d{4})", k) for k in (1, 2)]
    return F.try_to_timestamp(F.nullif(F.concat(*m), F.lit("")), F.lit("yyyyMMddHHmm"))


def parse_time(text: Column) -> Column:
    """``8/21/2018 18:49:59 UTC`` or ``yyyyMMddHHmmss``."""
    return F.coalesce(
        F.try_to_timestamp(F.regexp_replace(text, " UTC$", ""), F.lit("M/d/yyyy H:mm:ss")), F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss"))
    )


def bounding_hours(time: Column, n: int) -> Column:
    """Array of the hour of ``time`` and n hours before and after; n < 0: empty."""
    if n < 0:
        return F.array().cast("array<timestamp>")
    hour = F.date_trunc("hour", time)
    return F.transform(F.sequence(F.lit(-n), F.lit(n)), lambda k: F.timestamp_seconds(F.unix_seconds(hour) + k * 3600))


def bounding_quarters(time: Column, n: int) -> Column:
    """Array of the nearest quarter-hour and those n steps around; n < 0: empty."""
    if n < 0:
        return F.array().cast("array<timestamp>")
    s = F.unix_seconds(time)
    return F.transform(F.sequence(F.lit(-n), F.lit(n)), lambda k: F.timestamp_seconds(F.floor((s + k * 900 + 450) / 900) * 900))


def time_of_file(name: Column) -> Column:
    """By the first run of four or more digits: 4, 8, 10, 12 or 14 of them; any other length is an error."""
    digits = F.regexp_extract(name, r"(\d{4,})", 1)
    forms = {4: "yyyy", 8: "yyyyMMdd", 10: "yyyyMMddHH", 12: "yyyyMMddHHmm", 14: "yyyyMMddHHmmss"}
    out = F.when(digits == "", F.lit(None).cast("timestamp"))
    for n, form in forms.items():
        out = out.when(F.length(digits) == n, F.to_timestamp(F.when(F.length(digits) == n, digits), form))
    return out.otherwise(F.raise_error(F.concat(F.lit("no time in "), name)).cast("timestamp"))


def min_ppmm(file_name: Column) -> Column:
    """The threshold in ``minppmm1000``; a name without one is an error."""
    found = F.regexp_extract(file_name, r"minppmm(\d+)", 1)
    return F.when(found != "", found.cast("int")).otherwise(F.raise_error(F.concat(F.lit("no threshold in "), file_name)).cast("int"))


def candidate_tail(candidate: Column) -> Column:
    """What stands behind the last hyphen."""
    return F.element_at(F.split(candidate, "-"), -1)


def next_candidate(candidates: DataFrame, lid: str = "lid", cid: str = "cid") -> DataFrame:
    """(lid, next_cid): the letter after the largest one used. Ids of one letter count by code, longer ones as numbers."""
    code = F.when(F.length(cid) == 1, F.ascii(cid)).otherwise(F.expr(f"try_cast({cid} AS INT)"))
    return candidates.groupBy(lid).agg(F.char(F.greatest(F.max(code) + 1, F.lit(ord("A"))).cast("bigint")).alias("next_cid"))


def coordinate_columns(columns: list[str]) -> tuple[str, str]:
    """The latitude and longitude columns of a table: the first of the matching names in alphabetical order."""
    found = []
    for key in ("lat", "lon"):
        own = sorted(c for c in columns if key in c.lower())
        if not own:
            raise ValueError(f"no {key} column among {columns}")
        found.append(own[0])
    return found[0], found[1]


def name_matches(name: Column, pattern: str, anywhere: bool = False) -> Column:
    """Regular expression at the start of a name, or anywhere in it."""
    return name.rlike(pattern if anywhere else f"^(?:{pattern})")


def first_rows(df: DataFrame, keys: list[str], order: str = "row_id") -> DataFrame:
    """The first row of each key in input order; nulls are equal."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def lone_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key no other row has."""
    return df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("_n = 1").drop("_n")


def expected_granules(spark, start: str, end: str, step: str, template: str) -> DataFrame:
    """(time, path) for every step from the start date to the end of the end date; ``{...}`` in the template are date patterns."""
    import re

    times = spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("timestamp"), F.expr(f"timestamp '{end}' + interval 1 day - interval 1 second"), F.expr(f"interval {step}"))).alias("time")
    )
    parts = [F.lit(p) if n % 2 == 0 else F.date_format("time", p) for n, p in enumerate(re.split(r"[{}]", template))]
    return times.select("time", F.concat(*parts).alias("path"))
