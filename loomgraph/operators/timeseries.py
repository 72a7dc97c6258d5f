"""Time-series selection (M1-M7)."""

from __future__ import annotations

import operator
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPS = {"=": operator.eq, "!=": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
FORMATS = ("%Y-%m-%d %H:%M:%S", "%m/%d/%Y %H:%M:%S")


def parse_time(text: str) -> datetime:
    for f in FORMATS:
        try:
            return datetime.strptime(text, f)
        except ValueError:
            continue
    raise ValueError(f"no time: {text}")


def select_tags(df: DataFrame, time_col: str, tags: dict[str, str], epoch: bool = False, raw: bool = False) -> DataFrame:
    """Timestamp and tag columns under their variables' names (M1)."""
    t = F.timestamp_seconds(F.col(time_col)) if epoch and not raw else F.col(time_col)
    return df.select(t.alias("timestamp"), *[F.col(c).alias(v) for c, v in tags.items()])


def where_values(df: DataFrame, tests: list[tuple[str, str, object]], conjunction: str = "AND") -> DataFrame:
    """Variable constraints joined by AND or OR (M2)."""
    cols = [OPS[op](F.col(c), F.lit(v)) for c, op, v in tests]
    return df.where(reduce(operator.and_ if conjunction == "AND" else operator.or_, cols)) if cols else df


def where_time(df: DataFrame, time_col: str, low: tuple[str, str] | None = None, high: tuple[str, str] | None = None) -> DataFrame:
    """Bounds as (operator, text in one of two formats) (M3); they reach the scan as they are."""
    for bound in (low, high):
        if bound:
            df = df.where(OPS[bound[0]](F.col(time_col), F.lit(parse_time(bound[1]))))
    return df


def time_dates(low: tuple[str, str] | None, high: tuple[str, str] | None) -> list[str]:
    """The days (yyyyMMdd) that bounds cover, for partition pruning (M4); open ends are an error."""
    if low and low[0] == "=":
        return [f"{parse_time(low[1]):%Y%m%d}"]
    if not (low and high):
        raise ValueError("both bounds are needed")
    a, b = sorted((parse_time(low[1]).date(), parse_time(high[1]).date()))
    return [f"{a + timedelta(days=i):%Y%m%d}" for i in range((b - a).days + 1)]


def write_by_day(df: DataFrame, time_col: str, path: str) -> None:
    """Append rows under a folder for each day of ``time_col`` (``day=yyyyMMdd``), which ``read_days`` prunes by (M4).  Rows without a time are in
    Spark's default folder."""
    day = F.date_format(time_col, "yyyyMMdd")
    df.withColumn("day", day).repartition("day", F.pmod(F.xxhash64(time_col), F.lit(8))).write.mode("append").partitionBy("day").parquet(path)


def read_days(spark, path: str, time_col: str, low: tuple[str, str] | None, high: tuple[str, str] | None) -> DataFrame:
    """Rows within the bounds of ``where_time``; only the folders of ``time_dates`` are listed and read (M4)."""
    stored = spark.read.option("basePath", path).option("recursiveFileLookup", "false").parquet(path)
    inside = stored.where(F.col("day").cast("string").isin(time_dates(low, high)))
    return where_time(inside, time_col, low, high)


def time_span_seconds(low: tuple[str, str], high: tuple[str, str]) -> int:
    return abs(int((parse_time(high[1]) - parse_time(low[1])).total_seconds()))


def average_by(df: DataFrame, time_col: str, key: str, tags: list[str], tests: list[tuple[str, str, object]] = (), time_bounds: object = None) -> DataFrame:
    """Average of each tag and the first timestamp per key (M5); only the key may be constrained."""
    if time_bounds or any(c != key for c, _, _ in tests):
        raise ValueError("only the grouping column may be constrained")
    return where_values(df, list(tests)).groupBy(key).agg(F.min(time_col).alias("timestamp"), *[F.avg(t).alias(t) for t in tags])


def sort_by_time(df: DataFrame, time_col: str = "timestamp", on: bool = True) -> DataFrame:
    return df.orderBy(time_col, *[c for c in df.columns if c != time_col]) if on else df


def plan_sources(locator: DataFrame) -> DataFrame:
    """One request per uuid, server, database, table and timestamp column, with its tags (M7)."""
    keys = ["uuid", "server", "database", "table", "timestamp_col"]
    return locator.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("tag", "variable"))).alias("tags"))
