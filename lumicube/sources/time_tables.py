"""Leap seconds and UT1: readers of the public fixed-format files, and the leap seconds to 2009."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Julian date from which TAI - UTC has the given seconds.
LEAP_SECONDS = (
    (2441317.5, 10.0),
    (2441499.5, 11.0),
    (2441683.5, 12.0),
    (2442048.5, 13.0),
    (2442413.5, 14.0),
    (2442778.5, 15.0),
    (2443144.5, 16.0),
    (2443509.5, 17.0),
    (2443874.5, 18.0),
    (2444239.5, 19.0),
    (2444786.5, 20.0),
    (2445151.5, 21.0),
    (2445516.5, 22.0),
    (2446247.5, 23.0),
    (2447161.5, 24.0),
    (2447892.5, 25.0),
    (2448257.5, 26.0),
    (2448804.5, 27.0),
    (2449169.5, 28.0),
    (2449534.5, 29.0),
    (2450083.5, 30.0),
    (2450630.5, 31.0),
    (2451179.5, 32.0),
    (2453736.5, 33.0),
    (2454832.5, 34.0),
)


def leap_seconds(spark: SparkSession) -> DataFrame:
    """mjd, tai_utc."""
    return spark.createDataFrame([(jd - 2400000.5, s) for jd, s in LEAP_SECONDS], "mjd double, tai_utc double")


def parse_leap_seconds(lines: DataFrame) -> DataFrame:
    """(mjd, tai_utc) of lines (value) with `=JD` and `TAI-UTC=` and ` S `; others are skipped."""
    jd = F.regexp_extract("value", r"=JD\s+([0-9.]+)\s+TAI-UTC=", 1).try_cast("double")
    s = F.regexp_extract("value", r"TAI-UTC=\s*([0-9.]+)\s+S ", 1).try_cast("double")
    return lines.select((jd - 2400000.5).alias("mjd"), s.alias("tai_utc")).filter("mjd IS NOT NULL AND tai_utc IS NOT NULL")


def parse_ut1(lines: DataFrame) -> DataFrame:
    """(mjd, ut1_utc) of fixed-width lines (value): columns 8-15 and 59-68; blank fields are skipped."""
    field = lambda at, n: F.trim(F.substring("value", at, n)).try_cast("double")
    return lines.select(field(8, 8).alias("mjd"), field(59, 10).alias("ut1_utc")).filter("mjd IS NOT NULL AND ut1_utc IS NOT NULL")


def read_leap_seconds(spark: SparkSession, path: str) -> DataFrame:
    return parse_leap_seconds(spark.read.text(path))


def read_ut1(spark: SparkSession, path: str) -> DataFrame:
    return parse_ut1(spark.read.text(path))


#: Days after which a user's copy of a time table counts as outdated.
OUTDATED_DAYS = 7.0


def chosen_tables(files: DataFrame, now: Column) -> DataFrame:
    """name, path, outdated of time tables (name, origin, path, modified): a user's copy comes before the bundled table.

    Of several copies of one origin the newest is taken, then the smaller path.  A table is outdated if there is no
    user's copy, or if that was modified more than OUTDATED_DAYS before ``now``.
    """
    newest = F.max_by(F.struct("path", "modified", "origin"), F.struct((F.col("origin") == "user").cast("int"), "modified"))
    least = files.groupBy("name", "origin", "modified").agg(F.min("path").alias("path"))
    age = (F.unix_micros(now) - F.unix_micros(F.col("t.modified"))) / 8.64e10
    fresh = (F.col("t.origin") == "user") & (age <= OUTDATED_DAYS)
    return least.groupBy("name").agg(newest.alias("t")).select("name", F.col("t.path").alias("path"), (~fresh).alias("outdated"))


def updated(table: DataFrame, newer: DataFrame, key: str, value: str) -> DataFrame:
    """A time table with newer rows: they replace those with the same key and are added otherwise."""
    fresh = newer.groupBy(key).agg(F.max(value).alias("_new"))
    return table.join(fresh, key, "full_outer").select(key, F.coalesce("_new", value).alias(value))
