"""Queries: readers' parsing, product sets and metadata functions, on lines made of the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..registry import register
from ..sources import products as ops
from ..sources import time_tables
from ..sources.testdata import table


def _gps_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry lines of the events: padded, tab separated, with a header, blank lines and repeated seconds."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    packet = F.lit("+G:1")
    cells = [F.lit("2003.132.11"), n, packet, n * 2, packet, n * 3, packet, n * 5, packet, F.lit(1218), packet, F.floor(n / 3) * 10, packet, n % 7, packet, n % 11, packet, n % 13]
    line = F.concat_ws("\t", *[F.concat(F.lit(" "), c.cast("string")) for c in cells])
    rows = e.select(n.alias("line"), F.when(n % 10 == 0, "").when(n % 50 == 1, "TIME\tPKT").otherwise(line).alias("value"))
    return rows


@register(
    "scan_gps",
    "WITH kept AS (SELECT event_id AS n FROM events WHERE event_id % 10 <> 0 AND event_id % 50 <> 1), r AS (SELECT *, n // 3 * 10 AS s, lag(n // 3 * 10) OVER (ORDER BY n) AS b FROM kept) SELECT n AS line, (n * 2)::DOUBLE AS x, (n * 3)::DOUBLE AS y, (n * 5)::DOUBLE AS z, 1218 AS week, s::DOUBLE AS seconds, (n % 7)::DOUBLE AS vx, (n % 11)::DOUBLE AS vy, (n % 13)::DOUBLE AS vz FROM r WHERE b IS DISTINCT FROM s",
)
def scan_gps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.parse_gps(_gps_lines(spark, sf_dir))


@register("scan_ict", "SELECT n + 0.1e0 AS ict1, n + 0.2e0 AS ict2, n + 0.3e0 AS ict3, n + 0.4e0 AS ict4, n + 0.5e0 AS ict5 FROM (SELECT max(event_id) AS n FROM events WHERE event_id % 4 = 0)")
def scan_ict(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    packet = F.when(n % 4 == 0, "+G:29494").otherwise("+G:1")
    cells: list[Column] = [F.lit("2003"), n, F.lit("p"), F.lit("1"), packet]
    for k in range(1, 6):
        cells += [(n + k / 10).cast("string"), F.lit("p")]
    lines = table(spark, sf_dir, "events").select(n.alias("line"), F.concat_ws("\t", *[c.cast("string") for c in cells]).alias("value"))
    return ops.parse_ict(lines)


@register("distinct", "SELECT count(*) AS n FROM (SELECT event_id // 3 AS s, lag(event_id // 3) OVER (ORDER BY event_id) AS b FROM events WHERE event_id % 10 <> 0 AND event_id % 50 <> 1) WHERE b IS DISTINCT FROM s")
def distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.parse_gps(_gps_lines(spark, sf_dir)).agg(F.count("*").alias("n"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of the orders: centre times of two targets, and telemetry of every second reference number."""
    k, day = F.col("o_orderkey"), F.date_format(F.trunc("o_orderdate", "month"), "yyyyMMdd")
    ict = F.concat(F.lit("Pass"), (k % 90).cast("string"), F.lit("."), F.when(k % 3 == 0, "Town").otherwise("Field"), F.lit("_"), k.cast("string"), F.lit("_CHRIS_center_times_"), day, F.lit("_65534"))
    gps = F.concat(F.lit("CHRIS_"), k.cast("string"), F.lit("_"), (k + 4).cast("string"), F.lit("_PROBA1_GPS_Data"))
    return table(spark, sf_dir, "orders").select(F.explode(F.array(ict, F.when(k % 2 == 0, gps).otherwise("notes.txt"))).alias("name"))


#: A month of the tables' range, whose first day stands in the names, and its pairs.
_DAY = "1997-05-01"
_PAIRS_SQL = f"""pairs AS (SELECT 'Pass' || o_orderkey % 90 || '.Town_' || o_orderkey || '_CHRIS_center_times_' || strftime(date_trunc('month', o_orderdate), '%Y%m%d') || '_65534' AS ict,
  'CHRIS_' || o_orderkey || '_' || (o_orderkey + 4) || '_PROBA1_GPS_Data' AS gps FROM orders WHERE o_orderkey % 6 = 0 AND strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') = '{_DAY}')"""


@register("find_telemetry", f"WITH {_PAIRS_SQL} SELECT ict, gps FROM pairs ORDER BY ict, gps LIMIT 1")
def find_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.match_telemetry(_files(spark, sf_dir), "Town", _DAY)


@register("join_telemetry_files", f"WITH {_PAIRS_SQL} SELECT ict, gps FROM pairs")
def join_telemetry_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.telemetry_pairs(_files(spark, sf_dir), "Town", _DAY)


@register("scan_leap_seconds", "SELECT (event_id + 41317.0e0) AS mjd, (10 + event_id % 30)::DOUBLE AS tai_utc FROM events WHERE event_id % 5 <> 0")
def scan_leap_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the file's form for every event, a fifth of them broken."""
    n = F.col("event_id")
    line = F.format_string(" 1999 JAN  1 =JD %.1f  TAI-UTC=  %.7f       S + (MJD - 41317.) X 0.0      S", n + 2441317.5, (10 + n % 30).cast("double"))
    broken = F.when(n % 10 == 0, "no table line").otherwise(F.replace(line, F.lit("TAI-UTC="), F.lit("TAI-UTC")))
    return time_tables.parse_leap_seconds(table(spark, sf_dir, "events").select(F.when(n % 5 == 0, broken).otherwise(line).alias("value")))


@register("scan_ut1", "SELECT 48000.0e0 + event_id AS mjd, round((event_id % 100) / 1000.0e0, 7) AS ut1_utc FROM events WHERE event_id % 9 <> 0")
def scan_ut1(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    value = F.when(n % 9 == 0, F.lit(" " * 10)).otherwise(F.format_string("%10.7f", (n % 100) / 1000.0))
    line = F.concat(F.lit("730101 "), F.format_string("%8.2f", 48000.0 + n), F.lit(" " * 43), value)
    return time_tables.parse_ut1(table(spark, sf_dir, "events").select(line.alias("value")))


@register("scan_endmember_table", "SELECT 400.0e0 + event_id % 700 AS wavelength, round(event_id % 1000 / 1000.0e0, 6) AS vegetation, round(event_id / 200000.0e0, 6) AS soil FROM events WHERE event_id % 13 <> 0")
def scan_endmember_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for every event; some have no third column."""
    i = F.col("event_id")
    line = F.format_string("  %.3f   %.6f %s ", (400 + i % 700) / 1000.0, (i % 1000) / 1000.0, F.when(i % 13 == 0, "").otherwise(F.format_string("%.6f", i / 200000.0)))
    out = ops.parse_endmembers(table(spark, sf_dir, "events").select(line.alias("value")))
    return out.select(F.round("wavelength", 6).alias("wavelength"), "vegetation", "soil")


@register("scan_envi_band", "SELECT vec_id::VARCHAR AS path, (vec_id % 384 + 1)::VARCHAR AS samples, (vec_id % 64 + 1)::VARCHAR AS lines, (label % 3 + 1)::VARCHAR AS kind, (vec_id % 2)::VARCHAR AS byte_order, round(400 + vec_id % 650 + 0.5e0, 1) AS wavelength FROM embeddings")
def scan_envi_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header for every vector."""
    i = F.col("vec_id")
    text = F.format_string(
        "ENVI\ndescription = {radiance of %d}\nsamples = %d\nlines = %d\nbands = 1\ndata type = %d\ninterleave = bsq\nbyte order = %d\nwavelength = {%.1f}\n",
        i, i % 384 + 1, i % 64 + 1, F.col("label") % 3 + 1, i % 2, 400 + i % 650 + 0.5,
    )
    f = ops.parse_envi_header(table(spark, sf_dir, "embeddings").select(i.cast("string").alias("path"), text.alias("value")))
    at = lambda k: F.element_at("fields", k)
    return f.select("path", at("samples").alias("samples"), at("lines").alias("lines"), at("data type").alias("kind"), at("byte order").alias("byte_order"), F.regexp_extract(at("wavelength"), r"([0-9.]+)", 1).cast("double").alias("wavelength"))


@register(
    "scan_gcps",
    "SELECT 'GCP' || event_id AS name, (event_id % 372 + 0.5e0) AS x, (event_id % 374 + 0.25e0) AS y, CASE event_id % 3 WHEN 0 THEN 0.7 WHEN 1 THEN (event_id % 900 + 11) / 1000.0e0 ELSE (event_id % 10)::DOUBLE END AS alt FROM events WHERE event_id % 7 <> 0",
)
def scan_gcps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text of placemarks for every user, one an event: heights in metres, in kilometres or not told, some without a place."""
    n = F.col("event_id")
    note = F.when(n % 3 == 0, "no height").when(n % 3 == 1, F.format_string("Town (alt[m] = %d)", n % 900 + 11)).otherwise(F.format_string("(alt = %d)", n % 10))
    mark = F.format_string(
        '<Placemark name="GCP%d"><LATITUDE>%s</LATITUDE><LONGITUDE>%.4f</LONGITUDE><PIXEL_X>%.2f</PIXEL_X><PIXEL_Y>%.2f</PIXEL_Y><DESCRIPTION>%s</DESCRIPTION></Placemark>',
        n, F.when(n % 7 == 0, "").otherwise(F.format_string("%.4f", 39 + n / 1e6)), -2 + n / 1e6, n % 372 + 0.5, n % 374 + 0.25, note,
    )
    texts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.concat(F.lit("<Placemarks>"), F.array_join(F.collect_list(mark), "\n"), F.lit("</Placemarks>")).alias("value"))
    return ops.control_points(ops.parse_placemarks(texts), 0.7).select("name", "x", "y", "alt")


# Product sets and metadata ----------------------------------------------------------------------------------

#: Products of the orders: five-part names, some twice, of two types.
_PRODUCT_SQL = """product AS (SELECT 'CHRIS_BR_' || o_custkey % 50 || '_' || chr((65 + o_orderkey % 7)::INTEGER) || '_21' AS name, CASE WHEN o_orderkey % 11 = 0 THEN 'CHRIS_M1' ELSE 'CHRIS_M2' END AS type, o_custkey FROM orders)"""


def _products(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = F.concat(F.lit("CHRIS_BR_"), (c % 50).cast("string"), F.lit("_"), F.char(65 + k % 7), F.lit("_21"))
    return table(spark, sf_dir, "orders").select(name.alias("name"), F.when(k % 11 == 0, "CHRIS_M1").otherwise("CHRIS_M2").alias("type"), "o_custkey")


@register("scan_acquisition_set", f"WITH {_PRODUCT_SQL} SELECT DISTINCT name FROM product WHERE type = 'CHRIS_M2' AND starts_with(name, 'CHRIS_BR_7_')")
def scan_acquisition_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.acquisition_set(_products(spark, sf_dir), "CHRIS_BR_7_A_21", "CHRIS_M2").select("name")


@register("sort_products_by_name", f"WITH {_PRODUCT_SQL} SELECT name, row_number() OVER (PARTITION BY split_part(name, '_', 3) ORDER BY name)::INTEGER AS place FROM (SELECT DISTINCT name FROM product)")
def sort_products_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every product in its set."""
    names = _products(spark, sf_dir).select("name").distinct()
    return names.select("name", F.row_number().over(Window.partitionBy(F.split_part("name", F.lit("_"), F.lit(3))).orderBy("name")).alias("place"))


@register(
    "acquisition_set_validation",
    f"WITH {_PRODUCT_SQL} SELECT o_custkey, count(*) AS n, count(*) <= 5 AND count(DISTINCT name) = count(*) AND count(DISTINCT type) = 1 AS valid FROM product GROUP BY o_custkey",
)
def acquisition_set_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the products of each customer can be processed as a set."""

    @F.udf("boolean")
    def valid(names: list[str], kinds: list[str]) -> bool:
        try:
            ops.validate_set(names, kinds)
        except ValueError:
            return False
        return True

    # Six products tell that there are too many.
    each = _products(spark, sf_dir).withColumn("at", F.row_number().over(Window.partitionBy("o_custkey").orderBy("name", "type")))
    n = each.groupBy("o_custkey").agg(F.count("*").alias("n"), F.collect_list(F.when(F.col("at") <= 6, F.col("name"))).alias("names"), F.collect_list(F.when(F.col("at") <= 6, F.col("type"))).alias("kinds"))
    return n.select("o_custkey", "n", valid("names", "kinds").alias("valid"))


@register("per_product_selection", "SELECT 'p1' AS product_id, count(*) AS n FROM embeddings WHERE vec_id // 25 >= 10")
def per_product_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .catalog_noise import products

    targets = spark.createDataFrame([("p1",)], "product_id string")
    return products(spark, sf_dir).join(F.broadcast(targets), "product_id", "left_semi").groupBy("product_id").agg(F.count("*").alias("n"))


@register("sink_name_template", "SELECT source, source || '_VSC.parquet' AS path FROM (SELECT DISTINCT source FROM documents)")
def sink_name_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "documents").select("source").distinct()
    return names.select("source", F.replace(F.lit("${sourceName}_VSC.parquet"), F.lit("${sourceName}"), F.col("source")).alias("path"))


def _attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    number = F.concat(F.lit(" "), (F.col("o_orderkey") % 5 + 1).cast("string"), F.lit(" of 5"))
    entries = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("price"), F.col("o_totalprice").cast("string"), F.lit("bad"), F.lit("n/a"), F.lit("image"), number)
    return o.select("o_orderkey", entries.alias("attrs"))


@register("annotations", "SELECT o_orderkey, o_orderstatus AS status, 'none' AS missing, o_totalprice AS price, 1.5::DOUBLE AS fallback, (o_orderkey % 5 + 1)::INTEGER AS image FROM orders")
def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attrs(spark, sf_dir).select(
        "o_orderkey",
        ops.annotation("attrs", "status").alias("status"),
        ops.annotation("attrs", "nothing", "none").alias("missing"),
        ops.annotation_double("attrs", "price").alias("price"),
        ops.annotation_double("attrs", "bad", 1.5).alias("fallback"),
        ops.annotation_int("attrs", "image", 0, 2).alias("image"),
    )


@register("set_annotation", "SELECT o_orderkey, printf('%.2f', o_totalprice) AS aot, o_orderstatus AS status FROM orders")
def set_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.format_string("%.2f", F.try_element_at("attrs", F.lit("price")).cast("double"))
    rows = _attrs(spark, sf_dir).withColumn("attrs", ops.with_annotation("attrs", "AOT", value))
    return rows.select("o_orderkey", F.element_at("attrs", "AOT").alias("aot"), F.element_at("attrs", "status").alias("status"))


@register("lineage_string", "SELECT o_orderstatus, 'Computed from ' || string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS lineage FROM orders GROUP BY o_orderstatus")
def lineage_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ", ")
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.concat(F.lit("Computed from "), parts).alias("lineage"))


@register("altitude_parser", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0.7 WHEN event_id % 100 > 10 THEN (event_id % 100) / 1000.0e0 ELSE (event_id % 100)::DOUBLE END AS alt FROM events")
def altitude_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    text = F.when(n % 3 == 0, "Town").otherwise(F.concat(F.lit("Town (alt[m] = "), (n % 100).cast("string"), F.lit(")")))
    return table(spark, sf_dir, "events").select("event_id", ops.parse_altitude(text, F.lit(0.7)).alias("alt"))


@register(
    "metadata_display",
    "SELECT o_orderkey, unnest(['bad', 'image', 'price', 'status']) AS name, unnest(['n/a', (o_orderkey % 5 + 1)::VARCHAR || ' of 5', o_totalprice::VARCHAR, o_orderstatus]) AS value FROM orders",
)
def metadata_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The annotations of every order as rows, trimmed."""
    rows = _attrs(spark, sf_dir).select("o_orderkey", F.explode("attrs").alias("name", "value"))
    return rows.select("o_orderkey", "name", F.trim("value").alias("value"))


@register(
    "name_split_and_date",
    "SELECT DISTINCT o_custkey % 50 AS target, chr((65 + o_orderkey % 7)::INTEGER) AS image, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders",
)
def name_split_and_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target, image and date of five-part product names, the date in its text form."""
    k = F.col("o_orderkey")
    name = F.concat_ws("_", F.lit("CHRIS"), (F.col("o_custkey") % 50).cast("string"), F.char(65 + k % 7), F.date_format("o_orderdate", "yyMMdd"), F.lit("21"))
    part = lambda n: F.split_part(name, F.lit("_"), F.lit(n))
    century = F.when(F.substring(part(4), 1, 1) >= "7", "19").otherwise("20")
    day = F.concat_ws("-", F.concat(century, F.substring(part(4), 1, 2)), F.substring(part(4), 3, 2), F.substring(part(4), 5, 2))
    return table(spark, sf_dir, "orders").select(part(2).cast("long").alias("target"), part(3).alias("image"), day.alias("day")).distinct()
