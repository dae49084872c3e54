"""Queries of the general data problems: broken lines, heavy keys, implausible readings, trailing totals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriate.operators.anomaly import Reading, implausible_readings
from seriate.operators.dedupe import once_per_id
from seriate.operators.latest import latest_report
from seriate.operators.skew import heavy_keys, salted_aggregate
from seriate.operators.trailing import build_trees, correct_trees, period_totals, trailing_totals
from seriate.sources.delimited import rejected_lines, trip_fields, typed_rows

READINGS = [Reading("trip_distance", per_hour=200.0), Reading("fare_amount"), Reading("tip_amount"), Reading("passenger_count", stuck=False, scale_floor=0.75)]
FOUND_SHARE, SALT_SHARE = 0.04, 0.01


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that hold no well-formed trip, with the reason."""
    return rejected_lines(_table(spark, sf, "nyctx100_raw"), "raw_line", trip_fields()).select("raw_id", "reason")


def p3_broken_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Rejected lines whose values are at fault, with the first broken field."""
    bad = rejected_lines(_table(spark, sf, "nyctx100_raw"), "raw_line", trip_fields())
    return bad.where(F.col("reason") == "value").select("raw_id", "broken_field")


def p3_loaded(spark: SparkSession, sf: str) -> DataFrame:
    """The valid lines as typed rows."""
    return typed_rows(_table(spark, sf, "nyctx100_raw"), "raw_line", trip_fields(), ["raw_id"])


def location_totals(trips: DataFrame) -> DataFrame:
    """Counts and sums per field and location, by salted aggregation; sums in cents and hundredths of a mile are exact."""
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    ends = lambda df, *more: df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("long").alias("location_id")) for f in ("PULocationID", "DOLocationID")])).alias("e"), *more).select("e.*", *more)
    once = once_per_id(trips, "trip_id", ["PULocationID", "DOLocationID", "total_amount", "fare_amount", "trip_distance"])
    once = once.select("trip_id", "PULocationID", "DOLocationID", cents("total_amount").alias("total"), cents("fare_amount").alias("fare"), cents("trip_distance").alias("distance"))
    # Heavy keys of the rows as delivered: only the choice of what to salt, not a result.
    heavy = heavy_keys(ends(trips.select("PULocationID", "DOLocationID")), ["field_name", "location_id"], SALT_SHARE)
    aggs = {"n_trips": ("count_all", None), "n_totals": ("count", "total"), "total_cents": ("sum", "total"), "fare_cents": ("sum", "fare"), "distance_hundredths": ("sum", "distance")}
    return salted_aggregate(ends(once, "trip_id", "total", "fare", "distance"), ["field_name", "location_id"], aggs, heavy, "trip_id")


def p4_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and sums of all trips per pick-up and drop-off location."""
    return location_totals(_table(spark, sf, "nyctx100"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """The locations that hold at least 4 % of all trips."""
    # One row per field and location: bounded by the locations.
    totals = location_totals(_table(spark, sf, "nyctx100")).select("field_name", "location_id", "n_trips")
    everything = totals.groupBy("field_name").agg(F.sum("n_trips").alias("n_all"))
    joined = totals.join(F.broadcast(everything), "field_name")
    return joined.where(F.col("location_id").isNotNull() & (F.col("n_trips") * 100 >= F.col("n_all") * F.lit(int(FOUND_SHARE * 100)))).select("field_name", "location_id")


def trip_readings(spark: SparkSession, sf: str) -> DataFrame:
    return implausible_readings(_table(spark, sf, "nyctx100"), "meter_id", "tpep_pickup_datetime", "trip_id", READINGS, end_time="tpep_dropoff_datetime")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Impossible, stuck or far-off readings as pairs of trip and field."""
    cases = trip_readings(spark, sf).where("negative or too_fast or stuck or far")
    return cases.select("trip_id", "field_name")


def p5_flags(spark: SparkSession, sf: str) -> DataFrame:
    """All flags of the operator, those of the robust model included."""
    return trip_readings(spark, sf)


def _days(once: DataFrame) -> DataFrame:
    return once.select("meter_id", F.unix_date(F.to_date("tpep_pickup_datetime")).alias("day"), F.round(F.col("total_amount") * 100).cast("long").alias("cents"))


def trip_trailing(trips: DataFrame, windows: list[int]) -> DataFrame:
    once = once_per_id(trips, "trip_id", ["meter_id", "tpep_pickup_datetime", "total_amount"])
    return trailing_totals(build_trees(period_totals(_days(once), "meter_id", "day", "cents")), windows)


def sales_trailing(sales: DataFrame, windows: list[int]) -> DataFrame:
    monthly = latest_report(sales, ["series_id", "Month"], "reported_at", "sales")
    return trailing_totals(build_trees(period_totals(monthly, "series_id", "Month", "sales")), windows)


def _day(c: str = "period"):
    return F.date_format(F.date_from_unix_date(F.col(c).cast("int")), "yyyy-MM-dd")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Days and Months without activity in the short trailing period but with some in the long one."""
    days = trip_trailing(_table(spark, sf, "nyctx100"), [7, 30]).where("n_7 = 0 and n_30 > 0").select(F.lit("nyctx100").alias("source_table"), "entity_id", _day().alias("period"))
    months = sales_trailing(_table(spark, sf, "moving_avg"), [3, 12]).where("n_3 = 0 and n_12 > 0").select(F.lit("moving_avg").alias("source_table"), "entity_id", F.col("period").cast("string").alias("period"))
    return days.unionByName(months)


def _amounts(totals: DataFrame, windows: list[int]) -> DataFrame:
    avg = lambda w: F.when(F.col(f"n_{w}") > 0, F.col(f"total_{w}") / 100 / F.col(f"n_{w}")).alias(f"avg_{w}")
    columns = [c for w in windows for c in ((F.col(f"total_{w}") / 100).alias(f"total_{w}"), avg(w), F.col(f"n_{w}"))]
    return totals.select(F.col("entity_id").alias("meter_id"), _day().alias("day"), *columns)


def p6_trips(spark: SparkSession, sf: str) -> DataFrame:
    """Totals and averages of total_amount over the trailing 7 and 30 days, for each meter and day."""
    return _amounts(trip_trailing(_table(spark, sf, "nyctx100"), [7, 30]), [7, 30])


def p6_trailing_90(spark: SparkSession, sf: str) -> DataFrame:
    """The same over the trailing 90 and 365 days, which reach over several trees."""
    return _amounts(trip_trailing(_table(spark, sf, "nyctx100"), [90, 365]), [90, 365])


def p6_corrected(spark: SparkSession, sf: str) -> DataFrame:
    """Trailing totals from trees of the trips loaded in the first 30 days, corrected by those loaded later; the same as of all trips."""
    trips = _table(spark, sf, "nyctx100")
    # Of a trip delivered again the first time counts.
    at = trips.groupBy("trip_id").agg(*[F.max(c).alias(c) for c in ("meter_id", "tpep_pickup_datetime", "total_amount")], F.min("loaded_at").alias("at")).where("trip_id IS NOT NULL")
    cutoff = trips.agg((F.min("loaded_at") + F.expr("INTERVAL 30 DAYS")).alias("cutoff")).scalar()
    at = at.withColumn("early", F.coalesce(F.col("at") < cutoff, F.lit(False)))
    trees = build_trees(period_totals(_days(at.where("early")), "meter_id", "day", "cents"))
    fixed = correct_trees(trees, period_totals(_days(at.where("NOT early")), "meter_id", "day", "cents"))
    return _amounts(trailing_totals(fixed, [7, 30]), [7, 30])


def p6_sales(spark: SparkSession, sf: str) -> DataFrame:
    """Totals and averages of sales over the trailing 3 and 12 months, for each series and Month."""
    t = sales_trailing(_table(spark, sf, "moving_avg"), [3, 12])
    avg = lambda w: F.when(F.col(f"n_{w}") > 0, F.col(f"total_{w}") / F.col(f"n_{w}")).alias(f"avg_{w}")
    return t.select(F.col("entity_id").alias("series_id"), F.col("period").alias("month"), "total_3", avg(3), "n_3", "total_12", avg(12), "n_12")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p3_found, p3_broken_fields, p3_loaded, p4_found, p4_totals, p5_found, p5_flags, p6_found, p6_trips, p6_trailing_90, p6_corrected, p6_sales)
}
