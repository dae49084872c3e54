"""Queries of the operators of this subpackage, and SQL with the same results where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriate.llm.bpe import encode_column, encode_tables, splice_column
from seriate.llm.leaks import Leaks, find_leaks, without_leaks
from seriate.llm.quantiles import build_sketches, merge_sketches, rank_bound, sketch_quantiles
from seriate.llm.subjects import assign_subjects
from seriate.llm.topn import top_n
from seriate.operators.dedupe import once_per_id
from seriate.operators.skew import look_up
from seriate.session import materialize

PERCENTILES = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99, "p999": 0.999}
SKETCHED = ["trip_distance", "fare_amount"]
#: Words of a test passage in a row that are a leak.
MIN_WORDS = 10


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _location_values(spark: SparkSession, sf: str) -> DataFrame:
    return once_per_id(_table(spark, sf, "nyctx100"), "trip_id", ["PULocationID", "tpep_pickup_datetime", *SKETCHED]).select(
        F.col("PULocationID").alias("location_id"), F.unix_date(F.to_date("tpep_pickup_datetime")).alias("day"), *SKETCHED
    )


def _daily(spark: SparkSession, sf: str) -> DataFrame:
    return merge_sketches(build_sketches(_location_values(spark, sf), ["location_id", "day"], SKETCHED), ["location_id", "day"])


def p1_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of distance and fare per pick-up location, of each day and of all days; the latter (a null day) come from the days' sketches.

    ``p01_off`` and so on say by how many ranks each may be off: the high tail is protected, so the bound is a share of the distance from the top.
    """
    days = materialize(_daily(spark, sf), "days")
    together = merge_sketches(days.withColumn("part", F.pmod("day", F.lit(64))), ["location_id"])
    qs = list(PERCENTILES.values())
    per_day = sketch_quantiles(days, ["location_id", "day"], qs)
    overall = sketch_quantiles(together, ["location_id"], qs).withColumn("day", F.lit(None).cast("long"))
    day = F.date_format(F.date_from_unix_date(F.col("day").cast("int")), "yyyy-MM-dd").alias("pickup_day")
    return per_day.unionByName(overall).select("location_id", day, "field_name", "n", *[F.col("values")[i].alias(name) for i, name in enumerate(PERCENTILES)], *[rank_bound(q, F.col("n")).alias(f"{name}_off") for name, q in PERCENTILES.items()])


def p1_daily_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """Sketches per location and pick-up day: the form in which separate days combine."""
    return _daily(spark, sf)


def p1_within_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Per location, field and percentile: whether its rank among all values is off by no more than four standard errors and one row."""
    values = _location_values(spark, sf)
    estimates = sketch_quantiles(merge_sketches(build_sketches(values, ["location_id"], SKETCHED), ["location_id"]), ["location_id"], list(PERCENTILES.values()))
    wide = estimates.select("location_id", "field_name", "n", F.explode(F.arrays_zip(F.array(*map(F.lit, PERCENTILES)).alias("name"), F.array(*[F.lit(q) for q in PERCENTILES.values()]).alias("q"), F.col("values"))).alias("e")).select("location_id", "field_name", "n", "e.name", "e.q", F.col("e.values").alias("estimate"))
    long = values.select("location_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("x")) for f in SKETCHED])).alias("v")).select("location_id", "v.*").where("x IS NOT NULL")
    # Equal values are counted first; the estimates are a few per location.
    counts = long.groupBy("location_id", "field_name", "x").agg(F.count(F.lit(1)).alias("c"))
    e = wide.select(F.col("location_id").alias("l"), F.col("field_name").alias("f"), "n", "name", "q", "estimate")
    joined = counts.join(e, counts.location_id.eqNullSafe(e.l) & (counts.field_name == e.f))
    ranks = joined.groupBy("l", "f", "n", "name", "q").agg(F.sum(F.when(F.col("x") < F.col("estimate"), F.col("c")).otherwise(0)).alias("below"), F.sum(F.when(F.col("x") <= F.col("estimate"), F.col("c")).otherwise(0)).alias("upto"))
    slack = F.lit(None)
    for name, q in PERCENTILES.items():
        slack = F.when(F.col("name") == name, rank_bound(q, F.col("n"))).otherwise(slack)
    # An exact quantile is the least value with a share of at least q up to it.
    inside = (F.col("below") < F.greatest(F.ceil(F.col("q") * F.col("n") - 1e-9), F.lit(1)) + slack) & (F.col("upto") >= F.col("q") * F.col("n") - slack - 1e-9)
    return ranks.select(F.col("l").alias("location_id"), F.col("f").alias("field_name"), F.col("name").alias("percentile"), "n", inside.alias("within_bound"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """The three trips with the highest total_amount of every pick-up location and day."""
    once = once_per_id(_table(spark, sf, "nyctx100"), "trip_id", ["PULocationID", "tpep_pickup_datetime", "total_amount"])
    trips = once.select(F.col("PULocationID").cast("long").alias("location_id"), F.to_date("tpep_pickup_datetime").alias("pickup_date"), "tpep_pickup_datetime", "trip_id", "total_amount")
    top = top_n(trips, ["location_id", "pickup_date"], [("total_amount", True), ("tpep_pickup_datetime", False), ("trip_id", False)], 3, unique=True)
    return top.select("location_id", F.date_format("pickup_date", "yyyy-MM-dd").alias("pickup_day"), "trip_id")


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every document's text."""
    return encode_column(_table(spark, sf, "documents"), "doc_id", "text")


def p7_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of the corpus by language and source."""
    docs = _table(spark, sf, "documents")
    counts = encode_column(docs, "doc_id", "text").select("doc_id", F.size("ids").alias("n_tokens"))
    return docs.select("doc_id", "lang", "source").join(counts, "doc_id").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def p7_appended(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every post with the text of its parent after it, from the posts' own tables: only words near the seam and the added ones are encoded."""
    docs = _table(spark, sf, "documents")
    # One parent may have a third of all posts as replies.
    parents = docs.select(F.col("doc_id").alias("parent_id"), F.concat(F.lit("\n"), "text").alias("more"))
    joined = look_up(docs.select("doc_id", "text", "parent_id"), parents, ["parent_id"]).select("doc_id", "text", "more")
    tables = encode_tables(joined.select(F.struct("doc_id", "more").alias("key"), "text"), "key", "text")
    end = F.lit(None).cast("int")
    appended = splice_column(tables.withColumns({"start": end, "end": end, "more": F.col("key.more")}), "key", "start", "end", "more")
    return appended.select("key.doc_id", "ids")


def _leaks(spark: SparkSession, sf: str) -> Leaks:
    return find_leaks(_table(spark, sf, "documents"), "doc_id", "text", _table(spark, sf, "eval_items"), "item_id", "passage", MIN_WORDS)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold ten or more consecutive words of a test item, with the item."""
    return _leaks(spark, sf).spans.select("doc_id", "item_id").distinct()


def p8_spans(spark: SparkSession, sf: str) -> DataFrame:
    """The shared runs of words."""
    return _leaks(spark, sf).spans.drop("cid")


def p8_leaked_items(spark: SparkSession, sf: str) -> DataFrame:
    """The test items that leaked, with the documents that hold them."""
    found = p8_found(spark, sf).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))
    return _table(spark, sf, "eval_items").select("item_id", "suite").join(found, "item_id")


def p8_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """What stays of the leaking documents: their texts without every run of words that the search reports."""
    return without_leaks(_leaks(spark, sf), "doc_id")


def _subjects(spark: SparkSession, sf: str) -> DataFrame:
    # A short, fixed list: the subjects asked for.
    names = sorted(r[0] for r in _table(spark, sf, "subjects").select("subject").where("subject IS NOT NULL").distinct().collect())
    return assign_subjects(_table(spark, sf, "documents"), _table(spark, sf, "subject_labels"), names)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """The subjects that each post's own text is about."""
    return _subjects(spark, sf).select("doc_id", "subject")


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Posts per subject, and their share of all posts in thousandths."""
    n_all = _table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n_all")).scalar()
    counts = _subjects(spark, sf).groupBy("subject").agg(F.count(F.lit(1)).alias("n_posts"))
    return counts.select("subject", "n_posts", F.round(F.col("n_posts") * 1000 / n_all, 1).alias("per_thousand"))


_ONCE = "trips AS (SELECT trip_id, any_value(PULocationID) AS PULocationID, any_value(tpep_pickup_datetime) AS pickup, any_value(total_amount) AS total_amount, any_value(trip_distance) AS trip_distance, any_value(fare_amount) AS fare_amount FROM nyctx100 GROUP BY trip_id)"
_VALUES = f"{_ONCE}, vals AS (SELECT CAST(PULocationID AS BIGINT) AS location_id, 'trip_distance' AS field_name, trip_distance AS x FROM trips UNION ALL SELECT CAST(PULocationID AS BIGINT), 'fare_amount', fare_amount FROM trips)"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_percentiles, p1_daily_sketches, p1_within_bounds, p2_found, p7_ids, p7_lengths, p7_appended, p8_found, p8_spans, p8_leaked_items, p8_cleaned, p9_found, p9_shares)}

ORACLES = {
    "p1_within_bounds": f"WITH {_VALUES} SELECT location_id, field_name, percentile, count(*) AS n, TRUE AS within_bound FROM vals, (VALUES {', '.join(f"('{p}')" for p in PERCENTILES)}) AS p(percentile) WHERE x IS NOT NULL GROUP BY ALL",
    "p2_found": f"WITH {_ONCE} SELECT CAST(PULocationID AS BIGINT) AS location_id, strftime(pickup, '%Y-%m-%d') AS pickup_day, trip_id FROM trips WHERE PULocationID IS NOT NULL AND total_amount IS NOT NULL QUALIFY row_number() OVER (PARTITION BY PULocationID, CAST(pickup AS DATE) ORDER BY total_amount DESC, pickup, trip_id) <= 3",
}
