"""The queries of ``cleaning`` in plain SQL, for comparison."""

_TRIPS = "trips AS (SELECT trip_id, any_value(meter_id) AS meter_id, any_value(tpep_pickup_datetime) AS pickup, any_value(tpep_dropoff_datetime) AS dropoff, any_value(passenger_count) AS passenger_count, any_value(trip_distance) AS trip_distance, any_value(fare_amount) AS fare_amount, any_value(tip_amount) AS tip_amount, any_value(total_amount) AS total_amount, any_value(PULocationID) AS PULocationID, any_value(DOLocationID) AS DOLocationID FROM nyctx100 GROUP BY trip_id)"

_ENDS = f"""WITH {_TRIPS}, ends AS (
  SELECT 'PULocationID' AS field_name, CAST(PULocationID AS BIGINT) AS location_id, * FROM trips UNION ALL SELECT 'DOLocationID', CAST(DOLocationID AS BIGINT), * FROM trips)"""

_READINGS = f"""WITH {_TRIPS}, readings AS (
  SELECT trip_id, meter_id, pickup, dropoff, 'trip_distance' AS field_name, trip_distance AS x FROM trips WHERE trip_distance IS NOT NULL
  UNION ALL SELECT trip_id, meter_id, pickup, dropoff, 'fare_amount', fare_amount FROM trips WHERE fare_amount IS NOT NULL
  UNION ALL SELECT trip_id, meter_id, pickup, dropoff, 'tip_amount', tip_amount FROM trips WHERE tip_amount IS NOT NULL
  UNION ALL SELECT trip_id, meter_id, pickup, dropoff, 'passenger_count', passenger_count FROM trips WHERE passenger_count IS NOT NULL),
levels AS (SELECT meter_id, field_name, median(x) AS level FROM readings WHERE x > 0 GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY meter_id, field_name ORDER BY pickup, trip_id) - row_number() OVER (PARTITION BY meter_id, field_name, x ORDER BY pickup, trip_id) AS island FROM readings),
runs AS (SELECT *, count(*) OVER (PARTITION BY meter_id, field_name, x, island) AS run FROM placed)
SELECT trip_id, field_name FROM runs LEFT JOIN levels USING (meter_id, field_name)
WHERE x < 0 OR x >= 10 * level OR (field_name = 'trip_distance' AND dropoff > pickup AND x * 3600 > 200 * date_diff('second', pickup, dropoff))
   OR (field_name <> 'passenger_count' AND x > 0 AND run >= 8)"""

_DAYS = f"""WITH {_TRIPS}, daily AS (SELECT CAST(meter_id AS BIGINT) AS e, CAST(pickup AS DATE) AS d, sum(CAST(round(total_amount * 100) AS BIGINT)) AS s, count(total_amount) AS n FROM trips GROUP BY ALL),
span AS (SELECT e, min(d) AS a, max(d) AS b FROM daily GROUP BY e),
calendar AS (SELECT e, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d FROM span),
dense AS (SELECT e, d, coalesce(s, 0) AS s, coalesce(n, 0) AS n FROM calendar LEFT JOIN daily USING (e, d)),
rolled AS (SELECT e, d, CAST(sum(s) OVER w7 AS BIGINT) AS s7, CAST(sum(n) OVER w7 AS BIGINT) AS n7, CAST(sum(s) OVER w30 AS BIGINT) AS s30, CAST(sum(n) OVER w30 AS BIGINT) AS n30 FROM dense
  WINDOW w7 AS (PARTITION BY e ORDER BY d ROWS 6 PRECEDING), w30 AS (PARTITION BY e ORDER BY d ROWS 29 PRECEDING))"""

_MONTHS = """sales_once AS (SELECT CAST(series_id AS BIGINT) AS e, CAST(Month AS BIGINT) AS m, arg_max(struct_pack(v := sales), reported_at).v AS v FROM moving_avg GROUP BY ALL),
mspan AS (SELECT e, min(m) AS a, max(m) AS b FROM sales_once GROUP BY e),
mcalendar AS (SELECT e, unnest(generate_series(a, b)) AS m FROM mspan),
mdense AS (SELECT e, m, v FROM mcalendar LEFT JOIN sales_once USING (e, m)),
mrolled AS (SELECT e, m, CAST(coalesce(sum(v) OVER w3, 0) AS BIGINT) AS s3, count(v) OVER w3 AS n3, CAST(coalesce(sum(v) OVER w12, 0) AS BIGINT) AS s12, count(v) OVER w12 AS n12 FROM mdense
  WINDOW w3 AS (PARTITION BY e ORDER BY m ROWS 2 PRECEDING), w12 AS (PARTITION BY e ORDER BY m ROWS 11 PRECEDING))"""

_F = r"""([ \t]*"([^"]|"")*"[ \t]*|[^",]*)"""
#: Cells of a line without quotes or the blanks around its values; whole lines are judged column by column, unlike in ``delimited``.
_LINES = rf"""WITH lines AS (SELECT raw_id, regexp_replace(coalesce(raw_line, ''), '\r$', '') AS line FROM nyctx100_raw),
marked AS (SELECT *, regexp_matches(line, '^[^"]*$') OR regexp_full_match(line, '({_F},)*{_F}') AND NOT regexp_matches(',' || line, ',[ \t]*[^ \t",][^",]*"') AS quoted FROM lines),
celled AS (SELECT *, list_transform(string_split(regexp_replace(line, '"([^"]|"")*"', '"q"', 'g'), ','), lambda c: c) AS shape, list_transform(string_split(line, ','), lambda c: trim(trim(c, E' \t'), E'" \t')) AS v FROM marked),
judged AS (SELECT *, CASE WHEN NOT quoted THEN 'quoting' WHEN len(shape) <> 17 THEN 'column_count' WHEN len(v) <> 17 OR contains(line, '""') AND regexp_matches(line, '[^", \t][^",]*""|""[^",]*[^", \t]') THEN 'value'
  WHEN NOT regexp_full_match(v[1], '0*[12]') OR try_strptime(CASE WHEN regexp_full_match(v[2], '\d{{1,2}}/\d{{1,2}}/\d{{4}} \d{{1,2}}:\d\d') THEN v[2] END, '%m/%d/%Y %H:%M') IS NULL
    OR (v[3] <> '' AND try_strptime(CASE WHEN regexp_full_match(v[3], '\d{{1,2}}/\d{{1,2}}/\d{{4}} \d{{1,2}}:\d\d') THEN v[3] END, '%m/%d/%Y %H:%M') IS NULL)
    OR NOT regexp_full_match(v[4], '\d*') OR NOT (v[6] = '' OR regexp_full_match(v[6], '\d+') AND (TRY_CAST(v[6] AS HUGEINT) BETWEEN 1 AND 6 OR TRY_CAST(v[6] AS HUGEINT) = 99)) OR v[7] NOT IN ('', 'Y', 'N')
    OR NOT (v[8] = '' OR regexp_full_match(v[8], '\d+') AND TRY_CAST(v[8] AS HUGEINT) BETWEEN 1 AND 265) OR NOT (v[9] = '' OR regexp_full_match(v[9], '\d+') AND TRY_CAST(v[9] AS HUGEINT) BETWEEN 1 AND 265)
    OR NOT (v[10] = '' OR regexp_full_match(v[10], '\d+') AND TRY_CAST(v[10] AS HUGEINT) BETWEEN 1 AND 6)
    OR len(list_filter([v[5], v[11], v[12], v[13], v[14], v[15], v[16], v[17]], lambda c: NOT regexp_full_match(c, '(-?\d+(\.\d+)?)?'))) > 0 THEN 'value' END AS reason FROM celled)"""

_TIME = r"try_strptime(CASE WHEN regexp_full_match(v[{i}], '\d{{1,2}}/\d{{1,2}}/\d{{4}} \d{{1,2}}:\d\d') THEN v[{i}] END, '%m/%d/%Y %H:%M') IS NOT NULL"
_WHOLE = r"(v[{i}] = '' OR regexp_full_match(v[{i}], '\d+') AND ({what}))"
_ONE_OF = lambda i, *spans: _WHOLE.format(i=i, what=" OR ".join(f"TRY_CAST(v[{i}] AS HUGEINT) BETWEEN {a} AND {b}" for a, b in spans))
#: What the cell of each field has to be.
_GOOD = {
    "VendorID": "regexp_full_match(v[1], '0*[12]')", "tpep_pickup_datetime": _TIME.format(i=2), "tpep_dropoff_datetime": f"(v[3] = '' OR {_TIME.format(i=3)})", "passenger_count": _WHOLE.format(i=4, what="TRUE"),
    "trip_distance": 5, "RatecodeID": _ONE_OF(6, (1, 6), (99, 99)), "store_and_fwd_flag": "v[7] IN ('', 'Y', 'N')", "PULocationID": _ONE_OF(8, (1, 265)), "DOLocationID": _ONE_OF(9, (1, 265)), "payment_type": _ONE_OF(10, (1, 6)),
    **{f: 11 + i for i, f in enumerate(("fare_amount", "extra", "mta_tax", "tip_amount", "tolls_amount", "improvement_surcharge", "total_amount"))},
}
_BROKEN = "CASE " + " ".join(f"WHEN NOT {c if isinstance(c, str) else rf"regexp_full_match(v[{c}], '(-?\d+(\.\d+)?)?')"} THEN '{f}'" for f, c in _GOOD.items()) + " END"

_INTS = {4: "passenger_count", 6: "RatecodeID", 8: "PULocationID", 9: "DOLocationID", 10: "payment_type"}
_DOUBLES = {5: "trip_distance", 11: "fare_amount", 12: "extra", 13: "mta_tax", 14: "tip_amount", 15: "tolls_amount", 16: "improvement_surcharge", 17: "total_amount"}

_ROLLED = "SELECT e AS meter_id, strftime(d, '%Y-%m-%d') AS day, s7 / 100 AS total_7, CASE WHEN n7 > 0 THEN s7 / 100 / n7 END AS avg_7, n7 AS n_7, s30 / 100 AS total_30, CASE WHEN n30 > 0 THEN s30 / 100 / n30 END AS avg_30, n30 AS n_30 FROM rolled"

ORACLES = {
    "p3_found": f"{_LINES} SELECT raw_id, reason FROM judged WHERE reason IS NOT NULL",
    "p3_broken_fields": f"{_LINES} SELECT raw_id, {_BROKEN} AS broken_field FROM judged WHERE reason = 'value'",
    "p3_loaded": f"{_LINES} SELECT raw_id, CAST(v[1] AS INTEGER) AS VendorID, strptime(v[2], '%m/%d/%Y %H:%M') AS tpep_pickup_datetime, CASE WHEN v[3] <> '' THEN strptime(v[3], '%m/%d/%Y %H:%M') END AS tpep_dropoff_datetime, nullif(v[7], '') AS store_and_fwd_flag, "
    + "CASE WHEN v[4] <> '' AND TRY_CAST(v[4] AS INTEGER) IS NULL THEN 'passenger_count' END AS out_of_range, "
    + ", ".join([f"TRY_CAST(nullif(v[{i}], '') AS INTEGER) AS {n}" for i, n in _INTS.items()] + [f"CAST(nullif(v[{i}], '') AS DOUBLE) AS {n}" for i, n in _DOUBLES.items()])
    + " FROM judged WHERE reason IS NULL",
    "p4_found": f"{_ENDS} SELECT field_name, location_id FROM ends WHERE location_id IS NOT NULL GROUP BY ALL HAVING count(*) * 100 >= 4 * (SELECT count(*) FROM trips)",
    "p4_totals": f"{_ENDS} SELECT field_name, location_id, count(*) AS n_trips, count(total_amount) AS n_totals, CAST(sum(CAST(round(total_amount * 100) AS BIGINT)) AS BIGINT) AS total_cents, CAST(sum(CAST(round(fare_amount * 100) AS BIGINT)) AS BIGINT) AS fare_cents, CAST(sum(CAST(round(trip_distance * 100) AS BIGINT)) AS BIGINT) AS distance_hundredths FROM ends GROUP BY field_name, location_id",
    "p5_found": _READINGS,
    "p6_found": f"{_DAYS}, {_MONTHS} SELECT 'nyctx100' AS source_table, e AS entity_id, strftime(d, '%Y-%m-%d') AS period FROM rolled WHERE n7 = 0 AND n30 > 0 UNION ALL SELECT 'moving_avg', e, CAST(m AS VARCHAR) FROM mrolled WHERE n3 = 0 AND n12 > 0",
    "p6_trips": f"{_DAYS} {_ROLLED}",
    "p6_corrected": f"{_DAYS} {_ROLLED}",
    "p6_trailing_90": f"{_DAYS.replace('6 PRECEDING', '89 PRECEDING').replace('29 PRECEDING', '364 PRECEDING')} {_ROLLED.replace('_30', '_365').replace('_7', '_90')}",
    "p6_sales": f"WITH {_MONTHS} SELECT e AS series_id, m AS month, s3 AS total_3, CASE WHEN n3 > 0 THEN s3 / n3 END AS avg_3, n3 AS n_3, s12 AS total_12, CASE WHEN n12 > 0 THEN s12 / n12 END AS avg_12, n12 AS n_12 FROM mrolled",
}
