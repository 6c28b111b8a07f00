"""The found-queries of the general problems over a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from teesta.operators.donors import cells_without_value, donor_audit, filled_health_rows
from teesta.operators.gridfill import climate_grid, missing_periods
from teesta.operators.spikes import flag_spikes, source_tails, suspect_readings
from teesta.operators.timestamps import irregular_instants
from teesta.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return missing_periods(table(spark, d, "weekly_climate"), table(spark, d, "recent_vintage"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return irregular_instants(table(spark, d, "station_observation"), table(spark, d, "district_warning"), table(spark, d, "source_snapshot"), table(spark, d, "source_registry"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return suspect_readings(table(spark, d, "station_observation"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return cells_without_value(table(spark, d, "hmis_row"))


def p1_grid(spark: SparkSession, d: str) -> DataFrame:
    """How many periods of each series are observed and filled, and the observed total."""
    g = climate_grid(table(spark, d, "weekly_climate"), table(spark, d, "recent_vintage"))
    return g.groupBy("series_name", "grid_state").agg(F.count(F.lit(1)).alias("periods"), F.round(F.sum(F.when(F.col("grid_state") == "observed", F.col("value"))), 3).alias("observed_total"))


def p2_spikes(spark: SparkSession, d: str) -> DataFrame:
    """Every flagged reading with what is wrong with it."""
    x = flag_spikes(table(spark, d, "station_observation"))
    return x.where("impossible or frozen or stands_off").select("obs_id", "field_name", "value", "impossible", "frozen", "stands_off")


def p2_tails(spark: SparkSession, d: str) -> DataFrame:
    """The tail of every station and field."""
    return source_tails(table(spark, d, "station_observation"))


def p2_centres(spark: SparkSession, d: str) -> DataFrame:
    """The level of every station and field and its yardstick."""
    return source_tails(table(spark, d, "station_observation")).select("station", "field_name", F.round("centre", 6).alias("centre"), F.round("yardstick", 6).alias("yardstick"))


def p6_donors(spark: SparkSession, d: str) -> DataFrame:
    """Each filled cell held against its donor."""
    return donor_audit(table(spark, d, "hmis_row"))


def p6_filled(spark: SparkSession, d: str) -> DataFrame:
    return filled_health_rows(table(spark, d, "hmis_row"))


QUERIES = {f.__name__: f for f in (p1_found, p1_grid, p2_found, p2_spikes, p2_tails, p2_centres, p5_found, p6_found, p6_donors, p6_filled)}

_DAYS = """
  e AS (SELECT point_id, first_day + unnest(range(len(daily_rain_mm)))::INT AS day, unnest(daily_rain_mm) AS v FROM weekly_climate),
  u AS (SELECT DISTINCT point_id, day::DATE AS day FROM e WHERE v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v) AND v >= 0),
  g AS (SELECT point_id, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM u GROUP BY point_id),
  fu AS (SELECT DISTINCT point_id, date_trunc('week', timezone('UTC', retrieved_at))::DATE AS day FROM recent_vintage WHERE fill_days >= 0),
  fg AS (SELECT point_id, unnest(generate_series(min(day), max(day), INTERVAL 7 DAY))::DATE AS day FROM fu GROUP BY point_id)"""

_SPIKES = """
      l AS (UNPIVOT (SELECT obs_id, station, reading_no, rainfall_mm, temperature_c, relative_humidity_pct FROM station_observation)
                 ON rainfall_mm, temperature_c, relative_humidity_pct INTO NAME f VALUE v),
      d AS (SELECT station, reading_no, f, arg_min(v, obs_id) AS v FROM l WHERE v IS NOT NULL GROUP BY ALL),
      a AS (SELECT obs_id, f FROM l WHERE (f = 'rainfall_mm' AND v NOT BETWEEN 0 AND 500) OR (f = 'temperature_c' AND v NOT BETWEEN -10 AND 55) OR (f = 'relative_humidity_pct' AND v NOT BETWEEN 0 AND 100)),
      r AS (SELECT *, sum(CASE WHEN v IS DISTINCT FROM pv THEN 1 ELSE 0 END) OVER (PARTITION BY station, f ORDER BY reading_no) AS run
            FROM (SELECT *, lag(v) OVER (PARTITION BY station, f ORDER BY reading_no) AS pv FROM d)),
      b AS (SELECT station, reading_no, f FROM (SELECT *, count(*) OVER (PARTITION BY station, f, run) AS n FROM r) WHERE n >= 8 AND v <> 0),
      m AS (SELECT station, f, median(v) AS m FROM d WHERE f <> 'rainfall_mm' GROUP BY ALL),
      mad AS (SELECT station, f, m, median(abs(v - m)) AS s FROM d JOIN m USING (station, f) GROUP BY ALL),
      wet AS (SELECT station, f, median(v) AS m FROM d WHERE f = 'rainfall_mm' AND v > 0 GROUP BY ALL),
      c AS (SELECT obs_id, f FROM l JOIN mad USING (station, f) WHERE abs(v - m) > 6 * s UNION ALL SELECT obs_id, f FROM l JOIN wet USING (station, f) WHERE v > 5 * m)"""
_NO_VALUE = """
      SELECT row_id, 'malaria_tests' AS field_name FROM hmis_row WHERE malaria_tests IS NULL OR malaria_tests < 0 OR malaria_tests >= 99999 OR (malaria_tests = 0 AND malaria_positive_records > 0)
      UNION ALL SELECT row_id, 'malaria_test_positivity' FROM hmis_row WHERE malaria_test_positivity IS NULL OR isnan(malaria_test_positivity) OR malaria_test_positivity NOT BETWEEN 0 AND 1
      UNION ALL SELECT row_id, 'dengue_positive_records' FROM hmis_row WHERE dengue_positive_records IS NULL OR dengue_positive_records < 0 OR dengue_positive_records >= 9999
      UNION ALL SELECT row_id, 'district_name' FROM hmis_row WHERE district_name IS NULL OR lower(trim(district_name)) IN ('', '-', 'na', 'n/a', 'unknown', 'null', 'none')"""

ORACLE = {
    "p1_found": f"""WITH {_DAYS}
      SELECT 'daily_rain_mm' AS series_name, point_id, strftime(day, '%Y-%m-%d') AS period_day FROM (FROM g EXCEPT FROM u)
      UNION ALL SELECT 'fill_days', point_id, strftime(day, '%Y-%m-%d') FROM (FROM fg EXCEPT FROM fu)""",
    "p1_grid": f"""WITH {_DAYS},
      x AS (SELECT point_id, day, v, received_at, climate_row_id AS r FROM (SELECT point_id, first_day + unnest(range(len(daily_rain_mm)))::INT AS day, unnest(daily_rain_mm) AS v, received_at, climate_row_id FROM weekly_climate) WHERE v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v) AND v >= 0),
      y AS (SELECT 'daily_rain_mm' AS series_name, arg_max(v, (received_at, r, v)) AS v FROM x GROUP BY point_id, day
            UNION ALL SELECT 'fill_days', arg_max(fill_days, (retrieved_at, vintage_id))::DOUBLE FROM recent_vintage WHERE fill_days >= 0 GROUP BY point_id, date_trunc('week', timezone('UTC', retrieved_at)))
      SELECT series_name, 'observed' AS grid_state, count(*) AS periods, round(sum(v), 3) AS observed_total FROM y GROUP BY 1
      UNION ALL SELECT 'daily_rain_mm', 'filled', count(*), NULL FROM (FROM g EXCEPT FROM u)
      UNION ALL SELECT 'fill_days', 'filled', count(*), NULL FROM (FROM fg EXCEPT FROM fu)""",
    "p2_found": f"""WITH {_SPIKES} SELECT DISTINCT obs_id, f AS field_name FROM (
        FROM a UNION ALL SELECT obs_id, f FROM l JOIN b USING (station, reading_no, f) UNION ALL FROM c)""",
    "p2_spikes": f"""WITH {_SPIKES}, k AS (SELECT obs_id, f FROM l JOIN b USING (station, reading_no, f)),
      x AS (SELECT l.obs_id, l.f AS field_name, v AS value, a.f IS NOT NULL AS impossible, k.f IS NOT NULL AS frozen, c.f IS NOT NULL AS stands_off
            FROM l LEFT JOIN a USING (obs_id, f) LEFT JOIN k USING (obs_id, f) LEFT JOIN c USING (obs_id, f))
      FROM x WHERE impossible OR frozen OR stands_off""",
    "p2_centres": f"""WITH {_SPIKES} SELECT station, f AS field_name, round(m, 6) AS centre, round(s, 6) AS yardstick FROM mad
      UNION ALL SELECT d.station, 'rainfall_mm', CASE WHEN w.m IS NOT NULL THEN 0.0 END, round(w.m, 6) FROM (SELECT DISTINCT station FROM d WHERE f = 'rainfall_mm') d LEFT JOIN wet w USING (station)""",
    "p6_donors": f"""WITH n AS ({_NO_VALUE}), h AS (SELECT row_id, coalesce(district_id, '') AS g FROM hmis_row),
      has AS (SELECT DISTINCT g, f FROM h, (VALUES ('malaria_tests'), ('malaria_test_positivity'), ('dengue_positive_records'), ('district_name')) t(f)
              WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.row_id = h.row_id AND n.field_name = f))
      SELECT row_id, field_name, true AS same_group, true AS same_value FROM n JOIN h USING (row_id) JOIN has ON has.g = h.g AND has.f = n.field_name""",
    "p5_found": r"""
      WITH raw AS (
        SELECT 'station_observation' AS record_table, obs_id::VARCHAR AS record_key, source_id, observed_at AS t FROM station_observation
        UNION ALL SELECT 'district_warning', warning_id::VARCHAR, source_id, updated_at FROM district_warning
        UNION ALL SELECT 'source_snapshot', snapshot_id, source_id, retrieved_at FROM source_snapshot),
      odd AS (SELECT record_table, record_key, time_zone AS tz, date_order AS o, trim(translate(t, '०१२३४५६७८९০১২৩৪৫৬৭৮৯୦୧୨୩୪୫୬୭୮୯', '012345678901234567890123456789')) AS t
              FROM raw JOIN source_registry USING (source_id) WHERE t IS NOT NULL AND NOT regexp_matches(t, '^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$')),
      zone AS (SELECT *, CASE WHEN regexp_matches(t, '^\d{10,13}$') THEN '' WHEN regexp_matches(t, '[+-]\d\d:?\d\d$') AND regexp_matches(t, ':\d\d') THEN regexp_extract(t, '([+-]\d\d:?\d\d)$', 1)
                        WHEN regexp_matches(t, '[zZ]$') THEN '+00:00' ELSE CASE regexp_extract(t, ' ([A-Z]{3,4})$', 1) WHEN 'UTC' THEN '+00:00' WHEN 'IST' THEN '+05:30' WHEN 'CET' THEN '+01:00' WHEN 'CEST' THEN '+02:00' WHEN 'EDT' THEN '-04:00' WHEN 'EST' THEN '-05:00' END END AS z FROM odd),
      bare AS (SELECT *, replace(regexp_replace(regexp_replace(regexp_replace(t, '(T[\d:.]+|:\d\d) ?[+-]\d\d:?\d\d$', '\1'), '[zZ]$', ''), ' (UTC|IST|CET|CEST|EDT|EST|hrs)$', ''), ',', '.') AS b FROM zone),
      naive AS (SELECT *, coalesce(
          try_strptime(upper(b), ['%Y-%m-%dT%H:%M:%S.%f', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M:%S.%f', '%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M', '%Y%m%dT%H%M%S', '%Y/%m/%d %H:%M', '%Y/%m/%d %I:%M %p']),
          try_strptime(b, ['%d-%b-%y %H%M', '%a. %d %b %Y %H:%M:%S', '%d %b %Y %H:%M:%S', '%B %d. %Y %H:%M:%S']),
          CASE WHEN o = 'mdy' THEN try_strptime(b, ['%m/%d/%Y %I:%M %p', '%m/%d/%Y %H:%M']) ELSE try_strptime(b, ['%d/%m/%Y %I:%M %p', '%d/%m/%Y %H:%M']) END) AS n FROM bare)
      SELECT record_table, record_key, CASE
          WHEN regexp_matches(t, '^\d{10}$') THEN t::BIGINT * 1000000 WHEN regexp_matches(t, '^\d{13}$') THEN t::BIGINT * 1000
          WHEN z IS NOT NULL THEN epoch_us(n) - (CASE WHEN z[1] = '-' THEN -1 ELSE 1 END) * (z[2:3]::BIGINT * 60 + right(z, 2)::BIGINT) * 60000000
          ELSE epoch_us(timezone(tz, n)) END AS utc_micros
      FROM naive WHERE n IS NOT NULL OR regexp_matches(t, '^\d{10,13}$')""",
    "p6_found": _NO_VALUE,
}
