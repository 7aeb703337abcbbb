"""Queries of the attribute history and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallspark.operators.history import KEY, change_rates, note_history, note_satellites, satellite_view, standing_notes
from recallspark.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of stateful attributes with the period in which each held."""
    versions = note_history(table(spark, sf_dir, "notes"), table(spark, sf_dir, "attribute_kinds"))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    return versions.select(
        "conv_id", "note_key", iso("start").alias("valid_from"), F.coalesce(iso("end"), F.lit("open")).alias("valid_until")
    )


def p3_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same versions numbered, with their value."""
    versions = note_history(table(spark, sf_dir, "notes"), table(spark, sf_dir, "attribute_kinds"))
    w = Window.partitionBy("conv_id", "note_key").orderBy("start")
    return versions.select(
        "conv_id", "note_key", F.row_number().over(w).alias("version_no"), "value",
        F.date_format("start", "yyyy-MM-dd").alias("valid_from"), F.date_format("end", "yyyy-MM-dd").alias("valid_until"),
    )


def p3_satellites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version of each slow and fast satellite: its attributes as JSON, and the period they held."""
    parts = []
    for own, rows in note_satellites(table(spark, sf_dir, "notes"), table(spark, sf_dir, "attribute_kinds")):
        view = satellite_view(rows, KEY, "start")
        parts.append(view.select(
            *KEY, F.lit(", ".join(own)).alias("attributes"), F.to_json(F.struct(*own)).alias("held"),
            F.date_format("start", "yyyy-MM-dd").alias("valid_from"), F.date_format("end", "yyyy-MM-dd").alias("valid_until"),
        ))
    return reduce(DataFrame.unionByName, parts)


def p3_change_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of standing notes that change each attribute: what decides the satellites."""
    rows = standing_notes(table(spark, sf_dir, "notes"), table(spark, sf_dir, "attribute_kinds"))
    rates = change_rates(rows, ["conv_id", "note_key"], "day", ["value", "until", "status"])
    return rates.select(*[F.round(c, 6).alias(f"{c}_rate") for c in rates.columns])


def _day(c: str) -> str:
    month = f"lower(substr(regexp_extract({c}, '(\\d{{1,2}})\\s+([A-Za-z]{{3,9}})\\.?,?\\s+(\\d{{4}})', 2), 1, 3))"
    part = lambda i: f"regexp_extract({c}, '(\\d{{1,2}})\\s+([A-Za-z]{{3,9}})\\.?,?\\s+(\\d{{4}})', {i})"
    number = f"((instr('janfebmaraprmayjunjulaugsepoctnovdec', {month}) + 2) // 3)"
    return (
        f"CASE WHEN regexp_matches({c}, '^\\s*\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast(regexp_extract({c}, '^\\s*(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1) AS DATE) "
        f"WHEN {part(1)} <> '' THEN try_cast({part(3)} || '-' || lpad(CAST({number} AS VARCHAR), 2, '0') || '-' || lpad({part(1)}, 2, '0') AS DATE) END"
    )


_STANDING = f"""
latest AS (
  SELECT note_id, conv_id, lower(trim(attribute)) AS attribute,
         lower(trim(subject)) || '::' || lower(trim(attribute)) AS note_key, ingested_at,
         {_day("coalesce(nullif(trim(valid_from), ''), nullif(trim(event_time), ''), recorded_time)")} AS day,
         {_day("valid_until")} AS until, lower(trim(status)) AS status,
         regexp_replace(trim(lower(regexp_replace(coalesce(statement, ''), '\\s+', ' ', 'g'))), '[\\s.]+$', '') AS value
  FROM notes WHERE note_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY ingested_at DESC NULLS LAST, day DESC NULLS LAST, value DESC) = 1),
standing AS (
  SELECT * FROM latest WHERE day IS NOT NULL AND note_key IS NOT NULL
    AND attribute IN (SELECT lower(trim(attribute)) FROM attribute_kinds WHERE stateful)
  QUALIFY row_number() OVER (PARTITION BY conv_id, note_key, day ORDER BY ingested_at DESC NULLS LAST, note_id DESC) = 1)"""

_VERSIONS = f"""
WITH {_STANDING},
ended AS (
  SELECT *, CASE WHEN until > day AND (nxt IS NULL OR until < nxt) THEN until ELSE nxt END AS stop
  FROM (SELECT *, lead(day) OVER (PARTITION BY conv_id, note_key ORDER BY day) AS nxt FROM standing)),
flagged AS (
  SELECT *, CASE WHEN lag(stop) OVER w = day AND lag(value) OVER w = value THEN 0 ELSE 1 END AS fresh
  FROM ended WINDOW w AS (PARTITION BY conv_id, note_key ORDER BY day)),
runs AS (
  SELECT *, sum(fresh) OVER (PARTITION BY conv_id, note_key ORDER BY day) AS run FROM flagged),
versions AS (
  SELECT conv_id, note_key, run, min(day) AS start, any_value(value) AS value,
         CASE WHEN count(*) = count(stop) THEN max(stop) END AS stop
  FROM runs GROUP BY conv_id, note_key, run)"""

QUERIES = {"p3_found": p3_found, "p3_history": p3_history, "p3_satellites": p3_satellites, "p3_change_rates": p3_change_rates}

SQL = {
    "p3_found": _VERSIONS + """
SELECT conv_id, note_key, strftime(start, '%Y-%m-%d') AS valid_from,
       coalesce(strftime(stop, '%Y-%m-%d'), 'open') AS valid_until FROM versions""",
    "p3_history": _VERSIONS + """
SELECT conv_id, note_key, CAST(run AS INTEGER) AS version_no, value,
       strftime(start, '%Y-%m-%d') AS valid_from, strftime(stop, '%Y-%m-%d') AS valid_until FROM versions""",
    "p3_change_rates": f"""
WITH {_STANDING},
c AS (
  SELECT row_number() OVER w AS n,
         CAST(value IS DISTINCT FROM lag(value) OVER w AS INTEGER) AS v,
         CAST(until IS DISTINCT FROM lag(until) OVER w AS INTEGER) AS u,
         CAST(status IS DISTINCT FROM lag(status) OVER w AS INTEGER) AS s
  FROM standing WINDOW w AS (PARTITION BY conv_id, note_key ORDER BY day))
SELECT round(coalesce(avg(v), 0), 6) AS value_rate, round(coalesce(avg(u), 0), 6) AS until_rate,
       round(coalesce(avg(s), 0), 6) AS status_rate FROM c WHERE n > 1""",
}
