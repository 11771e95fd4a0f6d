"""Queries for the general data problems: drifting schemas, nested records, repeated messages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.operators import delivery, drift, nested
from quarrystone.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(table(spark, d, "column_facts")).select("file_id", "change_kind", "old_name", "new_name")


def p1_columns(spark: SparkSession, d: str) -> DataFrame:
    return drift.consistent_columns(table(spark, d, "column_facts"))


def p1_projections(spark: SparkSession, d: str) -> DataFrame:
    return drift.file_projections(table(spark, d, "column_facts"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    changes = drift.schema_changes(table(spark, d, "column_facts"))
    return changes.groupBy("series", "change_kind").agg(F.count("*").alias("changes"), F.countDistinct("file_id").alias("files"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.leaves(table(spark, d, "profile_bodies"))


def p3_tables(spark: SparkSession, d: str) -> DataFrame:
    return nested.flat_profiles(table(spark, d, "profile_bodies"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return delivery.surplus_deliveries(table(spark, d, "job_event_deliveries"))


def p5_messages(spark: SparkSession, d: str) -> DataFrame:
    kept = delivery.exactly_once(table(spark, d, "job_event_deliveries"))
    return kept.select("delivery_id", "batch_id", "event_id", "event_type", "received_at")


_FIRST = r"""
SELECT *, row_number() OVER (PARTITION BY lower(regexp_replace(job_id, '^\s+|\s+$', '', 'g')), event_id ORDER BY received_at, delivery_id) AS copy
FROM job_event_deliveries"""

QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_columns, p1_projections, p1_report, p3_found, p3_tables, p5_found, p5_messages)}

_STRIP = "lower(trim(name, ' ' || chr(9) || chr(10) || chr(13) || chr(65279)))"
_TYPES = "nullif(array_to_string(list_sort(list_distinct([lower(trim(x)) for x in coalesce(observed_types, []) if x IS NOT NULL AND trim(x) NOT IN ('', 'unknown')])), '|'), '')"
_P1 = f"""
WITH RECURSIVE raw AS (
  SELECT series, file_seq, file_id, name, raw_name, t, CASE WHEN t IS NOT NULL THEN nullable END AS nu, col_pos AS pos,
         row_number() OVER (PARTITION BY series, file_seq, file_id, name ORDER BY inspected_at DESC, fact_id DESC) AS rn
  FROM (SELECT *, {_TYPES} AS t FROM (SELECT * REPLACE ({_STRIP} AS name), name AS raw_name FROM column_facts)) WHERE name <> ''),
files AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY file_seq, file_id) AS idx FROM (SELECT DISTINCT series, file_seq, file_id FROM raw)),
cols AS (SELECT r.series, idx, r.file_id, name, raw_name, t, nu, pos, idx - row_number() OVER (PARTITION BY r.series, name ORDER BY idx) AS run FROM raw r JOIN files f USING (series, file_seq, file_id) WHERE rn = 1),
state AS (SELECT *, last_value(t IGNORE NULLS) OVER w AS lt, last_value(nu IGNORE NULLS) OVER w AS ln FROM cols WINDOW w AS (PARTITION BY series, name, run ORDER BY idx)),
old AS (SELECT s.series, s.idx + 1 AS idx, f.file_id, name, pos, lt, ln, run FROM state s JOIN files f ON f.series = s.series AND f.idx = s.idx + 1),
new AS (SELECT * FROM state WHERE idx > 1),
gone AS (SELECT * FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.series = o.series AND n.idx = o.idx AND n.name = o.name)),
came AS (SELECT * FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.series = n.series AND o.idx = n.idx AND o.name = n.name)),
renames AS (SELECT g.series, g.idx, g.file_id, g.name AS old_name, c.name AS new_name, g.lt, g.ln, g.run AS old_run, c.run, c.t, c.nu FROM gone g JOIN came c ON g.series = c.series AND g.idx = c.idx AND g.pos = c.pos AND g.lt = c.t),
inherited AS (
  SELECT series, new_name AS name, run, ln AS v FROM renames WHERE ln IS NOT NULL
  UNION ALL SELECT r.series, r.new_name, r.run, i.v FROM renames r JOIN inherited i ON i.series = r.series AND i.name = r.old_name AND i.run = r.old_run WHERE r.ln IS NULL),
kept AS (
  SELECT o.file_id, o.series, o.name AS old_name, n.name AS new_name, o.lt, n.t, o.ln, n.nu, o.run FROM old o JOIN new n ON o.series = n.series AND o.idx = n.idx AND o.name = n.name
  UNION ALL SELECT file_id, series, old_name, new_name, lt, t, ln, nu, old_run FROM renames),
judged AS (SELECT k.*, coalesce(k.ln, i.v) AS before FROM kept k LEFT JOIN inherited i ON i.series = k.series AND i.name = k.old_name AND i.run = k.run)
SELECT file_id, 'renamed' AS change_kind, old_name, new_name FROM renames
UNION ALL SELECT file_id, 'removed', name, '' FROM gone g WHERE NOT EXISTS (SELECT 1 FROM renames r WHERE r.series = g.series AND r.idx = g.idx AND r.old_name = g.name)
UNION ALL SELECT file_id, 'added', '', name FROM came c WHERE NOT EXISTS (SELECT 1 FROM renames r WHERE r.series = c.series AND r.idx = c.idx AND r.new_name = c.name)
UNION ALL SELECT file_id, 'type_changed', old_name, new_name FROM judged WHERE lt <> t
UNION ALL SELECT file_id, 'nullable_changed', old_name, new_name FROM judged WHERE before <> nu"""

_LINES = _P1[: _P1.index("inherited AS (")] + """
chained AS (
  SELECT DISTINCT c.series, c.name, c.run, c.name AS root, c.run AS root_run FROM cols c WHERE NOT EXISTS (SELECT 1 FROM renames r WHERE r.series = c.series AND r.new_name = c.name AND r.run = c.run)
  UNION ALL SELECT r.series, r.new_name, r.run, h.root, h.root_run FROM renames r JOIN chained h ON h.series = r.series AND h.name = r.old_name AND h.run = r.old_run),
member AS (SELECT c.*, root, root_run FROM cols c JOIN chained h ON h.series = c.series AND h.name = c.name AND h.run = c.run),
chains AS (SELECT series, root, root_run, arg_max(name, idx) AS last, min(idx) AS b, max(idx) AS e FROM member GROUP BY 1, 2, 3),
marks AS (SELECT series, max(length(name) - length(replace(name, '#', ''))) AS marks FROM cols GROUP BY 1),
lines AS (
  SELECT c.series, root, root_run, CASE WHEN min(b) OVER (PARTITION BY c.series, last ORDER BY e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= e THEN last || repeat('#', CAST(marks + 1 AS BIGINT)) || e ELSE last END AS line
  FROM chains c JOIN marks m ON m.series = c.series),
lined AS (SELECT m.*, line AS column_name FROM member m JOIN lines l ON l.series = m.series AND l.root = m.root AND l.root_run = m.root_run),
per AS (
  SELECT series, column_name, nullif(array_to_string(list_sort(list_distinct(flatten(list(string_split(t, '|')) FILTER (WHERE t IS NOT NULL)))), '|'), '') AS types, coalesce(bool_or(nu), true) AS nullable,
    arg_min(file_id, idx) AS first_file, arg_max(file_id, idx) AS last_file, count(*) AS n_files, array_to_string(list_sort(list(DISTINCT name)), '|') AS names
  FROM lined GROUP BY 1, 2),
typed AS (
  SELECT *, CASE WHEN types IS NULL THEN 'unknown' WHEN types = 'integer|number' THEN 'number' WHEN types LIKE '%string%' OR types LIKE '%|%' THEN 'string' WHEN types LIKE '%number%' THEN 'number' ELSE types END AS unified_type FROM per)
"""
_EXPRESSION = "'try_cast(`' || replace(raw_name, '`', '``') || '` as ' || CASE unified_type WHEN 'integer' THEN 'bigint' WHEN 'number' THEN 'double' WHEN 'boolean' THEN 'boolean' ELSE 'string' END || ') as `' || replace(l.column_name, '`', '``') || '`'"


def _plain(x: str) -> str:
    return f"(CASE json_type({x}) WHEN 'VARCHAR' THEN CASE WHEN json_valid({x} ->> '$') THEN CAST({x} ->> '$' AS JSON) END ELSE {x} END)"


def _items(x: str) -> str:
    return f"(CASE json_type({x}) WHEN 'ARRAY' THEN CAST({x} AS JSON[]) WHEN 'OBJECT' THEN [{x}] ELSE CAST([] AS JSON[]) END)"


_P3 = f"""
WITH body AS (SELECT DISTINCT profile_id, CAST(body AS JSON) AS j FROM profile_bodies WHERE json_valid(body)),
root AS (SELECT profile_id, {_plain("coalesce(j -> '$.payload', j) -> '$.snapshots'")} AS x FROM body),
snaps AS (SELECT profile_id, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS sp FROM (SELECT profile_id, {_items("x")} AS l FROM root)),
sk AS (SELECT profile_id, sp, {_plain("s -> '$.sketch'")} AS k, {_plain("s -> '$.sampling'")} AS g FROM snaps),
sk2 AS (SELECT profile_id, sp, {_plain("coalesce(k -> '$.skippedPaths', k -> '$.skipped_paths')")} AS p, g FROM sk),
skipped AS (SELECT profile_id, sp, unnest(l) AS c, generate_subscripts(l, 1) - 1 AS cp FROM (SELECT profile_id, sp, {_items("p")} AS l FROM sk2)),
runs AS (SELECT profile_id, sp, unnest(l) AS r, generate_subscripts(l, 1) - 1 AS gp FROM (SELECT profile_id, sp, {_items("g")} AS l FROM sk2)),
runs2 AS (SELECT profile_id, sp, gp, {_plain("coalesce(r -> '$.samplingSummary', r -> '$.sampling_summary')")} AS m, {_plain("coalesce(r -> '$.sampleRefs', r -> '$.sample_refs')")} AS f FROM runs),
runs3 AS (SELECT profile_id, sp, gp, f, {_plain("coalesce(m -> '$.coverageLosses', m -> '$.coverage_losses')")} AS o FROM runs2),
losses AS (SELECT profile_id, sp, gp, unnest(l) AS c, generate_subscripts(l, 1) - 1 AS cp FROM (SELECT profile_id, sp, gp, {_items("o")} AS l FROM runs3)),
refs AS (SELECT profile_id, sp, gp, unnest(l) AS c, generate_subscripts(l, 1) - 1 AS cp FROM (SELECT profile_id, sp, gp, {_items("f")} AS l FROM runs3))
SELECT DISTINCT * FROM (
  SELECT profile_id, 'skipped_path' AS child_kind, sp AS snapshot_pos, -1 AS sampling_pos, cp AS child_pos, CASE json_type(c) WHEN 'VARCHAR' THEN c ->> '$' ELSE c ->> '$.path' END AS child_value FROM skipped
  UNION ALL SELECT profile_id, 'coverage_loss', sp, gp, cp, CASE json_type(c) WHEN 'VARCHAR' THEN c ->> '$' ELSE nullif(concat_ws(':', nullif(c ->> '$.path', ''), c ->> '$.code'), '') END FROM losses
  UNION ALL SELECT profile_id, 'video_path', sp, gp, cp, nullif(coalesce(c ->> '$.videoPath', c ->> '$.video_path'), '') FROM refs) WHERE child_value IS NOT NULL"""

SQL: dict[str, str] = {
    "p1_found": _P1,
    "p1_columns": f"{_LINES} SELECT series, column_name, unified_type, nullable, first_file, last_file, n_files, names FROM typed",
    "p1_projections": f"{_LINES} SELECT l.series, file_id, string_agg({_EXPRESSION}, ', ' ORDER BY l.column_name) AS projection FROM lined l JOIN typed t ON t.series = l.series AND t.column_name = l.column_name GROUP BY l.series, idx, file_id",
    "p3_found": _P3,
    "p1_report": f"SELECT series, change_kind, count(*) AS changes, count(DISTINCT file_id) AS files FROM ({_P1}) JOIN (SELECT DISTINCT series, file_id FROM column_facts) USING (file_id) GROUP BY 1, 2",
    "p3_tables": _P3
    + """
UNION ALL SELECT DISTINCT profile_id, 'snapshot', sp, -1, sp, s ->> '$.revision' FROM snaps
UNION ALL SELECT DISTINCT profile_id, 'sampling_run', sp, gp, gp, m ->> '$.id' FROM runs2""",
    "p5_found": f"SELECT delivery_id FROM ({_FIRST}) WHERE copy > 1",
    "p5_messages": f"SELECT delivery_id, batch_id, event_id, event_type, received_at FROM ({_FIRST}) WHERE copy = 1",
}
