"""DuckDB SQL for every registered query, written independently of the Spark code.

Where Spark hashes a document, the SQL compares its whole sorted content; where Spark runs a chain of
conditions, the SQL joins the rules as a table and takes the first by position. Only the rule values
themselves are shared.
"""

from __future__ import annotations

from checks.inputs import ENTITY, ENTITY_CODE, LOOKED_UP, OTHER_ENTITY, POINT_BASE, PROJECT_FOLDER, SEALED
from checks.queries import SCOPES, TABLES, YEAR, YEARS
from figtrace.functions import rules as R
from figtrace.operators.compare import MESSAGES
from figtrace.operators.profile import CONTRACT

ORACLES: dict[str, str] = {}


def lit(value: object) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def values(name: str, columns: str, rows) -> str:
    """A rule table with its order as ``ord``."""
    body = ", ".join("(" + ", ".join([str(i), *map(lit, row)]) + ")" for i, row in enumerate(rows))
    return f"{name}(ord, {columns}) AS (VALUES {body})"


def oracle(name: str, *ctes: str, select: str) -> None:
    ORACLES[name] = ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + select.strip()


POINTS = f"""m AS ({POINT_BASE}),
points AS (
  SELECT * EXCLUDE (d) FROM m
  UNION ALL
  SELECT * EXCLUDE (d) REPLACE ('x' || point_id AS point_id,
    replace(source_file, '/Shared/Archive/', '{PROJECT_FOLDER}') AS source_file) FROM m WHERE d % 4 = 0 AND d < 196
  UNION ALL
  SELECT * EXCLUDE (d) REPLACE ('y' || point_id AS point_id,
    replace(source_file, '.xlsx', ' - Copy.xlsx') AS source_file) FROM m WHERE d % 10 = 0 AND d < 196
)"""

MARKS = " + ".join(f"CAST(lower(source_file) LIKE {lit(p)} AS BIGINT)" for p in R.COPY_MARKERS)


def canonical(source: str = "points", path: str = "source_file", cell: str = "location", value: str = "value_num") -> str:
    """Documents of equal content, found by comparing the content itself."""
    return f"""contents AS (
  SELECT {path} AS source_file, count(*) AS n_points,
    list_sort(list(coalesce(CAST({cell} AS VARCHAR), '') || chr(1) || coalesce(CAST({value} AS VARCHAR), ''))) AS content
  FROM {source} WHERE {path} <> '' GROUP BY 1),
ranked AS (
  SELECT *, {MARKS} AS copy_penalty, len(string_split(source_file, '/')) - 1 AS depth FROM contents),
groups AS (
  SELECT content, count(*) AS copies,
    min({{'a': copy_penalty, 'b': depth, 'c': length(source_file), 'd': source_file}}).d AS canonical_source_file
  FROM ranked GROUP BY 1),
canon AS (
  SELECT source_file, canonical_source_file, source_file = canonical_source_file AS is_canonical, copies, n_points,
    CAST(copy_penalty AS INTEGER) AS copy_penalty, CAST(depth AS INTEGER) AS depth
  FROM ranked JOIN groups USING (content))"""


CANON = canonical()
NORMAL = "lower(trim(replace(source_file, chr(92), '/'), '/'))"
SEALED_NORMAL = SEALED.lower().strip("/")
OPEN = f"NOT ({NORMAL} = {lit(SEALED_NORMAL)} OR starts_with({NORMAL}, {lit(SEALED_NORMAL + '/')}))"
CANONICAL_ONLY = "source_file IN (SELECT c.source_file FROM canon c WHERE c.is_canonical)"
CLASSED = """classed AS (
  SELECT *, CASE lower(temporality) WHEN 'forecast' THEN 'forecast' WHEN 'actual' THEN 'fact'
    ELSE CASE WHEN lower(scenario) = 'high' OR lower(scenario) = 'low' THEN 'assumption' ELSE 'unclassified' END
    END AS data_class
  FROM points)"""
SERVED = f"served AS (SELECT * FROM classed WHERE {OPEN} AND {CANONICAL_ONLY})"
SEARCHED = [POINTS, CANON, CLASSED, SERVED]
IS_ENTITY = f"(entity ILIKE '%{ENTITY}%' OR entity_id ILIKE '%{ENTITY}%')"

# Sources and binding

oracle("scan_points", POINTS, select="SELECT entity_id, count(*) AS n_rows FROM points GROUP BY 1")
oracle("replaced_table", POINTS, select="SELECT entity_id, count(*) AS n_rows, count(year) AS n_years FROM points GROUP BY 1")
oracle("bind_columns", POINTS, select="""
SELECT point_id AS record_id, CAST(value_num AS DECIMAL(18,7)) AS value, year, metric_code, entity_id AS entity, entity_id,
  unit, source_file AS source, location AS cell, context AS qualifiers, context AS extract_text
FROM points""")
oracle("data_class_view", POINTS, CLASSED, select="SELECT data_class, count(*) AS n FROM classed GROUP BY 1")

# Completeness

oracle("fill_rate", POINTS, select=" UNION ALL ".join(
    f"SELECT '{c}' AS concept, count(nullif({c}, '')) AS filled, count(*) AS total FROM points"
    for c in ("metric_code", "temporality", "project_id", "entity")))

# Scalar columns of the given tables.
COLUMNS = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag "
    "l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id label",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role text",
}
TYPE = """CASE any_value(typeof({})) WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
  ELSE lower(any_value(typeof({}))) END AS data_type"""
oracle("points_tables", POINTS, select=" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, {'true' if t in ('points', 'events') else 'false'} AS holds_points, count(*) AS n_rows FROM {t}" for t in (*TABLES, "points")))
oracle("fill_pct", POINTS, select=" UNION ALL ".join(
    f"SELECT '{c}' AS concept, count(nullif({c}, '')) AS filled, count(*) AS total, "
    f"round(count(nullif({c}, '')) * 100.0::DOUBLE / count(*), 6) AS pct FROM points"
    for c in ("metric_code", "temporality", "project_id", "entity")))
oracle("table_profile", select=" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, {TYPE.format(c, c)}, count(nullif(CAST({c} AS VARCHAR), '')) AS n_nonblank, "
    f"count(*) AS n_rows FROM {t}"
    for t in TABLES for c in COLUMNS[t].split()))

HELD = {"entity", "entity_id", "metric_code", "unit", "basis", "currency", "year", "temporality", "source_file",
        "project_id", "source_type_flag"}
oracle("contract_check", POINTS, select=" UNION ALL ".join(
    f"SELECT '{g}' AS contract_group, '{c}' AS column_name, {'true' if c in HELD else 'false'} AS present, "
    + (f"count(nullif(CAST({c} AS VARCHAR), '')) AS n_filled FROM points" if c in HELD else "CAST(0 AS BIGINT) AS n_filled")
    for g, columns in CONTRACT.items() for c in columns))
oracle("flag_freq", POINTS, select="""
SELECT CASE WHEN source_type_flag IS NULL OR source_type_flag = '' THEN '(blank)' ELSE source_type_flag END AS flag,
  count(*) AS n
FROM points GROUP BY 1 ORDER BY n DESC, flag LIMIT 10""")

def cited(value: str) -> str:
    return f"""coalesce(metric_code, '?') || '=' || coalesce(CAST({value} AS VARCHAR), '?') || ' '
  || coalesce(unit, '') || ' (' || coalesce(entity, '?') || ' ' || coalesce(CAST(year AS VARCHAR), '?') || ') [class='
  || data_class || ', status=' || coalesce(review_status, 'unverified') || '] source: ' || coalesce(source_file, 'UNSOURCED')"""


# Search and summary

oracle("search_points", *SEARCHED, select=f"""
SELECT point_id AS record_id, metric_code, entity, entity_id, year, value_num AS value, unit, currency, value_scale,
  data_class, review_status AS verification_status, source_file AS source, source_type_flag, temporality, project_id,
  {cited('value_num')} AS citation, 'Source: explicit store derived, table points.' AS provenance
FROM served WHERE metric_code ILIKE '%aero%' AND {IS_ENTITY} AND year BETWEEN 1996 AND 1999
ORDER BY point_id LIMIT 25""")
oracle("search_class_status", *SEARCHED, select="""
SELECT point_id AS record_id FROM served WHERE data_class = 'fact' AND review_status = 'accepted'""")
oracle("search_geography", *SEARCHED, select=f"""
SELECT point_id AS record_id FROM served WHERE entity ILIKE '%{OTHER_ENTITY}%'""")
oracle("search_require_code", *SEARCHED, select=f"""
SELECT count(*) AS n_all, count(*) FILTER (WHERE metric_code <> '') AS n_with_code FROM served WHERE {IS_ENTITY}""")
oracle("search_quarantine", POINTS, select=f"""
SELECT count(*) AS n_all, count(*) FILTER (WHERE {OPEN}) AS n_kept, count(*) FILTER (WHERE NOT {OPEN}) AS n_sealed
FROM points""")
oracle("search_absent_filter", POINTS, select="""
SELECT point_id AS record_id, 'data_class,verification_status' AS not_applied FROM points
WHERE metric_code ILIKE '%rev_aero%'""")

KEYS = {c: f"CAST({c} AS VARCHAR)" for c in ("metric_code", "unit", "data_class", "temporality", "year")}
KEYS["source_folder"] = "array_to_string(string_split(source_file, '/')[1:5], '/')"
oracle("summarise", *SEARCHED, f"""pairs AS (
  SELECT unnest([{{'facet': '_total', 'key': 'all'}}, {', '.join(f"{{'facet': '{f}', 'key': {k}}}" for f, k in KEYS.items())}],
    recursive := true)
  FROM served WHERE {IS_ENTITY}
  UNION ALL SELECT '_untagged', 'metric_code' FROM served WHERE {IS_ENTITY} AND coalesce(metric_code, '') = '')""", """counts AS (
  SELECT facet, CASE WHEN coalesce(key, '') = '' THEN '(blank)' ELSE key END AS key, count(*) AS n FROM pairs GROUP BY ALL)""", """
places AS (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, key) AS place FROM counts)""", select="""
SELECT facet, key, n FROM places WHERE place <= 15""")
oracle("summarise_untagged", *SEARCHED, select="""
SELECT count(*) AS n_total, count(*) FILTER (WHERE coalesce(metric_code, '') = '') AS n_blank,
  CAST(round(CAST(100 * count(*) FILTER (WHERE coalesce(metric_code, '') = '') AS DECIMAL(18,0)) / count(*), 1)
    AS DECIMAL(4,1)) AS blank_pct
FROM served WHERE year >= 1996""")

AEROS = f"metric_code ILIKE '%aero%' AND {IS_ENTITY}"
PAGES = {  # filter, what it is understood as, what was done about copies
    "cut": (f"served WHERE {AEROS} AND year BETWEEN 1996 AND 1999", f"metric_code=aero, entity={ENTITY}, year_from=1996, year_to=1999", "applied"),
    "whole": (f"served WHERE {AEROS} AND year = 1998 AND review_status = 'queued' AND data_class = 'fact'",
              f"metric_code=aero, entity={ENTITY}, year_from=1998, year_to=1998, data_class=fact, verification_status=queued", "applied"),
    "nothing": ("served WHERE false", "metric_code=no such metric", "applied"),
    "ignored": ("points WHERE metric_code ILIKE '%aero%'", "metric_code=aero", "unavailable"),
}
IGNORED = "not applied, because the table has no such concept: ['verification_status']; results are unfiltered on them"
oracle("page_notes", *SEARCHED, select=" UNION ALL ".join(f"""
SELECT CAST(least(count(*), 25) AS INTEGER) AS returned, count(*) > 25 AS truncated,
  CASE WHEN count(*) = 0 THEN 'no evidence held for these filters' END AS note,
  {lit(IGNORED if page == 'ignored' else None)} AS warning, '{said}' AS understood_as, '{copies}' AS deduplication, '{page}' AS page
FROM {rows}""" for page, (rows, said, copies) in PAGES.items()))
oracle("summary_notes", *SEARCHED, f"""scopes AS (
  SELECT 'some' AS scope, 'entity={ENTITY}' AS understood_as, count(*) AS matching, count(*) FILTER (WHERE coalesce(metric_code, '') = '') AS untagged
  FROM served WHERE {IS_ENTITY}
  UNION ALL SELECT 'coded', 'entity={ENTITY}, require_metric_code=True', count(*), 0 FROM served WHERE {IS_ENTITY} AND metric_code <> '')""",
  """shared AS (SELECT *, CAST(round(CAST(100 * untagged AS DECIMAL(18,0)) / matching, 1) AS DECIMAL(4,1)) AS untagged_pct FROM scopes)""",
  select="""
SELECT matching, untagged, untagged_pct, CASE WHEN untagged > 0 THEN untagged || ' of ' || matching || ' points (' || untagged_pct ||
  '%) state no metric code, so what they measure is not known' END AS caveat, CAST(NULL AS VARCHAR) AS note, CAST(NULL AS VARCHAR) AS warning,
  understood_as, 'applied' AS deduplication, scope
FROM shared
UNION ALL SELECT NULL, NULL, NULL, NULL, 'a summary needs at least one filter', NULL, '', 'applied', 'none'""")

# Sources of figures

MANIFEST = """manifest AS (
  SELECT '/Shared/' || source || '/' || lang || '/doc_' || doc_id || '.txt' AS path,
    CASE doc_id % 7 WHEN 0 THEN 'skipped' WHEN 1 THEN 'failed' ELSE 'done' END AS status
  FROM documents)"""
SCOPE_ROWS = """scopes AS (
  SELECT '/Shared/' || source AS scope FROM documents UNION SELECT '/Shared/' || source || '/' || lang FROM documents)"""
BELOW = "starts_with(path, scope || '/')"


oracle("citation", POINTS, CLASSED, select=f"""
SELECT point_id AS record_id, {cited('value_num')} AS citation,
  'Source: explicit store derived, table points.' AS provenance
FROM classed""")
SOURCES = (POINTS.replace("points AS", "homed AS"), """points AS (
  SELECT * REPLACE (CASE WHEN starts_with(source_file, '/Shared/Archive/')
    THEN '/Shared/src' || (n % 20) || '/' || (CASE n % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'es' END)
      || '/' || string_split(source_file, '/')[-1]
    ELSE source_file END AS source_file)
  FROM (SELECT *, CAST(regexp_extract(location, '([0-9]+)$', 1) AS BIGINT) AS n FROM homed))""", CLASSED, MANIFEST, f"""
held AS (
  SELECT a.record_id, c.*, {NORMAL.replace('lower', '')} AS clean,
    CASE WHEN c.point_id IS NULL THEN 'no_evidence' WHEN coalesce({OPEN}, true) THEN 'ok' ELSE 'refused_quarantine' END AS outcome
  FROM asked a LEFT JOIN classed c ON a.record_id = c.point_id)""", """
foldered AS (
  SELECT *, CASE WHEN source_file LIKE '%/%' THEN '/' || array_to_string(list_slice(string_split(clean, '/'), 1, -2), '/')
    ELSE '' END AS folder
  FROM held)""", """
disclosed AS (
  SELECT folder, count(*) FILTER (WHERE folder = '' OR starts_with(path, folder || '/')) AS in_scope,
    count(*) FILTER (WHERE (folder = '' OR starts_with(path, folder || '/')) AND status <> 'done') AS not_done
  FROM (SELECT DISTINCT folder FROM foldered WHERE outcome = 'ok'), manifest GROUP BY 1)""", """
told AS (
  SELECT folder, string_agg(status || ' ' || n, ', ' ORDER BY n DESC, status) AS by_status
  FROM (SELECT folder, status, count(*) AS n FROM (SELECT DISTINCT folder FROM foldered WHERE outcome = 'ok'), manifest
        WHERE folder = '' OR starts_with(path, folder || '/') GROUP BY 1, 2)
  GROUP BY 1)""")
SOURCED = f"""
SELECT record_id, outcome, CASE WHEN outcome = 'ok' THEN context END AS verbatim,
  CASE WHEN outcome = 'ok' THEN nullif(source_file, '') END AS locator_path,
  CASE WHEN outcome = 'ok' THEN location END AS cell, CASE WHEN outcome = 'ok' THEN metric_code END AS metric_code,
  CASE WHEN outcome = 'ok' THEN value_num END AS value, CASE WHEN outcome = 'ok' THEN unit END AS unit,
  CASE WHEN outcome = 'ok' THEN year END AS year, CASE WHEN outcome = 'ok' THEN data_class END AS data_class,
  CASE WHEN outcome = 'ok' THEN review_status END AS verification_status,
  CASE WHEN outcome = 'ok' THEN 'Source: explicit store derived, table points.' END AS provenance, CASE WHEN outcome = 'ok' THEN {cited('value_num')} END AS citation,
  CASE WHEN outcome = 'ok' THEN lower(folder) END AS scope,
  CASE WHEN outcome = 'ok' THEN in_scope END AS in_scope, CASE WHEN outcome = 'ok' THEN in_scope - not_done END AS done, CASE WHEN outcome = 'ok' THEN not_done END AS not_done,
  CASE WHEN outcome = 'ok' THEN coalesce(by_status, '') END AS by_status
FROM foldered LEFT JOIN disclosed USING (folder) LEFT JOIN told USING (folder)"""
oracle("get_source", """
asked AS (SELECT DISTINCT (CASE event_type WHEN 'error' THEN 'u' ELSE 'p' END) || event_id AS record_id FROM events)""", *SOURCES, select=SOURCED)
oracle("point_lookup", f"asked AS (SELECT unnest({LOOKED_UP}) AS record_id)", *SOURCES, select=SOURCED)
oracle("skip_disclosure", MANIFEST, SCOPE_ROWS, f"""counted AS (
  SELECT scope, status, count(*) AS n FROM scopes JOIN manifest ON {BELOW} GROUP BY 1, 2)""", select="""
SELECT scope, 'harvest_manifest' AS manifest, CAST(sum(n) AS BIGINT) AS in_scope,
  CAST(coalesce(sum(n) FILTER (WHERE status = 'done'), 0) AS BIGINT) AS done,
  CAST(coalesce(sum(n) FILTER (WHERE status <> 'done'), 0) AS BIGINT) AS not_done,
  string_agg(status || ' ' || n, ', ' ORDER BY n DESC, status) AS by_status
FROM counted GROUP BY 1""")
oracle("skip_absent", SCOPE_ROWS, select="""
SELECT scope, 'ABSENT' AS manifest, CAST(NULL AS BIGINT) AS in_scope, CAST(NULL AS BIGINT) AS done, CAST(NULL AS BIGINT) AS not_done,
  CAST(NULL AS VARCHAR) AS by_status
FROM scopes""")
oracle("skip_by_status", MANIFEST, SCOPE_ROWS, select=f"""
SELECT scope, status, count(*) AS n FROM scopes JOIN manifest ON {BELOW} GROUP BY 1, 2""")

COMPARISONS = """comparisons AS (
  SELECT concat_ws('|', 'a', metric_code, unit, currency, value_scale, basis, entity_id) AS comparison_id, point_id AS record_id
  FROM points
  UNION SELECT 'b' || l_partkey, 'p' || l_orderkey FROM lineitem
  UNION SELECT 'c' || event_id, unnest(['p' || event_id, 'u' || event_id]) FROM events)"""
RECORDS = """records AS (
  SELECT comparison_id, record_id, point_id IS NOT NULL AS held, metric_code, unit, currency, value_scale, basis,
    temporality, entity, CAST(year AS VARCHAR) AS year, value_num
  FROM comparisons LEFT JOIN points ON record_id = point_id)"""
HARD = ["metric_code", "unit", "currency", "value_scale", "basis"]
oracle("compare_evidence", POINTS, COMPARISONS, RECORDS, f"""judged AS (
  SELECT comparison_id, count(*) FILTER (WHERE held) AS n_held, count(*) FILTER (WHERE NOT held) AS n_missing,
    {' AND '.join(f"count(DISTINCT coalesce({a}, '')) FILTER (WHERE held) <= 1" for a in HARD)} AS agrees,
    count(value_num) AS n_v, min(value_num) AS lo, round(median(value_num), 4) AS mid, max(value_num) AS hi
  FROM records GROUP BY 1)""", """verdicts AS (
  SELECT *, CASE WHEN n_held < 2 THEN 'insufficient' WHEN agrees THEN 'comparable' ELSE 'not_comparable' END AS verdict
  FROM judged)""", """spreads AS (SELECT *, verdict = 'comparable' AND n_v = n_held AS shown FROM verdicts)""", select="""
SELECT comparison_id, verdict, n_held, n_missing, CASE WHEN shown THEN n_v END AS n, CASE WHEN shown THEN lo END AS v_min,
  CASE WHEN shown THEN mid END AS v_median, CASE WHEN shown THEN hi END AS v_max
FROM spreads""")
oracle("compare_flags", POINTS, COMPARISONS, RECORDS, "axes AS (" + " UNION ".join(
    f"SELECT comparison_id, '{a}' AS axis, '{'hard' if a in HARD else 'soft'}' AS severity, "
    f"coalesce(nullif({a}, ''), '(blank)') AS value FROM records WHERE held"
    for a in [*HARD, "temporality", "entity", "year"]) + ")",
    "messages(axis, message) AS (VALUES " + ", ".join(f"({lit(a)}, {lit(m)})" for a, m in MESSAGES.items()) + ")", select="""
SELECT comparison_id, axis, severity, count(*) OVER (PARTITION BY comparison_id, axis) AS n_values, value, message
FROM axes LEFT JOIN messages USING (axis)
QUALIFY n_values > 1""")
oracle("compare_aligned", POINTS, COMPARISONS, RECORDS, "agreed AS (" + " UNION ALL ".join(
    f"SELECT comparison_id, '{a}' AS axis, any_value(coalesce({a}, '')) AS value FROM records WHERE held "
    f"GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT coalesce({a}, '')) = 1" for a in HARD) + ")", select="SELECT * FROM agreed")
oracle("compare_components", POINTS, CLASSED, COMPARISONS, RECORDS, select=f"""
SELECT r.comparison_id, r.record_id, r.held, c.metric_code, c.unit, c.value_num AS value,
  CASE WHEN r.held THEN {cited('value_num').replace('year', 'c.year').replace('metric_code', 'c.metric_code').replace('(unit', '(c.unit').replace('entity', 'c.entity')
                         .replace('CAST(value_num', 'CAST(c.value_num')} END AS citation
FROM records r LEFT JOIN classed c ON r.record_id = c.point_id""")

# De-duplication

oracle("canonical_points", POINTS, CANON, select="""
SELECT count(*) AS n_all, count(*) FILTER (WHERE is_canonical) AS n_canonical,
  count(*) FILTER (WHERE is_canonical IS NULL) AS n_unmatched
FROM points LEFT JOIN canon USING (source_file)""")
oracle("doc_fingerprint", POINTS, select="""
SELECT source_file, count(*) AS n_points FROM points WHERE source_file <> '' GROUP BY 1""")
oracle("doc_canonical", POINTS, CANON, select="SELECT * FROM canon")
oracle("doc_canonical_updated", POINTS, CANON, select="SELECT * FROM canon")
oracle("dedup_report", POINTS, CANON, select="""
SELECT count(*) AS docs, count(*) FILTER (WHERE is_canonical) AS canonical_docs,
  count(*) FILTER (WHERE NOT is_canonical) AS duplicate_docs, CAST(sum(n_points) AS BIGINT) AS points,
  CAST(sum(n_points) FILTER (WHERE is_canonical) AS BIGINT) AS canonical_points,
  CAST(sum(n_points) FILTER (WHERE NOT is_canonical) AS BIGINT) AS copied_points
FROM canon""")
oracle("dedup_reduction", POINTS, CANON, """totals AS (
  SELECT count(*) AS docs, count(*) FILTER (WHERE is_canonical) AS canonical_docs,
    count(*) FILTER (WHERE NOT is_canonical) AS duplicate_docs, CAST(sum(n_points) AS BIGINT) AS points,
    CAST(sum(n_points) FILTER (WHERE is_canonical) AS BIGINT) AS canonical_points,
    CAST(sum(n_points) FILTER (WHERE NOT is_canonical) AS BIGINT) AS copied_points
  FROM canon)""", select="""
SELECT *, CAST(round(CAST(copied_points * 100 AS DECIMAL(18,1)) / points, 1) AS DOUBLE) AS copied_pct,
  CAST(round(CAST(points AS DECIMAL(18,1)) / canonical_points, 1) AS DOUBLE) AS reduction
FROM totals""")
oracle("most_copied", POINTS, CANON, select="""
SELECT canonical_source_file, copies, n_points FROM canon WHERE is_canonical AND copies > 1
ORDER BY copies DESC, n_points DESC, canonical_source_file LIMIT 10""")
oracle("text_dedup", "docs AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN '' ELSE text END AS content, CASE WHEN doc_id % 19 = 0 THEN '' "
       "ELSE '/Shared/' || source || '/' || lang || '/doc_' || doc_id || '.txt' END AS source_file FROM documents)", f"""winners AS (
  SELECT content, count(*) AS copies, arg_min(doc_id, {{'a': {MARKS}, 'b': len(string_split(source_file, '/')),
    'c': length(source_file), 'd': source_file, 'e': doc_id}}) AS canonical_doc_id
  FROM docs GROUP BY 1)""", select="""
SELECT doc_id, canonical_doc_id, doc_id = canonical_doc_id AS is_canonical, copies FROM docs JOIN winners USING (content)""")

# Repetition

SCOPE_LIST = "asked(metric, scope_entity) AS (VALUES " + ", ".join(f"({lit(m)}, {lit(e)})" for m, e in SCOPES) + ")"
SCOPED = """scoped AS (
  SELECT metric, scope_entity, p.*, {'y': year, 'v': value_num, 'u': unit} AS figure FROM asked LEFT JOIN points p
  ON metric_code = metric AND (entity ILIKE '%' || scope_entity || '%' OR p.entity_id ILIKE '%' || scope_entity || '%'))"""
FIGURE = "CASE WHEN point_id IS NOT NULL THEN figure END"
oracle("repetition_scope", POINTS, SCOPE_LIST, SCOPED, select=f"""
SELECT metric, scope_entity AS entity, count(point_id) AS n_rows, count(DISTINCT {FIGURE}) AS n_distinct,
  count(DISTINCT source_file) AS n_files,
  count(DISTINCT array_to_string(string_split(source_file, '/')[1:5], '/')) AS n_folders
FROM scoped GROUP BY ALL""")
oracle("repetition_ratio", POINTS, SCOPE_LIST, SCOPED, f"""counted AS (
  SELECT metric, scope_entity, count(point_id) AS n_rows, count(DISTINCT {FIGURE}) AS n_distinct FROM scoped GROUP BY ALL)""", select=f"""
SELECT metric, scope_entity AS entity, CASE WHEN n_distinct = 0 THEN 0.0::DOUBLE ELSE round(n_rows::DOUBLE / n_distinct, 6) END AS repetition
FROM counted UNION ALL SELECT 'no such metric', '{ENTITY}', 0.0::DOUBLE""")
oracle("repetition_by_doc", POINTS, select=f"""
SELECT source_file, count(*) AS n_rows, count(DISTINCT {{'y': year, 'v': value_num, 'u': unit}}) AS n_distinct
FROM points WHERE metric_code = 'rev_aero' AND {IS_ENTITY} GROUP BY 1 ORDER BY n_rows DESC, source_file LIMIT 10""")
oracle("repetition_after", POINTS, CANON, SCOPE_LIST, SCOPED, select=f"""
SELECT metric, scope_entity AS entity, count(point_id) AS n_rows,
  count(point_id) FILTER (WHERE coalesce(is_canonical, true)) AS canon_rows, count(DISTINCT {FIGURE}) AS n_distinct,
  count(DISTINCT {FIGURE}) FILTER (WHERE coalesce(is_canonical, true)) AS canon_distinct
FROM scoped LEFT JOIN canon USING (source_file) GROUP BY ALL""")
oracle("restated_figures", POINTS, CANON, select=f"""
SELECT year, CAST(value_num AS DECIMAL(18,7)) AS value, coalesce(nullif(unit, ''), '(blank)') AS unit, count(*) AS points,
  count(DISTINCT source_file) AS documents
FROM points WHERE metric_code = 'rev_aero' AND {IS_ENTITY} AND {CANONICAL_ONLY}
GROUP BY year, value_num, 3 ORDER BY documents DESC, points DESC, year, value_num, 3 LIMIT 10""")


def spread(column: str = "value_num") -> str:
    return f"round(min({column}), 4) AS v_min, round(median({column}), 4) AS v_median, round(max({column}), 4) AS v_max"


oracle("value_spread", POINTS, select=f"""
SELECT coalesce(nullif(unit, ''), '(blank)') AS unit, count(*) AS n, min(value_num) AS v_min,
  round(median(value_num), 4) AS v_median, max(value_num) AS v_max
FROM points WHERE metric_code = 'rev_aero' AND {IS_ENTITY} AND year = {YEAR} GROUP BY 1""")

# Contexts

LABELLED = """labelled AS (
  SELECT *, trim(regexp_replace(string_split(context, '||')[1], '^\\s*\\[[^\\]]*\\]\\s*', '')) AS label,
    regexp_extract(context, '^\\s*\\[([^\\]]*)\\]', 1) AS cue_text, coalesce(nullif(trim(unit), ''), '(blank)') AS unit_name
  FROM points)"""
oracle("value_band", POINTS, LABELLED, select="""
SELECT label, unit_name AS unit, count(*) AS n, round(median(value_num), 4) AS v_median
FROM labelled WHERE value_num > 0 AND value_num < 50 GROUP BY 1, 2 ORDER BY n DESC, label, unit LIMIT 40""")
oracle("context_shape", POINTS, LABELLED, select="""
SELECT count(*) AS n_rows, count(*) FILTER (WHERE coalesce(trim(context), '') = '') AS n_empty,
  count(*) FILTER (WHERE context LIKE '%||%') AS n_separator, count(*) FILTER (WHERE cue_text <> '') AS n_cue
FROM labelled""")
oracle("label_profile", POINTS, LABELLED, select=f"""
SELECT label, cue_text AS cue, unit_name AS unit, count(*) AS n, count(DISTINCT value_num) AS n_distinct,
  count(*) FILTER (WHERE value_num < 0) AS n_negative, {spread()}
FROM labelled GROUP BY 1, 2, 3 ORDER BY n DESC, label, cue, unit LIMIT 400""")
oracle("context_profile", POINTS, LABELLED, select=f"""
SELECT unit_name AS unit, context, count(*) AS n, {spread()}
FROM labelled GROUP BY 1, 2 ORDER BY n DESC, unit, context LIMIT 100""")
oracle("untagged_reclaim", POINTS, LABELLED, select=f"""
SELECT label, unit_name AS unit, count(*) AS n, {spread()}
FROM labelled WHERE coalesce(trim(metric_code), '') = '' AND lower(context) LIKE '%aero%'
GROUP BY 1, 2 ORDER BY n DESC, label, unit LIMIT 40""")

# Tags: distinct inputs are parsed, and each kind of text meets its rules as a table.

PARSED = """inputs AS (
  SELECT DISTINCT context, regexp_extract(location, 'sheet=(.*)!', 1) AS sheet, lower(coalesce(unit, '')) AS unit_l
  FROM points),
split AS (
  SELECT *, trim(regexp_replace(split_part(context, '||', 1), '^\\s*\\[[^\\]]*\\]\\s*', '')) AS label,
    lower(regexp_extract(context, '^\\s*\\[([^\\]]*)\\]', 1)) AS cue, lower(split_part(context, '||', 2)) AS tail
  FROM inputs),
parsed AS (
  SELECT context, sheet, unit_l, cue, tail,
    lower(CASE WHEN sheet <> '' AND ends_with(lower(label), lower(sheet))
      THEN trim(label[1:length(label) - length(sheet)]) ELSE label END) AS row_label
  FROM split)"""
TEXTS = f"""texts AS (
  SELECT *, lower(row_label || ' ' || sheet || ' ' || tail) AS everything,
    trim(regexp_replace(row_label, {lit(R.DENOMINATORS)}, ' ', 'g')) AS subject
  FROM parsed)"""
RULES = [
    values("nouns", "noun, pattern", R.NOUNS),
    values("kinds", "rule_id, kind, target, pattern, low, high", R.KINDS),
    values("families", "family, pattern", R.FAMILIES),
    values("codes", "noun, kind, family, code", R.CODES),
    values("currencies", "currency, pattern", R.CURRENCIES),
    values("scales", "scale, pattern", R.SCALES),
    values("bases", "basis, pattern", R.BASES),
]
TAGS = f"""subject_noun AS (
  SELECT subject, arg_min(noun, ord) AS noun FROM (SELECT DISTINCT subject FROM texts) JOIN nouns
  ON regexp_matches(subject, pattern) GROUP BY 1),
text_noun AS (
  SELECT everything, arg_min(noun, ord) AS noun, count(*) AS hits FROM (SELECT DISTINCT everything FROM texts) JOIN nouns
  ON regexp_matches(everything, pattern) GROUP BY 1),
nouned AS (
  SELECT t.*, coalesce(s.noun, CASE WHEN e.hits = 1 THEN e.noun END, '') AS noun,
    CASE WHEN s.noun IS NOT NULL THEN 'row_label' WHEN e.hits = 1 THEN 'sheet_fallback' ELSE 'none' END AS label_source
  FROM texts t LEFT JOIN subject_noun s USING (subject) LEFT JOIN text_noun e USING (everything)),
rule_hits AS (
  SELECT row_label, unit_l, noun, arg_min({{'rule': rule_id, 'kind': kind, 'low': low, 'high': high}}, ord) AS r
  FROM (SELECT DISTINCT row_label, unit_l, noun FROM nouned) n JOIN kinds
  ON regexp_matches(CASE target WHEN 'label' THEN row_label WHEN 'unit' THEN unit_l ELSE n.noun END, pattern)
  GROUP BY ALL),
family_hits AS (
  SELECT everything, arg_min(family, ord) AS family FROM (SELECT DISTINCT everything FROM texts) JOIN families
  ON regexp_matches(everything, pattern) GROUP BY 1),
kinded AS (
  SELECT n.*, coalesce(h.r.rule, 'R99_none') AS rule_id, coalesce(h.r.kind, 'unclassified') AS kind,
    CAST(h.r.low AS DOUBLE) AS low, CAST(h.r.high AS DOUBLE) AS high, coalesce(f.family, 'other') AS family
  FROM nouned n
  LEFT JOIN rule_hits h ON n.row_label IS NOT DISTINCT FROM h.row_label AND n.unit_l = h.unit_l AND n.noun = h.noun
  LEFT JOIN family_hits f USING (everything)),
code_hits AS (
  SELECT k.noun, k.kind, k.family, arg_min(c.code, c.ord) AS code
  FROM (SELECT DISTINCT noun, kind, family FROM kinded) k
  JOIN codes c ON c.noun = k.noun AND coalesce(c.kind, k.kind) = k.kind AND coalesce(c.family, k.family) = k.family
  WHERE k.kind NOT IN ('growth', 'share', 'index') GROUP BY ALL),
cue_hits AS (
  SELECT cue,
    (SELECT arg_min(currency, ord) FROM currencies WHERE regexp_matches(cue, pattern)) AS currency,
    (SELECT arg_min(scale, ord) FROM scales WHERE regexp_matches(cue, pattern)) AS scale,
    (SELECT arg_min(basis, ord) FROM bases WHERE regexp_matches(cue, pattern)) AS basis
  FROM (SELECT DISTINCT cue FROM texts)),
tags AS (
  SELECT context, sheet, unit_l, row_label, k.noun AS measure_noun, label_source, k.kind AS measure_kind,
    k.family AS metric_family, CASE WHEN label_source <> 'none' THEN h.code END AS metric_code_v2,
    coalesce(q.currency, '') AS currency_v2, CAST(coalesce(q.scale, 1) AS INTEGER) AS scale_mult,
    coalesce(q.basis, '') AS price_basis,
    CAST(nullif(regexp_extract(cue, {lit(R.BASE_YEAR)}, 1), '') AS INTEGER) AS base_year,
    CASE WHEN unit_l = '%' THEN true ELSE contains(cue, '%') END AS unit_is_pct, rule_id,
    CASE WHEN label_source <> 'none' AND list_contains([{', '.join(map(lit, R.NON_NEGATIVE_CODES))}], h.code)
      THEN CASE WHEN low > 0 THEN low ELSE 0.0::DOUBLE END ELSE low END AS band_lo,
    high AS band_hi
  FROM kinded k LEFT JOIN code_hits h ON k.noun = h.noun AND k.kind = h.kind AND k.family = h.family
  LEFT JOIN cue_hits q USING (cue))"""
TAGGED = """tagged AS (
  SELECT p.*, t.* EXCLUDE (context, sheet, unit_l, metric_code_v2), t.metric_code_v2 AS metric_code_v2_raw,
    CASE WHEN t.context IS NULL THEN 'untagged' WHEN value_num < band_lo THEN 'below_band'
      WHEN value_num > band_hi THEN 'above_band' ELSE 'ok' END AS magnitude_check,
    CASE WHEN magnitude_check = 'ok' THEN t.metric_code_v2 END AS metric_code_v2
  FROM points p LEFT JOIN tags t ON p.context = t.context AND regexp_extract(p.location, 'sheet=(.*)!', 1) = t.sheet
    AND lower(coalesce(p.unit, '')) = t.unit_l)"""
TAG_CTES = [POINTS, PARSED, TEXTS, *RULES, TAGS]
TAGGED_CTES = [*TAG_CTES, TAGGED]

oracle("context_parse", POINTS, PARSED, select="SELECT context, sheet, row_label, cue, tail, unit_l FROM parsed")
oracle("context_tag", *TAG_CTES, select="SELECT * FROM tags")
for name in ("points_tagged", "points_tagged_by_lookup"):
    oracle(name, *TAGGED_CTES, select="""
SELECT point_id, metric_code_v2, metric_code_v2_raw, magnitude_check, rule_id FROM tagged""")
oracle("tag_claims", *TAGGED_CTES, select="""
SELECT measure_noun AS noun, measure_kind AS kind, label_source, coalesce(metric_code_v2_raw, '(no money code)') AS code_v2,
  count(*) AS n, round(median(value_num), 4) AS v_median
FROM tagged WHERE magnitude_check <> 'untagged' GROUP BY 1, 2, 3, 4
ORDER BY n DESC, noun, kind, label_source, code_v2 LIMIT 30""")
oracle("tag_migration", *TAGGED_CTES, select="""
SELECT coalesce(nullif(metric_code, ''), '(blank)') AS old_code, coalesce(metric_code_v2_raw, '(none)') AS new_code,
  measure_kind AS kind, count(*) AS n
FROM tagged WHERE magnitude_check <> 'untagged' AND (metric_code = 'rev_aero' OR metric_code_v2_raw LIKE 'rev\\_aero%' ESCAPE '\\')
GROUP BY 1, 2, 3 ORDER BY n DESC, old_code, new_code, kind LIMIT 25""")
oracle("tag_promotions", *TAGGED_CTES, select="""
SELECT metric_code AS old_code, coalesce(metric_code_v2_raw, '(none)') AS new_code, count(*) AS n
FROM tagged WHERE magnitude_check <> 'untagged'
  AND metric_code IN ('ebitda', 'gdp_elasticity', 'opex_total', 'capex', 'pax_total')
GROUP BY 1, 2 ORDER BY n DESC, old_code, new_code LIMIT 15""")
oracle("tag_conflicts", *TAGGED_CTES, select="""
SELECT measure_kind AS kind, count(*) AS n FROM tagged WHERE value_num < band_lo OR value_num > band_hi GROUP BY 1""")
oracle("tag_coverage", *TAGGED_CTES, select="""
SELECT count(*) FILTER (WHERE label_source = 'row_label') AS n_row_label,
  count(*) FILTER (WHERE label_source = 'sheet_fallback') AS n_sheet,
  count(*) FILTER (WHERE label_source = 'none') AS n_none,
  count(*) FILTER (WHERE metric_code_v2_raw IS NOT NULL) AS n_coded, count(*) AS n_total
FROM tagged WHERE magnitude_check <> 'untagged'""")
oracle("code_distribution", *TAG_CTES, select="""
SELECT coalesce(metric_code_v2, '(none)') AS code, count(*) AS n FROM tags GROUP BY 1""")
oracle("gold_by_year", *TAGGED_CTES, select=f"""
SELECT year, count(*) AS n, {spread()} FROM tagged
WHERE metric_code_v2 = 'rev_aero_per_pax' AND label_source = 'row_label' AND year BETWEEN {YEARS[0]} AND {YEARS[1]}
GROUP BY 1""")
oracle("veto_audit", *TAGGED_CTES, select="""
SELECT count(*) AS n_out_of_band, count(metric_code_v2) AS n_still_coded, count(metric_code_v2_raw) AS n_raw_kept,
  CASE WHEN count(metric_code_v2) > 0 THEN 'FAIL: still coded' WHEN count(metric_code_v2_raw) = 0 THEN 'FAIL: raw claim missing'
    ELSE 'PASS' END AS verdict
FROM tagged WHERE magnitude_check <> 'ok'""")
oracle("tag_before_after", *TAGGED_CTES, select=f"""
SELECT 'before' AS which, count(*) AS n, {spread()} FROM tagged WHERE metric_code = 'rev_aero' AND year = {YEAR}
UNION ALL
SELECT 'after', count(*), {spread()} FROM tagged
WHERE metric_code_v2 = 'rev_aero_per_pax' AND label_source = 'row_label' AND year = {YEAR}""")

# Reports on one scope

SCOPE = [POINTS.replace("points AS", "every_point AS"), canonical("every_point"), f"""points AS (
  SELECT * FROM every_point WHERE entity_id = '{ENTITY_CODE}' AND {CANONICAL_ONLY})"""]
SCOPE_TAGGED = [*SCOPE, *TAGGED_CTES[1:]]
CODED = """coded AS (SELECT * FROM labelled WHERE metric_code = 'rev_aero')"""
oracle("scope_shape", *SCOPE, select="""
SELECT count(*) AS n_rows, count(*) FILTER (WHERE metric_code = 'rev_aero') AS n_metric,
  count(*) FILTER (WHERE coalesce(trim(metric_code), '') = '') AS n_blank
FROM points""")
oracle("scope_labels", *SCOPE, LABELLED, CODED, select=f"""
SELECT label, cue_text AS cue, unit_name AS unit, count(*) AS n, count(DISTINCT value_num) AS n_distinct,
  count(*) FILTER (WHERE value_num < 0) AS n_negative, {spread()}
FROM coded GROUP BY 1, 2, 3 ORDER BY n DESC, label, cue, unit LIMIT 100""")
oracle("scope_contexts", *SCOPE, LABELLED, CODED, select=f"""
SELECT unit_name AS unit, context, count(*) AS n, {spread()}
FROM coded GROUP BY 1, 2 ORDER BY n DESC, unit, context LIMIT 100""")
oracle("scope_band", *SCOPE, LABELLED, CODED, select="""
SELECT label, unit_name AS unit, count(*) AS n, round(median(value_num), 4) AS v_median
FROM coded WHERE value_num > 0 AND value_num < 50 GROUP BY 1, 2 ORDER BY n DESC, label, unit LIMIT 40""")
for ours, theirs in {"scope_untagged": "untagged_reclaim", "scope_claims": "tag_claims", "scope_gold": "gold_by_year", "scope_veto": "veto_audit",
                     "scope_before_after": "tag_before_after"}.items():
    ORACLES[ours] = ORACLES[theirs].replace(POINTS, ",\n".join(SCOPE), 1)
oracle("scope_money", *SCOPE_TAGGED, select="""
SELECT nullif(currency_v2, '') AS currency, nullif(price_basis, '') AS price_basis, count(*) AS n FROM tagged GROUP BY 1, 2""")
oracle("scope_run", POINTS, LABELLED, CODED, """grouped AS (
  SELECT label, cue_text, unit_name, count(*) AS n FROM coded GROUP BY 1, 2, 3 ORDER BY n DESC, label, cue_text, unit_name LIMIT 100)""",
  select="""
SELECT nullif(label, '') AS label, nullif(cue_text, '') AS cue, unit_name AS unit, n, (SELECT count(*) FROM points) AS n_points
FROM grouped""")

SHEETED = "regexp_extract(location, 'sheet=(.*)!', 1)"
CONTEXTS = f"count(DISTINCT {{'c': context, 's': {SHEETED}, 'u': lower(coalesce(unit, ''))}})"
PLAIN = f"(SELECT count(*) FROM every_point WHERE context IS NOT NULL AND {SHEETED} IS NOT NULL"
# One that holds the entity's contexts tags them for all points.
OWN = f"""own AS (SELECT DISTINCT context, {SHEETED} AS sheet, lower(coalesce(unit, '')) AS u FROM every_point WHERE entity_id = '{ENTITY_CODE}')"""
oracle("tag_run", *SCOPE, OWN, select=f"""
SELECT 'dry' AS run, false AS built, count(*) AS n_points, {CONTEXTS} AS n_contexts, 9 AS n_reports, CAST(NULL AS BIGINT) AS n_tagged FROM points
UNION ALL SELECT 'entity', true, count(*), {CONTEXTS}, 9,
  {PLAIN} AND (context, {SHEETED}, lower(coalesce(unit, ''))) IN (SELECT (context, sheet, u) FROM own)) FROM every_point WHERE entity_id = '{ENTITY_CODE}'
UNION ALL SELECT 'store', true, count(*), {CONTEXTS}, 0, {PLAIN}) FROM every_point""")

# Audit

oracle("audit_redact", select="""
SELECT event_id, '{"k":' || (props ->> '$.k') || ',"Api_Key":"[redacted]","client":{"kind":"basic","token":"[redacted]"},'
  || '"calls":[{"name":"' || event_type || '","password":"[redacted]"}],"auth":"[redacted]"}' AS props_redacted
FROM events""")
oracle("audit_stream", select="""
SELECT CAST(ts AS DATE) AS day, 2 * count(*) AS n, CAST(0 AS BIGINT) AS n_leaked, true AS few_files FROM events GROUP BY 1""")
oracle("audit_log", select="SELECT CAST(ts AS DATE) AS day, count(*) AS n, CAST(0 AS BIGINT) AS n_leaked FROM events GROUP BY 1")
