"""Inputs of the registered queries, all derived from whole given tables.

``POINT_BASE`` is plain SQL that Spark and DuckDB both run. Copies of documents are added to it on each
side on its own: in Spark by unfolding rows, so the tables are read once; in the oracle by a union.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figtrace.operators.dedup import canonical_map
from figtrace.sources.concepts import BoundPoints, bind
from figtrace.sources.tables import with_data_class

SEALED = "/Shared/Company/Sealed Folder"
PROJECT_FOLDER = "/Shared/Archive/2024/Old Project Files/"

POINT_BASE = r"""
SELECT point_id, project_id, value_num, unit, currency, value_scale, basis, metric_code, scenario, entity, entity_id,
  year, temporality, review_status, source_type_flag,
  CASE d WHEN 199 THEN '/Shared/Company/Sealed Folder/Model_199.xlsx'
         WHEN 198 THEN '/Shared/Company/Sealed Folder Two/Model_198.xlsx'
         WHEN 197 THEN replace('/Shared/Company/Sealed Folder/Model_197.xlsx', '/', chr(92))
         WHEN 196 THEN ''
         ELSE concat('/Shared/Archive/', CAST(2005 + d % 18 AS STRING), '/Client ', CAST(d % 23 AS STRING), '/Model_',
                     CAST(d AS STRING), '.xlsx') END AS source_file,
  concat('sheet=', sheet, '!C', CAST(o_orderkey AS STRING)) AS location,
  CASE WHEN o_orderkey % 37 = 0 THEN NULL
       ELSE concat(cue_text, label_text, ' ', sheet, ' || header for ', entity_id) END AS context,
  d
FROM (
  SELECT o_orderkey, o_orderkey % 200 AS d,
    concat('p', CAST(o_orderkey AS STRING)) AS point_id,
    CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE concat('PJ_', CAST(o_custkey % 40 AS STRING)) END AS project_id,
    CASE WHEN o_orderkey % 29 = 0 THEN CAST(NULL AS DOUBLE) WHEN o_orderkey % 17 = 0 THEN -o_totalprice
         WHEN o_orderkey % 3 = 0 THEN o_totalprice / 100000.0 ELSE o_totalprice END AS value_num,
    CASE o_orderkey % 5 WHEN 0 THEN 'GBP' WHEN 1 THEN 'EUR' WHEN 2 THEN 'per pax' WHEN 3 THEN '%' ELSE '' END AS unit,
    CASE o_orderkey % 4 WHEN 0 THEN 'GBP' WHEN 1 THEN 'EUR' WHEN 2 THEN 'USD' ELSE '' END AS currency,
    CASE WHEN o_orderkey % 9 = 0 THEN 'thousand' ELSE 'unit' END AS value_scale,
    CASE WHEN o_orderkey % 11 = 0 THEN 'real' ELSE 'nominal' END AS basis,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'rev_aero' WHEN '2-HIGH' THEN 'rev_nonaero'
         WHEN '3-MEDIUM' THEN 'pax_total' WHEN '5-LOW' THEN 'opex_total' ELSE '' END AS metric_code,
    CASE o_orderkey % 6 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'base' END AS scenario,
    n_name AS entity, concat('N', CAST(n_nationkey AS STRING)) AS entity_id,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(year(o_orderdate) AS INT) END AS year,
    CASE o_orderstatus WHEN 'F' THEN 'actual' WHEN 'O' THEN 'forecast' ELSE '' END AS temporality,
    CASE o_orderkey % 5 WHEN 0 THEN 'accepted' WHEN 1 THEN 'queued' ELSE 'auto' END AS review_status,
    CASE o_orderkey % 8 WHEN 0 THEN '' WHEN 1 THEN 'third_party' ELSE 'own' END AS source_type_flag,
    CASE (o_orderkey % 200) % 6 WHEN 0 THEN 'Footfall' WHEN 1 THEN 'Ticket Income' WHEN 2 THEN 'Retail Schedule'
         WHEN 3 THEN 'Profit Bridge' WHEN 4 THEN 'Aero Prices' ELSE '' END AS sheet,
    CASE o_orderkey % 7 WHEN 0 THEN '[$ bn] ' WHEN 1 THEN '[€ thousand, Nominal] ' WHEN 2 THEN '[Real 2015] '
         WHEN 3 THEN '[%] ' WHEN 4 THEN '[£ m, 2011 Prices] ' WHEN 5 THEN '[thousand] ' ELSE '' END AS cue_text,
    CASE o_orderkey % 16 WHEN 0 THEN 'Average fare' WHEN 1 THEN 'Seats' WHEN 2 THEN 'Operating profit'
         WHEN 3 THEN 'Gross takings' WHEN 4 THEN 'Inflation' WHEN 5 THEN 'Charter' WHEN 6 THEN 'Payroll'
         WHEN 7 THEN 'Aero turnover per passenger' WHEN 8 THEN 'Net' WHEN 9 THEN 'Change in mix'
         WHEN 10 THEN 'Capital cost' WHEN 11 THEN 'Passenger fee' WHEN 12 THEN 'Duty free receipts'
         WHEN 13 THEN 'Share of group' WHEN 14 THEN 'Elasticity' ELSE 'west 2003-h1' END AS label_text
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) AS keyed
"""

# One nation, by name and by code, stands for the entity a question is about; scopes are metric and entity.
LOOKED_UP = ["p1", "p7", "p32", "p196", "p199", "xp4", "xp100", "yp10", "yp1000", "p598", "p1409", "nobody", "p0", *[f"p{n}" for n in range(960, 1000)]]
ENTITY, ENTITY_CODE, OTHER_ENTITY = "NATION_7", "N7", "NATION_3"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def points(spark: SparkSession, sf: str) -> DataFrame:
    """The points table: every order is a figure; some documents exist in two or three copies."""
    names = {t: table(spark, sf, t) for t in ("orders", "customer", "nation")}
    base = spark.sql(
        POINT_BASE.replace("FROM orders JOIN customer", "FROM {orders} JOIN {customer}").replace("JOIN nation", "JOIN {nation}"),
        **names,
    )
    d, path = F.col("d"), F.col("source_file")
    # '-' keeps the original, x and y are copies under another path.
    copies = F.concat_ws(
        ",", F.lit("-"), F.when((d % 4 == 0) & (d < 196), "x"), F.when((d % 10 == 0) & (d < 196), "y")
    )
    unfolded = base.withColumn("_copy", F.explode(F.split(copies, ",")))
    moved = (
        F.when(F.col("_copy") == "x", F.replace(path, F.lit("/Shared/Archive/"), F.lit(PROJECT_FOLDER)))
        .when(F.col("_copy") == "y", F.replace(path, F.lit(".xlsx"), F.lit(" - Copy.xlsx")))
        .otherwise(path)
    )
    named = F.concat(F.when(F.col("_copy") == "-", "").otherwise(F.col("_copy")), F.col("point_id"))
    return unfolded.withColumns({"source_file": moved, "point_id": named}).drop("d", "_copy")


def canonical(spark: SparkSession, sf: str) -> DataFrame:
    return canonical_map(points(spark, sf))


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a harvested file, some skipped, some failed."""
    status = F.when(F.col("doc_id") % 7 == 0, "skipped").when(F.col("doc_id") % 7 == 1, "failed").otherwise("done")
    return table(spark, sf, "documents").select(document_path().alias("path"), status.alias("status"))


def document_path():
    return F.concat(
        F.lit("/Shared/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")
    )


def scopes(spark: SparkSession, sf: str) -> DataFrame:
    """Every folder of the documents."""
    docs = table(spark, sf, "documents")
    top = F.concat(F.lit("/Shared/"), F.col("source"))
    both = F.explode(F.array(top, F.concat(top, F.lit("/"), F.col("lang"))))
    return docs.select(both.alias("scope")).distinct()


def points_in_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The points, each archived one re-homed into one of the documents' folders, so that a source has
    a folder the manifest knows."""
    n = F.regexp_extract("location", r"([0-9]+)\z", 1).cast("bigint")
    folder = F.concat(
        F.lit("/Shared/src"), (n % 20).cast("string"), F.lit("/"),
        F.element_at(F.array(F.lit("en"), F.lit("fr"), F.lit("de"), F.lit("es")), (n % 4 + 1).cast("int")),
    )
    archived = F.col("source_file").startswith("/Shared/Archive/")
    file = F.element_at(F.split(F.col("source_file"), "/"), -1)
    return points(spark, sf).withColumn(
        "source_file", F.when(archived, F.concat(folder, F.lit("/"), file)).otherwise(F.col("source_file"))
    )


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """A record id for every event; error events ask for ids nobody holds."""
    letter = F.when(F.col("event_type") == "error", "u").otherwise("p")
    return table(spark, sf, "events").select(F.concat(letter, F.col("event_id").cast("string")).alias("record_id"))


def comparisons(spark: SparkSession, sf: str) -> DataFrame:
    """Three sorts: all points of one definition and entity; whatever the lines of one part mention;
    and a held record next to an unknown one."""
    p = points(spark, sf)
    definition = ["metric_code", "unit", "currency", "value_scale", "basis", "entity_id"]
    same = p.select(F.concat_ws("|", F.lit("a"), *definition).alias("comparison_id"), F.col("point_id").alias("record_id"))
    lines = table(spark, sf, "lineitem").select(
        F.concat(F.lit("b"), F.col("l_partkey").cast("string")).alias("comparison_id"),
        F.concat(F.lit("p"), F.col("l_orderkey").cast("string")).alias("record_id"),
    )
    event = F.col("event_id").cast("string")
    lone = table(spark, sf, "events").select(
        F.concat(F.lit("c"), event).alias("comparison_id"),
        F.explode(F.array(F.concat(F.lit("p"), event), F.concat(F.lit("u"), event))).alias("record_id"),
    )
    return same.unionByName(lines).unionByName(lone)


def bound(spark: SparkSession, sf: str, frame: DataFrame | None = None, *, with_canonical: bool = True) -> BoundPoints:
    """The points bound for questions, with data class, canonical map, manifest and sealed folder."""
    return bind(
        with_data_class(points(spark, sf) if frame is None else frame),
        table="points",
        store="derived",
        canonical=canonical(spark, sf) if with_canonical else None,
        manifest=manifest(spark, sf),
        manifest_name="harvest_manifest",
        sealed=[SEALED],
    )
