"""The registered queries. Each runs over whole tables; inputs are in ``checks.inputs``."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import inputs as I
from figtrace.functions.redact import redact
from figtrace.operators import builds as B
from figtrace.operators import compare as C
from figtrace.operators import dedup as D
from figtrace.operators import evidence as E
from figtrace.operators import profile as P
from figtrace.operators import repetition as RP
from figtrace.operators import scope_run as SR
from figtrace.operators import search as S
from figtrace.operators import tag_reports as TR
from figtrace.operators import tagging as T
from figtrace.operators.filters import EvidenceFilter, apply_filter, unmapped_points
from figtrace.session import staging_path
from figtrace.sources.concepts import bind, bind_store
from figtrace.sources.keyed import write_keyed
from figtrace.sources.tables import create_table_view, read_points, read_table, read_tsv, replace_table, with_data_class
from figtrace.streaming.audit import AuditContext, append_audit, compact_audit, read_audit, stream_audit

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SCOPES = [
    ("rev_aero", I.ENTITY), ("pax_total", I.ENTITY), ("rev_nonaero", I.ENTITY), ("opex_total", I.ENTITY),
    ("rev_aero", I.OTHER_ENTITY),
]
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)
YEARS = (1995, 2001)
YEAR = 1998
EXACT = "decimal(18,7)"  # values have at most seven decimals
DECIMALS = 4
SEARCH = EvidenceFilter(metric="aero", entity=I.ENTITY, year_from=1996, year_to=1999)


def side_by_side(*counts: DataFrame) -> DataFrame:
    """One-row counts of several frames as one row."""
    both = counts[0]
    for c in counts[1:]:
        both = both.unionByName(c, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# Sources and binding


@query
def scan_points(spark: SparkSession, sf: str) -> DataFrame:
    path = staging_path(spark, "points")
    replace_table(I.points(spark, sf), path, ["entity_id"])
    held = read_points(spark, path)
    return held.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query
def replaced_table(spark: SparkSession, sf: str) -> DataFrame:
    """A table replaced once, then by a write that fails half-way: the table and a view over it have the second rows."""
    path, p = staging_path(spark, "replaced"), I.points(spark, sf)
    replace_table(p.select("entity_id", "year").limit(0), path, ["entity_id"])
    replace_table(p.select("entity_id", "year"), path, ["entity_id"])
    broken = F.when(F.col("year") == YEAR, F.raise_error(F.lit("this row cannot be written"))).otherwise(F.col("year"))
    try:
        replace_table(p.select("entity_id", broken.cast("int").alias("year")), path, ["entity_id"])
    except PySparkException:
        pass
    create_table_view(spark, path, "replaced_points")
    n = F.count(F.lit(1))
    held = read_table(spark, path).groupBy("entity_id").agg(n.alias("n_rows"))
    seen = spark.sql("SELECT entity_id AS _e, count(year) AS n_years FROM replaced_points GROUP BY 1")
    return held.join(seen, F.col("entity_id") == F.col("_e")).drop("_e")


@query
def bind_columns(spark: SparkSession, sf: str) -> DataFrame:
    p = I.points(spark, sf).select(
        "context", F.col("unit").alias("UOM"), F.col("year").alias("Period_Year"), F.col("point_id").alias("Id"),
        F.col("entity_id").alias("IATA_Code"), F.col("value_num").alias("Amount"), F.col("metric_code").alias("Metric"),
        F.col("source_file").alias("File_Path"), "location", "scenario",
    )
    other = I.table(spark, sf, "nation")
    bound = bind_store({"nation": other, "core_points": p}, store="renamed")
    return bound.frame.select(
        "record_id", F.col("value").cast(EXACT).alias("value"), "year", "metric_code", "entity", "entity_id", "unit",
        "source", "cell", "qualifiers", "extract_text",
    )


@query
def data_class_view(spark: SparkSession, sf: str) -> DataFrame:
    classed = with_data_class(I.points(spark, sf))
    return classed.groupBy("data_class").agg(F.count(F.lit(1)).alias("n"))


# Completeness


@query
def fill_rate(spark: SparkSession, sf: str) -> DataFrame:
    return P.fill_rate(I.bound(spark, sf, with_canonical=False))


@query
def fill_pct(spark: SparkSession, sf: str) -> DataFrame:
    return P.with_fill_pct(P.fill_rate(I.bound(spark, sf, with_canonical=False))).withColumn("pct", F.round("pct", 6))


@query
def table_profile(spark: SparkSession, sf: str) -> DataFrame:
    return P.store_profile({t: I.table(spark, sf, t) for t in TABLES})


@query
def points_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Which tables hold figures at all, and how many rows each has."""
    tables = {t: I.table(spark, sf, t) for t in TABLES} | {"points": I.points(spark, sf)}
    n = F.count(F.lit(1)).alias("n_rows")
    parts = [df.agg(n).select(F.lit(t).alias("table_name"), F.lit(P.looks_like_points(df)).alias("holds_points"), "n_rows") for t, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


@query
def contract_check(spark: SparkSession, sf: str) -> DataFrame:
    return P.contract_check(I.points(spark, sf))


@query
def flag_freq(spark: SparkSession, sf: str) -> DataFrame:
    return P.flag_freq(I.points(spark, sf))


# Search and summary


@query
def search_points(spark: SparkSession, sf: str) -> DataFrame:
    return S.search(I.bound(spark, sf), SEARCH).records


@query
def search_class_status(spark: SparkSession, sf: str) -> DataFrame:
    found, _ = apply_filter(I.bound(spark, sf), EvidenceFilter(data_class="fact", status="accepted"))
    return found.select("record_id")


@query
def search_geography(spark: SparkSession, sf: str) -> DataFrame:
    found, _ = apply_filter(I.bound(spark, sf), EvidenceFilter(geography=I.OTHER_ENTITY))
    return found.select("record_id")


@query
def search_require_code(spark: SparkSession, sf: str) -> DataFrame:
    bound, n = I.bound(spark, sf), F.count(F.lit(1))
    found, _ = apply_filter(bound, EvidenceFilter(entity=I.ENTITY))
    coded, _ = apply_filter(bound, EvidenceFilter(entity=I.ENTITY, require_metric_code=True))
    return side_by_side(found.agg(n.alias("n_all")), coded.agg(n.alias("n_with_code")))


@query
def search_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    bound = I.bound(spark, sf, with_canonical=False)
    kept, _ = apply_filter(bound, EvidenceFilter(canonical_only=False))
    n = F.count(F.lit(1))
    counts = side_by_side(bound.frame.agg(n.alias("n_all")), kept.agg(n.alias("n_kept")))
    return counts.withColumn("n_sealed", F.col("n_all") - F.col("n_kept"))


@query
def search_absent_filter(spark: SparkSession, sf: str) -> DataFrame:
    thin = I.points(spark, sf).select(
        "point_id", "value_num", "year", "metric_code", "entity_id", "unit", "source_file"
    )
    found, echo = apply_filter(
        bind(thin), EvidenceFilter(metric="rev_aero", data_class="fact", status="accepted")
    )
    return found.select("record_id", F.lit(",".join(echo.not_applicable)).alias("not_applied"))


@query
def summarise(spark: SparkSession, sf: str) -> DataFrame:
    return S.summarise(I.bound(spark, sf), EvidenceFilter(entity=I.ENTITY))[0]


@query
def summarise_untagged(spark: SparkSession, sf: str) -> DataFrame:
    return S.untagged_share(I.bound(spark, sf), EvidenceFilter(year_from=1996))[0]


@query
def page_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Of a page that is cut off, one that is whole, one with nothing on it, and one whose filter cannot be applied."""
    bound = I.bound(spark, sf)
    thin = bind(I.points(spark, sf).select("point_id", "value_num", "year", "metric_code", "entity_id", "unit", "source_file"))
    asked = {
        "cut": (bound, SEARCH), "whole": (bound, replace(SEARCH, year_from=1998, year_to=1998, status="queued", data_class="fact")),
        "nothing": (bound, EvidenceFilter(metric="no such metric")), "ignored": (thin, EvidenceFilter(metric="aero", status="accepted")),
    }
    notes = [S.page_notes(S.search(b, f, limit=25)).withColumn("page", F.lit(name)) for name, (b, f) in asked.items()]
    return reduce(DataFrame.unionByName, notes)


@query
def summary_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Of a scope with untagged points, of one without, and of a question without a filter, which is refused."""
    bound = I.bound(spark, sf)
    asked = {"some": EvidenceFilter(entity=I.ENTITY), "coded": EvidenceFilter(entity=I.ENTITY, require_metric_code=True), "none": EvidenceFilter()}
    notes = [S.summary_notes(bound, f).withColumn("scope", F.lit(name)) for name, f in asked.items()]
    return reduce(DataFrame.unionByName, notes)


# Sources of figures


def _told(answers: DataFrame) -> DataFrame:
    """Counts by status as a text, most frequent first."""
    said = F.transform("by_status", lambda s: F.concat(s["status"], F.lit(" "), s["n"].cast("string")))
    return answers.withColumn("by_status", F.array_join(said, ", "))


@query
def get_source(spark: SparkSession, sf: str) -> DataFrame:
    bound = I.bound(spark, sf, with_data_class(I.points_in_documents(spark, sf)), with_canonical=False)
    return _told(E.get_source(bound, I.requests(spark, sf)))


@query
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """A few ids from a store that is sorted by id, and from the written scope tree."""
    keyed = write_keyed(with_data_class(I.points_in_documents(spark, sf)), staging_path(spark, "keyed"), "point_id")
    return _told(E.get_sources(E.with_scope_tree(I.bound(spark, sf, keyed, with_canonical=False)), I.LOOKED_UP))


@query
def citation(spark: SparkSession, sf: str) -> DataFrame:
    return E.cite(I.bound(spark, sf, with_canonical=False))


@query
def skip_disclosure(spark: SparkSession, sf: str) -> DataFrame:
    return _told(E.skip_disclosure(I.bound(spark, sf, with_canonical=False), I.scopes(spark, sf)))


@query
def skip_absent(spark: SparkSession, sf: str) -> DataFrame:
    """Without a manifest nothing is known of any scope, and that is not zero."""
    bound = replace(I.bound(spark, sf, with_canonical=False), manifest=None)
    return _told(E.skip_disclosure(bound, I.scopes(spark, sf)))


@query
def skip_by_status(spark: SparkSession, sf: str) -> DataFrame:
    return E.skip_by_status(I.bound(spark, sf, with_canonical=False), I.scopes(spark, sf))


@query
def compare_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return C.compare_evidence(I.bound(spark, sf, with_canonical=False), I.comparisons(spark, sf))


@query
def compare_flags(spark: SparkSession, sf: str) -> DataFrame:
    return C.compare_flags(I.bound(spark, sf, with_canonical=False), I.comparisons(spark, sf))


@query
def compare_aligned(spark: SparkSession, sf: str) -> DataFrame:
    return C.aligned_on(I.bound(spark, sf, with_canonical=False), I.comparisons(spark, sf))


@query
def compare_components(spark: SparkSession, sf: str) -> DataFrame:
    found = C.components(I.bound(spark, sf, with_canonical=False), I.comparisons(spark, sf))
    return found.select("comparison_id", "record_id", "held", "metric_code", "unit", "value", "citation")


# De-duplication


@query
def canonical_points(spark: SparkSession, sf: str) -> DataFrame:
    return unmapped_points(I.bound(spark, sf))


@query
def doc_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return D.fingerprint(I.points(spark, sf)).select("source_file", "n_points")


@query
def doc_canonical(spark: SparkSession, sf: str) -> DataFrame:
    return I.canonical(spark, sf)


@query
def doc_canonical_updated(spark: SparkSession, sf: str) -> DataFrame:
    """Built from the points of every other order, with some that are then removed, and the rest added."""
    folder, p = staging_path(spark, "documents"), I.points(spark, sf)
    order = F.regexp_extract("location", r"([0-9]+)\z", 1).cast("bigint")
    twice = p.where(order % 14 == 0).withColumn("location", F.lit("gone"))
    B.build_document_tables(p.where(order % 2 == 0).unionByName(twice), folder)
    return B.update_document_tables(folder, added=p.where(order % 2 == 1), removed=twice)[1]


@query
def dedup_report(spark: SparkSession, sf: str) -> DataFrame:
    return D.dedup_report(I.canonical(spark, sf))


@query
def dedup_reduction(spark: SparkSession, sf: str) -> DataFrame:
    return D.with_reduction(D.dedup_report(I.canonical(spark, sf)))


@query
def most_copied(spark: SparkSession, sf: str) -> DataFrame:
    return D.most_copied(I.canonical(spark, sf))


@query
def text_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Some texts and paths are missing."""
    docs, n = I.table(spark, sf, "documents"), F.col("doc_id")
    return D.text_dedup(docs.select(n, F.when(n % 17 != 0, F.col("text")).alias("text"), F.when(n % 19 != 0, I.document_path()).alias("path")))


# Repetition


@query
def repetition_scope(spark: SparkSession, sf: str) -> DataFrame:
    return RP.repetition_scope(I.points(spark, sf), SCOPES)


@query
def repetition_ratio(spark: SparkSession, sf: str) -> DataFrame:
    ratios = RP.with_ratio(RP.repetition_scope(I.points(spark, sf), [*SCOPES, ("no such metric", I.ENTITY)]))
    return ratios.select("metric", "entity", F.round("repetition", 6).alias("repetition"))


@query
def repetition_by_doc(spark: SparkSession, sf: str) -> DataFrame:
    return RP.repetition_by_doc(I.points(spark, sf), "rev_aero", I.ENTITY)


@query
def repetition_after(spark: SparkSession, sf: str) -> DataFrame:
    return RP.repetition_after(I.points(spark, sf), I.canonical(spark, sf), SCOPES)


@query
def restated_figures(spark: SparkSession, sf: str) -> DataFrame:
    figures = RP.restated_figures(I.points(spark, sf), I.canonical(spark, sf), "rev_aero", I.ENTITY)
    return figures.withColumn("value", F.col("value").cast(EXACT))


@query
def value_spread(spark: SparkSession, sf: str) -> DataFrame:
    return P.value_spread(I.points(spark, sf), "rev_aero", I.ENTITY, YEAR, decimals=DECIMALS)


# Contexts


@query
def value_band(spark: SparkSession, sf: str) -> DataFrame:
    return P.value_band(I.points(spark, sf), decimals=DECIMALS)


@query
def context_shape(spark: SparkSession, sf: str) -> DataFrame:
    return P.context_shape(I.points(spark, sf))


@query
def label_profile(spark: SparkSession, sf: str) -> DataFrame:
    return P.label_profile(I.points(spark, sf), decimals=DECIMALS)


@query
def context_profile(spark: SparkSession, sf: str) -> DataFrame:
    return P.context_profile(I.points(spark, sf), top=100, decimals=DECIMALS)


@query
def untagged_reclaim(spark: SparkSession, sf: str) -> DataFrame:
    return P.untagged_reclaim(I.points(spark, sf), decimals=DECIMALS)


@query
def context_parse(spark: SparkSession, sf: str) -> DataFrame:
    return T.contexts(I.points(spark, sf))


@query
def context_tag(spark: SparkSession, sf: str) -> DataFrame:
    return T.context_tags(I.points(spark, sf))


# Tagged points


def _tagged(spark: SparkSession, sf: str, *tags: str) -> DataFrame:
    """The tagged points, with only the tags that the question is about."""
    return T.tag_repeated_points(I.points(spark, sf), tags=tags)


@query
def points_tagged(spark: SparkSession, sf: str) -> DataFrame:
    return _tagged(spark, sf, "metric_code_v2", "metric_code_v2_raw", "magnitude_check", "rule_id").select("point_id", "metric_code_v2", "metric_code_v2_raw", "magnitude_check", "rule_id")


@query
def points_tagged_by_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Over points and tags in the same buckets: no point is shuffled by the join."""
    name, path = f"points_{uuid.uuid4().hex}", staging_path(spark, "bucketed")
    held = T.bucket_points(I.points(spark, sf), name, path, buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    tagged = T.tag_bucketed_points(held, T.context_tags(held.frame()), f"tags_{name}")
    return tagged.select("point_id", "metric_code_v2", "metric_code_v2_raw", "magnitude_check", "rule_id")


@query
def tag_claims(spark: SparkSession, sf: str) -> DataFrame:
    return TR.tag_claims(_tagged(spark, sf, "measure_noun", "measure_kind", "label_source", "metric_code_v2_raw", "magnitude_check"), decimals=DECIMALS)


@query
def tag_migration(spark: SparkSession, sf: str) -> DataFrame:
    return TR.tag_migration(_tagged(spark, sf, "metric_code_v2_raw", "measure_kind", "magnitude_check"))


@query
def tag_promotions(spark: SparkSession, sf: str) -> DataFrame:
    return TR.tag_promotions(_tagged(spark, sf, "metric_code_v2_raw", "magnitude_check"))


@query
def tag_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return TR.tag_conflicts(_tagged(spark, sf, "measure_kind", "magnitude_check"))


@query
def tag_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return TR.tag_coverage(_tagged(spark, sf, "label_source", "metric_code_v2_raw"))


@query
def code_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return TR.code_distribution(T.context_tags(I.points(spark, sf), tags=["metric_code_v2"]))


@query
def gold_by_year(spark: SparkSession, sf: str) -> DataFrame:
    return TR.gold_by_year(_tagged(spark, sf, "metric_code_v2", "label_source"), years=YEARS, decimals=DECIMALS)


@query
def veto_audit(spark: SparkSession, sf: str) -> DataFrame:
    return TR.veto_audit(_tagged(spark, sf, "metric_code_v2", "metric_code_v2_raw", "magnitude_check"))


@query
def tag_before_after(spark: SparkSession, sf: str) -> DataFrame:
    return TR.tag_before_after(_tagged(spark, sf, "metric_code_v2", "label_source"), YEAR, decimals=DECIMALS)


# Reports on one scope: an entity's points in canonical documents, staged once


WANTED = SR.Wanted(years=YEARS, year=YEAR, top=100, decimals=DECIMALS, rate_decimals=DECIMALS)


def scope_query(name: str, report: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        scope = SR.stage_scope(I.points(spark, sf), entity=I.ENTITY_CODE, canonical=I.canonical(spark, sf))
        return (SR.context_reports(scope, WANTED) | SR.tag_reports(scope, WANTED))[report]

    QUERIES[name] = run


SCOPE_REPORTS = {
    "scope_shape": "scope_shape", "scope_labels": "context_by_label", "scope_contexts": "context_verbatim", "scope_band": "context_band",
    "scope_untagged": "context_untagged", "scope_claims": "tag_claims", "scope_money": "tag_money", "scope_gold": "gold_by_year",
    "scope_veto": "veto_audit", "scope_before_after": "before_after",
}
for key, report in SCOPE_REPORTS.items():
    scope_query(key, report)


@query
def scope_run(spark: SparkSession, sf: str) -> DataFrame:
    """A whole run over all documents, written as TSV, and its counts by label read back."""
    folder = staging_path(spark, "reports")
    told = SR.run_scope(I.points(spark, sf), folder, wanted=WANTED, kinds={"contexts": SR.context_reports})
    back = read_tsv(spark, f"{folder}/context_by_label.tsv")
    return back.select("label", "cue", "unit", F.col("n").cast("long").alias("n"), F.lit(told["n_points"]).cast("long").alias("n_points"))


@query
def tag_run(spark: SparkSession, sf: str) -> DataFrame:
    """A run that only reports, one that builds an entity's tags, one that builds the whole store's; and what the views have."""
    p, canonical = I.points(spark, sf), I.canonical(spark, sf)
    asked = {"dry": {"entity": I.ENTITY_CODE, "canonical": canonical}, "entity": {"entity": I.ENTITY_CODE, "build": True}, "store": {"build": True}}
    told = {}
    for name, options in asked.items():
        told[name] = SR.tag_run(p, staging_path(spark, name), wanted=WANTED, view=f"tagged_{name}", **options)
        told[name]["n_tagged"] = None if name == "dry" else spark.table(f"tagged_{name}").where("magnitude_check <> 'untagged'").count()
    rows = [(n, t["built"], t["n_points"], t["n_contexts"], len(t["reports"]), t["n_tagged"]) for n, t in told.items()]
    return spark.createDataFrame(rows, "run string, built boolean, n_points long, n_contexts long, n_reports int, n_tagged long")


# Audit


@query
def audit_redact(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    user = F.col("user_id").cast("string")
    props = F.struct(
        k.alias("k"),
        user.alias("Api_Key"),
        F.struct(F.lit("basic").alias("kind"), user.alias("token")).alias("client"),
        F.array(F.struct(F.col("event_type").alias("name"), user.alias("password"))).alias("calls"),
        F.struct(user.alias("bearer")).alias("auth"),
    )
    events = I.table(spark, sf, "events").select("event_id", props.alias("props"))
    return redact(events, "props").select("event_id", F.to_json("props").alias("props_redacted"))


CONTEXT = AuditContext("explicit", "derived", "0.1.0")


def _calls(events: DataFrame) -> DataFrame:
    event = F.col("event_id").cast("string")
    return events.select(
        "ts",
        F.col("user_id").cast("string").alias("user"),
        F.col("event_type").alias("tool"),
        F.create_map(F.lit("record_id"), event, F.lit("session_token"), F.col("props")).alias("filters"),
        F.array(F.concat(F.lit("p"), event)).alias("record_ids"),
    )


@query
def audit_log(spark: SparkSession, sf: str) -> DataFrame:
    calls = _calls(I.table(spark, sf, "events"))
    folder = staging_path(spark, "audit")
    append_audit(calls, CONTEXT, folder)
    return _by_day(read_audit(spark, folder))


@query
def audit_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same calls as a stream, and as a batch that is written twice under one name and then compacted; each call counts
    once for either, and each day has few files."""
    folder = staging_path(spark, "audit_stream")
    events = I.table(spark, sf, "events")
    # A stream reads what a pattern finds, be it a file or a folder.
    arriving = spark.readStream.schema(events.schema).parquet(f"{sf}/event[s].parquet")
    stream_audit(_calls(arriving), CONTEXT, folder, staging_path(spark, "audit_checkpoint")).awaitTermination()
    for _ in range(2):
        append_audit(_calls(events), CONTEXT, folder, "replayed")
    compact_audit(spark, folder)
    append_audit(_calls(events), CONTEXT, folder, "replayed")
    entries = read_audit(spark, folder)
    files = entries.select("day", F.input_file_name().alias("_file")).distinct()
    few = files.groupBy("day").agg((F.count(F.lit(1)) <= 4).alias("few_files"))
    return _by_day(entries).join(few, "day")


def _by_day(entries: DataFrame) -> DataFrame:
    leaked = F.count_if(F.col("filters")["session_token"] != "[redacted]")
    return entries.groupBy("day").agg(F.count(F.lit(1)).alias("n"), leaked.alias("n_leaked"))
