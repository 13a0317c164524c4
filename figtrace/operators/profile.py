"""How complete a table is, and what its figures look like."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from figtrace.functions import rules as R
from figtrace.functions.text import BLANK, ilike_any_part, nonblank, or_blank, trim_spaces
from figtrace.plans.figures import grouped_figures, rounded
from figtrace.sources.concepts import BoundPoints

# Concepts whose fill says whether a store is resolved, and the wanted columns by group.
MARKERS = ("metric_code", "temporality", "project_id", "entity")
CONTRACT = {
    "identity": ("entity", "entity_id", "entity_type"),
    "metric": ("metric_code",),
    "measure": ("value", "unit", "basis", "currency"),
    "time": ("year", "temporality"),
    "provenance": ("source_file", "source", "project_id"),
    "governance": ("source_type_flag", "inferred_fields"),
}


def _unfold(counts: DataFrame, rows: Sequence[Sequence[Column]], names: Sequence[str]) -> DataFrame:
    """One wide row of counts as several rows."""
    structs = [F.struct(*[c.alias(n) for c, n in zip(row, names)]) for row in rows]
    return counts.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def _filled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: the row count, and per column how many values are not blank; one scan for all."""
    counts = [F.count_if(nonblank(F.col(f"`{c}`"))).alias(f"_f{i}") for i, c in enumerate(columns)]
    return df.agg(F.count(F.lit(1)).alias("_rows"), *counts)


def fill_rate(bound: BoundPoints, concepts: Sequence[str] = MARKERS) -> DataFrame:
    """(concept, filled, total) for the concepts the table has."""
    held = [c for c in concepts if bound.has(c)]
    rows = [(F.lit(c), F.col(f"_f{i}"), F.col("_rows")) for i, c in enumerate(held)]
    return _unfold(_filled(bound.frame, held), rows, ("concept", "filled", "total"))


def with_fill_pct(rates: DataFrame) -> DataFrame:
    """Add the percentage, NULL for an empty table."""
    return rates.withColumn("pct", F.col("filled") * 100.0 / F.nullif(F.col("total"), F.lit(0)))


def table_profile(df: DataFrame, table_name: str) -> DataFrame:
    """(table_name, column_name, data_type, n_nonblank, n_rows) for every scalar column."""
    nested = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)
    fields = [f for f in df.schema.fields if not isinstance(f.dataType, nested)]
    counts = _filled(df, [f.name for f in fields])
    rows = [
        (F.lit(table_name), F.lit(f.name), F.lit(f.dataType.simpleString()), F.col(f"_f{i}"), F.col("_rows"))
        for i, f in enumerate(fields)
    ]
    return _unfold(counts, rows, ("table_name", "column_name", "data_type", "n_nonblank", "n_rows"))


def store_profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``table_profile`` of every table of a store."""
    profiles = [table_profile(df, name) for name, df in tables.items()]
    whole = profiles[0]
    for p in profiles[1:]:
        whole = whole.unionByName(p)
    return whole


def contract_check(df: DataFrame, contract: Mapping[str, Sequence[str]] = CONTRACT) -> DataFrame:
    """(contract_group, column_name, present, n_filled): wanted columns, and how full they are.

    A column that is there but empty shows as present with nothing filled.
    """
    wanted = [(group, c) for group, columns in contract.items() for c in columns]
    held = [c for c in dict.fromkeys(c for _, c in wanted) if c in df.columns]
    rows = [
        (
            F.lit(group), F.lit(c), F.lit(c in held),
            F.col(f"_f{held.index(c)}") if c in held else F.lit(0).cast("long"),
        )
        for group, c in wanted
    ]
    return _unfold(_filled(df, held), rows, ("contract_group", "column_name", "present", "n_filled"))


def looks_like_points(df: DataFrame, contract: Mapping[str, Sequence[str]] = CONTRACT) -> bool:
    """Whether a table has any metric or measure column at all."""
    return any(c in df.columns for group in ("metric", "measure") for c in contract[group])


def flag_freq(df: DataFrame, flag: str = "source_type_flag", top: int = 10) -> DataFrame:
    """(flag, n): the commonest values, blanks named."""
    counts = df.groupBy(or_blank(F.col(flag)).alias("flag")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc("flag")).limit(top)


def tag_shape(df: DataFrame, metric: str) -> DataFrame:
    """(n_rows, n_metric, n_blank): points in scope, with one metric code, and with none."""
    code = F.col("metric_code")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(code == metric).alias("n_metric"),
        F.count_if(_absent(code)).alias("n_blank"),
    )


def _absent(c: Column) -> Column:
    return c.isNull() | (trim_spaces(c) == "")


def _cue() -> Column:
    return F.regexp_extract("context", R.CUE, 1)


def _label() -> Column:
    label = F.split_part(F.col("context"), F.lit(R.SEPARATOR), F.lit(1))
    return trim_spaces(F.regexp_replace(label, R.CUE_PREFIX, ""))


def _unit() -> Column:
    return F.coalesce(F.nullif(trim_spaces(F.col("unit")), F.lit("")), F.lit(BLANK))


def _top(df: DataFrame, top: int | None, ties: Sequence[str]) -> DataFrame:
    if top is None:
        return df
    return df.orderBy(F.desc("n"), *[F.col(t).asc_nulls_last() for t in ties]).limit(top)


def context_shape(df: DataFrame) -> DataFrame:
    """(n_rows, n_empty, n_separator, n_cue): how far contexts follow the grammar."""
    context = F.col("context")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(_absent(context)).alias("n_empty"),
        F.count_if(F.contains(context, F.lit(R.SEPARATOR))).alias("n_separator"),
        F.count_if(_cue() != "").alias("n_cue"),
    )


def label_profile(
    df: DataFrame, top: int | None = 400, value: str = "value_num", decimals: int = 3
) -> DataFrame:
    """(label, cue, unit, n, n_distinct, n_negative, v_min, v_median, v_max), most points first."""
    keys = ["label", "cue", "unit"]
    rows = df.select(_label().alias("label"), _cue().alias("cue"), _unit().alias("unit"), F.col(value).alias("_v"))
    figures = rounded(grouped_figures(rows, keys, "_v"), decimals)
    return _top(figures.select(*keys, "n", "n_distinct", "n_negative", "v_min", "v_median", "v_max"), top, keys)


def context_profile(
    df: DataFrame, top: int | None = 400, value: str = "value_num", decimals: int = 3
) -> DataFrame:
    """(unit, context, n, v_min, v_median, v_max) over verbatim contexts, most points first."""
    keys = ["unit", "context"]
    rows = df.select(_unit().alias("unit"), "context", F.col(value).alias("_v"))
    figures = rounded(grouped_figures(rows, keys, "_v"), decimals)
    return _top(figures.select(*keys, "n", "v_min", "v_median", "v_max"), top, keys)


def value_band(
    df: DataFrame,
    low: float = 0,
    high: float = 50,
    top: int | None = 40,
    value: str = "value_num",
    decimals: int = 3,
) -> DataFrame:
    """(label, unit, n, v_median) for values strictly between two limits."""
    v = F.col(value)
    rows = df.where((v > low) & (v < high)).select(_label().alias("label"), _unit().alias("unit"), v.alias("_v"))
    keys = ["label", "unit"]
    figures = rounded(grouped_figures(rows, keys, "_v"), decimals, "v_median")
    return _top(figures.select(*keys, "n", "v_median"), top, keys)


def untagged_reclaim(
    df: DataFrame,
    keyword: str = "aero",
    top: int | None = 40,
    value: str = "value_num",
    decimals: int = 3,
) -> DataFrame:
    """(label, unit, n, v_min, v_median, v_max) of points without a code whose context has a keyword."""
    mentions = F.contains(F.lower("context"), F.lit(keyword.lower()))
    rows = df.where(_absent(F.col("metric_code")) & mentions).select(
        _label().alias("label"), _unit().alias("unit"), F.col(value).alias("_v")
    )
    keys = ["label", "unit"]
    figures = rounded(grouped_figures(rows, keys, "_v"), decimals)
    return _top(figures.select(*keys, "n", "v_min", "v_median", "v_max"), top, keys)


def value_spread(
    df: DataFrame,
    metric: str,
    entity: str,
    year: int,
    value: str = "value_num",
    decimals: int | None = None,
) -> DataFrame:
    """(unit, n, v_min, v_median, v_max) of one metric of one entity in one year."""
    from figtrace.functions.text import year_number

    stated = year_number(F.col("year"), dict(df.dtypes)["year"]) == year
    scope = (F.col("metric_code") == metric) & entity_matches(entity) & stated
    rows = df.where(scope).select(or_blank(F.col("unit")).alias("unit"), F.col(value).alias("_v"))
    figures = rounded(grouped_figures(rows, ["unit"], "_v"), decimals, "v_median")
    return figures.select("unit", "n", "v_min", "v_median", "v_max")


def entity_matches(entity: str) -> Column:
    """The entity by name or by code."""
    return ilike_any_part(F.col("entity"), entity) | ilike_any_part(F.col("entity_id"), entity)
