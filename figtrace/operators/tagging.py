"""Tagging figures from their context: what is measured, what type of number it is, which code.

Everything is a row-local projection over built-in expressions, so tagging points needs no shuffle
and cannot multiply them. ``context_tags`` gives the distinct classifications for inspection, and
``tag_points_by_lookup`` joins them back where classifying each context once is cheaper;
``tag_repeated_points`` finds out whether it is.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figtrace.functions import rules as R
from figtrace.functions.dialect import first_match, literal, matches
from figtrace.functions.text import trim_spaces
from figtrace.plans.once import computed_once
from figtrace.plans.skew import lookup_join
from figtrace.sources.bucketed import KEY, BucketedTable, join_lookup, write_bucketed, write_lookup
from figtrace.sources.tables import stage

PARSED = ("sheet", "row_label", "cue", "tail", "unit_l")
TAGS = (
    "row_label", "measure_noun", "label_source", "measure_kind", "metric_family", "metric_code_v2", "currency_v2",
    "scale_mult", "price_basis", "base_year", "unit_is_pct", "rule_id", "band_lo", "band_hi",
)
VETOED = ("metric_code_v2_raw", "magnitude_check")

# Distinct contexts are classified once and sent to all tasks if they take so many bytes at most, with TAG_BYTES for the
# tags of each, and points repeat them so often on average.
LOOKUP_BYTES, TAG_BYTES, REPEATS = 64 << 20, 200, 4


def parse_context(
    df: DataFrame, context: str = "context", location: str = "location", unit: str = "unit"
) -> DataFrame:
    """Add sheet, row_label, cue, tail and unit_l.

    A context is ``[cue] row label sheet name || headers``; the sheet is known from the locator, so it
    can be taken off the end of the label.
    """
    raw = F.col(context)
    label = F.regexp_replace(F.split_part(raw, F.lit(R.SEPARATOR), F.lit(1)), R.CUE_PREFIX, "")
    df = df.withColumns(
        {
            "sheet": F.regexp_extract(F.col(location), R.SHEET, 1),
            "_label": trim_spaces(label),
            "cue": F.lower(F.regexp_extract(raw, R.CUE, 1)),
            "tail": F.lower(F.split_part(raw, F.lit(R.SEPARATOR), F.lit(2))),
            "unit_l": F.lower(F.coalesce(F.col(unit), F.lit(""))),
        }
    )
    size = F.length("sheet")
    ends_in_sheet = (F.col("sheet") != "") & (F.lower(F.right(F.col("_label"), size)) == F.lower("sheet"))
    before = trim_spaces(F.left(F.col("_label"), F.length("_label") - size))
    return df.withColumn(
        "row_label", F.when(ends_in_sheet, F.lower(before)).otherwise(F.lower("_label"))
    ).drop("_label")


def _noun(df: DataFrame) -> DataFrame:
    """Add measure_noun and label_source.

    The row label decides. Only where it names nothing may the sheet and headers, and only when
    exactly one pattern matches them (two revenue patterns count as two).
    """
    everything = F.concat("row_label", F.lit(" "), "sheet", F.lit(" "), "tail")
    df = df.withColumns(
        {
            "_family_text": F.lower(everything),
            "_noun_label": trim_spaces(F.regexp_replace("row_label", R.DENOMINATORS, " ")),
        }
    )
    label_noun = first_match([(matches("_noun_label", n.pattern), n.name) for n in R.NOUNS], "")
    df = df.withColumn("_label_noun", label_noun)
    hits = ", ".join(f"case when {matches('_family_text', n.pattern)} then {literal(n.name)} end" for n in R.NOUNS)
    df = df.withColumn("_sheet_nouns", F.expr(f"case when _label_noun = '' then concat_ws('|', {hits}) else '' end"))
    named = F.col("_label_noun") != ""
    from_sheet = (F.col("_sheet_nouns") != "") & ~F.contains(F.col("_sheet_nouns"), F.lit("|"))
    return df.withColumns(
        {
            "measure_noun": F.when(named, F.col("_label_noun")).when(from_sheet, F.col("_sheet_nouns")).otherwise(""),
            "label_source": F.when(named, "row_label").when(from_sheet, "sheet_fallback").otherwise("none"),
        }
    ).drop("_noun_label", "_label_noun", "_sheet_nouns")


def _kind(df: DataFrame) -> DataFrame:
    """Add rule_id by matching once, and measure_kind and the band by what that rule says."""
    unbanded = False
    for k in R.KINDS:
        banded = k.low is not None or k.high is not None
        if banded and unbanded:
            raise ValueError(f"{k.rule_id}: the band is that of the first match, so banded rules come first")
        unbanded = unbanded or not banded
    target = {"label": "row_label", "unit": "unit_l", "noun": "measure_noun"}
    rule = first_match([(matches(target[k.target], k.pattern), k.rule_id) for k in R.KINDS], R.NO_RULE)
    is_rule = {k.rule_id: f"rule_id = {literal(k.rule_id)}" for k in R.KINDS}
    family = first_match([(matches("_family_text", pattern), name) for name, pattern in R.FAMILIES], R.NO_FAMILY)
    df = df.withColumns({"rule_id": rule, "metric_family": family}).drop("_family_text")
    return df.withColumns(
        {
            "measure_kind": first_match([(is_rule[k.rule_id], k.kind) for k in R.KINDS], R.NO_KIND),
            "_low": first_match([(is_rule[k.rule_id], k.low) for k in R.KINDS if k.low is not None], None),
            "band_hi": first_match([(is_rule[k.rule_id], k.high) for k in R.KINDS if k.high is not None], None),
        }
    )


def _code(df: DataFrame) -> DataFrame:
    """Add metric_code_v2, NULL wherever the figure must not answer a question, and band_lo."""
    names = ", ".join(map(literal, R.UNCODED_KINDS))
    uncoded = f"measure_kind in ({names}) or measure_noun = {literal(R.UNCODED_NOUN)} or label_source = 'none'"
    cases = [(uncoded, None)]
    for c in R.CODES:
        wanted = {"measure_noun": c.noun, "measure_kind": c.kind, "metric_family": c.family}
        cases.append((" and ".join(f"{k} = {literal(v)}" for k, v in wanted.items() if v is not None), c.code))
    df = df.withColumn("metric_code_v2", first_match(cases, None))
    floored = F.greatest(F.coalesce(F.col("_low"), F.lit(0.0)), F.lit(0.0))
    return df.withColumn(
        "band_lo", F.when(F.col("metric_code_v2").isin(*R.NON_NEGATIVE_CODES), floored).otherwise(F.col("_low"))
    ).drop("_low")


def _cue(df: DataFrame) -> DataFrame:
    """Add currency, scale, price basis, base year and the percent flag, from the cue."""
    cue = F.col("cue")
    year = F.nullif(F.regexp_extract(cue, R.BASE_YEAR, 1), F.lit(""))
    return df.withColumns(
        {
            "currency_v2": first_match([(matches("cue", p), name) for name, p in R.CURRENCIES], ""),
            "scale_mult": first_match([(matches("cue", p), scale) for scale, p in R.SCALES], 1),
            "price_basis": first_match([(matches("cue", p), name) for name, p in R.BASES], ""),
            "base_year": year.try_cast("int"),
            "unit_is_pct": (F.col("unit_l") == "%") | F.contains(cue, F.lit("%")),
        }
    )


def classify(df: DataFrame, context: str = "context", location: str = "location", unit: str = "unit") -> DataFrame:
    """Add the parsed columns and all tags to every row."""
    return _cue(_code(_kind(_noun(parse_context(df, context, location, unit)))))


def contexts(points: DataFrame, context: str = "context", location: str = "location", unit: str = "unit") -> DataFrame:
    """(context, sheet, row_label, cue, tail, unit_l) of every distinct context, sheet and unit."""
    inputs = points.select(
        F.col(context).alias("context"), F.regexp_extract(F.col(location), R.SHEET, 1).alias("_sheet"),
        F.lower(F.coalesce(F.col(unit), F.lit(""))).alias("unit"),
    ).dropDuplicates()
    located = inputs.withColumn("location", F.concat(F.lit("sheet="), F.col("_sheet"), F.lit("!")))
    return parse_context(located).select("context", *PARSED)


def context_tags(
    points: DataFrame, context: str = "context", location: str = "location", unit: str = "unit", *, tags: Sequence[str] = TAGS
) -> DataFrame:
    """The tags of every distinct (context, sheet, unit), as ``context, sheet, unit_l`` and 14 tags, or those asked for.

    Duplicates go before any rule runs, and are dropped within map tasks before the shuffle.
    """
    inputs = points.select(
        F.col(context).alias("context"), F.regexp_extract(F.col(location), R.SHEET, 1).alias("_sheet"),
        F.lower(F.coalesce(F.col(unit), F.lit(""))).alias("unit"),
    ).dropDuplicates()
    located = inputs.withColumn("location", F.concat(F.lit("sheet="), F.col("_sheet"), F.lit("!")))
    return computed_once(classify(located).select("context", "sheet", "unit_l", *tags), tags)


# The tags that the veto reads.
VETO_READS = ("metric_code_v2", "currency_v2", "price_basis", "band_lo", "band_hi")


def _veto(df: DataFrame, tagged: Column, value: str) -> DataFrame:
    """Take the code from values outside the band; the claim stays in metric_code_v2_raw."""
    v = F.col(value)
    below = F.col("band_lo").isNotNull() & (v < F.col("band_lo"))
    above = F.col("band_hi").isNotNull() & (v > F.col("band_hi"))
    check = F.when(~tagged, "untagged").when(below, "below_band").when(above, "above_band").otherwise("ok")
    df = df.withColumn("magnitude_check", check)
    vetoed = F.col("magnitude_check").isin("below_band", "above_band")
    return df.withColumns(
        {
            "metric_code_v2_raw": F.col("metric_code_v2"),
            "metric_code_v2": F.when(~vetoed, F.col("metric_code_v2")),
            "currency_v2": F.nullif(F.col("currency_v2"), F.lit("")),
            "price_basis": F.nullif(F.col("price_basis"), F.lit("")),
        }
    )


def tag_points(
    points: DataFrame,
    context: str = "context",
    location: str = "location",
    unit: str = "unit",
    value: str = "value_num",
    *,
    tags: Sequence[str] | None = None,
) -> DataFrame:
    """Every point with its tags and the magnitude veto; one row in, one row out, no shuffle.

    With ``tags``, only those: rules and inputs that the others rest on are left out of the plan.
    """
    names = points.columns
    asked = [t for t in (*TAGS, *VETOED) if tags is None or t in tags]
    df = classify(points, context, location, unit)
    tagged = F.col(context).isNotNull() & F.col("sheet").isNotNull()
    df = df.select(
        *names, *[F.when(tagged, F.col(t)).alias(t) for t in TAGS], tagged.alias("_tagged")
    )
    df = _veto(df, F.col("_tagged"), value)
    return computed_once(df.select(*names, *asked), asked)


def tag_repeated_points(
    points: DataFrame,
    context: str = "context",
    location: str = "location",
    unit: str = "unit",
    value: str = "value_num",
    *,
    tags: Sequence[str] | None = None,
    among: DataFrame | None = None,
) -> DataFrame:
    """The same as ``tag_points``; where points repeat few contexts, these are classified once each instead of once a point.

    One pass estimates how many distinct contexts there are and how long they get, which decides the route only. Few are
    classified, written and sent to all tasks, so that no point is shuffled; otherwise this is ``tag_points``. ``among`` is
    a frame that holds the contexts of all points, if one takes less work to read. What was written can be released.
    """
    keys = _keys(context, location, unit)
    among = points if among is None else among
    keyed = among.select(*[c.alias(k) for k, c in keys.items()]).where("_context is not null and _sheet is not null")
    size = reduce(add, [F.octet_length(k) for k in keys]) + TAG_BYTES
    found = keyed.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64(*keys)).alias("distinct"), F.max(size).alias("size")).first()
    if found["distinct"] * REPEATS > found["n"] or found["distinct"] * (found["size"] or 0) > LOOKUP_BYTES:
        return tag_points(points, context, location, unit, value, tags=tags)
    names = points.columns
    asked = [t for t in (*TAGS, *VETOED) if tags is None or t in tags]
    needed = [t for t in TAGS if t in asked or t in VETO_READS]
    held = stage(context_tags(among, context, location, unit, tags=needed).where("context is not null and sheet is not null"), "tags")
    lookup = held.select(
        F.col("context").alias("_context"), F.col("sheet").alias("_sheet"), F.col("unit_l").alias("_unit"), *needed, F.lit(True).alias("_tagged")
    )
    joined = points.withColumns(keys).join(F.broadcast(lookup), list(keys), "left")
    tagged = _veto(joined, F.coalesce(F.col("_tagged"), F.lit(False)), value).select(*names, *asked)
    tagged._staged = held._staged
    return tagged


def tag_points_by_lookup(
    points: DataFrame,
    tags: DataFrame,
    context: str = "context",
    location: str = "location",
    unit: str = "unit",
    value: str = "value_num",
) -> DataFrame:
    """The same as ``tag_points``, from a table of ``context_tags``; contexts it lacks stay untagged."""
    names = points.columns
    keyed = points.withColumns(_keys(context, location, unit))
    keys = ["_context", "_sheet", "_unit"]
    lookup = tags.where("context is not null and sheet is not null").select(
        F.col("context").alias("_context"), F.col("sheet").alias("_sheet"), F.col("unit_l").alias("_unit"),
        *TAGS, F.lit(True).alias("_tagged"),
    )
    joined = lookup_join(keyed, lookup, keys)
    df = _veto(joined, F.coalesce(F.col("_tagged"), F.lit(False)), value)
    return df.select(*names, *TAGS, *VETOED)


def _keys(context: str, location: str, unit: str) -> dict[str, Column]:
    """What a context is classified by."""
    return {
        "_context": F.col(context),
        "_sheet": F.regexp_extract(F.col(location), R.SHEET, 1),
        "_unit": F.lower(F.coalesce(F.col(unit), F.lit(""))),
    }


def bucket_points(
    points: DataFrame, name: str, path: str, *, buckets: int = 64, context: str = "context", location: str = "location", unit: str = "unit"
) -> BucketedTable:
    """Write points bucketed by what their context is classified by, for any number of tag tables to be joined."""
    return write_bucketed(points, _keys(context, location, unit), name, path, buckets=buckets)


def tag_bucketed_points(points: BucketedTable, tags: DataFrame, name: str, value: str = "value_num") -> DataFrame:
    """``tag_points_by_lookup`` over bucketed points: the tags are written in the same buckets, under ``name``, and
    joined without shuffling a point."""
    held = tags.where("context is not null and sheet is not null").withColumn("_tagged", F.lit(True))
    lookup = write_lookup(held, points, {"_context": "context", "_sheet": "sheet", "_unit": "unit_l"}, name)
    names = [c for c in points.frame().columns if c not in (*points.keys, *KEY)]
    joined = join_lookup(points, lookup, [*TAGS, "_tagged"], names)
    return _veto(joined, F.coalesce(F.col("_tagged"), F.lit(False)), value).select(*names, *TAGS, *VETOED)


def in_scope(points: DataFrame, entity: str | None = None, canonical: DataFrame | None = None) -> DataFrame:
    """One entity or the whole store, with or without the copies of documents."""
    from figtrace.operators.filters import keep_canonical

    if entity is not None:
        points = points.where(F.col("entity_id") == entity)
    return points if canonical is None else keep_canonical(points, canonical)
