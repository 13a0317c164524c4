"""Reports over tagged points (the output of ``tag_points``, best written once and read back)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figtrace.functions.text import or_blank
from figtrace.plans.figures import grouped_figures, rounded

NO_MONEY_CODE, NO_CODE = "(no money code)", "(none)"


def _tagged(points: DataFrame) -> DataFrame:
    return points.where(F.col("magnitude_check") != "untagged")


def _vetoed() -> Column:
    return F.col("magnitude_check").isin("below_band", "above_band")


def _raw(default: str) -> Column:
    return F.coalesce(F.col("metric_code_v2_raw"), F.lit(default))


def _count() -> Column:
    return F.count(F.lit(1))


def _top(df: DataFrame, top: int, *ties: str) -> DataFrame:
    return df.orderBy(F.desc("n"), *[F.col(t).asc_nulls_last() for t in ties]).limit(top)


def tag_claims(
    points: DataFrame, value: str = "value_num", top: int = 30, decimals: int = 3
) -> DataFrame:
    """What the rules claim: (noun, kind, label_source, code_v2, n, v_median), most points first."""
    claims = _tagged(points).select(
        F.col("measure_noun").alias("noun"), F.col("measure_kind").alias("kind"), "label_source",
        _raw(NO_MONEY_CODE).alias("code_v2"), F.col(value).alias("_v"),
    )
    keys = ["noun", "kind", "label_source", "code_v2"]
    figures = rounded(grouped_figures(claims, keys, "_v"), decimals, "v_median")
    return _top(figures.select(*keys, "n", "v_median"), top, *keys)


def tag_migration(points: DataFrame, code: str = "rev_aero", top: int = 25) -> DataFrame:
    """Which figures leave a family of codes and which join it: (old_code, new_code, kind, n)."""
    involved = (F.col("metric_code") == code) | F.col("metric_code_v2_raw").startswith(code)
    moves = _tagged(points).where(involved).groupBy(
        or_blank(F.col("metric_code")).alias("old_code"), _raw(NO_CODE).alias("new_code"),
        F.col("measure_kind").alias("kind"),
    )
    return _top(moves.agg(_count().alias("n")), top, "old_code", "new_code", "kind")


def tag_promotions(
    points: DataFrame,
    codes: Sequence[str] = ("ebitda", "gdp_elasticity", "opex_total", "capex", "pax_total"),
    top: int = 15,
) -> DataFrame:
    """Where the figures of some old codes went: (old_code, new_code, n)."""
    moves = _tagged(points).where(F.col("metric_code").isin(*codes)).groupBy(
        F.col("metric_code").alias("old_code"), _raw(NO_CODE).alias("new_code")
    )
    return _top(moves.agg(_count().alias("n")), top, "old_code", "new_code")


def gold_by_year(
    points: DataFrame,
    code: str = "rev_aero_per_pax",
    years: tuple[int, int] = (2005, 2015),
    value: str = "value_num",
    decimals: int = 2,
) -> DataFrame:
    """A reference figure by year, in band and read from the row label: (year, n, v_min, v_median, v_max)."""
    held = points.where(
        (F.col("metric_code_v2") == code) & (F.col("label_source") == "row_label") & F.col("year").between(*years)
    ).select("year", F.col(value).alias("_v"))
    return rounded(grouped_figures(held, ["year"], "_v"), decimals).select("year", "n", "v_min", "v_median", "v_max")


def tag_conflicts(points: DataFrame) -> DataFrame:
    """Figures outside their band, by kind: (kind, n)."""
    return points.where(_vetoed()).groupBy(F.col("measure_kind").alias("kind")).agg(_count().alias("n"))


def tag_money(points: DataFrame) -> DataFrame:
    """(currency, price_basis, n): the money tags as the view shows them, NULL where a context states none."""
    counts = points.groupBy(F.col("currency_v2").alias("currency"), "price_basis")
    return counts.agg(_count().alias("n"))


def tag_coverage(tags: DataFrame) -> DataFrame:
    """How many rows took their noun from where, and how many carry a code."""
    code = "metric_code_v2_raw" if "metric_code_v2_raw" in tags.columns else "metric_code_v2"
    source = F.col("label_source")
    return tags.where(source.isNotNull()).agg(
        F.count_if(source == "row_label").alias("n_row_label"),
        F.count_if(source == "sheet_fallback").alias("n_sheet"),
        F.count_if(source == "none").alias("n_none"),
        F.count_if(F.col(code).isNotNull()).alias("n_coded"),
        _count().alias("n_total"),
    )


def code_distribution(tags: DataFrame) -> DataFrame:
    """(code, n) over the rows of a tag table."""
    return tags.groupBy(F.coalesce(F.col("metric_code_v2"), F.lit(NO_CODE)).alias("code")).agg(_count().alias("n"))


def veto_audit(points: DataFrame) -> DataFrame:
    """Does the veto take the code and keep the claim? (n_out_of_band, n_still_coded, n_raw_kept, verdict)."""
    counts = points.where(F.col("magnitude_check") != "ok").agg(
        _count().alias("n_out_of_band"),
        F.count_if(F.col("metric_code_v2").isNotNull()).alias("n_still_coded"),
        F.count_if(F.col("metric_code_v2_raw").isNotNull()).alias("n_raw_kept"),
    )
    verdict = (
        F.when(F.col("n_still_coded") > 0, "FAIL: still coded")
        .when(F.col("n_raw_kept") == 0, "FAIL: raw claim missing")
        .otherwise("PASS")
    )
    return counts.withColumn("verdict", verdict)


def tag_before_after(
    points: DataFrame,
    year: int,
    before: str = "rev_aero",
    after: str = "rev_aero_per_pax",
    value: str = "value_num",
    decimals: int = 2,
) -> DataFrame:
    """One question under the old code and the new: (which, n, v_min, v_median, v_max), in one pass."""
    asked = points.where(F.col("year") == year)
    old = F.when(F.col("metric_code") == before, F.lit("before"))
    new = F.when((F.col("metric_code_v2") == after) & (F.col("label_source") == "row_label"), F.lit("after"))
    held = asked.select(F.explode(F.array(old, new)).alias("which"), F.col(value).alias("_v")).where("which is not null")
    figures = rounded(grouped_figures(held, ["which"], "_v"), decimals)
    # A side nothing answers still has its row.
    sides = points.sparkSession.range(1).select(F.explode(F.array(F.lit("before"), F.lit("after"))).alias("_which"))
    joined = sides.join(figures, F.col("_which") == F.col("which"), "left")
    return joined.select(
        F.col("_which").alias("which"), F.coalesce(F.col("n"), F.lit(0)).alias("n"), "v_min", "v_median", "v_max"
    )
