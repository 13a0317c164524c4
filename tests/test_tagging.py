"""Context shapes and what they must be tagged as."""

from __future__ import annotations

import pytest

from checks.queries import QUERIES
from figtrace.functions.dialect import java_pattern, matches
from figtrace.operators import tag_reports as TR
from figtrace.operators import tagging as T
from pyspark.sql import functions as F

FIELDS = "point_id string, value_num double, metric_code string, unit string, location string, context string, year int"
FARE = "[$, Nominal] Average fare Aero Tickets || by route"
ROWS = [
    ("takings", 83.5, "", "EUR", "sheet=Duty Free!B2", "[€ bn, Real 2015] Gross takings Duty Free || by month"),
    ("seats", 512.0, "supply", "", "sheet=Capacity!B2", "[thousand] Seats offered Capacity || weekly"),
    ("fare", 12.4, "fares", "", "sheet=Aero Tickets!C3", FARE),
    ("inflation", 2.1, "", "%", "sheet=Model!D4", "[%] RPI assumed Model || plan"),
    ("profit", -3.3, "result", "EUR", "sheet=Bridge!E5", "[€m, 2019] Operating profit Bridge || plan"),
    ("mix", 41.0, "", "%", "sheet=Cargo!F6", "[%] Share of freight Cargo || plan"),
    ("parking", 9.9, "", "GBP", "sheet=Other Income!G7", "[£ thousand] Car park Other Income || plan"),
    ("variance", 0.4, "", "", "sheet=Plan!H8", "[Nominal] Variance Plan || takings by shop"),
    ("twice", 0.4, "", "", "sheet=Aero Income!H8", "[Nominal] Variance Aero Income || plan"),
    ("staff", 7.7, "", "per pax", "sheet=EBITDA Walk!I9", "[€] Staff cost EBITDA Walk || plan"),
    ("building", 120.0, "", "", "sheet=Works!J1", "[m] Capital expenditure Works || plan"),
    ("tariff", 6.1, "", "", "sheet=Aero Prices!K2", "[Nominal] Tariff Aero Prices || plan"),
    ("huge_fare", 50321.0, "fares", "", "sheet=Aero Tickets!C9", FARE),
    ("refund", -12.0, "fares", "", "sheet=Aero Tickets!C8", FARE),
    ("unit_loss", -4.2, "result", "per atm", "sheet=Results!L3", "[£, 2011 Prices] EBIT per ATM Results || plan"),
    ("no_value", None, "fares", "", "sheet=Aero Tickets!C7", FARE),
    ("no_context", 1.0, "", "GBP", "sheet=Works!J2", None),
    ("no_place", 1.0, "", "GBP", None, FARE),
    ("notes", 1.0, "", "", "sheet=Notes!A1", "[m] Region Notes || plan"),
]


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame([(*r, 2016) for r in ROWS], FIELDS)


@pytest.fixture(scope="module")
def tags(points):
    return {r.point_id: r for r in T.tag_points(points).collect()}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_row_survives(tags):
    assert sorted(tags) == sorted(r[0] for r in ROWS)


@pytest.mark.parametrize(
    ("point", "noun", "kind", "code", "source"),
    [
        ("takings", "revenue", "level", "rev_nonaero", "row_label"),
        ("seats", "pax", "volume", "pax_total", "row_label"),
        ("fare", "revenue", "rate", "rev_aero_per_pax", "row_label"),
        ("inflation", "macro", "index", None, "row_label"),
        ("profit", "ebitda", "level", "ebitda", "row_label"),
        ("mix", "", "share", None, "none"),
        ("parking", "revenue", "component", "rev_nonaero_segment", "sheet_fallback"),
        ("variance", "revenue", "growth", None, "sheet_fallback"),
        ("twice", "", "growth", None, "none"),  # its sheet says revenue twice over, so nothing may be read from it
        ("staff", "opex", "rate", "opex_per_pax", "row_label"),
        ("building", "capex", "level", "capex", "row_label"),
        ("tariff", "charge", "level", "aero_charge", "row_label"),
        ("unit_loss", "ebitda", "rate", "ebitda_per_pax", "row_label"),
        ("notes", "", "unclassified", None, "none"),
    ],
)
def test_shapes(tags, point, noun, kind, code, source):
    row = tags[point]
    assert (row.measure_noun, row.measure_kind, row.metric_code_v2_raw, row.label_source) == (noun, kind, code, source)


def test_the_cue_gives_currency_scale_and_basis(tags):
    def cue(point):
        row = tags[point]
        return row.currency_v2, row.scale_mult, row.price_basis, row.base_year

    assert cue("takings") == ("EUR", 1_000_000_000, "real", 2015) and cue("unit_loss") == ("GBP", 1, "real", 2011)
    assert cue("fare")[:3] == ("USD", 1, "nominal") and tags["tariff"].currency_v2 is None
    # A millions cue needs a space or the start before it.
    assert tags["building"].scale_mult == 1_000_000 and tags["profit"].scale_mult == 1


def test_out_of_band_figures_lose_their_code(tags):
    for point, check in (("huge_fare", "above_band"), ("refund", "below_band")):
        row = tags[point]
        assert (row.metric_code_v2, row.metric_code_v2_raw, row.magnitude_check) == (None, "rev_aero_per_pax", check)
    assert tags["fare"].metric_code_v2 == "rev_aero_per_pax" and tags["fare"].magnitude_check == "ok"
    assert tags["unit_loss"].metric_code_v2 == "ebitda_per_pax" and tags["no_value"].magnitude_check == "ok"


def test_without_context_or_sheet_nothing_is_tagged(tags):
    for point in ("no_context", "no_place"):
        assert tags[point].magnitude_check == "untagged" and tags[point].metric_code_v2_raw is None


def test_lookup_gives_the_same_tags(points, tags):
    looked_up = T.tag_points_by_lookup(points, T.context_tags(points))
    assert {r.point_id: r for r in looked_up.collect()} == tags


@pytest.mark.parametrize("asked", [None, ["measure_noun", "measure_kind", "magnitude_check"], ["metric_code_v2", "label_source"], ["currency_v2"]])
def test_repeated_contexts_give_the_same_tags(points, monkeypatch, asked):
    often = points.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(9))))
    want, got = T.tag_points(often, tags=asked), T.tag_repeated_points(often, tags=asked)
    assert got.schema == want.schema and got.count() == 9 * len(ROWS)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    # No rule is left above the points; they are not shuffled, and contexts without end are not sent to tasks.
    assert "penetration" not in plan_of(got) and "Exchange hash" not in plan_of(got) and "penetration" in plan_of(T.tag_repeated_points(points))
    monkeypatch.setattr(T, "LOOKUP_BYTES", 1000)
    assert "Broadcast" not in plan_of(T.tag_repeated_points(often, tags=asked))


def test_repeated_contexts_of_no_points(points):
    assert T.tag_repeated_points(points.limit(0)).collect() == []


def test_claims_classify_each_context_once(spark):
    """Five points a context: the rules ran on each of them before."""
    assert "penetration" not in plan_of(QUERIES["tag_claims"](spark, "/root/testdata/sf0.1"))


def test_filters_over_tags_stay_small(points):
    tagged = T.tag_points(points).where("metric_code_v2 = 'rev_nonaero' and magnitude_check = 'ok' and year = 2016")
    assert tagged.count() == 1
    assert len(tagged._jdf.queryExecution().optimizedPlan().toString()) < 60_000


def test_veto_audit_passes(points):
    row = TR.veto_audit(T.tag_points(points)).first()
    assert (row.n_still_coded, row.n_raw_kept, row.verdict) == (0, 2, "PASS")


def test_before_and_after_has_both_rows(points):
    rows = {r.which: r.n for r in TR.tag_before_after(T.tag_points(points), 1900).collect()}
    assert rows == {"before": 0, "after": 0}


def test_dialect():
    assert java_pattern(r"(index$|^eu\b)") == r"(index\z|^eu(?![A-Za-z0-9_]))"
    assert java_pattern("([$]|usd)") == "([$]|usd)"


@pytest.mark.parametrize("text", ["rev", "reve", "revé", "a rev.", "atm", "atms", "atmsx", "(cpi", "cpi x", "x cpi", "index", "index\n", ""])
@pytest.mark.parametrize("pattern", [r"(rev\b|atms?\b|^cpi|\(cpi|index$)", r"(passengers?|^rev)", r"(^|\s)(non-?)?aero(\s|$)"])
def test_phrases_match_as_the_whole_pattern_does(spark, text, pattern):
    import re

    df = spark.createDataFrame([(text,)], "t string")
    want = re.search(pattern.replace("$", r"\Z"), text, re.ASCII) is not None
    assert df.select(F.expr(matches("t", pattern))).first()[0] is want
