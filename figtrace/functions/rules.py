"""The tagging rules, as data. Every table is ordered and the first match wins.

Fixed values: the patterns, names, bands and codes below have to be these exact values, because
tags are compared and joined across stores that were tagged with them. All texts they are matched
against are lower case.
"""

from __future__ import annotations

from typing import NamedTuple


class Noun(NamedTuple):
    name: str
    pattern: str


class Kind(NamedTuple):
    rule_id: str
    kind: str
    target: str  # label, unit or noun
    pattern: str
    low: float | None
    high: float | None


class Code(NamedTuple):
    noun: str
    kind: str | None  # None: any kind
    family: str | None  # None: any family
    code: str


# What is measured, read from the row label.
NOUNS = (
    Noun("macro", r"(consumer price index|inflation|deflator|price index|elasticit|^cpi|^rpi|^gdp|\(cpi|\(rpi)"),
    Noun("ebitda", r"(ebitda|ebit\b|operating profit|net income|profit before)"),
    Noun("opex", r"(opex|operating cost|operating expen|staff cost|payroll|total cost|unit cost|cost base|overhead)"),
    Noun("capex", r"(capex|capital expen|capital cost|investment programme)"),
    Noun("charge", r"(charge|tariff|landing fee|passenger fee)"),
    Noun("revenue", r"(revenue|rev\b|revs\b|income|turnover|yield|fare|receipts|takings)"),
    Noun("pax", r"(passengers?|^pax|pax\b|atms?\b|air transport movement|movements?\b|wlu|seats\b|load factor)"),
    Noun("revenue", r"(^|\s)(non-?)?aero(\s|$)"),
)

# Per-unit denominators, removed from the label before its noun is read.
DENOMINATORS = r"(per pax|per passenger|per pass[a-z]*|per wlu|per atm|per fte|per employee|per movement|per sqm|/pax)"

# What type of number it is, with the band its values must lie in.
KINDS = (
    Kind("R01_share", "share", "label", r"(% share|share of|% of total|mix %|penetration)", -200.0, 200.0),
    Kind("R02_growth", "growth", "label", r"(yoy|y/y|year on year|year-on-year|cagr|% change|% chg|change in|growth|variance|delta)", -500.0, 500.0),
    Kind("R03_index", "index", "label", r"(consumer price index|inflation index|price index|deflator|^index|index$|elasticit|^cpi|^rpi|^gdp|\(cpi|\(rpi)", -100.0, 100000.0),
    Kind("R04_rate_unit", "rate", "unit", r"^(per pax|per passenger|/pax|per wlu|per atm)$", -1000.0, 1000.0),
    Kind("R05_rate_label", "rate", "label", r"(per pax|per pass|per passenger|per wlu|per atm|per movement|per fte|per sqm|per employee|/pax|rev/pax|yield|average fare|unit rate)", -1000.0, 1000.0),
    Kind("R06_volume", "volume", "label", r"^(pax|passengers?|total pax|atms?|air transport movements|movements|wlu|seats)\b", None, None),
    Kind("R07_component", "component", "label", r"(low cost|lcc|charter|scheduled|full service|domestic|international|^eu\b|non-eu|non eu|british airways|other airlines|transfer|freight|mail|general aviation|car park|parking|duty free|retail|advertising|concession|fuel|handling|hbs|cute|check-in|transactions|rental|catering)", None, None),
    Kind("R08_total", "level", "label", r"(^total|^sub ?total|^net\b|^gross\b|^reported|^normalised)", None, None),
    Kind("R09_level", "level", "noun", r"(revenue|charge|ebitda|opex|capex)", None, None),
)
NO_KIND, NO_RULE = "unclassified", "R99_none"

# The business family, read from label, sheet and header together.
FAMILIES = (
    ("nonaero", r"(non-aero|non aero|nonaero|retail|car park|duty free|concession|commercial revenue)"),
    ("aero", r"aero"),
    ("traffic", r"(passenger|pax|traffic)"),
)
NO_FAMILY = "other"

# The code that may answer a question. Kinds and nouns listed as uncoded never get one.
UNCODED_KINDS = ("growth", "share", "index")
UNCODED_NOUN = "macro"
CODES = (
    Code("pax", "component", None, "pax_segment"),
    Code("pax", None, None, "pax_total"),
    Code("ebitda", "rate", None, "ebitda_per_pax"),
    Code("ebitda", None, None, "ebitda"),
    Code("opex", "rate", None, "opex_per_pax"),
    Code("opex", None, None, "opex_total"),
    Code("capex", None, None, "capex"),
    Code("charge", None, "aero", "aero_charge"),
    Code("revenue", "rate", "aero", "rev_aero_per_pax"),
    Code("revenue", "rate", "nonaero", "rev_nonaero_per_pax"),
    Code("revenue", "rate", None, "rev_total_per_pax"),
    Code("revenue", "component", "aero", "rev_aero_segment"),
    Code("revenue", "component", "nonaero", "rev_nonaero_segment"),
    Code("revenue", None, "aero", "rev_aero"),
    Code("revenue", None, "nonaero", "rev_nonaero"),
    Code("revenue", None, None, "rev_total"),
)
# Codes whose values are never negative, whatever the band of their kind.
NON_NEGATIVE_CODES = ("rev_aero_per_pax", "rev_nonaero_per_pax", "rev_total_per_pax", "pax_total", "pax_segment")

# Currency, scale and price basis, read from the cue. A millions cue needs a space or the start
# before it, and any four-digit run makes a basis real.
CURRENCIES = (("GBP", r"(£|gbp)"), ("EUR", r"(€|eur)"), ("USD", r"([$]|usd)"))
SCALES = (
    (1000, r"(000s|000's|thousand)"),
    (1000000, r"(^| )(m|mn|million)s?( |,|$)"),
    (1000000000, r"(bn|billion)"),
)
BASES = (("nominal", r"nominal"), ("real", r"(real|[0-9]{4} price)"), ("real", r"[0-9]{4}"))
BASE_YEAR = r"(19[0-9]{2}|20[0-9]{2})"

# The parts of a context: [cue] row label sheet name || headers; and of a locator: sheet=NAME!CELL.
CUE = r"^\s*\[([^\]]*)\]"
CUE_PREFIX = r"^\s*\[[^\]]*\]\s*"
SEPARATOR = "||"
SHEET = r"sheet=(.*)!"

# Path fragments of a copy rather than an original, as LIKE patterns over lower case.
COPY_MARKERS = ("%old project files%", "%prior projects%", "%/old/%", "%copy of%", "%backup%", "%- copy%")
