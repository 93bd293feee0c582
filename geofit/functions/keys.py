"""Geographic keys: padding, scope and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# State code and postal code of the 50 states and DC.
STATE_USPS = {
    "01": "AL", "02": "AK", "04": "AZ", "05": "AR", "06": "CA", "08": "CO", "09": "CT", "10": "DE", "11": "DC",
    "12": "FL", "13": "GA", "15": "HI", "16": "ID", "17": "IL", "18": "IN", "19": "IA", "20": "KS", "21": "KY",
    "22": "LA", "23": "ME", "24": "MD", "25": "MA", "26": "MI", "27": "MN", "28": "MS", "29": "MO", "30": "MT",
    "31": "NE", "32": "NV", "33": "NH", "34": "NJ", "35": "NM", "36": "NY", "37": "NC", "38": "ND", "39": "OH",
    "40": "OK", "41": "OR", "42": "PA", "44": "RI", "45": "SC", "46": "SD", "47": "TN", "48": "TX", "49": "UT",
    "50": "VT", "51": "VA", "53": "WA", "54": "WV", "55": "WI", "56": "WY",
}

# Digits in a key, by level.
KEY_WIDTH = {"state": 2, "county": 5, "place": 7, "metro": 5, "district": 7}

CDP_CODE = "57"


def text(value) -> Column:
    """A trimmed string; numbers are rendered without a decimal point by the caller."""
    return F.trim((F.col(value) if isinstance(value, str) else value).cast("string"))


def key_fault(value, width: int) -> Column:
    """Why a key component cannot be used, or null when it can."""
    s = text(value)
    return (
        F.when(s.isNull() | ~s.rlike("^[0-9]+$"), F.lit("not numeric"))
        .when(F.length(s) > width, F.lit(f"longer than {width} digits"))
    )


def norm_key(value, width: int) -> Column:
    """Zero-padded key, null when the component is not digits or too long.

    The length is tested first because lpad silently truncates.
    """
    s = text(value)
    return F.when(s.rlike("^[0-9]+$") & (F.length(s) <= width), F.lpad(s, width, "0"))


def county_key(state, county) -> Column:
    return F.concat(norm_key(state, 2), norm_key(county, 3))


def place_key(state, place) -> Column:
    return F.concat(norm_key(state, 2), norm_key(place, 5))


def state_of(key) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.when(F.length(k) >= 2, F.substring(k, 1, 2))


def in_scope(key) -> Column:
    return F.coalesce(state_of(key).isin(*STATE_USPS), F.lit(False))


def usps_of(key) -> Column:
    table = F.create_map(*[F.lit(x) for pair in STATE_USPS.items() for x in pair])
    return F.try_element_at(table, state_of(key))


def classify_place(code, type_text=None) -> Column:
    """'cdp' or 'incorporated'; a descriptive type, where there is one, decides."""
    by_code = F.when(text(code) == CDP_CODE, "cdp").otherwise("incorporated")
    if type_text is None:
        return by_code
    t = F.upper(text(type_text))
    return (
        F.when(t.isNull(), by_code)
        .when(t.contains("DESIGNATED"), "cdp")
        .otherwise("incorporated")
    )


def is_city_unit(key) -> Column:
    """County-level keys 510-840 outside state 02 are cities rather than counties."""
    k = F.col(key) if isinstance(key, str) else key
    suffix = F.substring(k, 3, 3).try_cast("int")
    return F.coalesce(
        (F.length(k) == 5) & (F.substring(k, 1, 2) != "02") & suffix.between(510, 840), F.lit(False)
    )


# Legal suffixes of place names, for display and for name matching.
DISPLAY_SUFFIXES = (
    r"(?i) (metropolitan|metro|consolidated|unified) government \(balance\)$",
    r" \(balance\)$",
    r" (city|town|village|borough|CDP|municipality|plantation)$",
)
MATCH_SUFFIX = r"\s+(County|Parish|Borough|city|town|CDP|Census Area)$"


def clean_name(name) -> Column:
    c = F.col(name) if isinstance(name, str) else name
    for pattern in DISPLAY_SUFFIXES:
        c = F.regexp_replace(c, pattern, "")
    return c


def match_stem(name) -> Column:
    return F.regexp_replace(F.col(name) if isinstance(name, str) else name, MATCH_SUFFIX, "")
