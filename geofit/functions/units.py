"""One definition of how an indicator value is shown to a person."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units whose value is a fraction shown as a percentage.
FRACTIONS = ("share", "percent")

# Units that cannot be negative; a negative there is a publisher's marker.
NON_NEGATIVE_UNITS = (
    "usd", "usd/month", "people", "people/sqmi", "count", "per10k", "per100k", "years", "share",
    "percent", "ratio", "inches", "miles", "minutes", "ug/m3", "degree_days", "passengers/year",
)

# Unit -> (prefix, decimals, thousands separator, suffix).
SHAPES = {
    "usd/month": ("$", 0, True, "/mo"),
    "degf": ("", 0, False, "°F"),
    "inches": ("", 0, False, '"'),
    "miles": ("", 0, True, " mi"),
    "minutes": ("", 0, False, " min"),
    "people": ("", 0, True, ""),
    "count": ("", 0, True, ""),
    "passengers/year": ("", 0, True, ""),
    "people/sqmi": ("", 0, True, "/sq mi"),
    "per10k": ("", 1, False, " per 10k"),
    "per100k": ("", 1, False, " per 100k"),
    "years": ("", 1, False, " yrs"),
    "ug/m3": ("", 1, False, " µg/m³"),
    "degree_days": ("", 0, True, " deg-days"),
    "index": ("", 1, True, ""),
    "score": ("", 1, True, ""),
}
MISSING = "—"


def _fixed(value: Column, decimals: int, grouped: bool) -> Column:
    # format_number rounds ties to even on the stored double.
    out = F.format_number(value, decimals)
    return out if grouped else F.replace(out, F.lit(","), F.lit(""))


def format_value(value, unit) -> Column:
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    u = F.lower(F.trim(F.coalesce(F.col(unit) if isinstance(unit, str) else unit, F.lit(""))))
    out = (
        F.when(v.isNull(), F.lit(MISSING))
        .when(u.isin(*FRACTIONS), F.concat(_fixed(v * 100, 1, False), F.lit("%")))
        .when(
            u == "usd",
            F.when(v >= 10000, F.concat(F.lit("$"), _fixed(v / 1000, 0, True), F.lit("k"))).otherwise(
                F.concat(F.lit("$"), _fixed(v, 0, True))
            ),
        )
        .when(
            u == "ratio",
            F.when(F.abs(v) < 1, _fixed(v, 3, False)).otherwise(_fixed(v, 2, True)),
        )
    )
    for name, (prefix, decimals, grouped, suffix) in SHAPES.items():
        out = out.when(u == name, F.concat(F.lit(prefix), _fixed(v, decimals, grouped), F.lit(suffix)))
    return out.otherwise(_fixed(v, 1, True))
