"""Source normalisers: raw string columns to records (geo_level, geo_id, indicator_id, value).

The records go through contracts.emit_long. A missing value is a null row, never a zero.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geofit.functions.keys import county_key, in_scope, norm_key, place_key
from geofit.functions.stats import ratio
from geofit.sources.readers import coalesce_columns

# ------------------------------------------------------------------------- shared helpers


def num(c) -> Column:
    return (F.col(f"`{c}`") if isinstance(c, str) else c).try_cast("double")


def records(df: DataFrame, level: str, indicator, geo="geo_id", value="value") -> DataFrame:
    ind = F.lit(indicator) if isinstance(indicator, str) else indicator
    return df.select(F.lit(level).alias("geo_level"), F.col(geo).alias("geo_id"), ind.alias("indicator_id"),
                     (F.col(value) if isinstance(value, str) else value).alias("value"))


def unpivot_to_long(df: DataFrame, level: str, columns: dict[str, Column]) -> DataFrame:
    """One record per listed indicator and row; the frame carries geo_id."""
    cells = F.array(*[F.struct(F.lit(i).alias("indicator_id"), v.cast("double").alias("value")) for i, v in columns.items()])
    return df.select(F.lit(level).alias("geo_level"), "geo_id", F.inline(cells))


def scoped_counties(df: DataFrame, key: Column) -> DataFrame:
    return df.withColumn("geo_id", key).where(F.col("geo_id").isNotNull() & in_scope("geo_id"))


def month_columns(columns) -> list[str]:
    """Month-end columns (2024-06-30) in file order."""
    return [c for c in columns if len(c) == 10 and c[4] == "-" and c[:4].isdigit()]


def melt_months(wide: DataFrame) -> DataFrame:
    """A file with one column per month in long form: its other columns, month (2024-06-30), value (text)."""
    months = month_columns(wide.columns)
    cells = F.array(*[F.struct(F.lit(m).alias("month"), F.col(m).alias("value")) for m in months])
    return wide.select(*[c for c in wide.columns if c not in months], F.inline(cells))


def with_newest(series: DataFrame) -> DataFrame:
    """series (month, ...) with `at` (first day of the month) and `newest`, that of the last month anywhere in it."""
    at = series.withColumn("at", F.trunc(F.to_date("month"), "month")).withColumn("__k", F.lit(1))
    return at.join(at.agg(F.max("at").alias("newest")).withColumn("__k", F.lit(1)), "__k").drop("__k")


def latest_within(series: DataFrame, by: list[str], window: int = 12) -> DataFrame:
    """by, value: the newest readable value of the last `window` months of the file; null where there is none."""
    v = num("value")
    inside = v.isNotNull() & (F.col("at") > F.add_months("newest", -window))
    return with_newest(series).groupBy(*by).agg(F.max_by(v, F.when(inside, F.col("at"))).alias("value"))


# ------------------------------------------------------------------------- surveys

ACS_VARIABLES = {"B01003_001E": "form_population"}


def matrix_geo(fields: Column) -> tuple[Column, Column]:
    """(level, key) of a matrix row; a place component decides before a county one."""
    place, county = F.try_element_at(fields, F.lit("place")), F.try_element_at(fields, F.lit("county"))
    state = F.nullif(F.try_element_at(fields, F.lit("state")), F.lit(""))
    level = F.when(state.isNull(), None).when(place.isNotNull(), "place").when(county.isNotNull(), "county")
    key = F.when(level == "place", place_key(state, place)).when(level == "county", county_key(state, county))
    return level, key


def acs_ingest(matrix: DataFrame, variables: dict[str, str] = ACS_VARIABLES) -> DataFrame:
    """Mapped variables of a parsed matrix (column `fields`) as records."""
    level, key = matrix_geo(F.col("fields"))
    names = F.create_map(*[F.lit(x) for pair in variables.items() for x in pair])
    return (
        matrix.select(level.alias("geo_level"), key.alias("geo_id"), F.explode("fields").alias("var", "value"))
        .withColumn("indicator_id", F.try_element_at(names, F.col("var")))
        .where(F.col("indicator_id").isNotNull() & F.col("geo_level").isNotNull() & in_scope("geo_id"))
        .select("geo_level", "geo_id", "indicator_id", "value")
    )


def acs_population(matrix: DataFrame, variable: str = "B01003_001E") -> DataFrame:
    """Population by key; unreadable or negative counts are left out."""
    _, key = matrix_geo(F.col("fields"))
    pop = num(F.try_element_at("fields", F.lit(variable))).cast("bigint")
    return matrix.select(key.alias("geo_id"), pop.alias("population")).where(
        in_scope("geo_id") & (F.col("population") >= 0)
    )


# Key prefixes of the bulk survey files.
BULK_PREFIX = {"1600000US": "place", "0500000US": "county"}


def acs_bulk_scan(raw: DataFrame, variable: str) -> DataFrame:
    """geo_id, value from one bulk table; suppressed cells (negative) are left out."""
    geo = F.regexp_extract("geo_id", "^(?:" + "|".join(BULK_PREFIX) + ")(.*)$", 1)
    return (
        raw.select(F.nullif(geo, F.lit("")).alias("geo_id"), num(variable).cast("bigint").alias("value"))
        .where(in_scope("geo_id") & (F.col("value") >= 0))
    )


# Indicator -> (numerator, denominator, level) over bulk table cells.
ACS_RATIOS = {
    "cost_property_tax_rate": ("b25103_e001", "b25077_e001", "county"),
    "cost_income_to_home_ratio": ("b25077_e001", "b19013_e001", "place"),
    "form_mean_commute": ("b08013_e001", "b08303_e001", "place"),
    "sens_foreign_born_share": ("b05002_e013", "b05002_e001", "place"),
    "comm_same_house_1yr": ("b07003_e004", "b07003_e001", "place"),
    "comm_median_age": ("b01002_e001", None, "place"),
    "form_population": ("b01003_e001", None, "place"),
}
LEVEL_WIDTH = {"county": 5, "place": 7}


def acs_ratio_indicators(cells: DataFrame, ratios: dict = ACS_RATIOS) -> DataFrame:
    """Ratios across bulk tables from one long frame of cells (geo_id, variable, value).

    Each place's cells come together once, whatever number of ratios use them.
    """
    wanted = sorted({v for n, d, _ in ratios.values() for v in (n, d) if v})
    wide = cells.where(F.col("variable").isin(*wanted)).groupBy("geo_id").agg(
        *[F.max(F.when(F.col("variable") == v, F.col("value").cast("double"))).alias(v) for v in wanted]
    )
    rows = []
    for indicator, (n, d, level) in ratios.items():
        here = F.col(n).isNotNull() & (F.length("geo_id") == LEVEL_WIDTH[level])
        value = ratio(F.col(n), F.col(d)) if d else F.col(n)
        rows.append(F.when(here, F.struct(F.lit(level).alias("geo_level"), F.lit(indicator).alias("indicator_id"), value.alias("value"))))
    return (
        wide.select("geo_id", F.explode(F.array(*rows)).alias("r"))
        .where(F.col("r").isNotNull())
        .select("r.geo_level", "geo_id", "r.indicator_id", "r.value")
    )


def density(universe: DataFrame, population: DataFrame, indicator: str = "form_population_density") -> DataFrame:
    places = universe.where(F.col("geo_level") == "place").select("geo_id", "land_sqmi")
    joined = places.join(population.select("geo_id", F.col("population").cast("double").alias("p")), "geo_id", "left")
    return records(joined, "place", indicator, value=F.when(F.col("land_sqmi") > 0, F.col("p") / F.col("land_sqmi")))


# ------------------------------------------------------------------------- population estimates

SUMLEV_COUNTY, SUMLEV_PLACE, SUMLEV_PLACE_COUNTY = "050", "162", "157"
POP_COLUMN = "popestimate2024"


def pep_population(raw: DataFrame, level: str, column: str = POP_COLUMN) -> DataFrame:
    code, key = (
        (SUMLEV_COUNTY, county_key("state", "county")) if level == "county" else (SUMLEV_PLACE, place_key("state", "place"))
    )
    return (
        raw.where(F.col("sumlev") == code)
        .select(key.alias("geo_id"), num(column).cast("bigint").alias("population"))
        .where(in_scope("geo_id") & F.col("population").isNotNull())
    )


def pep_place_county_weights(raw: DataFrame, column: str = POP_COLUMN) -> DataFrame:
    return (
        raw.where(F.col("sumlev") == SUMLEV_PLACE_COUNTY)
        .select(
            place_key("state", "place").alias("place_geoid"), county_key("state", "county").alias("county_geoid"),
            num(column).cast("bigint").alias("weight"),
        )
        .where(in_scope("place_geoid") & F.col("weight").isNotNull())
    )


# ------------------------------------------------------------------------- business and jobs

# Industry code as padded in the file -> indicator; and the codes also kept as totals.
NAICS_RATES = {
    "722///": "amen_food_drink_per10k",
    "71----": "amen_arts_rec_per10k",
    "445///": "amen_grocery_per10k",
    "713940": "amen_fitness_per10k",
    "------": "amen_establishments_per10k",
}
NAICS_TOTALS = {"722///": "amen_food_drink_total", "71----": "amen_arts_rec_total"}
CBP_POPULATION_FLOOR = 10_000


def cbp_rates(raw: DataFrame, population: DataFrame, rates=NAICS_RATES, totals=NAICS_TOTALS) -> DataFrame:
    """Establishments per 10,000 people (at least 10,000 in the denominator), and two raw totals."""
    as_map = lambda d: F.create_map(*[F.lit(x) for pair in d.items() for x in pair])
    est, pop = F.col("__est"), F.col("population")
    rate = F.when(pop > 0, est / F.greatest(pop, F.lit(CBP_POPULATION_FLOOR)) * 10_000)
    naics = F.trim("naics")
    rows = (
        scoped_counties(raw.where(naics.isin(*rates)), county_key("fipstate", "fipscty"))
        .withColumn("__est", num("est"))
        .where(est.isNotNull())
        .join(population.select("geo_id", "population"), "geo_id", "left")
    )
    cells = F.array(
        F.struct(F.try_element_at(as_map(rates), naics).alias("indicator_id"), rate.alias("value")),
        F.struct(F.try_element_at(as_map(totals), naics).alias("indicator_id"), est.alias("value")),
    )
    return rows.select(F.lit("county").alias("geo_level"), "geo_id", F.inline(cells)).where("indicator_id is not null")


AGG_SECTOR, AGG_TOTAL, OWN_TOTAL = "74", "70", "0"


def _qcew(raw: DataFrame) -> DataFrame:
    area = F.trim("area_fips")
    return raw.where(area.rlike("^[0-9]{5}$") & in_scope(area)).select(
        area.alias("geo_id"), F.trim("agglvl_code").alias("agglvl"), F.trim("own_code").alias("own"),
        F.trim("industry_code").alias("sector"), num(F.coalesce(F.nullif(F.trim("annual_avg_emplvl"), F.lit("")), F.lit("0"))).alias("emp"),
    ).where(F.col("emp").isNotNull())


def qcew_sectors(raw: DataFrame) -> DataFrame:
    """Employment per county and sector, summed over ownership."""
    return _qcew(raw).where((F.col("agglvl") == AGG_SECTOR) & (F.col("sector") != "")).groupBy("geo_id", "sector").agg(
        F.sum("emp").alias("emp")
    )


def qcew_totals(raw: DataFrame) -> DataFrame:
    return _qcew(raw).where((F.col("agglvl") == AGG_TOTAL) & (F.col("own") == OWN_TOTAL)).groupBy("geo_id").agg(
        F.max("emp").alias("emp")
    )


def inverse_hhi(sectors: DataFrame, by: str = "geo_id", amount: str = "emp") -> DataFrame:
    """Effective number of sectors: total squared over the sum of squares of the positive ones."""
    e = F.col(amount)
    sums = sectors.groupBy(by).agg(F.sum(e).alias("t"), F.sum(F.when(e > 0, e * e)).alias("s2"))
    return sums.select(by, F.when((F.col("t") > 0) & (F.col("s2") > 0), F.col("t") * F.col("t") / F.col("s2")).alias("value"))


def employment_growth(now: DataFrame, prior: DataFrame) -> DataFrame:
    """Percent change in employment; null where the earlier figure is absent or not positive."""
    then = F.col("then")
    return now.join(prior.select("geo_id", F.col("emp").alias("then")), "geo_id", "left").select(
        "geo_id", F.when(then > 0, (F.col("emp") - then) / then * 100.0).alias("value")
    )


# ------------------------------------------------------------------------- climate and air travel

# Climate-normal column -> indicator.
NORMALS = {
    "djf-tavg-normal": "climate_temp_winter_mean",
    "jja-tavg-normal": "climate_temp_summer_mean",
    "djf-tmin-normal": "climate_winter_low",
    "jja-tmax-normal": "climate_summer_high",
    "ann-prcp-normal": "climate_annual_precip",
    "ann-snow-normal": "climate_annual_snowfall",
    "ann-htdd-normal": "climate_heating_degree_days",
    "ann-cldd-normal": "climate_cooling_degree_days",
}


def station_number(c) -> Column:
    v = num(c)
    return F.when(v > -999, v)


def station_readings(raw: DataFrame, fields: dict[str, str] = NORMALS) -> DataFrame:
    """station_id, lat, lon, indicator_id, value: readings a station actually reports."""
    cells = F.array(*[
        F.struct(F.lit(i).alias("indicator_id"), station_number(c).alias("value"))
        for c, i in fields.items() if c in raw.columns
    ])
    return (
        raw.select(F.col("station").alias("station_id"), station_number("latitude").alias("lat"),
                   station_number("longitude").alias("lon"), F.inline(cells))
        .where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("value").isNotNull())
    )


EUROPE_CODES = (400, 499)
MIN_HUB_PASSENGERS = 10_000


def hub_summary(segments: DataFrame, min_passengers: float = MIN_HUB_PASSENGERS) -> DataFrame:
    """hub, destinations, passengers of airports with real service to the area.

    Grouping by (hub, destination) first keeps the distinct count a plain count.
    """
    low, high = EUROPE_CODES
    wac = F.col("fg_wac").try_cast("int")
    total = num(F.coalesce(F.nullif(F.trim("total"), F.lit("")), F.lit("0")))
    return (
        segments.where(wac.between(low, high) & (F.lower("type") == "passengers") & total.isNotNull())
        .where((F.coalesce("usg_apt", F.lit("")) != "") & (F.coalesce("fg_apt", F.lit("")) != ""))
        .groupBy(F.col("usg_apt").alias("hub"), "fg_apt").agg(F.sum(total).alias("p"))
        .groupBy("hub").agg(F.count(F.lit(1)).alias("destinations"), F.sum("p").alias("passengers"))
        .where(F.col("passengers") >= min_passengers)
    )


def read_airports(raw: DataFrame) -> DataFrame:
    """hub, lat, lon from the headerless airport table (columns 5, 7 and 8)."""
    c = raw.columns
    code = F.trim(F.replace(F.col(c[4]), F.lit('"'), F.lit("")))
    return raw.select(code.alias("hub"), num(c[6]).alias("lat"), num(c[7]).alias("lon")).where(
        (F.length("hub") == 3) & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    )


# ------------------------------------------------------------------------- safety, hazard, health

# Intent -> indicator, and the markers of a withheld cell.
INTENTS = {"FA_Deaths": "safety_firearm_death_rate", "Drug_OD": "safety_overdose_death_rate"}
WITHHELD = ("", "*", "suppressed", "unreliable", "na", "n/a")


def cdc_injury(raw: DataFrame) -> DataFrame:
    """Records plus `status`: ok, suppressed, or negative (a numeric marker)."""
    names = F.create_map(*[F.lit(x) for pair in INTENTS.items() for x in pair])
    rate = num("rate")
    count = F.lower(F.trim(F.coalesce("count_sup", F.lit(""))))
    withheld = count.isin(*WITHHELD) | F.col("rate").isNull() | F.col("rate").isin(*WITHHELD) | rate.isNull()
    return (
        scoped_counties(raw.withColumn("indicator_id", F.try_element_at(names, F.trim("intent"))), norm_key("geoid", 5))
        .where(F.col("indicator_id").isNotNull())
        .withColumn("status", F.when(withheld, "suppressed").when(rate < 0, "negative").otherwise("ok"))
        .select(F.lit("county").alias("geo_level"), "geo_id", "indicator_id",
                F.when(F.col("status") == "ok", rate).alias("value"), "status")
    )


# Hazard score columns -> indicators, and the 17 loss-of-life columns.
HAZARD_SCORES = {
    "RISK_SCORE": "hazard_nri_composite",
    "HRCN_RISKS": "hazard_nri_hurricane",
    "WFIR_RISKS": "hazard_nri_wildfire",
    "HWAV_RISKS": "hazard_nri_heatwave",
    "DRGT_RISKS": "hazard_nri_drought",
    "TRND_RISKS": "hazard_nri_tornado",
}
# Columns of expected deaths in the hazard file.
HAZARD_LOSSES = (
    "AVLN_EALP", "CFLD_EALP", "CWAV_EALP", "ERQK_EALP", "HAIL_EALP", "HWAV_EALP", "HRCN_EALP", "ISTM_EALP", "LNDS_EALP",
    "LTNG_EALP", "IFLD_EALP", "SWND_EALP", "TRND_EALP", "TSUN_EALP", "VLCN_EALP", "WFIR_EALP", "WNTW_EALP",
)


def nri_hazards(raw: DataFrame, scores=HAZARD_SCORES, losses=HAZARD_LOSSES) -> DataFrame:
    """Six hazard scores (blank is not assessed) and expected deaths per 100,000 residents."""
    have = [F.col(c).try_cast("double") for c in losses if c in raw.columns]
    present = F.filter(F.array(*have) if have else F.array().cast("array<double>"), lambda x: x.isNotNull())
    pop = num("POPULATION")
    deaths = F.when(
        (F.size(present) > 0) & (pop != 0), F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / pop * 100_000
    )
    columns = {"hazard_fatality_risk_per100k": deaths}
    columns.update({i: (num(c) if c in raw.columns else F.lit(None)) for c, i in scores.items()})
    return unpivot_to_long(scoped_counties(raw, norm_key("STCOFIPS", 5)), "county", columns)


UNKNOWN_COUNTIES = ("0", "997", "998", "999")
CRASH_POPULATION_FLOOR = 1_000


def fars_rate(crashes: DataFrame, population: DataFrame) -> DataFrame:
    """Road deaths per 100,000 for every county with a population.

    No crash is a real zero; a population under 1,000 has no rate.
    """
    fatals = num(F.coalesce(F.nullif(F.trim("fatals"), F.lit("")), F.lit("0"))).cast("bigint")
    deaths = (
        crashes.where(~F.trim("county").isin(*UNKNOWN_COUNTIES) & (F.trim("state") != ""))
        .select(county_key("state", "county").alias("geo_id"), fatals.alias("fatals"))
        .where(in_scope("geo_id"))
        .groupBy("geo_id").agg(F.sum("fatals").alias("deaths"))
    )
    pop = F.col("population")
    return records(
        population.join(deaths, "geo_id", "left"), "county", "safety_traffic_fatality_rate",
        value=F.when(pop >= CRASH_POPULATION_FLOOR, F.coalesce("deaths", F.lit(0)) / pop * 100_000),
    )


PM25_PARAMETER, PM25_METRIC = "PM2.5 - Local Conditions", "Daily Mean"


def pm25_mean(raw: DataFrame) -> DataFrame:
    rows = raw.where(
        (F.trim("parameter name") == PM25_PARAMETER) & F.col("metric used").contains(PM25_METRIC)
    ).withColumn("__v", num("arithmetic mean"))
    means = scoped_counties(rows.where("__v is not null"), county_key("`state code`", "`county code`")).groupBy(
        "geo_id"
    ).agg(F.avg("__v").alias("value"))
    return records(means, "county", "env_pm25_annual")


# Measure column -> indicator; the one published upside down.
MEASURES = {
    "Life Expectancy raw value": "health_life_expectancy",
    "Primary Care Physicians raw value": "health_pcp_ratio",
    "Social Associations raw value": "comm_social_associations",
    "Access to Parks raw value": "rec_park_access",
    "Unemployment raw value": "econ_unemployment_rate",
}
INVERTED = ("health_pcp_ratio",)


def chr_measures(raw: DataFrame, measures=MEASURES, fips: str = "5-digit FIPS Code") -> DataFrame:
    """Measures to long; state rollups dropped; one measure turned into people per provider."""
    def value(column, indicator):
        v = num(column)
        return F.when(v > 0, 1.0 / v) if indicator in INVERTED else v

    rows = scoped_counties(raw, norm_key(F.col(f"`{fips}`"), 5)).where(~F.col("geo_id").endswith("000"))
    return unpivot_to_long(rows, "county", {i: value(c, i) for c, i in measures.items() if c in raw.columns})


def absent_measures(raw: DataFrame, measures=MEASURES) -> list[str]:
    return sorted(m for m in measures if m not in raw.columns)


def available_measures(raw: DataFrame) -> list[str]:
    """Every measure column of the file, read from its schema."""
    return sorted(c for c in raw.columns if c.endswith("raw value"))


# ------------------------------------------------------------------------- civic

EXCLUDED_MARGIN_STATES = ("02",)


def partisan_margin(raw: DataFrame) -> DataFrame:
    """Signed two-party margin; one state is out because its codes collide with districts."""
    a, b = num("per_gop"), num("per_dem")
    rows = scoped_counties(raw, norm_key("county_fips", 5)).where(
        ~F.substring("geo_id", 1, 2).isin(*EXCLUDED_MARGIN_STATES) & (a + b > 0)
    )
    return records(rows, "county", "sens_partisan_lean", value=(a - b) / (a + b))


def adherence_share(raw: DataFrame) -> DataFrame:
    """Records plus `status`; a share over 1 is dropped by the caller's filter, not clipped."""
    pop, n = num("2020 population"), num("adherents")
    fips = F.regexp_replace(F.trim("fips"), r"\.0$", "")
    share = n / pop
    return (
        scoped_counties(raw, norm_key(fips, 5)).where((pop > 0) & n.isNotNull())
        .withColumn("status", F.when(share > 1.0, "over 100%").otherwise("ok"))
        .select(F.lit("county").alias("geo_level"), "geo_id", F.lit("sens_religious_adherence").alias("indicator_id"),
                share.alias("value"), "status")
    )


CHILDCARE = {"mcinfant": "family_childcare_cost_infant", "mctoddler": "family_childcare_cost_toddler"}
WEEKS_PER_YEAR = 52


def childcare_annual(raw: DataFrame, year: int = 2018) -> DataFrame:
    """Weekly prices of the latest study year as annual; only positive prices count."""
    fips = F.regexp_replace(F.trim("county_fips_code"), r"\.0$", "")
    rows = scoped_counties(raw.where(num("studyyear") == year), norm_key(fips, 5))
    long = unpivot_to_long(rows, "county", {i: num(c) for c, i in CHILDCARE.items()})
    return long.where(F.col("value") > 0).withColumn("value", F.col("value") * WEEKS_PER_YEAR)


def rpp_to_county(raw: DataFrame, metros: DataFrame, year: str = "2023") -> DataFrame:
    """Metro price parity on member counties; a county without one stays missing.

    metros: geo_id (county), metro.
    """
    by_metro = (
        raw.where(F.trim("linecode") == "1")
        .select(F.trim(F.replace(F.col("geofips"), F.lit('"'), F.lit(""))).alias("metro"), num(year).alias("value"))
        .where(F.col("value").isNotNull() & (F.col("metro") != ""))
        .groupBy("metro").agg(F.max("value").alias("value"))
    )
    return records(metros.select("geo_id", "metro").join(by_metro, "metro", "left"), "county", "cost_price_parity")


# ------------------------------------------------------------------------- education

ALL_STUDENTS = ("race", "disability", "econ_disadvantaged", "lep", "homeless", "foster_care")
GRADES = 13
MIN_COHORT_COVERAGE = 0.5
MIN_STAFF_COVERAGE = 0.5
MAX_BIN_WIDTH = 20


def _count(c: str) -> Column:
    v = num(c)
    return F.when(v >= 0, v)


def school_districts(directory: DataFrame) -> DataFrame:
    """district -> in-scope county with enrolment and staff."""
    rows = directory.where((F.coalesce(F.trim("leaid"), F.lit("")) != "") & (F.coalesce("county_code", F.lit("")) != ""))
    return scoped_counties(rows, norm_key("county_code", 5)).select(
        F.trim("leaid").alias("leaid"), F.col("geo_id").alias("county"),
        _count("enrollment").alias("enrollment"), _count("teachers_total_fte").alias("teachers"),
    )


def district_counties(districts: DataFrame) -> DataFrame:
    return districts.groupBy("leaid").agg(F.max("county").alias("county"))


def county_enrolment(districts: DataFrame) -> DataFrame:
    paired = (F.col("teachers") > 0) & (F.col("enrollment") > 0)
    return districts.groupBy("county").agg(
        F.coalesce(F.sum("enrollment"), F.lit(0.0)).alias("enrolled"),
        F.coalesce(F.sum(F.when(paired, F.col("enrollment"))), F.lit(0.0)).alias("covered"),
        F.coalesce(F.sum(F.when(paired, F.col("teachers"))), F.lit(0.0)).alias("teachers"),
        F.count_if(F.col("enrollment") > 0).alias("districts"),
    )


def _everyone() -> Column:
    """Rows of graduation rates that speak for all students."""
    return reduce(lambda a, b: a & b, [F.col(axis).try_cast("int") == 99 for axis in ALL_STUDENTS])


def education_rollup(directory: DataFrame, finance: DataFrame, grads: DataFrame) -> DataFrame:
    """Districts to counties: staffing ratio, district count, spending per pupil, graduation.

    A ratio or rate stands only if the districts behind it cover half of what they speak for.
    """
    districts = school_districts(directory)
    where_is = district_counties(districts)
    enrolment = county_enrolment(districts)
    staffed = (F.col("teachers") > 0) & (F.col("covered") > 0) & (
        (F.col("enrolled") == 0) | (F.col("covered") >= MIN_STAFF_COVERAGE * F.col("enrolled"))
    )
    base = enrolment.withColumnRenamed("county", "geo_id")
    staffing = records(base.where(staffed), "county", "edu_student_teacher_ratio", value=F.col("covered") / F.col("teachers"))
    choice = records(base.where("districts > 0"), "county", "edu_district_choice_count", value=F.col("districts").cast("double"))

    spend = (
        finance.select(F.trim("leaid").alias("leaid"), _count("exp_current_elsec_total").alias("spend"),
                       _count("enrollment_fall_responsible").alias("pupils"))
        .where(F.col("spend").isNotNull() & (F.col("pupils") > 0))
        .join(where_is, "leaid")
        .groupBy(F.col("county").alias("geo_id")).agg((F.sum("spend") / F.sum("pupils")).alias("value"))
    )
    width = num("grad_rate_high") - num("grad_rate_low")
    rates = (
        grads.where(_everyone())
        .where(F.coalesce(width, F.lit(0.0)) <= MAX_BIN_WIDTH)
        .select(F.trim("leaid").alias("leaid"), _count("grad_rate_midpt").alias("rate"), _count("cohort_num").alias("cohort"))
        .where(F.col("rate").isNotNull() & (F.col("cohort") > 0))
        .join(where_is, "leaid")
        .groupBy("county")
        .agg((F.sum(F.col("rate") / 100.0 * F.col("cohort")) / F.sum("cohort")).alias("value"), F.sum("cohort").alias("cohort"))
        .join(enrolment.select("county", "enrolled"), "county", "left")
        .where((F.coalesce("enrolled", F.lit(0.0)) == 0) | (F.col("cohort") >= MIN_COHORT_COVERAGE * F.col("enrolled") / GRADES))
        .withColumnRenamed("county", "geo_id")
    )
    return (
        staffing.unionByName(choice)
        .unionByName(records(spend, "county", "edu_spend_per_pupil"))
        .unionByName(records(rates, "county", "edu_graduation_rate"))
    )


def education_rejects(directory: DataFrame, finance: DataFrame, grads: DataFrame) -> DataFrame:
    """What the roll-up left out, as (reason, n)."""
    districts = school_districts(directory)
    enrolment = county_enrolment(districts)
    no_county = directory.agg(
        F.count_if((F.coalesce(F.trim("leaid"), F.lit("")) == "") | (F.coalesce("county_code", F.lit("")) == "")).alias("n")
    ).select(F.lit("districts_without_county").alias("reason"), "n")
    thin = enrolment.agg(
        F.count_if((F.col("teachers") > 0) & (F.col("covered") > 0) & (F.col("enrolled") > 0)
                   & (F.col("covered") < MIN_STAFF_COVERAGE * F.col("enrolled"))).alias("a"),
        F.count_if(F.col("districts") == 0).alias("b"),
    ).select(F.inline(F.array(
        F.struct(F.lit("ratios_dropped_unrepresentative").alias("reason"), F.col("a").alias("n")),
        F.struct(F.lit("counties_without_a_district").alias("reason"), F.col("b").alias("n")),
    )))
    mapped = district_counties(districts)
    spend_markers = finance.join(mapped, "leaid", "left_semi").agg(
        F.count_if(num("exp_current_elsec_total") < 0).alias("n")
    ).select(F.lit("spend_markers_rejected").alias("reason"), "n")
    usable = _count("grad_rate_midpt").isNotNull() & (_count("cohort_num") > 0)
    wide = grads.where(_everyone() & usable).join(mapped, "leaid", "left_semi").agg(
        F.count_if(num("grad_rate_high") - num("grad_rate_low") > MAX_BIN_WIDTH).alias("n")
    ).select(F.lit("grad_bins_too_wide").alias("reason"), "n")
    return no_county.unionByName(thin).unionByName(spend_markers).unionByName(wide)


# ------------------------------------------------------------------------- prices, amenities, movers


def home_values(series: DataFrame, indicator: str, window: int = 12) -> DataFrame:
    """County price series (statecodefips, municipalcodefips, month, value) to the newest value of the last year."""
    rows = latest_within(scoped_counties(series, county_key("statecodefips", "municipalcodefips")), ["geo_id"], window)
    return records(rows, "county", indicator)


def zip_values(series: DataFrame, window: int = 12) -> DataFrame:
    """zcta, state, value: ZIP price series (regionname, state, month, value) to the newest value of the last year."""
    keyed = series.select(F.lpad(F.trim("regionname"), 5, "0").alias("zcta"), F.trim("state").alias("state"), "month", "value")
    return latest_within(keyed, ["zcta", "state"], window).where(F.col("zcta").rlike("^[0-9]+$") & F.col("value").isNotNull())


def zip_place_overlap(raw: DataFrame) -> DataFrame:
    """zcta, place, overlapping land and the place's land."""
    area = lambda c: F.coalesce(num(c), F.lit(0.0))
    return raw.select(
        F.nullif(F.trim("geoid_zcta5_20"), F.lit("")).alias("zcta"), F.nullif(F.trim("geoid_place_20"), F.lit("")).alias("place"),
        area("arealand_part").alias("part"), area("arealand_place_20").alias("place_land"),
    ).where(F.col("zcta").isNotNull() & F.col("place").isNotNull())


AMENITY_FIPS = ("fips", "fips code", "fipscode", "geoid", "stcofips")
AMENITY_SCALE = ("natural amenities scale", "scale", "amenity_scale", "nat_amen_scale")


def amenity_scale(raw: DataFrame) -> DataFrame:
    """Amenity scale under any of its column names; water as a share; terrain code."""
    columns = {"env_natural_amenities": coalesce_columns(raw, AMENITY_SCALE).try_cast("double")}
    if "water percent" in raw.columns:
        columns["env_water_area_share"] = num("water percent") / 100.0
    if "topography" in raw.columns:
        columns["env_topographic_variation"] = num("topography")
    return unpivot_to_long(scoped_counties(raw, norm_key(coalesce_columns(raw, AMENITY_FIPS), 5)), "county", columns)


DOMESTIC_TOTAL = "97"


def _movers(flows: DataFrame, name: str) -> DataFrame:
    """flows: state, county, marker, people (text, by position in the file)."""
    people = F.col("people").try_cast("bigint")
    return (
        flows.where((F.trim("marker") == DOMESTIC_TOTAL) & (people >= 0))
        .select(county_key("state", "county").alias("geo_id"), people.alias("p"))
        .groupBy("geo_id").agg(F.max("p").alias(name))
    )


def migration_flows(inflow: DataFrame, outflow: DataFrame) -> DataFrame:
    """Net domestic movers per county; a county in either file counts."""
    both = _movers(inflow, "i").join(_movers(outflow, "o"), "geo_id", "full_outer")
    return both.select("geo_id", (F.coalesce("i", F.lit(0)) - F.coalesce("o", F.lit(0))).alias("net_migration"))
