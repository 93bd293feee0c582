import pytest

from geofit.operators import contracts as con
from geofit.operators.registry import registry_frame
from geofit.sources import normalise as no
from geofit.sources import readers, sinks


def strings(spark, columns, rows):
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))


def test_inverse_hhi(spark):
    df = spark.createDataFrame([("one", "a", 1000.0), *[("four", str(i), 100.0) for i in range(4)], ("none", "a", 0.0)], "geo_id string, sector string, emp double")
    got = {r["geo_id"]: r["value"] for r in no.inverse_hhi(df).collect()}
    assert got["one"] == pytest.approx(1.0) and got["four"] == pytest.approx(4.0) and got["none"] is None


def test_latest_value_is_recent_or_missing(spark):
    months = [f"{2023 + m // 12}-{m % 12 + 1:02d}-28" for m in range(24)]
    row = lambda county, **v: ["42", county, *[v.get(f"m{i}", "") for i in range(24)]]
    raw = strings(spark, ["statecodefips", "municipalcodefips", *months], [row("43", m3="1450"), row("45", m3="1", m18="1900"), row("47", m18="7", m23="n/a")])
    assert [r["value"] for r in no.home_values(no.melt_months(raw), "rent").orderBy("geo_id").collect()] == [None, 1900.0, 7.0]


def test_crash_rate_zero_is_real_and_tiny_is_missing(spark):
    crashes = strings(spark, ["state", "county", "fatals"], [("42", "043", "5"), ("42", "999", "9")])
    pop = spark.createDataFrame([("42043", 293029), ("48301", 64), ("06037", 1000000)], "geo_id string, population long")
    got = {r["geo_id"]: r["value"] for r in no.fars_rate(crashes, pop).collect()}
    assert got["42043"] == pytest.approx(5 / 293029 * 100_000) and got["48301"] is None and got["06037"] == 0.0


def test_withheld_rates(spark):
    rows = [("42043", "FA_Deaths", "1-9", "13.1"), ("42043", "Drug_OD", "0", ""), ("06037", "FA_Deaths", "1-9", "-999"), ("06037", "Drug_OD", "*", "3"), ("72127", "FA_Deaths", "10", "5.0")]
    got = no.cdc_injury(strings(spark, ["geoid", "intent", "count_sup", "rate"], rows)).collect()
    assert sorted((r["geo_id"], r["status"], r["value"]) for r in got if r["value"] is not None) == [("42043", "ok", 13.1)]
    assert sorted(r["status"] for r in got) == ["negative", "ok", "suppressed", "suppressed"]


def test_metro_header_is_found_by_content(spark, tmp_path):
    f = tmp_path / "list.csv"
    f.write_text('List 1,,,\nJuly,,,\nCBSA Code,CBSA Title,FIPS State Code,FIPS County Code\n10180,"Abilene, TX",48,059\n99999,"Isla, PR",72,001\nnote,,,\n')
    got = readers.metro_crosswalk(readers.numbered_lines(spark, str(f))).collect()
    assert [(r["geo_id"], r["metro"], r["title"]) for r in got] == [("48059", "10180", "Abilene, TX")]


def test_adherents_over_population_are_flagged(spark):
    got = no.adherence_share(strings(spark, ["fips", "2020 population", "adherents"], [("48269.0", "215", "972"), ("42043", "100", "50"), ("Totals", "1", "1")])).collect()
    assert sorted((r["geo_id"], r["status"]) for r in got) == [("42043", "ok"), ("48269", "over 100%")]


def reg(spark):
    return registry_frame(spark, [dict(indicator_id="rate", geo_level="county", unit="per100k", domain="d", curve="lower_better")])


def test_emit_refuses_and_counts(spark):
    rows = [("county", "42043", "rate", "-999"), ("county", "42043", "rate", "n/a"), ("county", "06037", "rate", "4.5")]
    good = spark.createDataFrame(rows, "geo_level string, geo_id string, indicator_id string, value string")
    assert [r["value"] for r in con.emit_long(good, reg(spark), "f", "v").collect()] == [None, None, 4.5]
    assert con.rejected_markers(good, reg(spark)).first()["n"] == 1
    for bad in (("place", "4212500", "rate", "1"), ("county", "4204", "rate", "1"), ("county", "42043", "nope", "1")):
        records = spark.createDataFrame([bad], good.schema)
        with pytest.raises(Exception, match="malformed key|unregistered|disagrees"):
            con.emit_long(records, reg(spark), "f", "v").collect()
        with pytest.raises(con.ContractError):
            con.require_emit(records, reg(spark))


def test_manifest_round_trip(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    for n in "ab":
        (tmp_path / "raw" / f"{n}.txt").write_text(n * 3)
    recorded = readers.file_manifest(spark, str(tmp_path / "raw"))
    before = spark.createDataFrame(recorded.collect(), recorded.schema)
    (tmp_path / "raw" / "b.txt").write_text("changed")
    (tmp_path / "raw" / "c.txt").write_text("new")
    got = readers.verify_manifest(before, readers.file_manifest(spark, str(tmp_path / "raw"))).collect()
    assert sorted(r["problem"] for r in got) == ["altered", "unrecorded"]


def test_refusals(spark, tmp_path):
    m = spark.createDataFrame([("a", True)], "path string, synthetic boolean")
    with pytest.raises(con.ContractError, match="'path': 'a'"):
        con.assert_no_synthetic(m)
    ranked = spark.createDataFrame([("x", 1, 1, 2), ("y", 2, None, 3)], "geo_id string, rank int, rank_p05 int, rank_p95 int")
    with pytest.raises(con.ContractError, match="rank_p05"):
        con.require_bands(ranked.drop("rank_p05"), "probe")
    with pytest.raises(Exception, match="no band for y"):
        sinks.write_ranking(ranked, str(tmp_path / "out"))
    assert con.require_bands(ranked.where("geo_id = 'x'"), "probe").count() == 1
    assert con.require_bands(ranked.limit(0), "probe").count() == 0
