"""A small universe with one place for every way a place can be kept or lost."""

import json

import pytest
from pyspark.sql import functions as F

from geofit.operators import universe as uni
from geofit.sources import normalise as no
from geofit.sources import readers

COUNTIES = [("NC", "37183", "Alder County", 35.79, -78.65), ("NC", "37101", "Birch County", 35.52, -78.37), ("NC", "37021", "Cedar County", 35.6, -82.5), ("OR", "41029", "Dogwood County", 42.4, -122.7),
            ("MI", "26077", "Elm County", 42.2, -85.5), ("PA", "42027", "Fir County", 40.9, -77.8), ("MT", "30031", "Gum County", 45.5, -111.2), ("VT", "50007", "Hazel County", 44.5, -73.1),
            ("ME", "23005", "Ivy County", 43.8, -70.3), ("IA", "19113", "Juniper County", 42.1, -91.6), ("PR", "72127", "Kapok Municipio", 18.4, -66.0)]
PLACES = [("NC", "3712000", "Two Rivers city", "25", 35.79, -78.64, 100000), ("NC", "3712100", "Tiny town", "43", 35.51, -78.36, 4000), ("NC", "3712200", "Unbuilt CDP", "57", 35.6, -82.52, 12400),
          ("OR", "4112300", "Wester city", "25", 42.42, -122.72, 31000), ("MI", "2612400", "Uncounted village", "47", 42.23, -85.53, None), ("PA", "4212500", "Quarry borough", "21", 40.91, -77.81, 7400),
          ("MT", "3012600", "Highpass city", "25", 45.54, -111.16, 54000), ("VT", "5012700", "Lakeside city", "25", 44.46, -73.09, 44000), ("ME", "2312800", "Saltflat CDP", "57", 43.79, -70.32, 8600),
          ("IA", "1912900", "Cornfield city", "25", 42.06, -91.59, 26000), ("NC", "3713000", "Unlisted city", "25", 35.7, -78.5, 9000), ("PR", "7213100", "Island city", "25", 18.44, -66.02, 90000),
          ("NC", "3713100", "Nowhere city", "25", None, None, 6000)]
LINKS = [("3712000", "37183", 82000), ("3712000", "37101", 18000), ("3712100", "37101", 6200), ("3712200", "37021", 1), ("4112300", "41029", 1), ("2612400", "26077", 1), ("4212500", "42027", 1),
         ("3012600", "30031", 1), ("5012700", "50007", 1), ("2312800", "23005", 1), ("1912900", "19113", 1), ("7213100", "72127", 1)]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("landed")
    geo = lambda head, rows: "\n".join("\t".join(head) for head in [head] + rows) + "\n"
    txt = lambda v: "" if v is None else str(v)
    (d / "c.txt").write_text(geo([" USPS", "GEOID", "NAME ", "ALAND_SQMI", "INTPTLAT", "INTPTLONG   "], [[u, g, n + "  ", "800", txt(a), txt(b)] for u, g, n, a, b in COUNTIES]))
    (d / "p.txt").write_text(geo(["USPS", "GEOID", "NAME", "LSAD", "ALAND_SQMI", "INTPTLAT", "INTPTLONG"], [[u, g, n, x, "10", txt(a), txt(b)] for u, g, n, x, a, b, _ in PLACES]))
    (d / "x.csv").write_text("place_geoid,county_geoid,weight\n" + "\n".join(f"{a},{b},{w}" for a, b, w in LINKS) + "\n")
    cells = [["NAME", "B01003_001E", "state", "place"]] + [[n, str(p), str(int(g[:2])), g[2:]] for _, g, n, _, _, _, p in PLACES if p]
    (d / "pop.json").write_text(json.dumps(cells))
    pop = no.acs_population(readers.read_json_matrix(spark, str(d / "pop.json")))
    links = uni.crosswalk_normalise(readers.read_delimited_crosswalk(spark, str(d / "x.csv")))
    raw = readers.read_gazetteer(spark, str(d / "c.txt"))
    counties = uni.build_counties(raw, pop)
    disp = uni.place_dispositions(readers.read_gazetteer(spark, str(d / "p.txt")), pop, links, counties).cache()
    report = {r["counter"]: r["n"] for r in uni.universe_report(raw, counties, disp).collect()}
    return report, uni.build_universe(counties, uni.build_places(disp)), uni.place_links(disp, links), disp


def test_golden_counts(built):
    report = built[0]
    assert report == {"counties": 10, "counties_out_of_scope": 1, "places_total": 13, "places_kept": 9, "places_below_floor": 1, "places_no_population": 1, "places_unmatched_county": 1,
                      "places_multi_county": 1, "places_county_by_centroid": 1, "incorporated": 7, "cdp": 2, "places_out_of_scope": 1}


def test_universe_is_sound(built):
    _, universe, links, disp = built
    assert universe.count() == 19 and uni.duplicate_keys(universe).count() == 0
    assert universe.where("geo_level = 'county' and geo_id <> county_geoid").count() == 0
    assert disp.where("geo_id = '3713000'").first()["county_geoid"] == "37183"
    assert disp.where("geo_id = '3712000'").first()["county_geoid"] == "37183"
    shares = links.where("place_geoid = '3712000'").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).first()
    assert (shares["n"], round(shares["w"], 9)) == (2, 1.0)


def test_weights_that_do_not_add_up_are_split_evenly(spark):
    links = spark.createDataFrame([("p", "a", 0.0), ("p", "b", None)], "place_geoid string, county_geoid string, weight double")
    assert [r["weight"] for r in uni.crosswalk_normalise(links).collect()] == [0.5, 0.5]
