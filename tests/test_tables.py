"""Weather, landscapes, files, documents, catalogs and streaming on small fixtures."""

import datetime as dt
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from firegrid import Grid, MissingColumnsError
from firegrid.operators import algebra, climatology, quantiles, reporting, scenarios, synthetic, treatment, windrose
from firegrid.operators.change import check_types, sdi_change
from firegrid.operators.zonal import zonal_categorical, zonal_continuous
from firegrid.plans.weather_bundle import weather_bundle
from firegrid.sources import ascii_grid, catalog, documents, store
from firegrid.sources import tables as src
from firegrid.streaming.windrose import rose_from_counts, stream_bin_counts


@pytest.mark.parametrize("steps", [4, 1000])
def test_exact_quantiles_with_a_hot_group(spark, steps):
    rnd = random.Random(1)
    rows = [("hot", float(rnd.randrange(4000))) for _ in range(6000)]
    rows += [("flat", 3.0)] * 500 + [("one", 5.0), ("two", 1.0), ("two", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    out = quantiles.exact_quantiles(df, ["k"], {"v": "v", "w": -F.col("v")}, probs, steps=steps)
    got = {(r["k"], r["measure"]): (r["n"], r["q"]) for r in out.collect()}
    for k in ("hot", "flat", "one", "two"):
        values = [v for a, v in rows if a == k]
        for m, sign in (("v", 1), ("w", -1)):
            n, q = got[(k, m)]
            assert n == len(values)
            assert q == pytest.approx(list(np.quantile([sign * v for v in values], probs)))
    assert ("none", "v") not in got


def season(spark, values):
    rows = [("1", dt.date(y, m, d), y, float(e)) for y, m, d, e in values]
    return spark.createDataFrame(rows, "pyrome string, date date, year int, erc double")


def test_season_is_leap_safe_filled_and_complete(spark):
    wx = season(spark, [(2019, 4, 1, 10), (2019, 4, 1, 20), (2020, 4, 1, 40), (2021, 4, 2, 7), (2020, 10, 31, 5), (2020, 11, 1, 99), (2020, 3, 31, 99)])
    got = {(r["year"], r["dos"]): (r["erc"], r["filled"]) for r in climatology.season_erc(wx).collect()}
    assert len(got) == 3 * 214
    assert got[(2019, 1)] == (15.0, False) and got[(2020, 1)] == (40.0, False)
    assert got[(2021, 1)] == (27.5, True)
    assert got[(2019, 214)] == (5.0, True) and got[(2020, 100)] == (None, True)


def test_current_window_and_rounding(spark):
    rows = [("1", y, d, float(e)) for y, e in ((2000, 1), (2001, 2)) for d in range(1, 215)]
    s = spark.createDataFrame(rows, "pyrome string, year int, dos int, erc double")
    out = climatology.current_erc(s, 10, 5)
    assert out.count() == 5 and {r["erc"] for r in out.collect()} == {2}  # 1.5 rounds to even
    with pytest.raises(ValueError, match="past 214"):
        climatology.current_erc(s, 200, 79)
    stats = climatology.erc_stats(s).where("dos = 1").first()
    assert (stats["erc_avg"], stats["erc_std"]) == (1.5, 0.71)


def weather(spark, ercs, doy=200):
    rows = [("1", dt.date(2001, 7, 19), 2001, doy, float(e), 8.0, 90.0, 20.0, 50.0) for e in ercs]
    return spark.createDataFrame(
        rows, "pyrome string, date date, year int, doy int, erc double, fm100 double, tmmx_f double, rmin double, tmmn_f double"
    )


def test_erc_classes_share_limits_and_fall_back(spark):
    out = climatology.erc_classes(weather(spark, [0, 10])).orderBy("class").collect()
    assert [(r["lower"], r["upper"]) for r in out] == [(8, 10), (6, 8), (4, 6), (2, 4), (0, 2)]
    emc = 2.22749 + 0.160107 * 20 - 0.014784 * 90
    assert {r["fm1"] for r in out} == {round(1.03 * emc, 1)}  # empty classes use the whole record
    assert [r["spot_dist"] for r in out] == [360, 300, 240, 180, 120]
    with pytest.raises(ValueError, match="spotting"):
        climatology.erc_classes(weather(spark, [1]), n_classes=3)


def test_day_window_wraps_the_year(spark):
    d = spark.range(1, 367).select(F.col("id").cast("int").alias("doy"))
    inside = lambda c: {r["doy"] for r in d.where(climatology.doy_in_window("doy", F.lit(c))).collect()}
    assert inside(5) == set(range(1, 20)) | set(range(357, 367))
    assert inside(360) == set(range(346, 367)) | set(range(1, 9))
    assert inside(100) == set(range(86, 115))


def test_scenario_moistures_need_records(spark):
    wx = weather(spark, [1, 2, 3])
    scen = spark.createDataFrame([("1", 20)], "pyrome string, scenario_doy int")
    with pytest.raises(ValueError, match="no weather records"):
        climatology.scenario_fuel_moistures(wx, scen)


def test_wind_rose_bins_and_calm(spark):
    rows = [("a", 1.9, 10.0), ("a", 2.0, 0.0), ("a", 5.0, 360.0), ("a", 31.0, 90.0)]
    obs = spark.createDataFrame(rows, "pyrome_id string, ws_mph double, wd_deg double")
    out = windrose.wind_cells(obs)
    assert out.count() == 48 and out.agg(F.sum("pct")).first()[0] == pytest.approx(100)
    full = {(r["speed_bin"], r["dir_bin"]): r["pct"] for r in out.where("pct > 0").collect()}
    assert full == {(0, 7): pytest.approx(200 / 3), (5, 1): pytest.approx(100 / 3)}
    assert out.first()["calm_pct"] == 25.0
    calm = obs.withColumn("ws_mph", F.lit(1.0))
    with pytest.raises(Exception, match="calm"):
        windrose.wind_cells(calm).collect()
    assert windrose.wind_cells(calm, strict=False).count() == 0


def test_wind_rose_missing_directions_and_regions(spark):
    rows = [("a", 5.0, 90.0), ("a", 5.0, None), (None, 9.0, 90.0), ("a", None, 10.0)]
    obs = spark.createDataFrame(rows, "pyrome_id string, ws_mph double, wd_deg double")
    out = windrose.wind_cells(obs)
    assert out.count() == 48 and out.agg(F.sum("pct")).first()[0] == pytest.approx(100)
    full = {(r["speed_bin"], r["dir_bin"]): r["pct"] for r in out.where("pct > 0").collect()}
    assert full == {(0, 1): pytest.approx(50), (0, 7): pytest.approx(50)}


def test_streamed_rose_equals_batch(spark, tmp_path):
    rows = [
        (i, None if i % 41 == 0 else "a" if i % 3 else "b", dt.datetime(2024, 1, 1 + i % 20, i % 24), float(i % 37),
         None if i % 13 == 0 else float(i * 7 % 361))
        for i in range(500)
    ]
    obs = spark.createDataFrame(rows, "id long, pyrome_id string, ts timestamp, ws_mph double, wd_deg double")
    obs.write.parquet(str(tmp_path / "in"))
    counts = stream_bin_counts(spark.readStream.schema(obs.schema).parquet(str(tmp_path / "in")))
    q = counts.writeStream.outputMode("complete").format("memory").queryName("rose").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r["pyrome_id"], r["speed_bin"], r["dir_bin"])
    got = {key(r): r["pct"] for r in rose_from_counts(spark.table("rose")).collect()}
    want = {key(r): r["pct"] for r in windrose.wind_cells(obs).where("pct > 0").collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_zonal_totals(spark):
    rows = [(1, 0), (1, 0), (1, 1), (1, None), (2, None)]
    df = spark.createDataFrame(rows, "feature_id long, c int")
    got = {(r["feature_id"], r["class_val"]): r["pct_cover"] for r in zonal_categorical(df, "c").collect()}
    assert got == {(1, 0): pytest.approx(200 / 3), (1, 1): pytest.approx(100 / 3)}
    kept = zonal_categorical(df, "c", nodata_in_denominator=True).where("class_val = 0").first()
    assert kept["pct_cover"] == 50.0
    cont = zonal_continuous(df, "c", ["count", "mean"], nodata=0, scale_factor=10).collect()
    assert [(r["feature_id"], r["count"], r["mean"]) for r in cont] == [(1, 1, 0.1)]
    with pytest.raises(ValueError, match="stat must be"):
        zonal_continuous(df, "c", ["median"])


def test_treatment_rules(spark):
    px = spark.createDataFrame(
        [(0, 0, 50, 100, 10, 20, 165), (0, 1, 15, 100, 10, 20, 300), (0, 2, None, 100, 10, 20, None)],
        "row int, col int, cc short, ch short, cbh short, cbd short, fbfm40 short",
    )
    surface = src.unpivot_surface(spark.createDataFrame([("TU5", 165, 161), ("SB4", 204, 201)], "Code string, FBFM40 int, Manage int"))
    canopy = src.canopy_effects(spark)
    out = treatment.apply_treatment(px, canopy, surface, "Mech Thin", "Manage").orderBy("col").collect()
    assert tuple(out[0])[2:] == (30, 130, 13, 12, 161)
    assert tuple(out[1])[2:] == (0, 0, 0, 0, 201)  # cover falls below 10; code 300 counts as 204
    assert tuple(out[2])[2:] == (None, None, None, None, None)
    again = treatment.apply_treatment(spark.createDataFrame(out[1:2], px.schema), canopy, surface, "Mech Thin", "Manage").first()
    assert tuple(again)[2:6] == (0, 0, 0, 0)
    for names in (("Nope", "Manage"), ("Thin", "Nope")):
        with pytest.raises(Exception, match="unknown"):
            treatment.apply_treatment(px, canopy, surface, *names).collect()
    renamed = px.withColumnsRenamed({"cc": "cover", "fbfm40": "fuel"})
    mapped = treatment.apply_treatment(renamed, canopy, surface, "Patch", "Manage", band_map={"cc": "cover", "fbfm40": "fuel"})
    assert mapped.orderBy("col").first()["cover"] == 0


def test_presets_and_bad_cover(spark):
    land = synthetic.synthetic_landscapes(synthetic.presets(spark), n_pixels=2)
    assert land.count() == 44
    row = land.where("raster_id = 'lodgepole_2019'").first()
    assert (row["slpd"], row["ch"], row["cbh"], row["cbd"], row["evt"]) == (12, 150, 8, 11, 9999)
    bad = synthetic.presets(spark).withColumn("cc_pct", F.lit(101.0))
    with pytest.raises(Exception, match="cc_pct"):
        synthetic.synthetic_landscapes(bad).collect()
    with pytest.raises(MissingColumnsError):
        synthetic.synthetic_landscapes(bad.drop("ch_m"))


def test_band_selection_errors(spark):
    px = spark.createDataFrame([("a", "US_CC", 0, 0, 1.0), ("b", "ELEV", 0, 0, 2.0)], "raster_id string, band string, row int, col int, value double")
    with pytest.raises(ValueError, match="not found"):
        algebra.select_band(px, "US_CC")
    bands = px.select("raster_id", F.lit(1).alias("band_index"), "band")
    assert algebra.find_band(bands, px, "cc").count() == 2  # a single band is returned as it is
    with pytest.raises(ValueError, match="unknown condition"):
        algebra.apply_edit_rules(px, [{"conditions": [("row", "GT", 1)], "changes": []}])
    with pytest.raises(ValueError, match="CRS"):
        algebra.align_to_grid(px, Grid(), px, Grid(crs="EPSG:4326"), ["value"])


def test_ascii_grid_files(spark, tmp_path):
    rnd = np.random.default_rng(2)
    nrows, ncols = 400, 90
    values = rnd.integers(0, 50, (nrows, ncols)) / 4.0
    values[5, 7] = -9999
    head = f"NCOLS {ncols}\nnrows {nrows}\nxllcorner -2098\nYLLCORNER 3210\ncellsize 30\nNODATA_value -9999\n"
    text = head + "\n".join(" ".join(f"{v:g}" for v in r) + " " for r in values) + "\n"
    (tmp_path / "run_BurnProb.asc").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # several splits per file
    try:
        with pytest.warns(UserWarning, match="AvgTime"):
            out = ascii_grid.read_probability_outputs(spark, str(tmp_path), "run")
        got = np.full((nrows, ncols), np.nan)
        for r in out.collect():
            got[r["row"], r["col"]] = np.nan if r["BurnProb"] is None else r["BurnProb"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    values[5, 7] = np.nan
    assert np.array_equal(got, values, equal_nan=True)
    _, headers = ascii_grid.read_ascii_grids(spark, str(tmp_path / "run_BurnProb.asc"))
    grid = ascii_grid.header_grid(headers.first())
    assert (grid.nrows, grid.x0, grid.y0) == (400, -2098.0, 3210.0 + 400 * 30)
    with pytest.raises(FileNotFoundError):
        ascii_grid.read_probability_outputs(spark, str(tmp_path), "other")


def test_ignition_grid_round_trip(spark, tmp_path):
    spans = spark.createDataFrame([(1, 0, 1), (1, 3, 4), (2, 0, 4)], "row int, c0 int, c1 int")
    grid = Grid(x0=10.0, y0=100.0, cell=30.0, nrows=4, ncols=5)
    ascii_grid.write_lines(ascii_grid.burned_grid_lines(spans, grid), str(tmp_path / "ign"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "ign").glob("part-*")))
    assert text.splitlines() == [
        "ncols 5", "nrows 4", "xllcorner 10.0", "yllcorner -20.0", "cellsize 30.0", "NODATA_value 0",
        "0 0 0 0 0", "1 1 0 1 1", "1 1 1 1 1", "0 0 0 0 0",
    ]


def test_rtc_file(spark, tmp_path):
    good = tmp_path / "rtc.txt"
    good.write_text("# codes\n101:10\n\n 185 : 2 \n")
    assert {(r["code"], r["rtc"]) for r in src.read_rtc(spark, str(good)).collect()} == {(101, 10.0), (185, 2.0)}
    (tmp_path / "bad.txt").write_text("101:10\n102-4\n")
    with pytest.raises(Exception, match="cannot parse line 2"):
        src.read_rtc(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "empty.txt").write_text("# nothing\n")
    with pytest.raises(ValueError, match="no entries"):
        src.read_rtc(spark, str(tmp_path / "empty.txt"))


def test_climatology_csv(spark, tmp_path):
    f = tmp_path / "wx.csv"
    f.write_text(
        "system:index, Pyrome ,date,erc,fm100,fm1000,tmmx,rmin,vs,th\n"
        "a,7,2020-12-31,50,8,9,300,20,2,180\nb,7,2020-01-01,,8,9,300,20,2,180\nc,7,2020-01-02,x,8,9,300,20,2,180\n"
        "d,8,2019-03-01,1,n/a,9,300,20,2,\n"
    )
    rows = {r["system:index"]: r for r in src.read_climatology(spark, str(f)).collect()}
    assert set(rows) == {"a", "d"}
    assert rows["a"]["doy"] == 366 and rows["a"]["tmmx_f"] == pytest.approx(80.33)
    assert rows["a"]["ws_mph"] == pytest.approx(4.47388) and rows["d"]["fm100"] is None and rows["d"]["wd_deg"] is None
    report = src.climatology_report(spark.read.csv(str(f), header=True)).first()
    assert tuple(report) == (2, 2, 2, 2019, 2020)
    with pytest.raises(KeyError):
        src.normalise_climatology(spark.range(1))


def test_scenario_csv(spark, tmp_path):
    f = tmp_path / "s.csv"
    f.write_text(
        "Scenario,LCP,WIND_SPEED,WIND_DIRECTION,FM_1hr,FM_10hr,FM_100hr,FM_herb,FM_woody,CROWN_FIRE_METHOD,Outputs,Extra\n"
        'pct25,lcp.tif,8,-1,21,17,15,100,130,Finney,"FLAMELENGTH, CROWNSTATE",x\n'
    )
    row = src.read_scenarios(spark, str(f), "/lcps").first()
    assert row["LCP"] == "/lcps/lcp.tif" and row["Outputs"] == "FLAMELENGTH, CROWNSTATE" and row["Extra"] == "x"
    with pytest.raises(ValueError, match="lacks"):
        src.resolve_scenarios(spark.createDataFrame([("a",)], "Scenario string"))
    table = scenarios.build_scenarios(spark.createDataFrame([("a", 1), ("b", 2)], "Scenario string, WIND_SPEED int"), ["x/l1.tif", "l2.tif", "l3.tif"])
    assert table.count() == 6 and table.columns[1] == "LCP"
    assert table.first()["Outputs"].startswith("FLAMELENGTH")
    jobs = scenarios.job_table(table, "/o", input_column="FSPro_input")
    assert scenarios.failed_jobs(jobs).count() == 6


def test_document_store(spark, tmp_path):
    docs = spark.createDataFrame([("1", [1.0, 2.0], 5), ("22", [3.0], 6)], "pyrome string, values array<double>, n int")
    store.write_documents(docs, str(tmp_path / "d"))
    assert store.read_document(spark, str(tmp_path / "d"), 22).first()["n"] == 6
    assert store.read_document(spark, str(tmp_path / "d"), "1", values="values").first()[0] == [1.0, 2.0]
    assert store.read_document(spark, str(tmp_path / "d"), "1").first()["pyrome"] == "1"
    padded = spark.createDataFrame([("01", 7), ("1", 8), ("a=b c", 9)], "pyrome string, n int")
    store.write_documents(padded, str(tmp_path / "p"))
    got = {i: store.read_document(spark, str(tmp_path / "p"), i, schema="n int").first()["n"] for i in ("01", "1", "a=b c")}
    assert got == {"01": 7, "1": 8, "a=b c": 9}
    with pytest.raises(FileNotFoundError, match="'3'"):
        store.read_document(spark, str(tmp_path / "d"), "3")
    store.write_results({"fl_change": docs.select("pyrome", "n")}, str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r" / "fl_change"), header=True).count() == 2
    store.write_manifest(docs.select("pyrome"), str(tmp_path / "m"))
    assert "created_at" in spark.read.json(str(tmp_path / "m")).columns


def bundle(spark):
    row = (
        "9", [[0.125, 1.0], [2.0, 96.875]], 10.254, [[10.5, 11.5], [12.0, 13.0]], [11.25, 12.0], [1.0, 2.005],
        [(1, 80.5, 91.0, 2.9, 3.2, 4.3, 36.3, 60.0, 360.0, 0.15, 0.0)], [81, 82],
    )
    cls = "class int, lower double, upper double, fm1 double, fm10 double, fm100 double, fm_herb double, fm_woody double, spot_dist double, spot_prob double, spot2 double"
    types = f"pyrome string, wind_cells array<array<double>>, calm_value double, erc_historic array<array<double>>, erc_avg array<double>, erc_std array<double>, erc_classes array<struct<{cls.replace(' ', ':', 0)}>>, current_erc array<int>"
    types = types.replace(cls, ",".join(p.strip().replace(" ", ":") for p in cls.split(",")))
    return spark.createDataFrame([row], types)


def test_probability_document(spark, tmp_path):
    lines = documents.fspro_lines(bundle(spark), "ign.shp", speed_breaks=[5, 10], dir_breaks=[180, 360],
                                  forecast=[(20, 5), (15, 3)], NumFires=5)
    text = [r["line"] for r in lines.orderBy("line_no").collect()]
    assert text == [
        "FSPRO-Inputs-File-Version-4", "Dimension: 2", "Resolution: 90.0", "Duration: 7", "NumFires: 5", "MaxLag: 30",
        "PolyDegree: 9", "ThreadsPerFire: 1", "UseCustomFuels: 0", "SPOTTING_SEED: 617327", "CROWN_FIRE_METHOD: Finney",
        "CalmValue: 10.25", "NumWindDirs: 2", "180 360", "NumWindSpeeds: 2", "5 10", "WindCellValues:", "0.12 1.00",
        "2.00 96.88", "NumERCClasses: 1", "80 91 2.9 3.2 4.3 36.3 60.0 360 0.15 0", "NumERCYears: 2", "NumWxPerYear: 2",
        "HistoricERCValues: ", "10 12", "12 13", "AvgERCValues: ", "11.2 12.0", "StdDevERCValues:", "1.00 2.00",
        "NumWxCurrYear: 2", "CurrentERCValues: ", "81 82", "NumForecast: 2", "20 5", "15 3", "BarrierFill: 0",
        "SavePerimeters: 1", "IgnitionFile: ign.shp",
    ]
    seeded = documents.paired_lines(bundle(spark), "i", seed=7, SPOTTING_SEED=1)
    assert seeded.where("line = 'SPOTTING_SEED: 7'").count() == 1
    store.write_text_documents(lines, str(tmp_path / "doc"))
    written = "".join(p.read_text() for p in sorted((tmp_path / "doc" / "pyrome=9").glob("part-*")))
    assert written.splitlines() == text


def test_catalog_files(spark, tmp_path):
    for name in ("baseline/Water_eNVC.tif", "treated/mech_eNVC_Water.tif", "maps/x_eNVC.tif", "bp/some_bp.tif", "bp/BurnProbability.tif", "Pct50/z.tif", "a.txt"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"x")
    files = catalog.list_files(spark, str(tmp_path), ".tif")
    assert files.count() == 6
    # the temporary folder's own name must not matter
    rel = files.withColumn("path", F.regexp_replace("path", f"^{tmp_path}", "/q"))
    found = {r["path"].rsplit("/", 1)[1]: r["metric"] for r in catalog.classify_metrics(rel, metrics=["eNVC"]).collect()}
    assert found == {"Water_eNVC.tif": "eNVC", "mech_eNVC_Water.tif": "eNVC"}
    best = {r["folder"]: r["path"] for r in catalog.find_burn_probability(rel).collect()}
    assert best == {"/q/bp": "/q/bp/BurnProbability.tif"}
    raster = catalog.find_behavior_raster(rel, [("Pct50", "FLAMELENGTH")]).first()
    assert raster["path"] == "/q/Pct50/z.tif"
    with pytest.raises(Exception, match="no raster"):
        catalog.find_behavior_raster(rel, [("Pct97", "FLAMELENGTH")]).collect()


def test_missing_types_and_empty_sdi(spark):
    attrs = spark.createDataFrame([(1, 1, "Rx Fire", 2.0)], "feature_id long, ord int, type string, acres_gis double")
    with pytest.raises(ValueError, match="Rx Fire"):
        check_types(attrs, spark.createDataFrame([("Thin",)], "type string"))
    row = sdi_change(None, None, spark.createDataFrame([], "feature_id long, row int, c0 int, c1 int"), attrs).first()
    assert row["scenario"] == "rx_fire" and row["sdi_bl_mean"] is None


def test_levelling_off(spark):
    curve = [(50 * i, 10.0 + (i if i <= 12 else 12 + (i - 12) * 0.01)) for i in range(1, 31)]
    rows = [("step", d, v) for d, v in curve] + [("none", d, 1.0 + d) for d, _ in curve]
    df = spark.createDataFrame(rows, "treatment string, buffer_ft int, mean_value double")
    got = {r["treatment"]: r for r in reporting.levelling_off(df).collect()}
    assert got["step"]["found"] and got["step"]["stable_ft"] == 550
    assert not got["none"]["found"] and got["none"]["stable_ft"] == 1500
    diffs = reporting.first_difference(df).where("treatment = 'none'")
    assert diffs.where("diff is null").count() == 1


def test_boxplot_whiskers(spark):
    values = [1, 2, 3, 4, 5, 6, 7, 100]
    df = spark.createDataFrame([("s", float(v)) for v in values], "scenario string, v double")
    r = reporting.boxplot_stats(df, "v").first()
    assert r["median"] == statistics.median(values) and (r["whisker_low"], r["whisker_high"]) == (1.0, 7.0)


def test_bundle_joins_only_complete_regions(spark):
    days = [("1", dt.date(2001, 4, 1) + dt.timedelta(days=i), 2001, 91 + i, 10.0 + i % 50, 8.0, 90.0, 20.0) for i in range(214)]
    wx = spark.createDataFrame(days, "pyrome string, date date, year int, doy int, erc double, fm100 double, tmmx_f double, rmin double")
    obs = spark.createDataFrame([("1", dt.date(2017, 1, 1), 9.0, 100.0), ("2", dt.date(2018, 1, 1), 9.0, 100.0)], "pyrome_id string, date date, ws_mph double, wd_deg double")
    rows = weather_bundle(wx, obs).collect()
    assert [r["pyrome"] for r in rows] == ["1"]
    assert len(rows[0]["erc_historic"][0]) == 214 and len(rows[0]["current_erc"]) == 79 and len(rows[0]["erc_classes"]) == 5


def test_line_numbers_survive_other_splits(spark, tmp_path):
    text = "\n".join(f"line {i} " + "x" * (i % 50) for i in range(20_000))
    (tmp_path / "a.txt").write_text(text)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
        lines = ascii_grid.numbered_lines(spark, str(tmp_path / "a.txt"))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "37000")
        rows = lines.collect()
    finally:
        for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.minPartitionNum"):
            spark.conf.set(k, old[k]) if k in old else spark.conf.unset(k)
    assert len(rows) == 20_000 and all(r["value"].startswith(f"line {r['line_no']} ") for r in rows)


def test_grid_rows_that_start_with_a_word(spark):
    text = ["NCOLS 2", "nrows 3", "xllcorner 0", "yllcorner 0", "cellsize 30", "NODATA_value -1", "1 2", "nan 4", "-1 6"]
    lines = spark.createDataFrame([("g", i, v) for i, v in enumerate(text)], "path string, line_no long, value string")
    pixels, headers = ascii_grid.parse_ascii_grids(lines)
    got = {(r["row"], r["col"]): r["value"] for r in pixels.collect()}
    assert got == {(0, 0): 1.0, (0, 1): 2.0, (1, 0): None, (1, 1): 4.0, (2, 0): None, (2, 1): 6.0}
    assert headers.first()["nrows"] == 3.0


def test_aliases_belong_to_their_table(spark):
    walk = spark.createDataFrame([("DOI", "M", "Masticate", "Masticate")], "Agency string, Treatment string, CanEff string, SurfEff string")
    records = spark.createDataFrame([("DOI", "M")], "agency string, treatment string")
    row = treatment.crosswalk_effects(records, walk, src.effect_aliases(spark)).first()
    assert (row["CanEff"], row["SurfEff"]) == ("Masticate", "Mastication")


def test_lookup_opens_only_the_folders_of_wanted_ids(spark, tmp_path):
    docs = spark.range(500).select(F.col("id").alias("pyrome"), (F.col("id") * 2).alias("n"))
    path = str(tmp_path / "docs")
    store.write_document_buckets(docs, path, buckets=16)
    wanted = spark.createDataFrame([(7,), (7,), (11,), (9999,), (None,)], "pyrome long")
    used = {r[0] for r in wanted.select(store._bucket("pyrome", 16)).collect()}
    for folder in (tmp_path / "docs").glob("bucket=*"):
        if int(folder.name.removeprefix("bucket=")) not in used:
            for file in folder.glob("*.parquet"):
                file.write_bytes(b"unreadable")
    got = store.lookup_documents(spark, path, wanted, "pyrome", docs.schema, buckets=16)
    rows = {r["pyrome"]: (r["n"], r["found"]) for r in got.collect()}
    assert rows == {7: (14, True), 11: (22, True), 9999: (None, False), None: (None, False)}
    only = store.lookup_documents(spark, path, wanted, "pyrome", docs.schema, buckets=16, values="n")
    assert only.columns == ["pyrome", "n", "found"] and only.count() == 4
    assert store.lookup_documents(spark, path, wanted.limit(0), "pyrome", docs.schema, buckets=16).count() == 0
