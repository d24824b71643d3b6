"""Scalar functions at hand-computed points."""

import pytest
from pyspark.sql import functions as F

from firegrid.functions import albers, bins, names, nfdrs, thin, wind
from firegrid.functions import sdi_classes as sc
from firegrid.functions.common import half_even, missing_to_null


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("t", "h", "want"),
    [
        (95.0, 5.0, 0.03229 + 0.281073 * 5 - 0.000578 * 95 * 5),
        (95.0, 10.0, 2.22749 + 1.60107 - 0.014784 * 95),
        (70.0, 50.0, 21.0606 + 0.005565 * 2500 - 0.00035 * 70 * 50 - 0.483199 * 50),
        (600.0, 9.0, 0.0),
    ],
)
def test_equilibrium_moisture(spark, t, h, want):
    assert one(spark, nfdrs.calc_emc(F.lit(t), F.lit(h))) == pytest.approx(want)


def test_live_fuel_points(spark):
    herb = lambda d: one(spark, nfdrs.calc_herb_fm(F.lit(d)))
    assert [herb(d) for d in (1, 91, 250, 300)] == [250.0, 250.0, 30.0, 30.0]
    woody = lambda d: one(spark, nfdrs.calc_woody_fm(F.lit(d)))
    assert woody(152) == pytest.approx(200) and woody(274) == pytest.approx(60)
    assert one(spark, nfdrs.calc_gsi(F.lit(50.0), F.lit(100.0), F.lit(14.0))) == 1.0
    assert one(spark, nfdrs.calc_herb_fm_gsi(F.lit(0.75))) == pytest.approx(140)
    assert one(spark, nfdrs.calc_emc(F.lit(None).cast("double"), F.lit(5.0))) is None


def test_aspect_and_edges(spark):
    got = [one(spark, sc.classify_aspect(F.lit(float(a)))) for a in (-1, 22.5, 180, 300, 337.5)]
    assert got == [10, 8, 1, 7, 10]
    assert one(spark, sc.classify_aspect(F.lit(None).cast("double"))) == 5
    assert one(spark, sc.classify_accessibility(F.lit(100.0))) == 10
    assert one(spark, sc.classify_accessibility(F.lit(None).cast("double"))) == 1
    assert one(spark, sc.slope_hazard(F.lit(10.0))) == 0.01
    assert one(spark, sc.slope_hazard(F.lit(10.0), "smoothed")) == 0.1


def test_wind_bins(spark):
    got = [one(spark, wind.speed_bin(F.lit(v))) for v in (2.0, 5.0, 5.1, 30.0, 80.0)]
    assert got == [0, 0, 1, 5, 5]
    got = [one(spark, wind.direction_bin(F.lit(v))) for v in (0.0, 45.0, 46.0, 360.0)]
    assert got == [7, 0, 1, 7]
    assert one(spark, wind.wind_direction_deg(F.lit(0.0), F.lit(-1.0))) == pytest.approx(0)


def test_flame_classes(spark):
    got = [one(spark, bins.bin_fl(F.lit(v))) for v in (0.0, 0.6, 0.6096, 3.6576, 50.0)]
    assert got == [None, 0, 1, 4, 4]
    assert one(spark, bins.clean_crown_state(F.lit(4.0))) is None


def test_names(spark):
    assert one(spark, names.file_stem(F.lit("/a/b.c/lcp.v2.tif"))) == "lcp.v2"
    assert one(spark, names.band_label(F.lit("US_220F40_20"))) == "FBFM40"
    assert one(spark, names.percentile_key(0.975)) == "p98"
    assert one(spark, names.normalize_band_name(F.lit("CC"))) == "CC"
    assert one(spark, names.stacked_output_path(F.lit("/o"), F.lit("x/lcp.tif"), F.lit("s1"))) == (
        "/o/lcp/s1/s1_LCP.tif"
    )


def test_thinning(spark):
    c = lambda **k: one(
        spark,
        thin.classify_thin(*[F.lit(k.get(x)).cast("string") for x in ("ty", "act", "eq", "mth")]),
    )
    assert c(ty="Burning") is None
    assert c(act="Commercial Thin", eq=" Chain Saw ") == "Manual"
    assert c(ty="thinning", mth="Power Hand") == "Manual"
    assert c(ty="thinning") == "Mechanical"


def test_albers_origin(spark):
    x, y = albers.to_epsg5070(F.lit(-96.0), F.lit(23.0))
    assert one(spark, x) == pytest.approx(0, abs=1e-6)
    assert one(spark, y) == pytest.approx(0, abs=1e-6)
    # Equal-area: a small quad keeps its ellipsoidal area.
    d, lon, lat = 0.01, -110.0, 40.0
    pts = []
    for a, b in ((0, 0), (d, 0), (d, d), (0, d)):
        x, y = albers.to_epsg5070(F.lit(lon + a), F.lit(lat + b))
        pts.append((one(spark, x), one(spark, y)))
    area = abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(pts, pts[1:] + pts[:1]))) / 2
    import math

    e2, a = albers._E2, albers.SEMI_MAJOR
    s = math.sin(math.radians(lat + d / 2))
    m = a * (1 - e2) / (1 - e2 * s * s) ** 1.5
    n = a / math.sqrt(1 - e2 * s * s)
    want = m * n * math.cos(math.radians(lat + d / 2)) * math.radians(d) ** 2
    assert area == pytest.approx(want, rel=1e-5)
    with pytest.raises(ValueError, match="no transformation"):
        albers.to_grid_crs(spark.range(1), "EPSG:26913", "EPSG:5070")


def test_missing_and_rounding(spark):
    assert one(spark, missing_to_null(F.lit(float("nan")))) is None
    assert one(spark, missing_to_null(F.lit(-9999.0), -9999.0)) is None
    assert [one(spark, half_even(F.lit(v), 0)) for v in (0.5, 1.5, 2.5)] == [0.0, 2.0, 2.0]
