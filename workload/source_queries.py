"""Catalogs, grids, lookup tables, scenario tables and simulator documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from firegrid.operators import rasterize, scenarios, treatment
from firegrid.operators.climatology import daily_weather_rows
from firegrid.operators.windrose import hourly_wind_rows
from firegrid.plans import container, treatment_pipeline
from firegrid.plans.weather_bundle import weather_bundle
from firegrid.session import shared_folder
from firegrid.sources import ascii_grid, catalog, documents, store
from firegrid.sources import tables as src

from .pixel_queries import SURFACE, surface_table
from .registry import query, r6
from .spatial_queries import ROAD_DIST, TRAIL_DENS
from .scalar_queries import ASPECT_CLS, DOWN, FL_CLS, HUA_CLS, SLOPE_CLS, UP, steps_sql
from .views import TYPES
from .weather_queries import DOC_VIEWS
from .zonal_queries import CS_CHANGE, FL_CHANGE, rounded_change

# Paths made from the part table: metric, scenario and percentile words in the file names.
PATHS = """
SELECT concat('/q/', CASE p_partkey % 3 WHEN 0 THEN 'baseline' WHEN 1 THEN 'treated' ELSE 'Maps' END, '/',
 CASE p_size % 4 WHEN 0 THEN 'mech' WHEN 1 THEN 'mech_thin' WHEN 2 THEN 'rx' ELSE 'other' END, '_',
 CASE p_partkey % 7 WHEN 0 THEN 'eNVC' WHEN 1 THEN 'cNVC' WHEN 2 THEN 'Feas' WHEN 3 THEN 'SDI90' WHEN 4 THEN 'FlameLength'
  WHEN 5 THEN 'BurnProb' ELSE 'x' END, '_', CASE p_size % 3 WHEN 0 THEN 'Pct50' WHEN 1 THEN 'Pct90' ELSE 'Pct97' END, '_',
 CAST(p_partkey AS STRING), '.tif') AS path FROM {part}"""


def paths(t):
    return t.spark.sql(PATHS, part=t.part)


@query(
    "S1",
    """SELECT path, metric FROM (SELECT path, CASE WHEN n LIKE '%envc%' THEN 'eNVC' WHEN n LIKE '%cnvc%' THEN 'cNVC' WHEN n LIKE '%feas%' THEN 'Feas'
 WHEN n LIKE '%sdi90%' THEN 'SDI' WHEN n LIKE '%flamelength%' THEN 'Flamelength' END AS metric
 FROM (SELECT path, lower(split_part(path, '/', 4)) AS n FROM {paths}) WHERE lower(path) NOT LIKE '%maps%') WHERE metric IS NOT NULL""",
    paths=PATHS,
)
def raster_catalog(t):
    return catalog.classify_metrics(paths(t))


@query(
    "S2",
    """SELECT 'bl' AS side, percentile, min(path) AS path FROM {tagged} WHERE path LIKE '%baseline%' GROUP BY percentile
UNION ALL SELECT 'tr', percentile, path FROM {tagged} WHERE path LIKE '%treated%'""",
    paths=PATHS,
    tagged="SELECT path, p AS percentile FROM {paths}, (VALUES ('Pct50'), ('Pct97')) v(p) WHERE contains(path, p)",
)
def percentile_files(t):
    bl, tr = catalog.match_percentiles(paths(t), ["Pct50", "Pct97"])
    side = lambda df, s: df.select(F.lit(s).alias("side"), "percentile", "path")
    return side(bl, "bl").unionByName(side(tr, "tr"))


@query(
    "S3 J13",
    """SELECT CASE WHEN n LIKE 'mech\\_thin\\_%' ESCAPE '\\' THEN 'Mech_Thin' WHEN n LIKE 'mech\\_%' ESCAPE '\\' THEN 'Mech'
  ELSE 'Rx' END AS scenario, min(path) AS path FROM (SELECT path, split_part(path, '/', 4) AS n FROM {paths})
WHERE n NOT LIKE 'other%' GROUP BY 1""",
    paths=PATHS,
)
def scenario_files(t):
    names = t.spark.createDataFrame([("Mech",), ("Mech_Thin",), ("Rx",)], "scenario string")
    return catalog.match_scenarios(paths(t), names)


@query(
    "S3 F28",
    """SELECT path, CASE WHEN n LIKE 'mech\\_thin%' ESCAPE '\\' THEN 'Mech-Thin' ELSE 'Rx' END AS scenario
FROM (SELECT path, split_part(path, '/', 4) AS n FROM {paths}) WHERE n LIKE 'mech\\_thin%' ESCAPE '\\' OR n LIKE 'rx%'""",
    paths=PATHS,
)
def scenario_files_normalised(t):
    return catalog.match_scenarios_normalised(paths(t), ["Rx", "Mech-Thin"])


@query(
    "S4",
    """SELECT split_part(path, '/', 3) AS folder, min(path) AS path FROM {paths} WHERE path LIKE '%BurnProb%' GROUP BY 1""",
    paths=PATHS,
)
def burn_probability_files(t):
    out = catalog.find_burn_probability(paths(t))
    return out.withColumn("folder", F.element_at(F.split("folder", "/"), -1))


@query(
    "S4",
    """SELECT b AS band, p AS percentile, min(path) AS path FROM {paths}, (VALUES ('Pct50', 'FLAMELENGTH'), ('Pct90', 'SDI90')) v(p, b)
WHERE contains(lower(path), lower(p)) AND contains(lower(path), lower(b)) GROUP BY ALL""",
    paths=PATHS,
)
def behaviour_files(t):
    return catalog.find_behavior_raster(paths(t), [("Pct50", "FLAMELENGTH"), ("Pct90", "SDI90")])


def grid_lines(t):
    """The landscape's flame lengths as the lines of ASCII grids of 15 raster rows each."""
    value = F.coalesce(F.col("flamelength").cast("string"), F.lit("-9999"))
    rows = t.px.groupBy("row").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", value.alias("v")))),
                                 lambda s: s["v"]), " ").alias("value")
    ).select(
        F.concat(F.lit("/g/"), F.floor(F.col("row") / 15).cast("string"), F.lit(".asc")).alias("path"),
        (F.col("row") % 15 + 6).alias("line_no"), "value",
    )
    text = ["ncols 100", "NROWS 15", "xllcorner -2098", "yllcorner 3210.5", "cellsize 30", "NODATA_value -9999"]
    head = rows.select("path").distinct().select(
        "path", F.posexplode(F.array(*[F.lit(x) for x in text])).alias("line_no", "value")
    )
    return rows.unionByName(head)


def grid_files(t) -> str:
    """The grids written as files, one per grid; the folder they are in."""
    folder = shared_folder(t.spark)
    lines = grid_lines(t).select(
        F.regexp_extract("path", "([0-9]+)", 1).alias("grid"), "line_no", F.col("value").alias("line")
    )
    store.write_text_documents(lines, folder, key="grid")
    return folder


def grid_name(df):
    return df.withColumn("path", F.concat(F.lit("/g/"), F.regexp_extract("path", "grid=([0-9]+)", 1), F.lit(".asc")))


@query(
    "S5 P4",
    "SELECT concat('/g/', row // 15, '.asc') AS path, CAST(row % 15 AS INT) AS row, col, flamelength AS value FROM {px}",
)
def ascii_grid_pixels(t):
    pixels, _ = ascii_grid.read_ascii_grids(t.spark, grid_files(t))
    return grid_name(pixels)


@query(
    "S5",
    """SELECT DISTINCT concat('/g/', row // 15, '.asc') AS path, 100.0::DOUBLE AS ncols, 15.0::DOUBLE AS nrows, -2098.0::DOUBLE AS xllcorner,
 3210.5::DOUBLE AS yllcorner, 30.0::DOUBLE AS cellsize, -9999.0::DOUBLE AS nodata_value FROM {px}""",
)
def ascii_grid_headers(t):
    _, headers = ascii_grid.read_ascii_grids(t.spark, grid_files(t))
    return grid_name(headers)


@query(
    "S6 G17",
    """SELECT row + 6 AS line_no, string_agg(CASE WHEN z.row IS NULL THEN '0' ELSE '1' END, ' ' ORDER BY p.col) AS line
FROM {px} p LEFT JOIN (SELECT DISTINCT row, col FROM {zone_cells}) z ON z.row = p.row AND z.col = p.col GROUP BY p.row""".replace(
        "SELECT row + 6", "SELECT p.row + 6")
    + """ UNION ALL SELECT i, line FROM (SELECT unnest(range(6)) AS i, unnest(['ncols 100', concat('nrows ', n), 'xllcorner 0.0',
 concat('yllcorner ', CAST(n * -30.0 AS DOUBLE)), 'cellsize 30.0', 'NODATA_value 0']) AS line FROM (SELECT max(row) + 1 AS n FROM {px}))""",
)
def ignition_grid_lines(t):
    spans = rasterize.polygon_spans(t.zone_edges, t.grid).withColumn("_all", F.lit(1))
    merged = rasterize.dissolve_spans(spans, ["_all"])
    return ascii_grid.burned_grid_lines(merged, t.grid)


@query(
    "S9",
    """SELECT DISTINCT CAST(fbfm40 AS INT) AS code, CAST(fbfm40 % 10 AS DOUBLE) AS rtc FROM {px}""",
)
def rtc_lines(t):
    codes = t.px.select("fbfm40").distinct()
    line = F.concat(F.lit(" "), F.col("fbfm40").cast("string"), F.lit(": "), (F.col("fbfm40") % 10).cast("string"))
    lines = codes.select(F.col("fbfm40").cast("bigint").alias("line_no"), line.alias("value"))
    extra = codes.select((F.col("fbfm40") + 1000).cast("bigint"), F.lit("# note"))
    folder = shared_folder(t.spark)
    ascii_grid.write_lines(lines.union(extra).select("line_no", F.col("value").alias("line")), folder)
    return src.read_rtc(t.spark, folder)


@query(
    "S10",
    """SELECT scenario, code AS fbfm40, CASE scenario WHEN 'Manage' THEN code ELSE 101 END AS new_fbfm40
FROM (SELECT DISTINCT CAST(fbfm40 AS INT) AS code FROM {px}), (VALUES ('Manage'), ('RxFire')) v(scenario)""",
)
def surface_effects_long(t):
    wide = t.px.select(
        F.concat(F.lit("F"), F.col("fbfm40").cast("string")).alias("Code"),
        F.col("fbfm40").cast("string").alias("FBFM40"), F.col("fbfm40").cast("string").alias("Manage"),
        F.lit("101").alias("RxFire"),
    ).distinct()
    return src.unpivot_surface(wide)


@query(
    "S8",
    """SELECT Scenario, CASE WHEN n % 2 = 0 THEN concat('/abs/', n, '.tif') ELSE concat('/lcps/rel', n, '.tif') END AS LCP
FROM (SELECT *, CAST(substr(Scenario, 4) AS INT) AS n FROM {conditions})""",
)
def scenario_paths(t):
    n = F.substring("Scenario", 4, 9).cast("int")
    lcp = F.when(n % 2 == 0, F.concat(F.lit("/abs/"), n.cast("string"))).otherwise(
        F.concat(F.lit("rel"), n.cast("string")))
    raw = t.conditions.withColumns(
        {"LCP": F.concat(lcp, F.lit(".tif")), "CROWN_FIRE_METHOD": F.lit("Finney"), "Outputs": F.lit("A")}
    )
    return src.resolve_scenarios(raw, "/lcps").select("Scenario", "LCP")


LCPS = ("/data/lcp_base.tif", "/data/lcp_mod.v2.tif")
LCP_SQL = "(VALUES (0, '/data/lcp_base.tif', 'lcp_base'), (1, '/data/lcp_mod.v2.tif', 'lcp_mod.v2')) v(o, lcp, stem)"


@query(
    "T1 J1",
    f"""SELECT Scenario, lcp AS LCP, WIND_SPEED, FM_herb, GRIDDED_WINDS_GENERATE AS gridded, 'ScottReinhardt' AS crown, 30 AS resolution,
 'FLAMELENGTH, CROWNSTATE' AS Outputs, CAST(o AS INT) AS lcp_ord FROM {{conditions}}, {LCP_SQL}""",
)
def scenario_table(t):
    df = scenarios.build_scenarios(t.conditions, LCPS, outputs="FLAMELENGTH, CROWNSTATE")
    return df.select(
        "Scenario", "LCP", "WIND_SPEED", "FM_herb", F.col("GRIDDED_WINDS_GENERATE").alias("gridded"),
        F.col("CROWN_FIRE_METHOD").alias("crown"), F.col("GRIDDED_WINDS_RESOLUTION").alias("resolution"),
        "Outputs", "lcp_ord",
    )


@query(
    "T2",
    f"""SELECT Scenario, lcp AS LCP, 30 AS MTT_RESOLUTION, 600 AS MTT_SIM_TIME, 50 AS MTT_TRAVEL_PATH_INTERVAL,
 0.0::DOUBLE AS MTT_SPOT_PROBABILITY, 0 AS MTT_FILL_BARRIERS FROM {{conditions}}, {LCP_SQL}""",
)
def travel_time_scenarios(t):
    df = scenarios.build_mtt_scenarios(t.conditions, LCPS, MTT_SIM_TIME=600)
    return df.select("Scenario", "LCP", *scenarios.MTT_DEFAULTS)


@query(
    "T3",
    """SELECT Scenario, CASE WHEN n < 10 THEN concat('/ign/', n) END AS ignition, CASE WHEN n < 3 THEN 'b.shp' END AS barrier,
 CASE WHEN n < 10 THEN 'success' ELSE concat('error: no ignition shapefile for scenario ''', Scenario, '''') END AS status
FROM (SELECT *, CAST(substr(Scenario, 4) AS INT) AS n FROM {conditions})""",
)
def scenario_inputs(t):
    ignitions = t.conditions.select(
        "Scenario", F.substring("Scenario", 4, 9).cast("int").alias("n")
    ).where("n < 10").select("Scenario", F.concat(F.lit("/ign/"), F.col("n").cast("string")).alias("ignition"))
    barriers = {f"pct{i}": "b.shp" for i in range(3)}
    out = scenarios.resolve_inputs(t.conditions, ignitions, barriers)
    return out.select("Scenario", "ignition", "barrier", "status")


@query(
    "T4 F32",
    f"""SELECT Scenario, concat('/lcps/', stem, '.tif') AS LCP, concat('/out/', stem, '/', Scenario) AS output_dir,
 concat('/out/', stem, '/', Scenario, '/TestMTT_run.log') AS log_path,
 concat('/out/', stem, '/', Scenario, '/', Scenario, '_', upper(stem), '.tif') AS stacked_path, 'success' AS status
FROM {{conditions}}, {LCP_SQL}""",
)
def job_table(t):
    df = scenarios.build_scenarios(t.conditions, ["lcp_base.tif", "lcp_mod.v2.tif"])
    return scenarios.job_table(df, "/out", lcp_dir="/lcps", model="TestMTT")


@query(
    "T5",
    "SELECT CASE WHEN o_orderkey % 10 < 7 THEN 'success' ELSE concat('error: ', o_custkey % 4) END AS status, count(*) AS n_jobs FROM {orders} GROUP BY 1",
)
def job_status(t):
    status = F.when(F.col("o_orderkey") % 10 < 7, "success").otherwise(
        F.concat(F.lit("error: "), (F.col("o_custkey") % 4).cast("string")))
    return scenarios.status_summary(t.orders.withColumn("status", status))


WALK = ", ".join(f"('{a}', '{b}', '{c}', '{d}')" for a, b, c, d in src.CROSSWALK)
# Spelled out here, so that the check does not share the library's constants.
CANOPY_ALIAS = "CASE CanEff WHEN 'Rx fire' THEN 'RxFire' ELSE CanEff END"
SURFACE_ALIAS = """CASE SurfEff WHEN 'Rx fire' THEN 'RxFire' WHEN 'Lop and scatter' THEN 'Rearrange'
    WHEN 'Masticate' THEN 'Mastication' ELSE SurfEff END"""


@query(
    "T6",
    # The added row has a canopy effect that only the surface table knows by another name.
    f"""SELECT r.id, r.agency, r.treatment, {CANOPY_ALIAS} AS CanEff, {SURFACE_ALIAS} AS SurfEff
FROM (SELECT p_partkey AS id, CASE p_partkey % 2 WHEN 0 THEN 'DOI' ELSE 'USFS' END AS agency,
 CASE p_size % 6 WHEN 0 THEN 'Broadcast Burn' WHEN 1 THEN 'Thinning' WHEN 2 THEN 'Lop and Scatter' WHEN 3 THEN 'Chipping'
 WHEN 4 THEN 'Mowing' ELSE 'Unknown' END AS treatment FROM {{part}}) r
LEFT JOIN (VALUES {WALK}, ('DOI', 'Unknown', 'Masticate', 'Masticate')) w(Agency, Treatment, CanEff, SurfEff) ON w.Agency = r.agency AND w.Treatment = r.treatment""",
)
def treatment_crosswalk(t):
    kinds = ["Broadcast Burn", "Thinning", "Lop and Scatter", "Chipping", "Mowing", "Unknown"]
    records = t.part.select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_partkey") % 2 == 0, "DOI").otherwise("USFS").alias("agency"),
        F.get(F.array(*[F.lit(k) for k in kinds]), F.col("p_size") % 6).alias("treatment"),
    )
    walk = src.crosswalk_table(t.spark)
    walk = walk.union(t.spark.createDataFrame([("DOI", "Unknown", "Masticate", "Masticate")], walk.schema))
    return treatment.crosswalk_effects(records, walk, src.effect_aliases(t.spark))


@query(
    "S11 S12",
    """SELECT w.id AS customer, d.n, d.first_day, d.n IS NOT NULL AS found
FROM (SELECT c_custkey AS id FROM {customer} WHERE c_custkey % 5 = 0 UNION ALL SELECT -c_custkey FROM {customer} WHERE c_custkey % 50 = 1) w
LEFT JOIN (SELECT o_custkey, count(*) AS n, CAST(min(o_orderdate) AS DATE) AS first_day FROM {orders} GROUP BY o_custkey) d ON o_custkey = w.id""",
)
def document_lookup(t):
    docs = t.orders.groupBy(F.col("o_custkey").alias("customer")).agg(
        F.count("*").alias("n"), F.min("o_orderdate").cast("date").alias("first_day")
    )
    folder = shared_folder(t.spark)
    store.write_document_buckets(docs, folder, key="customer")
    key = F.col("c_custkey")
    wanted = t.customer.where(key % 5 == 0).select(key.alias("customer"))
    unknown = t.customer.where(key % 50 == 1).select((-key).alias("customer"))
    return store.lookup_documents(t.spark, folder, wanted.unionByName(unknown), "customer", docs.schema)


@query(
    "S13",
    "SELECT fbfm40, count(*) AS n, round(avg(sdi), 4) AS mean_sdi, any_value('a, \"b\"') AS note FROM {px} GROUP BY fbfm40",
)
def result_sinks(t):
    folder = shared_folder(t.spark)
    table = t.px.groupBy("fbfm40").agg(F.count("*").alias("n"), F.round(F.avg("sdi"), 4).alias("mean_sdi"))
    store.write_results({"sdi_summary": table.withColumn("note", F.lit('a, "b"'))}, folder)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
    return t.spark.read.csv(f"{folder}/sdi_summary", header=True, schema=f"{kinds}, note string", escape='"')


SHORTTERM = """
SELECT Scenario, lcp, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS line_no FROM (SELECT Scenario, lcp, list_concat([
 'ShortTerm-Inputs-File-Version-1', '', 'FUEL_MOISTURES_DATA: 1', concat_ws(' ', '0', FM_1hr, FM_10hr, FM_100hr, FM_herb, FM_woody),
 'FOLIAR_MOISTURE_CONTENT: 100', 'CROWN_FIRE_METHOD: ScottReinhardt', 'NUMBER_PROCESSORS: 4', concat('WIND_SPEED: ', WIND_SPEED),
 concat('WIND_DIRECTION: ', WIND_DIRECTION)], list_concat(CASE WHEN GRIDDED_WINDS_GENERATE = 'Yes' THEN
 ['GRIDDED_WINDS_GENERATE: Yes', 'GRIDDED_WINDS_RESOLUTION: 30'] ELSE [] END, {tail})) AS l FROM {conditions}, {lcps})"""


@query(
    "S17",
    "SELECT Scenario, lcp AS LCP, CAST(line_no AS INT) AS line_no, line FROM {lines}",
    lines=SHORTTERM.replace("{tail}", "['FLAMELENGTH: 1', 'CROWNSTATE: 1']").replace("{lcps}", LCP_SQL),
)
def shortterm_documents(t):
    df = scenarios.build_scenarios(t.conditions, LCPS, outputs="FLAMELENGTH, CROWNSTATE")
    return documents.shortterm_lines(df, ["Scenario", "LCP"], n_process=4)


@query(
    "S17",
    "SELECT Scenario, lcp AS LCP, CAST(line_no AS INT) AS line_no, line FROM {lines}",
    lines=SHORTTERM.replace(
        "{tail}",
        "['MTT_RESOLUTION: 30', 'MTT_SIM_TIME: 400', 'MTT_TRAVEL_PATH_INTERVAL: 50', 'MTT_SPOT_PROBABILITY: 0.0', 'MTT_FILL_BARRIERS: 0', 'FLAMELENGTH:']",
    ).replace("{lcps}", LCP_SQL),
)
def travel_time_documents(t):
    df = scenarios.build_mtt_scenarios(t.conditions, LCPS, outputs="FLAMELENGTH")
    return documents.shortterm_lines(df, ["Scenario", "LCP"], n_process=4, model="mtt")


COND_WX = """
SELECT pyrome, count(*) AS n, string_agg(line, chr(10) ORDER BY date, line) AS body FROM (
 SELECT pyrome, date, concat_ws(' ', month(date), day(date), pcp, 500, 1400, CAST(round_even(tmmn_f, 0) AS INT), CAST(round_even(tmmx_f, 0) AS INT),
  CAST(rmax AS INT), CAST(rmin AS INT), 7000, CASE WHEN pcp > 0 THEN 600 ELSE 0 END, CASE WHEN pcp > 0 THEN 1200 ELSE 0 END) AS line
 FROM (SELECT *, greatest(0, CAST(round_even(pr * 0.03937::DOUBLE * 100, 0) AS INT)) AS pcp FROM {wx})
 WHERE date BETWEEN DATE '1998-07-01' AND DATE '1998-07-20') GROUP BY pyrome"""
COND_WIND = """
SELECT pyrome_id AS pyrome, count(*) AS n, string_agg(line, chr(10) ORDER BY t, line) AS body FROM (
 SELECT pyrome_id, date + INTERVAL (utc_hour) HOUR AS t, concat_ws(' ', month(date), day(date), utc_hour * 100, CAST(round_even(ws_mph, 0) AS INT), CAST(wd_deg AS INT), 0) AS line
 FROM {obs} WHERE date BETWEEN DATE '2024-01-02' AND DATE '2024-01-20' AND utc_hour IN (13, 14, 15, 16)) GROUP BY pyrome_id"""


@query(
    "S18 C6 C14",
    """SELECT pyrome, concat('FlamMap-Inputs-File-Version-1', chr(10), 'CONDITIONING_PERIOD_END: 07 20 1600', chr(10), chr(10),
 'FUEL_MOISTURES_DATA: 1', chr(10), '0 3 4 5 30 60', chr(10), chr(10), 'WEATHER_DATA: ', w.n, chr(10),
 '# Mth Day Pcp mTH xTH mT xT mH xH Elv PST PET', chr(10), w.body, chr(10), chr(10), 'WIND_DATA: ', v.n, chr(10),
 '# Mth Day Hour Speed Direction CloudCover', chr(10), v.body, chr(10), chr(10), 'FOLIAR_MOISTURE_CONTENT: 100', chr(10),
 'CROWN_FIRE_METHOD: Finney', chr(10), 'NUMBER_PROCESSORS: 1', chr(10), 'WIND_SPEED: 12', chr(10), 'WIND_DIRECTION: -1', chr(10), 'FLAMELENGTH:') AS doc
FROM {cond_wx} w JOIN {cond_wind} v USING (pyrome)""",
    cond_wx=COND_WX, cond_wind=COND_WIND,
)
def conditioning_documents(t):
    wx = daily_weather_rows(t.wx, "1998-07-01", "1998-07-20", 7000)
    named = t.obs.drop("ts").select("pyrome_id", "date", "utc_hour", "ws_mph", "wd_deg")
    wind = hourly_wind_rows(named, "2024-01-02", "2024-01-20", keys=["pyrome_id"]).withColumnRenamed("pyrome_id", "pyrome")
    values = {"FM_1hr": 3, "FM_10hr": 4, "FM_100hr": 5, "FM_herb": 30, "FM_woody": 60, "CROWN_FIRE_METHOD": "Finney",
              "WIND_SPEED": 12, "WIND_DIRECTION": -1, "Outputs": "FLAMELENGTH"}
    regions = t.wx.select("pyrome").distinct().withColumns({k: F.lit(v) for k, v in values.items()})
    lines = documents.conditioning_lines(regions, wx, wind, "1998-07-20 16:00")
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy("pyrome").agg(
        F.array_join(F.transform(ordered, lambda s: s["line"]), "\n").alias("doc")
    )


def _containers(t):
    """Containers: the treatment polygons; regions named like the weather's regions."""
    zones = rasterize.polygon_spans(t.zone_edges, t.grid).withColumnRenamed("feature_id", "container_id")
    regions = rasterize.polygon_spans(t.region_edges, t.grid, ["region_id"]).select(
        (F.col("region_id") % 8).cast("string").alias("pyrome"), "row", "c0", "c1"
    )
    return zones, regions


REGION_OF = """
SELECT feature_id AS container_id, arg_min(p, (-n, p)) AS pyrome FROM (
 SELECT feature_id, CAST(region_id % 8 AS STRING) AS p, count(*) AS n FROM {zone_cells} JOIN {region_cells} USING (row, col) GROUP BY ALL)
GROUP BY feature_id"""


@query(
    "C15 S14 G13",
    """SELECT container_id, '/lf/2022.tif' AS lcp_path, concat('/out/', container_id, '/ignitions/container_ignition.shp') AS ignition_path,
 concat('/out/', container_id, '/fspro_inputs/fspro.input') AS fspro_input_path, pyrome AS pyrome_id, concat('/out/', container_id) AS out_dir,
 concat('/out/', container_id, '/outputs') AS outputs_dir, '2022' AS lf_year, '500' AS num_fires FROM {region_of}""",
    region_of=REGION_OF,
)
def container_manifests(t):
    zones, regions = _containers(t)
    bundle = weather_bundle(t.wx, t.obs)
    _, manifest = container.prepare_containers(
        zones, regions, bundle, "/out", 2022, lcp_path="/lf/2022.tif", NumFires=500
    )
    stamped = store.with_manifest_time(manifest)
    return stamped.withColumn("num_fires", F.col("fspro_kwargs")["NumFires"]).drop("fspro_kwargs", "created_at")


@query(
    "C15 S15",
    """SELECT container_id, CAST(line_no AS INT) AS line_no, line FROM {docs} JOIN {region_of} USING (pyrome) UNION ALL
SELECT container_id, CAST(42 + n AS INT), concat('IgnitionFile: /out/', container_id, '/ignitions/container_ignition.shp')
FROM {n_years} JOIN {region_of} USING (pyrome)""",
    region_of=REGION_OF, **DOC_VIEWS,
)
def container_documents(t):
    zones, regions = _containers(t)
    lines, _ = container.prepare_containers(zones, regions, weather_bundle(t.wx, t.obs), "/out", 2022)
    return lines


@query(
    "C16 P8 G3",
    """SELECT pix, CAST(CASE WHEN z.row IS NULL THEN cc WHEN floor(cc * 0.6::DOUBLE) >= 10 THEN floor(cc * 0.6::DOUBLE)
  WHEN floor(cc * 0.6::DOUBLE) < 10 THEN 0 END AS SMALLINT) AS cc,
 CAST(CASE WHEN z.row IS NULL THEN p.fbfm40 ELSE coalesce(s.new_fbfm40, c) END AS SMALLINT) AS fbfm40
FROM (SELECT *, greatest(0, least(fbfm40, (SELECT max(fbfm40) FROM {surface}))) AS c FROM {px}) p
LEFT JOIN {surface} s ON s.fbfm40 = c LEFT JOIN (SELECT DISTINCT row, col FROM {zone_cells}) z ON z.row = p.row AND z.col = p.col""",
    surface=SURFACE,
)
def counterfactual_landscape(t):
    zones, regions = _containers(t)
    treated, _, _ = container.prepare_counterfactuals(
        zones, regions, weather_bundle(t.wx, t.obs), t.px.select("pix", "row", "col", "cc", "fbfm40"),
        zones, src.canopy_effects(t.spark), surface_table(t), "Mech Thin", "Manage", "/out", 2022,
    )
    return treated.select("pix", "cc", "fbfm40")


@query(
    "C16 S16 S14",
    """SELECT container_id, pyrome AS pyrome_id, 617327 AS seed, concat('/out/', container_id, '/treated/lcp/treated.tif') AS treated_lcp_path
FROM {region_of}""",
    region_of=REGION_OF, surface=SURFACE,
)
def counterfactual_manifests(t):
    zones, regions = _containers(t)
    _, _, manifest = container.prepare_counterfactuals(
        zones, regions, weather_bundle(t.wx, t.obs), t.px, zones, src.canopy_effects(t.spark),
        surface_table(t), "Mech Thin", "Manage", "/out", 2022,
    )
    return manifest.select("container_id", "pyrome_id", "seed", "treated_lcp_path")


def _pipeline(t, name):
    spans = rasterize.polygon_spans(t.zone_edges, t.grid)
    params = t.spark.createDataFrame([(k, "Mech Thin", "Manage") for k in TYPES], "type string, canopy string, surface string")
    return treatment_pipeline.run_treatment_pipeline(
        t.px.select("row", "col", "slpd", "asp", "fbfm40", "cc", "ch", "cbh", "cbd"), t.fire_bl, t.fire_tr, spans,
        t.zone_attr, params, src.canopy_effects(t.spark), surface_table(t), t.roads, t.trails,
        src.rtc_table(t.spark), t.grid, tables=[name],
    )[name]


@query("C17", rounded_change("fl", "fl_change"), fl_change=FL_CHANGE)
def pipeline_flame_change(t):
    return r6(_pipeline(t, "fl"))


@query("C17", rounded_change("cs", "cs_change"), cs_change=CS_CHANGE)
def pipeline_crown_change(t):
    return r6(_pipeline(t, "cs"))


RTC_CASE = "CASE least(fbfm40, 205) " + " ".join(f"WHEN {k} THEN {v}" for k, v in src.RTC.items()) + " ELSE 0 END"
SDI_LAND = f"""
SELECT type, row, col, round_even(100 * (base + CASE WHEN distance_m <= 100 THEN 0 ELSE
    {steps_sql('sp', (10, 20, 30, 40, 50), (0.01, 0.1, 0.2, 0.4, 0.6), 0.8, '<=')} END::DOUBLE), 0) AS sdi
FROM (SELECT *, CASE WHEN flamelength IS NULL THEN NULL ELSE 2.0::DOUBLE * ({FL_CLS}) * ({HUA_CLS}) / (({FL_CLS}) + ({HUA_CLS})) END
   / ({steps_sql('coalesce(distance_m, 1e9)', range(100, 901, 100), DOWN, 1, '<=')} + 1
      + (({SLOPE_CLS}) + rtc + ({ASPECT_CLS}) + 2 * ({steps_sql('coalesce(trail_m, 0)', range(10, 91, 10), UP, 10)})) / 5.0::DOUBLE
      + rtc * (({steps_sql('sp', (20, 30, 40), (1.0, 0.75, 0.625), 0.5)})::DOUBLE + ({steps_sql('sp', (30, 40), (1.0, 0.5), 0.0)})::DOUBLE)) AS base
 FROM (SELECT p.*, distance_m, trail_m, tan(radians(slpd)) * 100 AS sp, {RTC_CASE} AS rtc FROM (
   SELECT NULL AS type, row, col, slpd, asp, fbfm40, f.flamelength, f.heatarea FROM {{px}} JOIN {{fire_bl}} f USING (row, col) WHERE percentile = 'Pct90'
   UNION ALL SELECT f.type, row, col, slpd, asp, coalesce(s.new_fbfm40, greatest(0, least(q.fbfm40, (SELECT max(fbfm40) FROM {{surface}})))), f.flamelength, f.heatarea
   FROM {{px}} q JOIN {{fire_tr}} f USING (row, col) LEFT JOIN {{surface}} s ON s.fbfm40 = greatest(0, least(q.fbfm40, (SELECT max(fbfm40) FROM {{surface}})))
   WHERE percentile = 'Pct90') p LEFT JOIN {{road_dist}} d USING (row, col) LEFT JOIN {{trail_dens}} USING (row, col)))"""


@query(
    "C17 P23 A6",
    """SELECT feature_id, type, acres_gis, lower(replace(replace(type, ' ', '_'), '/', '-')) AS scenario, round(bl, 6) AS sdi_bl_mean,
 round(tr, 6) AS sdi_tr_mean, round(bl - tr, 6) AS sdi_delta_mean
FROM {zone_attr} JOIN (SELECT feature_id, avg(sdi) / 100 AS bl FROM {sdi_land} JOIN {zone_grid} USING (row, col) WHERE type IS NULL GROUP BY 1) USING (feature_id)
LEFT JOIN (SELECT feature_id, avg(sdi) / 100 AS tr FROM {sdi_land} JOIN {zone_grid_type} USING (type, row, col) GROUP BY 1) USING (feature_id)""",
    surface=SURFACE, road_dist=ROAD_DIST, trail_dens=TRAIL_DENS, sdi_land=SDI_LAND,
)
def pipeline_sdi_change(t):
    return r6(_pipeline(t, "sdi"))
