"""Report statistics: class shares, box plots, orders, line metrics, fire sizes."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from firegrid.operators import distance, rasterize, reporting

from .registry import query, r6
from .spatial_queries import line_dist
from .views import TYPES
from .zonal_queries import CS_CHANGE, FL_CHANGE, FL_LABELS, fl_changes


def pixel_shares_sql(p: str, source: str) -> str:
    def side(s: str, rows: str) -> str:
        return (
            f"SELECT scenario, percentile, {p}_class, sum({p}_{s}_count) / sum(sum({p}_{s}_count)) "
            f"OVER (PARTITION BY scenario, percentile) * 100.0::DOUBLE AS {s}_pct FROM {rows} "
            f"GROUP BY scenario, percentile, {p}_class"
        )

    once = (
        f"(SELECT DISTINCT ON (scenario, feature_id, percentile, {p}_class) * FROM {{{source}}})"
    )
    return f"""SELECT scenario, percentile, {p}_class, coalesce(bl_pct, 0) AS bl_pct, coalesce(tr_pct, 0) AS tr_pct
FROM ({side('bl', once)}) b FULL JOIN ({side('tr', '{' + source + '}')}) t USING (scenario, percentile, {p}_class)"""


FL_SHARES = pixel_shares_sql("fl", "fl_change")
CS_SHARES = pixel_shares_sql("cs", "cs_change")
ROUND_SHARES = "SELECT scenario, percentile, {p}_class, round(bl_pct, 6) AS bl_pct, round(tr_pct, 6) AS tr_pct FROM {{shares}}"


@query("A15", ROUND_SHARES.format(p="fl"), fl_change=FL_CHANGE, shares=FL_SHARES)
def pixel_weighted_flame_shares(t):
    return r6(reporting.pixel_weighted_shares(fl_changes(t)))


@query("A15", ROUND_SHARES.format(p="cs"), cs_change=CS_CHANGE, shares=CS_SHARES)
def pixel_weighted_crown_shares(t):
    from firegrid.operators import change

    spans = rasterize.polygon_spans(t.zone_edges, t.grid)
    changes = change.crown_state_change(t.fire_bl, t.fire_tr, spans, t.zone_attr)
    return r6(reporting.pixel_weighted_shares(changes, "cs"))


@query(
    "A16",
    """SELECT scenario, percentile, fl_class, round(tr_pct, 6) AS tr_pct, round(bl_pct, 6) AS bl_pct
FROM (SELECT scenario, percentile, fl_class, avg(fl_tr_pct) AS tr_pct FROM {fl_change} GROUP BY ALL)
LEFT JOIN (SELECT percentile, fl_class, avg(fl_bl_pct) AS bl_pct FROM {fl_change} GROUP BY ALL) USING (percentile, fl_class)""",
    fl_change=FL_CHANGE,
)
def polygon_weighted_flame_shares(t):
    return r6(reporting.polygon_weighted_shares(fl_changes(t)))


DELTAS = """
SELECT type AS scenario, t.row, t.col, CAST(p.sdi - t.sdi AS DOUBLE) AS delta, p.sdi AS base,
 CASE WHEN p.pix % 2 = 0 THEN 'Line' ELSE 'Interior' END AS pod_line FROM {sdi_tr} t JOIN {px} p USING (row, col)"""


def sdi_deltas(t):
    base = t.px.select("row", "col", F.col("sdi").alias("base"), "pix")
    return t.sdi_tr.join(base, ["row", "col"]).select(
        F.col("type").alias("scenario"), "row", "col",
        (F.col("base") - F.col("sdi")).cast("double").alias("delta"), "base",
        F.when(F.col("pix") % 2 == 0, "Line").otherwise("Interior").alias("pod_line"),
    )


@query(
    "A17",
    """SELECT scenario, pod_line, n, q1, median, q3, min(delta) AS whisker_low, max(delta) AS whisker_high
FROM {deltas} JOIN (SELECT scenario, pod_line, count(*) AS n, quantile_cont(delta, 0.25) AS q1, median(delta) AS median,
  quantile_cont(delta, 0.75) AS q3 FROM {deltas} GROUP BY ALL) USING (scenario, pod_line)
WHERE delta BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL""",
    deltas=DELTAS,
)
def sdi_boxplots(t):
    return reporting.boxplot_stats(sdi_deltas(t), "delta", ["scenario", "pod_line"])


@query(
    "A23",
    """SELECT scenario, quantile_cont(delta, 0.75) - quantile_cont(delta, 0.25) AS iqr FROM {deltas} GROUP BY scenario""",
    deltas=DELTAS,
)
def sdi_interquartile_range(t):
    return reporting.interquartile_range(sdi_deltas(t), "delta", ["scenario"])


SD = math.sqrt(1.5**2 + 0.2**2)


@query(
    "A18",
    f"""SELECT scenario, percentile, CAST(i AS INT) AS point, round(i * (18.0::DOUBLE / 299), 6) AS x,
  round(sum(w * exp(-0.5 * ((i * (18.0::DOUBLE / 299) - mid) / {SD!r}) ** 2) / ({SD!r} * sqrt(2 * pi()))) / sum(w), 8) AS density
FROM (SELECT scenario, percentile, tr_pct AS w, CASE fl_class WHEN '0-2ft' THEN 1 WHEN '2-4ft' THEN 3 WHEN '4-8ft' THEN 6
  WHEN '8-12ft' THEN 10 ELSE 15 END::DOUBLE AS mid FROM {{shares}} WHERE tr_pct > 0), range(300) r(i) GROUP BY ALL""",
    fl_change=FL_CHANGE, shares=FL_SHARES,
)
def flame_length_density(t):
    shares = reporting.pixel_weighted_shares(fl_changes(t))
    out = reporting.class_density(shares, "tr_pct", ["scenario", "percentile"])
    return out.withColumns({"x": F.round("x", 6), "density": F.round("density", 8)})


@query(
    "A15 W",
    f"""SELECT scenario, percentile, fl_class, round(top - tr_pct, 6) AS bottom, round(top, 6) AS top FROM (
 SELECT *, sum(tr_pct) OVER (PARTITION BY scenario, percentile ORDER BY list_position({list(FL_LABELS)!r}, fl_class)) AS top FROM {{shares}})""",
    fl_change=FL_CHANGE, shares=FL_SHARES,
)
def stacked_flame_shares(t):
    shares = reporting.pixel_weighted_shares(fl_changes(t))
    out = reporting.stacking_offsets(shares, "tr_pct", ["scenario", "percentile"])
    return r6(out.select("scenario", "percentile", "fl_class", "bottom", "top"))


def order_sql(key: str) -> str:
    return f"""SELECT scenario, round(k, 6) AS sort_key, CAST(row_number() OVER (ORDER BY k IS NULL, k, scenario) AS INT) AS position
FROM ({key})"""


@query(
    "K2",
    order_sql("""SELECT scenario, avg(tr_pct) FILTER (WHERE fl_class = '>12ft') AS k FROM {shares}
 WHERE percentile = 'Pct90' GROUP BY scenario"""),
    fl_change=FL_CHANGE, shares=FL_SHARES,
)
def scenarios_by_high_flames(t):
    shares = reporting.pixel_weighted_shares(fl_changes(t))
    return r6(reporting.order_by_class_share(shares, "Pct90"))


@query(
    "K3",
    order_sql("""SELECT scenario, avg(delta_pct) FILTER (WHERE fl_class = '>12ft') AS k FROM {fl_change}
 WHERE percentile = 'Pct90' GROUP BY scenario"""),
    fl_change=FL_CHANGE,
)
def scenarios_by_flame_delta(t):
    return r6(reporting.order_by_class_share(fl_changes(t), "Pct90", value="delta_pct"))


@query(
    "K4",
    order_sql("""SELECT scenario, avg(delta_pct) FILTER (WHERE cs_class = 'Surface') AS k FROM {cs_change}
 WHERE percentile = 'Pct50' GROUP BY scenario"""),
    cs_change=CS_CHANGE,
)
def scenarios_by_surface_delta(t):
    from firegrid.operators import change

    spans = rasterize.polygon_spans(t.zone_edges, t.grid)
    changes = change.crown_state_change(t.fire_bl, t.fire_tr, spans, t.zone_attr)
    return r6(
        reporting.order_by_class_share(changes, "Pct50", "Surface", "delta_pct", cls="cs_class")
    )


@query(
    "K5",
    order_sql("SELECT scenario, median(delta) AS k FROM {deltas} GROUP BY scenario"),
    deltas=DELTAS,
)
def scenarios_by_median(t):
    return r6(reporting.order_by_median(sdi_deltas(t), "delta"))


@query(
    "K6",
    """SELECT type AS scenario, CAST(row_number() OVER (ORDER BY CASE type WHEN 'Rx Fire' THEN 0 ELSE 1 END, type) AS INT) AS position
FROM (SELECT DISTINCT type FROM {zone_attr})""",
)
def scenarios_by_preference(t):
    kinds = t.zone_attr.select(F.col("type").alias("scenario"))
    return reporting.order_by_preference(kinds, ["Rx Fire"])


@query(
    "K7",
    """SELECT type, arg_min(feature_id, (-acres_gis, feature_id)) AS feature_id FROM {zone_attr} GROUP BY type""",
)
def largest_zone_by_type(t):
    return reporting.arg_extreme(t.zone_attr, ["type"], "feature_id", "acres_gis")


def metric_columns() -> str:
    parts = []
    for k in TYPES:
        f = f"FILTER (WHERE treatment = '{k}')"
        parts += [
            f"round(avg(delta) {f}, 6) AS \"{k}_mean\"", f"round(median(delta) {f}, 6) AS \"{k}_median\"",
            f"round(avg(pct) {f}, 6) AS \"{k}_mean_pct\"",
        ]
    return ", ".join(parts)


@query(
    "A19",
    f"""SELECT feature_id AS segment_id, {metric_columns()} FROM (
 SELECT d.feature_id, scenario AS treatment, delta, CASE WHEN base <> 0 THEN abs(delta) / base * 100 END AS pct
 FROM {{dist}} d JOIN {{deltas}} USING (row, col)) GROUP BY feature_id""",
    dist=line_dist("pod_lines", 90.0), deltas=DELTAS,
)
def line_segment_metrics(t):
    cells = distance.line_cell_distance(t.pod_lines, t.grid, 90.0)
    deltas = sdi_deltas(t)
    zoned = cells.join(deltas, ["row", "col"]).select(
        F.col("feature_id").alias("segment_id"), F.col("scenario").alias("treatment"), "delta",
        (F.try_divide(F.abs("delta"), F.col("base").cast("double")) * 100).alias("pct"),
    )
    return r6(reporting.line_metrics(zoned, TYPES))


CURVE = """
SELECT scenario AS treatment, CAST(feet AS INT) AS buffer_ft, avg(m) AS mean_value FROM (
 SELECT scenario, feature_id, feet, avg(delta) AS m FROM {dist} JOIN {deltas} USING (row, col),
  (SELECT i * 50 AS feet FROM range(1, 31) r(i)) WHERE distance_m <= feet * 0.3048::DOUBLE GROUP BY ALL) GROUP BY ALL"""


def zone_means_wide(t):
    """Mean delta SDI per line and treatment, one column per buffer distance."""
    feet = [50 * i for i in range(1, 31)]
    cells = distance.line_cell_distance(t.pod_lines, t.grid, 1500 * 0.3048)
    valued = cells.join(sdi_deltas(t), ["row", "col"]).withColumnRenamed("scenario", "treatment")
    return distance.nested_zone_means(valued, {f"mean_{f}Feet": f * 0.3048 for f in feet}, "delta", ["treatment", "feature_id"])


@query(
    "A20",
    "SELECT treatment, buffer_ft, round(mean_value, 6) AS mean_value FROM {curve}",
    dist=line_dist("pod_lines", 457.2), deltas=DELTAS, curve=CURVE,
)
def buffer_distance_curve(t):
    return r6(reporting.buffer_curve(zone_means_wide(t)))


@query(
    "A21 W",
    """SELECT treatment, buffer_ft, round(mean_value, 6) AS mean_value,
 round(mean_value - lag(mean_value) OVER (PARTITION BY treatment ORDER BY buffer_ft), 6) AS diff FROM {curve}""",
    dist=line_dist("pod_lines", 457.2), deltas=DELTAS, curve=CURVE,
)
def buffer_curve_differences(t):
    return r6(reporting.first_difference(reporting.buffer_curve(zone_means_wide(t))))


# All 32 segmentations at multiples of five instead of a search.
DIFFS = """SELECT treatment, row_number() OVER (PARTITION BY treatment ORDER BY buffer_ft) - 2 AS i, buffer_ft,
 mean_value - lag(mean_value) OVER (PARTITION BY treatment ORDER BY buffer_ft) AS x FROM {curve}"""
WIDTHS = """SELECT treatment, CASE WHEN m = 0 THEN 1 ELSE 1 / m END AS g, n FROM (
 SELECT a.treatment, median((a.x - b.x) ** 2) AS m FROM {diffs} a JOIN {diffs} b ON a.treatment = b.treatment AND a.i >= 0 AND b.i > a.i GROUP BY 1)
 JOIN (SELECT treatment, max(i) + 1 AS n FROM {diffs} GROUP BY 1) USING (treatment)"""
PATHS = """SELECT treatment, g, n, mask, list_concat(list_concat([0], list_filter([5, 10, 15, 20, 25], lambda b: (mask >> CAST(b / 5 - 1 AS INT)) & 1 = 1)), [n]) AS p
FROM {widths}, range(32) r(mask)"""
SEGMENTS = """SELECT treatment, g, n, mask, p[2] AS first_break, p[k] AS s, p[k + 1] AS e FROM (SELECT *, unnest(range(1, len(p))) AS k FROM {paths})"""
COSTS = """SELECT treatment, n, mask, first_break, s, e, (e - s) - sum(CASE WHEN a.i = b.i THEN 1 ELSE exp(-least(greatest(g * (a.x - b.x) ** 2, 0.01), 100)) END) / (e - s) + 1 AS cost
FROM {segments} JOIN {diffs} a USING (treatment) JOIN {diffs} b USING (treatment)
WHERE a.i BETWEEN s AND e - 1 AND b.i BETWEEN s AND e - 1 GROUP BY treatment, n, mask, first_break, s, e"""


@query(
    "A21",
    """SELECT treatment, buffer_ft AS stable_ft, first_break < n AS found FROM (
 SELECT treatment, n, first_break, row_number() OVER (PARTITION BY treatment ORDER BY sum(cost)) AS rank FROM {costs} GROUP BY treatment, n, mask, first_break
) JOIN {diffs} USING (treatment) WHERE rank = 1 AND i = first_break - 1""",
    dist=line_dist("pod_lines", 457.2), deltas=DELTAS, curve=CURVE, diffs=DIFFS, widths=WIDTHS, paths=PATHS, segments=SEGMENTS, costs=COSTS,
)
def levelling_off_distance(t):
    return reporting.levelling_off(reporting.buffer_curve(zone_means_wide(t)))


@query(
    "A22",
    """SELECT size_class, round(avg(size), 6) AS mean_size, count(*) AS n_fires FROM {fires}
WHERE size_class NOT IN ('A', 'B') GROUP BY size_class""",
)
def fire_size_by_class(t):
    return r6(reporting.fire_size_by_class(t.fires))


@query(
    "A24",
    """SELECT count(*) AS n_rows, count(DISTINCT pyrome) AS n_groups, min(year) AS first_year, max(year) AS last_year FROM {wx}""",
)
def weather_coverage(t):
    return reporting.coverage_report(t.wx, "pyrome", "year")


@query(
    "A25",
    "SELECT DISTINCT type FROM {zone_attr} WHERE type NOT IN (SELECT type FROM {zone_attr} WHERE feature_id = 0)",
)
def types_without_parameters(t):
    known = t.zone_attr.where(F.col("feature_id") == 0)
    return reporting.missing_categories(t.zone_attr, known, "type")
