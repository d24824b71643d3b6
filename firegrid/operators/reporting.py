"""Statistics behind the reports: class shares, box plots, density curves, orders, line metrics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bins import FL_LABELS, FL_MIDPOINTS_FT
from ..functions.common import lookup
from ..session import broadcast_if_small
from .quantiles import exact_quantiles, medians, quantile_columns


def pixel_weighted_shares(
    changes: DataFrame, prefix: str = "fl", scenario: str = "scenario", ident: str = "feature_id"
) -> DataFrame:
    """Class shares per (scenario, percentile), weighted by pixels. The baseline of a treatment
    counts once per (scenario, treatment, percentile, class)."""
    cls = f"{prefix}_class"
    keys = [scenario, "percentile", cls]
    total = Window.partitionBy(scenario, "percentile")

    def side(df: DataFrame, s: str) -> DataFrame:
        px = df.groupBy(*keys).agg(F.sum(f"{prefix}_{s}_count").alias("_px"))
        share = F.try_divide(F.col("_px").cast("double"), F.sum("_px").over(total)) * 100.0
        return px.select(*keys, share.alias(f"{s}_pct"))

    # Copies of a baseline row are identical in the count, so any of them may be kept.
    once = changes.groupBy(scenario, ident, "percentile", cls).agg(
        F.first(f"{prefix}_bl_count").alias(f"{prefix}_bl_count")
    )
    return (
        side(once, "bl").join(side(changes, "tr"), keys, "full_outer").na.fill(0.0, ["bl_pct", "tr_pct"])
    )


def polygon_weighted_shares(changes: DataFrame, prefix: str = "fl", scenario: str = "scenario"):
    """Mean of the per-polygon percentages; the baseline is averaged over all scenarios."""
    cls = f"{prefix}_class"
    tr = changes.groupBy(scenario, "percentile", cls).agg(F.avg(f"{prefix}_tr_pct").alias("tr_pct"))
    bl = changes.groupBy("percentile", cls).agg(F.avg(f"{prefix}_bl_pct").alias("bl_pct"))
    return tr.join(bl, ["percentile", cls], "left")


def boxplot_stats(df: DataFrame, value: str, keys: Sequence[str] = ("scenario",)) -> DataFrame:
    """Quartiles and whiskers (last values within 1.5 IQR of the box) per group."""
    keys = list(keys)
    quartiles = broadcast_if_small(
        exact_quantiles(df, keys, {"v": value}, (0.25, 0.5, 0.75)).select(
            *keys, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"),
            F.col("q")[2].alias("q3"),
        )
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return (
        df.where(F.col(value).isNotNull())
        .select(*keys, F.col(value).cast("double").alias("_v"))
        .join(quartiles, keys)
        .where(F.col("_v").between(F.col("q1") - reach, F.col("q3") + reach))
        .groupBy(*keys, "n", "q1", "median", "q3")
        .agg(F.min("_v").alias("whisker_low"), F.max("_v").alias("whisker_high"))
    )


def interquartile_range(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    wide = quantile_columns(df, keys, {"q1": (value, "v", 0.25), "q3": (value, "v", 0.75)})
    return wide.select(*keys, (F.col("q3") - F.col("q1")).alias("iqr"))


def class_density(
    shares: DataFrame,
    weight: str,
    keys: Sequence[str],
    cls: str = "fl_class",
    bandwidth: float = 1.5,
    jitter: float = 0.2,
    points: int = 300,
    upper: float = 18.0,
) -> DataFrame:
    """Density curve of flame length from class shares: a normal kernel at each class midpoint,
    weighted by its share. Groups whose weights are all zero give no curve."""
    keys = list(keys)
    sd = math.sqrt(bandwidth**2 + jitter**2)
    midpoint = lookup(F.col(cls), dict(zip(FL_LABELS, FL_MIDPOINTS_FT, strict=True)))
    w = shares.groupBy(*keys, midpoint.alias("_mid")).agg(F.sum(weight).alias("_w")).where(
        F.col("_mid").isNotNull() & (F.col("_w") > 0)
    )
    step = upper / (points - 1)
    z = (F.col("x") - F.col("_mid")) / sd
    kernel = F.exp(-0.5 * z * z) / (sd * math.sqrt(2 * math.pi))
    return (
        w.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .withColumn("x", F.col("_i") * step)
        .groupBy(*keys, F.col("_i").alias("point"), "x")
        .agg((F.sum(F.col("_w") * kernel) / F.sum("_w")).alias("density"))
    )


def stacking_offsets(shares: DataFrame, value: str, keys: Sequence[str], cls: str = "fl_class",
                     labels: Sequence[str] = FL_LABELS) -> DataFrame:
    """Cumulative class shares in class order (at most as many rows per group as classes)."""
    pos = lookup(F.col(cls), {name: i for i, name in enumerate(labels)})
    w = Window.partitionBy(*keys).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    return (
        shares.withColumn("_pos", pos)
        .withColumn("top", F.sum(value).over(w))
        .withColumn("bottom", F.col("top") - F.col(value))
        .drop("_pos")
    )


def _ordered(scenarios: DataFrame, keyed: DataFrame, key: str, scenario: str) -> DataFrame:
    """Rank scenarios by a key ascending; scenarios without a key follow by name."""
    # One row per scenario: the global window sorts a list of labels, not data.
    w = Window.orderBy(F.col(key).isNull().cast("int"), F.col(key), F.col(scenario))
    return (
        scenarios.select(scenario).distinct()
        .join(keyed, scenario, "left")
        .withColumn("position", F.row_number().over(w))
    )


def order_by_class_share(
    shares: DataFrame, percentile: str, cls_value: str = ">12ft", value: str = "tr_pct",
    cls: str = "fl_class", scenario: str = "scenario",
) -> DataFrame:
    """Scenario order by the share (or delta) of one class at one percentile, ascending."""
    at = shares.where(F.col("percentile") == percentile)
    keyed = at.where(F.col(cls) == cls_value).groupBy(scenario).agg(F.avg(value).alias("sort_key"))
    return _ordered(at, keyed, "sort_key", scenario)


def order_by_median(df: DataFrame, value: str = "delta_sdi", scenario: str = "scenario"):
    """Scenario order by the median of a value, ascending."""
    return _ordered(df, medians(df, [scenario], {"sort_key": value}), "sort_key", scenario)


def order_by_preference(df: DataFrame, preferred: Sequence[str], scenario: str = "scenario"):
    """Preferred names first in the given order, the others alphabetically."""
    pos = lookup(F.col(scenario), {name: i for i, name in enumerate(preferred)})
    w = Window.orderBy(F.coalesce(pos, F.lit(len(preferred))), F.col(scenario))
    return df.select(scenario).distinct().withColumn("position", F.row_number().over(w))


def arg_extreme(df: DataFrame, keys: Sequence[str], ident: str, value: str, largest: bool = True):
    """Id of the row with the largest (smallest) value per group; ties go to the smallest id."""
    order = F.struct((-F.col(value) if largest else F.col(value)), F.col(ident))
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(ident, order).alias(ident))


def line_metrics(
    zoned: DataFrame, treatments: Sequence[str], zone: Sequence[str] = ("segment_id",)
) -> DataFrame:
    """Mean and median delta SDI and mean percent change per segment, one column set per
    treatment. ``zoned`` is ``(zone keys, treatment, delta, pct)``; the treatment list is fixed by
    the caller, so the pivot needs no extra pass."""
    zone = list(zone)
    known = zoned.where(F.col("treatment").isin(list(treatments)))
    means = known.groupBy(*zone, "treatment").agg(
        F.avg("delta").alias("mean"), F.avg("pct").alias("mean_pct")
    )
    mids = medians(known, [*zone, "treatment"], {"median": "delta"})
    return (
        means.join(mids, [*zone, "treatment"], "left")
        .groupBy(*zone)
        .pivot("treatment", list(treatments))
        .agg(F.first("mean").alias("mean"), F.first("median").alias("median"),
             F.first("mean_pct").alias("mean_pct"))
    )


def buffer_curve(
    wide: DataFrame, keys: Sequence[str] = ("treatment",), prefix: str = "mean_"
) -> DataFrame:
    """Mean of the zone means per buffer distance, from one column per distance
    (``mean_<distance>feet``) to one row per distance."""
    cols = [c for c in wide.columns if c.startswith(prefix)]
    ids = [c for c in wide.columns if c not in cols]
    distance = F.regexp_extract("_name", r"(\d+)", 1)
    return (
        wide.unpivot(ids, cols, "_name", "_value")
        .where(distance != "")
        .groupBy(*keys, distance.cast("int").alias("buffer_ft"))
        .agg(F.avg("_value").alias("mean_value"))
    )


def first_difference(curve: DataFrame, keys: Sequence[str] = ("treatment",)) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("buffer_ft")
    return curve.withColumn("diff", F.col("mean_value") - F.lag("mean_value").over(w))


def levelling_off(
    curve: DataFrame, key: str = "treatment", penalty: float = 1.0, min_size: int = 2, jump: int = 5
) -> DataFrame:
    """Distance at which the buffer curve levels off: the first changepoint of its first
    differences. ``found`` is false when that is just the end of the series.

    Segments end at multiples of ``jump`` or at the series' end. A segment costs its length less its
    mean similarity (radial basis, width from the median squared difference) and the penalty; the
    segmentation of least cost is found over the few ends, each of which remembers its cost and its
    first break. A curve is one array of a value per buffer distance (30).
    """
    rows = curve.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("buffer_ft", "mean_value"))).alias("_c")
    )
    at = lambda c, i: F.get(c, i)
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    x, n = F.col("_x"), F.col("_n")
    steps = F.transform(
        upto(F.size("_c") - 1),
        lambda i: at(F.col("_c"), i + 1)["mean_value"] - at(F.col("_c"), i)["mean_value"],
    )
    rows = rows.withColumn("_x", steps).withColumn("_n", F.size("_x"))
    square = lambda a, b: (a - b) * (a - b)
    squares = F.array_sort(
        F.flatten(
            F.transform(
                upto(n),
                lambda i: F.transform(
                    F.slice(x, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda y: square(at(x, i), y)
                ),
            )
        )
    )
    rows = rows.withColumn("_q", squares).withColumn(
        "_median",
        (at(F.col("_q"), F.floor((F.size("_q") - 1) / 2).cast("int"))
         + at(F.col("_q"), F.ceil((F.size("_q") - 1) / 2).cast("int"))) / 2,
    )
    gamma = F.when(F.col("_median") != 0, 1 / F.col("_median")).otherwise(F.lit(1.0))
    rows = rows.withColumn("_g", F.coalesce(gamma, F.lit(1.0)))
    near = lambda a, b: F.exp(-F.least(F.greatest(F.col("_g") * square(a, b), F.lit(1e-2)), F.lit(1e2)))

    def cost(start: Column, end: Column) -> Column:
        part = F.slice(x, start + 1, end - start)
        # Every value is fully similar to itself, and the bound below makes it slightly less.
        own = (end - start) * (1 - F.exp(F.lit(-1e-2)))
        total = F.aggregate(
            part, F.lit(0.0),
            lambda acc, a: acc + F.aggregate(part, F.lit(0.0), lambda inner, b: inner + near(a, b)),
        )
        return (end - start) - (total + own) / (end - start)

    ends = F.array_append(F.filter(upto(n), lambda i: (i > 0) & (i % jump == 0)), n)
    state = "array<struct<at:int,cost:double,first:int>>"

    def step(done: Column, end: Column) -> Column:
        open_ = F.filter(done, lambda d: end - d["at"] >= min_size)
        best = F.array_min(
            F.transform(
                open_,
                lambda d: F.struct((d["cost"] + cost(d["at"], end)).alias("total"), d["at"].alias("at"), d["first"].alias("first")),
            )
        )
        new = F.struct(
            end.alias("at"), (best["total"] + penalty).alias("cost"),
            F.when(best["at"] == 0, end).otherwise(best["first"]).alias("first"),
        )
        return F.when(F.size(open_) > 0, F.concat(done, F.array(new).cast(state))).otherwise(done)

    start = F.array(F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("cost"), F.lit(0).alias("first"))).cast(state)
    last = F.filter(F.aggregate(ends, start, step), lambda d: d["at"] == n)
    first = F.when(n > 0, F.coalesce(at(last, F.lit(0))["first"], n))
    return rows.withColumn("_at", first).select(
        key, at(F.col("_c"), F.col("_at"))["buffer_ft"].alias("stable_ft"),
        F.coalesce(F.col("_at") < n, F.lit(False)).alias("found"),
    )



def fire_size_by_class(fires: DataFrame, drop: Sequence[str] = ("A", "B")) -> DataFrame:
    """Mean fire size per size class; the smallest classes are left out."""
    return (
        fires.where(~F.col("size_class").isin(list(drop)))
        .groupBy("size_class")
        .agg(F.avg("size").alias("mean_size"), F.count("*").alias("n_fires"))
    )


def coverage_report(df: DataFrame, group: str, year: str) -> DataFrame:
    """Rows, distinct groups and year range of a record table."""
    return df.agg(
        F.count("*").alias("n_rows"), F.count_distinct(group).alias("n_groups"),
        F.min(year).alias("first_year"), F.max(year).alias("last_year"),
    )


def missing_categories(needed: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """Categories that occur in the data but have no parameters."""
    return needed.select(key).distinct().join(given.select(key).distinct(), key, "left_anti")
