"""Distribution statistics that stay exact and distributed.

Exact quantiles need the sorted data. Instead of gathering a group's values
in one task, values are first reduced to distinct (group, value, weight)
rows (partial aggregation), then cumulative weights come from the
range-partitioned ``prefix_sum`` (operators/ordering.py), so a hot group is
split across as many tasks as its distinct values need. The order statistic
for a target position is the least value whose cumulative weight reaches it,
which is a plain conditional ``min`` per group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from taskshift.functions.nulls import mean_strict, safe_div
from taskshift.operators import weighted_sketch
from taskshift.operators.joins import join_null_safe
from taskshift.operators.ordering import prefix_sum
from taskshift.operators.reshape import to_long, very_wide_to_long
from taskshift.session import cut_lineage


def _qname(p: float) -> str:
    return "q" + f"{p:g}".replace(".", "_")


def cumulative_by_group(df: DataFrame, keys: Sequence[str], x: str, weight: Column | None = None,
                        bounded_groups: bool = False, distinct: bool = False) -> DataFrame:
    """Distinct (keys, x) rows with ``__c`` (weight of the value), ``__cum``
    (cumulative weight inside the group, ascending x) and ``__n`` (group total).

    One distributed prefix sum over (keys, x) gives the running weight across
    all groups; a group's start is the least (running weight - own weight) in
    it, so within-group positions need no second ordered pass. The result is
    read from the checkpointed prefix-sum table, so consumers of it never
    recompute the input. ``distinct``: the rows are distinct by (keys, x)
    already and are not grouped again."""
    keys = list(keys)
    w = F.lit(1).cast("bigint") if weight is None else weight
    dist = df.where(F.col(x).isNotNull())
    dist = dist.select(*keys, x, w.alias("__c")) if distinct else dist.groupBy(*keys, x).agg(F.sum(w).alias("__c"))
    order = [(k, True, False) for k in keys] + [(x, True, False)]
    rows = prefix_sum(dist, order, "__c", "__cg")
    if not keys:
        total = rows.agg(F.sum("__c")).scalar()
        return rows.select(x, "__c", F.col("__cg").alias("__cum"), total.alias("__n"))
    g = rows.groupBy(*keys).agg(F.sum("__c").alias("__n"), F.min(F.col("__cg") - F.col("__c")).alias("__gstart"))
    rows = join_null_safe(rows, g, keys, "inner", broadcast_right=bounded_groups)
    return rows.select(*keys, x, "__c", (F.col("__cg") - F.col("__gstart")).alias("__cum"), "__n")


def quantiles_from_cumulative(rows: DataFrame, keys: Sequence[str], x: str, probs: Sequence[float],
                              names: Sequence[str]) -> DataFrame:
    """Type-7 quantiles from a ``cumulative_by_group`` table."""
    n = F.col("__n").cast("double")
    cum, v = F.col("__cum"), F.col(x)
    aggs = [F.max("__n").alias("n")]
    for p, nm in zip(probs, names):
        h = (n - 1) * p + 1
        aggs.append(F.min(F.when(cum >= F.floor(h), v)).alias(f"__lo_{nm}"))
        aggs.append(F.min(F.when(cum >= F.ceil(h), v)).alias(f"__hi_{nm}"))
    g = rows.groupBy(*keys).agg(*aggs)
    out = [*keys, F.col("n").cast("bigint").alias("n")]
    for p, nm in zip(probs, names):
        h = (F.col("n").cast("double") - 1) * p + 1
        lo, hi = F.col(f"__lo_{nm}"), F.col(f"__hi_{nm}")
        out.append((lo + (h - F.floor(h)) * (hi - lo)).alias(nm))
    return g.select(*out)


def approx_group_quantiles(df: DataFrame, keys: Sequence[str], x: str, probs: Sequence[float],
                           names: Sequence[str] | None = None, accuracy: int = 10000) -> DataFrame:
    """Approximate quantiles per group in one partial-aggregable pass
    (``percentile_approx``: bounded-memory sketch, rank error about
    1/``accuracy``), for when exact order statistics are not required."""
    names = list(names or [_qname(p) for p in probs])
    g = df.where(F.col(x).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx(x, list(probs), accuracy).alias("__q"))
    return g.select(*keys, "n", *[F.col("__q")[i].alias(nm) for i, nm in enumerate(names)])


def group_quantiles(df: DataFrame, keys: Sequence[str], x: str, probs: Sequence[float],
                    names: Sequence[str] | None = None, bounded_groups: bool = False) -> DataFrame:
    """Exact linearly interpolated quantiles per group (type 7: the default of
    R ``quantile``, Spark ``percentile``, DuckDB ``quantile_cont``). Missing
    values are ignored. Output: keys, ``n``, one column per prob."""
    names = list(names or [_qname(p) for p in probs])
    rows = cumulative_by_group(df, keys, x, bounded_groups=bounded_groups)
    return quantiles_from_cumulative(rows, list(keys), x, probs, names)


def weighted_quantiles(df: DataFrame, x: str, w: str, probs: Sequence[float],
                       names: Sequence[str] | None = None, sketch: int | None = None) -> DataFrame:
    """Frequency-weighted quantiles (one row).

    ``sketch`` (a size) takes them from a mergeable summary of bounded memory
    instead of the sorted values; ``weighted_sketch`` states its rank error.

    Rows with a missing value or weight are dropped, and so are zero
    weights. With distinct values sorted and cumulative weights ``cum``
    (total ``n``), for each prob ``p``: ``pos = 1 + (n-1) p``,
    ``low = max(floor(pos), 1)``, ``high = min(low + 1, n)``; ``v(t)`` is
    the least value whose ``cum >= t``; the quantile is
    ``(1 - frac(pos)) v(low) + frac(pos) v(high)``.
    """
    names = list(names or [_qname(p) for p in probs])
    if sketch:
        made = weighted_sketch.weighted_sketch(df, [], x, w, sketch)
        # a table without rows has no summary, and one row of missing quantiles
        return weighted_sketch.quantiles_from_sketch(made, [], probs, names).agg(*[F.first(F.col(f"`{c}`")).alias(c) for c in names])
    clean = df.where(F.col(x).isNotNull() & F.col(w).isNotNull() & (F.col(w) > 0))
    rows = cumulative_by_group(clean, [], x, F.col(w).cast("double"))
    n = F.col("__n").cast("double")
    cum, v = F.col("__cum"), F.col(x)
    aggs = [F.max("__n").alias("__n")]
    for p, nm in zip(probs, names):
        pos = 1 + (n - 1) * p
        low = F.greatest(F.floor(pos), F.lit(1))
        high = F.least(low + 1, n)
        aggs.append(F.min(F.when(cum >= low, v)).alias(f"__lo_{nm}"))
        aggs.append(F.min(F.when(cum >= high, v)).alias(f"__hi_{nm}"))
    g = rows.agg(*aggs)
    out = []
    for p, nm in zip(probs, names):
        pos = 1 + (F.col("__n").cast("double") - 1) * p
        frac = pos - F.floor(pos)
        out.append(((1 - frac) * F.col(f"__lo_{nm}") + frac * F.col(f"__hi_{nm}")).alias(nm))
    return g.select(*out)


def box_summary(df: DataFrame, keys: Sequence[str], x: str, coef: float = 1.5,
                bounded_groups: bool = False, approx: bool = False) -> DataFrame:
    """Box-plot statistics per group: n, ymin, lower, middle, upper, ymax,
    n_outliers, notchlower, notchupper (middle -/+ 1.58 IQR / sqrt(n)).
    Whiskers reach the furthest value within ``coef`` IQR of the
    quartiles; values beyond are counted as outliers. Everything is
    computed from the distinct (group, value, count) table, never from a
    group's raw rows gathered in one place. ``approx`` takes the quartiles
    from ``percentile_approx`` instead of exact order statistics."""
    keys = list(keys)
    if approx:
        rows = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count(F.lit(1)).alias("__c"))
        q = approx_group_quantiles(df, keys, x, [0.25, 0.5, 0.75], ["lower", "middle", "upper"])
    else:
        rows = cumulative_by_group(df, keys, x, bounded_groups=bounded_groups)
        q = quantiles_from_cumulative(rows, keys, x, [0.25, 0.5, 0.75], ["lower", "middle", "upper"])
    iqr = F.col("upper") - F.col("lower")
    fences = q.select(*keys, "n", "lower", "middle", "upper",
                      (F.col("lower") - coef * iqr).alias("__lo_f"),
                      (F.col("upper") + coef * iqr).alias("__hi_f"))
    j = join_null_safe(rows.select(*keys, x, "__c"), fences, keys, "inner", broadcast_right=bounded_groups)
    v = F.col(x)
    inside = (v >= F.col("__lo_f")) & (v <= F.col("__hi_f"))
    g = j.groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("lower").alias("lower"), F.max("middle").alias("middle"),
        F.max("upper").alias("upper"),
        F.min(F.when(inside, v)).alias("__inmin"), F.max(F.when(inside, v)).alias("__inmax"),
        F.coalesce(F.sum(F.when(~inside, F.col("__c"))), F.lit(0)).cast("bigint").alias("n_outliers"))
    notch = 1.58 * (F.col("upper") - F.col("lower")) / F.sqrt(F.col("n").cast("double"))
    return g.select(*keys, "n", F.least("lower", "__inmin").alias("ymin"), "lower", "middle", "upper",
                    F.greatest("upper", "__inmax").alias("ymax"), "n_outliers",
                    (F.col("middle") - notch).alias("notchlower"), (F.col("middle") + notch).alias("notchupper"))


def histogram(df: DataFrame, facet: Sequence[str], x: str, bins: int = 30) -> DataFrame:
    """Histogram with one range shared by every facet, binned as the chart
    layer does: ``bins`` bins of width w = (max - min) / (bins - 1) centred
    on min + k w, right-closed (a value on a boundary goes to the lower bin,
    with a 1e-8 w tolerance; the first bin also holds its left edge); a zero
    range gives one bin of width 0.1. Every bin of every facet is reported,
    empty ones with count 0: columns bin, x (centre), xmin, xmax, count.

    The input is reduced once to distinct (facet, value, count) rows,
    checkpointed; the shared range and the bin counts read that table (a
    bin depends only on the value). The empty bins come from a per-facet
    ``sequence`` (bins rows per facet), not from a join of all pairs."""
    facet = list(facet)
    dist = cut_lineage(df.where(F.col(x).isNotNull()).groupBy(*facet, x).agg(F.count(F.lit(1)).alias("__c")))
    rng = dist.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi")).alias("r")).scalar()
    lo, hi = rng.getField("lo"), rng.getField("hi")
    flat = hi <= lo
    width = F.when(flat, F.lit(0.1)).otherwise((hi - lo) / (bins - 1))
    nbins = F.when(flat, F.lit(1)).otherwise(F.lit(bins))
    t = (F.col(x) - (lo - width / 2)) / width
    b = F.when(flat, F.lit(0)).otherwise(F.greatest(F.ceil(t - F.lit(1e-8)) - 1, F.lit(0))).cast("int")
    counts = dist.select(*facet, b.alias("bin"), "__c").groupBy(*facet, "bin").agg(F.sum("__c").alias("count"))
    every = dist.select(*facet).distinct().select(*facet, F.explode(F.sequence(F.lit(0), nbins - 1)).alias("bin"))
    g = join_null_safe(every, counts, [*facet, "bin"], "left")
    centre = lo + F.col("bin") * width
    return g.select(*facet, "bin", centre.alias("x"), (centre - width / 2).alias("xmin"),
                    (centre + width / 2).alias("xmax"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"))


def linear_trend(df: DataFrame, y: str, x: str) -> DataFrame:
    """Least-squares line of y on x (one row): slope, intercept, r2, n."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                  F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def category_order(df: DataFrame, label: str, x: str, fn=mean_strict, name: str = "order") -> DataFrame:
    """Order chart labels by a summary of x (default: mean, missing-propagating).

    The window runs over the per-label summary (one row per chart label)."""
    s = df.groupBy(label).agg(fn(x).alias("order_value"))
    w = Window.orderBy(F.col("order_value").asc_nulls_last(), F.col(label).asc_nulls_last())
    return s.withColumn(name, F.row_number().over(w).cast("bigint"))


# ---------------------------------------------------------------------------
# Kernel density on a fixed grid
# ---------------------------------------------------------------------------

def density_grid(df: DataFrame, facet: str, x: str, grid: int = 512, cut: float = 3.0,
                 bounded_facets: bool = False, joint: bool = True,
                 limits: tuple[float, float] | None = None) -> DataFrame:
    """Gaussian kernel density per facet on ``grid`` points.

    ``limits``: values outside [lo, hi] are dropped before anything is
    computed (a chart's axis limits do this); the grid itself is not clipped.

    Bandwidth per facet: ``0.9 min(sd, IQR/1.34) n^-1/5`` (falling back to
    sd, then 1, when that spread is 0). With ``joint`` (the ridgeline
    default) every facet uses the mean of the per-facet bandwidths (facets
    with at least two values) and one shared grid from the overall
    min - cut*bw to max + cut*bw; otherwise each facet has its own bandwidth
    and grid.

    Values are binned linearly onto ``grid`` points from 4 bandwidths below the
    evaluation grid to 4 above (each value splits its count between its two
    neighbours), the bins are convolved with the kernel by FFT on a doubled
    grid, so that nothing wraps round, and the result is interpolated linearly
    at the evaluation points: the charting library's way of computing it.

    The input is reduced once to distinct (facet, value, count) rows (the
    checkpointed table of ``cumulative_by_group``). Counts, range, quartiles and
    mean come from one aggregate of it, the two-pass standard deviation from a
    second; the facets' parameters (one row each) are checkpointed, so that
    binning reads the two tables and nothing else. Only binned masses
    (``grid`` rows per facet) reach numpy, whatever the row count."""
    src = df.select(facet, x)
    if limits is not None:
        src = src.where(F.col(x).between(limits[0], limits[1]))
    rows = cumulative_by_group(src, [facet], x, bounded_groups=bounded_facets)
    c, v, n = F.col("__c"), F.col(x), F.col("__n").cast("double")
    at = {name: (n - 1) * p + 1 for name, p in (("q1", 0.25), ("q3", 0.75))}
    reach = lambda h: F.min(F.when(F.col("__cum") >= h, v))
    first = rows.groupBy(facet).agg(F.max("__n").alias("n"), F.min(x).alias("__min"), F.max(x).alias("__max"), (F.sum(c * v) / F.sum(c)).alias("__mean"),
                                    *[a for name, h in at.items() for a in (reach(F.floor(h)).alias(f"__lo_{name}"), reach(F.ceil(h)).alias(f"__hi_{name}"))])
    off = v - F.col("__mean")
    whole = join_null_safe(rows, first.select(facet, "__mean"), [facet], broadcast_right=bounded_facets)
    dev = whole.groupBy(facet).agg(F.sum(c * off * off).alias("__ss"))
    per = join_null_safe(first, dev, [facet])
    quart = {}
    for name, p in (("q1", 0.25), ("q3", 0.75)):
        h = (F.col("n").cast("double") - 1) * p + 1
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        quart[name] = lo + (h - F.floor(h)) * (hi - lo)
    per = per.withColumn("__sd", F.sqrt(F.try_divide(F.col("__ss"), (F.col("n") - 1).cast("double"))))
    spread = F.least(F.col("__sd"), (quart["q3"] - quart["q1"]) / 1.34)
    spread = F.when(spread > 0, spread).when(F.col("__sd") > 0, F.col("__sd")).otherwise(F.lit(1.0))
    per = cut_lineage(per.select(facet, "n", "__min", "__max", (0.9 * spread * F.pow(F.col("n").cast("double"), -0.2)).alias("bw")))
    if joint:
        # one row: the joint bandwidth and the range of all facets
        shared = per.agg(F.struct(F.avg(F.when(F.col("n") > 1, F.col("bw"))).alias("bw"), F.min("__min").alias("lo"), F.max("__max").alias("hi")).alias("s")).scalar()
        par = per.withColumn("__s", shared).select(facet, "n", F.col("__s.bw").alias("bw"), F.col("__s.lo").alias("lo"), F.col("__s.hi").alias("hi"))
    else:
        par = per.select(facet, "n", "bw", F.col("__min").alias("lo"), F.col("__max").alias("hi"))
    par = par.select(facet, "n", "bw", (F.col("lo") - cut * F.col("bw")).alias("g_lo"),
                     ((F.col("hi") - F.col("lo") + 2 * cut * F.col("bw")) / (grid - 1)).alias("g_step"),
                     (F.col("lo") - (cut + 4) * F.col("bw")).alias("b_lo"),
                     ((F.col("hi") - F.col("lo") + 2 * (cut + 4) * F.col("bw")) / (grid - 1)).alias("b_step"))
    par = cut_lineage(par)
    j = join_null_safe(rows.select(facet, x, "__c"), par, [facet], broadcast_right=bounded_facets)
    pos = (v - F.col("b_lo")) / F.col("b_step")
    left = F.floor(pos).cast("int")
    frac = pos - F.floor(pos)
    cells = j.select(facet, F.inline(F.array(
        F.struct(left.alias("i"), (c * (1 - frac)).alias("m")),
        F.struct((left + 1).alias("i"), (c * frac).alias("m")))))
    mass = cells.where((F.col("i") >= 0) & (F.col("i") < grid)).groupBy(facet, "i").agg(F.sum("m").alias("m"))
    mass = join_null_safe(mass, par, [facet], broadcast_right=bounded_facets)
    schema = StructType([StructField(facet, StringType()), StructField("i", LongType()),
                         StructField("x", DoubleType()), StructField("density", DoubleType())])

    def _kde(pdf: pd.DataFrame) -> pd.DataFrame:
        n, bw, g_lo, g_step, b_lo, b_step = (float(pdf[col].iloc[0]) for col in ("n", "bw", "g_lo", "g_step", "b_lo", "b_step"))
        m = np.zeros(grid)
        m[pdf["i"].to_numpy(dtype=int)] = pdf["m"].to_numpy(dtype=float)
        gx = g_lo + g_step * np.arange(grid)
        dens = np.interp(gx, b_lo + b_step * np.arange(grid), gaussian_convolution(m / n, b_step, bw))
        return pd.DataFrame({facet: pdf[facet].iloc[0], "i": np.arange(grid), "x": gx, "density": dens})

    cols = [facet, "i", "m", "n", "bw", "g_lo", "g_step", "b_lo", "b_step"]
    return mass.select(*cols).groupBy(facet).applyInPandas(_kde, schema)


def gaussian_convolution(mass: np.ndarray, step: float, bw: float) -> np.ndarray:
    """Masses on an even grid convolved with a Gaussian kernel, by FFT on a grid twice as long (negative noise set to 0)."""
    n = len(mass)
    k = np.arange(2 * n)
    z = np.minimum(k, 2 * n - k) * step / bw
    kernel = np.exp(-0.5 * z * z) / (bw * np.sqrt(2 * np.pi))
    return np.maximum(0.0, np.fft.irfft(np.fft.rfft(mass, 2 * n) * np.fft.rfft(kernel), 2 * n)[:n])


# ---------------------------------------------------------------------------
# Table profile
# ---------------------------------------------------------------------------

PROFILE_COLUMNS = ["skim_type", "skim_variable", "n_missing", "complete_rate", "mean", "sd",
                   "p0", "p25", "p50", "p75", "p100", "n_unique", "min_len", "max_len", "n_empty",
                   "n_whitespace", "n_true", "n_false", "first_at", "middle_at", "last_at", "hist", "top_counts"]
#: Bins and signs of the small histogram, and how many of the most frequent texts are listed.
HIST_BINS, BARS, TOP = 8, "▁▂▃▅▆▇", 4
_PROFILE_TYPES = {"double": "numeric", "float": "numeric", "byte": "numeric", "short": "numeric", "integer": "numeric", "long": "numeric",
                  "decimal": "numeric", "string": "character", "boolean": "logical", "date": "date", "timestamp": "date", "timestamp_ntz": "date"}


def profile_kind(data_type) -> str:
    """How a column of this type is profiled."""
    return _PROFILE_TYPES.get(data_type.typeName(), "other")


def profile_number(field: StructField) -> Column:
    """A numeric column as a double; a date as its day, a timestamp as its microsecond."""
    c, kind = F.col(f"`{field.name}`"), field.dataType.typeName()
    if kind == "date":
        return F.unix_date(c).cast("double")
    if kind.startswith("timestamp"):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return c.cast("double")


def bars(counts: Sequence[Column]) -> Column:
    """Counts of bins as a row of bars, the highest for the largest count (NULL without rows)."""
    most = F.greatest(*counts)
    return F.when(most > 0, F.concat(*[F.substring(F.lit(BARS), F.greatest(F.lit(1), F.ceil(len(BARS) * c / most)).cast("int"), F.lit(1)) for c in counts]))


def hist_bin(v: Column, lo: Column, hi: Column) -> Column:
    """Bin 1 to HIST_BINS of a value: equal widths from lo to hi, closed on the right, the lowest value in the first; one value alone in a middle bin."""
    return F.when(hi <= lo, F.lit(HIST_BINS // 2)).otherwise(F.greatest(F.lit(1), F.least(F.lit(HIST_BINS), F.ceil((v - lo) / (hi - lo) * HIST_BINS)))).cast("int")


def profile_rows(df: DataFrame, keep: Sequence[str] = (), **cols: Column) -> DataFrame:
    """Profile rows: the given statistics, NULL for the others; columns in ``keep`` go first."""
    types = dict.fromkeys(("mean", "sd", "p0", "p25", "p50", "p75", "p100"), "double") | dict.fromkeys(("first_at", "middle_at", "last_at", "hist", "top_counts"), "string")
    own = {"skim_type": F.col("kind"), "skim_variable": F.col("skim_variable"), "n_missing": F.col("n_missing").cast("bigint"),
           "complete_rate": safe_div(F.col("total") - F.col("n_missing"), "total")} | cols
    return df.select(*keep, *[own.get(c, F.lit(None)).cast(types.get(c, "bigint")).alias(c) if c not in own or c in cols else own[c].alias(c)
                              for c in PROFILE_COLUMNS])


def profile(df: DataFrame, approx: Sequence[str] = ()) -> DataFrame:
    """One row per column, whatever its type: missing count and complete rate
    for all; mean, sd and exact quartiles for numeric columns (decimals as
    doubles); distinct count, lengths and empty and blank counts for text;
    counts of both values for logical columns; distinct count, first, middle
    (lower median) and last for dates and timestamps. ``hist`` shows the
    shape of a numeric column in HIST_BINS bars, ``top_counts`` the TOP most frequent
    texts with their counts (ties: smaller first). ``sketches.profile_sketch`` gives
    the same columns from one scan, with stated errors.

    Missing counts come from one aggregate of a single row. Numbers and dates
    become (variable, value) counts in one aggregation, sorted once and
    checkpointed (``cumulative_by_group``); all their statistics read that
    table, and per-variable rows are broadcast (one per column). Numeric
    columns named in ``approx`` (meant for nearly unique ids) are not reduced
    to distinct values: their quartiles come from ``percentile_approx`` in the
    first aggregate."""
    var = "skim_variable"
    of = {f.name: profile_kind(f.dataType) for f in df.schema.fields}
    col = lambda c: F.col(f"`{c}`")
    if not of:
        raise ValueError("a table without columns has no profile")

    number = lambda c: profile_number(df.schema[c])
    rough = [c for c in approx if of.get(c) == "numeric"]
    first = df.agg(F.count(F.lit(1)).alias("total"), *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(of)],
                   *[F.count(F.when(col(c), 1)).alias(f"t{i}") for i, c in enumerate(of) if of[c] == "logical"],
                   *[x for i, c in enumerate(of) if c in rough for x in (
                       F.avg(number(c)).alias(f"m{i}"), F.stddev_samp(number(c)).alias(f"s{i}"),
                       F.percentile_approx(number(c), [0.0, .25, .5, .75, 1.0]).alias(f"q{i}"))])
    none = F.lit(None).cast("double")
    cells = [F.struct(F.lit(c).alias(var), F.lit(of[c]).alias("kind"), "total", (F.col("total") - F.col(f"n{i}")).alias("n_missing"),
                      (F.col(f"t{i}") if of[c] == "logical" else F.lit(None).cast("bigint")).alias("n_true"),
                      (F.col(f"m{i}") if c in rough else none).alias("mean"), (F.col(f"s{i}") if c in rough else none).alias("sd"),
                      (F.col(f"q{i}") if c in rough else F.lit(None).cast("array<double>")).alias("q"), F.lit(c in rough).alias("rough"))
             for i, c in enumerate(of)]
    per_var = cut_lineage(first.select(F.inline(F.array(*cells))))
    here = F.col("total") - F.col("n_missing")
    quartiles = ("p0", "p25", "p50", "p75", "p100")
    # logical columns, roughly profiled ones and kinds without statistics
    parts = []
    if any(k in ("logical", "other") for k in of.values()) or rough:
        plain = per_var.where(F.col("kind").isin("logical", "other") | F.col("rough"))
        parts.append(profile_rows(plain, mean=F.coalesce("mean", safe_div("n_true", here)), sd=F.col("sd"), n_true=F.col("n_true"),
                                   n_false=here - F.col("n_true"), **{p: F.get("q", i) for i, p in enumerate(quartiles)}))
    exact = [c for c in of if of[c] in ("numeric", "date") and c not in rough]
    text = [c for c in of if of[c] == "character"]
    if exact:
        long = very_wide_to_long(df.select(*[number(c).alias(c) for c in exact]), [], exact, var, "v")
        dist = long.where(F.col("v").isNotNull()).groupBy(var, "v").agg(F.count(F.lit(1)).alias("c"))
        rows = cumulative_by_group(dist, [var], "v", F.col("c"), bounded_groups=True, distinct=True)
        n = F.col("__n").cast("double")
        at = {p: (n - 1) * q + 1 for p, q in zip(quartiles, (0, .25, .5, .75, 1))}
        reach = lambda h: F.min(F.when(F.col("__cum") >= h, F.col("v")))
        stats = rows.groupBy(var).agg(
            F.max("__n").alias("__n"), F.count(F.lit(1)).alias("n_unique"), (F.sum(F.col("__c") * F.col("v")) / F.sum("__c")).alias("mean"),
            reach(F.ceil(F.col("__n") / 2)).alias("middle"),
            *[x for p, h in at.items() for x in (reach(F.floor(h)).alias(f"lo_{p}"), reach(F.ceil(h)).alias(f"hi_{p}"))])
        off = F.col("v") - F.col("mean")
        into = hist_bin(F.col("v"), F.col("lo_p0"), F.col("hi_p100"))
        away = rows.join(F.broadcast(stats.select(var, "mean", "lo_p0", "hi_p100")), var).groupBy(var).agg(
            F.sqrt(F.try_divide(F.sum(F.col("__c") * off * off), (F.max("__n") - 1).cast("double"))).alias("sd"),
            *[F.sum(F.when(into == i + 1, F.col("__c")).otherwise(0)).alias(f"bin{i}") for i in range(HIST_BINS)])
        s = per_var.drop("mean", "sd").where(F.col("kind").isin("numeric", "date") & ~F.col("rough"))
        s = s.join(F.broadcast(stats), var, "left").join(F.broadcast(away), var, "left")
        number_, date_ = (lambda c: F.when(F.col("kind") == "numeric", c)), (lambda c: F.when(F.col("kind") == "date", c))
        days = F.col(var).isin([c for c in exact if df.schema[c].dataType.typeName() == "date"])
        shown = lambda c: date_(F.when(days, F.date_from_unix_date(F.col(c).cast("int")).cast("string")).otherwise(
            F.date_format(F.timestamp_micros(F.col(c).cast("bigint")), "yyyy-MM-dd HH:mm:ss")))
        between = {p: number_(F.col(f"lo_{p}") + (h - F.floor(h)) * (F.col(f"hi_{p}") - F.col(f"lo_{p}"))) for p, h in at.items()}
        parts.append(profile_rows(s, mean=number_(F.col("mean")), sd=number_(F.col("sd")), hist=number_(bars([F.col(f"bin{i}") for i in range(HIST_BINS)])), n_unique=date_(F.coalesce("n_unique", F.lit(0))),
                                   first_at=shown("lo_p0"), middle_at=shown("middle"), last_at=shown("hi_p100"), **between))
    if text:
        long = to_long(df.select(*[col(c) for c in text]), [], text, var, "s")
        values = long.where(F.col("s").isNotNull()).groupBy(var, "s").agg(F.count(F.lit(1)).alias("c"))
        t = values.groupBy(var).agg(
            F.count(F.lit(1)).alias("n_unique"), F.min(F.length("s")).alias("min_len"), F.max(F.length("s")).alias("max_len"),
            F.sum(F.when(F.col("s") == "", F.col("c")).otherwise(0)).alias("n_empty"),
            F.sum(F.when(F.col("s").rlike("^[ \\t\\n\\r\\f]+$"), F.col("c")).otherwise(0)).alias("n_whitespace"))
        first = Window.partitionBy(var).orderBy(F.desc("c"), "s")
        most = values.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= TOP).groupBy(var).agg(
            F.sort_array(F.collect_list(F.struct("__r", F.concat("s", F.lit(": "), F.col("c").cast("string")).alias("t")))).alias("top"))
        s = per_var.where("kind = 'character'").drop("n_true").join(F.broadcast(t), var, "left").join(F.broadcast(most), var, "left")
        zero = lambda c: F.coalesce(c, F.lit(0))
        parts.append(profile_rows(s, n_unique=zero("n_unique"), min_len=F.col("min_len"), max_len=F.col("max_len"),
                                  n_empty=zero("n_empty"), n_whitespace=zero("n_whitespace"), top_counts=F.coalesce(F.array_join(F.col("top.t"), ", "), F.lit(""))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*PROFILE_COLUMNS)
