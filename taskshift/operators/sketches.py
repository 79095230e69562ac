"""Column profiles from mergeable sketches: one scan, bounded memory, no shuffle of values.

``column_sketches`` makes one row per column (and per group of ``by``): counts and
moments, a HyperLogLog sketch of the values, a KLL quantile sketch of numbers and
dates, and a frequent-items sketch of texts. Each is a partial aggregate, so
only sketches leave the tasks. Rows of several runs, days or partitions are
combined by ``merge_sketches``; ``profile_from_sketches`` turns rows into
the columns of ``stats.profile``.

Stated errors:

* distinct counts: relative standard error ``1.04 / sqrt(2 ** lg)``
  (``distinct_error``; 1.6 % at the default of 12);
* quantiles: the rank of a reported quantile is off by at most
  ``2.296 / k ** 0.9723`` of the rows with 99 % confidence (``rank_error``; 0.35 % at
  the default of 800); a histogram bin is off by at most twice that and 1 / STEPS;
* top counts: exact as long as a column has at most 3/4 of ``items`` different
  values; beyond, only values that make up more than about ``1 / items`` of the
  rows are sure to be listed.

Counts, complete rate, mean, sd, minimum, maximum and text lengths are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskshift.functions.nulls import nan_to_null, safe_div
from taskshift.operators import stats

LG, K, ITEMS = 12, 800, 4096
#: Quantiles from which the ranks of histogram breaks are read.
STEPS = 500
VAR = "skim_variable"
_NO_ITEMS = "array<struct<item:string,count:bigint>>"


def distinct_error(lg: int = LG) -> float:
    """Relative standard error of a distinct count."""
    return 1.04 / 2 ** (lg / 2)


def rank_error(k: int = K) -> float:
    """Rank error of a quantile, as a share of the rows, at 99 % confidence."""
    return 2.296 / k ** 0.9723


def column_sketches(df: DataFrame, by: Sequence[str] = (), lg: int = LG, k: int = K, items: int = ITEMS) -> DataFrame:
    """One row per column of ``df`` that is not in ``by`` (and per group): the mergeable state of its profile."""
    kinds = {f.name: stats.profile_kind(f.dataType) for f in df.schema.fields if f.name not in by}
    if not kinds:
        raise ValueError("a table without columns has no profile")
    aggs = [F.count(F.lit(1)).alias("total")]
    for i, (c, kind) in enumerate(kinds.items()):
        col, number = F.col(f"`{c}`"), stats.profile_number(df.schema[c])
        if kind == "numeric":
            number = nan_to_null(number)
            col = F.when(number.isNotNull(), number)
        present = F.count(col)
        parts = {"n": present}
        if kind == "logical":
            parts["n_true"] = F.count_if(col)
        if kind in ("numeric", "date"):
            parts |= {"mean": F.avg(number), "m2": F.var_pop(number) * present, "lo": F.min(number), "hi": F.max(number),
                      "kll": F.kll_sketch_agg_double(number, k), "hll": F.hll_sketch_agg(F.when(number.isNotNull(), F.xxhash64(number)), lg)}
        if kind == "character":
            parts |= {"min_len": F.min(F.length(col)), "max_len": F.max(F.length(col)), "n_empty": F.count_if(col == ""),
                      "n_whitespace": F.count_if(col.rlike("^[ \\t\\n\\r\\f]+$")), "hll": F.hll_sketch_agg(F.when(col.isNotNull(), F.xxhash64(col)), lg),
                      "top": F.expr(f"approx_top_k_accumulate({_quoted(c)}, {items})")}
        aggs += [x.alias(f"{name}{i}") for name, x in parts.items()]
    one = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    types = {"n": "bigint", "n_true": "bigint", "mean": "double", "m2": "double", "lo": "double", "hi": "double", "min_len": "bigint", "max_len": "bigint",
             "n_empty": "bigint", "n_whitespace": "bigint", "hll": "binary", "kll": "binary"}
    # a frequent-items state, of any text column, has one type; a table without texts has none
    text = [i for i, kind in enumerate(kinds.values()) if kind == "character"]
    types["top"] = one.schema[f"top{text[0]}"].dataType.simpleString() if text else "binary"
    rows = [F.struct(F.lit(c).alias(VAR), F.lit(kind).alias("kind"), F.lit(_days(df, c)).alias("days"), "total",
                     *[(F.col(f"{name}{i}") if f"{name}{i}" in one.columns else F.lit(None)).cast(t).alias(name) for name, t in types.items()])
            for i, (c, kind) in enumerate(kinds.items())]
    return one.select(*by, F.inline(F.array(*rows)))


def _quoted(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def _days(df: DataFrame, c: str) -> bool:
    return df.schema[c].dataType.typeName() == "date"


def merge_sketches(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketch rows of several tables or groups combined, one per column (and per group of ``by``).

    Rows with the same variable must be of the same kind and made with the same parameters.
    """
    n, mean = F.col("n"), F.col("mean")
    all_n, all_sum = F.sum("n"), F.sum(n * mean)
    # sum of squares about the common mean: own ones, and the means' about theirs
    apart = F.sum(n * mean * mean) - safe_div(all_sum * all_sum, F.sum(F.when(mean.isNotNull(), n)))
    aggs = [F.max("days").alias("days"), F.sum("total").alias("total"), all_n.alias("n"), F.sum("n_true").alias("n_true"),
            safe_div(all_sum, F.sum(F.when(mean.isNotNull(), n))).alias("mean"), (F.sum("m2") + F.greatest(apart, F.lit(0.0))).alias("m2"),
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("min_len").alias("min_len"), F.max("max_len").alias("max_len"),
            F.sum("n_empty").alias("n_empty"), F.sum("n_whitespace").alias("n_whitespace"), F.hll_union_agg("hll").alias("hll"),
            F.kll_merge_agg_double("kll").alias("kll")]
    # states of frequent items are combined where there are some: the function takes no nulls
    none = F.lit(None).cast(rows.schema["top"].dataType)
    merged = rows.where("top is null").groupBy(*by, VAR, "kind").agg(*aggs, F.first(none).alias("top"))
    if rows.schema["top"].dataType.typeName() == "struct":
        texts = rows.where("top is not null").groupBy(*by, VAR, "kind").agg(*aggs, F.expr("approx_top_k_combine(top)").alias("top"))
        merged = merged.unionByName(texts)
    return merged.select(*by, *[c for c in rows.columns if c in merged.columns and c not in by])


def profile_from_sketches(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Profile rows (the columns of ``stats.profile``) from sketch rows, one for one."""
    some = F.col("kind").isin("numeric", "date") & (F.coalesce("n", F.lit(0)) > 0)
    q = F.when(some, F.kll_sketch_get_quantile_double("kll", F.array(*[F.lit(p) for p in (0.0, .25, .5, .75, 1.0)])))
    width = (F.col("hi") - F.col("lo")) / stats.HIST_BINS
    steps = F.when(some & (width > 0), F.kll_sketch_get_quantile_double("kll", F.array(*[F.lit((i + 0.5) / STEPS) for i in range(STEPS)])))
    d = rows.withColumn("q", q).withColumn("steps", steps)
    rank = lambda i: F.size(F.filter("steps", lambda x: x <= F.col("lo") + i * width)) / F.lit(float(STEPS))
    d = d.withColumn("ranks", F.when(F.col("steps").isNotNull(), F.array(*[rank(i) for i in range(1, stats.HIST_BINS)])))
    upto = F.concat(F.array(F.lit(0.0)), "ranks", F.array(F.lit(1.0)))
    counts = [F.round(F.greatest(F.get(upto, i + 1) - F.get(upto, i), F.lit(0.0)) * F.col("n")).cast("bigint") for i in range(stats.HIST_BINS)]
    flat = [F.when(F.lit(i == stats.HIST_BINS // 2 - 1), F.col("n")).otherwise(0).cast("bigint") for i in range(stats.HIST_BINS)]
    bars = F.when(some & (F.col("kind") == "numeric"), F.when(F.col("ranks").isNull(), stats.bars(flat)).otherwise(stats.bars(counts)))
    listed = F.lit(None).cast(_NO_ITEMS)
    if rows.schema["top"].dataType.typeName() == "struct":
        # a null is counted as an item of its own, so one more is asked for
        listed = F.when(F.col("top").isNotNull(), F.expr(f"approx_top_k_estimate(top, {stats.TOP + 1})").cast(_NO_ITEMS))
    listed = F.slice(F.filter(listed, lambda x: x["item"].isNotNull()), 1, stats.TOP)
    top = F.when(F.col("kind") == "character", F.array_join(F.transform(listed, lambda x: F.concat(x["item"], F.lit(": "), x["count"].cast("string"))), ", "))
    number_, date_ = (lambda c: F.when(F.col("kind") == "numeric", c)), (lambda c: F.when(F.col("kind") == "date", c))
    shown = lambda c: date_(F.when(F.col("days"), F.date_from_unix_date(c.cast("int")).cast("string")).otherwise(
        F.date_format(F.timestamp_micros(c.cast("bigint")), "yyyy-MM-dd HH:mm:ss")))
    n_unique = F.when(F.col("kind").isin("character", "date"), F.hll_sketch_estimate("hll"))
    here = F.col("n")
    d = d.withColumn("n_missing", F.col("total") - here)
    cols = {"mean": F.coalesce(number_(F.col("mean")), F.when(F.col("kind") == "logical", safe_div("n_true", here))),
            "sd": number_(F.when(here > 1, F.sqrt(F.col("m2") / (here - 1)))), "n_unique": n_unique,
            "n_true": F.col("n_true"), "n_false": here - F.col("n_true"), "hist": bars, "top_counts": top,
            "first_at": shown(F.col("lo")), "middle_at": shown(F.get("q", 2)), "last_at": shown(F.col("hi"))}
    cols |= {c: F.col(c) for c in ("min_len", "max_len", "n_empty", "n_whitespace")}
    cols |= {p: number_(F.get("q", i)) for i, p in enumerate(("p0", "p25", "p50", "p75", "p100"))}
    out = stats.profile_rows(d, keep=by, **cols)
    return out


def profile_sketch(df: DataFrame, by: Sequence[str] = (), lg: int = LG, k: int = K, items: int = ITEMS) -> DataFrame:
    """The profile of every column from one scan and one aggregate; errors as stated in the module."""
    return profile_from_sketches(column_sketches(df, by, lg, k, items), by)


def sketch_audit(df: DataFrame, lg: int = LG, k: int = K, items: int = ITEMS) -> DataFrame:
    """How far the sketch profile is from the exact one, column by column.

    ``distinct_ok``: the distinct count is within four standard errors;
    ``rank_ok``: each quartile lies between the exact quantiles a stated rank error below
    and above it, or is one of the values there (numbers and dates). The
    sketch is made per part of the rows and merged, as for a growing table.
    """
    parts = df.withColumn("__part", F.pmod(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in df.columns]), F.lit(4)))
    got = profile_from_sketches(merge_sketches(column_sketches(parts, ["__part"], lg, k, items).drop("__part")))
    exact = stats.profile(df)
    numeric = [c for c in df.columns if stats.profile_kind(df.schema[c].dataType) == "numeric"]
    probs = (.25, .5, .75)
    e = rank_error(k)
    out = exact.select(VAR, "skim_type", "n_missing", "n_unique", "p0", "p100", "min_len", "max_len")
    g = got.select(F.col(VAR).alias("__v"), F.col("n_missing").alias("g_missing"), F.col("n_unique").alias("g_unique"), F.col("p0").alias("g0"), F.col("p100").alias("g100"),
                   *[F.col(f"p{int(100 * p)}").alias(f"g{int(100 * p)}") for p in probs])
    out = out.join(F.broadcast(g), F.col(VAR) == F.col("__v"))              # one row a column
    if numeric:
        long = stats.very_wide_to_long(df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in numeric]), [], numeric, "of", "v")
        names = [f"{side}{int(100 * p)}" for p in probs for side in ("lo", "hi")]
        bounds = stats.group_quantiles(long, ["of"], "v", [max(0.0, p - e) if s == "lo" else min(1.0, p + e) for p in probs for s in ("lo", "hi")], names, bounded_groups=True)
        out = out.join(F.broadcast(bounds), F.col(VAR) == F.col("of"), "left")
        within = [(F.col(f"g{int(100 * p)}") >= F.col(f"lo{int(100 * p)}")) & (F.col(f"g{int(100 * p)}") <= F.col(f"hi{int(100 * p)}")) for p in probs]
        rank_ok = F.when(F.col("of").isNotNull(), within[0] & within[1] & within[2])
    else:
        rank_ok = F.lit(None).cast("boolean")
    far = F.abs(F.col("g_unique") - F.col("n_unique")) / F.greatest(F.col("n_unique"), F.lit(1))
    return out.select(VAR, "skim_type", "n_missing", "n_unique", "p0", "p100", (far <= 4 * distinct_error(lg)).alias("distinct_ok"), rank_ok.alias("rank_ok"),
                      (F.col("g_missing").eqNullSafe(F.col("n_missing")) & F.col("g0").eqNullSafe(F.col("p0")) & F.col("g100").eqNullSafe(F.col("p100"))).alias("exact_ok"))
