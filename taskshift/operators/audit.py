"""Row accounting of a whole run: every named step reports its rows in the run itself.

An ``Audit`` goes along a chain of filters, joins and aggregations. Each step
attaches a ``DataFrame.observe`` to the plan, so rows are counted while the query runs:
no second job, no second scan. After the action, ``report`` has a row per step, in order.

* ``where``: rows in, dropped (condition false or missing), rows out;
* ``join``: rows in (left), rows on the right, left rows matched and unmatched, rows of
  the right that met none, rows dropped (an inner join's unmatched), rows out;
* ``into`` / ``out``: rows before and after an aggregation or a pivot.

An audited inner or left join runs as a full outer join that marks each side, and is
filtered after it was counted; that is what it costs to know both sides' leftovers.
``right_only=False`` leaves the right side's out and keeps a (broadcast) left join.
``matched`` counts joined rows, so a key that repeats on the right counts once per pair.
A run whose lost tasks are repeated may count their rows again, as all Spark metrics do.

The functions ``where_step``, ``join_step``, ``into`` and ``out`` take an audit or
None; with None they are the plain operations.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["rows_in", "rows_right", "matched", "unmatched", "right_only", "dropped", "rows_out"]
_LEFT, _RIGHT = "__audit_left", "__audit_right"


class Audit:
    """The steps of one run. Use it for one result, and run that result once."""

    def __init__(self) -> None:
        self._steps: dict[str, tuple[str, list[Observation]]] = {}

    def _observe(self, df: DataFrame, step: str, kind: str, **metrics: Column) -> DataFrame:
        seen = Observation(f"{step}-{uuid.uuid4().hex}")
        self._steps.setdefault(step, (kind, []))[1].append(seen)
        return df.observe(seen, *[c.alias(name) for name, c in metrics.items()])

    def into(self, df: DataFrame, step: str, kind: str = "group") -> DataFrame:
        return self._observe(df, step, kind, rows_in=F.count(F.lit(1)))

    def out(self, df: DataFrame, step: str, kind: str = "group") -> DataFrame:
        return self._observe(df, step, kind, rows_out=F.count(F.lit(1)))

    def where(self, df: DataFrame, cond: Column, step: str) -> DataFrame:
        kept = F.count_if(cond)
        return self._observe(df, step, "filter", rows_in=F.count(F.lit(1)), dropped=F.count(F.lit(1)) - kept, rows_out=kept).where(cond)

    def join(self, left: DataFrame, right: DataFrame, on: Sequence[str], how: str, step: str, null_safe: bool = False,
             right_only: bool = True) -> DataFrame:
        """Inner or left equi-join on the columns ``on`` (``null_safe``: missing keys match each other)."""
        if how not in ("inner", "left"):
            raise ValueError(f"audited joins are inner or left, not {how}")
        kind = f"{how} join"
        names = [*left.columns, *[c for c in right.columns if c not in on]]
        one = F.count(F.lit(1))
        x = self._observe(left.withColumn(_LEFT, F.lit(True)), step, kind, rows_in=one)
        y = self._observe(right.select(*[F.col(f"`{c}`").alias(f"__on_{c}" if c in on else c) for c in right.columns], F.lit(True).alias(_RIGHT)), step, kind, rows_right=one)
        cond = F.lit(True)
        for c in on:
            a, b = x[f"`{c}`"], y[f"`__on_{c}`"]
            cond = cond & (a.eqNullSafe(b) if null_safe else a == b)
        both = x.join(y, cond, "full" if right_only else "left")
        l, r = F.col(_LEFT).isNotNull(), F.col(_RIGHT).isNotNull()
        counts = {"matched": F.count_if(l & r), "unmatched": F.count_if(l & ~r)}
        if right_only:
            counts["right_only"] = F.count_if(~l)
        if how == "inner":
            counts |= {"dropped": F.count_if(l & ~r), "rows_out": F.count_if(l & r)}
        else:
            counts |= {"dropped": F.count_if(F.lit(False)), "rows_out": F.count_if(l)}
        both = self._observe(both, step, kind, **counts).where(l & r if how == "inner" else l)
        return both.select(*[F.col(f"`{c}`") for c in names])

    def report(self, spark: SparkSession) -> DataFrame:
        """One row per step: step (from 1), name, kind and the counts that apply. Waits for the run to end."""
        rows = []
        for i, (name, (kind, seen)) in enumerate(self._steps.items(), 1):
            got = {k: v for obs in seen for k, v in obs.get.items()}
            rows.append((i, name, kind, *[got.get(c) for c in COLUMNS]))
        return spark.createDataFrame(rows, "step int, name string, kind string, " + ", ".join(f"{c} bigint" for c in COLUMNS))


def where_step(audit: Audit | None, df: DataFrame, cond: Column, step: str) -> DataFrame:
    return audit.where(df, cond, step) if audit else df.where(cond)


def join_step(audit: Audit | None, left: DataFrame, right: DataFrame, on: Sequence[str], how: str, step: str) -> DataFrame:
    return audit.join(left, right, on, how, step) if audit else left.join(right, list(on), how)


def into(audit: Audit | None, df: DataFrame, step: str) -> DataFrame:
    return audit.into(df, step) if audit else df


def out(audit: Audit | None, df: DataFrame, step: str) -> DataFrame:
    return audit.out(df, step) if audit else df


def run_report(result: DataFrame, audit: Audit) -> DataFrame:
    """Run a result once, keep nothing of it, and give its audit."""
    result.write.format("noop").mode("overwrite").save()
    return audit.report(result.sparkSession)
