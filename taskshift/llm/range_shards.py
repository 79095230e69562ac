"""Sharding by sampled splitters.

The sort key of a record is (md5 of its text, doc_id), so that equal texts stand
together in an order that is otherwise without trend. Its law is ``bytes``:
shards are contiguous stretches of that order with near-equal sizes, a size
being the text's UTF-8 bytes plus 1.

* Records are drawn for a sample with ``POINTS`` points a range on average, in
  proportion to their size; a record larger than a point's share gets several.
* Every ``POINTS``-th point, in key order, is a quantile boundary: ``RANGES``
  ranges of near-equal bytes. Boundaries lie before the first record of a text,
  so a group of equal texts lies in one range.
* Overfull ranges are those that hold a heavy text: one whose copies are more
  than 1 / ``HEAVY`` of a shard. Boundaries inside it subdivide its copies by
  doc_id (then by row), so a text that fills a third of all rows is spread like
  the rest.
* Exact byte and row counts per range (one aggregate) give every range its
  offset; inside a range, running sums give each record's place. A group goes to
  the shard that the middle of its bytes falls in; copies of a heavy text go one
  by one. So the assignment follows from exact sums alone: the sample decides
  only how the work is dealt.

Scale: texts are read once and reduced to a narrow row, written once to the
shared folder; narrow rows are shuffled once, by range. Sample, boundaries,
ranges and heavy texts are bounded by ``RANGES * POINTS``, ``RANGES`` and
``n_shards * HEAVY`` whatever the input, so their single-partition sums and
broadcasts are as well. DataFrame functions only.

Defined results: a null text has size 1, crc32 0 and is equal to the empty text;
a null doc_id sorts first within its text; repeated rows are records of their own
in adjacent slots, interchangeable; more shards than records leave some empty;
an empty table gives an empty result; further columns go along only by ``carry``
and may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taskshift.llm.common import materialize

N_SHARDS = 8
RANGES, POINTS = 1024, 16
#: Copies of one text are subdivided from a hundredth of a shard on.
HEAVY = 100
#: Boundaries are searched in two steps: among every ``STEP``-th, then between two of those.
STEP = 32


def narrow(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, text_md5, row number (unique, not dense) and, with ``carry``, the whole ``row``."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] * carry
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                       F.unhex(F.md5(text)).alias("text_md5"), F.monotonically_increasing_id().alias("nth"), *row)


def heavy_texts(records: DataFrame, total: int, n_shards: int) -> DataFrame:
    """text_md5 of the texts whose copies hold more than 1 / HEAVY of a shard: fewer than ``n_shards * HEAVY``."""
    sums = records.groupBy("text_md5").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    return sums.where((F.col("n") > 1) & (F.col("bytes") * (n_shards * HEAVY) > total)).select("text_md5")


def splitters(records: DataFrame, heavy: DataFrame, total: int) -> DataFrame:
    """One row: the sorted array ``keys`` of range boundaries (text_md5, doc_id, nth).

    A boundary (md5, null, null) stands before all records of a text.
    """
    share = F.lit(RANGES * POINTS / total)
    chance = F.pmod(F.xxhash64("text_md5", "doc_id", "nth"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = records.withColumn("points", F.floor(F.col("size") * share + chance)).where("points > 0")
    h = F.broadcast(heavy.select(F.col("text_md5").alias("heavy")))
    drawn = drawn.join(h, F.col("text_md5") == F.col("heavy"), "left").select("text_md5", "doc_id", "nth", "points", "heavy")
    # the sample has about RANGES * POINTS rows at most, whatever the input
    upto = Window.orderBy("text_md5", F.asc_nulls_first("doc_id"), "nth").rowsBetween(Window.unboundedPreceding, 0)
    drawn = drawn.withColumn("upto", F.sum("points").over(upto))
    cut = drawn.where(F.floor(F.col("upto") / POINTS) > F.floor((F.col("upto") - F.col("points")) / POINTS))
    inside = F.col("heavy").isNotNull()
    key = F.struct("text_md5", F.when(inside, F.col("doc_id")).alias("doc_id"), F.when(inside, F.col("nth")).alias("nth"))
    return cut.agg(F.sort_array(F.collect_set(key)).alias("keys"))


def ranged(records: DataFrame, keys: DataFrame) -> DataFrame:
    """The records with ``range``: how many boundaries are not above their key."""
    tops = F.transform(F.sequence(F.lit(1), F.ceil(F.size("keys") / STEP).cast("int")), lambda i: F.get("keys", (i - 1) * STEP))
    both = keys.select(F.struct("keys", F.when(F.size("keys") > 0, tops).otherwise(F.slice("keys", 1, 0)).alias("tops")).alias("both"))
    d = records.withColumn("__both", both.scalar())
    key = F.struct("text_md5", "doc_id", "nth")
    d = d.withColumn("__top", F.size(F.filter(F.col("__both.tops"), lambda b: b <= key)))
    near = F.slice(F.col("__both.keys"), (F.col("__top") - 1) * STEP + 1, STEP)
    d = d.withColumn("range", F.when(F.col("__top") == 0, 0).otherwise(
        (F.col("__top") - 1) * STEP + F.size(F.filter(near, lambda b: b <= key))))
    return d.drop("__both", "__top")


def shards(docs: DataFrame, n_shards: int = N_SHARDS, carry: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (from 0, gapless in each shard) of every record.

    With ``carry`` the input row goes along as the struct ``row``.
    """
    records = materialize(narrow(docs, carry), "shard-records")
    total = records.agg(F.sum("size")).first()[0] or 1
    heavy = materialize(heavy_texts(records, total, n_shards), "shard-heavy")
    keys = materialize(splitters(records, heavy, total), "shard-keys")
    d = ranged(records, keys)
    sums = d.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)          # over at most RANGES + 1 rows
    sums = sums.select(F.col("range").alias("at"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
                       F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"))
    h = heavy.select(F.col("text_md5").alias("heavy"))
    d = d.join(F.broadcast(sums), F.col("range") == F.col("at")).join(F.broadcast(h), F.col("text_md5") == F.col("heavy"), "left")

    inside = Window.partitionBy("range").orderBy("text_md5", F.asc_nulls_first("doc_id"), "nth")
    d = d.withColumn("start", F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    d = d.withColumn("place", F.col("rows_before") + F.row_number().over(inside) - 1)
    # copies of a text that is not heavy are one unit, less than 1 / HEAVY of a shard; all of them lie in one range
    unit = Window.partitionBy("range", "text_md5")
    light = F.col("heavy").isNull()
    d = d.withColumn("twice_middle", F.when(light, 2 * F.min("start").over(unit) + F.sum("size").over(unit)).otherwise(2 * F.col("start") + F.col("size")))
    d = d.withColumn("shard", F.expr(f"least({n_shards - 1}, ({n_shards} * twice_middle) div {2 * total})").cast("int"))
    placed = materialize(d.select("doc_id", "size", "text_crc32", "shard", "place", *["row"] * carry), "shard-placed")
    first = placed.groupBy("shard").agg(F.min("place").alias("first")).select(F.col("shard").alias("s"), "first")
    out = placed.join(F.broadcast(first), F.col("shard") == F.col("s"))
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"), *["row"] * carry)


def write_shards(docs: DataFrame, path: str, n_shards: int = N_SHARDS) -> None:
    """Write the documents, all columns, to Parquet folders ``shard=0`` to ``shard=n-1`` under ``path`` (as the struct ``row`` if one of them is named shard)."""
    d = shards(docs, n_shards, carry=True)
    clash = "shard" in docs.columns
    d.select("row" if clash else "row.*", "shard").write.partitionBy("shard").parquet(path)


def document_shards(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """The digest table: size, crc32, law, shard and slot of every document."""
    return shards(docs, n_shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                                         F.lit(None).cast("int").alias("grown_shard"))
