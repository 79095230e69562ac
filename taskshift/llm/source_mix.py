"""Mixing sources to target weights by Sainte-Lague apportionment.

Sizes are words. Targets share ``SHARE`` (150 %) of all words by source
weight, stopped at ``MAX_EPOCHS`` (2) times a source's words, the excess
reshared by weight until no source is above its stop (water-filling).

Blocks are then apportioned by highest quotient ``target / (2 s + 1)``: first
among the sources, then, inside a source, among its shards (quotient ``words /
(2 s + 1)``), so every (source, shard) gets an integer quota. Blocks hold
100 words; sources whose target is less than ``LEAST_BLOCKS`` such blocks are
apportioned among themselves in smaller ones, down to single words, so a source ends
within a block or two (1 or 2 64ths) of its target however small it is. Inside a shard, documents lie end to end in a seeded
order, cut into blocks; a seeded stride over the block numbers picks the
quota, going round at most twice. A document takes the words of its that lie
in picked blocks.

Highest quotients are found without listing them all: at the divisor
``sum / n`` plain rounding gives every party its seats but for a difference
``d``; no party's seats can differ from that by more than ``|d|``, so only
``2 |d| + 1`` quotients per party compete for the open seats.

Scale: text is read once for its word count. Documents are shuffled once, by
(source, shard); a source gets one shard per ``SHARD_WORDS`` words or
``SHARD_DOCS`` documents, so a source with a third of all rows is spread like
the rest. Source and shard tables are plain joins, whose broadcast Spark
decides by measured size, and skewed sides are split by AQE; ranks and running
sums over sources, shards and quotients are range-partitioned, none is gathered.

Defined results: null or empty text has size 0 and takes 0; a null source is a
source of its own, after all others; documents are placed by doc_id and text, so
those without a doc_id spread over shards; repeated rows are documents of their own
that lie side by side; an empty table gives an empty result; the mix depends
only on the rows and ``seed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskshift.llm.common import WORD, WORD_GAP, materialize, words_of
from taskshift.operators.ordering import global_row_number, prefix_sum

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_EPOCHS = 2
#: Words of a block: the largest of which a source's target holds LEAST_BLOCKS.
BLOCKS = (2, 4, 8, 16, 32, 64, 100)
LEAST_BLOCKS = 64
SHARD_WORDS = 1 << 20
SHARD_DOCS = 20_000
SEED = 17
#: Strides over block numbers; primes above any shard's number of blocks.
STRIDES = (2147483647, 1073741789, 536870909, 268435399)


def source_targets(sources: DataFrame) -> DataFrame:
    """Targets for a table (source, source_size): weights by rank of the source, water-filled.

    With stops in rising order of stop / weight, the sources that reach their
    stop are a prefix; the rest share what is left by weight. Rank and sums up to
    a source are range-partitioned running sums, so no task holds all sources.
    """
    cycle = F.array(*[F.lit(w) for w in WEIGHTS])
    s = global_row_number(sources, [("source", True, True)], "__k")
    s = s.withColumn("weight", F.get(cycle, ((F.col("__k") - 1) % len(WEIGHTS)).cast("int"))).withColumn("stop", (F.col("source_size") * MAX_EPOCHS).cast("double"))
    s = s.withColumn("__at", F.col("stop") / F.col("weight"))
    rising = [("__at", True, True), ("source", True, True)]
    s = prefix_sum(prefix_sum(s, rising, "stop", "__stops"), rising, "weight", "__weights")
    all_words, all_weight = s.agg(F.sum("source_size")).scalar(), s.agg(F.sum("weight")).scalar()
    s = s.withColumn("__level", (all_words * SHARE - (F.col("__stops") - F.col("stop"))) / (all_weight - (F.col("__weights") - F.col("weight"))))
    s = materialize(s, "mix-levels")
    # the first source, in rising order, that stays under its stop fixes the level for all after it
    level = s.where(F.col("stop") > F.col("weight") * F.col("__level")).agg(F.min(F.struct("__at", "__level"))["__level"]).scalar()
    s = s.withColumn("__level", level)
    target = F.round(F.when(F.col("__level").isNull(), F.col("stop")).otherwise(F.least("stop", F.col("weight") * F.col("__level"))), 6)
    return s.withColumn("target", target).select(*sources.columns, "weight", "target")


def block_words(target) -> Column:
    """Words of a block for a source: the largest of ``BLOCKS`` of which its target holds ``LEAST_BLOCKS``, 1 for smaller targets."""
    out = F.lit(1)
    for b in BLOCKS:
        out = F.when(target >= LEAST_BLOCKS * b, b).otherwise(out)
    return out.cast("long")


def _with_sums(rows: DataFrame, group: list[str], **sums: Column) -> DataFrame:
    """Rows with sums over their group, by aggregate and join: no group is gathered."""
    g = rows.groupBy(*group).agg(*[c.alias(k) for k, c in sums.items()])
    return _matched(rows, g, group)


def _matched(rows: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Left join on columns in which nulls match."""
    other = other.select(*[F.col(c).alias(f"__on_{c}") for c in on], *[c for c in other.columns if c not in on])
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__on_{c}"))
    return rows.join(other, cond, "left").drop(*[f"__on_{c}" for c in on])


def apportion(parties: DataFrame, votes: str, seats: str, group: list[str], key: list[str], out: str) -> DataFrame:
    """Sainte-Lague: ``seats`` (a column, equal within ``group``) by ``votes`` among the group's rows.

    ``key`` names a party within its group and settles equal quotients. Sums of
    a group are aggregates, and the rank of the quotients that compete is a
    range-partitioned row number, so a group may have any number of parties.
    """
    p = _with_sums(parties, group, __all=F.sum(votes))
    p = p.withColumn("__d", F.try_divide(F.col("__all"), F.col(seats)))
    p = p.withColumn("__fair", F.when((F.col(votes) > 0) & (F.col(seats) > 0), F.floor(F.col(votes) / F.col("__d") + 0.5)).otherwise(F.lit(0)).cast("long"))
    p = _with_sums(p, group, __sum=F.sum("__fair"))
    p = p.withColumn("__sure", F.greatest(F.lit(0).cast("long"), F.col("__fair") - F.abs(F.col(seats) - F.col("__sum"))))
    p = materialize(_with_sums(p, group, __given=F.sum("__sure")), "mix-parties")
    p = p.withColumn("__open", F.col(seats) - F.col("__given"))
    q = p.where((F.col(votes) > 0) & (F.col("__open") > 0)).withColumn(
        "__s", F.explode(F.sequence(F.col("__sure"), F.col("__fair") + F.abs(F.col(seats) - F.col("__sum")))))
    names = list(dict.fromkeys([*group, *key]))
    q = q.select(*names, "__open", "__s", (F.col(votes) / (2 * F.col("__s") + 1)).alias("__q"))
    order = [*[(c, True, True) for c in group], ("__q", False, True), *[(c, True, True) for c in key if c not in group], "__s"]
    q = _with_sums(global_row_number(q, order, "__n"), group, __first=F.min("__n"))
    won = q.where(F.col("__n") - F.col("__first") < F.col("__open")).groupBy(*names).agg(F.count("*").alias("__won"))
    return _matched(p, won, names).withColumn(out, F.col("__sure") + F.coalesce("__won", F.lit(0))).select(*parties.columns, out)


def mix(docs: DataFrame, seed: int = SEED, carry: bool = False) -> DataFrame:
    """doc_id, size, source, source_size, target, taken and ``pieces`` of every document.

    ``pieces`` lists the document's parts by block: first word (from 0),
    number of words, times taken. With ``carry``, the input row rides along
    as the struct ``row``.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.md5(text.cast("binary"))))
    base = ["doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("size"), order.alias("order")]
    placed = sizes = materialize(docs.select(*base), "mix-sizes")
    if carry:
        placed = docs.select(*base, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    targets = source_targets(sources).withColumn("block", block_words(F.col("target")))
    targets = _with_sums(targets, ["block"], seats=F.round(F.sum("target") / F.max("block")).cast("long"))
    targets = apportion(targets, "target", "seats", ["block"], ["source"], "blocks")
    targets = targets.withColumn("n_shards", F.greatest(
        F.ceil(F.col("source_size") / SHARD_WORDS), F.ceil(F.col("n_docs") / SHARD_DOCS), F.lit(1)))
    t = materialize(targets.select(F.col("source").alias("__source"), "source_size", "target", "block", "blocks", "n_shards"), "mix-targets")

    def sharded(d: DataFrame) -> DataFrame:
        d = d.join(t, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
        return d.withColumn("shard", F.conv(F.substring("order", 1, 12), 16, 10).cast("long") % F.col("n_shards"))

    shards = sharded(sizes).groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.max("blocks").alias("blocks"), F.max("block").alias("block"))
    shards = apportion(shards, "shard_size", "blocks", ["source"], ["shard"], "quota")
    shards = shards.withColumn("n_blocks", F.ceil(F.col("shard_size") / F.col("block")))
    shards = shards.withColumn("quota", F.least(F.col("quota"), F.col("n_blocks") * MAX_EPOCHS))
    pick = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce("source", F.lit("")), F.col("shard").cast("string")))
    shards = shards.withColumn("offset", F.conv(F.substring(pick, 1, 8), 16, 10).cast("long"))
    shards = shards.withColumn("stride", F.get(F.array(*[F.lit(x).cast("long") for x in STRIDES]), (F.col("offset") % len(STRIDES)).cast("int")))
    h = shards.select(F.col("source").alias("__source"), F.col("shard").alias("__shard"), "quota", "n_blocks", "offset", "stride")

    in_shard = Window.partitionBy("source", "shard").orderBy("order", F.asc_nulls_last("doc_id"), "size")
    placed = sharded(placed).withColumn("first", F.sum("size").over(in_shard.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    placed = placed.join(h, F.col("source").eqNullSafe(F.col("__source")) & (F.col("shard") == F.col("__shard"))).drop("__source", "__shard")
    blocks = F.sequence(F.expr("first div block"), F.expr("(first + size - 1) div block"))
    end, block = F.col("first") + F.col("size"), F.col("block")
    pieces = F.transform(blocks, lambda b: F.struct(
        (F.greatest(F.col("first"), b * block) - F.col("first")).alias("start"),
        (F.least(end, (b + 1) * block) - F.greatest(F.col("first"), b * block)).alias("n"),
        picked(b).alias("times")))
    placed = placed.withColumn("pieces", F.when(F.col("size") > 0, pieces).otherwise(
        F.array().cast("array<struct<start:bigint,n:bigint,times:bigint>>")))
    placed = placed.withColumn("taken", F.aggregate("pieces", F.lit(0).cast("long"), lambda s, x: s + x["n"] * x["times"]))
    return placed.select("doc_id", "size", "source", "source_size", "target", "taken", "pieces", *["row"] * carry)


def picked(b):
    """How often block ``b`` of a shard is taken: full rounds, and once more if the seeded stride ranks it below the rest of the quota."""
    n = F.col("n_blocks")
    rank = F.pmod((F.col("stride") % n) * b + F.col("offset"), n)
    return (F.floor(F.col("quota") / n) + F.when(rank < F.col("quota") % n, 1).otherwise(0)).cast("long")


def document_mix(docs: DataFrame) -> DataFrame:
    """The digest table: what the mix takes of every document."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: up to two rows per document, holding its words in blocks taken at least once, and twice.

    Words keep the white space that follows them; ``n_chars`` is counted anew.
    """
    m = mix(docs, carry=True).where("taken > 0")
    rounds = F.transform(F.sequence(F.lit(1), F.lit(MAX_EPOCHS)), lambda k: F.filter("pieces", lambda x: x["times"] >= k))
    m = m.withColumn("words", F.regexp_extract_all(F.col("row.text"), F.lit(f"({WORD}(?:{WORD_GAP})?)"), 1))
    m = m.withColumn("part", F.explode(F.filter(rounds, lambda r: F.size(r) > 0)))
    m = m.withColumn("text", F.array_join(F.transform("part", lambda x: F.array_join(
        F.slice(F.col("words"), (x["start"] + 1).cast("int"), x["n"].cast("int")), "")), ""))
    out = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return m.select(*[out.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
