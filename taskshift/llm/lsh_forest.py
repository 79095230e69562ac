"""MinHash near-dedup with an LSH forest.

A document's set holds its distinct word shingles. Documents with equal sets
are one class, so copies never meet pair by pair. Each class has ``TREES``
labels of ``DEPTH`` min-hashes: the forest's signature orders. Sorted by
label, the classes that share a prefix stand together; a region is a shared
prefix, and its depth adapts to how crowded it is:

* a region of up to ``SMALL`` classes has all its pairs as candidates;
* a larger one is descended (``levels``), so that its neighbours with longer
  common prefixes are compared, and on every level its classes meet its
  pivots: the class with most company at full depth (the likely origin of a
  crowd of near copies) and a few picked by hash;
* what a crowded region of the least depth, which holds the deeper ones, still
  keeps apart after that (classes outside its main component) is found by an
  exact index: sets that are alike share one of their rarest shingles. Classes
  that only share shingles of more than ``LIST`` of them are compared block by block: by one
  byte of each min-hash, and what is left by it on signatures and full sets in
  one task.

The least depth is the largest of up to four at which a pair at the threshold
shares no prefix in any tree with a probability of at most ``MISSED``.

Candidates are confirmed on the full sets (``100 * both >= percent *
either``). The pairs most often proposed are confirmed first; later ones only
if their ends are not yet linked. Components are the smallest doc_id
reachable.

Scale: documents are reduced to a signature row each; texts are read again
only for classes with candidates, and one shuffle of texts picks those.
Regions are counted before they are gathered, only ``SMALL`` ones are
gathered, and joins with a crowded side are plain joins that AQE splits. The index
of a crowd grows with its shingles. Only pages so alike that what they do not share
is less than the similarity leaves open, yet not alike, still meet in
blocks, whose number grows with the square of theirs; each is a task's
bounded unit of work.
Nothing goes through the driver but counts.

Defined results: a null or empty text, or one without words, has no shingles,
component_id = doc_id and is kept; fewer words than a shingle make one
shingle of all of them; rows with a null or a repeated doc_id link by their own
texts (``near_groups``), and in ``near_duplicates`` a null doc_id has a null
component_id and is kept; every row of a repeated doc_id is returned; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskshift.llm.common import materialize, text_batches
from taskshift.llm.graph import components

TREES, DEPTH = 12, 8
MISSED = 2e-4
SMALL = 24
HASH_PIVOTS = 1
BLOCK = 256
#: Signature agreement (of TREES * DEPTH places) from which a pair of a crowded region is confirmed on full sets: about four standard errors under the threshold.
SLACK = 4.0
#: Classes that share a rare shingle are paired up to this number, compared in blocks beyond it.
LIST = 64
#: Slots in which the shingles of crowds are counted.
SLOTS = 1 << 20
WORDS_KEPT = 250_000
SETS_AT_ONCE = 256

_U = np.uint64
_SLOT = _U(64 - SLOTS.bit_length() + 1)
_RNG = np.random.default_rng(20240607)
_MUL = _RNG.integers(1, 2**63, TREES * DEPTH, dtype=np.uint64) * _U(2) + _U(1)
_ADD = _RNG.integers(0, 2**63, TREES * DEPTH, dtype=np.uint64)
_ODD = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F))


class WordHashes(dict):
    """64-bit hash of a word, kept for the words seen last."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def shingles(text: bytes, hashes: WordHashes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles (words in lower case, ASCII letters only)."""
    words = text.lower().split()
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(width, len(w))
    if not k:
        return w
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h = mixed(h * _ODD[j % len(_ODD)] + w[j:len(w) - k + 1 + j])
    return np.unique(h)


def signatures(sets: list[np.ndarray]) -> list[bytes]:
    """Min-hashes of each non-empty set, big-endian, so that byte order is label order."""
    starts = np.cumsum([0, *map(len, sets[:-1])])
    h = np.concatenate(sets)
    out = np.empty((len(sets), TREES * DEPTH), ">u4")
    for i in range(TREES * DEPTH):
        out[:, i] = np.minimum.reduceat((h * _MUL[i] + _ADD[i]) >> _U(32), starts)
    return [row.tobytes() for row in out]


def text_md5() -> Column:
    """What tells rows of one doc_id apart."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("text_md5")


def signed(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_md5, n_shingles, key (128-bit hash of the set; null without one) and signature of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch, texts in text_batches(batches, 1 << 20):
            sets = [shingles(t, hashes, width) for t in texts]
            full = [i for i, s in enumerate(sets) if len(s)]
            sigs, keys = [None] * len(sets), [None] * len(sets)
            if full:
                for i, sig in zip(full, signatures([sets[i] for i in full])):
                    sigs[i], keys[i] = sig, xxhash.xxh3_128_digest(sets[i].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()),
                                              pa.array(sigs, pa.binary())], names=["doc_id", "text_md5", "n_shingles", "key", "sig"])

    return docs.select("doc_id", text_md5(), "text").mapInArrow(run, "doc_id bigint, text_md5 binary, n_shingles bigint, key binary, sig binary")


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text_md5 and the compressed text, so that less is shuffled to pick the documents with candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch, texts in text_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([press.compress(t) for t in texts], pa.binary())], names=["doc_id", "text_md5", "packed"])

    return docs.select("doc_id", text_md5(), "text").mapInArrow(run, "doc_id bigint, text_md5 binary, packed binary")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """id, full set (sorted 64-bit hashes) and signature of each packed document with a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        open_ = zstandard.ZstdDecompressor()
        for whole in batches:
            for start in range(0, len(whole), SETS_AT_ONCE):
                batch = whole.slice(start, SETS_AT_ONCE)
                sets = [shingles(open_.decompress(t), hashes, width) for t in batch.column(1).to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                if full:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(full)), pa.array([sets[i].tobytes() for i in full], pa.binary()),
                                                      pa.array(signatures([sets[i] for i in full]), pa.binary())], names=["id", "set", "sig"])

    return docs.select("id", "packed").mapInArrow(run, "id bigint, set binary, sig binary")


def least_agreement(percent: int) -> float:
    """Places in which the signatures of a pair at the threshold agree at least, but for chance of ``SLACK`` standard errors."""
    j = percent / 100
    return (j - SLACK * (j * (1 - j) / (TREES * DEPTH)) ** 0.5) * TREES * DEPTH


def likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose signatures agree enough to be worth fetching their full sets."""
    least = least_agreement(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), ">u4").reshape(-1, TREES * DEPTH) for c in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least, pa.bool_()))

    x = sets.select(F.col("id").alias("a"), F.col("sig").alias("xa"))
    y = sets.select(F.col("id").alias("b"), F.col("sig").alias("xb"))
    return pairs.join(y, "b").join(x, "a").select("a", "b", "xa", "xb").mapInArrow(run, "a bigint, b bigint")


def alike(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted sets."""
    if len(p) > len(q):
        p, q = q, p
    if 100 * len(p) < percent * len(q):
        return False
    at = np.searchsorted(q, p)
    both = int(np.count_nonzero(q[np.minimum(at, len(q) - 1)] == p))
    return 100 * both >= percent * (len(p) + len(q) - both)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike: 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                keep.append(alike(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = sets.select(F.col("id").alias("a"), F.col("set").alias("sa"))
    y = sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    both = pairs.select("a", "b").join(y, "b").join(x, "a").select("a", "b", "sa", "sb")
    return both.mapInArrow(run, "a bigint, b bigint")


def levels(percent: int) -> tuple[int, ...]:
    """Depths at which regions are formed: the least one, then in steps of two to the full one."""
    least = max([1, *(d for d in range(1, 5) if (1 - (percent / 100) ** d) ** TREES <= MISSED)])
    return (*range(least, DEPTH, 2), DEPTH)


def _prefix(depth: int):
    return F.xxhash64("tree", F.substring("label", 1, 4 * depth))


def regions(classes: DataFrame, least: int) -> DataFrame:
    """(id, tree, label, n) for every class and tree in which n > 1 classes share its prefix of the least depth."""
    trees = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(
        t.cast("tinyint").alias("tree"), F.substring(F.col("sig"), t * (4 * DEPTH) + 1, F.lit(4 * DEPTH)).alias("label")))
    rows = classes.select("id", F.explode(trees).alias("x")).select("id", "x.tree", "x.label").withColumn("at", _prefix(least))
    return rows.join(rows.groupBy("at").agg(F.count("*").alias("n")).where("n > 1"), "at").drop("at")


def crowds(rows: DataFrame, depths: tuple[int, ...]) -> DataFrame:
    """(id, level, at, n, score) of the classes of crowded regions on every level.

    ``score`` adds up, over all trees, how many share the class's full label.
    """
    every = F.array(*[F.struct(F.lit(d).alias("level"), _prefix(d).alias("at")) for d in depths])
    r = rows.where(F.col("n") > SMALL).select("id", F.explode(every).alias("x")).select("id", "x.level", "x.at")
    r = r.join(r.groupBy("at").agg(F.count("*").alias("n")), "at")
    score = r.where(F.col("level") == DEPTH).groupBy("id").agg(F.sum("n").alias("score"))
    return r.join(score, "id")


def candidates(rows: DataFrame, crowd: DataFrame, least: int) -> DataFrame:
    """(a, b, times): pairs of small regions, and of the classes of crowded ones with their pivots."""
    hashed = [F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("h"), "id"))["id"].alias(f"p{k + 1}") for k in range(HASH_PIVOTS)]
    pivots = crowd.where(F.col("n") > SMALL).groupBy("at").agg((-F.max(F.struct("score", (-F.col("id")).alias("m")))["m"]).alias("p0"), *hashed)
    pivots = pivots.select("at", F.array_distinct(F.array(*[F.col(f"p{k}") for k in range(HASH_PIVOTS + 1)])).alias("ps"))
    met = crowd.join(pivots, "at").select("id", F.explode("ps").alias("p")).where("id <> p")
    small = rows.where(F.col("n") <= SMALL).select(_prefix(least).alias("at"), "id").unionByName(
        crowd.where((F.col("n") > 1) & (F.col("n") <= SMALL)).select("at", "id"))
    small = small.groupBy("at").agg(F.collect_list("id").alias("ids"))
    close = small.select("ids", F.explode("ids").alias("a")).select("a", F.explode("ids").alias("b")).where("a > b")
    every = met.select(F.greatest("id", "p").alias("a"), F.least("id", "p").alias("b")).unionByName(close)
    return every.groupBy("a", "b").agg(F.count("*").alias("times"))


def hung(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose ends do not hang on one class after two steps along ``links`` (one link per ``a``)."""
    up = links.groupBy("a").agg(F.min("b").alias("b"))
    over = up.select(F.col("a").alias("b"), F.col("b").alias("c"))
    up = materialize(up.join(over, "b", "left").select("a", F.coalesce("c", "b").alias("root")), "lsh-roots")
    x, y = up.select("a", F.col("root").alias("ra")), up.select(F.col("a").alias("b"), F.col("root").alias("rb"))
    return pairs.join(x, "a", "left").join(y, "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def sketches(sets: DataFrame) -> DataFrame:
    """id and the last byte of each min-hash: where signatures agree, sketches do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s[3::4] for s in batch.column(1).to_pylist()], pa.binary())], names=["id", "sketch"])

    return sets.select("id", "sig").mapInArrow(run, "id bigint, sketch binary")


def rarity(sets: DataFrame) -> np.ndarray:
    """How often shingles occur in the sets, by hash slot: ``SLOTS`` numbers whatever the sets hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for s in batch.column(0):
                counts += 0 if not s.is_valid else np.bincount(np.frombuffer(s.as_buffer(), np.uint64) >> _SLOT, minlength=SLOTS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["slot", "n"])

    got = sets.select("set").mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SLOTS, np.int32)
    counts[got["slot"].to_numpy()] = np.minimum(got["n"].to_numpy(), 2**31 - 1)
    return counts


def rare_keys(sets: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """(key, id, lone, component): the rarest shingles of each set, so many that two sets alike share one of them.

    Sets that are alike share at least ``percent`` of the larger one. So in one order of
    all shingles, here rarest slot first, they meet within the first
    ``size - percent of size + 1`` of each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), SETS_AT_ONCE):
                batch = whole.slice(start, SETS_AT_ONCE)
                keys = []
                for s in batch.column(3):
                    s = np.frombuffer(s.as_buffer(), np.uint64)
                    keys.append(s[np.lexsort((s, counts[s >> _SLOT]))[:len(s) - -(-percent * len(s) // 100) + 1]])
                row = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *[batch.column(c).take(row) for c in range(3)]],
                                                 names=["key", "id", "lone", "component"])

    return sets.select("id", "lone", "component", "set").mapInArrow(run, "key bigint, id bigint, lone boolean, component bigint")


def crowd_links(crowd: DataFrame, sets: DataFrame, found: DataFrame, percent: int, least_depth: int) -> DataFrame:
    """Links that crowded regions of the least depth still hide: their classes
    outside the main component ("lone") against all of them.

    An index of rare shingles finds them: alike sets share one of their rarest. Lists of up to
    ``LIST`` classes give candidate pairs; classes that meet in longer
    lists are compared in blocks, region by region."""
    member = crowd.where((F.col("level") == least_depth) & (F.col("n") > SMALL)).join(found, "id", "left")
    member = member.select("at", "id", F.coalesce("component", "id").alias("component"))
    sizes = member.groupBy("at", "component").agg(F.count("*").alias("k"))
    main = sizes.groupBy("at").agg(F.max(F.struct("k", "component"))["component"].alias("main"), F.count("*").alias("parts")).where("parts > 1")
    member = materialize(member.join(main.select("at", "main"), "at").select("at", "id", "component", (F.col("component") != F.col("main")).alias("lone")), "lsh-members")
    classes = member.groupBy("id").agg(F.max("lone").alias("lone"), F.min("component").alias("component"))
    held = sets.select("id", "set").join(classes, "id")
    keys = materialize(rare_keys(held, rarity(held), percent), "lsh-keys")
    lists = materialize(keys.groupBy("key").agg(F.count("*").alias("n"), F.max("lone").alias("some")).where("n > 1 and some").select("key", "n"), "lsh-lists")
    short = keys.join(lists.where(F.col("n") <= LIST), "key").groupBy("key").agg(F.collect_list(F.struct("id", "lone", "component")).alias("xs"))
    pairs = short.select("xs", F.explode("xs").alias("x")).select("x", F.explode("xs").alias("y"))
    pairs = pairs.where("x.id > y.id and (x.lone or y.lone) and x.component <> y.component").select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    pairs = materialize(pairs, "lsh-rare")
    links = confirmed(likely(pairs, sets, percent), sets, percent)
    hot = keys.join(lists.where(F.col("n") > LIST), "key", "left_semi").select("id").distinct()
    return links.union(block_links(member.join(hot, "id", "left_semi"), sets, percent))


def block_links(member: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of the lone classes of each region ``at`` with all its classes, block by block.

    Sketches pick the classes of a block that may have links in it, full sets confirm
    them in place, and only links leave the task, one per class and component."""
    least = least_agreement(percent)
    counts = member.groupBy("at").agg(F.count("*").alias("n"), F.count_if("lone").alias("n_lone")).where("n_lone > 0")
    member = materialize(member.join(counts, "at"), "lsh-hot")
    blocks, lone_blocks = F.ceil(F.col("n") / BLOCK).cast("int"), F.ceil(F.col("n_lone") / BLOCK).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    held = materialize(sketches(sets.join(member.select("id").distinct(), "id", "left_semi")), "lsh-sketches")
    x = member.where("lone").join(held, "id").select("at", own(lone_blocks).alias("p"), every(blocks).alias("q"), "id", "component", "sketch")
    y = member.join(held, "id").select("at", every(lone_blocks).alias("p"), own(blocks).alias("q"), "id", "component", "sketch")
    spot, names = ["at", "p", "q"], ["at", "p", "q", "id", "component"]

    def met(x: DataFrame, y: DataFrame, run, schema: str) -> DataFrame:
        x, y = x.toDF(*[f"x_{c}" for c in x.columns]), y.toDF(*[f"y_{c}" for c in y.columns])
        return x.groupBy(*[f"x_{c}" for c in spot]).cogroup(y.groupBy(*[f"y_{c}" for c in spot])).applyInArrow(run, schema)

    def near(x: pa.Table, y: pa.Table) -> pa.Table:
        out = []
        if len(x) and len(y):
            xc, yc = np.array(x[4]), np.array(y[4])
            xs, ys = (np.frombuffer(b"".join(t[5].to_pylist()), np.uint8).reshape(-1, TREES * DEPTH) for t in (x, y))
            hits = np.zeros(len(y), bool)
            for k in range(len(x)):
                hit = ((ys == xs[k]).sum(axis=1) >= least) & (yc != xc[k])
                if hit.any():
                    hits |= hit
                    out.append((True, k))
            out += [(False, int(m)) for m in np.flatnonzero(hits)]
        kept = [t.select(range(5)).rename_columns(names).take(pa.array([k for s, k in out if s == side], pa.int64())) for side, t in ((True, x), (False, y))]
        return pa.concat_tables(kept).append_column("lone", pa.array([s for s, _ in out], pa.bool_()))

    picked = materialize(met(x, y, near, "at bigint, p int, q int, id bigint, component bigint, lone boolean"), "lsh-near")
    x, y = (picked.where(side).join(sets, "id").select(*names, "sig", "set") for side in ("lone", "not lone"))

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        read = lambda t: (np.array(t[3]), np.array(t[4]), np.frombuffer(b"".join(t[5].to_pylist()), ">u4").reshape(-1, TREES * DEPTH), t[6])
        out = []
        if len(x) and len(y):
            (xi, xc, xs, xf), (yi, yc, ys, yf) = read(x), read(y)
            for k in range(len(xi)):
                linked, mine = set(), None
                for m in np.flatnonzero(((ys == xs[k]).sum(axis=1) >= least) & (yc != xc[k])).tolist():
                    if yc[m] not in linked:
                        mine = np.frombuffer(xf[k].as_py(), np.uint64) if mine is None else mine
                        if alike(mine, np.frombuffer(yf[m].as_py(), np.uint64), percent):
                            linked.add(yc[m])
                            out.append((int(xi[k]), int(yi[m])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return met(x, y, run, "a bigint, b bigint")


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_md5, n_shingles, component_id, stays for every document.

    Rows are told apart by doc_id and text, so that rows with a repeated or a null
    doc_id link by their own texts. ``component_id`` is the least doc_id of the group (null if
    none has one); ``stays`` marks the (doc_id, text) that stands for it: the least, null ids last.
    """
    feats = materialize(signed(docs, width), "lsh-signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_md5", "sig"))
    classes = feats.where("key is not null").groupBy("key").agg(first.alias("m")).select("key", "m.*", F.monotonically_increasing_id().alias("id"))
    classes = materialize(classes, "lsh-classes")
    depths = levels(percent)
    rows = materialize(regions(classes, depths[0]), "lsh-regions")
    crowd = materialize(crowds(rows, depths), "lsh-crowds")
    pairs = materialize(candidates(rows, crowd, depths[0]), "lsh-pairs")
    need = classes.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id").select("id", F.col("doc_id").alias("of"), F.col("text_md5").alias("md5"))
    reps = packed(docs).join(need, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_md5") == F.col("md5")))
    sets = materialize(shingle_sets(reps.groupBy("id").agg(F.min("packed").alias("packed")), width), "lsh-sets")
    # first the partner that most trees and levels propose for each class, then what that leaves apart
    best = pairs.groupBy(F.col("a").alias("x")).agg(F.max(F.struct("times", (-F.col("b")).alias("m"))).alias("m"))
    first = best.select(F.col("x").alias("a"), (-F.col("m.m")).alias("b"))
    links = materialize(confirmed(first, sets, percent), "lsh-links")
    rest = hung(links, pairs.join(first, ["a", "b"], "left_anti"))
    links = links.union(materialize(confirmed(likely(rest, sets, percent), sets, percent), "lsh-links"))
    found = materialize(components(links), "lsh-found")
    late = materialize(crowd_links(crowd, sets, found, percent, depths[0]), "lsh-late")
    if not late.isEmpty():
        found = components(links.union(late))
    grouped = classes.drop("sig").join(found, "id", "left").withColumn("group", F.coalesce("component", "id"))
    heads = grouped.groupBy("group").agg(F.min(F.struct("none", "doc_id", "text_md5")).alias("head"))
    named = grouped.select("key", "group").join(heads, "group").select(F.col("key").alias("of"), "head")
    out = feats.join(named, F.col("key") == F.col("of"), "left")
    stays = F.col("head").isNull() | (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_md5") == F.col("head.text_md5")))
    return out.select("doc_id", "text_md5", "n_shingles", F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id"), stays.alias("stays"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document; one without a doc_id has no component_id and is kept."""
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return near_groups(docs, width, percent).select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
