"""Spelling variant grouping by dense prefix-suffix tiling.

The vocabulary is counted in Spark: maximal letter runs, A-Z lower-cased; one run
in 31 (by crc32 of ``<doc_id>:<run>``) loses one code point, which plants known
misspellings. Words of at least ``LEAST_LENGTH`` code points that occur at least
``LEAST_N`` times take part.

Two words are near if one code point is inserted, deleted or replaced. For a pair
whose longer word has M code points that holds exactly if common prefix plus
common suffix reach M - 1. Then either the first M // 2 code points are common or
the last M - M // 2 are, so words are dealt by these halves: each word, for
M = its length and for M = its length + 1, under its first and its last half.
Words of one half form blocks; padded code-point matrices of two blocks (left
aligned for prefixes, right aligned for suffixes) are compared position by
position, which gives common prefix and suffix lengths of all pairs of the tile
at once. A pair that shares both halves is reported under its first one only, so
every near pair is reported once.

A half with more than ``BLOCK`` words is cut into blocks by the word's hash, and
every pair of its blocks is a tile of its own, so that no task holds a whole hot
half. Pairs are compared inside tasks; only near ones leave them.

A word's form is its near word of largest n (ties: smallest), if that n is at
least ``RATIO`` times its own. Forms are followed to their root by doubling the
steps; n grows tenfold a step, so a few rounds do.

Scale: texts are reduced to (word, n) by partial aggregation; the rest works on
the vocabulary. Tiles cost the square of a half's words, which the halves keep
small: half a word is shared by far fewer words than a fixed prefix is.

Defined results: null or empty texts have no words; a null doc_id counts as the
empty string in the hash; repeated rows count again; a very long run is a word
like others; a word without near words has form null, n_near 0 and is its own
root; an empty table, or one without such words, gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskshift.llm.common import materialize

LEAST_LENGTH, LEAST_N = 7, 2
RATIO = 10
#: One run in so many loses a code point.
SPOILED = 31
BLOCK = 1024
#: Tiles of up to so many words are compared row against row, larger ones matrix against matrix.
SMALL = 24
#: Code points of a chunk of tiles that is compared at once.
CHUNK = 4 << 20

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_GAP = "[^a-zÀ-ÿ]+"


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of all words that take part."""
    lower = F.translate(F.coalesce("text", F.lit("")), _UPPER, _UPPER.lower())
    runs = F.filter(F.split(lower, _GAP, -1), lambda w: F.length(w) >= LEAST_LENGTH)
    d = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    d = d.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    spoiled = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    d = d.select(F.when(F.col("h") % SPOILED == 0, spoiled).otherwise(F.col("run")).alias("word"))
    return d.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_N)


def halves(words: DataFrame) -> DataFrame:
    """(word, n, m, first, half): each word under both halves, as the longer word of a pair (m = its length) and the shorter."""
    def half(more: int, first: bool) -> Column:
        m = F.length("word") + more
        front = F.floor(m / 2).cast("int")
        part = F.substring("word", F.lit(1), front) if first else F.right("word", m - front)
        return F.struct(m.alias("m"), F.lit(first).alias("first"), part.alias("half"))

    every = F.array(*[half(more, first) for more in (0, 1) for first in (True, False)])
    return words.select("word", "n", F.explode(every).alias("x")).select("word", "n", "x.*")


def tiles(words: DataFrame, block: int) -> DataFrame:
    """(m, first, half, tile, side, word, n), dealt by tile and sorted, so that a tile's rows follow one another.

    ``tile`` is -1 for halves of one block, else the number of a pair of blocks; ``side`` tells its two blocks apart.
    """
    rows = halves(words)
    big = rows.groupBy("m", "first", "half").agg(F.count("*").alias("c")).where(F.col("c") > block)
    big = big.select("m", "first", "half", F.ceil(F.col("c") / block).cast("int").alias("blocks"))
    d = rows.join(big, ["m", "first", "half"], "left")
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    last = F.col("blocks") - 1
    pairs = F.transform(F.sequence(F.lit(0), last), lambda j: F.struct(
        (F.least(own, j) * F.col("blocks") + F.greatest(own, j)).alias("tile"), (own > j).cast("int").alias("side")))
    whole = F.array(F.struct(F.lit(-1).alias("tile"), F.lit(0).alias("side")))
    d = d.select("m", "first", "half", "word", "n", "blocks", F.explode(F.when(F.col("blocks").isNull(), whole).otherwise(pairs)).alias("x"))
    # a tile of two blocks compares them with each other; the tile of a block with itself compares within
    cross = F.coalesce(F.floor(F.col("x.tile") / F.col("blocks")) != F.col("x.tile") % F.col("blocks"), F.lit(False))
    d = d.select("m", "first", "half", F.col("x.tile").alias("tile"), F.when(cross, F.col("x.side")).alias("side"), "word", "n")
    key = ["m", "first", "half", "tile"]
    return d.repartition(*key).sortWithinPartitions(*key)


def matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths and the code points of words, padded right and padded left (letters up to U+00FF are one octet each)."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    at, width = np.arange(lens.max()), int(lens.max())
    left, right = np.zeros((len(words), width), np.uint8), np.zeros((len(words), width), np.uint8)
    left[at < lens[:, None]] = flat
    right[at >= width - lens[:, None]] = flat
    return lens, left, right


def common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Common prefix lengths of all rows of x with all rows of y."""
    alive = np.ones((len(x), len(y)), bool)
    length = np.zeros((len(x), len(y)), np.int32)
    for k in range(x.shape[1]):
        alive &= x[:, k, None] == y[None, :, k]
        if not alive.any():
            break
        length += alive
    return length


def compare_rows(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common prefix and suffix lengths of the row pairs (a[i], b[i])."""
    same = left[a] == left[b]
    pre = np.where(same.all(axis=1), same.shape[1], same.argmin(axis=1))
    same = (right[a] == right[b])[:, ::-1]
    return pre, np.where(same.all(axis=1), same.shape[1], same.argmin(axis=1))


def near_in_chunk(starts: np.ndarray, m: np.ndarray, first: np.ndarray, side: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs that are near, of all tiles of a chunk; ``starts`` bounds the tiles."""
    lens, left, right = matrices(words)
    sizes = np.diff(starts)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def keep(a, b, pre, suf):
        # one word has the full length; a pair that shares its first half is reported there only; a block is not compared with itself in a tile of two
        ok = (pre + suf >= m[a] - 1) & (np.maximum(lens[a], lens[b]) == m[a]) & (first[a] | (pre < m[a] // 2)) & ((side[a] < 0) | (side[a] != side[b]))
        found.append((a[ok], b[ok]))

    tile = np.repeat(np.arange(len(sizes)), sizes)
    small = np.flatnonzero(sizes[tile] <= SMALL)
    for d in range(1, min(SMALL, int(sizes.max()))):
        if len(small) > d:
            a, b = small[:-d], small[d:]
            hit = tile[a] == tile[b]
            a, b = a[hit], b[hit]
            keep(a, b, *compare_rows(a, b, left, right))
    for t in np.flatnonzero(sizes > SMALL):
        rows = np.arange(starts[t], starts[t + 1])
        width = int(m[rows[0]])
        ps, ss = left[:, :width], right[:, right.shape[1] - width:]
        full, short = rows[lens[rows] == width], rows[lens[rows] == width - 1]
        blocks = [(full, full), (full, short)]
        if side[rows[0]] >= 0:
            by = lambda r, s: r[side[r] == s]
            blocks = [(by(full, 0), by(full, 1)), (by(full, 0), by(short, 1)), (by(full, 1), by(short, 0))]
        for x, y in blocks:
            if len(x) and len(y):
                pre, suf = common(ps[x], ps[y]), common(ss[x][:, ::-1], ss[y][:, ::-1])
                i, j = np.nonzero(pre + suf >= width - 1)
                one = (x[i] < y[j]) if x is y else np.ones(len(i), bool)
                i, j = i[one], j[one]
                keep(x[i], y[j], pre[i, j], suf[i, j])
    return tuple(np.concatenate(z) for z in zip(*found)) if found else (np.empty(0, int), np.empty(0, int))


def near_pairs(words: DataFrame, block: int | None = None) -> DataFrame:
    """(word, near, near_n): every near pair of the vocabulary (word, n), in both directions, once."""
    block = block or BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def near(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            # tiles of one row have no pairs; rows come by length, and padding stays below twice the words' own length
            sizes = np.diff(starts)
            wide = np.floor(np.log2(table["m"].to_numpy()[starts[:-1]]))
            for w in np.unique(wide[sizes > 1]):
                pick = (sizes > 1) & (wide == w)
                part = table.take(pa.array(np.flatnonzero(np.repeat(pick, sizes))))
                words, n = part["word"].to_pylist(), part["n"].to_numpy()
                side = part["side"].fill_null(-1).to_numpy()
                a, b = near_in_chunk(np.concatenate([[0], np.cumsum(sizes[pick])]), part["m"].to_numpy(), part["first"].to_numpy(), side, words)
                both, other = np.concatenate([a, b]), np.concatenate([b, a])
                yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in both], pa.string()), pa.array([words[i] for i in other], pa.string()),
                                                  pa.array(n[other], pa.int64())], schema=schema)

        held: pa.Table | None = None
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if len(held) * int(held["m"][-1].as_py()) >= CHUNK:
                starts = tile_starts(held)
                if len(starts) > 1:          # the last tile may go on in the next batch
                    yield from near(held.slice(0, int(starts[-1])), starts)
                    held = held.slice(int(starts[-1]))
        if held is not None and len(held):
            yield from near(held, np.append(tile_starts(held), len(held)))

    schema = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])
    return tiles(words, block).mapInArrow(run, "word string, near string, near_n bigint")


def tile_starts(table: pa.Table) -> np.ndarray:
    """Row numbers at which a tile begins."""
    new = np.zeros(len(table), bool)
    new[0] = True
    for c in ("m", "first", "half", "tile"):
        col = table[c].combine_chunks()
        new[1:] |= pc.not_equal(col.slice(1), col.slice(0, len(table) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every word with a form: forms followed to the last, twice as many steps each round."""
    r = materialize(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while not r.join(r.select(F.col("word").alias("root")), "root", "left_semi").isEmpty():
        on = r.select(F.col("word").alias("w"), F.col("root").alias("next"))
        r = materialize(r.join(on, F.col("root") == F.col("w"), "left").select("word", F.coalesce("next", "root").alias("root")), "variant-roots")
    return r


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word that takes part."""
    words = materialize(vocabulary(docs), "variant-words")
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    near = near.select(F.col("word").alias("w"), "n_near", F.col("best.near").alias("best"), (-F.col("best.m")).alias("best_n"))
    d = words.join(near, F.col("word") == F.col("w"), "left")
    sure = F.col("best_n") >= RATIO * F.col("n")
    d = materialize(d.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(sure, F.col("best")).alias("form"),
                             F.when(sure, F.col("best_n")).alias("form_n")), "variant-forms")
    r = roots(d.where("form is not null")).select(F.col("word").alias("w"), "root")
    return d.join(r, F.col("word") == F.col("w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
