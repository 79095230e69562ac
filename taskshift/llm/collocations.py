"""Phrase collocation mining by SETM.

Texts are lower-cased (A-Z), cut into pieces and words. The occurrence relation
R_k holds, for every position that starts a frequent phrase of k words, that
phrase's id. It is persisted in position order, one row a document: an array
whose index is the position, with 0 where a piece ends or no frequent phrase
starts. So relations are sorted by (document, piece, position) as they are written.

* R_1 holds the words with at least ``LEAST`` occurrences.
* Merge join: phrases of k + 1 words are the pairs (left, right) of R_k at adjacent
  positions of one piece; both parts are frequent by construction.
* Group count: pairs are counted by id, combined in the tasks before the shuffle. A
  pair's left part goes with its count; the id and the left part give the right one.
* Semi-join: R_{k+1} keeps the positions of frequent pairs and is written before
  the next length. The frequent ids come as a bit map of at most ``MOST_BITS``
  bits, whatever their number; ids that it lets pass wrongly only cost room, as
  the exact counts decide at every length.

An id is a 64-bit hash (of language and word, then of the two parts' ids; for each
left part one to one in the right part). Each frequent id is checked to have one left
part, so to stand for one pair, and to stand for one word; if two share one, the run
is repeated with other hashes, so counts are exact.

A frequent phrase knows its two parts, so its words, and the counts of all its
beginnings and ends, follow from joins with the phrases one word shorter. That gives
the score of each cut, and a phrase that a longer one covers is found
among the parts of the phrases one word longer: if a phrase two words longer covers
it, so does one in between.

Scale: text is read twice (count, R_1), relations shrink with length and
are only scanned; shuffles hold combined counts and frequent phrases. The most
frequent phrase is one row per task. The ranking keeps each task's first ``TOP``
of a language before its shuffle. The tables of frequent phrases are
joined as they are, never broadcast.

Defined results: null and empty texts have no words; a null language is ``und``;
repeated rows and ids count again; equal scores rank by count, then phrase; an
empty table, or one without frequent phrases, gives an empty result; a very long
text is one row's array; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taskshift.llm.common import materialize, text_batches
from taskshift.llm.lsh_forest import mixed

LEAST, LONGEST, TOP = 30, 4, 2000
COVERED_PERCENT = 80
SCALE = 2_000_000
NO_LANG = "und"
LEAST_BITS, MOST_BITS = 20, 28
WORDS_KEPT = 200_000
#: Ids that a task combines before it hands counts on, and that it joins at once.
HELD, RUN = 2 << 20, 1 << 19

_U = np.uint64
_RIGHT = _U(0xC2B2AE3D27D4EB4F)
#: Piece ends become an octet that UTF-8 never holds; tabs are blanks; A-Z are lower-cased.
_END = 0xFF
_TABLE = bytes(_END if chr(i) in ".,;:!?\n\x0b\x0c\r" else 32 if i == 9 else i + 32 if 65 <= i <= 90 else i for i in range(256))


class SharedId(ValueError):
    """Two words, or two pairs, share an id; other hashes are needed."""


def tokens(text: bytes) -> list[bytes]:
    """Words of a text and, between and after its pieces, end marks."""
    return text.translate(_TABLE).replace(b"\xff", b" \xff ").split() + [b"\xff"]


class WordIds(dict):
    """Id of a word in one language; 0 for end marks and, with a bit map, for words outside it."""

    def __init__(self, lang: str, seed: int, bits: np.ndarray | None = None):
        self.lang, self.seed, self.bits = lang.encode() + b"\0", seed, bits
        self.shift = 0 if bits is None else 65 - len(bits).bit_length()

    def __missing__(self, word: bytes) -> int:
        h = 0
        if word != b"\xff":
            h = xxhash.xxh3_64_intdigest(self.lang + word, self.seed) or 1
            if self.bits is not None and not self.bits.item(h >> self.shift) >> (h & 63) & 1:
                h = 0
        # the frequent words come early; what is rare is looked up again
        if len(self) < WORDS_KEPT:
            self[word] = h
        return h


def passed(ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which ids the bit map lets pass."""
    shift = _U(64 - int(len(bits)).bit_length() + 1)
    return (bits[ids >> shift] >> (ids & _U(63)) & _U(1)).astype(bool)


def bit_map(ids: DataFrame) -> np.ndarray:
    """Bit map of the column ``id``: 16 bits an id, between 2 ** LEAST_BITS and 2 ** MOST_BITS bits in all."""
    size = min(MOST_BITS, max(LEAST_BITS, (16 * ids.count()).bit_length()))
    rows = ids.select(F.shiftrightunsigned("id", 64 - (size - 6)).alias("at"), F.expr("shiftleft(1L, cast(id & 63 as int))").alias("bit"))
    got = rows.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (size - 6), _U)
    bits[got["at"].to_numpy()] = got["bits"].to_numpy().view(_U)
    return bits


def joined(ids: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which two ids are adjacent, and the ids of the pairs there."""
    at = np.flatnonzero((ids[:-1] != 0) & (ids[1:] != 0))
    pair = mixed(ids[at] * _left_factor(seed) + mixed(ids[at + 1] ^ _RIGHT))
    return at, np.where(pair == 0, _U(1), pair)


def right_part(pair: np.ndarray, left: np.ndarray, seed: int) -> np.ndarray:
    """The right ids of pairs, from the pairs' ids and their left ids."""
    return unmixed(unmixed(pair) - left * _left_factor(seed)) ^ _RIGHT


def unmixed(h: np.ndarray) -> np.ndarray:
    """What ``mixed`` made ``h`` from."""
    h = (h ^ (h >> _U(31)) ^ (h >> _U(62))) * _U(pow(0x94D049BB133111EB, -1, 1 << 64))
    h = (h ^ (h >> _U(27)) ^ (h >> _U(54))) * _U(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return h ^ (h >> _U(30)) ^ (h >> _U(60))


def _left_factor(seed: int) -> np.uint64:
    return _U(0x9E3779B97F4A7C15 + 2 * seed)


def id_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of whole rows of a relation with about ``RUN`` ids: the rows, their ids end to end, and where rows begin. Rows end in 0, so none meets the next."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index("ids"))
        bounds = col.offsets.to_numpy()
        first = 0
        while first < len(batch):
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + RUN, side="right")) - 1)
            ids = col.values.slice(int(bounds[first]), int(bounds[last] - bounds[first])).to_numpy(zero_copy_only=False).view(_U)
            yield batch.slice(first, last - first), ids, bounds[first:last + 1] - bounds[first]
            first = last


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, word, id, f) of every word."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("id", pa.int64()), ("f", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def drain() -> Iterator[pa.RecordBatch]:
            for lang, c in counts.items():
                ids = WordIds(lang, seed)
                c.pop(b"\xff", None)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.binary()).cast(pa.string()),
                                                  pa.array(np.fromiter((ids[w] for w in c), _U, len(c)).view(np.int64)), pa.array(list(c.values()), pa.int64())], schema=schema)
            counts.clear()

        for batch, texts in text_batches(batches):
            for lang, text in zip(batch.column(0).to_pylist(), texts):
                counts.setdefault(lang, Counter()).update(tokens(text))
            if sum(map(len, counts.values())) >= WORDS_KEPT:
                yield from drain()
        yield from drain()

    d = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), "text").mapInArrow(run, "lang string, word string, id bigint, f bigint")
    return d.groupBy("lang", "word", "id").agg(F.sum("f").alias("f"))


def word_relation(docs: DataFrame, bits: np.ndarray, seed: int) -> DataFrame:
    """R_1: (lang, ids) of every document, for words in the bit map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_lang: dict[str, WordIds] = {}
        for batch, texts in text_batches(batches):
            langs, rows = batch.column(0).to_pylist(), []
            for lang, text in zip(langs, texts):
                if lang not in by_lang:
                    if len(by_lang) >= 64:
                        by_lang.clear()
                    by_lang[lang] = WordIds(lang, seed, bits)
                t = tokens(text)
                rows.append(np.fromiter(map(by_lang[lang].__getitem__, t), _U, len(t)))
            offsets = np.cumsum([0, *map(len, rows)])
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(rows).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), ids], names=["lang", "ids"])

    return docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), "text").mapInArrow(run, "lang string, ids array<bigint>")


def pair_counts(relation: DataFrame, seed: int) -> DataFrame:
    """(id, f, left) of every pair of adjacent ids: counted in the tasks, then in all; ``others`` tells if an id stands for two pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty(0, _U), np.empty(0, _U), np.empty(0, np.int64)
        fresh: list[tuple[np.ndarray, np.ndarray]] = []

        def combine():
            nonlocal held
            n = np.ones(len(held[0]) + sum(len(x) for x, _ in fresh), np.int64)
            n[:len(held[0])] = held[2]
            ids, left = (np.concatenate([held[k], *[x[k] for x in fresh]]) for k in (0, 1))
            held = ()
            fresh.clear()
            order = np.argsort(ids, kind="stable")
            # one by one: few copies at a time
            ids = ids[order]
            left = left[order]
            n = n[order]
            del order
            new = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (left[1:] != left[:-1]))) if len(ids) else np.empty(0, int)
            held = ids[new], left[new], np.add.reduceat(n, new) if len(new) else n

        def batch_out():
            # equal left parts stand together, which packs well
            order = np.argsort(held[1], kind="stable")
            ids, left, n = (x[order] for x in held)
            return pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(left.view(np.int64)), pa.array(n, pa.int64())], names=["id", "left", "f"])

        for _, ids, _ in id_runs(batches):
            at, pair = joined(ids, seed)
            fresh.append((pair, ids[at]))
            if sum(len(x) for x, _ in fresh) >= HELD:
                combine()
                if len(held[0]) >= HELD:
                    yield batch_out()
                    held = tuple(x[:0] for x in held)
        combine()
        yield batch_out()

    d = relation.select("ids").mapInArrow(run, "id bigint, left bigint, f bigint")
    others = F.min("left") != F.max("left")
    return d.groupBy("id").agg(F.sum("f").alias("f"), F.min("left").alias("left"), others.alias("others"))


def pair_parts(counts: DataFrame, seed: int) -> DataFrame:
    """Counted pairs with their right parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, left = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).view(_U) for c in ("id", "left"))
            yield batch.append_column("right", pa.array(right_part(pair, left, seed).view(np.int64)))

    return counts.select("id", "f", "left", "others").mapInArrow(run, "id bigint, f bigint, left bigint, others boolean, right bigint")


def pair_relation(relation: DataFrame, bits: np.ndarray, seed: int) -> DataFrame:
    """R_{k+1}: R_k joined with itself at adjacent positions, kept where the pair is in the bit map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, starts in id_runs(batches):
            at, pair = joined(ids, seed)
            out = np.zeros(len(ids), _U)
            out[at] = np.where(passed(pair, bits), pair, _U(0))
            rows = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(out.view(np.int64)))
            some = np.add.reduceat(np.append(out != 0, False), starts[:-1]) > 0
            yield pa.RecordBatch.from_arrays([batch.column(0), rows], names=["lang", "ids"]).filter(pa.array(some))

    return relation.select("lang", "ids").mapInArrow(run, "lang string, ids array<bigint>")


def longer(pairs: DataFrame, shorter: DataFrame) -> DataFrame:
    """The frequent phrases one word longer than ``shorter``: words, count, and the counts of their beginnings and ends by length."""
    side = lambda x, *c: shorter.select(F.col("id").alias(x), *[F.col(k).alias(f"{x}_{k}") for k in c])
    d = pairs.join(side("left", "lang", "phrase", "f", "begins"), "left").join(side("right", "last", "f", "ends"), "right")
    return d.select("id", F.col("left_lang").alias("lang"), "f", "left", "right", F.concat_ws(" ", "left_phrase", "right_last").alias("phrase"), F.col("right_last").alias("last"),
                    F.concat("left_begins", F.array("left_f")).alias("begins"), F.concat("right_ends", F.array("right_f")).alias("ends"))


def phrase_tables(docs: DataFrame, least: int, longest: int, seed: int) -> tuple[DataFrame, list[DataFrame]]:
    """Word totals per language, and the frequent phrases of 1 to ``longest`` words."""
    words = materialize(word_counts(docs, seed), "setm-words")
    if not words.groupBy("id").agg(F.count("*").alias("c"), F.sum("f").alias("f")).where((F.col("c") > 1) & (F.col("f") >= least)).isEmpty():
        raise SharedId
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    none = F.array().cast("array<bigint>")
    tables = [materialize(words.where(F.col("f") >= least).select("id", "lang", "f", F.col("word").alias("phrase"), F.col("word").alias("last"),
                                                                   none.alias("begins"), none.alias("ends")), "setm-phrases")]
    relation = materialize(word_relation(docs, bit_map(tables[0]), seed), "setm-relation")
    for k in range(2, longest + 1):
        pairs = materialize(pair_parts(pair_counts(relation, seed).where(F.col("f") >= least), seed), "setm-counts")
        if not pairs.where("others").isEmpty():
            raise SharedId
        tables.append(materialize(longer(pairs, tables[-1]), "setm-phrases"))
        if tables[-1].count() != pairs.count():
            raise SharedId
        if k < longest:
            relation = materialize(pair_relation(relation, bit_map(pairs), seed), "setm-relation")
    return totals, tables


def scored(phrases: DataFrame, parents: DataFrame | None, words: int) -> DataFrame:
    """Phrases of ``words`` words that no phrase one word longer covers, with the score of their weakest cut."""
    cuts = []
    for k in range(1, words):
        left, right = F.get("begins", F.lit(k - 1)), F.get("ends", F.lit(words - k - 1))
        score = F.floor(F.expr(f"cast({SCALE} as decimal(10, 0)) * cast(f as decimal(19, 0)) div (begins[{k - 1}] + ends[{words - k - 1}])"))
        cuts.append(F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    d = phrases.withColumn("cut", F.array_min(F.array(*cuts)))
    if parents is not None:
        held = parents.select("f", F.explode(F.array("left", "right")).alias("part")).groupBy("part").agg(F.max("f").alias("most"))
        d = d.join(held, F.col("id") == F.col("part"), "left").where(F.coalesce(100 * F.col("most") < COVERED_PERCENT * F.col("f"), F.lit(True)))
    return d.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of 2 to ``longest`` words."""
    for seed in range(8):
        try:
            totals, tables = phrase_tables(docs, least, longest, seed)
            break
        except SharedId:
            if seed == 7:
                raise
    every = None
    for k in range(2, longest + 1):
        d = scored(tables[k - 1], tables[k] if k < longest else None, k)
        every = d if every is None else every.union(d)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = every.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
