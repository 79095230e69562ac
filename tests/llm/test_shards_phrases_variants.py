"""Sharding, collocations, spelling variants: against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from taskshift.llm import collocations, range_shards, spelling_variants


def brute_shards(rows, n_shards):
    """Running bytes over all records in key order, groups of equal texts as units unless heavy."""
    recs = sorted((hashlib.md5((t or "").encode()).digest(), -1 if d is None else d, len((t or "").encode()) + 1, t) for d, t in rows)
    total, own, out = sum(r[2] for r in recs), 0, []
    groups = {}
    for h, _, size, _ in recs:
        n, b, start = groups.get(h, (0, 0, own))
        groups[h] = (n + 1, b + size, start)
        own += size
    own, slots = 0, [0] * n_shards
    for h, d, size, t in recs:
        n, b, start = groups[h]
        twice = 2 * own + size if n > 1 and b * n_shards * range_shards.HEAVY > total else 2 * start + b
        s = min(n_shards - 1, n_shards * twice // (2 * total))
        out.append((None if d < 0 else d, size, zlib.crc32((t or "").encode()), s, slots[s]))
        slots[s] += 1
        own += size
    return sorted(out, key=repr)


def shard_rows(df):
    return sorted(((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("ranges, points", [(1024, 16), (12, 2)])
def test_shards_by_brute_force(make_docs, prose, edge_texts, monkeypatch, ranges, points):
    """A third of the rows are copies of one text; ranges of any number give the same shards."""
    monkeypatch.setattr(range_shards, "RANGES", ranges)
    monkeypatch.setattr(range_shards, "POINTS", points)
    texts = edge_texts + [prose(k, 20 + k % 60) for k in range(200)] + [prose(7, 60)] * 130 + [prose(9, 30)] * 3
    ids = [None if i % 50 == 49 else i for i in range(len(texts))]
    docs = make_docs(texts, ids=ids, extra="size shard range start place text_md5 row").repartition(7)
    for n in (8, 3):
        got = shard_rows(range_shards.shards(docs, n))
        assert got == brute_shards(list(zip(ids, texts)), n)
    sizes = {}
    for _, size, _, s, _ in got:
        sizes[s] = sizes.get(s, 0) + size
    assert max(sizes.values()) < 1.1 * min(sizes.values()) + 2 * max(len(t or "") for t in texts)


def test_shards_repeat_null_rows_and_empty_table(make_docs):
    docs = make_docs(["same"] * 90 + ["other"], ids=[None] * 90 + [1])
    got = shard_rows(range_shards.shards(docs))
    assert got == brute_shards([(None, "same")] * 90 + [(1, "other")], 8) and len({r[3] for r in got}) == 8
    assert range_shards.document_shards(make_docs([])).collect() == []
    assert [(r["law"], r["slot"], r["grown_shard"]) for r in range_shards.document_shards(make_docs([None])).collect()] == [("bytes", 0, None)]


def test_written_shards_hold_the_whole_rows(spark, make_docs, prose, tmp_path):
    docs = make_docs([prose(k, 30) for k in range(60)] + [None], extra="row slot")
    range_shards.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.drop("shard").collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)
    want = {(r["doc_id"], r["shard"]) for r in range_shards.shards(docs, 4).collect()}
    assert {(r["doc_id"], r["shard"]) for r in back.collect()} == want


def one_edit(x, y):
    """True if one inserted, deleted or replaced code point turns x into y."""
    if len(x) > len(y):
        x, y = y, x
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1:] == x for i in range(len(y)))


def brute_variants(rows):
    count = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            count[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 7 and c >= 2}
    near = {w: [x for x in n if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in n}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] is not None else None))
    return sorted(out)


@pytest.fixture(scope="module")
def misspelt():
    """Texts over words of one stem, with edits at every place, some a hundred times as frequent as others."""
    rng = random.Random(11)
    stems = ["abcdefg", "ébéàüöñstraße", "processing", "aaaaaaaaaa", "zzzzzzz", "x" * 300]
    forms = []
    for s in stems:
        forms += [(s, 400), (s + "ing", 30)]
        for i in range(len(s) if len(s) < 20 else 5):
            forms += [(s[:i] + s[i + 1:], 3), (s[:i] + "q" + s[i:], 2), (s[:i] + "é" + s[i + 1:], rng.choice([1, 2, 30]))]
    forms += [("stem" + "".join(rng.choice("ab") for _ in range(5)), rng.choice([2, 25, 300])) for _ in range(60)]
    flat = [w for w, c in forms for _ in range(c)]
    rng.shuffle(flat)
    return [" ".join(flat[i:i + 50]) for i in range(0, len(flat), 50)] + [None, "", "Processing, PROCESSING\nÉBÉÀÜÖÑSTRASSE x÷y ×× 漢字processing"]


@pytest.mark.parametrize("block", [1024, 5])
def test_variants_by_brute_force(make_docs, misspelt, monkeypatch, block):
    """Also with halves cut into very small blocks, and tiles compared as matrices."""
    monkeypatch.setattr(spelling_variants, "BLOCK", block)
    ids = [None if i % 40 == 39 else i for i in range(len(misspelt))]
    docs = make_docs(misspelt, ids=ids, extra="word n m first half tile side form").repartition(5)
    got = sorted(tuple(r) for r in spelling_variants.variants(docs).collect())
    assert got == brute_variants(list(zip(ids, misspelt)))
    assert sum(r[1] is not None for r in got) > 30


def test_variants_chain_and_empty_table(spark, make_docs):
    assert spelling_variants.variants(make_docs([])).collect() == [] and spelling_variants.variants(make_docs([None, "short"])).collect() == []
    steps = [("aaaaaaab" + "c" * k, "aaaaaaab" + "c" * (k + 1)) for k in range(13)]
    forms = spark.createDataFrame([*steps, ("lone1", "lone2")], "word string, form string")
    assert {tuple(r) for r in spelling_variants.roots(forms).collect()} == {(w, steps[-1][1]) for w, _ in steps} | {("lone1", "lone2")}


def test_a_tile_is_cut_where_batches_end(spark, monkeypatch):
    """Chunks are compared when whole tiles fill them, whatever batches they come in."""
    monkeypatch.setattr(spelling_variants, "CHUNK", 64)
    monkeypatch.setattr(spelling_variants, "SMALL", 3)
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(7, 9))) for _ in range(300)})
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n bigint").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = [(r["word"], r["near"]) for r in spelling_variants.near_pairs(df, 16).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {(a, b) for a in words for b in words if a != b and abs(len(a) - len(b)) < 2 and one_edit(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def brute_collocations(rows, least, longest, top):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        c = f.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\\n\\x0b\\x0c\\r]", "".join(x.lower() if x.isascii() else x for x in text or "")):
            ws = tuple(re.findall("[^ \\t]+", piece))
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                c.update(ws[i:i + k] for i in range(len(ws) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        covered = set()
        for p, a in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    if 100 * a >= 80 * c[p[i:i + m]]:
                        covered.add(p[i:i + m])
        ranked = []
        for p, a in cand.items():
            if p not in covered:
                score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


@pytest.fixture(scope="module")
def spoken():
    """Texts of few words in three languages and none, with set phrases, a hot one, and odd signs."""
    rng = random.Random(21)
    words = ["alpha", "beta", "Gamma", "délta", "中文", "e\u0301", "zeta", "ETA", "x\x00y", "θ"]
    fixed = ["new york city", "the the the the", "of course,", "as well as Gamma", "beta\talpha beta", "end. new start"]
    rows = []
    for i in range(240):
        t = " ".join(rng.choice(fixed) if rng.random() < 0.4 else rng.choice(words) + rng.choice(["", "", "", ",", " .", "\n", "\x0b"]) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "de", None, "und"]), t))
    return rows + [("en", "hot phrase here")] * 120 + [("en", None), (None, ""), ("fr", "rare words only"), ("de", "long " * 30_000)]


def test_collocations_by_brute_force(spark, spoken, monkeypatch):
    """Also with very small runs, counts handed on early, and word tables that are emptied all the time."""
    df = spark.createDataFrame([(i, lang, t, "x", "y") for i, (lang, t) in enumerate(spoken)], "doc_id bigint, lang string, text string, id string, f string").repartition(5)
    want = brute_collocations(spoken, 30, 4, 2000)
    assert [r for r in want if r[0] == "und"] and any(r[2] == "new york city" for r in want) and not any(r[2] == "new york" for r in want)
    assert sorted(tuple(r) for r in collocations.collocations(df).collect()) == want
    for name, value in (("HELD", 50), ("RUN", 7), ("WORDS_KEPT", 5)):
        monkeypatch.setattr(collocations, name, value)
    assert sorted(tuple(r) for r in collocations.collocations(df, 12, 3, 40).collect()) == brute_collocations(spoken, 12, 3, 40)


def test_collocations_with_ids_that_clash_and_empty_table(spark, make_docs, spoken, monkeypatch):
    """Hashes of few values clash under the first seed; another seed gives the exact result."""
    few = [r for r in spoken if r[0] == "de"][:30]
    df = spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(few)], "doc_id bigint, lang string, text string")
    tries = []
    first = collocations.phrase_tables

    def clash(docs, least, longest, seed):
        tries.append(seed)
        if seed == 0:
            w = collocations.word_counts(docs, seed).withColumn("id", F.lit(7).cast("long"))
            with monkeypatch.context() as m:
                m.setattr(collocations, "word_counts", lambda *_: w)
                return first(docs, least, longest, seed)
        return first(docs, least, longest, seed)

    monkeypatch.setattr(collocations, "phrase_tables", clash)
    assert sorted(tuple(r) for r in collocations.collocations(df, 5).collect()) == brute_collocations(few, 5, 4, 2000)
    assert tries == [0, 1]
    monkeypatch.undo()
    assert collocations.collocations(make_docs([])).collect() == [] and collocations.collocations(make_docs([None, "a b"])).collect() == []


@pytest.mark.parametrize("tasks", [1, 12])
def test_parts_of_a_pair_come_once_whatever_the_tasks(spark, spoken, tasks):
    """Every task counts; a frequent pair's parts are told by its id and left part, not by each task that meets it."""
    df = spark.createDataFrame([r for r in spoken if r[0] == "de"] * 4, "lang string, text string").repartition(tasks)
    relation = collocations.word_relation(df, np.full(1 << 14, 2**64 - 1, np.uint64), 3)
    want = Counter()
    for r in relation.collect():
        ids = np.array(r["ids"], np.int64)
        want.update((a, b) for a, b in zip(ids[:-1].tolist(), ids[1:].tolist()) if a and b)
    want = {p: n for p, n in want.items() if n >= 30}
    got = collocations.pair_parts(collocations.pair_counts(relation, 3).where("f >= 30"), 3).collect()
    assert len(got) == len(want) > 1 and {(r["left"], r["right"]): r["f"] for r in got} == want
    assert not any(r["others"] for r in got) and len({r["id"] for r in got}) == len(got)
    for r in got:
        assert collocations.joined(np.array([r["left"], r["right"]], np.int64).view(np.uint64), 3)[1].view(np.int64)[0] == r["id"]


def test_pairs_that_share_an_id_are_told(spark, monkeypatch):
    relation = spark.createDataFrame([("de", [1, 2, 0]), ("de", [1, 2, 3, 0]), ("de", [5, 7, 0])], "lang string, ids array<bigint>").repartition(2)
    monkeypatch.setattr(collocations, "joined", lambda ids, seed: ((at := np.flatnonzero((ids[:-1] != 0) & (ids[1:] != 0))), np.where(ids[at] == 5, 8, 9).astype(np.uint64)))
    assert sorted(tuple(r) for r in collocations.pair_counts(relation, 0).select("id", "f", "others").collect()) == [(8, 1, False), (9, 3, True)]


def test_score_arithmetic_passes_64_bits(spark):
    big = 2**61
    row = spark.createDataFrame([(1, "en", big, 2, 3, "a b", "b", [big + 7], [2**62 - 1])], "id long, lang string, f long, left long, right long, phrase string, last string, begins array<long>, ends array<long>")
    got = collocations.scored(row, None, 2).collect()[0]
    assert got["score"] == 2_000_000 * big // (big + 7 + 2**62 - 1)
