"""Near-dedup, suffix dedup, nearest neighbours: against brute force."""

import hashlib
import random

import numpy as np
import pytest

from taskshift.llm import graph, lsh_forest, suffix_dedup, vp_tree


def word_sets(text, width):
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    return {tuple(w)} if len(w) < width else {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}


def near_groups(rows, width, percent):
    sets = [word_sets(t, width) for _, t in rows]
    least = {d: d for d, _ in rows}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    x, y = root(rows[i][0]), root(rows[j][0])
                    least[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for (d, _), s in zip(rows, sets)}


def mutated(text, share, seed):
    rng = random.Random(seed)
    w = text.split()
    for _ in range(int(len(w) * share)):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def near_texts(prose, edge_texts):
    out = list(edge_texts)
    for k in range(6):
        base = prose(100 + k, 150)
        out += [base, base.upper() if k == 0 else base] + [mutated(base, s, k * 10 + i) for i, s in enumerate((0.005, 0.01, 0.02, 0.04, 0.1))]
    crowd = prose(500, 200)
    out += [crowd] + [mutated(crowd, 0.012, 900 + i) for i in range(70)]      # a region larger than SMALL
    return out


def test_near_duplicates_by_brute_force(make_docs, near_texts):
    ids = [3 * i + 1 for i in range(len(near_texts))]
    docs = make_docs(near_texts, ids=ids, extra="key sig id n").repartition(5)
    for width, percent in ((3, 85), (5, 80)):
        want = near_groups(list(zip(ids, near_texts)), width, percent)
        got = {r["doc_id"]: r for r in lsh_forest.near_duplicates(docs, width, percent).collect()}
        assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want
        assert all(r["kept"] == (r["component_id"] == d) for d, r in got.items())


def test_near_duplicates_inside_a_crowd_of_templates(make_docs, prose):
    """Pages of one template, not alike, hold pairs that are alike only to each other; their regions are crowded on every level."""
    frame, texts = prose(600, 250), []
    for k in range(150):
        own = prose(2000 + k, 45)
        head = own.split()[:15]
        texts += [f"{frame} {own}", f"{frame} {' '.join(head)} {prose(4000 + k, 30)}"]
    docs = make_docs(texts)
    want = near_groups(list(enumerate(texts)), 5, 80)
    assert sum(c != d for d, (_, c) in want.items()) == 150
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in lsh_forest.near_duplicates(docs).collect()} == want


def test_pairs_at_the_threshold_share_a_prefix():
    for percent in (70, 80, 85, 95):
        assert (1 - (percent / 100) ** lsh_forest.levels(percent)[0]) ** lsh_forest.TREES <= lsh_forest.MISSED


def test_near_duplicates_of_odd_rows(make_docs, prose):
    a = prose(9, 50)
    docs = make_docs([a, a, a, None, prose(10, 50), a], ids=[5, 5, 2, 9, None, None])
    got = sorted((tuple(r) for r in lsh_forest.near_duplicates(docs).collect()), key=repr)
    assert [(d, c, k) for d, _, c, k in got if d == 5] == [(5, 2, False)] * 2
    assert [(c, k) for d, _, c, k in got if d is None] == [(None, True)] * 2
    assert [(d, n, c) for d, n, c, _ in got if d in (2, 9)] == [(2, 46, 2), (9, 0, 9)]
    assert lsh_forest.near_duplicates(docs.limit(0)).count() == 0


def test_groups_tell_rows_of_one_id_apart(make_docs, prose):
    """A repeated or a null doc_id: every text links as its own, and one (doc_id, text) of a group stays."""
    a, b, c = prose(9, 50), prose(10, 50), prose(11, 50)
    docs = make_docs([a, b, a, None, c, c, b, "", ""], ids=[1, 1, 5, 9, None, None, None, None, 1], extra="id key sig m head")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["stays"]) for r in lsh_forest.near_groups(docs).collect()), key=repr)
    assert got == sorted([(1, 46, 1, True), (1, 46, 1, True), (5, 46, 1, False), (9, 0, 9, True), (None, 46, None, True), (None, 46, None, True),
                          (None, 46, 1, False), (None, 0, None, True), (1, 0, 1, True)], key=repr)


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(600, 700)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(150)]
    links += [(7, 7), (100, 101), (101, 100)]
    least = {}

    def root(x):
        while least.setdefault(x, x) != x:
            x = least[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        least[max(x, y)] = min(x, y)
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = dict(tuple(r) for r in graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    assert got == {x: root(x) for x in linked}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def cut_by_hand(rows, length=50):
    """Expected (n_bytes, n_removed, n_spans, hash) per row of (doc_id, text)."""
    least = {}
    for d, t in rows:
        b = (t or "").encode()
        if d is not None:
            for i in range(len(b) - length + 1):
                w = b[i:i + length]
                least[w] = min(least.get(w, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        if d is not None:
            for i in range(len(b) - length + 1):
                if least[b[i:i + length]] < d:
                    gone[i:i + length] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int)])) if len(b) else np.empty(0)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((d, len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_suffix_dedup_by_brute_force(make_docs, edge_texts, prose, spark, sf, monkeypatch):
    passage = prose(77, 30)
    texts = list(edge_texts) + [prose(200 + k, 30) + " " + passage + " " + prose(300 + k, 30) for k in range(12)]
    texts += ["z" * 49, "z" * 50, "z" * 51, "ab" * 60, "ab" * 80, passage[:50], passage[:49], passage * 3, "é" * 40, "xé" * 40]
    texts += [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    ids = list(range(len(texts)))
    random.Random(4).shuffle(ids)
    ids[20] = ids[21] = None
    ids[30] = ids[31]
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 5_000)
    docs = make_docs(texts, ids=ids, extra="tid spans whole marks").repartition(6)
    got = sorted((tuple(r) for r in suffix_dedup.document_suffix_dedup(docs).collect()), key=repr)
    assert got == cut_by_hand(list(zip(ids, texts)))
    assert suffix_dedup.document_suffix_dedup(docs.limit(0)).count() == 0


def test_suffix_order_is_the_order_of_the_bytes(monkeypatch):
    rng = random.Random(8)
    for alphabet in ("ab", "abcdefgh"):
        data = "".join(rng.choice(alphabet) for _ in range(1500)) + ("abab" * 80) + "a" * 200
        data = np.frombuffer(data.encode(), np.uint8)
        starts = np.arange(len(data) - 49)
        order, same = suffix_dedup.suffix_order(data, starts, 50)
        strings = [data[s:s + 50].tobytes() for s in starts[order]]
        assert strings == sorted(strings)
        assert same.tolist() == [False] + [a == b for a, b in zip(strings, strings[1:])]
    # hashes that collide: equality is decided by the bytes
    monkeypatch.setattr(suffix_dedup.PrefixHashes, "of", lambda self, start, length: np.zeros(len(start), np.uint64))
    order, same = suffix_dedup.suffix_order(data, starts, 50)
    strings = [data[s:s + 50].tobytes() for s in starts[order]]
    assert strings == sorted(strings) and sum(same) == len(strings) - len(set(strings))


def vectors(spark, n=700, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)).astype(np.float32)
    v[300:340] = v[300]                                        # ties
    rows = [(i, [float(x) for x in v[i]], "given") for i in range(n)]
    rows += [(1000, None, ""), (1100, [], ""), (1200, [0.0] * dim, ""), (1300, [float("nan")] * dim, ""), (1400, [1.0, None] + [0.0] * (dim - 2), ""),
             (1500, [float("inf")] + [0.0] * (dim - 1), ""), (1600, [1.0, 2.0], ""), (1601, [1.0, 2.5], ""), (None, [1.0] * dim, ""), (350, rows[350][1], "")]
    return rows, spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score string")


def nearest_by_hand(rows, k=10):
    good = [(i, np.array(e, np.float64)) for i, e, _ in rows if i is not None and e and None not in e and np.isfinite(e).all() and any(e)]
    out = []
    for q, e in {i: e for i, e in good if i % 100 == 0}.items():
        found = []
        for i, v in good:
            if i != q and len(v) == len(e):
                s = 0.0
                for a, b in zip(e, v):
                    s += (a - b) * (a - b)
                found.append((float(np.sqrt(s)), i))
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def test_nearest_by_brute_force(spark, monkeypatch):
    from pyspark.sql import functions as F
    monkeypatch.setattr(vp_tree, "SHARD_ROWS", 300)
    monkeypatch.setattr(vp_tree, "PART_QUERIES", 3)
    rows, df = vectors(spark)
    want = nearest_by_hand(rows)
    got = sorted(tuple(r) for r in vp_tree.nearest(df, F.col("vec_id") % 100 == 0).collect())
    assert got == want
    assert vp_tree.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    # a larger factor prunes more and may lose some, but stays near
    rough = {(q, i) for q, _, i, _ in (tuple(r) for r in vp_tree.nearest(df, F.col("vec_id") % 100 == 0, factor=3.0).collect())}
    assert len(rough & {(q, i) for q, _, i, _ in want}) >= 0.5 * len(want)


def test_tree_prunes_and_stays_exact():
    rng = np.random.default_rng(2)
    points = rng.normal(size=(4000, 3))
    order, nodes, bounds = vp_tree.build(points)
    ids = np.arange(4000)[order]
    q = rng.normal(size=(20, 3))
    s = vp_tree.Search(ids, points[order], nodes, bounds, np.full(20, -1), q, 10, 1.0)
    met = []
    was = s.meet
    s.meet = lambda qq, lo, hi, d=None: (met.append(len(qq) * (hi - lo)), was(qq, lo, hi, d))
    s.run()
    d = vp_tree.distances(q, points)
    assert np.array_equal(s.who, np.argsort(d, axis=1, kind="stable")[:, :10]) and sum(met) < 0.5 * d.size
