"""Suffix dedup: remove bytes of 50-byte strings that a document with a smaller id holds too.

Suffixes are compared by prefix polynomial hashes: the hash of any substring
is a difference of two prefix hashes, and binary search over its length finds
the common extension of two suffixes, so a comparison takes a logarithmic
number of steps. ``suffix_order`` is a bottom-up mergesort with that
comparison (vectorised; the first 24 bytes are sorted as numbers). Suffixes
that agree by hash over the whole length are verified byte by byte.

Not every suffix is sorted in one place. Each window of ``length`` bytes has
a least hash among its ``ANCHOR``-byte substrings; equal windows have equal
least hashes, and consecutive windows with the same one form a run.

1. Only the run hashes (about one per eighteen bytes) are shuffled, once per
   text and batch, to find those that two different texts hold.
2. Texts with such runs send the runs' bytes, grouped by hash; a batch sends a
   string once, for its smallest doc_id (its other documents are covered
   already). Equal strings are collapsed, and the windows of hashes that
   still have several strings are sorted as suffixes. A window is covered if
   its group of equal windows has a smaller doc_id.
3. Covered spans are gathered per document and cut out of its text.

Exact copies of a whole text only take part through their smallest doc_id.

Scale: shuffled are run hashes, shared runs and the texts twice, each in a
job of its own whose shuffle files are dropped. Buckets are as many as the
total text needs at ``BUCKET_BYTES`` each. A frequent passage is one string
per batch, however many documents hold it.

Defined results: a null or empty text, or one shorter than the window, loses
nothing; a document does not lose what only it repeats, nor rows of one
doc_id to each other; a row with a null doc_id neither loses nor covers;
repeated rows are returned as often as given; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskshift.llm.common import materialize, text_batches

LENGTH = 50
ANCHOR = 16
BUCKET_BYTES = 16 << 20
#: Buckets at least, so that small inputs are spread too.
MIN_BUCKETS = 32
RUN_BYTES = 1 << 20
#: Text whose run hashes, or shared strings, one task holds before it sends them.
HASHED_BYTES = 24 << 20
HELD_BYTES = 6 << 20
WINDOWS_AT_ONCE = 1 << 18

_U = np.uint64
_SIGN = np.random.default_rng(50).integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known) <= n:
        known = np.full(max(n + 1, 1 << 20), base, np.uint64)
        known[0] = 1
        known = _powers[base] = np.cumprod(known)
    return known


class PrefixHashes:
    """Prefix polynomial hashes of a byte string (modulo 2**64)."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_SIGN[data] * powers(_BASE, n)[:n], out=self.sums[1:])
        self.back = powers(pow(_BASE, -1, 2**64), n)

    def of(self, start: np.ndarray, length) -> np.ndarray:
        """Hashes of the substrings [start, start + length)."""
        return (self.sums[start + length] - self.sums[start]) * self.back[start]

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.back[:n]

    def common(self, i: np.ndarray, j: np.ndarray, length: int) -> np.ndarray:
        """Length of the common extension of suffixes i and j, up to ``length``, by binary search."""
        low, high = np.zeros(len(i), np.int64), np.full(len(i), length, np.int64)
        while True:
            open_ = low < high
            if not open_.any():
                return low
            middle = (low + high + 1) // 2
            same = self.of(i, middle) == self.of(j, middle)
            low, high = np.where(open_ & same, middle, low), np.where(open_ & ~same, middle - 1, high)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a big-endian number."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = (out << _U(8)) | padded[k:k + len(data)]
    return out


def suffix_order(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts`` by their first ``length`` bytes, and which equals the one before it.

    Suffixes whose hashes agree over the whole length, verified byte by byte,
    are sorted as one. ``length`` is at least 24, and every suffix has as many
    bytes.
    """
    n = len(starts)
    hashes, head = PrefixHashes(data), eight_bytes(data)
    full = hashes.of(starts, length)
    by_hash = np.argsort(full, kind="stable")
    new = np.ones(n, bool)
    new[1:] = full[by_hash[1:]] != full[by_hash[:-1]]
    first, group = by_hash[new], np.empty(n, np.int64)
    group[by_hash] = np.cumsum(new) - 1
    one, equal = starts[first][group], np.ones(n, bool)
    for k in [*range(0, length - 7, 8), length - 8]:
        equal &= head[starts + k] == head[one + k]
    if equal.all():
        rank = np.empty(len(first), np.int64)
        rank[_merge_sort(data, starts[first], full[first], hashes, head, length)] = np.arange(len(first))
        rank = rank[group]
    else:                                      # a collision: rank by the bytes themselves
        strings = [data[s:s + length].tobytes() for s in starts]
        ranks = {s: k for k, s in enumerate(sorted(set(strings)))}
        rank = np.array([ranks[s] for s in strings], np.int64)
    order = np.argsort(rank, kind="stable")
    same = np.zeros(n, bool)
    same[1:] = rank[order[1:]] == rank[order[:-1]]
    return order, same


def _merge_sort(data: np.ndarray, starts: np.ndarray, full: np.ndarray, hashes: PrefixHashes, head: np.ndarray, length: int) -> np.ndarray:
    """Order of different suffixes: by their first 24 bytes as numbers, ties by bottom-up mergesort over common extensions."""
    n = len(starts)
    order = np.lexsort((head[starts + 16], head[starts + 8], head[starts]))
    at, full = starts[order], full[order]

    def before(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """-1, 0, 1: suffix x (positions in ``at``) against y."""
        out = np.zeros(len(x), np.int64)
        differ = np.flatnonzero(full[x] != full[y])
        if len(differ):
            i, j = at[x[differ]], at[y[differ]]
            shared = np.minimum(hashes.common(i, j, length), length - 1)
            out[differ] = np.where(data[i + shared] < data[j + shared], -1, 1)
        return out

    new = np.ones(n, bool)
    new[1:] = (head[at[1:]] != head[at[:-1]]) | (head[at[1:] + 8] != head[at[:-1] + 8]) | (head[at[1:] + 16] != head[at[:-1] + 16])
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, n))
    base, size = np.repeat(first, sizes), np.repeat(sizes, sizes)
    place = np.arange(n)                       # place[r]: which element stands at rank r
    run = 1
    while n and run < sizes.max():
        r = np.flatnonzero(size > run)         # ranks in groups with more than one sorted run
        offset = r - base[r]
        own = offset // run
        other = np.where(own % 2 == 0, own + 1, own - 1)
        low = np.minimum(base[r] + other * run, base[r] + size[r])
        high = np.minimum(low + run, base[r] + size[r])
        start, me = low.copy(), place[r]
        while True:                            # how many of the sister run stand before me
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) // 2
            c = before(place[middle], me[open_])
            smaller = (c < 0) | ((c == 0) & (own[open_] % 2 == 1))
            low[open_] = np.where(smaller, middle + 1, low[open_])
            high[open_] = np.where(smaller, high[open_], middle)
        merged = place.copy()
        merged[base[r] + (own // 2) * 2 * run + offset % run + (low - start)] = me
        place, run = merged, run * 2
    return order[place]


class Runs:
    """The window runs of some texts: ``hash`` (48 bits), ``text`` (its number), ``start`` in it, ``first`` in ``data``, ``size`` in bytes."""

    def __init__(self, texts: list[bytes], length: int):
        self.data = b"".join(texts)
        data = np.frombuffer(self.data, np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        if len(data) < length:
            self.hash, self.text = np.empty(0, np.uint64), np.empty(0, np.int64)
            self.start = self.first = self.size = self.text
            return
        least = mixed(PrefixHashes(data).all(ANCHOR))
        width, span = 1, length - ANCHOR + 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[:width - span], least[span - width:])
        owner = np.repeat(np.arange(len(texts)), sizes)[:len(least)]
        inside = np.arange(len(least)) + length <= ends[owner]
        new = inside.copy()
        new[1:] &= (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
        last = inside.copy()
        last[:-1] &= (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | ~inside[1:]
        at = np.flatnonzero(new)
        self.hash, self.text = least[at] >> _U(16), owner[at]
        self.first = at                        # in ``data``
        self.size = np.flatnonzero(last) - at + length
        self.start = at - (ends - sizes)[self.text]


def _i8(a) -> bytes:
    return np.asarray(a, np.int64).tobytes()


MARKS = "doc_id bigint, tid bigint, marks binary"
SENT = "bucket int, hashes binary, owners binary, docs binary, tids binary, many binary, " + MARKS


def run_hashes(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """Run hashes by bucket, one per text and batch; hashes that two texts of the batch hold are marked at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send() -> pa.RecordBatch:
            h, d, t = (np.concatenate([x[k] for x in held]) for k in range(3))
            order = np.argsort(h)
            h, d, t = h[order], d[order], t[order]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            lone = new & np.append(new[1:], True)
            # only hashes that occur more than once need the other columns in order
            several = np.flatnonzero(~lone)
            several = several[np.lexsort((d[several], t[several], h[several]))]
            sh, sd, st = h[several], d[several], t[several]
            first = np.ones(len(sh), bool)
            first[1:] = (sh[1:] != sh[:-1]) | (st[1:] != st[:-1])
            sh, sd, st = sh[first], sd[first], st[first]
            new = np.ones(len(sh), bool)
            new[1:] = sh[1:] != sh[:-1]
            group = np.cumsum(new) - 1
            many = np.bincount(group, minlength=1)[group] > 1
            h, d, t = (np.concatenate([x[lone], y]) for x, y in ((h, sh), (d, sd), (t, st)))
            many = np.concatenate([np.zeros(len(h) - len(sh), bool), many])
            new = np.concatenate([np.ones(len(h) - len(sh), bool), new])
            rows = []
            by = np.lexsort((d[many], t[many]))
            mh, md, mt = h[many][by], d[many][by], t[many][by]
            cuts = np.flatnonzero((mt[1:] != mt[:-1]) | (md[1:] != md[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(mh)]):
                if a < b:
                    rows.append((int(mh[a] % _U(buckets)), None, None, None, None, None, int(md[a]), int(mt[a]), mh[a:b].tobytes()))
            # a hash that is already known to be shared is sent once
            keep = new | ~many
            h, d, t, many = h[keep], d[keep], t[keep], many[keep]
            bucket = (h % _U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            h, d, t, many, bucket = h[order], d[order], t[order], many[order], bucket[order]
            cuts = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
            for a, b in zip([0, *cuts], [*cuts, len(h)]):
                if a < b:
                    pairs, owner = np.unique(np.stack([d[a:b], t[a:b]]), axis=1, return_inverse=True)
                    kind = np.uint16 if pairs.shape[1] < 65536 else np.uint32
                    six = h[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                    rows.append((int(bucket[a]), six.tobytes(), owner.ravel().astype(kind).tobytes(), _i8(pairs[0]), _i8(pairs[1]),
                                 np.packbits(many[a:b]).tobytes(), None, None, None))
            held.clear()
            return pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=schema)

        names = ["bucket", "hashes", "owners", "docs", "tids", "many", "doc_id", "tid", "marks"]
        schema = pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in names[1:6]], ("doc_id", pa.int64()), ("tid", pa.int64()), ("marks", pa.binary())])
        for batch, texts in text_batches(batches, RUN_BYTES):
            r = Runs(texts, length)
            d, t = np.array(batch.column(0)), np.array(batch.column(1))
            if len(r.hash):
                held.append((r.hash, d[r.text], t[r.text]))
            size += len(r.data)
            if size >= HASHED_BYTES and held:
                yield send()
                size = 0
        if held:
            yield send()

    return docs.select("doc_id", "tid", "text").mapInArrow(run, SENT)


def shared_marks(sent: DataFrame) -> DataFrame:
    """The hashes that two different texts hold, back to the documents that hold them."""

    def run(table: pa.Table) -> pa.Table:
        direct = table.filter(pa.compute.is_valid(table["marks"])).select(["doc_id", "tid", "marks"])
        table = table.filter(pa.compute.is_valid(table["hashes"]))
        hs, ds, ts, ms = [], [], [], []
        for r in table.to_pylist():
            six = np.frombuffer(r["hashes"], np.uint8).reshape(-1, 6)
            h = np.zeros((len(six), 8), np.uint8)
            h[:, :6] = six
            docs = np.frombuffer(r["docs"], np.int64)
            owner = np.frombuffer(r["owners"], np.uint16 if len(docs) < 65536 else np.uint32)
            hs.append(h.view("<u8").ravel())
            ds.append(docs[owner])
            ts.append(np.frombuffer(r["tids"], np.int64)[owner])
            ms.append(np.unpackbits(np.frombuffer(r["many"], np.uint8), count=len(h)).astype(bool))
        if not hs:
            return direct
        h, d, t, m = map(np.concatenate, (hs, ds, ts, ms))
        order = np.lexsort((d, t, h))
        h, d, t, m = h[order], d[order], t[order], m[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        group = np.cumsum(new) - 1
        other = np.zeros(len(h), bool)
        other[1:] = ~new[1:] & (t[1:] != t[:-1])
        shared = (np.bincount(group, other | m) > 0)[group]
        first = new.copy()                      # the smallest doc_id of each text
        first[1:] |= t[1:] != t[:-1]
        keep = shared & first & ~m
        h, d, t = h[keep], d[keep], t[keep]
        order = np.lexsort((t, d))
        h, d, t = h[order], d[order], t[order]
        cuts = np.flatnonzero((d[1:] != d[:-1]) | (t[1:] != t[:-1])) + 1
        ends = [*cuts, len(h)] if len(h) else []
        starts = [0, *cuts] if len(h) else []
        back = pa.table({"doc_id": pa.array(d[starts] if starts else [], pa.int64()), "tid": pa.array(t[starts] if starts else [], pa.int64()),
                         "marks": pa.array([h[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())})
        return pa.concat_tables([direct.cast(back.schema), back])

    return sent.groupBy("bucket").applyInArrow(run, MARKS)


SPANS = "doc_id bigint, tid bigint, spans binary"
STRINGS = "bucket int, hashes binary, docs binary, tids binary, starts binary, sizes binary, data binary, " + SPANS


def shared_runs(marked: DataFrame, length: int, buckets: int) -> DataFrame:
    """The bytes of shared runs by bucket, a string once per batch; later documents of the batch are covered at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "hashes", "docs", "tids", "starts", "sizes", "data", "doc_id", "tid", "spans"]
        schema = pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in names[1:7]], ("doc_id", pa.int64()), ("tid", pa.int64()), ("spans", pa.binary())])
        held: dict[bytes, list] = {}
        covered: dict[tuple[int, int], list[int]] = {}
        size = 0

        def send() -> pa.RecordBatch:
            by: dict[int, list] = {}
            for string, (h, doc, where) in held.items():
                by.setdefault(h % buckets, []).extend((h, doc, t, s, string) for t, s in where)
            rows = [(b, np.array([x[0] for x in v], np.uint64).tobytes(), _i8([x[1] for x in v]), _i8([x[2] for x in v]), _i8([x[3] for x in v]),
                     np.array([len(x[4]) for x in v], np.int32).tobytes(), b"".join([x[4] for x in v]), None, None, None) for b, v in by.items()]
            rows += [(int(t % buckets), None, None, None, None, None, None, d, t, _i8(v)) for (d, t), v in covered.items()]
            held.clear(), covered.clear()
            return pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=schema)

        for batch, texts in text_batches(batches, RUN_BYTES):
            r = Runs(texts, length)
            at = batch.schema.get_field_index("marks")
            marks = np.unique(np.concatenate([np.frombuffer(m, np.uint64) for cell in batch.column(at).to_pylist() for m in cell]))
            hit = np.flatnonzero(np.isin(r.hash, marks))
            docs, tids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for h, k, s, a, n in zip(r.hash[hit].tolist(), r.text[hit].tolist(), r.start[hit].tolist(), r.first[hit].tolist(), r.size[hit].tolist()):
                string, doc = r.data[a:a + n], docs[k]
                known = held.get(string)
                if known is None:
                    held[string] = [h, doc, [(tids[k], s)]]
                elif known[1] == doc:
                    known[2].append((tids[k], s))
                elif known[1] < doc:
                    covered.setdefault((doc, tids[k]), []).extend((s, s + n))
                else:
                    for t, was in known[2]:
                        covered.setdefault((known[1], t), []).extend((was, was + n))
                    held[string] = [h, doc, [(tids[k], s)]]
            size += len(r.data)
            if size >= HELD_BYTES:
                yield send()
                size = 0
        if held or covered:
            yield send()

    return marked.mapInArrow(run, STRINGS)


def covered_spans(strings: DataFrame, length: int) -> DataFrame:
    """(doc_id, tid, spans): byte spans of documents that a smaller doc_id covers."""

    def run(table: pa.Table) -> pa.Table:
        direct = table.filter(pa.compute.is_valid(table["spans"])).select(["doc_id", "tid", "spans"])
        # string -> its hash, smallest doc_id, occurrences
        known: dict[bytes, list] = {}
        for r in table.filter(pa.compute.is_valid(table["data"])).to_pylist():
            data, at = r["data"], 0
            for h, d, t, s, n in zip(*[np.frombuffer(r[c], k).tolist() for c, k in (("hashes", np.uint64), ("docs", np.int64), ("tids", np.int64), ("starts", np.int64), ("sizes", np.int32))]):
                string = data[at:at + n]
                at += n
                e = known.get(string)
                if e is None:
                    known[string] = [h, d, [(d, t, s)]]
                else:
                    e[1] = min(e[1], d)
                    e[2].append((d, t, s))
        out: dict[tuple[int, int], list[int]] = {}
        kinds: dict[int, list[bytes]] = {}
        for string, (h, least, where) in known.items():
            for d, t, s in where:
                if d > least:
                    out.setdefault((d, t), []).extend((s, s + len(string)))
            kinds.setdefault(h, []).append(string)
        part: list[bytes] = []
        n = 0
        for several in kinds.values():
            if len(several) > 1:
                part += several
                n += sum(map(len, several)) - len(several) * (length - 1)
                if n >= WINDOWS_AT_ONCE:
                    _cover(part, known, length, out)
                    part, n = [], 0
        if part:
            _cover(part, known, length, out)
        made = pa.table({"doc_id": pa.array([k[0] for k in out], pa.int64()), "tid": pa.array([k[1] for k in out], pa.int64()),
                         "spans": pa.array([_i8(v) for v in out.values()], pa.binary())})
        return pa.concat_tables([direct.cast(made.schema), made])

    return strings.groupBy("bucket").applyInArrow(run, SPANS)


def _cover(strings: list[bytes], known: dict[bytes, list], length: int, out: dict) -> None:
    """Sort the windows of the strings as suffixes; add the spans that a smaller doc_id covers to ``out``."""
    sizes = np.array([len(s) for s in strings])
    data = np.frombuffer(b"".join(strings), np.uint8)
    begin = np.cumsum(sizes) - sizes
    count = sizes - length + 1
    owner = np.repeat(np.arange(len(strings)), count)
    starts = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + begin[owner]
    order, same = suffix_order(data, starts, length)
    doc = np.array([known[s][1] for s in strings], np.int64)[owner[order]]
    first = np.flatnonzero(~same)
    least = np.minimum.reduceat(doc, first)[np.cumsum(~same) - 1]
    hit = np.zeros(len(owner), bool)
    hit[order] = doc > least
    edge = hit.copy()
    edge[1:] &= ~hit[:-1] | (owner[1:] != owner[:-1])
    stop = hit.copy()
    stop[:-1] &= ~hit[1:] | (owner[1:] != owner[:-1])
    for k, a, b in zip(owner[edge].tolist(), (starts - begin[owner])[edge].tolist(), (starts - begin[owner])[stop].tolist()):
        _, low, where = known[strings[k]]
        for d, t, s in where:
            if d == low:
                out.setdefault((d, t), []).extend((s + a, s + b + length))


def cut(texts: DataFrame) -> DataFrame:
    """Remove the spans: adds n_bytes, n_removed, n_spans and ``kept`` (bytes left) to (doc_id, text, whole, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data in text_batches(batches):
            whole, cells = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            removed, spans, kept = [], [], []
            for text, all_, cell in zip(data, whole, cells):
                if all_:
                    removed.append(len(text)), spans.append(1), kept.append(b"")
                    continue
                at = n = gone = 0
                left = []
                if cell:
                    pairs = np.concatenate([np.frombuffer(c, np.int64) for c in cell]).reshape(-1, 2)
                    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                    reach = np.maximum.accumulate(pairs[:, 1])
                    new = np.ones(len(pairs), bool)
                    new[1:] = pairs[1:, 0] > reach[:-1]
                    first = np.flatnonzero(new)
                    for a, b in zip(pairs[first, 0].tolist(), reach[np.append(first[1:] - 1, len(pairs) - 1)].tolist()):
                        left.append(text[at:a])
                        at, n, gone = b, n + 1, gone + b - a
                left.append(text[at:])
                removed.append(gone), spans.append(n), kept.append(b"".join(left))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, pa.int64()) for v in ([len(t) for t in data], removed, spans)],
                                              pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return texts.select("doc_id", "text", "whole", "spans").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the remaining bytes of every document."""
    body = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tid", F.xxhash64("text"))
    ids = materialize(body.select("doc_id", "tid", F.md5("text").alias("sum"), F.octet_length("text").alias("size")), "suffix-ids")
    total = ids.agg(F.sum("size")).first()[0] or 0
    buckets = max(MIN_BUCKETS, -(-total // BUCKET_BYTES))
    first = ids.groupBy("sum", "size").agg(F.min("doc_id").alias("rep"))
    ranked = ids.join(first, ["sum", "size"])
    reps = ranked.where("doc_id = rep").select("doc_id", "tid").distinct()
    copies = ranked.where((F.col("doc_id") > F.col("rep")) & (F.col("size") >= length)).select("doc_id", "tid", F.lit(True).alias("whole")).distinct()

    marks = materialize(shared_marks(run_hashes(body.where("doc_id is not null"), length, buckets)), "suffix-marks")
    marks = marks.groupBy("doc_id", "tid").agg(F.collect_list("marks").alias("marks")).join(reps, ["doc_id", "tid"], "left_semi")
    marked = body.join(marks, ["doc_id", "tid"]).select("doc_id", "tid", "text", "marks")
    spans = materialize(covered_spans(shared_runs(marked, length, buckets), length), "suffix-spans")
    spans = spans.groupBy("doc_id", "tid").agg(F.collect_list("spans").alias("spans"))
    changed = spans.join(copies, ["doc_id", "tid"], "full_outer")
    return cut(body.join(changed, ["doc_id", "tid"], "left"))


def document_suffix_dedup(docs: DataFrame) -> DataFrame:
    """The digest table: what is removed of every document, and the hash of what is left."""
    d = suffix_dedup(docs)
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
