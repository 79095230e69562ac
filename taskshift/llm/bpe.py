"""BPE encoding and decoding by a tokenization automaton.

``MergeAutomaton`` starts from one state with a loop for every base symbol
and takes the merges in order. The gadget of merge (a, b): the arcs labelled
``a`` lead to a state ``q``; a copy of ``q`` without its ``b`` arc becomes
their new target (so ``a b`` can no longer be read apart), and every state
with an ``a`` arc gets an arc ``ab`` to where ``b`` led. The result is
deterministic and accepts, for every word, exactly its BPE segmentation.

All arcs with one label lead to one state, so the table needs only that
target per label and, per state, the arcs it has lost: a state is (label,
time), it has lost ``y`` if (label, y) was merged up to that time, or if the
state it was first copied from had lost it. A label made from ``y`` by later
merges is lost with it. (state, label) answers are kept in a table.

Encoding a pre-split word follows the table from the start state, trying the
longest arc first; each prefix has one accepted path, so a position that
leads nowhere is tried once. Decoding emits the arc labels.

Texts are normalised and split as the tokenizer file says (NFC, runs of
white space to one space, lower case; contractions, letter runs, single
numerals, runs of other signs), with the special tokens' strings cut out
first. Work is per document inside Arrow batches: nothing is shuffled,
memory is bounded by one text and tables of fixed numbers of entries.

Defined results: a null or empty text has no tokens and decodes to the empty
string; rows are independent, so repeated rows, ties and extra columns do
not matter (columns of the input named like an added one are replaced); an
empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskshift.llm.common import text_batches

#: Entries of the two word tables; most words that a run misses are new themselves.
RUNS_KEPT, WORDS_KEPT = 300_000, 50_000
LONGEST_KEPT = 64
TABLE_KEPT = 250_000
#: Bytes of text encoded at once; ids and decoded text take several times as many.
BATCH_BYTES = 512 << 10

_SPACE = "\\t\\n\\x0b\\f\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
SPACES = regex.compile(f"[{_SPACE}]+")
NOT_SPACE = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class MergeAutomaton:
    """States are numbers; 0 is the start and the target of labels that no merge has narrowed."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str):
        self.vocab, self.end = vocab, end
        self.label = {i: s for s, i in vocab.items()}
        self.id_bytes = {i: i.to_bytes(4, "little") for i in self.label}
        size = max(vocab.values()) + 1
        self.size = size
        self.goal = [0] * size                 # where the arcs with a label lead
        self.owner, self.time = [-1], [-1]     # of a state: its label, the last merge that narrowed it
        self.base = [0] * size                 # the state a label's first copy was made from
        self.left, self.made = [-1] * size, [-1] * size
        self.rank: dict[int, int] = {}
        self.table: dict[int, bool] = {}
        for t, (x, y) in enumerate(merges):
            a, b, ab = vocab[x], vocab[y], vocab[x + y]
            q = self.goal[a]
            if self.made[ab] >= 0:
                raise ValueError(f"merge {t} makes a symbol twice")
            if not self.leaves(q, b):          # an earlier merge always takes one of the two: no arcs
                continue
            self.left[ab], self.made[ab] = a, t
            self.goal[ab] = self.base[ab] = q if a == b else self.goal[b]
            self.rank[a * size + b] = t
            self.owner.append(a)
            self.time.append(t)
            self.goal[a] = len(self.owner) - 1
        self.table.clear()
        self.trie: dict = {}
        self.span = [0] * size
        for string, x in vocab.items():
            ended = bool(end) and string.endswith(end)
            signs = list(string[:-len(end)] if ended else string)
            if ended:
                signs[-1] += end
            self.span[x] = len(signs)
            if len(signs) > 1 and self.made[x] < 0:
                continue                        # no arc has this label
            node = self.trie
            for sign in signs:
                node = node.setdefault(sign, {})
            node[""] = x

    def lost(self, state: int, label: int) -> int | None:
        """When the state lost its arc with this very label."""
        while state:
            a = self.owner[state]
            t = self.rank.get(a * self.size + label)
            if t is not None and t <= self.time[state]:
                return t
            state = self.base[a]
        return None

    def leaves(self, state: int, label: int) -> bool:
        """Does an arc with this label leave the state?"""
        key = state * self.size + label
        if (known := self.table.get(key)) is not None:
            return known
        y, until, out = label, len(self.rank) + 1, True
        while y >= 0:
            t = self.lost(state, y)
            if t is not None and t <= until:
                out = False
                break
            y, until = self.left[y], self.made[y]
        self.table[key] = out
        return out

    def starting(self, signs: list[str], at: int) -> list[int]:
        """Labels that match from a position on, shortest first."""
        node, out = self.trie, []
        for k in range(at, len(signs)):
            node = node.get(signs[k])
            if node is None:
                break
            if (x := node.get("")) is not None:
                out.append(x)
        return out

    def encode(self, word: str) -> list[int]:
        """Labels of the accepted path of a pre-split word (byte symbols, without its end mark).

        Walks the table from the start state, longest arc first. A position
        is reached by one accepted path only, so one that leads nowhere is
        never tried again.
        """
        signs = list(word)
        signs[-1] += self.end
        n, table, size, span, goal = len(signs), self.table, self.size, self.span, self.goal
        path, at, state, dead = [], [0], [0], set()
        arcs = [self.starting(signs, 0)]
        while arcs:
            p, s, open_arcs = at[-1], state[-1], arcs[-1]
            while open_arcs:
                x = open_arcs.pop()
                to = p + span[x]
                if to in dead:
                    continue
                if s:
                    leaves = table.get(s * size + x)
                    if not (self.leaves(s, x) if leaves is None else leaves):
                        continue
                path.append(x)
                if to == n:
                    if len(table) > TABLE_KEPT:
                        table.clear()
                    return path
                at.append(to)
                state.append(goal[x])
                arcs.append(self.starting(signs, to))
                break
            else:
                dead.add(p)
                at.pop(), state.pop(), arcs.pop()
                if path:
                    path.pop()
        raise ValueError("a symbol of the word is not in the vocabulary")


class Table(dict):
    """A bounded table that fills itself; long keys are not kept."""

    most = WORDS_KEPT

    def made(self, key: str) -> tuple[bytes, str]:
        raise NotImplementedError

    def __missing__(self, key: str) -> tuple[bytes, str]:
        out = self.made(key)
        if len(key) <= LONGEST_KEPT:
            if len(self) >= self.most:
                self.clear()
            self[key] = out
        return out


class Words(Table):
    """Pre-split word -> ids as little-endian bytes."""

    def __init__(self, automaton: MergeAutomaton):
        self.automaton, self.signs = automaton, byte_symbols()

    def made(self, word: str) -> bytes:
        plain = word.isascii() and word.isprintable()      # such bytes stand for themselves
        ids = self.automaton.encode(word if plain else "".join([self.signs[b] for b in word.encode()]))
        return b"".join([self.automaton.id_bytes[i] for i in ids])


class Runs(Table):
    """Run of signs between white space -> ids of its pre-split words.

    White space neither joins a word nor composes with what follows it, so
    runs can be normalised one by one.
    """

    most = RUNS_KEPT

    def __init__(self, words: Words):
        self.words = words

    def made(self, run: str) -> bytes:
        # lower case sign by sign: a final sigma stays the plain one
        text = unicodedata.normalize("NFC", run).replace("\u03a3", "\u03c3").lower()
        return b"".join([self.words[w] for w in SPLIT.findall(text)])


class Encoder:
    """A tokenizer file with its automaton; ``Encoder.of(path)`` keeps one per worker process."""

    _made: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        strings = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, strings)) + ")") if strings else None
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        vocab = {s: i for s, i in model["vocab"].items() if s not in self.special}
        self.automaton = MergeAutomaton(vocab, merges, model["end_of_word_suffix"] or "")
        self.runs = Runs(Words(self.automaton))
        self.label = {**self.automaton.label, **{i: s for s, i in self.special.items()}}
        self.by_id = np.full(max(self.label) + 1, None, object)
        for i, s in self.label.items():
            self.by_id[i] = s

    def pieces(self, text: str) -> Iterator[bytes]:
        """Ids of each run of a text and of each special token."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.plain(text)
        parts = self.cut.split(text)
        return chain.from_iterable(
            [np.array([self.special[p]], "<u4").tobytes()] if k % 2 else self.plain(p) for k, p in enumerate(parts))

    def plain(self, text: str) -> Iterator[bytes]:
        # str.split() also splits at four control signs that are no white space here
        runs = SPACES.split(text) if NOT_SPACE.search(text) else text.split()
        return map(self.runs.__getitem__, runs)

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids of a text (little-endian 32-bit) and the text decoded from them."""
        ids = b"".join(self.pieces(text))
        return ids, self.decode(ids)

    def decode(self, ids: bytes) -> str:
        """Arc labels of the ids, joined as the tokenizer does without a decoder."""
        return " ".join(self.by_id[np.frombuffer(ids, "<u4")].tolist())


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Add ``ids`` (binary: little-endian unsigned 32-bit), ``n_tokens`` and ``decoded`` to each document."""
    rest = [c for c in docs.columns if c not in ("ids", "n_tokens", "decoded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch, texts in text_batches(batches, BATCH_BYTES):
            got = [encoder.encode(t.decode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([i for i, _ in got], pa.binary()), pa.array([len(i) // 4 for i, _ in got], pa.int64()),
                 pa.array([s for _, s in got], pa.string())], names=[*batch.schema.names, "ids", "n_tokens", "decoded"])
            del got, texts
            # what a batch has freed goes back to the system
            pa.default_memory_pool().release_unused()

    d = docs.select(*[F.col(f"`{c}`") for c in rest])
    return d.mapInArrow(run, _schema(d) + "ids binary, n_tokens bigint, decoded string")


def _schema(df: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields)


def document_tokens(docs: DataFrame, path: str) -> DataFrame:
    """The digest table: number and hash of the ids, hash of the decoded text."""
    d = encode_documents(docs.select("doc_id", "text"), path)
    return d.select("doc_id", "n_tokens", F.sha2(F.col("ids"), 256).alias("ids_sha256"),
                    F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
