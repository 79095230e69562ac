"""Token counts by count-only Viterbi over a unigram vocabulary.

A text's spaces become the space mark, one is put in front if it does not
start with one, and the text is cut before each mark. An Aho-Corasick automaton over the vocabulary enumerates the pieces that end at each position
of a part. Dynamic programming carries two numbers per
position, the best score and its number of pieces; no path is kept. Scores
are added in double precision from left to right as the tokenizer does.

Tie rule of the tokenizer: starts are tried in rising order and only a
strictly better score replaces one, so among equal scores the longest last
piece wins. A position at which no one-sign piece starts may be passed as
unknown, at the lowest score less ``UNKNOWN_PENALTY``; neighbouring unknown
signs are one piece, which is spelt in byte pieces when the vocabulary has
them all, else counts one.

The vocabulary is a piece file of a public tokenizer, read as a unigram
vocabulary (pieces and scores as given). Work is per document in Arrow
batches; nothing is shuffled, and memory is bounded by one text and a table
of ``PARTS_KEPT`` parts.

Defined results: a null or empty text has no tokens and score 0; rows are
independent, so repeated rows and ties between them do not matter; columns
named like an added one are replaced, others pass through; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskshift.llm.common import text_batches

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
PARTS_KEPT = 300_000
LONGEST_KEPT = 64


def vocabulary(path: str) -> tuple[list[tuple[str, float]], int]:
    """Pieces with scores, in id order, and the id of the unknown piece."""
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size())], m.unk_id()


class Counter(dict):
    """part -> (pieces, score)."""

    _made: dict[str, Counter] = {}

    @classmethod
    def of(cls, path: str) -> Counter:
        if path not in cls._made:
            cls._made[path] = cls(*vocabulary(path))
        return cls._made[path]

    def __init__(self, pieces: list[tuple[str, float]], unknown: int):
        super().__init__()
        self.known = {p: s for p, s in pieces if p}
        self.by_byte = all(f"<0x{b:02X}>" in self.known for b in range(256))
        self.low = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.matches = ahocorasick.Automaton()
        for p, s in self.known.items():
            self.matches.add_word(p, (len(p), s))
        self.matches.make_automaton()
        self.unknown = pieces[unknown][0]

    def spelt(self, signs: str) -> int:
        """Pieces of a run of unknown signs."""
        return len(signs.encode()) if self.by_byte and signs not in self.known else 1

    def __missing__(self, part: str) -> tuple[int, float]:
        out = self.best(part)
        if len(part) <= LONGEST_KEPT:
            if len(self) >= PARTS_KEPT:
                self.clear()
            self[part] = out
        return out

    def best(self, part: str) -> tuple[int, float]:
        n = len(part)
        score, pieces = [0.0] * (n + 1), [0] * (n + 1)
        run = [0] * (n + 1)                     # length of the unknown run that ends here
        low, single = self.low, False
        at, best, count, unknown = 1, None, 0, 0

        def step(j: int) -> None:
            """Settle position j once all its matches, longest first, have been seen."""
            nonlocal best, count, unknown
            if not single:
                s = score[j - 1] + low
                if best is None or s > best:
                    best, unknown = s, run[j - 1] + 1
                    before = pieces[j - unknown]
                    count = before + self.spelt(part[j - unknown:j])
            score[j], pieces[j], run[j] = best, count, unknown
            best, count, unknown = None, 0, 0

        for end, (size, s) in self.matches.iter(part):
            while at <= end:
                step(at)
                at, single = at + 1, False
            s += score[end + 1 - size]
            if size == 1:
                single = True
            if best is None or s > best:
                best, count, unknown = s, pieces[end + 1 - size] + 1, 0
        while at <= n:
            step(at)
            at, single = at + 1, False
        return pieces[n], score[n]

    def count(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        n, score = 0, 0.0
        parts = text.replace(" ", SPACE).split(SPACE)
        for part in parts if parts[0] else parts[1:]:
            k, s = self[SPACE + part]
            n, score = n + k, score + s
        return n, score


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """Add ``n_tokens`` and ``score`` (of the best segmentation) to each document."""
    rest = [c for c in docs.columns if c not in ("n_tokens", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(path)
        for batch, texts in text_batches(batches):
            got = [counter.count(t.decode()) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([k for k, _ in got], pa.int64()), pa.array([s for _, s in got], pa.float64())],
                                             names=[*batch.schema.names, "n_tokens", "score"])

    d = docs.select(*[F.col(f"`{c}`") for c in rest])
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in d.schema.fields)
    return d.mapInArrow(run, fields + "n_tokens bigint, score double")


def document_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, score of every document."""
    return count_tokens(docs.select("doc_id", "text"), path).select("doc_id", "n_tokens", "score")
