"""Quality rules, BPE, token counts: against plain Python on whole texts, and edge cases."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from taskshift.llm import bpe, quality_rules, token_counts

BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def base_figures(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    seen = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {p for i in range(len(w) - 4) if seen[tuple(w[i:i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_quality_base_figures(make_docs, edge_texts):
    texts = edge_texts + ["a b c d e f a b c d e", "the same line here now.\nthe same line here now.\n" * 4, "# $ | <a> & b"]
    got = {r["doc_id"]: r for r in quality_rules.document_quality(make_docs(texts, extra="n_words kept __words")).collect()}
    for i, t in enumerate(texts):
        e = base_figures(t)
        assert tuple(got[i])[1:6] == e, (i, t and t[:40])
        assert got[i]["base_failed"] == (e[0] < 10 or 100 * e[4] > 20 * e[0])
    assert got[5]["kept"] is False or got[5]["kept"] is True


def test_quality_lines(make_docs):
    good = "This is a plain sentence of some length here.\nAnother plain sentence follows it at once."
    nav = "Home | About us | Contact | Imprint | Login"
    texts = [good, good + "\n" + nav, nav + "\n" + nav.replace("Home", "Start") + "\n" + good.split("\n")[0],
             "A LOUD LINE OF MANY CAPITAL LETTERS, ALL OF IT SHOUTED.\n" * 1 + good[:20], "word### more$$$ of%%% this&&& kind*** here###\n" * 1 + "Ok.", None, ""]
    d = quality_rules.quality(make_docs(texts))
    got = {r["doc_id"]: r for r in d.collect()}
    assert got[0]["clean_text"] == good and got[0]["lost"] == 0 and got[0]["kept"]
    assert got[1]["clean_text"] == good and got[1]["kept"]
    assert got[2]["clean_text"] == good.split("\n")[0] and not got[2]["kept"]
    assert "LOUD" not in got[3]["clean_text"] and got[4]["clean_text"] == "Ok."
    assert got[5]["lost"] is None and not got[5]["kept"] and not got[6]["kept"]
    assert {r["doc_id"] for r in quality_rules.accepted(d).collect()} == {k for k, r in got.items() if r["kept"]}


def test_quality_has_no_python_and_empty_table(make_docs):
    d = quality_rules.document_quality(make_docs(["a"]).limit(0))
    assert d.count() == 0 and "Python" not in d._jdf.queryExecution().executedPlan().toString()


def test_bpe_encodes_small_runs_of_a_batch(make_docs, monkeypatch):
    """A batch of long texts is encoded and handed on piece by piece, with the same rows."""
    made, d = [], make_docs(["x"])
    monkeypatch.setattr(type(d), "mapInArrow", lambda self, run, schema: made.append(run))
    bpe.encode_documents(d, BPE)
    texts = [f"Some words of text {i}, " * 100 for i in range(1000)] + [None, "x" * (1 << 20)]
    out = list(made[0](iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])])))
    assert all(sum(len(t or "") for t in b.column(0).to_pylist()[:-1]) <= 512 << 10 for b in out)
    assert [t for b in out for t in b.column(0).to_pylist()] == texts
    e = bpe.Encoder.of(BPE)
    got = [r for b in out for r in zip(b.column(1).to_pylist(), b.column(3).to_pylist())]
    assert got[0] == e.encode(texts[0]) and got[999] == e.encode(texts[999]) and got[1000] == (b"", "")


def test_bpe_is_the_tokenizer(make_docs, edge_texts, sf, spark):
    t = Tokenizer.from_file(BPE)
    texts = edge_texts + ["<|endoftext|>", "a<|startoftext|>b <|endoftext|> c", "I'm sure they'LL don't 's", "ΑΣ ΣΑΣ İstanbul", "a" * 300, "½²٣ ख़ \x85"]
    texts += [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs = make_docs(texts, extra="ids words")
    got = {r["doc_id"]: r for r in bpe.document_tokens(docs, BPE).collect()}
    full = {r["doc_id"]: r for r in bpe.encode_documents(docs, BPE).collect()}
    e = bpe.Encoder.of(BPE)
    for i, text in enumerate(texts):
        want = t.encode(text or "", add_special_tokens=False)
        ids = np.array(want.ids, "<u4").tobytes()
        decoded = t.decode(want.ids, skip_special_tokens=False)
        assert got[i]["n_tokens"] == len(want.ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(ids).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
        assert bytes(full[i]["ids"]) == ids and full[i]["words"] == "given" and e.decode(ids) == decoded
    assert bpe.document_tokens(docs.limit(0), BPE).count() == 0


def test_decoded_text_comes_from_the_ids():
    e = bpe.Encoder(BPE)
    ids, id_bytes = {s: i for i, s in e.label.items()}, e.automaton.id_bytes
    assert e.encode("hello <|endoftext|> world")[1] == "hello</w> <|endoftext|> world</w>"
    id_bytes[ids["house</w>"]] = id_bytes[ids["world</w>"]]          # a wrong id shows in the decoded text
    assert e.encode("house")[1] == "world</w>"


def test_merge_gadgets_on_a_small_alphabet():
    """All words up to seven signs, against merging by rank, for merges with doubled and nested symbols."""
    from itertools import product
    merges = [("a", "a"), ("a", "b"), ("b", "a"), ("aa", "b"), ("ab", "ab"), ("aa", "aa"), ("ba", "a")]
    strings = ["a", "b", "c", *("".join(m) for m in merges)]
    vocab = {s: i for i, s in enumerate(strings)}
    a = bpe.MergeAutomaton(vocab, merges, "")

    def by_rank(word):
        parts = list(word)
        for x, y in merges:
            out = []
            for p in parts:
                if out and out[-1] == x and p == y and not out[-1:] == [None]:
                    out[-1] = x + y
                    out.append(None)     # a merged pair is not merged again by this rule
                else:
                    out.append(p)
            parts = [p for p in out if p is not None]
        return parts

    for n in range(1, 8):
        for w in product("abc", repeat=n):
            assert [a.label[i] for i in a.encode("".join(w))] == by_rank("".join(w)), w


@pytest.fixture(scope="module")
def unigram():
    pieces, unknown = token_counts.vocabulary(PIECES)
    t = Tokenizer(models.Unigram(pieces, unk_id=unknown, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


def test_counts_are_the_tokenizers(make_docs, edge_texts, unigram, spark, sf):
    texts = edge_texts + [" ", "  a", "▁▁ a", "a▁b c", "<unk><s>", "😀😀a\x00", "a  b   c "]
    texts += [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in token_counts.document_counts(make_docs(texts, extra="score parts"), PIECES).collect()}
    for i, text in enumerate(texts):
        assert got[i]["n_tokens"] == len(unigram.encode(text or "", add_special_tokens=False).ids), text and text[:40]
    assert got[0]["score"] == 0.0 and token_counts.document_counts(make_docs(["a"]).limit(0), PIECES).count() == 0


def test_ties_take_the_longest_last_piece():
    """Equal scores on purpose: every split of a run costs the same."""
    pieces = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("aaa", -3.0), ("▁a", -2.0), ("b", -1.5)]
    t = Tokenizer(models.Unigram(pieces, unk_id=0))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    c = token_counts.Counter(pieces, 0)
    for text in ["a", "aa", "aaaaaaa", "ab aab", "aaxa", "xx", "x a xx aaab", "bbbaaa"]:
        assert c.count(text)[0] == len(t.encode(text, add_special_tokens=False).ids), text


def test_counts_keep_rows(make_docs):
    d = token_counts.count_tokens(make_docs(["a b", "a b"], ids=[7, 7], extra="n_tokens"), PIECES)
    assert [r["n_tokens"] for r in d.collect()] == [2, 2] and d.select(F.col("n_tokens")).count() == 2
