"""Secret scan, co-training, tool calls, source mix and the pipeline."""

import hashlib
import json
import random
import re
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from taskshift.llm import cotraining, secret_scan, source_mix, tool_calls
from taskshift.llm.common import materialize, read

VOCAB = public_tokenizers.path("word_bpe_49k.json")


# -- secrets ---------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def labelled(spark):
    docs, labels = read(spark, "/root/testdata/sf0.01", "documents"), read(spark, "/root/testdata/sf0.01", "labels")
    return secret_scan.stand_in_findings(docs, labels)


def test_candidates_by_hand(make_docs):
    texts = ['x token = "abcdef0123456789abcdef" y', "abcdefabcdefabcdefab", 'pw: "hunter2!!" q="short"', None, "", "k=" + "A1" * 3000,
             'a1b2c3d4e5f6a7b8c9 é a1b2c3d4e5f6a7b8c9', "1234567890123456 1234-5678"]
    docs = make_docs(texts, extra="value start").withColumn("path", F.col("source"))
    got = sorted((r["doc_id"], r["start"], r["value"]) for r in secret_scan.candidates(docs).collect())
    want = []
    for i, t in enumerate(texts):
        for m in re.finditer(secret_scan.CANDIDATE.replace("*+", "*").replace("}+", "}"), t or ""):
            want.append((i, m.start(), m.group(0)))
    assert got == want and [g[0] for g in got] == [0, 2, 5, 6, 6, 7]


def test_candidates_search_each_text_once(make_docs):
    docs = make_docs(["a"]).withColumn("path", F.col("source"))
    plan = secret_scan.candidates(docs)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    searched = [x.strip(" :+-") for x in plan if "{16,}+" in x]
    assert not [x for x in searched if x.startswith("Filter")]
    assert len([x for x in searched if "regexp_replace" in x]) == 1
    assert all("CASE WHEN Contains(text" in x for x in searched if "regexp_replace" not in x)


def test_candidates_of_odd_texts(make_docs):
    rng = random.Random(3)
    parts = ["pw", "key", "Token", "PASSWORD", "-", "=", ":", ":=", "=>", ">", " ", "  ", "    ", "\t", "\n", '"', "'", "&", ",", ")", "@", "@h", "/", "<", "a", "9", "_", "x1", "abcdefgh", "ijklmnop", "qrstuvwx",
             "12345678", "é", "😀", "\x01", "!", "hunter2!", "abc123def456", "user:", "http://", "=="]
    texts = []
    for _ in range(600):
        some = rng.sample(parts, rng.randint(2, 20))
        texts.append("".join(rng.choice(some) for _ in range(rng.randint(1, 40))))
    texts += ["\x01", " ".join(f"w é😀 a{i:015d}" for i in range(700)), " ".join(f"key={i}x!yz" for i in range(600)) + "\x01"]   # more than two blocks of candidates
    docs = make_docs(texts).withColumn("path", F.col("source"))
    got = sorted((r["doc_id"], r["start"], r["value"], r["left"], r["right"]) for r in secret_scan.candidates(docs).collect())
    want = []
    for i, t in enumerate(texts):
        found = [m.span() for m in re.finditer(secret_scan.CANDIDATE, t, re.ASCII)]
        ends, starts = [0] + [b for _, b in found], [a for a, _ in found] + [len(t)]
        want += [(i, a, t[a:b], t[ends[k]:a][-secret_scan.LEFT:], t[b:starts[k + 1]][:secret_scan.RIGHT]) for k, (a, b) in enumerate(found)]
    assert got == want and len(want) > 1500 and any("\x01" in x[2] for x in want)
    bare = [i for i, t in enumerate(texts) if any(x[0] == i for x in want) and not re.search(r"[=:>-]", t)]
    assert len(bare) > 10                                            # texts that hold runs only


UNQUOTED = [("password=Pa55w0rd!", "Pa55w0rd!"), ("export DB_PASSWORD: Xk9!v2Lp", "Xk9!v2Lp"), ("api_key=4f9a1c7be02d", "4f9a1c7be02d"), ("postgres://user:S3c:r@t@host/db", "S3c:r@t"),
            ("Bearer qWzxJvKwyHpguTRbnM", "qWzxJvKwyHpguTRbnM"), ("PASSWORD =   ab!cd#ef, next", "ab!cd#ef"), ("run --token tRbnM!xq now", "tRbnM!xq"), ('"secret": 71625341', "71625341")]


def test_unquoted_values_are_candidates(make_docs):
    docs = make_docs([t for t, _ in UNQUOTED] + ["no = such thing: here at all", "https://example.com:8080/x"]).withColumn("path", F.col("source"))
    got = [(r["doc_id"], r["value"], r["start"]) for r in secret_scan.candidates(docs).orderBy("doc_id").collect()]
    assert got == [(i, v, t.index(v)) for i, (t, v) in enumerate(UNQUOTED)]


def test_unquoted_secrets_are_redacted(make_docs, labelled):
    docs = make_docs(["words before it password=Rk7!wQ2x and words after", "see postgres://admin:Yb4!kT9s@db.example.com:5432/main for it", "in the file api_key=9c04be17a3f2 and more",
                      "the text said password: required and no more"])
    got = [r["text"] for r in secret_scan.redact(docs, labelled, VOCAB, "source").orderBy("doc_id").collect()]
    assert got == ["words before it password=<SECRET> and words after", "see postgres://admin:<SECRET>@db.example.com:5432/main for it", "in the file api_key=<SECRET> and more",
                   "the text said password: required and no more"]


def test_forest_on_held_out_findings(labelled):
    words, pairs = secret_scan.dictionary(VOCAB)
    fold = F.pmod(F.xxhash64("text", F.lit(9)), F.lit(4))
    model = secret_scan.train(labelled.where(fold > 0), words, pairs)
    held = labelled.where(fold == 0).withColumn("doc_id", F.xxhash64("text"))
    found = model.transform(secret_scan.figures(secret_scan.candidates(held), words, pairs)).join(held.select("doc_id", "label"), "doc_id")
    n, right = found.agg(F.count("*"), F.sum((F.col("prediction") == F.col("label")).cast("int"))).first()
    assert n > 40 and right / n >= 0.9


def test_redaction(make_docs, labelled):
    secret = hashlib.sha1(b"1").hexdigest()
    texts = [f'some words before token = "{secret}" and words after', "plain words only, nothing to see", f"sha256: {hashlib.sha256(b'2').hexdigest()}", None,
             f'token = "{secret}" twice token = "{secret}"', f'token = "{secret}"']
    docs = make_docs(texts, ids=[0, 1, 2, 3, 4, None], extra="__text path")
    got = {r["doc_id"]: r for r in secret_scan.redact(docs, labelled, VOCAB, "source").collect()}
    assert got[0]["text"] == 'some words before token = "<SECRET>" and words after' and got[0]["n_chars"] == len(got[0]["text"])
    assert got[1]["text"] == texts[1] and got[3]["text"] is None and secret not in got[4]["text"]
    assert got[None]["text"] == 'token = "<SECRET>"'             # a missing doc_id does not keep a secret in the text
    assert got[0]["path"] == "given" and docs.columns == secret_scan.redact(docs, labelled, VOCAB, "source").columns
    assert secret_scan.redact(docs.limit(0), labelled, VOCAB, "source").count() == 0


def test_scan_without_labels_keeps_every_candidate(make_docs, labelled):
    docs = make_docs(["commit " + hashlib.sha1(b"3").hexdigest()]).withColumn("path", F.lit(None).cast("string"))
    r = secret_scan.scan(docs, labelled.limit(0), VOCAB).collect()
    assert [(x["is_secret"], x["p_secret"]) for x in r] == [(True, None)]


def test_scan_main_path_is_native(make_docs, labelled):
    d = secret_scan.scan(make_docs(["a"]).withColumn("path", F.col("source")), labelled, VOCAB)
    assert not re.search("Python|Pandas|Arrow", d._jdf.queryExecution().executedPlan().toString())


# -- co-training -----------------------------------------------------------------------------

def test_cotraining_on_held_out_labels(spark):
    docs, labels = read(spark, "/root/testdata/sf0.01", "documents"), read(spark, "/root/testdata/sf0.01", "labels").select("doc_id", "quality")
    fold = F.pmod(F.xxhash64("doc_id", F.lit(21)), F.lit(3))
    out = cotraining.classify(docs, labels.where(fold > 0)).join(labels.where(fold == 0), "doc_id").toPandas()
    assert ((out.score >= 0.5) == (out.quality == 1)).mean() >= 0.93
    assert out.kept[out.quality == 1].mean() >= 0.97


def test_cotraining_edges(make_docs, edge_texts, spark):
    docs = make_docs(edge_texts, extra="score words label")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (3, 1)], "doc_id bigint, quality int")
    out = cotraining.classify(docs, labels).collect()      # one class only
    assert len(out) == len(edge_texts) and all(r["kept"] and r["score"] is None for r in out)
    full = spark.createDataFrame([(i, int(i % 2)) for i in range(len(edge_texts))] * 2, "doc_id bigint, quality int")
    out = cotraining.classify(docs.union(docs), full).collect()
    assert len(out) == 2 * len(edge_texts) and len({(r["doc_id"], r["score"]) for r in out}) == len(edge_texts)
    assert cotraining.classify(docs.limit(0), full).count() == 0


# -- tool calls ------------------------------------------------------------------------------

def check_arguments(tool, text, tools):
    try:
        args = json.loads(text)
    except (TypeError, ValueError):
        args = None
    if not isinstance(args, dict):
        return ["arguments are not a JSON object"], None
    if tool not in tools:
        return ["unknown tool"], args
    kind = lambda v: ("null" if v is None else "boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "number" if isinstance(v, float)
                      else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object")
    errors = [f"missing {n}" for n, _, need in tools[tool] if need and n not in args]
    errors += [f"{n} is {kind(args[n])}, not {t}" for n, t, _ in tools[tool] if n in args and kind(args[n]) != t and not (t == "number" and kind(args[n]) == "integer")]
    errors += [f"unknown {k}" for k in args if k not in [n for n, _, _ in tools[tool]]]
    return sorted(errors), args


def by_level(calls):
    """Level of each (conv, call) by hand; None on or behind a circle."""
    out = {}
    for _ in range(len(calls) + 1):
        for (c, i), refs in calls.items():
            known = [(c, r) for r in refs if (c, r) in calls]
            if (c, i) not in out and all(k in out for k in known):
                out[c, i] = 1 + max([out[k] for k in known], default=-1)
    return {k: out.get(k) for k in calls}


def test_tool_calls_by_hand(spark, monkeypatch):
    tools = {n: ps for n, ps in tool_calls.TOOLS}
    calls = [(1, 1, "a", "search", '{"query":"q","limit":3}', []), (1, 3, "b", "fetch", '{"url":"u","timeout":2}', ["a"]), (1, 5, "c", "store", '{"items":[1],"meta":{"b":1,"a":{"z":2,"y":null}}}', ["a", "b", "gone"]),
             (1, 7, "a", "search", '{"query":"again"}', []), (2, 1, "a", "search", '{"limit":"x"}', None), (2, 2, "x", "search", '{"query":1,"more":true}', ["y"]), (2, 3, "y", "fetch", '{"url":"u"}', ["x"]),
             (2, 4, "z", "fetch", '{"url":"u"}', ["x"]), (2, 5, "s", "search", '{"query":"self"}', ["s"]), (3, 1, "t", "nothing", "{}", []), (3, 2, "u", "search", "[1]", []), (3, 3, "v", "search", "{bad", []), (3, 4, "w", "search", None, ["t", "t"]),
             (None, 1, "q", "search", "{}", []), (4, 1, None, "search", "{}", []), (5, 1, "é", "search", '{ "query" : "Ä \\"x\\" \\n" , "limit":null}', [])]
    calls += [(9, k, f"k{k}", "search", '{"query":"q"}', [f"k{k // 3}"] if k else []) for k in range(40)]
    results = [(1, 2, "a", "first"), (1, 9, "a", "second"), (1, 4, "b", None), (1, 6, "nobody", "?"), (2, 9, "x", "r"), (None, 1, "a", "?")]
    c = spark.createDataFrame([(*r, "given") for r in calls], "conv_id bigint, turn bigint, call_id string, tool string, arguments string, refs array<string>, level string")
    r = spark.createDataFrame(results, "conv_id bigint, turn bigint, call_id string, content string")
    t = spark.createDataFrame([(n, [tuple(p) for p in ps]) for n, ps in tool_calls.TOOLS], "tool string, params array<struct<name:string,type:string,required:boolean>>")
    rows = tool_calls.link(c, r, t).collect()
    named = {}
    for conv, turn, call, tool, args, refs in sorted((x for x in calls if x[0] is not None and x[2] is not None), key=lambda x: x[1]):
        named.setdefault((conv, call), (turn, tool, args, refs or []))
    levels = by_level({k: v[3] for k, v in named.items()})
    lost = [(x["conv_id"], x["call_id"], x["kind"], list(x["errors"]), x["line"]) for x in rows if "null key" in x["errors"]]
    line = '{"arguments":{},"conv_id":%s,"id":%s,"role":"assistant","tool":"search","valid":false}'
    assert sorted(lost, key=repr) == sorted([(None, "q", "call", ["null key", "missing query"], line % ("null", '"q"')), (4, None, "call", ["null key", "missing query"], line % ("4", "null")),
                                             (None, "a", "orphan result", ["null key"], '{"content":"?","conv_id":null,"id":"a","role":"tool","tool":null}')], key=repr)
    got = {(x["conv_id"], x["call_id"]): x for x in rows if x["kind"] == "call" and "null key" not in x["errors"]}
    assert set(got) == set(named)
    for k, (turn, tool, args, _) in named.items():
        errors, parsed = check_arguments(tool, args, tools)
        errors = errors + (["refers in a circle"] if levels[k] is None else [])
        x = got[k]
        assert (x["turn"], x["level"], list(x["errors"]), x["valid"]) == (turn, levels[k], errors, not errors), k
        line = {"arguments": parsed, "conv_id": k[0], "id": k[1], "role": "assistant", "tool": tool, "valid": not errors}
        assert x["line"] == json.dumps(line, sort_keys=True, separators=(",", ":"), ensure_ascii=False), k
    kinds = defaultdict(list)
    for x in rows:
        kinds[x["kind"]].append((x["conv_id"], x["call_id"], x["rows"]))
    assert sorted(kinds["result"]) == [(1, "a", 1), (1, "b", 1), (2, "x", 1)] and kinds["extra result"] == [(1, "a", 1)]
    assert kinds["repeated call"] == [(1, "a", 1)] and sorted(kinds["orphan result"], key=repr) == [(1, "nobody", 1), (None, "a", 1)]
    assert tool_calls.link(c.limit(0), r.limit(0), t).count() == 0


def test_repeated_rows_keep_what_they_hold(spark):
    """One identifier with retried calls and a result in parts, some rows wholly equal."""
    calls = [(1, k, "a", "search", json.dumps({"query": f"q{k}"} if k % 2 else {"limit": k}), ["b"] if k == 3 else None) for k in range(1, 30)]
    calls += [calls[4], calls[4], calls[0], (1, 50, "a", None, None, None), (1, 1, "b", "search", '{"query":"b"}', [])]
    results = [(1, k, "a", f"part {k}") for k in range(2, 20)] + [(1, 2, "a", "part 2"), (1, 9, "a", "part 9"), (2, 1, "o", "x"), (2, 2, "o", None)]
    c = spark.createDataFrame(calls, "conv_id bigint, turn bigint, call_id string, tool string, arguments string, refs array<string>")
    r = spark.createDataFrame(results, "conv_id bigint, turn bigint, call_id string, content string")
    t = spark.createDataFrame([(n, [tuple(p) for p in ps]) for n, ps in tool_calls.TOOLS], "tool string, params array<struct<name:string,type:string,required:boolean>>")
    tools, want = {n: ps for n, ps in tool_calls.TOOLS}, []
    for (conv, turn, call, tool, args), n in {x[:5]: sum(y[:5] == x[:5] for y in calls) for x in calls if x[2] == "a"}.items():
        errors, parsed = check_arguments(tool, args, tools)
        line = {"arguments": parsed, "conv_id": conv, "id": call, "role": "assistant", "tool": tool, "valid": False}
        if n - (turn == 1):
            want.append((turn, ["repeated call", *errors], json.dumps(line, sort_keys=True, separators=(",", ":")), n - (turn == 1)))
    for turn in range(2, 20):
        n = (turn > 2) + (turn in (2, 9))
        want.append((turn, ["extra result"], json.dumps({"content": f"part {turn}", "conv_id": 1, "id": "a", "role": "tool", "tool": "search"}, separators=(",", ":")), n)) if n else None
    want.append((2, ["extra result"], '{"content":"","conv_id":2,"id":"o","role":"tool","tool":null}', 1))
    rows = tool_calls.link(c, r, t).collect()
    got = [(x["turn"], list(x["errors"]), x["line"], x["rows"]) for x in rows if x["kind"] in ("repeated call", "extra result")]
    assert sorted(got) == sorted(want) and sum(x["rows"] for x in rows) == len(calls) + len(results)
    assert sorted((x["kind"], x["turn"]) for x in rows if x["kind"] in ("call", "result")) == [("call", 1), ("call", 1), ("result", 2)]


# -- source mix ------------------------------------------------------------------------------

def words_in(t):
    return [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]


def test_mix_targets_and_limits(make_docs, prose, monkeypatch):
    monkeypatch.setattr(source_mix, "SHARD_WORDS", 4000)
    texts = [prose(k, 30 + 17 * (k % 40)) for k in range(150)] + [None, "", " ", prose(1, 9000)]
    sources = [("b", "a", "é", None, "c")[k % 5] if k < 150 else "a" for k in range(154)]
    docs = make_docs(texts, sources=sources, extra="size target pieces").repartition(4)
    got = source_mix.document_mix(docs).collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in source_mix.document_mix(docs.repartition(7)).collect())
    sizes = {s: sum(len(words_in(t)) for t, x in zip(texts, sources) if x == s) for s in set(sources)}
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while True:                                            # reshare by weight until none is above its stop
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * level > 2 * sizes[s]}
        if not over:
            target.update({s: weights[s] * level for s in free})
            break
        target.update({s: 2.0 * sizes[s] for s in over})
        left -= sum(target[s] for s in over)
        free -= over
    taken = defaultdict(int)
    for r in got:
        n = len(words_in(texts[r["doc_id"]]))
        assert r["size"] == n and 0 <= r["taken"] <= 2 * n and r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - target[r["source"]]) < 1e-5
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(0.03 * target[s], 300), s


def test_small_sources_reach_their_targets(make_docs, prose):
    """Forty sources of 20 words beside one of 2,000: every source ends within a few words of its target."""
    texts = [prose(k, 20) for k in range(40)] + [prose(100 + k, 100) for k in range(20)] + [prose(300, 3), "", None]       # 44 sources with the null one
    sources = [f"s{k:02d}" for k in range(40)] + ["big"] * 20 + ["tiny", "none", None]
    docs = make_docs(texts, sources=sources, ids=[None if k % 9 == 0 else k for k in range(len(texts))])
    got = source_mix.document_mix(docs).collect()
    target, taken, size = {}, defaultdict(int), {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        target[r["source"]], size[r["source"]] = r["target"], r["source_size"]
        taken[r["source"]] += r["taken"]
    assert size["s00"] == 20 and target["s00"] == 40 and len(target) == 44
    for s, t in target.items():
        block = max([b for b in (1, *source_mix.BLOCKS) if t >= 64 * b or b == 1])
        assert abs(taken[s] - t) <= 2 * block, (s, t, taken[s])
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, source_mix.document_mix(docs.repartition(5)).collect()), key=repr)


def test_apportionment_is_highest_quotients(spark):
    import random
    rng = random.Random(6)
    rows = [(g, k, float(rng.choice([0, 1, 5, 5, 17, 300, 1234.5])), s) for g, s in ((1, 7), (2, 0), (3, 1), (4, 100)) for k in range(9)]
    df = spark.createDataFrame(rows, "g int, k int, votes double, seats bigint")
    got = {(r["g"], r["k"]): r["won"] for r in source_mix.apportion(df, "votes", "seats", ["g"], ["k"], "won").collect()}
    for g, seats in ((1, 7), (2, 0), (3, 1), (4, 100)):
        q = sorted((-v / (2 * s + 1), k, s) for gg, k, v, _ in rows if gg == g and v > 0 for s in range(seats))[:seats]
        assert {k: got[g, k] for gg, k, *_ in rows if gg == g} == {k: sum(x[1] == k for x in q) for gg, k, *_ in rows if gg == g}


def test_mixed_documents_hold_what_is_taken(make_docs, prose):
    texts = [prose(k, 20 + 13 * k) + (" \n" if k % 2 else "") for k in range(40)] + [None, ""]
    docs = make_docs(texts, extra="words part row")
    taken = {r["doc_id"]: r["taken"] for r in source_mix.document_mix(docs).collect()}
    rows = source_mix.mixed_documents(docs).collect()
    held = defaultdict(int)
    for r in rows:
        held[r["doc_id"]] += len(words_in(r["text"]))
        assert r["n_chars"] == len(r["text"]) and r["part"] == "given"
        assert set(words_in(r["text"])) <= set(words_in(texts[r["doc_id"]]))
    assert {d: n for d, n in taken.items() if n} == dict(held)
    whole = [r for r in rows if len(words_in(r["text"])) == len(words_in(texts[r["doc_id"]]))]
    assert whole and all(r["text"] == texts[r["doc_id"]] for r in whole)
    assert source_mix.mixed_documents(docs.limit(0)).count() == 0 and source_mix.document_mix(docs.limit(0)).count() == 0


# -- pipeline ------------------------------------------------------------------------------

def test_pipeline_stages_by_brute_force(spark, sf):
    """Each stage against plain Python on what it was given."""
    from tokenizers import Tokenizer

    from test_dedup_ops import near_groups
    from taskshift.llm import quality_rules
    docs = read(spark, sf, "documents")
    inputs, outs = [], []
    for _, stage in corpus_pipeline.STAGES:
        inputs.append(docs)
        docs = materialize(stage(spark, docs, sf), "pipeline-test")
        outs.append(docs)
    for given, out in list(zip(inputs, outs))[:-1]:
        assert given.columns == out.columns
    rows = lambda df: {r["doc_id"]: r.asDict() for r in df.collect()}
    judged = {r["doc_id"]: r for r in quality_rules.quality(inputs[0]).collect()}
    assert {d: r["text"] for d, r in rows(outs[0]).items()} == {d: r["clean_text"] for d, r in judged.items() if r["kept"]}
    given = [(r["doc_id"], r["text"]) for r in inputs[1].collect()]
    want = {d for d, (_, c) in near_groups(given, 5, 80).items() if c == d}
    assert set(rows(outs[1])) == want
    before, after = rows(inputs[2]), rows(outs[2])
    assert set(before) == set(after)
    for d, r in after.items():
        plain = re.compile("(.+)".join(map(re.escape, r["text"].split(secret_scan.MARK))), re.S)
        assert plain.fullmatch(before[d]["text"])
    assert any(secret_scan.MARK in r["text"] for r in after.values()) == any(re.search(r'token = "[0-9a-f]{40}"', r["text"]) for r in before.values())
    taken = {r["doc_id"]: r["taken"] for r in source_mix.document_mix(inputs[3]).collect()}
    held = defaultdict(int)
    for r in outs[3].collect():
        held[r["doc_id"]] += len(words_in(r["text"]))
    assert dict(held) == {d: n for d, n in taken.items() if n}
    t = Tokenizer.from_file(VOCAB)
    got = sorted((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in outs[4].collect())
    want = []
    for r in inputs[4].collect():
        e = t.encode(r["text"], add_special_tokens=False)
        want.append((r["doc_id"], len(e.ids), hashlib.sha256(t.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)


def test_pipeline_on_odd_documents(make_docs, edge_texts, spark, sf):
    docs = make_docs(edge_texts + edge_texts[:3], ids=[*range(len(edge_texts)), None, 5, 5], extra="row kept words")
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), "odd")
        assert stage(spark, empty, sf).count() == 0
        assert docs.count() > 0
        if "text" not in docs.columns:
            break
        assert set(docs.columns) == set(empty.columns)


def test_dedup_stage_on_repeated_ids_and_map_columns(spark, make_docs, prose, sf):
    """One row of each group stays, whatever ids and other columns hold; rows without words all stay."""
    from pyspark.sql import functions as F
    a, b, c = prose(9, 50), prose(10, 50), prose(11, 50)
    docs = make_docs([a, b, a, c, c, b, b, "", None, None], ids=[1, 1, 5, None, None, None, 1, 1, 1, None], sources=[f"s{9 - i}" for i in range(10)])
    docs = docs.withColumn("tags", F.create_map(F.lit("k"), "source")).withColumn("row", F.lit(1)).repartition(3)
    out = corpus_pipeline.dedup_stage(spark, docs, sf)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"], r["source"], r["tags"]["k"]) for r in out.collect()), key=repr)
    assert got == sorted([(1, a, "s9", "s9"), (1, b, "s3", "s3"), (None, c, "s5", "s5"), (1, "", "s2", "s2"), (1, None, "s1", "s1"), (None, None, "s0", "s0")], key=repr)


def test_scratch_tables_go(spark, make_docs):
    from taskshift.llm import common
    inside = []
    before = spark.conf.get(common._CLEANUP, "false")
    with common.scratch(spark):
        inside.append(materialize(make_docs(["a"]), "gone").inputFiles()[0])
        with common.scratch(spark):
            inside.append(materialize(make_docs(["b"]), "gone").inputFiles()[0])
        kept = common.written(make_docs(["c"]), "stays")
        assert spark.conf.get(common._CLEANUP, "false") == before
    for path in inside:
        fs, at = common._folder(spark, path)
        assert not fs.exists(at.getParent())
    assert spark.read.parquet(kept).count() == 1
