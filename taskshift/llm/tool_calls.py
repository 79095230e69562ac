"""Chat formatting: tool-call linking, in DataFrame functions only.

Calls and results are hash-joined by call identifier, put in topological
order over what a call refers to, checked against their tool's schema and
serialised as canonical JSON (keys in order, no spaces), one line per
message, so that a conversation of any length is never gathered into one row.

* Linking: the first row (by turn, then content) of a call identifier is the
  call, the first row of a result identifier its result; every row that
  repeats them is reported with its own turn and line, repeated calls checked
  like first ones (only wholly equal rows share one; ``rows``: how many), as is
  a result without a call.
* Order: ``level`` 0 for calls that refer to no other call of their
  conversation, else one more than the highest level referred to, found in
  rounds, each a join of the calls still open with those just placed. Calls
  on or behind a cycle keep a null level and are reported. Messages sort by
  (conv_id, level, turn, kind, call_id).
* Validation: arguments must parse as a JSON object; required parameters must
  be there and parameters have the schema's type; unknown parameters and
  unknown tools are reported.

Scale: joins on (conv_id, call_id) keys, which are as fine as rows, so one
huge conversation is spread like many small ones. Rows of one identifier that
is repeated very often are told from its first by a plain join with the
combined minimum, which AQE splits, and grouped by all their columns. Tools are a table joined
plainly; Spark broadcasts it by its measured size.

Defined results: null text counts as empty; rows with a null conversation,
turn or identifier link with nothing and are reported; malformed or null
arguments make an invalid call with arguments null; repeated rows are
reported as repeated calls or extra results; empty tables give an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskshift.llm.common import materialize, read, words_of

#: JSON type names and the start of Spark's name for a parsed value's type.
JSON_TYPES = (("string", "STRING"), ("integer", "BIGINT"), ("number", "DECIMAL"), ("number", "DOUBLE"), ("boolean", "BOOLEAN"),
              ("array", "ARRAY"), ("object", "OBJECT"), ("null", "VOID"))


def json_type(variant: Column) -> Column:
    name = F.schema_of_variant(variant)
    out = F.lit("string")
    for kind, start in JSON_TYPES:
        out = F.when(name.startswith(start), F.lit(kind)).otherwise(out)
    return out


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) for first calls; ``refs`` names the calls referred to. Calls on or behind a cycle are left out."""
    keyed = calls.select("conv_id", "call_id", F.array_distinct("refs").alias("refs"))
    edges = keyed.select("conv_id", "call_id", F.explode("refs").alias("ref"))
    known = keyed.select("conv_id", F.col("call_id").alias("ref"))
    edges = materialize(edges.join(known, ["conv_id", "ref"], "left_semi"), "chat-edges")   # references to missing calls do not hold a call back
    waits = edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("waits"))
    open_ = keyed.select("conv_id", "call_id").join(waits, ["conv_id", "call_id"], "left").withColumn("waits", F.coalesce("waits", F.lit(0)))
    placed, level = [], 0
    open_ = materialize(open_, "chat-open")
    while True:
        ready = materialize(open_.where("waits = 0").select("conv_id", "call_id", F.lit(level).alias("level")), "chat-level")
        if ready.isEmpty():
            break
        placed.append(ready)
        freed = (edges.join(ready.select("conv_id", F.col("call_id").alias("ref")), ["conv_id", "ref"])
                 .groupBy("conv_id", "call_id").agg(F.count("*").alias("freed")))
        open_ = (open_.where("waits > 0").join(freed, ["conv_id", "call_id"], "left")
                 .select("conv_id", "call_id", (F.col("waits") - F.coalesce("freed", F.lit(0))).alias("waits")))
        open_, level = materialize(open_, "chat-open"), level + 1
    out = placed[0] if placed else ready
    for p in placed[1:]:
        out = out.unionAll(p)
    return out


def checked(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """Add ``parsed`` (the arguments, null unless a JSON object) and ``errors`` (sorted) to calls."""
    parsed = F.try_parse_json("arguments")
    c = calls.withColumn("parsed", F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed))
    fields = F.map_entries(F.from_json(F.to_json("parsed"), "map<string,variant>"))
    c = c.withColumn("given", F.map_from_entries(F.transform(fields, lambda e: F.struct(e["key"], json_type(e["value"])))))
    t = tools.select(F.col("tool").alias("__tool"), "params")
    c = c.join(t, F.col("tool") == F.col("__tool"), "left")
    kind = lambda p: F.try_element_at("given", p["name"])
    fits = lambda p: (kind(p) == p["type"]) | ((p["type"] == "number") & (kind(p) == "integer"))
    missing = F.transform(F.filter("params", lambda p: p["required"] & kind(p).isNull()), lambda p: F.concat(F.lit("missing "), p["name"]))
    wrong = F.transform(F.filter("params", lambda p: kind(p).isNotNull() & ~fits(p)),
                        lambda p: F.concat(p["name"], F.lit(" is "), kind(p), F.lit(", not "), p["type"]))
    named = F.transform("params", lambda p: p["name"])
    unknown = F.transform(F.array_except(F.map_keys("given"), named), lambda k: F.concat(F.lit("unknown "), k))
    errors = (F.when(F.col("parsed").isNull(), F.array(F.lit("arguments are not a JSON object")))
              .when(F.col("__tool").isNull(), F.array(F.lit("unknown tool")))
              .otherwise(F.sort_array(F.concat(missing, wrong, unknown))))
    return c.withColumn("errors", errors).drop("given", "__tool", "params")


def repeats(d: DataFrame, firsts: DataFrame, cols: list[str]) -> DataFrame:
    """The whole rows of ``d`` that repeat an identifier of ``firsts`` (its first row and ``rows``, all it has), equal ones as one with their count."""
    key, cols = ["conv_id", "call_id"], ["turn", *cols]
    head = firsts.where("rows > 1").select(*key, F.struct(*cols).alias("head"))
    same = d.where("whole").join(head, key).groupBy(*key, *cols, F.struct(*cols).eqNullSafe(F.col("head")).alias("is_first")).agg(F.count("*").alias("n"))
    return same.withColumn("rows", F.col("n") - F.col("is_first").cast("long")).where("rows > 0").drop("n", "is_first")


def link(calls: DataFrame, results: DataFrame, tools: DataFrame) -> DataFrame:
    """Linked, ordered, checked and serialised messages.

    ``calls``: conv_id, turn, call_id, tool, arguments (JSON), refs (array of
    call ids); ``results``: conv_id, turn, call_id, content; ``tools``: tool,
    params (array of name, type, required). Returns conv_id, level, turn,
    kind (call, result, repeated call, extra result, orphan result), call_id,
    valid, errors, line, rows.
    """
    calls = calls.select("conv_id", "turn", "call_id", "tool", "arguments", F.coalesce("refs", F.array().cast("array<string>")).alias("refs"))
    results = results.select("conv_id", "turn", "call_id", F.coalesce("content", F.lit("")).alias("content"))
    whole = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull() & F.col("turn").isNotNull()
    calls = materialize(calls.withColumn("whole", whole), "chat-calls")
    results = results.withColumn("whole", whole)
    key = ["conv_id", "call_id"]
    firsts = lambda d, *cols: d.where("whole").groupBy(*key).agg(F.min(F.struct("turn", *cols)).alias("m"), F.count("*").alias("rows"))
    c = materialize(firsts(calls, "tool", "arguments", "refs").select(*key, "m.*", "rows"), "chat-named")
    first = checked(c, tools)
    first = first.join(levels(c), key, "left")
    errors = F.when(F.col("level").isNull(), F.concat(F.col("errors"), F.array(F.lit("refers in a circle")))).otherwise(F.col("errors"))
    first = materialize(first.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0), "chat-first")
    again = checked(repeats(calls, c, ["tool", "arguments", "refs"]), tools)
    again = materialize(again.withColumn("errors", F.concat(F.array(F.lit("repeated call")), "errors")).withColumn("valid", F.lit(False)), "chat-again")
    call_line = F.to_json(F.struct(F.col("parsed").alias("arguments"), F.col("conv_id"), F.col("call_id").alias("id"),
                                   F.lit("assistant").alias("role"), F.col("tool"), F.col("valid")), {"ignoreNullFields": "false"})
    one = F.lit(1).cast("long").alias("rows")
    out = first.select("conv_id", "level", "turn", F.lit("call").alias("kind"), "call_id", "valid", "errors", call_line.alias("line"), one)

    r = firsts(results, "content").select(*key, "m.*", "rows")
    r = r.join(first.select(*key, "level", "tool", F.lit(True).alias("linked")), key, "left")
    kind = F.when(F.col("linked").isNull(), "orphan result").otherwise("result")
    none = F.array().cast("array<string>")
    result_line = F.to_json(F.struct("content", "conv_id", F.col("call_id").alias("id"), F.lit("tool").alias("role"), "tool"), {"ignoreNullFields": "false"})
    r = r.withColumn("kind", kind).withColumn("valid", F.col("kind") == "result")
    r = materialize(r, "chat-results")
    answers = r.select("conv_id", "level", "turn", "kind", "call_id", "valid",
                       F.when(F.col("valid"), none).otherwise(F.array("kind")).alias("errors"), result_line.alias("line"), one)

    extra = repeats(results, r, ["content"]).join(first.select(*key, "tool"), key, "left")

    def reported(d: DataFrame, kind: str, errors: Column, line: Column = F.lit(None).cast("string"), rows: Column = one) -> DataFrame:
        return d.select("conv_id", F.lit(None).cast("int").alias("level"), "turn", F.lit(kind).alias("kind"), "call_id",
                        F.lit(False).alias("valid"), errors.alias("errors"), line.alias("line"), rows)

    # what names no conversation, turn or call cannot be linked, but keeps all it holds
    lost = checked(calls.where("not whole"), tools)
    lost = lost.withColumn("errors", F.concat(F.array(F.lit("null key")), "errors")).withColumn("valid", F.lit(False))
    return (out.unionByName(answers).unionByName(reported(again, "repeated call", F.col("errors"), call_line, F.col("rows")))
            .unionByName(reported(extra, "extra result", F.array(F.lit("extra result")), result_line, F.col("rows")))
            .unionByName(reported(lost, "call", F.col("errors"), call_line))
            .unionByName(reported(results.where("not whole").withColumn("tool", F.lit(None).cast("string")), "orphan result", F.array(F.lit("null key")), result_line)))


TOOLS = (("search", (("query", "string", True), ("limit", "integer", False))),
         ("fetch", (("url", "string", True), ("after", "string", False), ("timeout", "number", False))),
         ("store", (("items", "array", True), ("meta", "object", False))))


def stand_in(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and tools in the operator's schema, taken from the conversation table.

    Every assistant turn makes a call with arguments from its text, the next
    user turn is its result; some refer to an earlier call, some carry
    arguments of other types, some results name no call.
    """
    t = read(spark, sf_dir, "conversations").withColumn("w", words_of(F.col("text")))
    pick = F.pmod(F.xxhash64("text"), F.lit(12))
    name = lambda turn: F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    few = F.slice("w", 1, 4)
    search = F.to_json(F.struct(F.array_join(few, " ").alias("query"), F.when(pick < 6, F.size("w")).alias("limit")))
    fetch = F.to_json(F.struct(F.when(pick > 1, F.size("w") / 4).alias("timeout"), F.get("w", 0).alias("url")))
    store = F.to_json(F.struct(F.struct(F.size("w").alias("z"), F.get("w", 1).alias("a")).alias("meta"), F.when(pick > 2, few).alias("items")))
    kind = F.pmod(F.col("turn") + F.col("conv_id"), F.lit(4))
    tool = F.when(kind == 0, "search").when(kind == 1, "fetch").when(kind == 2, "store").otherwise(F.when(pick == 0, "other").otherwise("search"))
    args = (F.when(tool == "fetch", fetch).when(tool == "store", store)
            .when(pick == 1, F.substring(search, 1, 9)).otherwise(search))
    earlier = F.floor(F.col("turn") / 8) * 2 + 1
    refs = F.when((earlier < F.col("turn")) & (pick % 2 == 0), F.array(name(earlier.cast("long")))).otherwise(F.array().cast("array<string>"))
    calls = t.where("role = 'assistant'").select("conv_id", "turn", name(F.col("turn")).alias("call_id"), tool.alias("tool"), args.alias("arguments"), refs.alias("refs"))
    results = t.where("role = 'user' and turn > 1").select("conv_id", "turn", name(F.col("turn") - F.when(pick == 3, 2).otherwise(1)).alias("call_id"), F.col("text").alias("content"))
    param = lambda n, t, r: F.struct(F.lit(n).alias("name"), F.lit(t).alias("type"), F.lit(r).alias("required"))
    known = F.array(*[F.struct(F.lit(n).alias("tool"), F.array(*[param(*p) for p in ps]).alias("params")) for n, ps in TOOLS])
    return calls, results, spark.range(1).select(F.inline(known))
