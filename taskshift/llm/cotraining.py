"""Quality classifier by co-training two views.

The text view sees figures of the content (word and line shapes, symbols,
capitals, repeats); the metadata view sees source, language and length. Both
start as logistic regressions on a sample of labelled documents. In each
round they score all documents, and what one view is sure of (and the labels
do not say) becomes a pseudo-label for the other. At the end each view is
calibrated on labelled documents that no round has trained on, and the
calibrated log-odds are added, the prior counted once, to score every
document.

Scale: features of all documents are computed once, in DataFrame functions,
and written; a round reads that narrow table. Labelled rows are a sample bounded
by ``MAX_LABELLED``, taken in hash order of doc_id; pseudo-labels are all that a view is
sure of, however many, and count together as much as the labelled rows do, so
that they neither vanish nor drown them. Fits are distributed; scoring covers all rows.

Defined results: null or empty text has zero figures, null source or language
are values of their own; documents with several labels count by majority
(ties: good), null labels do not count; without labelled documents of both
classes in the training and the calibration fold, scores are null and all
documents are kept; repeated rows score alike and each is returned; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import FeatureHasher, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskshift.llm.common import materialize, words_of

MAX_LABELLED = 20_000
ROUNDS = 2
SURE = 0.95
FOLDS = 5
KEEP_FROM = 0.5
TEXT = ("words", "word_length", "symbols", "digits", "capitals", "bangs", "lines", "ended", "repeated_lines", "distinct_words")
META = ("source", "lang", "length")


def features(docs: DataFrame) -> DataFrame:
    """doc_id and both views' figures of every document."""
    body = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", F.coalesce("source", F.lit("(null)")).alias("source"), F.coalesce("lang", F.lit("(null)")).alias("lang"), body.alias("text"))
    d = d.withColumn("w", words_of(F.col("text"))).withColumn("l", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n, size, lines = F.greatest(F.size("w"), F.lit(1)), F.greatest(F.length("text"), F.lit(1)), F.greatest(F.size("l"), F.lit(1))
    count = lambda regex: F.regexp_count("text", F.lit(regex))
    d = d.withColumns({
        "words": F.log1p(F.size("w")), "word_length": F.log1p(F.length(F.array_join("w", "")) / n), "symbols": F.log1p(10 * count("[#*$%&|<>]") / n),
        "digits": F.log1p(100 * count("[0-9]") / size), "capitals": count(r"\p{Lu}") / size, "bangs": count("!") / n, "lines": F.log1p(F.size("l")),
        "ended": F.size(F.filter("l", lambda x: x.rlike(r"[.!?]\s*$"))) / lines, "repeated_lines": 1 - F.size(F.array_distinct("l")) / lines,
        "distinct_words": F.size(F.array_distinct("w")) / n, "length": F.log1p(F.length("text"))})
    return d.select("doc_id", "source", "lang", "length", *TEXT)


def classifier(view: str) -> Pipeline:
    if view == "text":
        first = [VectorAssembler(inputCols=list(TEXT), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True)]
    else:
        first = [FeatureHasher(inputCols=list(META), outputCol="x", numFeatures=128, categoricalCols=["source", "lang"])]
    return Pipeline(stages=[*first, LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", regParam=0.01, maxIter=30)])


def scored(model: PipelineModel, rows: DataFrame, out: str) -> DataFrame:
    """Add the model's log-odds."""
    d = model.transform(rows).withColumn(out, vector_to_array("rawPrediction")[1])
    return d.select(*rows.columns, out)


def sampled(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def platt(rows: DataFrame, odds: str) -> Column | None:
    """Calibrated log-odds from a view's log-odds, fitted on (odds, label)."""
    d = VectorAssembler(inputCols=[odds], outputCol="x").transform(rows.select(odds, "label"))
    m = LogisticRegression(featuresCol="x", labelCol="label", maxIter=30).fit(d)
    return float(m.coefficients[0]) * F.col(odds) + float(m.intercept)


def classify(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, p_text, p_meta, score (probabilities of good quality), kept for every document."""
    f = materialize(features(docs), "cotrain-features")
    truth = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    least = f.groupBy("doc_id").agg(F.min(F.struct(*[c for c in f.columns if c != "doc_id"])).alias("x")).select("doc_id", "x.*")
    known = materialize(least.join(truth, "doc_id").withColumn("weight", F.lit(1.0)), "cotrain-labelled")
    fold = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FOLDS))
    train = materialize(sampled(known.where(fold > 0), MAX_LABELLED), "cotrain-train")
    held = materialize(sampled(known.where(fold == 0), MAX_LABELLED), "cotrain-held")
    if any(d.agg(F.count_distinct("label")).first()[0] < 2 for d in (train, held)):
        none = F.lit(None).cast("double")
        return f.select("doc_id", none.alias("p_text"), none.alias("p_meta"), none.alias("score"), F.lit(True).alias("kept"))

    free = f.join(known.select("doc_id"), "doc_id", "left_anti").where("doc_id is not null")
    models = {v: classifier(v).fit(train) for v in ("text", "meta")}
    n_train = train.count()
    sure = F.log(F.lit(SURE / (1 - SURE)))
    for _ in range(rounds):
        sets = {}
        for view, other in (("text", "meta"), ("meta", "text")):
            s = scored(models[view], free, "odds").where(F.abs("odds") >= sure)
            told = materialize(s.withColumn("label", (F.col("odds") > 0).cast("double")).drop("odds"), "cotrain-pseudo")
            told = told.withColumn("weight", F.lit(n_train / max(n_train, told.count())))
            sets[other] = train.unionByName(told)
        models = {v: classifier(v).fit(sets[v]) for v in sets}

    views = lambda d: scored(models["meta"], scored(models["text"], d, "text_odds"), "meta_odds")
    h = materialize(views(held), "cotrain-held-scored")
    text, meta = platt(h, "text_odds"), platt(h, "meta_odds")
    share = h.agg(F.avg("label")).first()[0]
    odds = text + meta - F.log(F.lit(share / (1 - share)))
    p = lambda x: F.round(1 / (1 + F.exp(-x)), 6)
    out = views(f).select("doc_id", p(text).alias("p_text"), p(meta).alias("p_meta"), p(odds).alias("score"))
    return out.withColumn("kept", F.col("score") >= KEEP_FROM)
