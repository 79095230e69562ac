"""Secret scans: candidates in texts, and a random forest that removes false positives.

On the main path only DataFrame functions and Spark's own ML stages are used.
A candidate is a quoted value of 8 or more signs behind ``=`` or ``:``, an
unquoted one of 5 or more behind a name that ends like a key's (``NAMES``; up to
four blanks apart, or an option and its value), a password in a URL, or a run of
16 or more key-like signs with a digit or ``DISTINCT`` different ones. Its figures: length, transitions between
kinds of characters and between letters (log-likelihood under the letter
pairs of a public vocabulary's words), share covered by that vocabulary's words,
shape flags, how it is assigned, the words around it (hashed) and the words
of its path (hashed). The forest is trained on labelled findings, at most
``MAX_LABELLED`` of them, taken in hash order; scanning covers every
candidate of every whole text.

Scale: texts are read and scanned in place; only redaction joins the secret
values back to their documents. One pass marks a text's candidates, and the
marked text is cut at the marks; a text without a sign of assignment or an
option (``SIGN``) is searched for key-like runs only. A text's candidates are
rows, so a text full of them is no larger a unit of work than others. Model,
dictionary and letter table have fixed bounds.

Defined results: a null or empty text has no candidates; a null path has no
words; repeated rows are scanned each; redaction replaces a document's secret
values wherever they are candidates in rows of that doc_id and text, a null doc_id
included; without labelled findings of both classes no
forest can be fitted, so no candidate is a false positive (``p_secret`` null,
``is_secret`` true); an empty table gives an empty result; extra columns are
ignored (redaction passes them through).
"""

from __future__ import annotations

import json
import math
import string

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskshift.llm.common import materialize, words_of

#: Sign by sign, since Java looks up a class of single signs in one table and tests ranges one after the other.
WORDISH = string.ascii_letters + r"0123456789+/_\-"
KEYISH = f"[{WORDISH}=]"
#: Ends of the names whose unquoted values are candidates.
NAMES = ("pw", "key", "pwd", "psk", "pass", "auth", "token", "creds", "passwd", "secret", "bearer", "password", "passcode", "credential", "passphrase", "credentials")
#: Different signs from which a key-like run without a digit is a candidate.
DISTINCT = 8
_NAME = f"(?i:{'|'.join(NAMES)})"


def _named(before: str, after: str) -> str:
    """Lookbehinds, each of one width, for a key-like name between ``before`` and ``after``."""
    widths = sorted({len(n) for n in NAMES})
    return "|".join(f"(?<={before}(?i:{'|'.join(n for n in NAMES if len(n) == w)}){after})" for w in widths)


def _assigned() -> str:
    gaps = ""
    for blanks in range(4, -1, -1):  # more blanks are looked at only behind as many
        after = r"\s" * blanks
        ways = "|".join(_named("", before + sign + after) for sign in ("[=:]", ":=", "=>") for before in ("", r"\s", "[\"']"))
        gaps = f"(?<=[=:>]{after})(?:{ways})" + (f"|(?<=\\s{after})(?:{gaps})" if gaps else "")
    return f"(?:{gaps}|" + _named("-", r"\s") + ")"


def _different(n: int) -> str:
    """``n`` different key-like signs, in the order in which they first come."""
    out = f"({KEYISH})"
    for k in range(2, n + 1):
        seen = "|".join(f"\\{i}" for i in range(1, k))
        out += f"(?:{seen}){{0,24}}+(?!{seen})({KEYISH})"
    return out


#: A run of key-like signs.
RUN = (f"(?<!{KEYISH})(?={KEYISH}{{16}})" + rf"""(?![{WORDISH}]*?{_NAME}=[^\s"'&=:>][^\s"'&]{{3,}}?[^\s"'&,;)])"""
       + rf"(?:(?=[{string.ascii_letters}+/_=\-]*+[0-9])|(?=" + _different(DISTINCT) + f")){KEYISH}{{16,}}+")
#: All kinds of candidates. The first line is what they have in common; few places of a text pass it.
CANDIDATE = (rf"""(?<![{WORDISH}])(?=[^\s"'])(?:"""
             r"""(?<=["'])(?:(?<=[=:].)|(?<=[=:]\s.))[^"'\s]{8,}+(?=["'])"""
             r"""|(?<=[^\s:@]:)[^\s/"'<>]{2,200}(?=@[A-Za-z0-9\[])"""
             r"""|(?<=[=:>\s])(?=[^=:>])""" + _assigned() + r"""[^\s"'&]{4,}[^\s"'&,;)]"""
             "|" + RUN + ")")
#: Every text with a candidate other than a ``RUN`` has this: a sign of assignment with a quoted value, a URL's password or a name beside it, or an option.
SIGN = (r"""[=:>\-](?:(?<=[=:])\s?["'][^"'\s]{8}|(?<=:)[^\s/"'<>]{2,200}@"""
        rf"""|(?<={_NAME}["'\s]?(?:[=:]|:=|=>))\s{{0,4}}[^\s"'=:>]|(?<=-){_NAME}\s)""")
#: Set around the candidates of a text.
BOUND = "\x01"
#: Pieces of a text are counted in blocks of 2 ** BLOCK.
BLOCK = 8
MAX_LABELLED = 6_000
TREES, TREE_DEPTH, SEED = 20, 8, 11
THRESHOLD = 0.5
LEFT, RIGHT = 60, 30
MARK = "<SECRET>"
FIGURES = ("length", "kinds", "letters", "dictionary", "distinct", "digits", "capitals", "hex", "uuid", "number", "quoted", "assigned", "spread", "named", "address", "placeholder")


def dictionary(path: str) -> tuple[list[str], list[float]]:
    """The vocabulary's whole words of three or more letters, and the log-probabilities of letter pairs in them (27 x 27; 26: any other sign)."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    words = []
    for piece in sorted(vocab, key=vocab.get):
        w = piece.removesuffix("</w>")
        if piece.endswith("</w>") and len(w) >= 3 and w.isascii() and w.isalpha():
            words.append(w.lower())
    counts = [[1.0] * 27 for _ in range(27)]
    for w in words:
        for a, b in zip(w.lower(), w.lower()[1:]):
            counts[ord(a) - 97][ord(b) - 97] += 1
    return words, [math.log(c / sum(row)) for row in counts for c in row]


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, path, start (characters before it), value and the text left and right of every candidate."""
    d = docs.select("doc_id", "path", F.coalesce("text", F.lit("")).alias("text"))
    marked = lambda regex: F.regexp_replace("text", F.lit(regex), F.lit(f"{BOUND}$0{BOUND}"))
    # no filter on what comes of this: it would be pushed below the projection, and the search run twice
    d = d.withColumn("marked", F.when(F.col("text").rlike(SIGN), marked(CANDIDATE)).otherwise(marked(RUN)))
    # gaps and candidates in turn, from a gap to a gap; null without candidates
    apart = F.zip_with(F.split("text", CANDIDATE, -1), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)), lambda p, v: F.array(p, v))
    d = d.withColumn("pieces", F.when(F.contains("text", F.lit(BOUND)), F.array_compact(F.flatten(apart)))
                     .when(F.contains("marked", F.lit(BOUND)), F.split("marked", BOUND, -1))).drop("text", "marked")
    # characters before each piece: those of whole blocks of pieces before it, then those in its block
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, n: s + n)
    d = d.withColumn("sizes", F.transform("pieces", F.length))
    d = d.withColumn("blocks", F.transform(F.sequence(F.lit(0), F.shiftright(F.size("sizes"), BLOCK)), lambda k: total(F.slice("sizes", F.shiftleft(k, BLOCK) + 1, F.lit(1 << BLOCK)))))
    d = d.withColumn("before", F.transform("blocks", lambda n, k: total(F.slice("blocks", F.lit(1), k))))
    start = lambda i, k: F.get("before", k) + total(F.slice("sizes", F.shiftleft(k, BLOCK) + 1, i - F.shiftleft(k, BLOCK)))
    found = F.filter(F.transform("pieces", lambda p, i: F.when(i % 2 == 1, F.struct(
        p.alias("value"), start(i, F.shiftright(i, BLOCK)).cast("long").alias("start"), F.right(F.get("pieces", i - 1), F.lit(LEFT)).alias("left"),
        F.substring(F.get("pieces", i + 1), 1, RIGHT).alias("right")))), lambda x: x.isNotNull())
    return d.select("doc_id", "path", F.explode(found).alias("x")).select("doc_id", "path", "x.*")


def figures(found: DataFrame, words: list[str], pairs: list[float]) -> DataFrame:
    """Add the forest's figures and the neighbouring and path words to candidates."""
    v, n = F.col("value"), F.length("value")
    count = lambda regex: F.regexp_count("value", F.lit(regex))
    signs = F.split(F.lower(v), "")
    code = lambda s: F.when((s >= "a") & (s <= "z"), F.ascii(s) - 97).otherwise(26)
    table = F.lit(pairs)
    d = found.withColumn("codes", F.transform(signs, code))
    steps = F.zip_with(F.slice("codes", 1, F.size("codes") - 1), F.slice("codes", 2, F.size("codes") - 1), lambda a, b: F.get(table, a * 27 + b))
    # the words by their first two letters, as one folded constant
    shelves = [["", ""] for _ in range(26 * 26)]
    for w in words:
        shelves[(ord(w[0]) - 97) * 26 + ord(w[1]) - 97].insert(1, w)
    listed = F.split(F.lit("\n".join("|".join(x) for x in shelves)), "\n", -1)
    shelf = lambda w: F.get(listed, (F.ascii(w) - 97) * 26 + F.ascii(F.substring(w, 2, 1)) - 97)
    parts = F.transform(F.regexp_extract_all("value", F.lit("[A-Z]?[a-z]{2,}|[A-Z]{3,}"), F.lit(0)), F.lower)
    known = F.filter(parts, lambda w: (F.length(w) >= 3) & F.contains(shelf(w), F.concat(F.lit("|"), w, F.lit("|"))))
    covered = F.aggregate(known, F.lit(0), lambda s, w: s + F.length(w))
    flag = lambda c: c.cast("double")
    neighbour = lambda c: words_of(F.regexp_replace(F.lower(c), r"[^\p{L}_]+", " "))
    before = F.slice(F.reverse(neighbour(F.col("left"))), 1, 3)
    near = F.concat(F.transform(before, lambda w, i: F.when(i == 0, F.concat(F.lit("<"), w)).otherwise(w)), F.transform(F.slice(neighbour(F.col("right")), 1, 1), lambda w: F.concat(F.lit(">"), w)))
    return d.withColumns({
        "length": F.log(n.cast("double")), "kinds": count("[0-9]+|[a-z]+|[A-Z]+|[^0-9a-zA-Z]+") / n,
        "letters": F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / n, "dictionary": covered / n,
        "distinct": F.size(F.array_distinct(signs)) / n, "digits": count("[0-9]") / n, "capitals": count("[A-Z]") / n,
        "hex": flag(v.rlike("^[0-9a-fA-F]+$")), "uuid": flag(v.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")),
        "number": flag(v.rlike("^[0-9]+$")), "quoted": flag(F.col("left").rlike("[\"']$")), "assigned": flag(F.col("left").rlike("[=:]\\s*[\"']?$")),
        "spread": F.size(F.array_distinct(F.regexp_extract_all("value", F.lit("..?"), F.lit(0)))) / n,
        "named": flag(F.col("left").rlike(f"(?i)({'|'.join(NAMES)})[\"']?\\s*(:=|=>|[=:]|\\s)\\s*[\"']?$")),
        "address": flag(F.col("left").rlike("://[^\\s/@]*:$") & F.col("right").startswith("@")),
        "placeholder": flag(v.rlike("^([$<{%(\\[].*|[*xX.#]+)$")),
        "near": near, "path_words": neighbour(F.coalesce("path", F.lit("")))}).drop("codes")


def train(labelled: DataFrame, words: list[str], pairs: list[float], n: int = MAX_LABELLED) -> PipelineModel | None:
    """Fit the forest on labelled findings: text, path, label (1: secret). A text's candidates share its label. None without both labels."""
    rows = labelled.select(F.xxhash64("text").alias("doc_id"), "path", "text", F.col("label").cast("double").alias("label"))
    rows = materialize(rows.where("text is not null and label is not null").orderBy("doc_id", "text", "label").limit(n), "secret-labelled")
    x = figures(candidates(rows), words, pairs).join(rows.select("doc_id", "label").distinct(), "doc_id")
    x = materialize(x.repartitionByRange(1, "doc_id", "start").sortWithinPartitions("doc_id", "start"), "secret-train")
    if x.select("label").distinct().count() < 2:
        return None
    stages = [HashingTF(inputCol="near", outputCol="near_x", numFeatures=96, binary=True),
              HashingTF(inputCol="path_words", outputCol="path_x", numFeatures=16, binary=True),
              VectorAssembler(inputCols=[*FIGURES, "near_x", "path_x"], outputCol="x"),
              RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=TREE_DEPTH,
                                     featureSubsetStrategy="onethird", seed=SEED)]
    return Pipeline(stages=stages).fit(x)


def scan(docs: DataFrame, labelled: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, start, value, p_secret, is_secret for every candidate of every document (doc_id, path, text)."""
    words, pairs = dictionary(vocabulary)
    model = train(labelled, words, pairs)
    d = candidates(docs)
    if model is None:
        return d.select("doc_id", "start", "value", F.lit(None).cast("double").alias("p_secret"), F.lit(True).alias("is_secret"))
    d = model.transform(figures(d, words, pairs)).withColumn("p_secret", F.round(vector_to_array("probability")[1], 6))
    return d.select("doc_id", "start", "value", "p_secret", (F.col("p_secret") >= THRESHOLD).alias("is_secret"))


def redact(docs: DataFrame, labelled: DataFrame, vocabulary: str, path: str) -> DataFrame:
    """``docs`` with the secret values in ``text`` replaced by ``MARK``; ``n_chars`` is counted anew."""
    # rows are told apart by doc_id and text: a repeated or null doc_id is no hindrance
    key = F.struct("doc_id", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("md5"))
    found = scan(docs.select(key.alias("doc_id"), F.col(path).alias("path"), "text"), labelled, vocabulary).where("is_secret")
    secrets = found.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("value").alias("__secrets"))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), key.alias("__key"))
    d = d.join(secrets, F.col("__key") == F.col("__id"), "left")
    body = F.col("__row.text")
    d = d.withColumn("__values", F.when(F.col("__id").isNotNull(), F.regexp_extract_all(body, F.lit(CANDIDATE), 0)))
    safe = F.transform(F.concat("__values", F.array(F.lit(""))), lambda v: F.when(F.array_contains("__secrets", v), F.lit(MARK)).otherwise(v))
    joined = F.array_join(F.zip_with(F.split(body, CANDIDATE, -1), safe, lambda p, v: F.concat(p, v)), "")
    d = d.withColumn("__text", F.when(F.col("__id").isNotNull(), joined).otherwise(body))
    out = {"text": F.col("__text"), "n_chars": F.when(F.col("__id").isNotNull(), F.length("__text").cast("long")).otherwise(F.col("__row.n_chars"))} \
        if "n_chars" in docs.columns else {"text": F.col("__text")}
    return d.select(*[out.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])


def stand_in_findings(docs: DataFrame, labels: DataFrame, n: int = MAX_LABELLED) -> DataFrame:
    """Labelled findings (text, path, label) in the scan's schema: words of the labelled documents around a finding of a known kind.

    The test tables hold no labelled findings, so each of ``n`` labelled
    documents, in hash order, gives one: its first words, a snippet (half of
    them credentials, half hashes, identifiers, numbers, slugs and
    placeholders), its next words. The ``n`` ids are broadcast (8 bytes each).
    """
    ids = labels.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    d = docs.join(F.broadcast(ids), "doc_id").select("doc_id", "source", "text")
    d = d.withColumn("w", F.slice(words_of(F.substring("text", 1, 2000)), 1, 40))
    salt = lambda k: F.concat(F.lit(f"{k}:"), F.col("doc_id").cast("string"))
    sha1, sha256 = F.sha1(salt(1)), F.sha2(salt(2), 256)
    b64 = F.translate(F.base64(F.unhex(sha256)), "=", "")
    uuid = F.concat_ws("-", F.substring(sha256, 1, 8), F.substring(sha256, 9, 4), F.substring(sha256, 13, 4), F.substring(sha256, 17, 4), F.substring(sha256, 21, 12))
    number = F.translate(F.substring(sha256, 1, 16), "abcdef", "012345")
    few = F.lower(F.regexp_replace(F.concat_ws("-", F.slice("w", 3, 3)), "[^A-Za-z-]", ""))
    quoted = lambda key, sep, v, q='"': F.concat(F.lit(f"{key}{sep}{q}"), v, F.lit(q))
    kinds = [
        (1, quoted("token", " = ", sha1)), (1, quoted("api_key", ": ", F.substring(b64, 1, 32))), (1, quoted("password", " = ", F.substring(b64, 5, 14), "'")),
        (1, F.concat(F.lit("secret="), sha256)), (1, F.concat(F.lit("Authorization: Bearer "), b64)),
        (1, F.concat(F.lit("aws_access_key_id = AKIA"), F.upper(F.substring(F.translate(sha256, "01", "xy"), 1, 15)), F.lit("7"))),
        (1, quoted("access_token", "=", sha1)), (1, quoted("client_secret", ": ", sha256)),
        (0, F.concat(F.lit("commit "), sha1)), (0, F.concat(F.lit("sha256: "), sha256)), (0, quoted("id", " = ", uuid)), (0, number),
        (0, F.concat(few, F.lit("-2019-"), few, F.lit("-0001"))), (0, quoted("name", " = ", few)), (0, F.concat(F.lit("https://example.com/"), few, F.lit("/20190412/"), few)),
        (0, quoted("token", " = ", F.concat(F.lit("your_token_here_"), F.lit("0000000000")))), (0, quoted("title", ": ", few)), (0, quoted("checksum", " = ", sha1)),
    ]
    plain_word = F.lower(F.regexp_replace(F.concat(F.get("w", 2), F.lit("value")), "[^A-Za-z]", ""))
    bare = lambda v: F.translate(v, "0123456789+/", "qzxjvkwyhpgu")
    short = F.concat(F.substring(b64, 3, 4), F.lit("!"), F.substring(b64, 9, 4))
    kinds += [
        (1, F.concat(F.lit("password="), short)), (1, F.concat(F.lit("DB_PASSWORD: "), F.concat(F.substring(b64, 7, 6), F.lit("#9")))), (1, F.concat(F.lit("api_key="), F.substring(sha1, 1, 12))),
        (1, F.concat(F.lit("postgres://admin:"), short, F.lit("@db.example.com:5432/main"))), (1, F.concat(F.lit("https://bot:"), F.substring(sha1, 5, 10), F.lit("@example.com/"))),
        (1, F.concat(F.lit("Authorization: Bearer "), bare(b64))), (1, F.concat(F.lit("the key "), bare(F.substring(b64, 1, 24)))), (1, F.concat(F.lit("--token "), bare(F.substring(sha1, 1, 20)))),
        (0, F.concat(F.lit("password: "), plain_word)), (0, F.concat(F.lit("token="), plain_word)), (0, F.concat(F.lit("key: "), plain_word)), (0, F.concat(F.lit("password=${"), F.upper(plain_word), F.lit("}"))),
        (0, F.concat(F.lit("mailto:"), plain_word, F.lit("@example.com"))), (0, F.concat(few, F.lit("-and-other-things"))), (0, F.concat(F.lit("src/main/"), few, F.lit("/modules"))),
        (0, F.concat(F.lit("getDefault"), F.initcap(plain_word), F.lit("FromSettings"))),
    ]
    kind = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(len(kinds)))
    snippet, label = F.lit(None).cast("string"), F.lit(0)
    for k, (y, s) in enumerate(kinds):
        snippet, label = F.when(kind == k, s).otherwise(snippet), F.when(kind == k, F.lit(y)).otherwise(label)
    snippet = F.when(F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(8)) == 0, F.upper(snippet)).otherwise(snippet)
    plain = lambda a, n: F.array_join(F.transform(F.slice("w", a, n), lambda w: F.regexp_replace(w, "[0-9\"'=:]", "")), " ")
    return d.select(F.concat_ws(" ", plain(1, 12), snippet, plain(13, 8)).alias("text"), F.col("source").alias("path"), label.alias("label"))
