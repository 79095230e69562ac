"""DuckDB SQL of the training-data queries that SQL can express, in the most literal form of each rule."""

from __future__ import annotations

from taskshift.llm import collocations as C
from taskshift.llm import quality_rules as Q
from taskshift.llm import range_shards as R
from taskshift.llm import source_mix as M
from taskshift.llm import spelling_variants as V

WORD = r"[^\x20\x09-\x0D]"
ORACLE: dict[str, str] = {}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _plain(regex: str) -> str:
    """A regular expression without possessive quantifiers (DuckDB's matcher never backtracks)."""
    return _q(regex.replace("++", "+").replace("*+", "*"))


# -- near duplicates: all pairs over shared shingles, then the closure of the links ----------

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE["op2_minhash_lsh_forest"] = f"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{WORD}+') AS ws FROM documents
),
s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS sh FROM w
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
    SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_n FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
    JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b
    WHERE 100 * both_n >= 85 * (na.n + nb.n - both_n)
),
reach AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION
    SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.doc_id = d.doc_id"""

# -- quality rules ------------------------------------------------------------------------

_letters, _capitals = r"len(regexp_extract_all(l, '\p{L}'))", r"len(regexp_extract_all(l, '\p{Lu}'))"
_symbols = f"len(regexp_extract_all({{}}, {_q(Q.SYMBOLS)}))"
_phrases = " OR ".join(f"contains(lower(l), {_q(p)})" for p in Q.BOILERPLATE)
_fails = f"""(regexp_matches(l, {_plain(Q.NAV_LINE)}) OR {_symbols.format('l')} > {Q.MAX_SYMBOL_SHARE} * length(l)
      OR ({_letters} >= {Q.SHOUT_MIN_LETTERS} AND {_capitals} > {Q.SHOUT_SHARE} * {_letters})
      OR (NOT regexp_matches(l, {_plain(Q.END_MARKS)}) AND regexp_matches(l, {_plain(Q.OPEN_LINE)})) OR {_phrases})"""
ORACLE["op7_quality_rules"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}+') AS ws, string_split(t, chr(10)) AS every FROM d),
l AS (SELECT *, list_filter(every, lambda l: regexp_matches(l, '{WORD}')) AS ls,
        list_filter(every, lambda l: NOT regexp_matches(l, '{WORD}') OR NOT {_fails}) AS stay FROM w),
win AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 3), lambda i: struct_pack(i := i, s := array_to_string(ws[i:i + 4], ' ')))) AS x
        FROM w WHERE len(ws) > 5),
twice AS (SELECT doc_id, x.i AS i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, x.s) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
b AS (SELECT l.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST({_symbols.format('t')} AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, length(t) AS size, length(array_to_string(stay, chr(10))) AS stays
      FROM l LEFT JOIN rep ON rep.doc_id = l.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {Q.BASE_MIN_WORDS} OR 100 * n_repeat_words > {Q.BASE_MAX_REPEAT_PCT} * n_words AS base_failed,
  NOT (n_words < {Q.BASE_MIN_WORDS} OR 100 * n_repeat_words > {Q.BASE_MAX_REPEAT_PCT} * n_words)
    AND size > 0 AND CAST(size - stays AS DOUBLE) / greatest(size, 1) <= {Q.MAX_LOST} AS kept
FROM b"""

# -- nearest neighbours: every pair ----------------------------------------------------------

ORACLE["op9_vp_tree"] = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id,
        sqrt(list_reduce(list_transform(list_zip(q.e, v.e), lambda x: (x[1] - x[2]) * (x[1] - x[2])), lambda a, b: a + b)) AS score
      FROM v q JOIN v ON v.vec_id <> q.vec_id AND len(v.e) = len(q.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10"""

# -- source mix: water-filling, then every quotient, highest first ------------------------------

_hash = "md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, '')))".format(seed=M.SEED)
_block = "CASE " + " ".join(f"WHEN target >= {M.LEAST_BLOCKS * b} THEN {b}" for b in reversed(M.BLOCKS)) + " ELSE 1 END::BIGINT"
ORACLE["op10_source_mix"] = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}+')) AS BIGINT) AS size, {_hash} AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, (source_size * {M.MAX_EPOCHS})::DOUBLE AS stop FROM s),
u AS (SELECT *, sum(source_size) OVER () * {M.SHARE}::DOUBLE - coalesce(sum(stop) OVER up, 0) AS left_words,
        sum(weight) OVER () - coalesce(sum(weight) OVER up, 0) AS left_weight FROM w
      WINDOW up AS (ORDER BY stop / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(left_words / left_weight, stop / weight) AS level FROM u WHERE stop > weight * (left_words / left_weight)),
tt AS (SELECT source, k, source_size, greatest(ceil(source_size / {M.SHARD_WORDS}.0), ceil(n_docs / {M.SHARD_DOCS}.0), 1)::BIGINT AS n_shards,
        round(CASE WHEN level IS NULL THEN stop ELSE least(stop, weight * level) END, 6) AS target FROM u, f),
t AS (SELECT *, {_block} AS block FROM tt),
seats AS (SELECT block, CAST(round(sum(target) / block) AS BIGINT) AS n FROM t GROUP BY block),
quot AS (SELECT t.k, t.block, t.target, n, unnest(range(n)) AS j FROM t JOIN seats USING (block) WHERE target > 0),
won AS (SELECT k, count(*) AS blocks FROM (SELECT k, n, row_number() OVER (PARTITION BY block ORDER BY target / (2 * j + 1) DESC, k, j) AS r FROM quot) WHERE r <= n GROUP BY k),
p AS (SELECT d.*, t.k, t.source_size, t.target, t.block, coalesce(won.blocks, 0) AS blocks, ('0x' || substr(h, 1, 12))::BIGINT % t.n_shards AS shard
      FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source LEFT JOIN won ON won.k = t.k),
sh AS (SELECT k, any_value(source) AS source, shard, sum(size)::BIGINT AS shard_size, max(blocks) AS blocks, max(block) AS block FROM p GROUP BY k, shard),
shq AS (SELECT k, shard, unnest(range(blocks)) AS j, shard_size FROM sh WHERE shard_size > 0),
shw AS (SELECT k, shard, count(*) AS quota FROM (SELECT q.*, row_number() OVER (PARTITION BY k ORDER BY shard_size / (2 * j + 1)::DOUBLE DESC, shard, j) AS r FROM shq q) x
        JOIN (SELECT DISTINCT k AS k2, blocks FROM sh) y ON y.k2 = x.k WHERE r <= blocks GROUP BY k, shard),
g AS (SELECT sh.k, sh.shard, ceil(shard_size / block::DOUBLE)::BIGINT AS n_blocks,
        least(coalesce(quota, 0), {M.MAX_EPOCHS} * ceil(shard_size / block::DOUBLE)::BIGINT) AS quota,
        ('0x' || substr(md5('{M.SEED}:' || coalesce(source, '') || ':' || CAST(sh.shard AS VARCHAR)), 1, 8))::BIGINT AS off
      FROM sh LEFT JOIN shw ON shw.k = sh.k AND shw.shard = sh.shard),
o AS (SELECT p.*, n_blocks, quota, off, [{', '.join(map(str, M.STRIDES))}][(off % {len(M.STRIDES)}) + 1]::BIGINT AS stride,
        (sum(size) OVER (PARTITION BY p.k, p.shard ORDER BY h, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS first
      FROM p JOIN g ON g.k = p.k AND g.shard = p.shard),
bl AS (SELECT doc_id, h, k, size, first, block, quota, n_blocks, stride, off, unnest(range(first // block, (first + size - 1) // block + 1)) AS b FROM o WHERE size > 0),
tk AS (SELECT doc_id, first, k, sum((least(first + size, (b + 1) * block) - greatest(first, b * block))
        * (quota // n_blocks + CASE WHEN ((stride % n_blocks) * b + off) % n_blocks < quota % n_blocks THEN 1 ELSE 0 END)) AS taken FROM bl GROUP BY doc_id, first, k)
SELECT o.doc_id, o.size, o.source_size, o.target, CAST(coalesce(tk.taken, 0) AS BIGINT) AS taken, o.source
FROM o LEFT JOIN tk ON tk.doc_id = o.doc_id AND tk.first = o.first AND tk.k = o.k"""

# -- crc32, bit by bit ------------------------------------------------------------------------


def _crc32(hexed: str) -> str:
    """Unsigned CRC-32 (reflected polynomial EDB88320) of the octets in the column ``hexed`` of hex digits; ``crc_table`` must be joined."""
    octets = f"list_prepend(4294967295::BIGINT, list_transform(range(1, length({hexed}), 2), lambda i: ('0x' || substr({hexed}, i, 2))::BIGINT))"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, crc_t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"


_CRC_TABLE = """crc_table AS (SELECT list(list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
    lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY k) AS crc_t FROM range(256) r(k))"""

# -- shards: running bytes over all documents in key order ---------------------------------------

ORACLE["op13_range_shards"] = f"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, coalesce(text, '') AS t, md5(coalesce(text, '')) AS h, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size FROM documents),
o AS (SELECT *, sum(size) OVER all_before - size AS own, row_number() OVER all_before AS place, sum(size) OVER () AS total,
        sum(size) OVER (PARTITION BY h) AS bytes, count(*) OVER (PARTITION BY h) AS n
      FROM d WINDOW all_before AS (ORDER BY h, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
u AS (SELECT *, CASE WHEN n > 1 AND bytes * {R.N_SHARDS * R.HEAVY} > total THEN 2 * own + size ELSE 2 * min(own) OVER (PARTITION BY h) + bytes END AS middle FROM o),
s AS (SELECT *, CAST(least({R.N_SHARDS - 1}, ({R.N_SHARDS} * middle) // (2 * total)) AS INTEGER) AS shard FROM u)
SELECT doc_id, size, {_crc32('hx')} AS text_crc32, 'bytes' AS law, shard,
  CAST(place - min(place) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM (SELECT *, hex(encode(t)) AS hx FROM s), crc_table"""

# -- spelling variants: equal after one code point is left out or masked ------------------------

ORACLE["op12_spelling_variants"] = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[a-zÀ-ÿ]+')) AS run FROM documents),
each AS (SELECT id, run, count(*) AS c, any_value(hex(encode(id || ':' || run))) AS hx FROM runs WHERE length(run) >= {V.LEAST_LENGTH} GROUP BY id, run),
hashed AS (SELECT run, c, {_crc32('hx')} AS h FROM each, crc_table),
ws AS (SELECT CASE WHEN h % {V.SPOILED} = 0 THEN run[:(h % length(run))] || run[(h % length(run)) + 2:] ELSE run END AS word, c FROM hashed),
v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM ws WHERE length(word) >= {V.LEAST_LENGTH} GROUP BY word HAVING sum(c) >= {V.LEAST_N}),
cut AS (SELECT word, i, word[:i - 1] AS a, word[i + 1:] AS b FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
swapped AS (SELECT x.word, y.word AS near FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word),
longer AS (SELECT DISTINCT c.word, v.word AS near FROM cut c JOIN v ON v.word = c.a || c.b),
pairs AS (SELECT word, near FROM swapped UNION SELECT word, near FROM longer UNION SELECT near, word FROM longer),
best AS (SELECT p.word, count(*) AS n_near, arg_min(p.near, (-v.n, p.near)) AS near, max(v.n) AS near_n FROM pairs p JOIN v ON v.word = p.near GROUP BY p.word),
f AS (SELECT v.word, v.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN near_n >= {V.RATIO} * v.n THEN near END AS form,
        CASE WHEN near_n >= {V.RATIO} * v.n THEN near_n END AS form_n FROM v LEFT JOIN best ON best.word = v.word),
walk AS (SELECT word, word AS at_word FROM f UNION ALL SELECT w.word, f.form FROM walk w JOIN f ON f.word = w.at_word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.at_word AS root, f.n, f.n_near, f.form_n
FROM f JOIN walk w ON w.word = f.word JOIN f last ON last.word = w.at_word AND last.form IS NULL"""

# -- collocations: every phrase of every piece ---------------------------------------------------

ORACLE["op11_collocations"] = f"""
WITH pieces AS (SELECT coalesce(lang, '{C.NO_LANG}') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])) AS ws FROM w, range(1, {C.LONGEST + 1}) r(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, ws, count(*) AS a FROM grams GROUP BY lang, k, ws HAVING count(*) >= {C.LEAST}),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
cuts AS (SELECT c.lang, c.k, c.ws, c.a, j, l.a AS l, r.a AS r, (CAST({C.SCALE} AS HUGEINT) * c.a) // (l.a + r.a) AS score
    FROM (SELECT *, unnest(range(1, k)) AS j FROM f WHERE k > 1) c
    JOIN f l ON l.lang = c.lang AND l.ws = c.ws[1:c.j] JOIN f r ON r.lang = c.lang AND r.ws = c.ws[c.j + 1:]),
weak AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, j) = 1),
inner_parts AS (SELECT lang, ws[i:i + m - 1] AS ws, max(a) AS most FROM f, range(1, {C.LONGEST}) i(i), range(2, {C.LONGEST}) m(m)
    WHERE k > m AND i + m - 1 <= k GROUP BY 1, 2),
stay AS (SELECT w.* FROM weak w LEFT JOIN inner_parts p ON p.lang = w.lang AND p.ws = w.ws WHERE p.most IS NULL OR 100 * p.most < {C.COVERED_PERCENT} * w.a),
named AS (SELECT lang, array_to_string(ws, ' ') AS phrase, a, l, r, CAST(score AS BIGINT) AS score FROM stay),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM named)
SELECT lang, rank, phrase, a, l, r, n.n, score FROM ranked JOIN n USING (lang) WHERE rank <= {C.TOP}"""
