"""The registered queries of the training-data operators: each runs over its whole table and derives the contract's columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import byte_shards, cgk_decontam, conflict_packing, inner_topk, katz, phrase_automata, phrase_mining, ppm_lang, prefix_trie, repair_store, setsketch, token_counts, toxic_chain

TOKENIZER = "word_bpe_49k.json"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_repair_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_store.token_store(_read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end_id=2)


def op2_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_chain.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), categories())


def categories() -> dict[str, Column]:
    """The chain over the table `labels`: toxic, and whether a toxic text is junk or prose by its quality."""
    toxic, quality = F.col("toxic"), F.col("quality")
    return {"p_toxic": toxic, "p_toxic_junk": toxic * (1 - quality), "p_toxic_prose": toxic * quality}


def op3_conflict_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflict_packing.pack(_read(spark, sf_dir, "documents"), capacity=8192)


def op4_norm_sorted_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inner_topk.top_inner_products(inner_topk.integer_vectors(_read(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0, k=20)


def op5_resync_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), token_limit=2048)


def op6_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_lang.identify(_read(spark, sf_dir, "documents"))


def op7_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cgk_decontam.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), similarity=0.8)
    return found.select("doc_id", "item_id", "start", "edits", "item_words")


def op8_prefix_sum_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_shards.byte_shards(_read(spark, sf_dir, "documents"), shards=16)


def op9_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(_read(spark, sf_dir, "documents"), percent=85).drop("text_hash")


def op10_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = phrase_automata.remove_repeats(_read(spark, sf_dir, "documents"), span=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bigram model; sums of logarithms are rounded, as their last digits depend on the order of summing."""
    training = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) != 2
    out = katz.score(_read(spark, sf_dir, "documents"), training, order=2)
    return out.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op12_phrase_quicksort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.collocations(_read(spark, sf_dir, "documents"), least=100, best=2000)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_read(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_repair_store,
        op2_toxicity_chain,
        op3_conflict_best_fit,
        op4_norm_sorted_topk,
        op5_resync_token_counts,
        op6_ppm_language,
        op7_cgk_decontamination,
        op8_prefix_sum_shards,
        op9_setsketch_near_dedup,
        op10_phrase_automata,
        op11_katz_backoff,
        op12_phrase_quicksort,
        op13_prefix_trie,
    )
}

_OP4_SQL = """
WITH v AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

#: The crc32 of a text is a fold over its bytes, by a table of 256 entries that the reversed polynomial gives.
_OP8_SQL = """
WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS tab),
hex AS (SELECT doc_id, row_number() OVER () AS r, CAST(coalesce(octet_length(encode(text)), 0) + 1 AS BIGINT) AS size, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS h FROM documents),
crc AS (SELECT doc_id, r, size, xor(list_reduce(list_prepend(4294967295, list_transform(h, lambda x: CAST(16 * (instr('0123456789ABCDEF', x[1]) - 1) + instr('0123456789ABCDEF', x[2]) - 1 AS BIGINT))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM hex, tab),
placed AS (SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, crc, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first, sum(size) OVER () AS total FROM crc),
s AS (SELECT *, CAST(least(15, first * 16 // total) AS INTEGER) AS shard FROM placed)
SELECT doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY first, r) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""

#: The crc32 of a document's id as text, by the same table.
_ID_CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"
_TAB = "tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS tab)"

_WORDS = r"""regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"""

_OP9_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
und AS (SELECT x AS u, y AS v FROM l UNION ALL SELECT y, x FROM l),
reach(u, v) AS (SELECT u, v FROM und UNION SELECT r.u, e.v FROM reach r JOIN und e ON e.u = r.v),
low AS (SELECT u, min(v) AS low FROM reach GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(low, d.doc_id)) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON u = d.doc_id
"""

_OP10_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
rep AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS rn FROM win) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM rep, range(20) t(k)),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
kept AS (SELECT a.doc_id, count(*) AS n, count(g.p) AS gone, string_agg(word, ' ' ORDER BY a.p) FILTER (WHERE g.p IS NULL) AS t FROM word a LEFT JOIN gone g ON g.doc_id = a.doc_id AND g.p = a.p GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: ' end' and ' start' hold a space, so that they are no words.
_OP11_SQL = f"""
WITH {_TAB},
d AS (SELECT doc_id, row_number() OVER () AS r, coalesce({_ID_CRC} % 7 = 2, false) AS held, list_append({_WORDS.format(text=_LOWER)}, ' end') AS w FROM documents, tab),
tok AS (SELECT r, held, unnest(w) AS w, unnest(list_prepend(' start', w[:-2])) AS v FROM d),
c1 AS (SELECT w, count(*) AS c FROM tok WHERE NOT held GROUP BY 1),
c2 AS (SELECT v, w, count(*) AS c FROM tok WHERE NOT held GROUP BY 1, 2),
t AS (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS n, count(*) AS v FROM c1),
of AS (SELECT v, sum(c) AS c FROM c2 GROUP BY 1),
nr AS (SELECT 1 AS level, c, count(*) AS n FROM c1 GROUP BY 2 UNION ALL SELECT 2, c, count(*) FROM c2 GROUP BY 2),
fit AS (SELECT level, least(CASE WHEN count(*) > 1 THEN regr_slope(ln(n), ln(c)) ELSE -2 END, -1.05) + 1 AS power FROM nr WHERE c <= 64 GROUP BY 1),
turing AS (SELECT a.level, a.c, (a.c + 1) * b.n / (a.c * a.n) AS t FROM nr a JOIN nr b ON b.level = a.level AND b.c = a.c + 1 WHERE a.c <= 5),
disc AS (SELECT nr.level, nr.c, CASE WHEN t > 0 AND t < 1 THEN t ELSE pow(1 + 1 / nr.c, power) END AS d FROM nr JOIN fit USING (level) LEFT JOIN turing u ON u.level = nr.level AND u.c = nr.c),
p1 AS (SELECT w, c1.c AS c, d * c1.c / n AS p FROM c1, t, disc WHERE disc.level = 1 AND disc.c = c1.c),
p2 AS (SELECT c2.v, c2.w, d * c2.c / of.c AS p FROM c2 JOIN of USING (v) JOIN disc ON disc.level = 2 AND disc.c = c2.c),
a0 AS (SELECT 1 - coalesce(sum(p), 0) AS a FROM p1),
a1 AS (SELECT v, (1 - sum(p2.p)) / (1 - sum(p1.p)) AS a FROM p2 JOIN p1 USING (w) GROUP BY 1),
s AS (SELECT r, count(*) AS n_tokens, count(p1.c) AS n_known, sum(log10((coalesce(p1.c, 0) + 1) / (t.n + t.v + 1))) AS base,
      sum(CASE WHEN p2.p IS NOT NULL THEN log10(p2.p) ELSE log10(coalesce(a1.a, 1)) + log10(coalesce(p1.p, a0.a)) END) AS score
      FROM tok CROSS JOIN t CROSS JOIN a0 LEFT JOIN p1 ON p1.w = tok.w LEFT JOIN p2 ON p2.v = tok.v AND p2.w = tok.w LEFT JOIN a1 ON a1.v = tok.v GROUP BY r)
SELECT doc_id, held AS held_out, n_tokens, n_known, t.n AS train_tokens, round(base, 6) AS base_score, round(score, 6) AS score FROM d JOIN s USING (r), t
"""

_OP12_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all({_LOWER}, '[^.,;:!?\x0A-\x0D]+')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM w, range(1, 6) r(m) WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
cut AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM c, range(1, 5) r(k) WHERE k < m),
s AS (SELECT cut.lang, cut.phrase, cut.a, k, x.a AS l, y.a AS r, n, CAST(1000::HUGEINT * cut.a * n // (x.a::HUGEINT * y.a) AS BIGINT) AS score
      FROM cut JOIN t USING (lang) JOIN f x ON x.lang = cut.lang AND x.phrase = head JOIN f y ON y.lang = cut.lang AND y.phrase = tail),
low AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS i FROM s) WHERE i = 1),
sub AS (SELECT lang, a, array_to_string(w[:m - 1], ' ') AS phrase FROM c WHERE m > 2 UNION SELECT lang, a, array_to_string(w[2:], ' ') FROM c WHERE m > 2),
kept AS (SELECT * FROM low ANTI JOIN sub ON sub.lang = low.lang AND sub.phrase = low.phrase AND sub.a = low.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""

_OP13_SQL = f"""
WITH {_TAB},
o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {_ID_CRC.replace("doc_id", "conv_id")} % 6 AS h, conv_id - conv_id % 100 AS base FROM (SELECT DISTINCT conv_id FROM o), tab),
hd AS (SELECT c.conv_id, pos, role, text FROM c JOIN o ON o.conv_id = base AND pos <= h),
k AS (SELECT c.conv_id, h, count(hd.pos) AS n FROM c LEFT JOIN hd ON hd.conv_id = c.conv_id GROUP BY 1, 2),
re AS (SELECT * FROM hd UNION ALL SELECT o.conv_id, pos - h + n, role, text FROM o JOIN k ON k.conv_id = o.conv_id WHERE pos > h),
l AS (SELECT k.conv_id, coalesce(list([role, text] ORDER BY pos) FILTER (pos IS NOT NULL), []) AS t FROM k LEFT JOIN re ON re.conv_id = k.conv_id GROUP BY 1),
pre AS (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM l),
m AS (SELECT conv_id, d, t, md5(CAST(to_json(t[:d]) AS VARCHAR)) AS key, CASE WHEN d > 0 THEN md5(CAST(to_json(t[:d - 1]) AS VARCHAR)) END AS up, CASE WHEN d > 0 THEN length(t[d][2]) ELSE 0 END AS chars FROM pre),
node AS (SELECT key, d, any_value(up) AS up, any_value(t) AS t, min(conv_id) AS conv_id, count(*) AS n, any_value(chars) AS chars FROM m GROUP BY 1, 2),
kids AS (SELECT up, count(*) AS n FROM node GROUP BY 1),
sub AS (SELECT n.key, n.d, (n.n - 1) * n.chars AS saved, CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END AS leaf, n.t, unnest(range(0, n.d + 1)) AS j FROM node n LEFT JOIN kids ON kids.up = n.key),
total AS (SELECT md5(CAST(to_json(t[:j]) AS VARCHAR)) AS key, sum(saved) AS saved, sum(leaf) AS leaves FROM sub GROUP BY 1),
fin AS (SELECT md5(CAST(to_json(t) AS VARCHAR)) AS key, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM l GROUP BY 1)
SELECT node.conv_id, CAST(node.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, node.n AS n_convs, CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM node JOIN total USING (key) LEFT JOIN kids ON kids.up = node.key LEFT JOIN node p ON p.key = node.up LEFT JOIN fin ON fin.key = node.key
"""

ORACLE_SQL = {"op4_norm_sorted_topk": _OP4_SQL, "op8_prefix_sum_shards": _OP8_SQL, "op9_setsketch_near_dedup": _OP9_SQL, "op10_phrase_automata": _OP10_SQL, "op11_katz_backoff": _OP11_SQL, "op12_phrase_quicksort": _OP12_SQL, "op13_prefix_trie": _OP13_SQL}
