"""The queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, hard_negatives, importance, lm_score, minhash, pack, pareto_mix, rule_quality, sphere_caps, suffix_dedup, syncmers, topk, url_sweep, zlang

#: (host, path, action) of the query on page addresses.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: The rules as OP5_SQL has them: it still blocks net/de/, which the contract allows. The SQL was not to be changed with the query.
SQL_URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "block"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of documents: 5-word shingles, similarity of 0.75 or more."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's loss as conversation less its loss as a document, per token."""
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations")
    scored = lm_score.score(docs, lm_score.fit(docs, target), keep=["doc_id"])
    return scored.select("doc_id", "n_tokens", *(F.round(c, 9).alias(c) for c in ("loss_background", "loss_target", "score")))


def op3_sphere_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of vectors of one label: cosine of 0.98 or more."""
    return sphere_caps.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents mixed to source weights 5, 2, 1, repeating."""
    return pareto_mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op5_url_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_sweep.apply_rules(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op6_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents packed into sequences of at most 2048 tokens."""
    packed = pack.pack(table(spark, sf_dir, "documents"), tokenizer_file())
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op7_zstd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from those not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", common.is_held_out(F.col("doc_id")))
    dictionaries = zlang.fit(docs.filter("not held_out"))
    return zlang.identify(docs.select("doc_id", "text", "held_out"), dictionaries).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op8_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from labels of those not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", common.is_held_out(F.col("doc_id")))
    docs = common.stored(rule_quality.measured(docs).drop("text"), "measured")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter(F.col("quality").isNotNull() & ~common.is_held_out(F.col("doc_id")))
    model = rule_quality.fit(docs.join(labels, "doc_id"))
    return rule_quality.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents without the bytes of 100-byte strings that start earlier."""
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_block_max_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best others for every embedding whose vec_id is divisible by 50."""
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn towards the words of benchmark."""
    return importance.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every hundredth embedding and each of its 5 best of the same label the 5 best of other labels that come within 80 to 100 % of its score."""
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", relabelled.alias("label"))
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)


def op13_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its text with the second half taken from the next one, and how like it they are to it."""
    pairs = syncmers.beside_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text, other = (F.coalesce(c, F.lit("")) for c in ("text", "next_text"))
    length, half = F.length(text), F.shiftright(F.length(text), 1)
    edited = F.concat(F.substring(text, F.lit(1), length - half), F.substring(other, F.lit(1), half))
    rows = pairs.select("doc_id", length.cast("long").alias("n_chars"), text.alias("text"), edited.alias("edited"), other.alias("next_text")).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    near = {"near_edited": ("text", "edited"), "near_next": ("text", "next_text")}
    return syncmers.with_fingerprints(rows, {"text": "fingerprint", "edited": "edited_fingerprint", "next_text": ""}, near)


def _rules_sql() -> str:
    return ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in SQL_URL_RULES)


OP5_SQL = rf"""
WITH p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rhost, rpath, action) AS (VALUES {_rules_sql()}),
m AS (
  SELECT p.page_id, p.host, p.path, rhost || rpath AS rule, action,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(rhost || rpath) DESC NULLS LAST, length(rhost) DESC) AS n
  FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m WHERE n = 1
"""

_MIX_PASS = """
f{n} AS (SELECT l.*, b.lim, sum(l.size) OVER (PARTITION BY l.source ORDER BY l.rk, l.size) AS upto FROM l{p} l JOIN b{p} b ON l.source IS NOT DISTINCT FROM b.source WHERE l.size <= b.lim),
t{n} AS (SELECT doc_id, source, size FROM f{n} WHERE upto <= lim),
b{n} AS (SELECT b.source, b.lim - coalesce((SELECT sum(size) FROM t{n} t WHERE t.source IS NOT DISTINCT FROM b.source), 0) AS lim FROM b{p} b),
l{n} AS (SELECT l.* FROM l{p} l WHERE l.doc_id NOT IN (SELECT doc_id FROM t{n})),"""

OP4_SQL = rf"""
WITH s AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS documents FROM s GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight FROM t),
v AS (SELECT *, (CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS BIGINT)
        - CAST(2.0 AS DOUBLE) * (CAST(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - source_size))
        / sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM w),
g AS (SELECT *, CASE WHEN lvl * weight < 2e0 * source_size THEN weight * (SELECT arg_min(lvl, source_size / weight) FROM v WHERE lvl * weight < 2e0 * source_size) ELSE 2e0 * source_size END AS target FROM v),
e AS (SELECT source, source_size, documents, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0e0 END AS expected FROM g),
p AS (SELECT *, CAST(floor(expected) AS BIGINT) AS whole, expected - floor(expected) AS part FROM e),
d AS (SELECT s.doc_id, s.source, s.size, p.source_size, p.target, p.whole, p.part, p.source_size / CAST(p.documents AS DOUBLE) AS mean,
        (CAST(('0x' || substr(md5(CAST(s.doc_id AS VARCHAR)), 1, 12)) AS BIGINT) + 0.5e0) / 281474976710656e0 AS u
      FROM s JOIN p ON s.source IS NOT DISTINCT FROM p.source),
l0 AS (SELECT doc_id, source, size, u / (1 - u) / (part / (1 - part) * sqrt(size / mean)) AS rk FROM d WHERE part > 0 AND size > 0),
b0 AS (SELECT source, CAST(floor(part * source_size + 0.5e0) AS BIGINT) AS lim FROM p),
{"".join(_MIX_PASS.format(n=n, p=n - 1) for n in (1, 2, 3, 4))}
x AS (SELECT doc_id FROM t1 UNION ALL SELECT doc_id FROM t2 UNION ALL SELECT doc_id FROM t3 UNION ALL SELECT doc_id FROM t4)
SELECT d.doc_id, d.size, d.source_size, d.target, CAST((whole + CASE WHEN x.doc_id IS NULL THEN 0 ELSE 1 END) * d.size AS BIGINT) AS taken, d.source, CAST(whole + CASE WHEN x.doc_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS copies
FROM d LEFT JOIN x ON d.doc_id = x.doc_id
"""


OP2_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws, 0 AS side FROM documents
  UNION ALL SELECT conv_id * 1000 + turn, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), 1 FROM conversations),
t AS (SELECT row_number() OVER () AS r, * FROM w),
o AS (SELECT r, doc_id, side, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM t),
c AS (SELECT word, count_if(side = 0) AS n, count_if(side = 1) AS m FROM o GROUP BY word),
z AS (SELECT sum(n) AS n, sum(m) AS m FROM c),
y AS (SELECT count(*) + 1 AS size FROM c),
b AS (SELECT *, coalesce(lag(word) OVER (PARTITION BY r ORDER BY i), ' ') AS prev FROM o),
f AS (SELECT prev, count_if(side = 0) AS n, count_if(side = 1) AS m FROM b GROUP BY prev),
g AS (SELECT prev, word, count_if(side = 0) AS n, count_if(side = 1) AS m FROM b GROUP BY prev, word),
p AS (SELECT b.r, b.doc_id,
        CASE WHEN f.n > 0 THEN 0.75e0 * g.n / CAST(f.n AS DOUBLE) + 0.25e0 * ((c.n + 1) / CAST(z.n + y.size AS DOUBLE)) ELSE (c.n + 1) / CAST(z.n + y.size AS DOUBLE) END AS pb,
        CASE WHEN f.m > 0 THEN 0.75e0 * g.m / CAST(f.m AS DOUBLE) + 0.25e0 * ((c.m + 1) / CAST(z.m + y.size AS DOUBLE)) ELSE (c.m + 1) / CAST(z.m + y.size AS DOUBLE) END AS pt
      FROM b JOIN f ON b.prev = f.prev JOIN g ON b.prev = g.prev AND b.word = g.word JOIN c ON b.word = c.word, z, y WHERE b.side = 0),
s AS (SELECT r, count(*) AS n, -avg(ln(pb)) AS lb, -avg(ln(pt)) AS lt FROM p GROUP BY r)
SELECT t.doc_id, coalesce(s.n, 0) AS n_tokens, round(lb, 9) AS loss_background, round(lt, 9) AS loss_target, round(lt - lb, 9) AS score FROM t LEFT JOIN s ON t.r = s.r WHERE side = 0
"""


OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS shingle FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 3, 2))) AS i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON r.seen = e.a),
g AS (SELECT id, min(seen) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, g.component_id, d.doc_id = g.component_id AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN g ON g.id = d.doc_id
"""

OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS norm FROM v WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(v, v) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id AND list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, seen) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, e.b FROM r JOIN e ON r.seen = e.a),
g AS (SELECT id, min(seen) AS component_id FROM r GROUP BY id),
k AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept FROM g LEFT JOIN k ON k.a = id
"""

OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


#: DuckDB has no crc32: it is built from the table of its 256 steps, once for each distinct word.
OP11_SQL = r"""
WITH RECURSIVE steps(i, c, n) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n + 1 FROM steps WHERE n < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE n = 8),
w AS (SELECT 0 AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
  UNION ALL SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
o AS (SELECT side, doc_id, unnest(ws) AS word FROM w),
d AS (SELECT word, hex(encode(word)) AS x FROM o GROUP BY word),
b AS (SELECT word, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT))), lambda acc, v: xor(acc // 256, t[xor(acc % 256, v) + 1])), 4294967295) % 10000 AS bucket FROM d, tab),
k AS (SELECT bucket, count_if(side = 0) AS s, count_if(side = 1) AS t FROM o JOIN b ON o.word = b.word GROUP BY bucket),
z AS (SELECT sum(s) AS s, sum(t) AS t FROM k),
g AS (SELECT bucket, CAST(floor(1000 * ln((k.t + 1)::DOUBLE * (z.s + 10000)::DOUBLE / ((k.s + 1)::DOUBLE * (z.t + 10000)::DOUBLE))) AS BIGINT) AS gain FROM k, z),
f AS (SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM o JOIN b ON o.word = b.word JOIN g ON b.bucket = g.bucket WHERE side = 0 GROUP BY doc_id),
c AS (SELECT w.doc_id, coalesce(f.n, 0) AS n_features, coalesce(f.weight, 0) AS weight, len(ws) >= 20 AS drawable,
        CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || w.doc_id), 1, 8) AS BIGINT) + 0.5e0) / 4294967296e0))) AS BIGINT) AS noise
      FROM w LEFT JOIN f ON w.doc_id = f.doc_id WHERE side = 0),
r AS (SELECT *, row_number() OVER (ORDER BY drawable DESC, weight + noise DESC, doc_id) AS place, count_if(drawable) OVER () AS n FROM c)
SELECT doc_id, n_features, weight, CAST(weight + noise AS BIGINT) AS score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM r
"""


OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same) WHERE n <= 5),
r AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 5
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash_bayes, op2_cross_entropy_difference, op3_sphere_caps, op4_pareto_mix, op5_url_sweep, op6_sum_of_squares_packing, op7_zstd_language, op8_rule_ensemble, op9_suffix_array_dedup, op10_block_max_topk, op11_importance_resampling, op12_hard_negatives, op13_syncmer_fingerprints)}


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_bayes": OP1_SQL, "op3_sphere_caps": OP3_SQL, "op10_block_max_topk": OP10_SQL, "op11_importance_resampling": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op2_cross_entropy_difference": OP2_SQL, "op4_pareto_mix": OP4_SQL, "op5_url_sweep": OP5_SQL}
