"""The operators of this subpackage applied to their whole tables, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsift.llm import bpe, exact_dedup, langid, merkle, packing, pii, rlz, shard, simhash, topk, toxicity, trie, urls
from litsift.llm.common import held_out, table

SPACE_SQL = r"'[\x20\x09-\x0D]+'"


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    predict = langid.predictor(spark, langid.learn(docs.where(~held_out())))
    return (docs.select("doc_id", held_out().alias("held_out"), predict("text").alias("p"))
            .select("doc_id", "held_out", "p.lang_pred", "p.score"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rlz.dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.rules_df(spark, urls.RULES))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shard_documents(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = _tokenizer("byte_bpe_50k.tiktoken")
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, decoded=True))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(merkle.manifest(table(spark, sf_dir, "documents")))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP2_SQL = rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), {SPACE_SQL}), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos, len(ws) AS n FROM d),
s AS (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY win) < doc_id AS dup
      FROM (SELECT doc_id, pos, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS win FROM w)
      WHERE pos + 13 <= n),
m AS (SELECT w.doc_id, w.pos, w.word,
             coalesce(bool_or(s.dup) OVER (PARTITION BY w.doc_id ORDER BY w.pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), false) AS gone
      FROM w LEFT JOIN s ON s.doc_id = w.doc_id AND s.pos = w.pos),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '') AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""

OP4_SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS xs FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, unnest(xs) AS x, unnest(range(len(xs))) AS i FROM v),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
      FROM e q JOIN e c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP6_SQL = r"""
WITH r(action, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
t AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS n FROM t),
f AS (SELECT u.n, r.action, r.h || r.p AS rule, row_number() OVER (PARTITION BY u.n ORDER BY length(r.h || r.p) DESC, length(r.h) DESC) AS nth
      FROM u JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p))
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.action, 'allow') AS verdict FROM u LEFT JOIN f ON f.n = u.n AND f.nth = 1
"""

OP9_SQL = rf"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), {SPACE_SQL}, ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, CAST(count(*) OVER (PARTITION BY norm) AS BIGINT) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept, sha256(norm) AS text_sha256 FROM t
"""

OP11_SQL = r"""
WITH RECURSIVE
c AS (SELECT doc_id, source, lang, n_chars, text,
             list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
                 lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)) AS state
      FROM documents),
f AS (SELECT doc_id, lang, n_chars, doc_id IS NOT NULL AND xor(state, 4294967295::BIGINT) % 7 = 0 AS hit,
             coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
             coalesce(strlen(text) || ':' || text, '-') AS tail FROM c),
l AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
             CASE WHEN hit AND n_chars IS NOT NULL THEN sha256(head || strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) || tail) END AS shown FROM f),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM l),
t AS (SELECT lang, 0 AS level, CAST(pos AS BIGINT) AS pos, leaf AS h, CAST(n AS BIGINT) AS n FROM o
      UNION ALL
      SELECT lang, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY lang, level, pos // 2, n),
s AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS level, CAST(pos AS BIGINT) AS pos, h, CAST(n AS BIGINT) AS n FROM s
      UNION ALL
      SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY level, pos // 2, n),
p AS (SELECT row_number() OVER () AS id, doc_id, lang, 0 AS level, CAST(pos AS BIGINT) AS pos, CAST(n AS BIGINT) AS n, leaf, coalesce(shown, leaf) AS node, '' AS proof FROM o
      UNION ALL
      SELECT p.id, p.doc_id, p.lang, p.level + 1, p.pos // 2, (p.n + 1) // 2, p.leaf,
             sha256(CASE WHEN p.pos % 2 = 0 THEN p.node || coalesce(t.h, '') ELSE t.h || p.node END), p.proof || coalesce(t.h, '')
      FROM p LEFT JOIN t ON t.lang IS NOT DISTINCT FROM p.lang AND t.level = p.level AND t.pos = xor(p.pos, 1) WHERE p.n > 1),
q AS (SELECT p.id, p.doc_id, p.leaf, s.h AS subroot, 0 AS level, CAST(s.pos AS BIGINT) AS pos, CAST(s.n AS BIGINT) AS n, p.node, p.proof
      FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang WHERE p.n = 1
      UNION ALL
      SELECT q.id, q.doc_id, q.leaf, q.subroot, q.level + 1, q.pos // 2, (q.n + 1) // 2,
             sha256(CASE WHEN q.pos % 2 = 0 THEN q.node || coalesce(u.h, '') ELSE u.h || q.node END), q.proof || coalesce(u.h, '')
      FROM q LEFT JOIN u ON u.level = q.level AND u.pos = xor(q.pos, 1) WHERE q.n > 1)
SELECT q.doc_id, q.leaf, q.subroot, u.h AS root, sha256(q.proof) AS proof_sha256, q.node AS folded_root, q.node = u.h AS verified
FROM q JOIN u ON u.n = 1 WHERE q.n = 1
"""

OP13_SQL = r"""
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS i
           FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
g AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY i) AS turns,
             xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
                 lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)),
                 4294967295::BIGINT) % 6 AS h
      FROM t GROUP BY conv_id),
r AS (SELECT g.conv_id, list_concat(coalesce(list_slice(b.turns, 1, g.h), []), list_slice(g.turns, g.h + 1, len(g.turns))) AS s
      FROM g LEFT JOIN g b ON b.conv_id = g.conv_id - g.conv_id % 100),
p AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS depth FROM r),
v AS (SELECT depth, list_slice(s, 1, depth) AS prefix, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(length(s[depth].text)) AS n,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(s) = depth), '')) AS ends_sha256
      FROM p GROUP BY depth, list_slice(s, 1, depth)),
k AS (SELECT p.depth, p.prefix, count(*) AS n_children FROM v JOIN v p ON v.depth = p.depth + 1 AND list_slice(v.prefix, 1, p.depth) = p.prefix GROUP BY p.depth, p.prefix),
w AS (SELECT v.depth, v.prefix, coalesce((v.n_convs - 1) * v.n, 0) AS own, k.depth IS NULL AS leaf FROM v LEFT JOIN k ON k.depth = v.depth AND k.prefix = v.prefix),
a AS (SELECT depth, list_slice(prefix, 1, depth) AS prefix, sum(own) AS saved_tokens, count(*) FILTER (leaf) AS n_leaves
      FROM (SELECT prefix, own, leaf, unnest(range(0, len(prefix) + 1)) AS depth FROM w) GROUP BY depth, list_slice(prefix, 1, depth))
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, coalesce(k.n_children, 0) AS n_children, a.n_leaves,
       CAST(a.saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM v JOIN a ON a.depth = v.depth AND a.prefix = v.prefix
LEFT JOIN k ON k.depth = v.depth AND k.prefix = v.prefix
LEFT JOIN v u ON u.depth = v.depth - 1 AND u.prefix = list_slice(v.prefix, 1, v.depth - 1)
"""

QUERIES = {
    "op1_language_id": (op1_language_id, None),
    "op2_substring_dedup": (op2_substring_dedup, OP2_SQL),
    "op3_toxicity": (op3_toxicity, None),
    "op4_top_k": (op4_top_k, OP4_SQL),
    "op5_simhash_dedup": (op5_simhash_dedup, None),
    "op6_url_filter": (op6_url_filter, OP6_SQL),
    "op7_sharding": (op7_sharding, None),
    "op8_bpe": (op8_bpe, None),
    "op9_exact_dedup": (op9_exact_dedup, OP9_SQL),
    "op10_packing": (op10_packing, None),
    "op11_merkle_manifest": (op11_merkle_manifest, OP11_SQL),
    "op12_pii": (op12_pii, None),
    "op13_prefix_trie": (op13_prefix_trie, OP13_SQL),
    "pipeline": (pipeline, None),
}
