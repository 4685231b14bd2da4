"""The queries of this package for the driver, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, chosen_path, decontaminate, html_layout, mixing, prefix_trie, quality, simhash, substring, topk, toxicity, url_rules, whitening
from .common import table

URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said)
    return chat.digests(chat.format_chats(chats.unionByName(more)))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score_quality(docs).select("doc_id", "weak_label", "score", "predicted")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_layout.page_texts(table(spark, sf_dir, "pages"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.filter("vec_id % 100 = 0"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.repeated_windows(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors)
    if model is None:
        return spark.createDataFrame([], "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    share = F.array(*(F.lit(float(e / model.trace) if model.trace else 0.0) for e in model.values[:8]))
    rows = whitening.whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        F.col("deviation").cast("long").alias("deviation"),
        "whitened",
        F.element_at(share, F.col("at") + 1).alias("explained"),
        F.lit(model.identity_error).cast("double").alias("identity_error"),
    )


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=2)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.ordered(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(prefix_trie.grafted(turns), turns.filter("place = 0").select("conv_id"), ("own", "place"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_chat, op3_quality, op4_html_text, op5_url_filter, op6_toxicity, op7_top_k, op8_substring_dedup, op9_simhash, op10_decontaminate, op11_whitening, op12_minhash, op13_prefix_trie)}

_OP2 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
    count(*) OVER (PARTITION BY conv_id) AS all_n,
    23 + length(regexp_replace(replace(role, '\', '\\'), '([<\[])(\|turn\|>|\|text\|>|\|end\|>|s>|/s>|INST\]|/INST\])', '\1\\\2', 'g'))
       + length(regexp_replace(replace(text, '\', '\\'), '([<\[])(\|turn\|>|\|text\|>|\|end\|>|s>|/s>|INST\]|/INST\])', '\1\\\2', 'g')) AS chars
  FROM turns),
summed AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY n) AS upto FROM marked)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR n = all_n) AS BIGINT) AS formatted_chars
FROM summed GROUP BY conv_id
"""

_OP5 = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(rule_host, rule_path, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
best AS (
  SELECT page_id, host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(v, length(rule_host || rule_path)) AS v
  FROM split LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id, host, path)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM best
"""

_OP7 = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.r <> q.r),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

_OP8 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
starts AS (
  SELECT r, i, string_agg(word, ' ') OVER next AS k, count(*) OVER next AS n FROM words
  WINDOW next AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
repeated AS (SELECT k FROM starts WHERE n = 35 GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM starts WHERE n = 35 AND k IN (SELECT k FROM repeated)),
marked AS (
  SELECT r, count(gone.i) AS n_removed, string_agg(word, ' ' ORDER BY words.i) FILTER (gone.i IS NULL) AS kept
  FROM words LEFT JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN marked USING (r)
"""

_OP12 = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT r, doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM d),
kinds AS (SELECT min(r) AS k, s FROM (SELECT r, list_sort(s) AS s FROM sets WHERE len(s) > 0) GROUP BY s),
each AS (SELECT k, len(s) AS n, unnest(s) AS x FROM kinds),
alike AS (SELECT a.k AS i, b.k AS j, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM each a JOIN each b ON a.x = b.x AND a.k < b.k AND a.n * 5 >= b.n * 4 AND b.n * 5 >= a.n * 4 GROUP BY 1, 2),
links AS (SELECT i, j FROM alike WHERE 100 * c >= 80 * (n + m - c)),
ways AS (SELECT i, j FROM links UNION ALL SELECT j, i FROM links),
reached AS (SELECT k, k AS to_k FROM kinds UNION SELECT reached.k, ways.j FROM reached JOIN ways ON reached.to_k = ways.i),
roots AS (SELECT k, min(to_k) AS root FROM reached GROUP BY k),
class AS (SELECT r, doc_id, s, root FROM (SELECT r, doc_id, list_sort(s) AS s FROM sets) JOIN kinds USING (s) JOIN roots USING (k)),
least AS (SELECT root, min(doc_id) AS component_id FROM class GROUP BY root)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM class JOIN least USING (root)
UNION ALL SELECT doc_id, 0, doc_id, true FROM sets WHERE len(s) = 0
"""

_OP13 = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, list_reduce([4294967295] || flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [ord(x), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda c, x: CASE WHEN x >= 0 THEN xor(CAST(c AS BIGINT), CAST(x AS BIGINT)) WHEN c & 1 = 1 THEN xor(CAST(c AS BIGINT) >> 1, 3988292384) ELSE CAST(c AS BIGINT) >> 1 END) AS c
  FROM (SELECT DISTINCT conv_id FROM turns)),
heads AS (SELECT conv_id, xor(c, 4294967295) % 6 AS h FROM convs),
rebuilt AS (
  SELECT heads.conv_id, 0 AS own, place, role, text FROM heads JOIN turns ON turns.conv_id = heads.conv_id - heads.conv_id % 100 AND place < h
  UNION ALL SELECT conv_id, 1, place, role, text FROM turns JOIN heads USING (conv_id) WHERE place >= h),
deep AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, place) AS depth, role, text FROM rebuilt),
prefixes AS (
  SELECT conv_id, depth, length(text) AS chars, sha256(string_agg(sha256(role) || sha256(text), '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth)) AS k FROM deep
  UNION ALL SELECT conv_id, 0, 0, '' FROM heads),
nodes AS (SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n, any_value(chars) AS chars FROM prefixes GROUP BY depth, k),
way AS (SELECT p.conv_id AS m, n.* FROM prefixes p JOIN nodes n USING (depth, k)),
tree AS (
  SELECT c.*, p.conv_id AS parent FROM nodes c LEFT JOIN way p ON p.m = c.conv_id AND p.depth = c.depth - 1),
kids AS (SELECT parent AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM tree WHERE depth > 0 GROUP BY 1, 2),
own AS (SELECT t.*, coalesce(n_children, 0) AS n_children FROM tree t LEFT JOIN kids USING (conv_id, depth)),
sums AS (
  SELECT up.conv_id, up.depth, count(*) FILTER (o.n_children = 0) AS n_leaves, sum((o.n - 1) * o.chars) AS saved
  FROM own o JOIN way up ON up.m = o.conv_id AND up.depth <= o.depth GROUP BY 1, 2),
last AS (SELECT conv_id AS m, max(depth) AS depth FROM prefixes GROUP BY 1),
ends AS (
  SELECT way.conv_id, way.depth, sha256(string_agg(CAST(m AS VARCHAR), ',' ORDER BY m)) AS ends_sha256 FROM last JOIN way USING (m, depth) GROUP BY 1, 2)
SELECT conv_id, depth, parent AS parent_conv_id, n AS n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM own JOIN sums USING (conv_id, depth) LEFT JOIN ends USING (conv_id, depth)
"""

ORACLE_SQL = {"op2_chat": _OP2, "op5_url_filter": _OP5, "op7_top_k": _OP7, "op8_substring_dedup": _OP8, "op12_minhash": _OP12, "op13_prefix_trie": _OP13}
