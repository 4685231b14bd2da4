"""Queries over records: integration, reconciliation, similarity, clusters, outlines, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, cluster, outline, records
from ..sources import readers, writers
from .registry import query
from .tables import CARDS, DIM, SLUG, cards, dimension, split, table

_NEW = """new AS (
  SELECT * FROM cards WHERE NOT known AND trim(front) <> '' AND NOT regexp_matches(front, 'Ã¼|Ã¶|Ã¤|Ã©|Ã |â€™|â€œ|â€') AND norm_front NOT IN (SELECT norm_front FROM cards WHERE known)
  QUALIFY row_number() OVER (PARTITION BY norm_front ORDER BY pos) = 1)"""


@query(f"WITH {CARDS} SELECT pos, md5(norm_front) AS norm_md5 FROM cards QUALIFY row_number() OVER (PARTITION BY norm_front ORDER BY pos) = 1")
def norm_front_dedup(spark, d):
    rows = cards(spark, d).select("pos", T.normalize_text("front").alias("norm_front"))
    return records.first_by_text(rows, "norm_front").select("pos", F.md5("norm_front").alias("norm_md5"))


@query(f"WITH {CARDS}, {_NEW} SELECT pos, md5(norm_front) AS norm_md5 FROM new")
def integrate_anti_join(spark, d):
    old, new = split(spark, d)
    return records.novel(old, records.usable(new)).select("pos", F.md5("norm_front").alias("norm_md5"))


_ROUTED = """routed AS (
  SELECT new.pos, new.norm_front, CASE WHEN dim.key IS NULL THEN 'collection_99_Neue_Karten' ELSE new.collection END AS collection, new.category, coalesce(dim.ord, (SELECT max(ord) + 1 FROM dim)) AS ord
  FROM new LEFT JOIN dim ON new.collection = dim.key),
numbered AS (SELECT *, row_number() OVER (PARTITION BY collection, category ORDER BY pos) AS n FROM routed)"""


@query(f"WITH {CARDS}, {DIM}, {_NEW}, {_ROUTED} SELECT pos, collection, category, n, printf('%02d_%s_%02d_', ord, upper(substr(category, 1, 1)), n) || substr({SLUG.format('norm_front')}, 1, 50) AS sort_field FROM numbered")
def integrate_sort_keys(spark, d):
    old, new = split(spark, d)
    return records.integrate(old, new, dimension(spark, d), "collection_99_Neue_Karten").select("pos", "collection", "category", "n", "sort_field")


@query(f"WITH {CARDS}, {DIM}, {_NEW}, {_ROUTED}, before AS (SELECT collection, category, count(*) AS c FROM cards WHERE known GROUP BY ALL) SELECT pos, n + coalesce(c, 0) AS n FROM numbered LEFT JOIN before USING (collection, category)")
def integrate_going_on(spark, d):
    old, new = split(spark, d)
    return records.integrate(old, new, dimension(spark, d), "collection_99_Neue_Karten", go_on=True).select("pos", "n")


_CAP = "list_transform(string_split({0}, '_'), lambda p: upper(substr(p, 1, 1)) || lower(substr(p, 2)))"


@query(f"WITH {CARDS} SELECT collection, category, 'Deck::' || array_to_string({_CAP.format('collection')}, '_') || '::' || array_to_string({_CAP.format('category')}, '_') AS tag, count(*) AS n FROM cards GROUP BY collection, category")
def hierarchical_tags(spark, d):
    return cards(spark, d).groupBy("collection", "category").agg(F.count("*").alias("n")).withColumn("tag", T.tag_path("Deck", "collection", "category"))


@query(f"WITH {CARDS} SELECT DISTINCT collection, CAST(('0x' || substr(md5(collection), 1, 8)) AS BIGINT) % 2147483648 AS stable_id, array_to_string({_CAP.format('string_split(collection, chr(95))[3]')}, ' ') AS display_name FROM cards")
def stable_ids(spark, d):
    return cards(spark, d).select("collection").distinct().select("collection", T.stable_id("collection").alias("stable_id"), T.display_name("collection", 2).alias("display_name"))


@query(f"SELECT item_id, {SLUG.format(chr(39).join(['lower(trim(regexp_replace(text, ', chr(92) + 's+', ', ', ' ', ', ', 'g', ')))']))} AS slug FROM benchmark")
def key_slugs(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.key_slug("text").alias("slug"))


_SIDES = f"""WITH {CARDS},
c AS (SELECT norm_front, min(pos) AS c_pos, list_sort(list(DISTINCT back)) AS choices FROM cards GROUP BY norm_front),
s AS (SELECT lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS norm_front, min(item_id) AS s_pos, arg_max('b_bench_' || item_id, item_id) AS category FROM benchmark GROUP BY 1
  UNION ALL SELECT norm_front, min(pos), arg_max(category, pos) FROM cards WHERE known GROUP BY 1),
j AS (SELECT coalesce(c.norm_front, s.norm_front) AS norm_front, c_pos, s_pos, category, choices,
  CASE WHEN s.norm_front IS NULL THEN 'orphan' WHEN c.norm_front IS NULL THEN 'missing' WHEN len(choices) > 1 THEN 'conflict' ELSE 'matched' END AS state
  FROM c FULL JOIN s ON c.norm_front = s.norm_front)"""


def _sides(spark, d):
    old, _ = split(spark, d)
    bench = table(spark, d, "benchmark").select(F.col("item_id").alias("pos"), F.col("text").alias("front"), F.lit("collection_0_bench").alias("collection"), F.concat(F.lit("b_bench_"), F.col("item_id").cast("string")).alias("category"), F.lit("00_B_01").alias("sort_key"))
    return cards(spark, d), bench.unionByName(old.select("pos", "front", "collection", "category", F.lit("01_A_01").alias("sort_key")))


@query(_SIDES + " SELECT md5(norm_front) AS norm_md5, coalesce(c_pos, -1) AS c_pos, coalesce(s_pos, -1) AS s_pos, category, CASE WHEN state = 'missing' THEN 'TODO' ELSE choices[1] END AS back, state, CASE state WHEN 'orphan' THEN 'rescued' WHEN 'missing' THEN 'todo' ELSE 'kept' END AS outcome FROM j")
def reconcile_outer(spark, d):
    return records.reconcile(*_sides(spark, d)).select(F.md5("norm_front").alias("norm_md5"), F.coalesce("c_pos", F.lit(-1)).alias("c_pos"), F.coalesce("s_pos", F.lit(-1)).alias("s_pos"), "category", "back", "state", "outcome")


@query(_SIDES + " SELECT c_pos, row_number() OVER (ORDER BY c_pos) AS n, printf('21_A_%02d', row_number() OVER (ORDER BY c_pos)) AS sort_key FROM j WHERE state = 'orphan'")
def rescue_orphans(spark, d):
    orphans = records.reconcile(*_sides(spark, d)).filter("outcome = 'rescued'")
    return records.rescue(orphans, 21, "Orphan").select("c_pos", F.substring("sort_key", 6, 9).cast("long").alias("n"), "sort_key")


@query(f"WITH {CARDS} SELECT md5(norm_front) AS norm_md5, count(*) AS n, count(DISTINCT back) AS choices, min(back) AS first_choice FROM cards GROUP BY norm_front HAVING count(DISTINCT back) > 1")
def back_conflicts(spark, d):
    one = records.by_front(cards(spark, d)).filter(F.size("choices") > 1)
    return one.select(F.md5("norm_front").alias("norm_md5"), F.size("backs").cast("long").alias("n"), F.size("choices").cast("long").alias("choices"), F.element_at("choices", 1).alias("first_choice"))


@query(f"WITH {CARDS} SELECT CAST(coalesce(max(TRY_CAST(split_part(collection, '_', 2) AS INTEGER)), -1) + 1 AS BIGINT) AS next_number FROM cards")
def next_collection_number(spark, d):
    return records.next_number(cards(spark, d))


@query(_SIDES + ", st AS (SELECT norm_front, category FROM s QUALIFY row_number() OVER (PARTITION BY norm_front ORDER BY 1) = 1) SELECT cards.pos, coalesce(st.category, cards.category) AS category, st.norm_front IS NOT NULL AS synced FROM cards LEFT JOIN st ON cards.norm_front = st.norm_front")
def sync_outline(spark, d):
    return records.sync_structure(*_sides(spark, d)).select("pos", "category", "synced")


@query(_SIDES + " SELECT md5(norm_front) AS norm_md5, count(*) AS n FROM (SELECT lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS norm_front FROM benchmark) WHERE norm_front NOT IN (SELECT norm_front FROM cards) GROUP BY 1")
def outline_without_cards(spark, d):
    return records.structure_without_cards(*_sides(spark, d)).groupBy(F.md5("norm_front").alias("norm_md5")).agg(F.count("*").alias("n"))


@query("""WITH per AS (SELECT CASE WHEN doc_id < 2 THEN 'rare' ELSE source END AS collection, count(*) AS n FROM documents GROUP BY 1),
  m AS (SELECT list_sort(list(n))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS median, sum(n) AS total, count(*) AS groups FROM per)
  SELECT collection, n, median, greatest(3, CAST(floor(median * 15 / 100) AS BIGINT)) AS threshold FROM per, m WHERE total > 20 AND groups >= 2 AND n < greatest(3, floor(median * 15 / 100))""")
def balance_warnings(spark, d):
    return audit.balance_warnings(table(spark, d, "documents").select(F.when(F.col("doc_id") < 2, "rare").otherwise(F.col("source")).alias("collection")))


@query("SELECT source AS collection, count(*) AS n, min(CASE WHEN CAST(substr(source, 4) AS INTEGER) < 5 THEN 'x' ELSE lang END) AS category FROM documents GROUP BY 1 HAVING count(*) >= 5 AND count(DISTINCT CASE WHEN CAST(substr(source, 4) AS INTEGER) < 5 THEN 'x' ELSE lang END) = 1")
def category_collapse(spark, d):
    category = F.when(F.substring("source", 4, 9).cast("int") < 5, "x").otherwise(F.col("lang"))
    return audit.category_collapse(table(spark, d, "documents").select(F.col("source").alias("collection"), category.alias("category")))


@query("SELECT md5(text) AS digest, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return audit.duplicate_keys(table(spark, d, "documents").select(F.md5("text").alias("digest")), "digest")


@query(r"""WITH t AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS w, doc_id IN (SELECT doc_id FROM labels) AS known FROM documents),
  s AS (SELECT * FROM t WHERE w <> ''), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  p AS (SELECT a.doc_id AS left_id, b.doc_id AS right_id, count(*) AS inter FROM s a JOIN s b ON a.w = b.w AND a.known AND NOT b.known GROUP BY 1, 2)
  SELECT left_id, right_id, inter, l.n + r.n - inter AS uni FROM p JOIN n l ON left_id = l.doc_id JOIN n r ON right_id = r.doc_id WHERE inter > 0.3 * (l.n + r.n - inter)""")
def jaccard_pairs(spark, d):
    old, new = split(spark, d)
    name = lambda df: df.select(F.col("pos").alias("id"), F.col("front").alias("text"))
    return cluster.similarity_join(name(old), name(new), 0.3)


_PAIRS = f"""WITH RECURSIVE {CARDS},
keys AS (SELECT pos, md5(front) AS k1, md5(norm_front) AS k2, md5(lower(split_part(front, chr(10), 1))) AS k3 FROM cards),
g AS (SELECT pos AS j, unnest([min(pos) OVER (PARTITION BY k1), min(pos) OVER (PARTITION BY k2), min(pos) OVER (PARTITION BY k3), min(pos) OVER (PARTITION BY k1, k2),
  min(pos) OVER (PARTITION BY k1, k3), min(pos) OVER (PARTITION BY k2, k3), min(pos) OVER (PARTITION BY k1, k2, k3)]) AS i FROM keys),
v AS (SELECT DISTINCT i, j, CAST(CAST(a.k1 = b.k1 AS INTEGER) + CAST(a.k2 = b.k2 AS INTEGER) + CAST(a.k3 = b.k3 AS INTEGER) AS BIGINT) AS n FROM g JOIN keys a ON a.pos = i JOIN keys b ON b.pos = j WHERE i < j),
verdicts AS (SELECT i, j, n, CASE WHEN n >= 3 THEN 'HIGH' WHEN n >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM v),
strong AS (SELECT i, j FROM verdicts WHERE confidence <> 'LOW'),
both_ways AS (SELECT i AS a, j AS b FROM strong UNION SELECT j, i FROM strong),
reach(node, other) AS (SELECT a, a FROM both_ways UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a),
comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
conf AS (SELECT a.component, max(CASE confidence WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END) AS worst FROM verdicts JOIN comp a ON i = a.node JOIN comp b ON j = b.node WHERE a.component = b.component GROUP BY 1),
cl AS (SELECT component, worst FROM conf WHERE worst < 2)"""


def _verdicts(spark, d):
    """Three passes: equal texts, equal normal forms, equal first lines."""
    keys = {"k1": F.md5("front"), "k2": F.md5(T.normalize_text("front")), "k3": F.md5(F.lower(F.substring_index("front", "\n", 1)))}
    return cluster.key_votes(cards(spark, d).select("pos", *(k.alias(n) for n, k in keys.items())), list(keys))


@query(_PAIRS + " SELECT i, j, n, confidence FROM verdicts")
def pair_votes(spark, d):
    return _verdicts(spark, d)


@query(_PAIRS + " SELECT node, component FROM comp")
def dup_components(spark, d):
    return cluster.components(_verdicts(spark, d).filter("confidence <> 'LOW'"))


@query(_PAIRS + " SELECT component, CASE worst WHEN 0 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence, array_to_string(list_sort((SELECT list(node) FROM comp WHERE comp.component = cl.component)), ',') AS members FROM cl")
def cluster_confidence(spark, d):
    return cluster.clusters(_verdicts(spark, d)).withColumn("members", F.array_join(F.transform("members", lambda x: x.cast("string")), ","))


def _roles(spark, d, action):
    acts = cluster.clusters(_verdicts(spark, d)).withColumn("action", F.lit(action))
    people = cards(spark, d).withColumn("node", F.col("pos"))
    return cluster.kept_and_gone(acts, people)


@query(_PAIRS + " SELECT component, node, CASE WHEN node = min(node) OVER (PARTITION BY component) THEN 'kept' ELSE 'gone' END AS role FROM comp WHERE component IN (SELECT component FROM cl)")
def keep_oldest(spark, d):
    return _roles(spark, d, "keep_oldest").select("component", "node", "role")


@query(_PAIRS + " SELECT component, node, CASE WHEN node = max(node) OVER (PARTITION BY component) THEN 'kept' ELSE 'gone' END AS role FROM comp WHERE component IN (SELECT component FROM cl)")
def keep_newest(spark, d):
    return _roles(spark, d, "keep_newest").select("component", "node", "role")


@query(_PAIRS + " SELECT pos FROM cards WHERE pos NOT IN (SELECT node FROM comp WHERE component IN (SELECT component FROM cl) AND node <> component)")
def apply_deletes(spark, d):
    return records.delete_by(cards(spark, d), _roles(spark, d, "keep_oldest").filter("role = 'gone'")).select("pos")


@query(_PAIRS + " SELECT CASE worst WHEN 0 THEN 'keep_oldest' ELSE 'skip' END AS action, count(*) AS n FROM cl GROUP BY 1")
def resolve_actions(spark, d):
    return cluster.action_counts(cluster.resolve(cluster.clusters(_verdicts(spark, d)), "hybrid"))


@query(_PAIRS + " SELECT component, CAST(component AS VARCHAR) AS guid, count(*) AS asked, arg_min(back, node) AS back FROM comp JOIN cards ON node = pos WHERE component IN (SELECT component FROM cl) GROUP BY component")
def merge_backs(spark, d):
    members = cluster.clusters(_verdicts(spark, d)).select("component", F.explode("members").alias("pos")).join(cards(spark, d), "pos")
    return cluster.merge_backs(members).select("component", "guid", F.size("asked").cast("long").alias("asked"), "back")


@query("SELECT conv_id AS doc, 'page_' || turn AS image, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS ord, md5(regexp_replace(text, '\\s+$', '')) AS body FROM conversations")
def section_parse(spark, d):
    pages = table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.concat(F.lit("page_"), F.col("turn").cast("string")).alias("image"), F.col("text").alias("body"))
    found = outline.sections(outline.lines_of(outline.write_sections(pages)))
    return found.select("doc", "image", "ord", F.md5("body").alias("body"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS current FROM events")
def carry_forward(spark, d):
    ev = table(spark, d, "events")
    return outline.carry_forward(ev, F.when(F.col("event_type") == "purchase", F.col("value")), "user_id", "event_id").select("event_id", "current")


@query("""WITH k AS (SELECT DISTINCT 'collection_' || substr(source, 4) || '_docs' AS key FROM documents UNION SELECT DISTINCT lang FROM documents)
  SELECT key, row_number() OVER (ORDER BY TRY_CAST(split_part(key, '_', 2) AS INTEGER) IS NULL, coalesce(TRY_CAST(split_part(key, '_', 2) AS INTEGER), 0), key) AS rank FROM k""")
def collection_order(spark, d):
    from pyspark.sql import Window

    keys = cards(spark, d).select(F.col("collection").alias("key")).union(table(spark, d, "documents").select("lang")).distinct()
    return keys.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*outline.collection_order(F.col("key")))).cast("long"))


@query("""WITH per AS (SELECT source AS directory, max(n_chars) AS size, arg_max(doc_id, n_chars * 1000000000 - doc_id) AS path FROM documents GROUP BY 1)
  SELECT directory, path, size, path = (SELECT arg_max(path, size * 1000000000 - path) FROM per) AS is_largest FROM per""")
def max_per_group(spark, d):
    files = table(spark, d, "documents").select(F.col("source").alias("directory"), F.col("doc_id").alias("path"), F.col("n_chars").alias("size"), F.col("doc_id").alias("pos"))
    return audit.largest_files(files)


@query("SELECT source AS doc, sha256(string_agg(doc_id || '|' || coalesce(CAST(n_chars AS VARCHAR) || '|' || doc_id, 'missing'), '' ORDER BY CAST(doc_id AS VARCHAR))) AS fingerprint FROM documents GROUP BY source")
def fingerprint(spark, d):
    files = table(spark, d, "documents").select(F.col("source").alias("doc"), F.col("doc_id").cast("string").alias("name"), F.col("n_chars").alias("size"), F.col("doc_id").alias("mtime"))
    return audit.fingerprint(files)


@query("SELECT 'f' || doc_id || '.txt' AS filename, CASE WHEN quality IS NULL THEN 'missing' WHEN quality = 0 THEN 'differs' ELSE 'same' END AS status FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'p' || page_id, 'extra' FROM pages")
def file_diff(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), F.col("text").alias("content"))
    live = docs.join(table(spark, d, "labels"), "doc_id").select("filename", F.when(F.col("quality") == 0, F.concat("content", F.lit("!"))).otherwise(F.replace("content", F.lit("\n"), F.lit("\r\n"))).alias("content"))
    pages = table(spark, d, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("filename"), F.col("html").alias("content"))
    return audit.compare_files(docs.select("filename", "content"), live.unionByName(pages))


@query(f"WITH {CARDS}, {DIM} SELECT key AS collection, 'missing' AS side FROM dim WHERE key NOT IN (SELECT collection FROM cards WHERE known) UNION ALL SELECT DISTINCT collection, 'extra' FROM cards WHERE known AND collection NOT IN (SELECT key FROM dim)")
def one_sided_keys(spark, d):
    old, _ = split(spark, d)
    return audit.one_sided(dimension(spark, d).select(F.col("key").alias("collection")), old, "collection")


@query(f"""WITH {CARDS} SELECT * FROM (VALUES ('marker_parity', false, 1), ('count_consistency', false, 1)) t("check", passed, bad)
  UNION ALL SELECT 'file_names', count(*) = 0, count(*) FROM (SELECT DISTINCT collection FROM cards WHERE CAST(split_part(collection, '_', 2) AS INTEGER) >= 10)
  UNION ALL SELECT 'required_fields', count(*) = 0, count(*) FROM cards WHERE trim(front) = '' OR trim(back) = ''
  UNION ALL SELECT 'hierarchy', true, 0
  UNION ALL SELECT 'unique_guid', count(*) = 0, count(*) FROM (SELECT guid FROM cards GROUP BY guid HAVING count(*) > 1)""")
def post_checks(spark, d):
    c, dim = cards(spark, d), dimension(spark, d)
    files = writers.collection_files(c, dim).groupBy("filename").agg((F.count("*") + 1).alias("rows"))  # one row too many a file
    lines = outline.outline_lines(c, dim).select("line").unionByName(spark.range(1).select(F.lit("<!-- COLLECTION_99_START -->").alias("line")))
    broken = lines.withColumn("doc", F.lit("index"))
    return audit.post_checks(c, files, dim, broken)


@query(f"WITH {CARDS} SELECT collection, category, row_number() OVER (PARTITION BY collection, category ORDER BY pos) - 1 AS ord, md5(front) AS front FROM cards")
def nested_candidates(spark, d):
    nested = records.nest(cards(spark, d)).select(F.to_json(F.struct(F.map_from_entries(F.array(F.struct("collection", "categories"))).alias("generated_cards"))).alias("value"), F.col("collection").alias("file"))
    return readers.candidates(nested).select("collection", "category", F.col("pos").alias("ord"), F.md5("front").alias("front"))


@query(f"WITH {CARDS}, {DIM} SELECT coalesce(dim.key || '.json', collection || '.json') AS filename, count(*) AS n, md5(string_agg(guid, ',' ORDER BY guid)) AS guids FROM cards LEFT JOIN dim ON collection = key GROUP BY 1")
def collection_files(spark, d):
    rows = writers.collection_files(cards(spark, d), dimension(spark, d))
    return rows.groupBy("filename").agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("guid")), ",")).alias("guids"))


@query(f"WITH {CARDS}, o AS (SELECT category, min(collection) AS near FROM cards WHERE known GROUP BY 1) SELECT c.collection, c.category, coalesce(e.collection, '-') AS exact FROM (SELECT DISTINCT collection, category FROM cards) c LEFT JOIN (SELECT DISTINCT collection, category FROM cards WHERE known) e USING (collection, category)")
def category_sets(spark, d):
    old, _ = split(spark, d)
    have = old.groupBy("collection").agg(F.collect_set("category").alias("set"))
    rows = cards(spark, d).select("collection", "category").distinct().join(have, "collection", "left")
    return rows.select("collection", "category", F.when(F.array_contains("set", F.col("category")), F.col("collection")).otherwise("-").alias("exact"))


@query("""WITH w AS (SELECT DISTINCT 'collection_' || substr(source, 4) || '_' || lang AS key FROM documents), t AS (SELECT DISTINCT 'collection_' || substr(source, 4) || '_' || lang AS key, source, lang FROM documents WHERE lang = 'en')
  SELECT w.key, coalesce(e.key, n.near) AS match FROM w LEFT JOIN t e ON w.key = e.key LEFT JOIN (SELECT split_part(key, '_', 2) AS k, min(key) AS near FROM t GROUP BY 1) n ON split_part(w.key, '_', 2) = n.k""")
def two_tier_match(spark, d):
    key = F.concat(F.lit("collection_"), F.substring("source", 4, 100), F.lit("_"), F.col("lang")).alias("key")
    docs = table(spark, d, "documents")
    template = docs.filter("lang = 'en'").select(key).distinct().withColumn("ord", F.col("key"))
    return records.two_tier(docs.select(key).distinct(), template, "key", F.element_at(F.split("_key", "_"), 2)).select("key", "match")


@query("""WITH u AS (SELECT conv_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS w, role FROM conversations),
  a AS (SELECT conv_id, w, count(*) AS n FROM u WHERE role = 'user' AND w <> '' GROUP BY ALL), b AS (SELECT conv_id, w, count(*) AS m FROM u WHERE role = 'assistant' AND w <> '' GROUP BY ALL)
  SELECT conv_id, round(sum(least(n, coalesce(m, 0))) / sum(n), 9) AS recall FROM a LEFT JOIN b USING (conv_id, w) GROUP BY conv_id""")
def recall_of_turns(spark, d):
    tokens = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: x != "")
    rows = table(spark, d, "conversations").select("conv_id", "role", tokens.alias("tokens"))
    out = cluster.multiset_recall(rows.filter("role = 'user'"), rows.filter("role = 'assistant'"), "conv_id")
    return out.select("conv_id", F.round("recall", 9).alias("recall"))


@query("SELECT item_id, CAST(length(text) AS BIGINT) AS chars, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview, string_split(text, chr(10))[1] || CASE WHEN len(string_split(text, chr(10))) > 1 THEN chr(10) || '... (' || (len(string_split(text, chr(10))) - 1) || ' more lines)' ELSE '' END AS excerpt FROM benchmark")
def excerpts(spark, d):
    return readers.excerpt(table(spark, d, "benchmark"), 1).select("item_id", F.length("text").cast("long").alias("chars"), T.preview("text").alias("preview"), "excerpt")


@query("SELECT md5(string_agg('=== ' || item_id || ' ===' || chr(10) || text, chr(10) || chr(10) ORDER BY CAST(item_id AS VARCHAR))) AS digest FROM benchmark")
def joined_sources(spark, d):
    texts = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("file"), "text")
    return readers.joined_texts(texts).select(F.md5("text").alias("digest"))


@query(f"""WITH {CARDS}, {DIM}, c AS (SELECT *, CAST(split_part(collection, '_', 2) AS INTEGER) AS src, trim(regexp_replace(front, '\\s+', ' ', 'g')) AS line FROM cards),
  k AS (SELECT collection, row_number() OVER (ORDER BY src, collection) - 1 AS i, src FROM (SELECT DISTINCT collection, src FROM c))
  SELECT CAST(i AS INTEGER) AS collection_no, CASE WHEN dim.ord IS NULL THEN 'Docs' ELSE 'Docs ' || dim.ord END AS title, category, CAST(n AS INTEGER) AS number, md5(line) AS front, printf('%02d_%s_%02d', i, upper(substr(category, 1, 1)), n) AS sort_key
  FROM (SELECT *, row_number() OVER (PARTITION BY collection, category ORDER BY pos) AS n FROM c) c JOIN k USING (collection) LEFT JOIN dim ON dim.key = collection WHERE line <> ''""")
def outline_round_trip(spark, d):
    c = cards(spark, d).withColumn("front", F.trim(F.regexp_replace("front", "\\s+", " ")))
    lines = outline.outline_lines(c, dimension(spark, d)).withColumn("doc", F.lit("index"))
    return outline.read_outline_lines(lines).select("collection_no", "title", "category", "number", F.md5("front").alias("front"), "sort_key")
