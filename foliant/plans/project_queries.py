"""Queries over projects and calls: retries, costs, where documents stand, files, materials, configurations, codes of categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, calls, cluster, outline, projects, records, runs
from ..sources import readers, writers
from .registry import query
from .tables import CARDS, cards, dimension, split, table

# ---- calls -------------------------------------------------------------------------------------------------------------------------------------------

_TRIES = """WITH t AS (SELECT user_id AS request_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt,
    CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 429 WHEN 2 THEN 500 WHEN 3 THEN 400 WHEN 4 THEN 503 WHEN 5 THEN 520 ELSE 200 END AS code FROM events),
  v AS (SELECT *, CASE WHEN code IS NULL OR code < 400 THEN 'ok' WHEN code IN ({codes}) AND attempt < 3 THEN 'retry' ELSE 'failed' END AS verdict FROM t),
  o AS (SELECT *, coalesce(max(CASE WHEN verdict <> 'retry' THEN 1 ELSE 0 END) OVER (PARTITION BY request_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM v),
  made AS (SELECT request_id, attempt, code, verdict, CASE WHEN verdict = 'retry' THEN CASE attempt WHEN 1 THEN {first} ELSE {second} END END AS delay FROM o WHERE over = 0)"""


def _tries(spark, d):
    from pyspark.sql import Window

    code = F.element_at(F.array(*(F.lit(x).cast("int") for x in (None, 429, 500, 400, 503, 520, 200))), (F.col("event_id") % 7 + 1).cast("int"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, d, "events").select(F.col("user_id").alias("request_id"), place.alias("attempt"), code.alias("code"))


@query(_TRIES.format(codes="429, 500, 502, 503", first="2.0", second="8.0") + " SELECT request_id, CAST(attempt AS INTEGER) AS attempt, CAST(code AS INTEGER) AS code, verdict, CAST(delay AS DOUBLE) AS delay FROM made")
def retry_schedule(spark, d):
    return calls.retry_schedule(_tries(spark, d), jitter=0.0)


@query(_TRIES.format(codes="429, 500, 502, 503, 520, 524", first="3.0", second="6.0") + " SELECT request_id, CASE arg_max(verdict, attempt) WHEN 'retry' THEN 'open' ELSE arg_max(verdict, attempt) END AS outcome, count(*) AS tries, CAST(coalesce(sum(delay), 0) AS DOUBLE) AS waited FROM made GROUP BY 1")
def request_outcomes(spark, d):
    return calls.request_outcomes(calls.retry_schedule(_tries(spark, d), calls.BENCH_TRANSIENT, calls.BENCH_DELAYS, 0.0))


@query("""SELECT o_custkey AS run_id, round(CAST(sum(CAST(o_totalprice AS DECIMAL(20, 10))) AS DOUBLE), 2) AS cost, count(*) AS calls FROM orders GROUP BY 1""")
def cost_lines(spark, d):
    error = F.when(F.col("o_orderstatus") == "F", "failed")
    phases = table(spark, d, "orders").select(F.col("o_custkey").alias("run_id"), F.array(F.struct(F.col("o_totalprice").alias("cost"), error.alias("error"))).alias("llm_calls"))
    return calls.cost_lines(phases).select("run_id", F.round("cost", 2).alias("cost"), "calls")


@query("""WITH p AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS phase FROM events)
  SELECT user_id AS session, CAST(phase AS BIGINT) AS phase, count(*) AS responses FROM p WHERE event_type <> 'signup' GROUP BY ALL""")
def phase_responses(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("pos"), "event_type")
    return calls.by_phase(log, F.col("event_type") == "signup").filter("event_type <> 'signup'").groupBy("session", "phase").agg(F.count("*").alias("responses"))


@query("SELECT DISTINCT substr(p_name, 1, length(p_name) - 1) AS model, p_name AS suggested FROM part WHERE p_partkey % 4 = 0")
def unknown_models(spark, d):
    """Models configured by the names of parts, some of which lack their last letter: those aren't in the catalogue, and the whole name is the closest that is."""
    part = table(spark, d, "part")
    short = F.substring(F.col("p_name"), F.lit(1), F.length("p_name") - 1)
    asked = part.select(F.when(F.col("p_partkey") % 4 == 0, short).otherwise(F.col("p_name")).alias("model"))
    found = calls.unknown_models(asked, part.select(F.col("p_name").alias("model")), most=1)
    return found.select("model", F.element_at("suggestions", 1).alias("suggested"))


@query("""SELECT c_custkey AS trial, CASE WHEN c_acctbal >= c_nationkey * 400 THEN 'good' ELSE 'bad' END AS picked, CASE WHEN length(c_name) > length(c_mktsegment) * 2 THEN 'good' ELSE 'bad' END AS longer,
  CAST(least(c_nationkey, greatest(1, floor(c_custkey % 16 * 0.6))) AS INTEGER) AS workers, CAST(least(20, greatest(5, c_nationkey * greatest(1, c_custkey % 4))) AS INTEGER) AS pool FROM customer""")
def picks_and_sizes(spark, d):
    c = table(spark, d, "customer")
    return c.select(
        F.col("c_custkey").alias("trial"),
        calls.picked(F.col("c_acctbal"), F.col("c_nationkey") * 400).alias("picked"),
        calls.longer(F.col("c_name"), F.repeat("c_mktsegment", F.lit(2))).alias("longer"),
        calls.workers(F.col("c_nationkey"), F.col("c_custkey") % 16).alias("workers"),
        calls.call_pool(F.col("c_nationkey"), F.col("c_custkey") % 4).alias("pool"),
    )


# ---- where documents stand ---------------------------------------------------------------------------------------------------------------------------

_STATUS = """WITH s AS (SELECT 'in/' || source || '/' || doc_id || '.pdf' AS path, source, doc_id, n_chars,
    CASE WHEN doc_id NOT IN (SELECT doc_id FROM labels) THEN 'pending' WHEN doc_id % 3 <> 0 OR lang = 'en' THEN 'done' WHEN lang = 'fr' THEN 'paused' ELSE 'running' END AS ocr FROM documents)"""


def _documents(spark, d):
    """Documents, the texts of the labelled ones, and states of every third one: completed, paused, unreadable or without a status, by language."""
    path = F.concat(F.lit("in/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    docs = table(spark, d, "documents").withColumn("path", path)
    text = docs.join(table(spark, d, "labels"), "doc_id").withColumn("path", F.replace("path", F.lit(".pdf"), F.lit(".txt")))
    value = F.when(F.col("lang") == "en", '{"run_status": "completed"}').when(F.col("lang") == "fr", '{"run_status": "paused"}').when(F.col("lang") == "de", "{").otherwise('{"pages": 1}')
    states = text.filter("doc_id % 3 = 0").select(F.concat("path", F.lit(".ocr_state.json")).alias("path"), value.alias("value"))
    return docs.select("path"), text.select("path"), states


def _status(spark, d):
    docs, texts, states = _documents(spark, d)
    return projects.document_status(docs, texts, projects.run_states(states))


@query(_STATUS + " SELECT path, ocr FROM s")
def document_status(spark, d):
    return _status(spark, d)


@query(_STATUS + " SELECT path, 'ocr' AS stage FROM s WHERE ocr = 'pending' UNION ALL SELECT replace(path, '.pdf', '.txt'), 'ingest' FROM s WHERE ocr = 'done'")
def pending_stages(spark, d):
    _, texts, _ = _documents(spark, d)
    status = _status(spark, d)
    todo, ready = projects.to_do(status), projects.ready_texts(status, texts)
    return todo.select("path", F.lit("ocr").alias("stage")).unionByName(ready.select("path", F.lit("ingest").alias("stage")))


@query("""SELECT source AS project, CASE WHEN max(CASE WHEN labels.doc_id IS NOT NULL THEN 1 ELSE 0 END) = 1 THEN 'done' ELSE 'pending' END AS ingest,
  CASE WHEN max(CASE WHEN lang = 'fr' AND n_chars > 2000 THEN 1 ELSE 0 END) = 1 THEN 'done' ELSE 'pending' END AS export FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def project_flags(spark, d):
    docs = table(spark, d, "documents").withColumn("project", F.col("source"))
    return projects.project_flags(docs.select("project").distinct(), docs.join(table(spark, d, "labels"), "doc_id"), docs.filter("lang = 'fr' and n_chars > 2000"))


@query("SELECT event_id, 'p' || user_id || '.txt.ocr_state_' || strftime(ts, '%Y%m%d_%H%M%S_%f') || '.json' AS name FROM events")
def archived_names(spark, d):
    path = F.concat(F.lit("/a/b.c/p"), F.col("user_id").cast("string"), F.lit(".txt.ocr_state.json"))
    return table(spark, d, "events").select("event_id", projects.archived_name(path, F.col("ts")).alias("name"))


@query("""WITH s AS (SELECT o_custkey AS doc, CASE o_orderstatus WHEN 'F' THEN 'live' WHEN 'O' THEN 'archived' ELSE 'legacy' END AS kind, CASE WHEN o_orderkey % 2 = 0 THEN 'completed' ELSE 'paused' END AS run_status, o_orderkey AS mtime FROM orders)
  SELECT doc, kind, 's' || mtime AS path FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY CASE WHEN kind = 'live' AND run_status <> 'completed' THEN 0 WHEN kind = 'archived' THEN 1 WHEN kind = 'live' THEN 2 ELSE 3 END, mtime DESC) AS n FROM s) WHERE n = 1""")
def resume_sources(spark, d):
    kind = F.when(F.col("o_orderstatus") == "F", "live").when(F.col("o_orderstatus") == "O", "archived").otherwise("legacy")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("doc"), kind.alias("kind"), F.when(F.col("o_orderkey") % 2 == 0, "completed").otherwise("paused").alias("run_status"), F.col("o_orderkey").alias("mtime"), F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("path"))
    return runs.resume_source(rows)


@query("""WITH i AS (SELECT conv_id AS doc, list(DISTINCT turn) AS wanted FROM conversations GROUP BY 1), s AS (SELECT conv_id AS doc, list(DISTINCT turn) AS have FROM conversations WHERE turn > 0 OR conv_id % 2 = 0 GROUP BY 1)
  SELECT s.doc, (s.doc % 3 <> 0) AND (s.doc % 5 <> 0) AND len(list_filter(wanted, lambda x: NOT list_contains(have, x))) = 0 AS compatible FROM s JOIN i USING (doc)""")
def compatible_states(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("image"))
    state = c.filter("image > 0 or doc % 2 = 0").groupBy("doc").agg(F.collect_set("image").alias("images"))
    state = state.withColumns({"schema_version": F.when(F.col("doc") % 3 == 0, 1).otherwise(2), "fingerprint": F.lit("x"), "wanted": F.when(F.col("doc") % 5 == 0, "y").otherwise("x")})
    return runs.compatible(state, c, 2)


# ---- files -------------------------------------------------------------------------------------------------------------------------------------------

_NAMES = "CASE WHEN doc_id % 5 = 0 THEN 'project.json' WHEN doc_id % 5 = 1 THEN 'deck_' || doc_id || '.apkg' WHEN doc_id % 5 = 2 THEN 'All_fronts.md' WHEN doc_id % 5 = 3 THEN 'c_' || lang || '.json' ELSE 'new_cards_output.json.1' END"


@query(f"""WITH f AS (SELECT {_NAMES} AS name FROM documents)
  SELECT CASE WHEN name = 'project.json' OR ends_with(name, '.apkg') OR starts_with(name, 'new_cards_output.json') THEN 'own' WHEN name = 'All_fronts.md' OR name = 'c_en.json' THEN 'derived' ELSE 'other' END AS class, count(*) AS n FROM f GROUP BY 1""")
def file_classes(spark, d):
    n = F.col("doc_id") % 5
    name = F.when(n == 0, "project.json").when(n == 1, F.concat(F.lit("deck_"), F.col("doc_id").cast("string"), F.lit(".apkg"))).when(n == 2, "All_fronts.md").when(n == 3, F.concat(F.lit("c_"), F.col("lang"), F.lit(".json"))).otherwise("new_cards_output.json.1")
    return table(spark, d, "documents").groupBy(projects.file_class(name, ("c_en.json",)).alias("class")).agg(F.count("*").alias("n"))


def _paths(spark, d):
    suffix = F.when(F.col("doc_id") % 3 == 0, ".PNG").otherwise(".txt")
    return table(spark, d, "documents").select(F.concat(F.lit("/in/"), F.col("source"), F.lit("/"), F.when(F.col("lang") == "en", "").otherwise(F.concat("lang", F.lit("/"))), F.col("doc_id").cast("string"), suffix).alias("path"))


@query("SELECT count(DISTINCT CASE WHEN lang = 'en' THEN source ELSE source || '/' || lang END) AS folders FROM documents")
def folder_count(spark, d):
    return projects.folder_count(_paths(spark, d))


@query("SELECT '/in/' || source AS document, count(*) AS images FROM documents WHERE lang = 'en' AND doc_id % 3 = 0 GROUP BY 1")
def image_folders(spark, d):
    return projects.image_folders(_paths(spark, d), "/in")


@query("SELECT DISTINCT path FROM (SELECT source || CASE WHEN lang = 'de' THEN '/pdf2pic/' WHEN lang = 'fr' THEN '/log_archive/x/' ELSE '/' END || lang || CASE WHEN doc_id % 2 = 0 THEN '.PDF' ELSE '.txt' END AS path, lang, doc_id FROM documents) WHERE doc_id % 2 = 0 AND lang NOT IN ('de', 'fr')")
def source_files(spark, d):
    inside = F.when(F.col("lang") == "de", "/pdf2pic/").when(F.col("lang") == "fr", "/log_archive/x/").otherwise("/")
    files = table(spark, d, "documents").select(F.concat("source", inside, "lang", F.when(F.col("doc_id") % 2 == 0, ".PDF").otherwise(".txt")).alias("path"))
    return readers.find_documents(files).distinct()


@query("""WITH n AS (SELECT r_name AS dir, n_name || CASE WHEN n_nationkey % 2 = 0 THEN '.pdf' ELSE '.txt' END AS file, n_nationkey % 2 = 0 AS pdf FROM nation JOIN region ON n_regionkey = r_regionkey),
  d AS (SELECT dir, row_number() OVER (ORDER BY dir) AS k FROM (SELECT DISTINCT dir FROM n)),
  f AS (SELECT n.*, k, row_number() OVER (PARTITION BY n.dir ORDER BY file) AS i, row_number() OVER (PARTITION BY n.dir ORDER BY file DESC) = 1 AS last FROM n JOIN d USING (dir)),
  l AS (SELECT k, 0 AS i, '├── ' || dir || '/' AS line FROM d UNION ALL SELECT k, i, '│   ' || CASE WHEN last THEN '└── ' ELSE '├── ' END || file || CASE WHEN pdf THEN '  [OCR: done]' ELSE '' END FROM f UNION ALL SELECT 1000, 0, '└── project.json  [EXISTS — project config]')
  SELECT row_number() OVER (ORDER BY k, i) AS pos, line FROM l""")
def directory_tree(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    pdf = F.col("n_nationkey") % 2 == 0
    files = n.select(F.concat("r_name", F.lit("/"), "n_name", F.when(pdf, ".pdf").otherwise(".txt")).alias("path"), F.when(pdf, "  [OCR: done]").alias("note"))
    more = spark.range(1).select(F.lit("project.json").alias("path"), F.lit("  [EXISTS — project config]").alias("note"))
    return projects.directory_tree(files.unionByName(more).unionByName(files.select(F.concat(F.lit("pdf2pic/"), "path").alias("path"), "note")))


# ---- materials and configurations --------------------------------------------------------------------------------------------------------------------


def _materials(spark, d):
    r = table(spark, d, "region")
    return r.select((F.col("r_regionkey") + 1).alias("number"), F.lower("r_name").alias("name"), F.concat(F.lit("m/"), F.col("r_name")).alias("path"), F.col("r_name").alias("description"), (F.col("r_regionkey") == 0).alias("is_default"))


@query("""SELECT CAST(r_regionkey + 1 AS INTEGER) AS number, lower(r_name) AS name, 'm/' || r_name AS path, r_name AS description, r_regionkey = 2 AS is_default FROM region WHERE r_regionkey <> 1
  UNION ALL SELECT (SELECT CAST(max(r_regionkey) + 2 AS INTEGER) FROM region), 'new', 'm/new.txt', 'Material: new', false""")
def material_registry(spark, d):
    """One is added, the third becomes the default, the second goes; the default itself can't, and an unknown one changes nothing."""
    m = projects.set_default(projects.add_material(_materials(spark, d), "new", "m/new.txt"), 3)
    return projects.set_default(projects.remove_material(projects.remove_material(m, 2), 3), 99)


@query("SELECT CAST(1 AS INTEGER) AS number, 'm/' || r_name AS path, (SELECT text FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark)) AS text FROM region WHERE r_regionkey = 0")
def default_material(spark, d):
    texts = table(spark, d, "benchmark").orderBy("item_id").limit(1).select(F.lit("m/AFRICA").alias("path"), "text")
    return projects.material(_materials(spark, d), texts)


@query("""SELECT s_suppkey AS path, CAST(unnest(range(0, len(p))) AS INTEGER) AS ord, unnest(p) AS problem FROM (SELECT s_suppkey, CASE s_suppkey % 5
  WHEN 0 THEN ['not a JSON object'] WHEN 1 THEN ['project_name is missing', 'collections is missing'] WHEN 2 THEN ['tag_prefix is empty', 'collections is no object with entries']
  WHEN 3 THEN ['project_name is empty', 'collections.a is no object', 'collections.b has no filename', 'collections.c' || s_nationkey || '.filename does not end in .json'] ELSE [] END AS p FROM supplier)""")
def project_problems(spark, d):
    """Every supplier's configuration, made of its name and nation: broken in four ways, or whole."""
    s = table(spark, d, "supplier")
    name, key, c = F.concat(F.lit('"'), "s_name", F.lit('"')), F.col("s_suppkey").cast("string"), F.concat(F.lit('"c'), F.col("s_nationkey").cast("string"), F.lit('"'))
    said = (
        F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("["), name, F.lit(", 2")))
        .when(F.col("s_suppkey") % 5 == 1, F.concat(F.lit('{"tag_prefix": '), name, F.lit("}")))
        .when(F.col("s_suppkey") % 5 == 2, F.concat(F.lit('{"project_name": '), name, F.lit(', "tag_prefix": " ", "collections": {}}')))
        .when(F.col("s_suppkey") % 5 == 3, F.concat(F.lit('{"project_name": '), key, F.lit(', "tag_prefix": "T", "collections": {"b": {}, "a": 1, '), c, F.lit(': {"filename": "c.txt"}, "d": {"filename": "d.json"}}}')))
        .otherwise(F.concat(F.lit('{"project_name": '), name, F.lit(', "tag_prefix": "T", "collections": {'), c, F.lit(': {"filename": "d.json"}}}')))
    )
    found = projects.project_problems(s.select(F.col("s_suppkey").alias("path"), said.alias("value")))
    return found.select("path", F.col("ord").cast("int"), "problem")


@query("""SELECT 'default_model' AS key, CAST(NULL AS VARCHAR) AS subkey, r_name AS value FROM region WHERE r_regionkey = 1 UNION ALL SELECT 'default_judge_model', NULL, 'j'""")
def settings_changed(spark, d):
    """Set twice, the last counts; a preset's parts are set and unset again, so nothing of it is left."""
    r = table(spark, d, "region")
    config = r.filter("r_regionkey = 0").select(F.lit("default_model").alias("key"), F.lit(None).cast("string").alias("subkey"), F.col("r_name").alias("value"))
    second = r.filter("r_regionkey = 1").first()["r_name"]
    config = projects.set_value(projects.set_value(config, "default_model", second), "default_judge_model", "j")
    config = projects.set_value(projects.set_value(config, "defaults", "m", "model"), "defaults", "2", "repeat")
    return projects.unset_value(projects.unset_value(config, "defaults", "model"), "defaults", "repeat")


# ---- records -----------------------------------------------------------------------------------------------------------------------------------------


@query(f"WITH {CARDS}, f AS (SELECT norm_front, min(pos) AS pos FROM cards WHERE known GROUP BY 1) SELECT c.pos AS asked, f.pos, CAST(f.pos AS VARCHAR) AS guid FROM cards c LEFT JOIN f USING (norm_front)")
def find_by_front(spark, d):
    old, _ = split(spark, d)
    asked = cards(spark, d).select(F.col("pos").alias("asked"), F.concat(F.lit("  "), F.col("front"), F.lit("\n")).alias("front"))
    return records.find_by_front(old, asked).select("asked", "pos", "guid")


@query("""SELECT doc_id AS pos, '{"guid":"' || doc_id || '","back":"' || lang || ':' || source || '","sort_field":null,"tags":["' || lang || '"],"created_at":"' || strftime(make_timestamp(doc_id * 1000000 + (doc_id % 2) * 250), '%Y-%m-%dT%H:%M:%S') || CASE WHEN doc_id % 2 = 1 THEN '.000250' ELSE '' END || '"}' AS json FROM documents""")
def cards_as_json(spark, d):
    late = F.timestamp_micros(F.col("pos") * 1_000_000 + F.col("pos") % 2 * 250)
    return records.to_json_rows(cards(spark, d).withColumn("created_at", late).select("pos", "guid", "back", "sort_field", "tags", "created_at"))


@query(f"""WITH {CARDS}, k AS (SELECT DISTINCT collection, category FROM cards WHERE known),
  n AS (SELECT *, dense_rank() OVER (ORDER BY CAST(split_part(collection, '_', 2) AS INTEGER), collection) AS n, row_number() OVER (PARTITION BY collection ORDER BY category) AS place FROM k),
  c AS (SELECT n || chr(CAST(place + 64 AS INTEGER)) AS code, collection, category FROM n),
  r AS (SELECT doc_id AS pos, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE (doc_id % 23 + 1) || chr(CAST(65 + doc_id % 5 AS INTEGER)) END AS code FROM documents)
  SELECT pos, r.code, c.collection, c.category FROM r LEFT JOIN c USING (code)""")
def decoded_categories(spark, d):
    old, _ = split(spark, d)
    code = F.concat((F.col("doc_id") % 23 + 1).cast("string"), F.lower(F.char(65 + F.col("doc_id") % 5)))
    replies = table(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.when(F.col("doc_id") % 10 == 0, "none of 0x these").otherwise(F.concat(F.lit("Code: "), code, F.lit("."))).alias("reply"))
    return records.decode_categories(replies, records.category_codes(old, outline.collection_order)).select("pos", "code", "collection", "category")


@query("WITH k AS (SELECT 'collection_' || substr(source, 4) || '_docs' AS key, count(*) AS n FROM documents GROUP BY 1) SELECT key, n, row_number() OVER (ORDER BY key) AS rank FROM k")
def export_order(spark, d):
    """Plain order of names: collection_10 before collection_2, other than in an outline."""
    return audit.leaderboard(cards(spark, d).groupBy(F.col("collection").alias("key")).agg(F.count("*").alias("n")), by="key").withColumnRenamed("place", "rank")


@query("""WITH r AS (SELECT source AS model, avg(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS vision, round(avg(n_chars), 6) AS recall FROM documents GROUP BY 1)
  SELECT model, row_number() OVER (ORDER BY vision DESC, recall DESC, model) AS place FROM r""")
def leaderboard(spark, d):
    rows = table(spark, d, "documents").groupBy(F.col("source").alias("model")).agg(F.avg((F.col("lang") == "en").cast("int")).alias("vision"), F.round(F.avg("n_chars"), 6).alias("recall"))
    return audit.leaderboard(rows, F.desc("vision"), F.desc("recall")).select("model", "place")


@query(f"""WITH {CARDS}, o AS (SELECT collection, pos, row_number() OVER (PARTITION BY collection ORDER BY pos) AS place, count(*) OVER (PARTITION BY collection) AS n FROM cards)
  SELECT collection, pos, greatest(n - 3, 0) AS more FROM o WHERE place <= 3""")
def first_of_group(spark, d):
    return audit.first_k(cards(spark, d), 3, "collection", "pos").select("collection", "pos", "more")


@query("SELECT doc_id, lang, CASE WHEN quality IS NULL THEN 0 ELSE 1 END AS n FROM documents LEFT JOIN (SELECT DISTINCT doc_id, 1 AS quality FROM labels) USING (doc_id) UNION ALL SELECT page_id, NULL, 2 FROM pages")
def appended_rows(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").select("doc_id").distinct()
    a = docs.join(labels, "doc_id", "left_anti").withColumn("n", F.lit(0))
    b = docs.join(labels, "doc_id", "left_semi").withColumn("n", F.lit(1))
    return records.append(records.append(a, b), table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.lit(2).alias("n")))


@query("""WITH m AS (SELECT conv_id, list_sort(list(DISTINCT turn)) AS m FROM conversations GROUP BY 1), p AS (SELECT conv_id % 3 AS pass, m, unnest(m) AS i FROM m)
  SELECT DISTINCT pass, i, j FROM (SELECT pass, i, unnest(m) AS j FROM p) WHERE i < j""")
def pairs_in_clusters(spark, d):
    found = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list("turn").alias("members"))
    return cluster.pairs_of(found.select((F.col("conv_id") % 3).alias("pass"), "members"))


@query("SELECT conv_id * 1000 + turn AS page, wanted FROM (SELECT conv_id, turn, unnest(['the ' || role, role || '  x', substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 3, 20)]) AS wanted, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations) WHERE NOT contains(t, trim(regexp_replace(wanted, '\\s+', ' ', 'g')))")
def missing_strings(spark, d):
    first = table(spark, d, "conversations").withColumn("page", F.col("conv_id") * 1000 + F.col("turn"))
    flat = F.trim(F.regexp_replace("text", "\\s+", " "))
    truth = first.select("page", F.array(F.concat(F.lit("the "), "role"), F.concat("role", F.lit("  x")), F.substring(flat, 3, 20)).alias("text"))
    return audit.not_contained(truth, first.select("page", F.col("text").alias("content")))


@query("SELECT item_id, upper(substr('bench ' || item_id || '-deck of ' || (item_id * 7), 1, 12)) AS raw, replace(replace(upper(substr('bench ' || item_id || '-deck of ' || (item_id * 7), 1, 12)), ' ', '_'), '-', '_') AS tag, 'Q: ' || item_id || ' of ' || length(text) || ' {other}' AS prompt FROM benchmark")
def tags_and_prompts(spark, d):
    name = F.concat(F.lit("bench "), F.col("item_id").cast("string"), F.lit("-deck of "), (F.col("item_id") * 7).cast("string"))
    b = table(spark, d, "benchmark")
    asked = F.replace(F.replace(T.fill(F.lit("Q: {id} of {n} {other}"), {"id": "#1", "n": "#2"}), F.lit("#1"), F.col("item_id").cast("string")), F.lit("#2"), F.length("text").cast("string"))
    return b.select("item_id", F.upper(F.substring(name, 1, 12)).alias("raw"), T.deck_tag(name, 12).alias("tag"), asked.alias("prompt"))


@query("""WITH p AS (SELECT p_partkey, 400 + p_size * 13 AS w, 300 + p_partkey % 900 AS h FROM part), f AS (SELECT *, CASE WHEN w > h THEN 842.0 ELSE 595.0 END AS pw, CASE WHEN w > h THEN 595.0 ELSE 842.0 END AS ph FROM p)
  SELECT p_partkey, w > h AS landscape, round(least(pw / w, ph / h), 6) AS scale, abs(round((pw - w * least(pw / w, ph / h)) / 2, 6)) AS x,
    CAST(round_even(least(greatest(CAST(10 AS DOUBLE) / w, 0), 1) * 2000, 0) AS INTEGER) AS crop_left, CAST(round_even(least(greatest(CAST(5000 AS DOUBLE) / h, 0), 1) * 3000, 0) AS INTEGER) AS crop_bottom FROM f""")
def image_places(spark, d):
    p = table(spark, d, "part").select("p_partkey", (400 + F.col("p_size") * 13).alias("w"), (300 + F.col("p_partkey") % 900).alias("h"))
    fit, box = T.fit_page(F.col("w"), F.col("h")), T.crop_box(F.lit(10), F.lit(20), F.lit(300), F.lit(5000), F.col("w"), F.col("h"), F.lit(2000), F.lit(3000))
    return p.select("p_partkey", fit["landscape"].alias("landscape"), F.round(fit["scale"], 6).alias("scale"), F.abs(F.round(fit["x"], 6)).alias("x"), box[0].alias("crop_left"), box[3].alias("crop_bottom"))


@query("SELECT 'm' || (item_id % 3) AS model, 'p' || item_id AS page, CAST(item_id AS VARCHAR) AS rep, CAST(length(text) AS INTEGER) AS hits FROM benchmark")
def keyed_results(spark, d):
    b = table(spark, d, "benchmark")
    key = F.concat(F.lit("m"), (F.col("item_id") % 3).cast("string"), F.lit("||p"), F.col("item_id").cast("string"), F.lit("||"), F.col("item_id").cast("string"))
    texts = b.select(F.to_json(F.map_from_arrays(F.array(key), F.array(F.struct(F.length("text").alias("hits"))))).alias("value"))
    return readers.keyed_results(texts, ["model", "page", "rep"], "hits int")


@query("SELECT event_id, event_type AS model, CAST(user_id % 12 AS INTEGER) AS pages_completed, event_id % 40 = 0 AS paused FROM events WHERE user_id % 12 >= 5 OR event_id % 40 = 0")
def kept_observations(spark, d):
    """What of the observations is worth a line of the log: five new pages at least, or a pause."""
    ev = table(spark, d, "events").select("event_id", F.col("event_type").alias("model"), (F.col("user_id") % 12).cast("int").alias("pages_completed"), (F.col("event_id") % 40 == 0).alias("paused"))
    return writers.worth_logging(ev)


@query("SELECT CASE WHEN ord < 10 THEN 'Docs ' || ord ELSE 'Docs' END AS deck, CAST(count(DISTINCT source) AS BIGINT) AS ids, count(*) AS notes, min(doc_id) AS first, md5(string_agg(CAST(doc_id AS VARCHAR) || md5(text) || lang || ':' || source, ',' ORDER BY CAST(doc_id AS VARCHAR))) AS fields FROM (SELECT *, CAST(substr(source, 4) AS INTEGER) AS ord FROM documents) GROUP BY 1")
def decks(spark, d):
    """Configured collections have decks of their names, the others one named after what follows their number; ids are those of collections."""
    rows = writers.deck_rows(cards(spark, d), dimension(spark, d))
    field = F.concat("guid", F.md5(F.col("fields")[0]), F.col("fields")[1])
    told = F.transform(F.array_sort(F.collect_list(F.struct("guid", field.alias("f")))), lambda x: x.f)
    return rows.groupBy("deck").agg(F.count_distinct("deck_id").alias("ids"), F.count("*").alias("notes"), F.min(F.col("guid").cast("long")).alias("first"), F.md5(F.array_join(told, ",")).alias("fields"))


@query("SELECT user_id AS model, event_type AS page, CAST(count_if(value > 50) AS BIGINT) AS hits, count(*) AS total, array_to_string(list_sort(list(event_id) FILTER (value <= 50 OR value IS NULL)), ',') AS missed FROM events GROUP BY ALL")
def missed_values(spark, d):
    hits = table(spark, d, "events").select(F.col("user_id").alias("model"), F.col("event_type").alias("page"), F.col("event_id").alias("label"), (F.col("value") > 50).alias("hit"))
    return runs.missed_values(hits).withColumn("missed", F.nullif(F.array_join(F.transform("missed", lambda x: x.cast("string")), ","), F.lit("")))


@query("WITH p AS (SELECT event_type AS judge, user_id AS pair, count(DISTINCT value > 50) AS n FROM events WHERE event_id % 3 <> 0 GROUP BY ALL) SELECT judge, CAST(count_if(n > 1) AS BIGINT) AS differing, count(*) AS pairs FROM p GROUP BY 1")
def differing_picks(spark, d):
    ev = table(spark, d, "events")
    return runs.differing(ev.select(F.col("event_type").alias("judge"), F.col("user_id").alias("pair"), (F.col("value") > 50).alias("picked"), (F.col("event_id") % 3 != 0).alias("ok")))


@query("SELECT CAST(pass AS INTEGER) AS pass, CAST(doc_id AS BIGINT) AS cluster, CAST(doc_id AS BIGINT) AS a, CAST(doc_id + 1 AS BIGINT) AS b FROM documents, (SELECT unnest([1, 2, 3]) AS pass) WHERE doc_id % 2 = 0 AND doc_id + 1 IN (SELECT doc_id FROM documents)")
def shown_orders(spark, d):
    """Each pass names pairs by the places it was shown; read back, every pass names the same rows."""
    docs = table(spark, d, "documents").select("doc_id")
    orders = cluster.permuted(docs, 3, 5, "doc_id")
    pairs = orders.groupBy("pass", F.floor(F.col("original") / 2).alias("k")).agg(F.collect_list(F.col("shown").cast("long")).alias("members"), F.min("original").cast("long").alias("cluster"))
    back = cluster.original_members(pairs.unionByName(pairs.limit(1).withColumns({"members": F.array(F.lit(-5).cast("long")), "cluster": F.lit(-1).cast("long")})), orders)
    return back.select("pass", "cluster", F.element_at("members", 1).cast("long").alias("a"), F.element_at("members", 2).cast("long").alias("b"))


@query("""SELECT p_partkey, p_size % 3 = 0 AS off, CAST(CASE WHEN p_size % 4 = 0 THEN 6 ELSE least(greatest(p_size - 10, 1), 20) END AS INTEGER) AS threads, (p_size % 5 = 0 OR p_size <= 10 OR p_size % 7 = 0) AS may_replace,
  CASE WHEN p_size % 5 = 1 THEN 'json' END IS NOT NULL AS same_json FROM part""")
def gates_and_flags(spark, d):
    p, n = table(spark, d, "part"), F.col("p_size")
    said = F.when(n % 3 == 0, F.element_at(F.array(F.lit("1"), F.lit(" true "), F.lit("True")), (F.col("p_partkey") % 3 + 1).cast("int"))).otherwise("no")
    threads = F.when(n % 4 == 0, "many").otherwise(F.concat(F.lit(" "), (n - 10).cast("string")))
    size = F.when(n % 5 != 0, n)
    files = p.select(F.concat(F.col("p_partkey").cast("string"), F.lit(".json")).alias("filename"), "p_partkey", n.alias("n"))
    a = files.select("filename", F.lit('{"a": 1, "b": [1, 2]}').alias("content"))
    b = files.select("filename", F.when(F.col("n") % 5 == 1, '{ "b":[1,2],\r\n"a":1}').otherwise('{"b":[2,1],"a":1}').alias("content"))
    same = audit.compare_files(a, b).select(F.substring_index("filename", ".", 1).cast("long").alias("p_partkey"), (F.col("status") == "same").alias("same_json"))
    return p.select("p_partkey", T.flag(said).alias("off"), T.clamped(threads, 6, 1, 20).alias("threads"), writers.may_replace(size, n % 7 == 0, 10).alias("may_replace")).join(same, "p_partkey")
