"""Queries over what is written and read again, and over functions of single values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import json_repair
from ..functions import text as T
from ..operators import cluster, runs
from ..operators.shared import scratch
from ..sources import readers, writers
from ..streaming import replies
from .registry import query
from .tables import cards, dimension, table


@query("SELECT r_regionkey, r_name || '!' AS r_name FROM region WHERE r_regionkey < 3 UNION ALL SELECT r_regionkey, r_name FROM region WHERE r_regionkey >= 3")
def replaced_table(spark, d):
    """Written, replaced with a backup, replaced once more, and the former one restored for some rows."""
    at, r = scratch(spark), table(spark, d, "region")
    writers.replace_table(r, at)
    backup = writers.replace_table(r.withColumn("r_name", F.concat("r_name", F.lit("!"))), at, keep_backup=True)
    new = spark.read.parquet(at).filter("r_regionkey < 3")
    return new.unionByName(spark.read.parquet(backup).filter("r_regionkey >= 3")).select("r_regionkey", "r_name")


@query("SELECT r_regionkey, r_name FROM region")
def restored_table(spark, d):
    at, r = scratch(spark), table(spark, d, "region")
    writers.replace_table(r, at)
    writers.restore(spark, at, writers.replace_table(r.limit(1), at, keep_backup=True))
    return spark.read.parquet(at).select("r_regionkey", "r_name")


@query("SELECT lang, count(*) AS n, count(*) * 2 AS twice FROM documents GROUP BY 1")
def staged_tables(spark, d):
    """The first stage is read from the first run, though its input is gone; the second is made again."""
    at, docs = scratch(spark), table(spark, d, "documents")
    once = writers.Stages(spark, at)
    once.run("counted", lambda: docs.groupBy("lang").agg(F.count("*").alias("n")))
    again = writers.Stages(spark, at, from_stage=2)
    first = again.run("counted", lambda: docs.limit(0).groupBy("lang").agg(F.count("*").alias("n")))
    return again.run("doubled", lambda: first.withColumn("twice", F.col("n") * 2))


@query("SELECT epoch_us(ts) AS ts, event_type AS model, CAST(user_id AS INTEGER) AS pages_completed FROM events")
def logged_observations(spark, d):
    """Two appends, and a line that can't be read, which is left out."""
    at, ev = scratch(spark), table(spark, d, "events")
    rows = ev.select("event_id", "ts", F.col("event_type").alias("model"), F.col("user_id").cast("int").alias("pages_completed"))
    for k in (0, 1):
        writers.append_log(rows.filter(F.col("event_id") % 2 == k).withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).drop("event_id"), at)
    spark.range(1).select(F.lit('{"ts": "2024').alias("value")).write.mode("append").text(at)
    return readers.read_log(spark, at).select(F.unix_micros("ts").alias("ts"), "model", "pages_completed")


@query("SELECT item_id % 4 AS part, row_number() OVER (PARTITION BY item_id % 4 ORDER BY item_id) - 1 AS pos, md5(text) AS front, CAST(item_id AS VARCHAR) AS guid FROM benchmark")
def records_read(spark, d):
    """Arrays of records, a file each, beside one that is no array and one with fields that aren't known."""
    at, b = scratch(spark), table(spark, d, "benchmark")
    one = F.struct("item_id", F.struct(F.col("text").alias("front"), F.col("item_id").cast("string").alias("guid"), (F.col("item_id") % 4).cast("string").alias("source"), F.lit(1).alias("unknown")).alias("c"))
    files = b.groupBy((F.col("item_id") % 4).alias("part")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.c)).alias("value"))
    files.unionByName(spark.range(1).select(F.col("id").alias("part"), F.lit('{"front": "x"}').alias("value"))).select("value").repartition(8).write.option("maxRecordsPerFile", 1).text(at)
    return readers.read_records(spark, at).filter("guid is not null").select(F.col("source").cast("long").alias("part"), "pos", F.md5("front").alias("front"), "guid")


@query("SELECT DISTINCT 'collection_' || substr(source, 4) || '_docs' AS collection, substr(lang, 1, 1) || '_' || lang AS category, 0 AS cards FROM documents")
def template_categories(spark, d):
    """The template that new cards are filled into, read back."""
    said = F.from_json("json", "generated_cards map<string,string>, subcategories_reference map<string,array<string>>")
    rows = writers.template(cards(spark, d)).select(said.alias("t")).select("t.subcategories_reference", F.explode("t.generated_cards").alias("collection", "m"))
    empty = rows.select("collection", F.element_at("subcategories_reference", F.col("collection")).alias("listed"), F.explode(F.from_json("m", "map<string,array<string>>")).alias("category", "cards"))
    return empty.filter(F.array_contains("listed", F.col("category"))).select("collection", "category", F.size("cards").alias("cards"))


@query("SELECT coalesce(CASE WHEN CAST(substr(source, 4) AS INTEGER) < 10 THEN 'collection_' || substr(source, 4) || '_docs.json' END, 'collection_' || substr(source, 4) || '_docs.json') AS filename, CAST(doc_id AS VARCHAR) AS guid, md5(text) AS front FROM documents")
def written_collections(spark, d):
    at = scratch(spark)
    writers.write_collections(cards(spark, d), dimension(spark, d), at)
    return spark.read.json(at).select("filename", "guid", F.md5("front").alias("front"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS run_id, count(*) AS phases FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1")
def traced_runs(spark, d):
    """A trace that is flushed after each of two phases; a broken one beside it gives nothing and is set aside."""
    at, broken, kind = scratch(spark), scratch(spark), "run_id string, phases bigint"
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("run_id"))
    writers.flush_trace(o.agg(F.lit(1).cast("long").alias("phases")), at)
    writers.flush_trace(table(spark, d, "orders").filter("o_orderkey % 2 = 0").groupBy(F.col("o_custkey").cast("string").alias("run_id")).agg(F.count("*").alias("phases")), at)
    spark.range(1).select(F.lit('{"run_id": ').alias("value")).write.text(broken)
    return writers.read_trace(spark, at, kind).unionByName(writers.read_trace(spark, broken, kind))


@query("SELECT 'page_' || r_regionkey || '.png' AS image, CAST(r_regionkey AS INTEGER) AS page_no, CAST(length(r_name) AS BIGINT) AS size FROM region WHERE r_regionkey <> 1 UNION ALL SELECT 'cover.jpg', NULL, length(r_name) FROM region WHERE r_regionkey = 1")
def images_listed(spark, d):
    at = scratch(spark)
    for r in table(spark, d, "region").collect():  # five small files
        name = "cover.jpg" if r["r_regionkey"] == 1 else f"page_{r['r_regionkey']}.png"
        writers.write_prompt(spark, f"{at}/{name}", r["r_name"])
        writers.write_prompt(spark, f"{at}/notes_{r['r_regionkey']}.md", "x")
    return readers.read_images(spark, at).select("image", "page_no", "size")


@query("SELECT r_name || '.txt' AS file, md5('text of ' || r_name) AS text FROM region")
def texts_read(spark, d):
    at = scratch(spark)
    names = [r["r_name"] for r in table(spark, d, "region").collect()]
    for name in names:
        writers.write_prompt(spark, f"{at}/{name}.txt", f"text of {name}")
    return readers.read_texts(spark, [f"{at}/{name}.txt" for name in names]).select(F.substring_index("file", "/", -1).alias("file"), F.md5("text").alias("text"))


@query("SELECT pos, md5(front) AS front, back FROM (SELECT item_id AS pos, text AS front, CASE WHEN item_id % 3 <> 0 THEN 'b' || item_id END AS back FROM benchmark)")
def candidates_exchanged(spark, d):
    at = scratch(spark)
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("pos"), F.col("text").alias("front"), F.when(F.col("item_id") % 3 != 0, F.concat(F.lit("b"), F.col("item_id").cast("string"))).alias("back"), F.col("item_id").cast("string").alias("source"))
    writers.write_candidates(b, at)
    back = readers.read_candidates(spark, writers.mark_processed(spark, at, "20240101"))
    return back.select(F.col("source").cast("long").alias("pos"), F.md5("front").alias("front"), "back")


# ---- values ------------------------------------------------------------------------------------------------------------------------------------------


@query("""WITH m AS (SELECT conv_id, list_sort(list(DISTINCT turn - 2) FILTER (turn - 2 >= 0 AND turn - 2 < 3)) AS m FROM conversations GROUP BY 1)
  SELECT conv_id, CASE WHEN len(m) >= 2 THEN array_to_string(m, ',') END AS members FROM m""")
def valid_members(spark, d):
    told = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.col("turn") - 2).alias("m"))
    good = cluster.valid_members(F.concat("m", "m"), F.lit(3))
    return told.select("conv_id", F.array_join(F.transform(good, lambda x: x.cast("string")), ",").alias("members"))


@query("""SELECT n_nationkey, lower(n_name) AS plain, replace(replace(replace(n_name || ': a/b', ' ', '_'), ':', ''), '/', '_') AS key, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_nationkey * 3 END AS x FROM nation""")
def text_values(spark, d):
    """Fences taken off, keys that a wizard makes, rectangles of whole numbers only."""
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    fenced = F.when(k % 3 == 0, F.concat(F.lit(" ```json\n"), F.lower("n_name"), F.lit("\n``` "))).when(k % 3 == 1, F.concat(F.lit("```"), F.lit("\n"), F.lower("n_name"))).otherwise(F.concat(F.lower("n_name"), F.lit("\n")))
    box = F.when(k % 5 == 0, F.concat(F.lit("1,2,x,"), k.cast("string"))).otherwise(F.concat(F.lit("1, "), (k * 3).cast("string"), F.lit(",-4,5")))
    return n.select("n_nationkey", T.strip_fence(fenced).alias("plain"), T.wizard_key(F.concat("n_name", F.lit(": a/b"))).alias("key"), T.rectangle(box)[1].alias("x"))


@query("""SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'done' WHEN event_type = 'signup' THEN 'judge_pending' WHEN user_id % 45 + 1 >= 40 THEN 'paused' ELSE 'pending' END AS status, CAST(user_id % 45 + 1 AS INTEGER) AS attempts_used,
  CASE WHEN event_type NOT IN ('purchase', 'signup') AND user_id % 45 + 1 < 40 THEN least(5.0, 0.5 * (user_id % 45 + 1)) ELSE 0 END::DOUBLE AS backoff FROM events""")
def page_budget(spark, d):
    outcome = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "signup", "judge_pending").otherwise("failed")
    cycles = table(spark, d, "events").select("event_id", (F.col("user_id") % 45).cast("int").alias("attempts_used"), outcome.alias("outcome"))
    return runs.next_state(cycles).select("event_id", "status", "attempts_used", F.col("backoff").cast("double").alias("backoff"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'unknown' ELSE event_type END AS model, CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS prompt_tokens, CAST(0 AS BIGINT) AS cached_tokens, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE value END AS cost FROM events""")
def usage_defaults(spark, d):
    use = F.when(F.col("event_id") % 3 != 0, F.struct(F.col("user_id").alias("prompt_tokens"), F.lit(None).cast("bigint").alias("completion_tokens"), F.lit(None).cast("struct<cached_tokens:bigint>").alias("prompt_tokens_details"), F.col("value").alias("cost")))
    response = F.struct(F.when(F.col("event_type") != "error", F.col("event_type")).alias("model"), use.alias("usage"), F.lit(None).cast("string").alias("error"))
    return table(spark, d, "events").select("event_id", runs.usage(response).alias("u")).select("event_id", "u.model", "u.prompt_tokens", "u.cached_tokens", F.coalesce("u.cost", F.lit(0.0)).alias("cost"))


@query("SELECT item_id, '{\"a\":' || item_id || ',\"b\":[1,{\"c\":null}]}' AS canonical FROM benchmark")
def canonical_json(spark, d):
    said = F.concat(F.lit('{ "b" : [1, {"c": null}],\n "a": '), F.col("item_id").cast("string"), F.lit("}"))
    return table(spark, d, "benchmark").select("item_id", F.regexp_replace(json_repair.canonical_json(said), r"\s", "").alias("canonical"))


@query("""WITH e AS (SELECT CAST(conv_id AS VARCHAR) AS request_id, turn, length(text) AS n FROM conversations), w AS (SELECT request_id, max(turn) AS last FROM e GROUP BY 1)
  SELECT request_id, CASE WHEN last * 400 > 1800 THEN 'wall_timeout' ELSE 'incomplete' END AS status FROM w""")
def reply_wall_limit(spark, d):
    """Events of data every 400 seconds: none is idle under a long idle limit, and the fifth is beyond the wall of 1800."""
    c = table(spark, d, "conversations")
    events = c.select(F.col("conv_id").cast("string").alias("request_id"), F.col("turn").alias("seq"), F.timestamp_seconds(F.col("turn") * 400).alias("ts"), F.lit("data").alias("kind"), F.col("role").alias("delta"), F.lit(None).cast("string").alias("finish_reason"))
    return replies.assemble(events, replies.Limits(idle_s=500)).select("request_id", "status")
