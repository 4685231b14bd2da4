"""Queries over runs: page states, ensembles, telemetry, statistics, streams, and functions that only Python has."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import json_repair, similarity
from ..functions import text as T
from ..operators import runs
from ..streaming import replies
from .registry import query
from .tables import table


@query("""WITH s AS (SELECT conv_id AS doc, turn AS image, CASE role WHEN 'user' THEN 'done' WHEN 'assistant' THEN 'judge_pending' ELSE 'pending' END AS status, CAST(turn AS INTEGER) AS attempts,
  CASE WHEN length(text) % 5 = 0 THEN '[ERROR: x]' ELSE text END AS body, length(text) % 2 = 0 AS cands, conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system') AS paused FROM conversations),
  o AS (SELECT *, NOT starts_with(ltrim(body), '[ERROR:') AND NOT starts_with(ltrim(body), '[INFO:') AND trim(body) <> '' AS ok FROM s),
  k AS (SELECT *, paused AND status <> 'done' AS again, (status = 'done' AND ok) AS stays, (status = 'judge_pending' AND ok AND cands) AS waits FROM o)
  SELECT doc, image, CASE WHEN again THEN 'pending' WHEN stays THEN 'done' WHEN waits THEN 'judge_pending' ELSE 'pending' END AS status,
    CASE WHEN again THEN 0 WHEN stays OR waits THEN attempts WHEN status IN ('done', 'judge_pending') THEN 0 ELSE attempts END AS attempts_used, CASE WHEN NOT again AND (stays OR waits) THEN md5(body) END AS text FROM k""")
def page_state_resume(spark, d):
    c = table(spark, d, "conversations").withColumns({"doc": F.col("conv_id"), "image": F.col("turn")})
    status = F.when(F.col("role") == "user", "done").when(F.col("role") == "assistant", "judge_pending").otherwise("pending")
    n = F.length("text")
    state = c.select("doc", "image", status.alias("status"), F.col("turn").cast("int").alias("attempts_used"), F.when(n % 2 == 0, F.array("text")).otherwise(F.array().cast("array<string>")).alias("candidates"))
    output = c.select("doc", "image", F.when(n % 5 == 0, "[ERROR: x]").otherwise(F.col("text")).alias("body"))
    paused = c.filter("role = 'system'").select("doc")
    return runs.resume_pages(c.select("doc", "image"), state, output, paused).select("doc", "image", "status", "attempts_used", F.md5("text").alias("text"))


@query("""WITH s AS (SELECT conv_id AS doc, CAST(count_if(role = 'user') AS BIGINT) AS done, CAST(count_if(role = 'system') AS BIGINT) AS pending, CAST(count_if(role = 'assistant') AS BIGINT) AS judge_pending FROM conversations GROUP BY 1)
  SELECT doc, done, pending, judge_pending, CAST(0 AS BIGINT) AS paused, CASE WHEN pending > 0 THEN 'running' WHEN judge_pending > 0 THEN 'completed_with_judge_pending' ELSE 'completed' END AS run_status FROM s""")
def run_completion(spark, d):
    status = F.when(F.col("role") == "user", "done").when(F.col("role") == "assistant", "judge_pending").otherwise("pending")
    return runs.run_status(table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), status.alias("status")))


@query("""WITH r AS (SELECT conv_id AS page, turn, CASE WHEN length(text) > 400 THEN '[ERROR: truncated]' ELSE text END AS t, CASE WHEN role = 'system' THEN 'J' || length(text) END AS j FROM conversations),
  g AS (SELECT page, list(t ORDER BY turn) AS all_t, max(j) AS j FROM r GROUP BY 1), v AS (SELECT *, list_filter(all_t, lambda x: NOT starts_with(x, '[ERROR:')) AS valid FROM g),
  o AS (SELECT *, CASE WHEN len(all_t) = 1 THEN all_t[1] WHEN j IS NOT NULL THEN j ELSE coalesce(valid[1], all_t[1]) END AS text FROM v)
  SELECT page, CAST(len(all_t) AS INTEGER) AS replies, CAST(len(valid) AS INTEGER) AS valid, md5(text) AS text, CASE WHEN starts_with(ltrim(text), '[ERROR:') OR starts_with(ltrim(text), '[INFO:') OR trim(text) = '' THEN 'failed' WHEN len(all_t) = 1 OR j IS NOT NULL THEN 'success' ELSE 'judge_pending' END AS outcome FROM o""")
def ensemble_first_valid(spark, d):
    c = table(spark, d, "conversations")
    rows = c.select(F.col("conv_id").alias("page"), F.col("turn").alias("place"), "text", F.when(F.length("text") > 400, "length").otherwise("stop").alias("finish"), F.when(F.col("role") == "system", F.concat(F.lit("J"), F.length("text").cast("string"))).alias("judged"), F.lit("stop").alias("finish_judge"))
    return runs.judge_outcome(rows).withColumn("text", F.md5("text"))


@query("""SELECT CAST(p_partkey AS BIGINT) AS page, m.model, a.attempt, CAST((m.ord - 1) * 2 + a.attempt AS INTEGER) AS place FROM part, (VALUES (1, 'a'), (2, 'b')) m(ord, model), (VALUES (1), (2)) a(attempt)""")
def ensemble_calls(spark, d):
    models = spark.createDataFrame([(1, "a", 2), (2, "b", 2)], "ord int, model string, repeat int")
    return runs.ensemble_calls(table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("page")), models)


_LOG = "SELECT user_id AS model, event_id AS pos, 1 + CAST(floor(value) AS INTEGER) % 8 AS concurrency, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS errors, event_type = 'purchase' AS paused FROM events"


def _log(spark, d):
    kind = F.col("event_type")
    return table(spark, d, "events").select(F.col("user_id").alias("model"), F.col("event_id").alias("pos"), (1 + F.floor("value").cast("int") % 8).alias("concurrency"), (kind == "error").cast("int").alias("errors"), (kind == "purchase").alias("paused"))


@query(f"WITH log AS ({_LOG}) SELECT model, pos, CAST(row_number() OVER (PARTITION BY model ORDER BY pos DESC) AS INTEGER) AS back FROM log QUALIFY row_number() OVER (PARTITION BY model ORDER BY pos DESC) <= 30")
def last_n_per_key(spark, d):
    return runs.last_n(_log(spark, d), "model", "pos").select("model", "pos", "back")


@query(f"""WITH log AS ({_LOG}), r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY pos DESC) AS back FROM log QUALIFY back <= 30), l AS (SELECT *, first_value(concurrency) OVER (PARTITION BY model ORDER BY back) AS level FROM r),
  g AS (SELECT model, max(level) AS level, coalesce(min(CASE WHEN paused OR errors > 0 OR concurrency <> level THEN back END), max(back) + 1) - 1 AS streak, bool_or(paused AND back = 1) AS paused, max(CASE WHEN back = 1 THEN errors ELSE 0 END) AS errors FROM l GROUP BY model)
  SELECT model, CAST(CASE WHEN paused THEN greatest(1, level // 2) WHEN errors > 0 THEN greatest(1, level - 1) WHEN streak >= 3 THEN least(16, level + 1) ELSE level END AS INTEGER) AS concurrency, CAST(streak AS INTEGER) AS streak FROM g""")
def aimd_recommendation(spark, d):
    return runs.recommend(_log(spark, d)).withColumn("streak", F.col("streak").cast("int"))


@query("""SELECT user_id AS run_id, round(CAST(coalesce(sum(CAST(value AS DECIMAL(20, 10))) FILTER (event_type <> 'error'), 0) AS DOUBLE), 6) AS cost, count(*) FILTER (event_type <> 'error') AS calls, count(*) FILTER (event_type = 'error') AS errors,
  round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS seconds FROM events GROUP BY 1""")
def run_summary(spark, d):
    ev = table(spark, d, "events")
    call = F.struct(F.col("event_type").alias("model"), F.col("value").alias("cost"), F.when(F.col("event_type") == "error", "failed").alias("error"))
    phases = ev.groupBy(F.col("user_id").alias("run_id"), F.to_date("ts").cast("string").alias("phase")).agg(F.min("ts").alias("started_at"), F.max("ts").alias("finished_at"), F.lit("ok").alias("status"), F.collect_list(call).alias("llm_calls"))
    out = runs.run_summary(phases)
    return out.select("run_id", F.round(F.col("cost").cast("double"), 6).alias("cost"), "calls", F.size("errors").cast("long").alias("errors"), "seconds")


@query("""WITH h AS (SELECT conv_id, turn, list(role || ':' || text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM conversations)
  SELECT conv_id, turn, CAST(coalesce(len(prior), 0) AS INTEGER) AS n, md5(coalesce(array_to_string(prior, '|'), '')) AS prior FROM h""")
def conversation_prefix(spark, d):
    rows = runs.history(table(spark, d, "conversations"))
    return rows.select("conv_id", "turn", F.size("prior").alias("n"), F.md5(F.array_join(F.transform("prior", lambda p: F.concat(p.role, F.lit(":"), p.text)), "|")).alias("prior"))


@query("""WITH f AS (SELECT *, role = 'user' AND coalesce(lead(role) OVER (PARTITION BY conv_id ORDER BY turn), '') <> 'assistant' AS failed FROM conversations)
  SELECT conv_id, turn, count(said) OVER w AS n, md5(coalesce(string_agg(said, '|') OVER w, '')) AS prior FROM (SELECT *, CASE WHEN NOT failed THEN role || ':' || text END AS said FROM f)
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def rolled_back_prefix(spark, d):
    """What was asked and got no reply leaves the history again."""
    from pyspark.sql import Window

    turns = table(spark, d, "conversations")
    replied = F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn")).eqNullSafe(F.lit("assistant"))
    rows = runs.history(turns.withColumn("failed", (F.col("role") == "user") & ~replied), failed=F.col("failed"))
    return rows.select("conv_id", "turn", F.size("prior").cast("long").alias("n"), F.md5(F.array_join(F.transform("prior", lambda p: F.concat(p.role, F.lit(":"), p.text)), "|")).alias("prior"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 21600 SECOND OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
  SELECT user_id, CAST(session AS BIGINT) AS session, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS ended, count(*) AS n FROM s GROUP BY 1, 2""")
def idle_sessions(spark, d):
    out = replies.idle_sessions(table(spark, d, "events"), "user_id", "ts", 21600)
    return out.select("user_id", "session", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "n")


def _stream_events(spark, d):
    c = table(spark, d, "conversations")
    ts = F.timestamp_seconds(F.col("turn") * 40 + F.when(F.col("turn") >= 5, 200).otherwise(0))
    return c.select(F.col("conv_id").cast("string").alias("request_id"), F.col("turn").alias("seq"), ts.alias("ts"), F.when(F.col("role") == "system", "comment").otherwise("data").alias("kind"), F.col("text").alias("delta"), F.when((F.col("role") == "assistant") & (F.col("turn") >= 3), "stop").alias("finish_reason"))


@query("""WITH e AS (SELECT CAST(conv_id AS VARCHAR) AS request_id, turn AS seq, turn * 40 + CASE WHEN turn >= 5 THEN 200 ELSE 0 END AS s, role <> 'system' AS data, text, role = 'assistant' AND turn >= 3 AS fin FROM conversations),
  w AS (SELECT *, sum(CASE WHEN data THEN length(text) ELSE 0 END) OVER (PARTITION BY request_id ORDER BY seq) AS n, s - coalesce(max(CASE WHEN data THEN s END) OVER (PARTITION BY request_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), min(s) OVER (PARTITION BY request_id)) > 120 AS idle FROM e),
  c AS (SELECT *, CASE WHEN idle THEN 'idle_timeout' WHEN data AND n >= 1500 THEN 'cap' END AS ends FROM w),
  k AS (SELECT *, count(ends) OVER (PARTITION BY request_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS over_ FROM c),
  g AS (SELECT request_id, string_agg(text, '' ORDER BY seq) FILTER (data AND coalesce(ends, '') <> 'idle_timeout') AS text, bool_or(fin AND data AND coalesce(ends, '') <> '') OR bool_or(fin AND data) AS fin, max(ends) AS ends FROM k WHERE over_ = 0 GROUP BY 1)
  SELECT request_id, CASE WHEN ends = 'idle_timeout' THEN ends WHEN ends = 'cap' OR fin THEN 'ok' ELSE 'incomplete' END AS status, CASE WHEN ends = 'idle_timeout' THEN NULL WHEN ends = 'cap' OR fin THEN md5(coalesce(text, '')) END AS text,
    CASE WHEN ends = 'idle_timeout' THEN NULL WHEN ends = 'cap' THEN 'length' WHEN fin THEN 'stop' END AS finish_reason FROM g""")
def reply_assembly(spark, d):
    out = replies.assemble(_stream_events(spark, d), replies.Limits(120, 1800, 1500))
    return out.withColumn("text", F.md5("text"))


@query("""WITH e AS (SELECT CAST(conv_id AS VARCHAR) AS request_id, turn, role, conv_id FROM conversations),
  x AS (SELECT *, min(CASE WHEN conv_id % 3 = 0 AND turn = 4 THEN turn WHEN conv_id % 7 = 1 AND turn = 2 THEN turn END) OVER (PARTITION BY request_id) AS stop FROM e),
  g AS (SELECT request_id, conv_id, max(stop) AS stop, max(CASE WHEN stop IS NOT NULL AND turn = stop THEN CASE WHEN conv_id % 7 = 1 AND turn = 2 THEN 'error' ELSE 'done' END END) AS ends,
    string_agg(role, '' ORDER BY turn) FILTER (turn % 4 <> 3 AND (stop IS NULL OR turn < stop)) AS text, min(turn) FILTER (turn % 4 <> 3 AND (stop IS NULL OR turn < stop)) AS first_turn,
    max(turn) FILTER (turn % 4 <> 3 AND (stop IS NULL OR turn < stop)) AS last_turn FROM x GROUP BY ALL)
  SELECT request_id, CASE ends WHEN 'error' THEN 'error' WHEN 'done' THEN 'ok' ELSE 'incomplete' END AS status, CASE WHEN ends = 'done' THEN text END AS text, 'id' || first_turn AS id, CASE WHEN first_turn IS NOT NULL THEN 'm' END AS model,
    CAST(last_turn * 10 AS BIGINT) AS prompt_tokens, CASE WHEN ends = 'error' THEN 503 END AS code FROM g""")
def sse_replies(spark, d):
    """Raw lines: a chunk a turn, every fourth one broken; some streams end with [DONE], some with an error, and what follows doesn't count."""
    c = table(spark, d, "conversations")
    turn = F.col("turn").cast("string")
    chunk = F.concat(F.lit('data: {"id": "id'), turn, F.lit('", "model": "m", "choices": [{"delta": {"content": "'), F.col("role"), F.lit('"}}], "usage": {"prompt_tokens": '), (F.col("turn") * 10).cast("string"), F.lit("}}"))
    line = (
        F.when((F.col("conv_id") % 7 == 1) & (F.col("turn") == 2), 'data: {"error": {"code": 503, "message": "busy"}}')
        .when((F.col("conv_id") % 3 == 0) & (F.col("turn") == 4), "data: [DONE]")
        .when(F.col("turn") % 4 == 3, "data: {broken")
        .otherwise(chunk)
    )
    rows = c.select(F.col("conv_id").cast("string").alias("request_id"), F.col("turn").alias("seq"), F.timestamp_seconds("turn").alias("ts"), line.alias("line"))
    other = rows.filter("seq % 2 = 0").select("request_id", (F.col("seq") * 10 + 5).alias("seq"), "ts", F.when(F.col("seq") % 4 == 0, ": keep-alive").otherwise("event: x").alias("line"))
    events = replies.sse_events(rows.withColumn("seq", F.col("seq") * 10).unionByName(other))
    out = replies.with_details(events, replies.assemble(events))
    return out.select("request_id", "status", "text", "id", "model", "usage.prompt_tokens", "code")


@query("""WITH g AS (SELECT event_type AS judge, CAST(count_if(value > 50) AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1), x AS (SELECT *, k / n AS p, 1 + 1.96 * 1.96 / n AS d FROM g)
  SELECT judge, k, n, round(greatest(0, (p + 1.96 * 1.96 / (2 * n)) / d - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n)) / d), 6) AS low, round(least(1, (p + 1.96 * 1.96 / (2 * n)) / d + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n)) / d), 6) AS high FROM x""")
def wilson_rates(spark, d):
    g = table(spark, d, "events").groupBy(F.col("event_type").alias("judge")).agg(F.count_if(F.col("value") > 50).alias("k"), F.count("*").alias("n"))
    low, high = runs.wilson(F.col("k"), F.col("n"))
    return g.select("judge", "k", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("SELECT event_type AS model, round(avg(value), 6) AS mean, min(value) AS least, round(median(value), 6) AS median, round(CAST(sum(CAST(value AS DECIMAL(20, 10))) AS DOUBLE), 4) AS total, count(value) AS n, CAST(count_if(value <= 5) AS BIGINT) AS failures FROM events GROUP BY 1")
def model_stats(spark, d):
    s = runs.model_stats(table(spark, d, "events").select(F.col("event_type").alias("model"), "value", (F.col("value") > 5).alias("ok")))
    return s.select("model", F.round("mean", 6).alias("mean"), "least", F.round("median", 6).alias("median"), F.round("total", 4).alias("total"), "n", "failures")


@query("SELECT m.event_type AS model, p.user_id AS page FROM (SELECT DISTINCT event_type FROM events) m, (SELECT DISTINCT user_id FROM events) p WHERE (m.event_type, p.user_id) NOT IN (SELECT (event_type, user_id) FROM events WHERE value > 50)")
def job_backlog(spark, d):
    ev = table(spark, d, "events").select(F.col("event_type").alias("model"), F.col("user_id").alias("page"), (F.col("value") > 50).alias("ok"))
    return runs.open_jobs(ev.select("model").distinct(), ev.select("page").distinct(), ev)


@query("""WITH c AS (SELECT l_orderkey AS page, l_linenumber AS model, l_returnflag = 'R' AS good, CAST(l_quantity AS INTEGER) AS hits, CAST(l_extendedprice AS BIGINT) AS length FROM lineitem),
  p AS (SELECT g.page, CASE WHEN g.length > b.length THEN 'good_longer' ELSE 'good_shorter' END AS orient, g.model AS good, b.model AS bad, g.hits - b.hits AS margin FROM c g JOIN c b ON g.page = b.page AND g.good AND NOT b.good AND g.length <> b.length AND g.hits > b.hits)
  SELECT page, orient, good, bad, margin FROM p QUALIFY row_number() OVER (PARTITION BY page, orient ORDER BY margin DESC, good, bad) = 1""")
def balanced_pairs(spark, d):
    li = table(spark, d, "lineitem")
    c = li.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("model"), (F.col("l_returnflag") == "R").alias("good"), F.rint("l_quantity").cast("int").alias("hits"), F.rint("l_extendedprice").cast("long").alias("length"))  # halves go to even numbers, as in SQL
    return runs.balanced_pairs(c)


@query("""WITH t AS (SELECT event_type AS judge, user_id % 2 = 0 AS short, value > 40 AS good, event_id % 3 = 0 AS long_good FROM events)
  SELECT judge, count(*) AS n, CAST(count_if(good) AS BIGINT) AS k, round(count_if(good) / count(*), 6) AS rate, round(avg(CASE WHEN short THEN CAST(good AS INTEGER) END), 6) AS good_shorter, round(avg(CAST(good = long_good AS INTEGER)), 6) AS longer FROM t GROUP BY 1""")
def pick_rates(spark, d):
    good = F.when(F.col("value") > 40, "good").otherwise("bad")
    t = table(spark, d, "events").select(F.col("event_type").alias("judge"), F.when(F.col("user_id") % 2 == 0, "good_shorter").otherwise("good_longer").alias("orient"), good.alias("picked"), F.when(F.col("event_id") % 3 == 0, "good").otherwise("bad").alias("longer"), F.lit(True).alias("ok"))
    r = runs.pick_rates(t)
    return r.select("judge", "n", "k", *(F.round(c, 6).alias(c) for c in ("rate", "good_shorter", "longer")))


@query("""WITH o AS (SELECT 2 * median(o_totalprice) AS two FROM orders), j AS (SELECT l_returnflag AS judge, median(l_extendedprice) + two AS cost FROM lineitem, o GROUP BY 1, two)
  SELECT judge, round(cost, 4) AS cost, round(cost / (SELECT min(cost) FROM j) - 1, 6) AS above_least FROM j""")
def cost_model(spark, d):
    ocr = table(spark, d, "orders").select(F.col("o_totalprice").alias("cost"))
    judge = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("judge"), F.col("l_extendedprice").alias("cost"))
    return runs.cost_model(ocr, judge).select("judge", F.round("cost", 4).alias("cost"), F.round("above_least", 6).alias("above_least"))


@query("SELECT o_orderpriority AS model, round(avg(CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice > 100000 AS INTEGER) END), 6) AS O, round(avg(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice > 100000 AS INTEGER) END), 6) AS F FROM orders GROUP BY 1")
def accuracy_matrix(spark, d):
    hits = table(spark, d, "orders").select(F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("page"), (F.col("o_totalprice") > 100000).alias("hit"))
    return runs.accuracy_matrix(hits, ["O", "F"]).select("model", F.round("O", 6).alias("O"), F.round("F", 6).alias("F"))


@query("SELECT p_partkey, CAST(unnest(generate_series(p_size - 1, p_size + 1)) AS INTEGER) AS page FROM part UNION ALL SELECT p_partkey, CAST(p_partkey - 1 AS INTEGER) FROM part WHERE p_partkey > 0")
def page_spec_expand(spark, d):
    s = lambda c: c.cast("string")
    size = F.col("p_size")
    spec = F.concat(s(size), F.lit("-"), s(size + 2), F.lit(", 9-7,x,"), s(F.col("p_partkey")))
    return table(spark, d, "part").select("p_partkey", F.explode(T.page_spec(spec)).alias("page"))


@query("""SELECT n_nationkey, lower(n_name) AS key, 'page_' || n_nationkey || '.png' AS name, n_nationkey AS page_no, regexp_replace(n_name || ' (1)', '\\W+', '_', 'g') AS file FROM nation""")
def names_and_numbers(spark, d):
    name = F.concat(F.lit("page_"), F.col("n_nationkey").cast("string"), F.lit(".png"))
    return table(spark, d, "nation").select("n_nationkey", F.lower("n_name").alias("key"), name.alias("name"), T.page_number(name).alias("page_no"), T.sanitize_filename(F.concat("n_name", F.lit(" (1)"))).alias("file"))


@query("""WITH l AS (SELECT 0 AS src, c_custkey AS label, CASE WHEN c_acctbal > 5000 THEN c_mktsegment END AS value FROM customer UNION ALL SELECT 1, c_custkey, CASE WHEN c_nationkey > 10 THEN 'nation' END FROM customer UNION ALL SELECT 2, c_custkey, 'default' FROM customer)
  SELECT label, arg_min(value, src) AS value, CAST(min(src) AS INTEGER) AS source, count(*) - 1 AS shadowed FROM l WHERE value IS NOT NULL GROUP BY 1""")
def settings_precedence(spark, d):
    c = table(spark, d, "customer").withColumn("label", F.col("c_custkey"))
    return runs.settings([c.select("label", F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")).alias("value")), c.select("label", F.when(F.col("c_nationkey") > 10, "nation").alias("value")), c.select("label", F.lit("default").alias("value"))])


@query("""WITH t AS (SELECT CASE doc_id % 4 WHEN 0 THEN ' [ERROR: x] ' || text WHEN 1 THEN chr(10) || '[INFO: none]' WHEN 2 THEN '  ' ELSE text END AS text FROM documents)
  SELECT CASE WHEN trim(text) = '' THEN 'empty' WHEN starts_with(ltrim(regexp_replace(text, '^\\s+', '')), '[ERROR:') THEN 'error' WHEN starts_with(regexp_replace(text, '^\\s+', ''), '[INFO:') THEN 'info' ELSE 'success' END AS class, count(*) AS n FROM t GROUP BY 1""")
def ocr_classes(spark, d):
    n = F.col("doc_id") % 4
    text = F.when(n == 0, F.concat(F.lit(" [ERROR: x] "), "text")).when(n == 1, "\n[INFO: none]").when(n == 2, "  ").otherwise(F.col("text"))
    return table(spark, d, "documents").groupBy(T.ocr_class(text).alias("class")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, CAST(round_even(l_quantity / 50 * 24, 0) AS INTEGER) AS filled FROM lineitem")
def progress_bars(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.progress("l_quantity", F.lit(50.0))[1].alias("filled"))


@query("""SELECT item_id, CAST(form AS INTEGER) AS form, ['direct', 'markdown_fence', 'brace_match', 'truncated_recovery', 'direct', 'all_failed'][form + 1] AS strategy, CAST(CASE WHEN form < 4 THEN 1 ELSE 0 END AS INTEGER) AS n_cards,
  CASE WHEN form < 4 THEN md5(text) END AS front FROM benchmark, (SELECT unnest(range(6)) AS form)""")
def json_repair_replies(spark, d):
    """Each item's card as it is, in a fence, in prose and cut short; an object without cards; and text that is none."""
    item = table(spark, d, "benchmark")
    good = F.to_json(F.struct(F.array(F.struct(F.col("text").alias("front"), F.lit("b").alias("back"))).alias("new_cards")))
    forms = F.array(good, F.concat(F.lit("Here:\n```json\n"), good, F.lit("\n```")), F.concat(F.lit("so "), good, F.lit(" ok")), F.expr("substring(g, 1, length(g) - 2)"), F.lit('{"a": "\\Sigma",}'), F.col("text"))
    rows = item.withColumn("g", good).select("item_id", F.posexplode(forms).alias("form", "reply"))
    parsed = json_repair.parse_reply("reply")
    return rows.select("item_id", "form", parsed.alias("p")).select("item_id", "form", "p.strategy", "p.n_cards", F.md5(F.get_json_object("p.payload", "$.new_cards[0].front")).alias("front"))


@query()
def order_scores(spark, d):
    c = table(spark, d, "conversations")
    a, b = c.filter("role = 'user'"), c.filter("role = 'assistant'").withColumnRenamed("text", "reply").withColumn("turn", F.col("turn") - 1)
    return a.join(b.select("conv_id", "turn", "reply"), ["conv_id", "turn"]).select("conv_id", "turn", similarity.order_score_udf("text", "reply").alias("score"))


@query()
def close_names(spark, d):
    names = sorted(r[0] for r in table(spark, d, "nation").select("n_name").collect())
    asked = table(spark, d, "nation").select("n_nationkey", F.lower(F.substring("n_name", 2, 20)).alias("said"))
    return asked.withColumn("suggested", F.array_join(similarity.close_names([n.lower() for n in names])("said"), ","))


@query(r"""WITH t AS (SELECT item_id, text, regexp_extract_all(regexp_replace(text, '[*_`#>|\\]', ' ', 'g'), '[0-9A-Za-zÄÖÜäöüß_.,()\-+*/=<>%]+') AS w FROM benchmark)
  SELECT item_id, array_to_string(list_filter(list_transform(w, lambda x: lower(trim(x, '.,()'))), lambda x: x <> ''), ' ') AS tokens, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS flat FROM t""")
def normal_tokens(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(similarity.tokens_udf("text"), " ").alias("tokens"), F.md5(similarity.flat_udf("text")).alias("flat"))
