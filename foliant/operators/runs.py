"""Runs: page states and their resumption, ensembles of candidates, telemetry, concurrency, statistics of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .order import lay, running
from .shared import kept

# ---- page states -------------------------------------------------------------------------------------------------------------------------------------


def resume_pages(images: DataFrame, state: DataFrame, output: DataFrame, paused: DataFrame | None = None) -> DataFrame:
    """doc, image, status, attempts_used, text, note for every image, from the stored state and the sections written before.

    images: doc, image. state: doc, image, status, attempts_used, candidates. output: doc, image, body. paused: doc of runs that were paused.
    """
    rows = images.join(state, ["doc", "image"], "left").join(output.select("doc", "image", "body"), ["doc", "image"], "left")
    stopped = F.lit(False)
    if paused is not None:
        rows = rows.join(paused.select("doc").distinct().withColumn("_paused", F.lit(True)), "doc", "left")
        stopped = F.coalesce("_paused", F.lit(False))
    ok = T.ocr_class("body") == "success"
    has = F.coalesce(F.size("candidates") > 0, F.lit(False))
    again = stopped & (F.coalesce("status", F.lit("")) != "done")
    stays_done = (F.col("status") == "done") & ok
    waits = (F.col("status") == "judge_pending") & has & ok
    lost = F.col("status").isin("done", "judge_pending")
    attempts = F.coalesce("attempts_used", F.lit(0))
    return rows.select(
        "doc",
        "image",
        F.when(again, "pending").when(stays_done, "done").when(waits, "judge_pending").otherwise("pending").alias("status"),
        F.when(again, 0).when(stays_done | waits, attempts).when(lost, 0).otherwise(attempts).cast("int").alias("attempts_used"),
        F.when(~again & (stays_done | waits), F.col("body")).alias("text"),
        F.when(~again & lost & ~(stays_done | waits), "stored text was not usable").alias("note"),
    )


def next_state(cycles: DataFrame, budget: int = 40) -> DataFrame:
    """The state after one cycle of a page: attempts_used (before), outcome (success, failed, judge_pending) to status, attempts_used, backoff (seconds)."""
    used = F.col("attempts_used") + 1
    status = F.when(F.col("outcome") == "success", "done").when(F.col("outcome") == "judge_pending", "judge_pending").when(used >= budget, "paused").otherwise("pending")
    return cycles.withColumns({"status": status, "attempts_used": used.cast("int"), "backoff": F.when(status == "pending", F.least(F.lit(5.0), 0.5 * used)).otherwise(0.0)})


def run_status(pages: DataFrame) -> DataFrame:
    """doc, run_status and tallies over its pages; a run with judge-pending pages keeps its state."""
    of = lambda s: F.count_if(F.col("status") == s)
    n = pages.groupBy("doc").agg(of("done").alias("done"), of("pending").alias("pending"), of("judge_pending").alias("judge_pending"), of("paused").alias("paused"))
    return n.withColumn("run_status", F.when(F.col("paused") > 0, "paused").when(F.col("pending") > 0, "running").when(F.col("judge_pending") > 0, "completed_with_judge_pending").otherwise("completed"))


def resume_source(sources: DataFrame) -> DataFrame:
    """doc, kind, path: live state that isn't completed, then archived (newest first), then live completed, then legacy output; `fresh` where none is."""
    order = F.when((F.col("kind") == "live") & (F.col("run_status") != "completed"), 0).when(F.col("kind") == "archived", 1).when(F.col("kind") == "live", 2).when(F.col("kind") == "legacy", 3).otherwise(4)
    w = Window.partitionBy("doc").orderBy(order, F.desc("mtime"), "path")
    return sources.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("doc", F.when(order == 4, "fresh").otherwise(F.col("kind")).alias("kind"), "path")


def compatible(state: DataFrame, images: DataFrame, version: int) -> DataFrame:
    """doc, compatible: schema version and fingerprint are the same, and the state has every image. state: doc, schema_version, fingerprint, wanted, images."""
    missing = images.groupBy("doc").agg(F.collect_set("image").alias("_all"))
    rows = state.join(missing, "doc", "left")
    return rows.select("doc", ((F.col("schema_version") == version) & (F.col("fingerprint") == F.col("wanted")) & (F.size(F.array_except(F.coalesce("_all", F.array().cast("array<string>")), "images")) == 0)).alias("compatible"))


# ---- ensembles ---------------------------------------------------------------------------------------------------------------------------------------


def ensemble_calls(pages: DataFrame, models: DataFrame) -> DataFrame:
    """A row for each call: page x model (ord, model, repeat) x repetition, with its place."""
    calls = models.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.col("repeat"))))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ord", "attempt"))  # a model list, few rows
    return pages.crossJoin(calls.withColumn("place", place).select("place", "model", "attempt"))


def judge_outcome(replies: DataFrame, with_judge: bool = True) -> DataFrame:
    """page, text, outcome of its replies (page, place, text, finish) and, if asked for, the judge's (page, judged, finish_judge).

    A reply that was cut off counts as an error. One reply is the outcome itself; of several, the judge's text if it is complete and usable, else the first
    valid one and judge_pending. Without a judge the first reply counts.
    """
    text = F.when(F.col("finish") == "length", "[ERROR: truncated]").otherwise(F.col("text"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", text.alias("t")))), lambda s: s.t)
    judged = [F.max("judged").alias("judged"), F.max("finish_judge").alias("finish_judge")] if with_judge else [F.lit(None).cast("string").alias("judged"), F.lit(None).cast("string").alias("finish_judge")]
    rows = replies.groupBy("page").agg(listed.alias("all"), *judged)
    valid = F.filter("all", T.valid_candidate)
    first = F.coalesce(F.try_element_at(valid, F.lit(1)), F.element_at("all", 1))
    settled = F.col("judged").isNotNull() & (F.coalesce("finish_judge", F.lit("stop")) != "length") & (T.ocr_class("judged") == "success")
    one = F.size("all") == 1
    out = F.when(one | F.lit(not with_judge), F.element_at("all", 1)).when(settled, F.col("judged")).otherwise(first)
    ok = T.ocr_class(out) == "success"
    status = F.when(~ok, "failed").when(one | F.lit(not with_judge) | settled, "success").otherwise("judge_pending")
    return rows.select("page", F.size("all").alias("replies"), F.size(valid).alias("valid"), out.alias("text"), status.alias("outcome"))


# ---- telemetry ---------------------------------------------------------------------------------------------------------------------------------------


def usage(response: Column | str = "response") -> Column:
    """Model, tokens, cost and error of a response, with 0 or unknown where it says nothing."""
    r = F.col(response) if isinstance(response, str) else response
    zero = lambda c, kind: F.coalesce(c.cast(kind), F.lit(0).cast(kind))
    return F.struct(
        F.coalesce(r["model"], F.lit("unknown")).alias("model"),
        zero(r["usage"]["prompt_tokens"], "bigint").alias("prompt_tokens"),
        zero(r["usage"]["completion_tokens"], "bigint").alias("completion_tokens"),
        zero(r["usage"]["prompt_tokens_details"]["cached_tokens"], "bigint").alias("cached_tokens"),
        zero(r["usage"]["cost"], "double").alias("cost"),
        r["error"].alias("error"),
    )


def run_summary(phases: DataFrame) -> DataFrame:
    """run_id, cost (8 places), calls (without errors), errors (in order), seconds (3 places) of runs from phases with llm_calls (model, cost, error)."""
    calls = phases.select("run_id", "started_at", "phase", F.posexplode_outer("llm_calls").alias("at", "c"))
    cost = calls.groupBy("run_id").agg(
        F.round(F.sum(F.when(F.col("c.error").isNull(), F.coalesce("c.cost", F.lit(0.0))).otherwise(0.0).cast("decimal(20,10)")), 8).alias("cost"),
        F.count_if(F.col("c").isNotNull() & F.col("c.error").isNull()).alias("calls"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("c.error").isNotNull(), F.struct("started_at", "phase", "at", F.col("c.error").alias("e"))))), lambda s: s.e).alias("errors"),
    )
    span = phases.groupBy("run_id").agg(F.round((F.unix_micros(F.max(F.col("finished_at").cast("timestamp"))) - F.unix_micros(F.min(F.col("started_at").cast("timestamp")))) / 1e6, 3).alias("seconds"), F.max(F.when(F.col("status") == "error", 1).otherwise(0)).cast("boolean").alias("failed"))
    return cost.join(span, "run_id")


def last_n(df: DataFrame, key: str, order: str, n: int = 30) -> DataFrame:
    """The last n rows of each key; back counts from the last."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= n)


def recommend(log: DataFrame, recent: int = 30, clean: int = 3, most: int = 16) -> DataFrame:
    """model, concurrency to use next: half after a pause, one less after errors, one more after `clean` clean runs at the last level.

    log: model, pos, concurrency, errors, paused.
    """
    rows = last_n(log, "model", "pos", recent)
    bad = F.coalesce("paused", F.lit(False)) | (F.coalesce("errors", F.lit(0)) > 0)
    level = F.first("concurrency").over(Window.partitionBy("model").orderBy("back"))
    per = rows.withColumns({"_level": level, "_ends": F.when(bad | (F.col("concurrency") != level), F.col("back"))}).groupBy("model").agg(
        F.max("_level").alias("level"), (F.coalesce(F.min("_ends"), F.max("back") + 1) - 1).alias("streak"), F.max(F.when(F.col("back") == 1, F.coalesce("paused", F.lit(False)))).alias("paused"), F.max(F.when(F.col("back") == 1, F.coalesce("errors", F.lit(0)))).alias("errors")
    )
    c = F.col("level")
    return per.select("model", F.when(F.col("paused"), F.greatest(F.lit(1), F.floor(c / 2))).when(F.col("errors") > 0, F.greatest(F.lit(1), c - 1)).when(F.col("streak") >= clean, F.least(F.lit(most), c + 1)).otherwise(c).cast("int").alias("concurrency"), "streak")


def with_seed(models: DataFrame, advice: DataFrame, seed: int = 4) -> DataFrame:
    """Every model; those without a log start at the seed."""
    return models.join(advice, "model", "left").withColumn("concurrency", F.coalesce("concurrency", F.lit(seed)))


def history(turns: DataFrame, conv: str = "conv_id", order: str = "turn", failed: Column | None = None) -> DataFrame:
    """Adds prior: the turns before each one, in order. Turns for which `failed` holds (what was asked and got no answer) leave the history again: they are in nobody's prior."""
    w = Window.partitionBy(conv).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    said = F.struct("role", "text")
    return turns.withColumn("prior", F.collect_list(said if failed is None else F.when(~F.coalesce(failed, F.lit(False)), said)).over(w))


# ---- statistics --------------------------------------------------------------------------------------------------------------------------------------


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The score interval of k hits of n, within 0 and 1; (0, 0) for n = 0.

    Its centre is the share after z * z more trials, half of them hits; its spread is that of k hits and n - k misses, widened by z * z / 4.
    """
    more = z * z
    centre = (k + more / 2) / (n + more)
    spread = z / (n + more) * F.sqrt(k * (n - k) / n + more / 4)
    inside = lambda x: F.when(n > 0, F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return inside(centre - spread), inside(centre + spread)


def medians(rows: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """g (a value of `by`, or 0), median of `value` (halfway between the two in the middle), exactly; nulls are left out, and a group of nothing else is absent.

    Approximate quantiles bracket the middle; what lies below is counted, and only values inside are told apart, their counts running over ranges of the order, so no task holds the
    values of a group. Should a bracket miss its middle, all values are inside.
    """
    told = rows.select((F.col(by) if by else F.lit(0)).alias("g"), F.col(value).cast("double").alias("v")).filter("v is not null")
    near = told.groupBy(F.col("g").alias("h")).agg(F.percentile_approx("v", F.array(F.lit(0.499), F.lit(0.501)), 10_000).alias("q")).select("h", F.col("q")[0].alias("a"), F.col("q")[1].alias("b"))
    met = told.join(F.broadcast(kept(near)), F.col("g").eqNullSafe(F.col("h")))  # one row a group
    around = kept(met.groupBy("g").agg(F.count("*").alias("total"), F.count_if(F.col("v") < F.col("a")).alias("below"), F.count_if(F.col("v") <= F.col("b")).alias("upto")))
    one, two = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    if around.filter((F.col("below") >= one) | (F.col("upto") < two)).isEmpty():
        inside = met.filter("v between a and b")
    else:
        inside, around = told, around.withColumn("below", F.lit(0))
    counts = running(lay(inside.groupBy("g", "v").agg(F.count("*").alias("n")), "g", "v", keep=kept), ["g"], {"upto": ("sum", F.col("n"))}).rows
    placed = counts.join(F.broadcast(around.select(F.col("g").alias("h"), "total", "below")), F.col("g").eqNullSafe(F.col("h"))).withColumn("upto", F.col("upto") + F.col("below"))
    holds = lambda k: (F.col("upto") - F.col("n") < k) & (F.col("upto") >= k)
    return placed.filter(holds(one) | holds(two)).groupBy("g").agg(((F.min("v") + F.max("v")) / 2).alias("median"))


def model_stats(results: DataFrame, model: str = "model", value: str = "value") -> DataFrame:
    """mean, least, median (interpolated), sum, number, failures."""
    v = F.col(value)
    told = results.groupBy(F.col(model).alias("_model")).agg(F.avg(v).alias("mean"), F.min(v).alias("least"), F.sum(v).alias("total"), F.count(v).alias("n"), F.count_if(~F.col("ok")).alias("failures"))
    rows = told.join(medians(results, value, model), F.col("_model").eqNullSafe(F.col("g")), "left")
    return rows.select(F.col("_model").alias(model), "mean", "least", "median", "total", "n", "failures")


def open_jobs(models: DataFrame, pages: DataFrame, done: DataFrame) -> DataFrame:
    """Every model and page without a successful result. models is a list of bounded size."""
    jobs = pages.select("page").crossJoin(models.select("model"))
    return jobs.join(done.filter("ok").select("model", "page"), ["model", "page"], "left_anti")


def balanced_pairs(candidates: DataFrame) -> DataFrame:
    """page, orient, good, bad: of good and bad candidates of a page with the good one shorter, or longer, the pair of largest margin of hits; of equal ones that of the smaller good name, then of the smaller bad one.

    candidates: page, model, good (boolean), hits, length. For one orientation only the best partner by length counts, so pairs come from running
    extremes over candidates sorted by length, not from all combinations.
    """
    known = candidates.dropna(subset=["page", "good", "hits", "length"])
    w = Window.partitionBy("page").orderBy("length")
    # of the bad ones strictly shorter (longer), the one with the fewest hits, then the smaller name, null last
    key = F.when(~F.col("good"), F.struct("hits", F.col("model").isNull().alias("none"), "model"))
    shorter = F.min(key).over(w.rangeBetween(Window.unboundedPreceding, -1))
    longer = F.min(key).over(w.rangeBetween(1, Window.unboundedFollowing))
    rows = known.withColumns({"a": shorter, "b": longer}).filter("good")
    each = rows.select("page", "model", "hits", F.explode(F.array(F.struct(F.lit("good_longer").alias("orient"), F.col("a").alias("bad")), F.struct(F.lit("good_shorter").alias("orient"), F.col("b").alias("bad")))).alias("x")).filter("x.bad is not null")
    margin = F.col("hits") - F.col("x.bad.hits")
    n = F.row_number().over(Window.partitionBy("page", "x.orient").orderBy(F.desc("_m"), F.asc_nulls_last("model"), F.asc_nulls_last("x.bad.model")))
    return each.withColumn("_m", margin).filter("_m > 0").withColumn("_n", n).filter("_n = 1").select("page", F.col("x.orient").alias("orient"), F.col("model").alias("good"), F.col("x.bad.model").alias("bad"), F.col("_m").alias("margin"))


def pick_rates(trials: DataFrame) -> DataFrame:
    """judge, n, picked rate and its interval, rates by orientation, and how often the longer one was picked."""
    good = (F.col("picked") == "good").cast("int")
    out = trials.filter("ok").groupBy("judge").agg(F.count("*").alias("n"), F.sum(good).alias("k"), F.avg(F.when(F.col("orient") == "good_shorter", good)).alias("good_shorter"), F.avg(F.when(F.col("orient") == "good_longer", good)).alias("good_longer"), F.avg((F.col("picked") == F.col("longer")).cast("int")).alias("longer"))
    low, high = wilson(F.col("k"), F.col("n"))
    return out.withColumns({"rate": F.col("k") / F.col("n"), "low": low, "high": high})


def cost_model(ocr: DataFrame, judge: DataFrame) -> DataFrame:
    """judge, cost of a page with two recognitions and one judgement by median costs, and the difference to the first judge by cost."""
    base = medians(ocr, "cost").select((2 * F.col("median")).alias("two"))
    each = judge.select("judge").distinct().join(medians(judge, "cost", "judge"), F.col("judge").eqNullSafe(F.col("g")), "left")
    each = each.join(F.broadcast(base), how="left").select("judge", (F.col("two") + F.col("median")).alias("cost"))
    low = each.agg(F.min("cost").alias("least"))
    return each.join(F.broadcast(low)).select("judge", "cost", (F.col("cost") / F.col("least") - 1).alias("above_least"))


def accuracy_matrix(hits: DataFrame, pages: list[str]) -> DataFrame:
    """model by page: share of hits."""
    return hits.groupBy("model").pivot("page", pages).agg(F.avg(F.col("hit").cast("int")))


def missed_values(hits: DataFrame) -> DataFrame:
    """model, page, hits, total, missed (labels in order) of hits (model, page, label, hit)."""
    lost = F.array_sort(F.collect_list(F.when(~F.coalesce("hit", F.lit(False)), F.col("label"))))
    return hits.groupBy("model", "page").agg(F.count_if("hit").alias("hits"), F.count("*").alias("total"), lost.alias("missed"))


def differing(trials: DataFrame) -> DataFrame:
    """judge, differing: of pairs shown in both orders, in how many the judge picked differently. trials: judge, pair, shown, picked."""
    per = trials.filter("ok").groupBy("judge", "pair").agg(F.count_distinct("picked").alias("n"))
    return per.groupBy("judge").agg(F.count_if(F.col("n") > 1).alias("differing"), F.count("*").alias("pairs"))


def settings(levels: list[DataFrame]) -> DataFrame:
    """label, value, source, shadowed from levels (label, value) of falling precedence."""
    rows = levels[0].withColumns({"source": F.lit(0)})
    for i, level in enumerate(levels[1:], 1):
        rows = rows.unionByName(level.withColumn("source", F.lit(i)))
    set_ = rows.filter(F.col("value").isNotNull())
    return set_.groupBy("label").agg(F.min_by("value", "source").alias("value"), F.min("source").alias("source"), (F.count("*") - 1).alias("shadowed"))
