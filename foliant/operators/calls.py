"""Calls to models: retries, checks before a run, what calls cost, phases, sizes of pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity

# Codes that are worth another try, and seconds before it, of the chat client and of the benchmark's client.
TRANSIENT = (429, 500, 502, 503)
DELAYS = (2.0, 8.0)
BENCH_TRANSIENT = (429, 500, 502, 503, 520, 524)
BENCH_DELAYS = (3.0, 6.0)


def retry_schedule(tries: DataFrame, codes: tuple[int, ...] = TRANSIENT, delays: tuple[float, ...] = DELAYS, jitter: float = 0.25) -> DataFrame:
    """request_id, attempt, code, verdict (ok, retry, failed) and delay in seconds, of the tries that are made.

    tries: request_id, attempt (from 1), code (null or below 400 is good). A transient code is tried again as long as there is a delay left; any other
    ends the request at once, and what is recorded behind its end isn't made. The delay is spread by `jitter` to both sides, by a hash, so reruns agree.
    """
    last = len(delays) + 1
    good = F.col("code").isNull() | (F.col("code") < 400)
    again = ~good & F.col("code").isin(*codes) & (F.col("attempt") < last)
    verdict = F.when(good, "ok").when(again, "retry").otherwise("failed")
    base = F.element_at(F.array(*map(F.lit, delays)), F.least(F.col("attempt"), F.lit(len(delays))).cast("int"))
    spread = F.pmod(F.xxhash64("request_id", "attempt"), F.lit(1 << 20)) / float(1 << 20)
    before = Window.partitionBy("request_id").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    rows = tries.withColumn("verdict", verdict)
    rows = rows.withColumn("over", F.max(F.col("verdict") != "retry").over(before)).filter(~F.coalesce("over", F.lit(False)))
    return rows.select("request_id", "attempt", "code", "verdict", F.when(F.col("verdict") == "retry", base * (1 - jitter + 2 * jitter * spread)).alias("delay"))


def request_outcomes(schedule: DataFrame) -> DataFrame:
    """request_id, outcome (ok, failed, open if its last try waits for another), tries, waited."""
    last = F.max_by("verdict", "attempt")
    return schedule.groupBy("request_id").agg(F.when(last == "retry", "open").otherwise(last).alias("outcome"), F.count("*").alias("tries"), F.coalesce(F.sum("delay"), F.lit(0.0)).alias("waited"))


def unknown_models(configured: DataFrame, catalogue: DataFrame | None, skip: bool = False, most: int = 3) -> DataFrame:
    """model, suggestions (up to `most` close names): configured models that the catalogue doesn't have, each once.

    Without a catalogue, or with an empty one, nothing is known to be wrong. Both tables are small lists; the close names come from whole lists.
    """
    asked = configured.filter(F.coalesce(F.trim("model"), F.lit("")) != "").select("model").distinct()
    if skip or catalogue is None or catalogue.isEmpty():
        return asked.limit(0).withColumn("suggestions", F.array().cast("array<string>"))
    known = catalogue.filter("model is not null").select("model").distinct()
    names = sorted(r["model"] for r in known.collect())  # a provider's list
    return asked.join(known, "model", "left_anti").withColumn("suggestions", similarity.close_names(names, most, 0.5)("model"))


def cost_lines(phases: DataFrame) -> DataFrame:
    """run_id, cost, calls, line of runs from phases with llm_calls (cost, error): here calls with errors count too. No line without calls."""
    calls = phases.select("run_id", F.explode("llm_calls").alias("c"))
    one = calls.groupBy("run_id").agg(F.sum(F.coalesce("c.cost", F.lit(0.0)).cast("decimal(20,10)")).cast("double").alias("cost"), F.count("*").alias("calls"))
    return one.withColumn("line", F.format_string("~$%.3f (%d calls)", "cost", "calls"))


def by_phase(log: DataFrame, start: Column, order: str = "pos", session: str = "session") -> DataFrame:
    """Adds phase: how many rows up to this one begin a phase, so that responses before a reset aren't counted with those behind it."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return log.withColumn("phase", F.sum(F.when(start, 1).otherwise(0)).over(w).cast("long"))


def picked(good: Column, bad: Column) -> Column:
    """Which of two the output is more similar to; the good one on ties."""
    return F.when(good >= bad, "good").otherwise("bad")


def longer(good: Column, bad: Column) -> Column:
    """Which of two texts is longer; the bad one on ties."""
    return F.when(F.length(good) > F.length(bad), "good").otherwise("bad")


def workers(jobs: Column, cores: Column) -> Column:
    """Worker processes: six tenths of the cores, one at least, no more than there are jobs."""
    return F.least(jobs, F.greatest(F.lit(1), F.floor(cores * F.lit(0.6)))).cast("int")


def call_pool(pages: Column, calls: Column, least: int = 5, most: int = 20) -> Column:
    """Threads for calls: one for each call of the pages that run at a time, within bounds."""
    return F.least(F.lit(most), F.greatest(F.lit(least), pages * F.greatest(F.lit(1), calls))).cast("int")
