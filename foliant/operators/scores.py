"""Scores of recognised pages against what is known of them: labels and the numbers behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import numbers_behind, order_score_udf, tokens_udf
from .cluster import multiset_recall

# Fixed value: the characters behind a label in which its value must stand.
WINDOW = 90

def label_hits(truth: DataFrame, pages: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """truth (page, label, value) against pages (page, text and what else tells results apart, such as a model): hit says whether the number `value` stands within `window` characters behind an occurrence of `label`, in any case.

    Pages without a result, null texts and empty or null labels are no hit. Texts are read in compatibility forms with single spaces; a number that the window cuts counts as what
    of it is inside. Repeated rows count once. A page meets all its labels in one row, so it is read once, and a label that turns up very often costs what is around it alone.
    """
    keys = [c for c in pages.columns if c != text]
    told = truth.select("page", "label", "value").distinct().groupBy("page").agg(F.collect_list(F.struct("label", "value")).alias("asked"))
    texts = pages.select(*keys, F.coalesce(text, F.lit("")).alias("text")).groupBy(*keys).agg(F.collect_set("text").alias("texts"))
    met = told.join(texts, "page", "left")
    found = numbers_behind(window)("texts", F.transform("asked", lambda x: x.label), F.transform("asked", lambda x: x.value))
    return met.select(*keys, F.explode(F.arrays_zip("asked", found.alias("found"))).alias("x")).select(*keys, "x.asked.label", "x.asked.value", F.coalesce("x.found", F.lit(False)).alias("hit"))


def score_rows(truth: DataFrame, known: DataFrame, results: DataFrame, order: bool = True) -> DataFrame:
    """model, page, recall, hits, total, missed, cut, and order if asked for: one row a result (model, page, text, ok, finish), against the page's text in `truth` (page, text) and its labels in `known` (page, label, value).

    A result that isn't ok has no scores; pages without truth or without known values have none of that kind. cut says whether the token limit ended the text. Of several results of a model and page each is scored by itself only
    if `text` differs; order is the share of the truth's tokens in matching blocks, in Arrow batches.
    """
    good = results.filter("ok").select("model", "page", "text").distinct()
    tokens = lambda df: df.select(F.struct("model", "page").alias("key"), tokens_udf("text").alias("tokens"))
    asked = good.select("model", "page").join(truth, "page")
    recall = multiset_recall(tokens(asked), tokens(good), "key").select("key.*", "recall")
    hits = page_scores(label_hits(known, good), ("model", "page"))
    rows = results.select("model", "page", F.coalesce("ok", F.lit(False)).alias("ok"), (F.col("ok") & F.col("finish").eqNullSafe(F.lit("length"))).alias("cut")).distinct()
    rows = rows.join(recall, ["model", "page"], "left").join(hits, ["model", "page"], "left")
    names = ["model", "page", "ok", "cut", "recall", "hits", "total", "missed"]
    if order:
        both = good.join(truth.select("page", F.col("text").alias("truth")), "page")
        rows = rows.join(both.select("model", "page", order_score_udf("truth", "text").alias("order")), ["model", "page"], "left")
        names.append("order")
    return rows.select(*names)


def page_scores(hits: DataFrame, by: tuple[str, ...] = ("page",)) -> DataFrame:
    """hits, total, missed (label=value, ascending): one row for each result of a page with known values."""
    missed = F.array_sort(F.collect_list(F.when(~F.col("hit"), F.concat("label", F.lit("="), "value"))))
    return hits.groupBy(*by).agg(F.sum(F.col("hit").cast("long")).alias("hits"), F.count("*").alias("total"), missed.alias("missed"))
