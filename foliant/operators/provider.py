"""Calls to models as data: a request table joined with a response table. Replay needs nothing else; other providers fill the table."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources import readers, writers

RESPONSE = "request_id string, content string, finish_reason string, error string"


def request_id(*columns: str):
    """A stable identifier of a request: what is asked, not when."""
    return F.sha2(F.concat_ws("\u0001", *columns), 256)


class ModelProvider(Protocol):
    def answer(self, requests: DataFrame) -> DataFrame:
        """requests (request_id, prompt, ...) with content, finish_reason and error."""
        ...


class Replay:
    """Answers from a table of recorded responses; a request that isn't there gets an error."""

    def __init__(self, responses: DataFrame):
        self.responses = responses

    def answer(self, requests: DataFrame) -> DataFrame:
        found = requests.join(self.responses.select("request_id", "content", "finish_reason", "error"), "request_id", "left")
        return found.withColumn("error", F.when(F.col("content").isNull() & F.col("error").isNull(), "not recorded").otherwise(F.col("error")))


class Stub:
    """Answers by a rule from prompt to text, for tests. Rows are asked in batches on the executors."""

    def __init__(self, rule: Callable[[str], str]):
        self.rule = rule

    def answer(self, requests: DataFrame) -> DataFrame:
        rule = self.rule

        @F.pandas_udf("string")
        def say(prompts: pd.Series) -> pd.Series:
            return prompts.map(rule)

        return requests.withColumns({"content": say("prompt"), "finish_reason": F.lit("stop"), "error": F.lit(None).cast("string")})


class Ingestor(Protocol):
    def ingest(self, sources: DataFrame) -> DataFrame:
        """sources (file, text) to new records (front, back, collection, category, source)."""
        ...


class TextIngestor:
    """Asks a provider for candidates from all the texts together and reads them from its reply, however that is wrapped."""

    def __init__(self, provider: ModelProvider, prompt: str = "{text}"):
        self.provider, self.prompt = provider, prompt

    def ingest(self, sources: DataFrame) -> DataFrame:
        joined = readers.joined_texts(sources).withColumn("prompt", F.replace(F.lit(self.prompt), F.lit("{text}"), F.col("text")))
        asked = joined.select(request_id("prompt").alias("request_id"), "prompt")
        answered = self.provider.answer(asked).filter("error is null")
        return readers.candidates(answered.select(F.col("request_id").alias("file"), text.strip_fence("content").alias("value"))).drop("file", "pos")


class Exporter(Protocol):
    def export(self, cards: DataFrame, dimension: DataFrame, path: str) -> DataFrame:
        """Writes cards by collection under `path`; what was written, as rows."""
        ...


class CollectionExporter:
    """Files of JSON lines, a folder a collection; gives filename and rows of each, in plain order of names."""

    def export(self, cards: DataFrame, dimension: DataFrame, path: str) -> DataFrame:
        writers.write_collections(cards, dimension, path)
        return writers.collection_files(cards, dimension).groupBy("filename").agg(F.count("*").alias("rows")).orderBy("filename")


#: What a tool of the discovery loop is given and gives: the sources, an argument, and a text.
Tool = Callable[[DataFrame, str], str]


def discover(turns: Callable[[list[dict]], dict], tools: dict[str, Tool], sources: DataFrame, most: int = 20) -> tuple[dict | None, list[dict]]:
    """A bounded conversation with a model that may call one tool a turn: its last answer (null if it gave none) and what was said.

    turns: what was said so far to {"tool": name, "argument": text} or {"result": ...}. Of several calls in a turn (`tools`) the first is run and the others are told to wait;
    an unknown tool and one that fails give their error as the result. On the last turn but one the model is told to finish.
    """
    said: list[dict] = []
    for n in range(most):
        reply = turns(said)
        if "result" in reply:
            return reply["result"], said
        calls = reply.get("tools") or [reply]
        name, argument = calls[0].get("tool"), calls[0].get("argument", "")
        try:
            result = tools[name](sources, argument) if name in tools else f"no such tool: {name}"
        except Exception as e:  # a tool's failure is an answer like others
            result = f"failed: {e}"
        said.append({"tool": name, "argument": argument, "result": result})
        said += [{"tool": c.get("tool"), "argument": c.get("argument", ""), "result": "deferred: one tool a turn"} for c in calls[1:]]
        if n == most - 2:
            said.append({"tool": None, "argument": "", "result": "this is the last turn: answer now"})
    return None, said
