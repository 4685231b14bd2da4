"""URL filters [native]: pattern rules found through their rarest literal token.

Every rule is a host and the beginning of a path. It is turned into a regular expression and
filed under the one of its whole tokens (host labels; path segments closed by a slash) that the
URLs at hand hold least often. The tokens of a URL fetch candidate rules from that index, and only
those run their expressions. The index is an array of hash bins, so that a look-up costs the
same for six rules and for a hundred thousand, and no URL is shuffled.

Rules enter the plan as one string; Spark splits it, counts the tokens, makes the expressions and gathers the bins. The
finished index, as large as the rules that the caller holds, goes into the plan of the URLs as one string too, which the optimizer turns into the array once.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: (verdict, rule): host, a slash, the beginning of a path.
Rule = tuple[str, str]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both are empty for null and for what has no `://`."""
    rest = F.instr(url, "://") > 0
    tail = F.regexp_extract(url, r"(?s)\A.*?://(.*)\z", 1)
    host = F.translate(F.regexp_extract(tail, r"(?s)\A([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(tail, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.when(rest, host).otherwise(""), F.when(rest, path).otherwise("")


def url_tokens(host: Column, path: Column) -> Column:
    """Whole tokens: `h:` and a label of the host, `p:` and a path segment that a slash closes."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    closed = F.split(path, "/")
    closed = F.slice(closed, F.lit(1), F.greatest(F.size(closed) - 1, F.lit(0)))
    return F.array_distinct(F.concat(labels, F.transform(closed, lambda x: F.concat(F.lit("p:"), x)), F.array(F.lit("any"))))


def rule_table(urls: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """verdict, rule, tokens (as those of a URL; `any` for a rule without), pattern over host and path together, size. A-Z in a rule's host count as small letters, as in a URL's; a rule without a host fits only URLs without one."""
    for verdict, rule in rules:
        if "/" not in rule or verdict not in ("allow", "block") or "\n" in rule:
            raise ValueError(f"not a rule: {verdict!r} {rule!r}")
    lines = F.split(F.lit("\n".join(f"{v} {r}" for v, r in rules)), "\n") if rules else F.array().cast("array<string>")
    told = urls.sparkSession.range(1, numPartitions=1).select(F.explode(lines).alias("line"))
    told = told.select(F.substring_index("line", " ", 1).alias("verdict"), F.expr("substring(line, instr(line, ' ') + 1)").alias("rule"))
    host, path = F.translate(F.substring_index("rule", "/", 1), _UPPER, _LOWER), F.expr("substring(rule, instr(rule, '/'))")
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    closed = F.split(path, "/")
    closed = F.filter(F.slice(closed, F.lit(1), F.size(closed) - 1), lambda x: x != "")
    tokens = F.concat(labels, F.transform(closed, lambda x: F.concat(F.lit("p:"), x)))
    pattern = F.concat(F.lit(r"(?s)\A(?:[^/]*\.)?\Q"), F.replace(F.concat(host, path), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return told.select("verdict", "rule", F.when(F.size(tokens) > 0, tokens).otherwise(F.array(F.lit("any"))).alias("tokens"), pattern.alias("pattern"), F.length("rule").alias("size"))


_BINS = "array<array<struct<token:string,rule:string,verdict:string,pattern:string,size:int>>>"


def rule_index(urls: DataFrame, host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, int]:
    """The bins as a constant, and how many there are. Token counts are taken over all rows, for the rules' tokens only."""
    n = 1 << max(3, (2 * len(rules)).bit_length())
    told = rule_table(urls, rules)
    wanted = told.select(F.explode("tokens").alias("token")).distinct()
    seen = urls.select(F.explode(url_tokens(host, path)).alias("token")).groupBy("token").count()
    often = wanted.join(seen, "token", "left").select("token", F.coalesce("count", F.lit(0)).alias("n"))
    filed = told.select("*", F.explode("tokens").alias("token")).join(often, "token").groupBy("verdict", "rule", "pattern", "size").agg(F.min(F.struct("n", "token")).alias("least"))
    entry = F.struct(F.col("least.token").alias("token"), "rule", "verdict", "pattern", "size")
    bins = filed.groupBy((F.crc32(F.col("least.token").cast("binary")) % n).alias("bin")).agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    every = urls.sparkSession.range(n).join(bins, F.col("id") == F.col("bin"), "left").select("id", F.coalesce("entries", F.array().cast(_BINS[6:-1])).alias("entries"))
    index = every.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("id", "entries"))), lambda b: b.entries)).alias("bins"))
    return F.from_json(F.lit(index.first()["bins"]), _BINS), n  # one row, no larger than the rules are


def filter_urls(pages: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to every row.

    A null url, an empty one and one without `://` have an empty host and path, which no rule with a
    host fits. Without a fitting rule, rule is null and the verdict is `default`. The longest fitting rule wins
    and between equally long ones the one that blocks, then the smaller by code point. A rule given twice counts once.
    Repeated rows are judged alike; columns of the four names are replaced, others stay. An empty table gives an empty one.
    """
    host, path = url_parts(F.col(url))
    bins, n = rule_index(pages, host, path, rules)
    (best,) = fresh([*pages.columns, "host", "path", "rule", "verdict"], "best")
    judged = pages.withColumns({best: F.struct(host.alias("host"), path.alias("path"))}).withColumns({x: F.col(f"{best}.{x}") for x in ("host", "path")})
    found = F.flatten(F.transform(url_tokens(F.col("host"), F.col("path")), lambda t: F.filter(F.element_at(bins, (F.crc32(t.cast("binary")) % n + 1).cast("int")), lambda e: e.token == t)))
    fits = F.filter(found, lambda e: F.rlike(F.concat("host", "path"), e.pattern))
    order = lambda e: F.struct((-e["size"]).alias("a"), (e.verdict == "allow").alias("b"), e["rule"].alias("rule"), e.verdict.alias("verdict"))
    judged = judged.withColumn(best, F.array_min(F.transform(fits, order)))
    return judged.withColumns({"rule": F.col(f"{best}.rule"), "verdict": F.coalesce(F.col(f"{best}.verdict"), F.lit(default))}).drop(best)


def compiled(rules: Sequence[Rule]) -> list[tuple[str, str, re.Pattern]]:
    """The rules for a plain check of one URL, as tests use them."""
    return [(v, r, re.compile(r"(?s)\A(?:[^/]*\.)?" + re.escape(r))) for v, r in rules]
