"""Checks of a deck and of the files derived from it: balance, categories, keys, counts, markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def balance_warnings(cards: DataFrame, least: int = 20) -> DataFrame:
    """collection, n, median (the upper one), threshold, of collections far below the median; none for small or single ones."""
    per = cards.groupBy("collection").agg(F.count("*").alias("n"))
    counts = F.array_sort(F.collect_list("n"))
    # one number a collection; collections are few beside cards
    whole = per.agg(F.sum("n").alias("total"), F.count("*").alias("groups"), counts.alias("c")).filter((F.col("total") > least) & (F.col("groups") >= 2))
    median = F.element_at("c", (F.floor(F.col("groups") / 2) + 1).cast("int"))
    limit = whole.select(median.alias("median")).withColumn("threshold", F.greatest(F.lit(3), F.floor(F.col("median") * 15 / 100)).cast("long"))
    return per.join(F.broadcast(limit), F.col("n") < F.col("threshold"))


def category_collapse(cards: DataFrame, least: int = 5) -> DataFrame:
    per = cards.groupBy("collection").agg(F.count("*").alias("n"), F.count_distinct(F.coalesce("category", F.lit(""))).alias("categories"), F.min(F.coalesce("category", F.lit(""))).alias("category"))
    return per.filter((F.col("n") >= least) & (F.col("categories") == 1)).drop("categories")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def compare_files(expected: DataFrame, live: DataFrame, marker: str = "<!-- ANKI_CARD_LIST_START -->") -> DataFrame:
    """filename, status (same, differs, missing, extra). Line ends don't count, nor do order of keys and space in JSON that can be read; of markdown only what follows the marker."""

    def digest(df: DataFrame, name: str) -> DataFrame:
        body = F.replace("content", F.lit("\r\n"), F.lit("\n"))
        after = F.when(F.endswith("filename", F.lit(".md")) & F.contains(body, F.lit(marker)), F.substring_index(body, marker, -1)).otherwise(body)
        said = F.when(F.endswith("filename", F.lit(".json")), F.coalesce(F.to_json(F.try_parse_json(body)), body)).otherwise(after)
        return df.select("filename", F.sha2(said, 256).alias(name))

    both = digest(expected, "a").join(digest(live, "b"), "filename", "full_outer")
    return both.select("filename", F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") == F.col("b"), "same").otherwise("differs").alias("status"))


def one_sided(expected: DataFrame, actual: DataFrame, key: str, tolerated: str = r"^collection_\d+_Orphan") -> DataFrame:
    """Keys of one side only; extra ones of a tolerated form pass."""
    a = expected.select(key).distinct().join(actual.select(key), key, "left_anti").withColumn("side", F.lit("missing"))
    b = actual.select(key).distinct().join(expected.select(key), key, "left_anti").filter(~F.rlike(key, F.lit(tolerated))).withColumn("side", F.lit("extra"))
    return a.unionByName(b)


def marker_parity(docs: DataFrame, text: str = "text") -> DataFrame:
    """id, starts, ends of each kind of marker, and whether they agree."""
    count = lambda p: F.regexp_count(text, F.lit(p)).cast("long")
    out = docs.withColumns({"collection_starts": count(r"<!-- COLLECTION_\d+_START -->"), "collection_ends": count(r"<!-- COLLECTION_\d+_END -->"), "card_starts": count("<!-- CARDS_START -->"), "card_ends": count("<!-- CARDS_END -->")})
    return _with_parity(out)


def marker_parity_of_lines(lines: DataFrame, by: str = "doc") -> DataFrame:
    """The same of texts that come as lines (by, line): counts are summed, so no text is whole anywhere."""
    told = marker_parity(lines.select(by, "line"), "line")
    return _with_parity(told.groupBy(by).agg(*(F.sum(c).alias(c) for c in ("collection_starts", "collection_ends", "card_starts", "card_ends"))))


def _with_parity(out: DataFrame) -> DataFrame:
    return out.withColumn("parity", (F.col("collection_starts") == F.col("collection_ends")) & (F.col("card_starts") == F.col("card_ends")))


def post_checks(cards: DataFrame, files: DataFrame, dimension: DataFrame, markdown: DataFrame) -> DataFrame:
    """check, passed, bad (how many rows offend). files: filename, rows of it; markdown: texts, or their lines (doc, line). Keys may hold capitals."""

    def row(name: str, bad: DataFrame) -> DataFrame:
        return bad.agg(F.count("*").alias("bad")).select(F.lit(name).alias("check"), (F.col("bad") == 0).alias("passed"), "bad")

    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    counts = cards.agg(F.count("*").alias("a")).join(files.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("b")), F.lit(True)).filter("a <> b")
    found = [
        row("marker_parity", (marker_parity_of_lines(markdown) if "line" in markdown.columns else marker_parity(markdown)).filter("not parity")),
        row("file_names", one_sided(dimension.select("filename"), files, "filename")),
        row("count_consistency", counts),
        row("required_fields", cards.filter(empty("front") | empty("back") | empty("guid"))),
        row("hierarchy", cards.filter(~F.coalesce(F.rlike("collection", F.lit(r"^\w+$")) & F.rlike("category", F.lit(r"^[A-Za-z]_\w+$")), F.lit(False)))),
        row("unique_guid", duplicate_keys(cards, "guid")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def fingerprint(files: DataFrame) -> DataFrame:
    """doc, fingerprint: SHA-256 over name|size|mtime of its files in order of names; `missing` for absent ones."""
    one = F.concat_ws("|", "name", F.when(F.col("size").isNull(), "missing").otherwise(F.concat_ws("|", F.col("size").cast("string"), F.col("mtime").cast("string"))))
    return files.groupBy("doc").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", one.alias("x")))), lambda s: s.x), ""), 256).alias("fingerprint"))


def largest_files(files: DataFrame) -> DataFrame:
    """directory, path, size of the largest file of each directory, the first on ties; is_largest marks the largest of all."""
    per = files.groupBy("directory").agg(F.max_by("path", F.struct("size", (-F.col("pos")).alias("p"))).alias("path"), F.max("size").alias("size"), F.max_by("pos", F.struct("size", (-F.col("pos")).alias("p"))).alias("pos"))
    top = per.agg(F.max(F.struct("size", (-F.col("pos")).alias("p"))).alias("t"))
    return per.join(F.broadcast(top)).withColumn("is_largest", (F.col("size") == F.col("t.size")) & (-F.col("pos") == F.col("t.p"))).drop("t", "pos")


def not_contained(truth: DataFrame, pages: DataFrame) -> DataFrame:
    """page, wanted strings (whitespace aside) that the page's text doesn't hold."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return truth.select("page", F.explode("text").alias("wanted")).join(pages.select("page", flat("content").alias("_t")), "page", "left").filter(~F.coalesce(F.contains(F.col("_t"), flat(F.col("wanted"))), F.lit(False))).drop("_t")


def leaderboard(rows: DataFrame, *order: Column, by: str = "model") -> DataFrame:
    """rows with place, in the given order; ties by name. One row a competitor."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order, by)).cast("long"))


def first_k(rows: DataFrame, k: int, by: str, *order: Column | str) -> DataFrame:
    """The first k rows of each group, and how many more there are (more)."""
    w = Window.partitionBy(by)
    ranked = rows.withColumns({"place": F.row_number().over(w.orderBy(*order)), "more": F.greatest(F.count("*").over(w) - k, F.lit(0))})
    return ranked.filter(F.col("place") <= k)
