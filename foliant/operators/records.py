"""Records: integration of a batch, reconciliation of sources, synchronisation, removal and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .order import numbered
from .shared import fresh


def first_of(df: DataFrame, *keys: str, order: str = "pos") -> DataFrame:
    """The first row of each key."""
    (n,) = fresh(df.columns, "n")
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(n, F.row_number().over(w)).filter(F.col(n) == 1).drop(n)


def last_wins(df: DataFrame, key: str, value: str, order: str = "pos") -> DataFrame:
    """One row a key, at its first place, with its last value."""
    return df.groupBy(key).agg(F.min(order).alias(order), F.max_by(value, order).alias(value))


def usable(df: DataFrame, front: str = "front", back: str = "back") -> DataFrame:
    """Rows with a front and a back, and no text that was decoded wrongly."""
    full = lambda c: F.coalesce(T.strip(c), F.lit("")) != ""
    return df.filter(full(front) & full(back) & ~T.has_mojibake(front, back))


def digest(col: Column | str) -> Column:
    """256 bits of a text: what long texts are dealt and compared by."""
    return F.unhex(F.sha2(F.col(col) if isinstance(col, str) else col, 256))


def first_by_text(df: DataFrame, text: str, order: str = "pos") -> DataFrame:
    """The first row of each text. Texts meet by their digests, and a digest's rows are reduced where they are read, so neither long nor frequent texts are dealt."""
    row = F.struct(*df.columns)
    return df.groupBy(digest(text)).agg(F.min_by(row, F.col(order)).alias("row")).select("row.*")


def novel(existing: DataFrame, incoming: DataFrame, front: str = "front", order: str = "pos", key: str | None = None) -> DataFrame:
    """Incoming rows whose normal front is new, the first of each; adds norm_front. `key` is a column of `existing` that holds the digest of its normal front, so that fronts needn't be read."""
    known = existing.select((F.col(key) if key else digest(T.normalize_text(front))).alias("known"))
    named = incoming.withColumn("norm_front", T.normalize_text(front))
    return first_by_text(named.join(known, digest("norm_front") == known["known"], "left_anti"), "norm_front", order)


def find_by_front(cards: DataFrame, asked: DataFrame, front: str = "front", order: str = "pos") -> DataFrame:
    """asked (front) with pos and guid of the first card of the same normal front; null where there is none."""
    have = cards.groupBy(digest(T.normalize_text(front)).alias("k")).agg(F.min(F.col(order)).alias("pos"), F.min_by("guid", order).alias("guid"))
    return asked.withColumn("k", digest(T.normalize_text(front))).join(have, "k", "left").drop("k")


def iso(ts: Column) -> Column:
    """A time as ISO 8601 writes it: microseconds only where there are any."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.date_format(ts, "SSSSSS") != "000000", F.date_format(ts, ".SSSSSS")).otherwise(""))


def to_json_rows(cards: DataFrame, times: tuple[str, ...] = ("created_at", "updated_at")) -> DataFrame:
    """pos, json: each card as a JSON object with all its fields, null ones too, and its times in ISO form."""
    fields = [iso(F.col(c)).alias(c) if c in times else F.col(c) for c in cards.columns if c != "pos"]
    return cards.select("pos", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def category_codes(structure: DataFrame, collection_rank) -> DataFrame:
    """code, collection, category: collections numbered in order, their categories lettered; what a reply such as `3C` is read by. `collection_rank` orders keys.

    From the 27th category of a collection on a number follows the letter (`3A1` to `3Z1`, `3A2`), which `decode_categories` reads only from replies that hold nothing else.
    """
    kinds = structure.filter((F.coalesce("collection", F.lit("")) != "") & (F.coalesce("category", F.lit("")) != "")).select("collection", "category").distinct()
    one = Window.partitionBy(F.lit(0))  # a row a category of a configured outline
    n = F.dense_rank().over(one.orderBy(*collection_rank(F.col("collection"))))
    at = F.row_number().over(Window.partitionBy("collection").orderBy("category")) - 1
    more = F.when(F.col("at") >= 26, F.floor(F.col("at") / 26).cast("string")).otherwise("")
    return kinds.select(n.alias("n"), at.alias("at"), "collection", "category").select(F.concat(F.col("n").cast("string"), F.char(F.col("at") % 26 + 65), more).alias("code"), "collection", "category")


def decode_categories(replies: DataFrame, codes: DataFrame, reply: str = "reply") -> DataFrame:
    """replies with collection and category of the first code in them; null where there is none, or none of the outline's."""
    number, letter = T.category_code(reply)
    whole = F.nullif(F.regexp_extract(F.upper(F.trim(F.col(reply))), r"^0*([1-9][0-9]*[A-Z][1-9][0-9]*)$", 1), F.lit(""))
    return replies.withColumn("code", F.coalesce(whole, F.concat(number.cast("string"), letter))).join(codes, "code", "left")


def append(cards: DataFrame, more: DataFrame) -> DataFrame:
    """Rows of both; a column that one side lacks is null there."""
    return cards.unionByName(more, allowMissingColumns=True)


def next_number(df: DataFrame, key: str = "collection") -> DataFrame:
    """One row, next_number: one more than the largest number of a `name_N_rest` key, 0 without any."""
    second = F.try_element_at(F.split(key, "_"), F.lit(2))
    number = F.when(F.rlike(second, F.lit(r"^[0-9]+$")), second.try_cast("decimal(38,0)"))
    return df.agg((F.coalesce(F.max(number), F.lit(-1)) + 1).cast("long").alias("next_number"))


def route(df: DataFrame, dimension: DataFrame, fallback: str, category: str = "a_Unsortiert") -> DataFrame:
    """Unknown collections go to `fallback`, missing categories to `category`; adds ord (of the dimension, else one more than its largest)."""
    dim = dimension.select(F.col("key").alias("collection"), "ord")
    after = dim.agg(F.coalesce(F.max("ord"), F.lit(0)) + 1).scalar()
    known = df.join(dim, "collection", "left")  # adaptive execution broadcasts it where it is small
    return known.withColumns(
        {
            "collection": F.when(F.col("ord").isNull(), fallback).otherwise(F.col("collection")),
            "category": F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit(category)),
            "ord": F.coalesce("ord", after),
        }
    )


def number(df: DataFrame, offset: DataFrame | None = None, order: str = "pos") -> DataFrame:
    """Running counter n by collection and category, and sort_field. `offset` (collection, category, count) goes on from rows that are there."""
    keys = ["collection", "category"]
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order)).cast("long")
    (before,) = fresh(df.columns, "before")
    if offset is not None:
        df = df.join(offset.select(*keys, F.col("count").alias(before)), keys, "left")
        n = n + F.coalesce(before, F.lit(0))
    out = df.withColumn("n", n).drop(before)
    return out.withColumn("sort_field", T.sort_field(T.sort_key("ord", F.substring("category", 1, 1), "n"), "front"))


def integrate(existing: DataFrame, incoming: DataFrame, dimension: DataFrame, fallback: str, go_on: bool = False, key: str | None = None) -> DataFrame:
    """What of a batch is added: usable, new, first in the batch, routed and numbered. With go_on numbers follow those that exist."""
    offset = existing.groupBy("collection", "category").count() if go_on else None
    return number(route(novel(existing, usable(incoming), key=key), dimension, fallback), offset)


def by_front(df: DataFrame, front: str = "front", back: str = "back", order: str = "pos") -> DataFrame:
    """One row a normal front, dealt by its digest norm_key: its first spelling, first place, and its backs in order and distinct."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("p"), F.col(back).alias("b")))), lambda s: s.b)
    keyed = df.groupBy(digest(T.normalize_text(front)).alias("norm_key"))
    found = keyed.agg(F.min_by(front, order).alias("front"), F.min(order).alias(order), listed.alias("backs"), F.array_sort(F.collect_set(back)).alias("choices"))
    return found.withColumn("norm_front", T.normalize_text("front"))


#: What is done with each side's rows where the sides disagree.
POLICIES = {"conflict": ("first", "drop"), "orphan": ("ignore", "rescue", "drop"), "missing": ("todo", "drop")}


def reconcile(collected: DataFrame, structure: DataFrame, conflict: str = "first", orphan: str = "rescue", missing: str = "todo", decisions: DataFrame | None = None) -> DataFrame:
    """Collections and outline joined on the normal front, both ways.

    state is matched, conflict, orphan (no outline) or missing (no collection); outcome is what the policies, or a row of
    `decisions` (norm_front, back), make of it: kept, rescued, ignored, todo or dropped; back is what is kept.
    """
    for name, chosen in (("conflict", conflict), ("orphan", orphan), ("missing", missing)):
        if chosen not in POLICIES[name]:
            raise ValueError(f"{name}: {chosen!r} is none of {POLICIES[name]}")
    left = by_front(collected).select("norm_key", F.col("front").alias("c_front"), F.col("pos").alias("c_pos"), "choices")
    right = _outline(structure, "front", "collection", "category", "sort_key")
    both = left.join(right.select("norm_key", F.col("pos").alias("s_pos"), F.col("row").alias("s")), "norm_key", "full_outer")
    both = both.withColumn("norm_front", T.normalize_text(F.coalesce("s.front", "c_front")))
    if decisions is not None:
        both = both.join(decisions.select(digest("norm_front").alias("norm_key"), F.col("back").alias("decided")), "norm_key", "left")
    else:
        both = both.withColumn("decided", F.lit(None).cast("string"))
    state = F.when(F.col("s").isNull(), "orphan").when(F.col("choices").isNull(), "missing").when(F.size("choices") > 1, "conflict").otherwise("matched")
    chosen = F.coalesce("decided", F.when(F.lit(conflict == "first"), F.element_at("choices", 1)))
    one = F.element_at("choices", 1)
    back = F.when(state == "matched", one).when(state == "conflict", chosen).when(state == "orphan", F.coalesce("decided", one)).otherwise(F.coalesce("decided", F.when(F.lit(missing == "todo"), "TODO")))
    outcome = (
        F.when(state == "matched", "kept")
        .when(state == "conflict", F.when(chosen.isNull(), "dropped").otherwise("kept"))
        .when(state == "orphan", F.lit({"rescue": "rescued", "ignore": "ignored", "drop": "dropped"}[orphan]))
        .otherwise(F.when(F.col("decided").isNotNull(), "kept").otherwise({"todo": "todo", "drop": "dropped"}[missing]))
    )
    return both.select("norm_front", F.coalesce("s.front", "c_front").alias("front"), back.alias("back"), "s.collection", "s.category", "s.sort_key", "c_pos", "s_pos", state.alias("state"), outcome.alias("outcome"))


def _outline(structure: DataFrame, *columns: str) -> DataFrame:
    """norm_key, pos, row: of a normal front its first place and the columns of its last row."""
    told = structure.select(digest(T.normalize_text("front")).alias("norm_key"), "pos", F.struct(*columns).alias("row"))
    return last_wins(told, "norm_key", "row")


def rescue(orphans: DataFrame, number: int, name: str, order: str = "c_pos") -> DataFrame:
    """Rescued rows get a collection of their own and numbers in order, over ranges of the order."""
    (n,) = fresh(orphans.columns, "n")
    rows = numbered(orphans, order, name=n)
    return rows.withColumns({"collection": F.lit(f"collection_{number}_{name}"), "category": F.lit("a_Unsortiert"), "sort_key": F.format_string("%02d_A_%02d", F.lit(number), F.col(n) + 1)}).drop(n)


def sync_structure(cards: DataFrame, structure: DataFrame) -> DataFrame:
    """Cards take collection, category and sort field of the outline where it has their front; others stay as they are. Adds norm_front and synced."""
    key, row = fresh([*cards.columns, "norm_front", "synced"], "norm_key", "row")
    outline = _outline(structure, "collection", "category", "sort_key").select(F.col("norm_key").alias(key), F.col("row").alias(row))
    named = cards.withColumn("norm_front", T.normalize_text("front"))
    rows = named.withColumn(key, digest("norm_front")).join(outline, key, "left")
    kept = {c: F.coalesce(F.col(f"{row}.{c}"), F.col(c)) for c in ("collection", "category")}
    new = F.when(F.col(row).isNull(), F.col("sort_field")).otherwise(T.sort_field(F.col(f"{row}.sort_key"), "front"))
    return rows.withColumns(kept | {"sort_field": new, "synced": F.col(row).isNotNull()}).drop(row, key)


def structure_without_cards(cards: DataFrame, structure: DataFrame) -> DataFrame:
    known = cards.select(digest(T.normalize_text("front")).alias("known"))
    named = structure.withColumn("norm_front", T.normalize_text("front"))
    return named.join(known, digest("norm_front") == known["known"], "left_anti")


def two_tier(wanted: DataFrame, template: DataFrame, exact: str, loose: Column, order: str = "ord") -> DataFrame:
    """Keys matched exactly, else by a looser key; of several the first of the template. `loose` is an expression over the key."""
    t = template.select(F.col(exact).alias("_key"), F.col(order).alias("_ord")).withColumn("_loose", F.expr(loose) if isinstance(loose, str) else loose)
    first = t.groupBy("_loose").agg(F.min_by("_key", "_ord").alias("_near"))
    rows = wanted.withColumn("_key", F.col(exact)).withColumn("_loose", F.expr(loose) if isinstance(loose, str) else loose)
    same = t.select("_key", F.lit(True).alias("_same")).distinct()
    return rows.join(same, "_key", "left").join(first, "_loose", "left").withColumn("match", F.when(F.col("_same"), F.col("_key")).otherwise(F.col("_near"))).drop("_key", "_loose", "_same", "_near")


def delete_by(cards: DataFrame, gone: DataFrame, key: str = "guid") -> DataFrame:
    return cards.join(gone.select(key).distinct(), key, "left_anti")


def update_by(cards: DataFrame, news: DataFrame, key: str = "guid") -> DataFrame:
    """Columns of `news`, where it has the row and they aren't null, replace those of `cards`."""
    names = [c for c in news.columns if c != key and c in cards.columns]
    (new,) = fresh(cards.columns, "new")
    changed = news.select(key, F.struct(*names).alias(new)) if names else news.select(key, F.lit(None).alias(new))
    return cards.join(changed, key, "left").select(*(F.coalesce(F.col(f"{new}.{c}"), F.col(c)).alias(c) if c in names else F.col(c) for c in cards.columns))


def nest(cards: DataFrame) -> DataFrame:
    """One row a collection: a map from category to its cards in order."""
    per = cards.groupBy("collection", "category").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "front", "back"))), lambda s: F.struct(s.front.alias("front"), s.back.alias("back"))).alias("cards"))
    return per.groupBy("collection").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "cards")))).alias("categories"))


def unnest(df: DataFrame, column: str = "generated_cards") -> DataFrame:
    """collection -> category -> cards, back to rows."""
    return df.select(F.explode(column).alias("collection", "_m")).select("collection", F.explode("_m").alias("category", "_cards")).select("collection", "category", F.posexplode("_cards").alias("ord", "_c")).select("collection", "category", "ord", "_c.*")
