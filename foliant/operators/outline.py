"""Sections of recognised text, outlines in markdown, and the orders of their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .order import lay, running
from .shared import kept

_HEAD = r"^Image:\s*(.+?)\s*$"


def lines_of(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    return docs.select(F.col(doc).alias("doc"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def sections(lines: DataFrame, head: str = _HEAD) -> DataFrame:
    """doc, image, ord, body: text under each header, right-stripped; what is before the first goes. Of equal names the last body at the first place.

    Headers are counted over ranges of lines, so a document may be any share of them; a section is one row.
    """
    name = F.nullif(F.regexp_extract("line", head, 1), F.lit(""))
    laid = lay(lines.select("doc", "line_no", "line", name.alias("name")), "doc", "line_no")
    marked = running(laid, ["doc"], {"n": ("sum", F.col("name").isNotNull().cast("int"))}).rows.filter("n > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("name").isNull(), F.struct("line_no", "line")))), lambda s: s.line), "\n")
    each = marked.groupBy("doc", "n").agg(F.max("name").alias("image"), F.regexp_replace(body, r"(?U)\s+$", "").alias("body"))
    return each.groupBy("doc", "image").agg(F.min("n").cast("int").alias("ord"), F.max_by("body", "n").alias("body"))


def write_sections(pages: DataFrame) -> DataFrame:
    """doc, text: the sections of a document in page order, one empty line between."""
    one = F.concat(F.lit("Image: "), F.col("image"), F.when(F.coalesce("body", F.lit("")) == "", "").otherwise(F.concat(F.lit("\n"), F.regexp_replace("body", r"(?U)\s+$", ""))))
    rows = pages.select("doc", F.struct(F.coalesce(T.page_number("image"), F.lit(2**31 - 1)).alias("p"), "image", one.alias("s")).alias("x"))
    return rows.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x.s), "\n\n").alias("text"))


def carry_forward(lines: DataFrame, mark: Column, by: str = "doc", order: str = "line_no") -> DataFrame:
    """Adds current: the last non-null mark at or before each line, over ranges of lines."""
    return running(lay(lines, by, order), [by], {"current": ("last", mark)}).rows.select(*lines.columns, "current")


def read_outline(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """Cards of a markdown index: doc, collection_no, title, letter, category, number, front, sort_key, pos.

    A block runs between COLLECTION_n marks of one n; cards count from CARDS_START on; those before any category are `unbekannt`, under Z.
    Numbers that no int holds are null. State is carried over ranges of lines, so a document may be any share of them.
    """
    return read_outline_lines(lines_of(docs, doc, text))


def read_outline_lines(marked: DataFrame) -> DataFrame:
    """The same of lines: doc, line_no, line."""
    begin, end = F.regexp_extract("line", r"^<!-- COLLECTION_(\d+)_START -->$", 1), F.regexp_extract("line", r"^<!-- COLLECTION_(\d+)_END -->$", 1)
    laid = lay(marked.select("doc", "line_no", "line"), "doc", "line_no", keep=kept)
    state = F.when(begin != "", begin).when(end != "", F.lit("-"))
    inside = running(laid, ["doc"], {"block": ("last", state)}).rows.filter("block is not null and block <> '-'").select("doc", "line_no", "line", "block")
    bold = F.nullif(F.regexp_extract("line", r"^\*\*([^*]+)\*\*$", 1), F.lit(""))
    cat = F.regexp_extract("line", r"^\*\*([A-Z])\.\s+([^*]+)\*\*$", 0)
    cards_on = F.when(F.trim("line") == "<!-- CARDS_START -->", 1).otherwise(0)
    cards_off = F.when(F.trim("line") == "<!-- CARDS_END -->", 1).otherwise(0)
    of_block = lay(inside, "doc", "block", "line_no", keep=kept)
    seen = running(of_block, ["doc", "block"], {"cat": ("last", F.nullif(cat, F.lit(""))), "began": ("max", cards_on), "ended": ("max", cards_off)}).rows
    titles = inside.groupBy("doc", "block").agg(F.min_by(bold, F.when(bold.isNotNull(), F.col("line_no"))).alias("title"))
    rows = seen.join(titles, ["doc", "block"]).withColumn("on", (F.col("began") == 1) & (F.col("ended") == 0))
    card = F.regexp_extract("line", r"^([0-9]+)\.\s+(.+)", 0)
    letter = F.coalesce(F.nullif(F.regexp_extract("cat", r"^\*\*([A-Z])", 1), F.lit("")), F.lit("Z"))
    named = F.regexp_extract("cat", r"^\*\*[A-Z]\.\s+([^*]+)\*\*$", 1)
    number = T.whole(F.regexp_extract("line", r"^([0-9]+)\.", 1))
    return (
        rows.filter(F.col("on") & (card != ""))
        .withColumns({"collection_no": T.whole(F.col("block")), "letter": letter, "number": number})
        .select(
            "doc",
            "collection_no",
            "title",
            "letter",
            F.when(F.col("cat").isNull(), "unbekannt").otherwise(T.category_key(F.lower("letter"), named)).alias("category"),
            "number",
            F.trim(F.regexp_extract("line", r"^[0-9]+\.\s+(.+)", 1)).alias("front"),
            T.sort_key("collection_no", F.col("letter"), F.col("number")).alias("sort_key"),
            F.col("line_no").cast("long").alias("pos"),
        )
    )


def collection_order(key: Column) -> list[Column]:
    """Numbered keys by number, then the others by name."""
    n = F.try_element_at(F.split(key, "_"), F.lit(2))
    n = F.when(F.rlike(n, F.lit("^[0-9]+$")), n.try_cast("decimal(38,0)"))
    return [n.isNull().asc(), F.coalesce(n, F.lit(0)).asc(), key.asc()]


def outline_lines(cards: DataFrame, dimension: DataFrame, header: str = "") -> DataFrame:
    """line_no (from 0), line: the markdown index of all cards.

    Collections and categories are ranked by windows, as there is one row each. Cards are numbered, and their lines counted, over ranges of their order, so neither the index nor a category
    is whole anywhere.
    """
    keyed = cards.select("collection", "category", F.coalesce("sort_field", F.lit("")).alias("s"), "pos", "front")
    prefix = F.element_at(F.split("category", "_"), 1)
    heading = F.concat(F.lit("**"), F.upper(F.substring(prefix, 1, 1)), F.lit(". "), T.display_name("category", 1), F.lit("**"))
    per = keyed.groupBy("collection", "category").agg(F.min(F.struct("s", "pos")).alias("f")).select("collection", "category", prefix.alias("p"), "f", heading.alias("text"))
    blocks = per.groupBy("collection").agg(F.count("text").alias("n")).join(dimension.select(F.col("key").alias("collection"), "display_name"), "collection", "left")
    i = (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*collection_order(F.col("collection")))) - 1).alias("i")
    blocks = kept(blocks.select("collection", "n", F.coalesce("display_name", T.display_name("collection", 2)).alias("name"), i).filter("name is not null"))
    place = F.row_number().over(Window.partitionBy("i").orderBy("p", "f", "text", "category")).alias("place")
    named = kept(per.filter("text is not null").join(blocks.select("collection", "i"), "collection").select("collection", "category", "i", place, "text"))

    placed = keyed.join(F.broadcast(named.select("collection", "category", "i", "place")), ["collection", "category"]).select("i", "place", "s", "pos", "front")
    size = F.coalesce(F.size(F.split("front", "\n")), F.lit(0)).cast("long")
    laid = lay(placed.withColumn("size", F.when(F.col("front").isNull(), 0).otherwise(size)), "i", "place", "s", "pos", within=("i", "place", "s", "pos", "front"), keep=kept)
    rows = running(laid, ["i", "place"], {"number": ("sum", F.lit(1)), "upto": ("sum", F.col("size"))}).rows
    sizes = rows.groupBy("i", "place").agg(F.max("upto").alias("size"))

    # what stands around cards: one row a piece, in the order of i, place and kind; of cards there is the number of their lines
    n = F.col("i").cast("string")
    head = F.concat(F.lit("<!-- COLLECTION_"), n, F.lit("_START -->\n# Sammlung "), n, F.lit("\n\n**"), F.col("name"), F.lit("**\n\n<!-- CARDS_START -->\n***\n"))
    foot = F.concat(F.when(F.col("n") == 0, "\n").otherwise(""), F.lit("<!-- CARDS_END -->\n<!-- COLLECTION_"), n, F.lit("_END -->\n\n---"))
    top = F.concat(F.lit(f"{header}<!-- ANKI_CARD_LIST_START -->\n"), F.when(F.col("blocks") == 0, "\n").otherwise(""))
    piece = lambda df, i, place, kind, text: df.select(i, place.cast("int").alias("place"), F.lit(kind).alias("kind"), text.alias("text"))
    pieces = piece(blocks.agg(F.count("*").alias("blocks")), F.lit(-1).alias("i"), F.lit(0), 0, top)
    for more in (piece(blocks, "i", F.lit(0), 0, head), piece(named, "i", F.col("place"), 1, F.col("text")), piece(named, "i", F.col("place"), 3, F.lit("")), piece(blocks, "i", F.lit(2**31 - 1), 4, foot)):
        pieces = pieces.unionByName(more)
    counted = pieces.withColumn("size", F.size(F.split("text", "\n")).cast("long")).unionByName(sizes.select("i", "place", F.lit(2).alias("kind"), F.lit(None).cast("string").alias("text"), "size"))
    before = Window.partitionBy(F.lit(0)).orderBy("i", "place", "kind").rowsBetween(Window.unboundedPreceding, -1)
    based = kept(counted.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0))))
    around = based.filter("kind <> 2").select("base", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    told = F.concat(F.col("number").cast("string"), F.lit(". "), F.col("front"))
    inside = rows.join(F.broadcast(based.filter("kind = 2").select("i", "place", "base")), ["i", "place"]).filter("front is not null")
    inside = inside.select((F.col("base") + F.col("upto") - F.col("size")).alias("base"), F.posexplode(F.split(told, "\n")).alias("k", "line"))
    return around.unionByName(inside).select((F.col("base") + F.col("k")).alias("line_no"), "line")


def write_outline(cards: DataFrame, dimension: DataFrame, header: str = "") -> DataFrame:
    """One row, text: the whole index, for one that a task holds."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x.line), "\n")
    return outline_lines(cards, dimension, header).agg(text.alias("text"))
