"""Text functions as Column expressions: normal forms, keys, tags, tokens, identifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# How accented letters and signs are written in keys, in order.
KEY_LETTERS = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), ("&", "und"), ("é", "e"), ("è", "e"), ("á", "a"), ("à", "a"))
# Substrings that tell of text decoded with the wrong character set.
MOJIBAKE = ("Ã¼", "Ã¶", "Ã¤", "Ã©", "Ã ", "â€™", "â€œ", "â€")


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col: Column | str) -> Column:
    """Without whitespace, in the Unicode sense, at both ends."""
    return F.regexp_replace(_c(col), r"(?U)^\s+|\s+$", "")


def normalize_text(col: Column | str) -> Column:
    """Runs of whitespace become one space, ends are stripped, letters small."""
    return F.lower(F.trim(F.regexp_replace(_c(col), r"(?U)\s+", " ")))


def key_slug(col: Column | str) -> Column:
    """An ASCII key: listed letters are rewritten, spaces become underscores, the rest goes."""
    x = normalize_text(col)
    for a, b in KEY_LETTERS:
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.regexp_replace(F.regexp_replace(x, " ", "_"), "[^a-z0-9_]", "")
    return F.regexp_replace(F.regexp_replace(x, "_+", "_"), "^_|_$", "")


def sort_field(sort_key: Column | str, front: Column | str) -> Column:
    return F.concat_ws("_", _c(sort_key), F.substring(key_slug(front), 1, 50))


def capitalize(col: Column) -> Column:
    """First letter large, the others small."""
    return F.concat(F.upper(F.substring(col, 1, 1)), F.lower(F.substring(col, 2, 1 << 30)))


def _parts(col: Column | str) -> Column:
    return F.array_join(F.transform(F.split(_c(col), "_"), capitalize), "_")


def tag_path(prefix: str, collection: Column | str, category: Column | str) -> Column:
    return F.concat_ws("::", F.lit(prefix), _parts(collection), _parts(category))


def display_name(key: Column | str, drop: int) -> Column:
    """A readable name of a key without its first `drop` parts."""
    parts = F.split(_c(key), "_")
    return F.array_join(F.transform(F.slice(parts, drop + 1, 1 << 20), capitalize), " ")


def category_key(letter: Column | str, name: Column | str) -> Column:
    return F.concat_ws("_", _c(letter), F.substring(key_slug(name), 1, 50))


def sort_key(collection: Column | str, letter: Column | str, number: Column | str) -> Column:
    return F.format_string("%02d_%s_%02d", _c(collection).cast("long"), F.upper(_c(letter)), _c(number).cast("long"))


def token_set(col: Column | str) -> Column:
    """Distinct runs of a-z and 0-9."""
    return F.array_distinct(F.array_remove(F.split(F.lower(_c(col)), "[^a-z0-9]+"), ""))


def sanitize_filename(col: Column | str) -> Column:
    return F.regexp_replace(_c(col), r"(?U)\W+", "_")


def whole(digits: Column) -> Column:
    """The number that a run of digits stands for; null for none, and for one beyond 32 bits."""
    return digits.try_cast("int")


def page_number(col: Column | str) -> Column:
    """Null, which sorts last, where the name holds none."""
    return whole(F.regexp_extract(_c(col), r"page_([0-9]+)", 1))


def strip_fence(col: Column | str) -> Column:
    """Without a code fence before and behind."""
    return F.regexp_replace(F.regexp_replace(strip(col), r"^```[A-Za-z]*\s*", ""), r"\s*```$", "")


def stable_id(key: Column | str) -> Column:
    """31 bits from the first eight hex digits of the key's MD5."""
    return (F.conv(F.substring(F.md5(_c(key).cast("binary")), 1, 8), 16, 10).cast("long") % (1 << 31)).cast("long")


def preview(col: Column | str, size: int = 200) -> Column:
    x = _c(col)
    return F.when(F.length(x) > size, F.concat(F.substring(x, 1, size), F.lit("..."))).otherwise(x)


def deck_tag(name: Column | str, size: int = 40) -> Column:
    return F.regexp_replace(F.substring(F.upper(_c(name)), 1, size), "[ -]", "_")


def category_code(reply: Column | str) -> tuple[Column, Column]:
    """The number and the letter of the first code such as `3C` in a reply."""
    said = F.regexp_extract(F.upper(_c(reply)), r"\b([1-9][0-9]*[A-Z])\b", 1)
    return whole(F.regexp_extract(said, r"^([0-9]+)", 1)), F.nullif(F.substring(said, -1, 1), F.lit(""))


def wizard_key(name: Column | str) -> Column:
    x = F.replace(F.replace(F.replace(_c(name), F.lit(" "), F.lit("_")), F.lit(":"), F.lit("")), F.lit("/"), F.lit("_"))
    return F.regexp_replace(x, r"(?U)[^\w]", "_")


def fill(template: Column | str, values: dict[str, str]) -> Column:
    """Placeholders replaced by their values."""
    x = _c(template)
    for name, value in values.items():
        x = F.replace(x, F.lit("{" + name + "}"), F.lit(value))
    return x


def page_spec(col: Column | str) -> Column:
    """`1-3,5` to zero-based page indexes; garbage, descending ranges and ranges of a million pages or more give none."""
    items = F.split(F.regexp_replace(_c(col), " ", ""), ",")
    span = F.transform(items, lambda x: F.struct(whole(F.regexp_extract(x, r"^([0-9]+)(?:-[0-9]+)?$", 1)).alias("a"), whole(F.regexp_extract(x, r"^[0-9]+-([0-9]+)$", 1)).alias("b"), F.contains(x, F.lit("-")).alias("two")))
    good = F.filter(span, lambda s: s.a.isNotNull() & (s.a >= 1) & (~s.two | s.b.isNotNull()) & (F.coalesce(s.b, s.a) >= s.a) & (F.coalesce(s.b, s.a) - s.a < 1_000_000))
    return F.flatten(F.transform(good, lambda s: F.sequence(s.a - 1, F.coalesce(s.b, s.a) - 1)))


def rectangle(col: Column | str) -> Column:
    """Four integers of `x,y,w,h`, or null."""
    parts = F.split(_c(col), ",")
    numbers = F.transform(parts, lambda p: F.when(F.rlike(F.trim(p), F.lit(r"^-?[0-9]+$")), whole(F.trim(p))))
    return F.when((F.size(parts) == 4) & F.forall(numbers, lambda n: n.isNotNull()), numbers)


def progress(done: Column | str, total: Column | str, width: int = 24) -> tuple[Column, Column]:
    """Percentage, and filled cells of a bar; halves round to even."""
    pct = F.when(_c(total) > 0, _c(done) * 100.0 / _c(total)).otherwise(F.lit(100.0))
    return pct, F.least(F.greatest(F.bround(pct / 100 * width).cast("int"), F.lit(0)), F.lit(width))


def crop_box(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column, wide: Column, high: Column) -> Column:
    """A rectangle given in pixels of one rendering, in pixels of another."""
    at = lambda v, size, out: F.bround(F.least(F.greatest(v / size, F.lit(0.0)), F.lit(1.0)) * out).cast("int")
    return F.array(at(left, width, wide), at(top, height, high), at(right, width, wide), at(bottom, height, high))


def fit_page(w: Column, h: Column, short: float = 595.0, long: float = 842.0) -> Column:
    """Scale and centring offsets of an image on a page that lies as the image does."""
    page_w, page_h = F.when(w > h, long).otherwise(short), F.when(w > h, short).otherwise(long)
    scale = F.least(page_w / w, page_h / h)
    return F.struct(scale.alias("scale"), ((page_w - w * scale) / 2).alias("x"), ((page_h - h * scale) / 2).alias("y"), (w > h).alias("landscape"))


def has_mojibake(*cols: Column | str) -> Column:
    found = F.lit(False)
    for c in cols:
        for m in MOJIBAKE:
            found |= F.coalesce(F.contains(_c(c), F.lit(m)), F.lit(False))
    return found


def ocr_class(col: Column | str) -> Column:
    """empty, error, info or success, by how a text begins."""
    x = F.regexp_replace(F.coalesce(_c(col), F.lit("")), r"(?U)^\s+", "")
    return F.when(x == "", "empty").when(F.startswith(x, F.lit("[ERROR:")), "error").when(F.startswith(x, F.lit("[INFO:")), "info").otherwise("success")


# Fixed value: the one notice that a judge isn't shown.
EMPTY_NOTICE = "[INFO: API returned empty content for OCR]"


def valid_candidate(col: Column) -> Column:
    """Whether a candidate may be judged: other notices than the one for empty content pass."""
    x = F.coalesce(col, F.lit(""))
    return ~F.startswith(x, F.lit("[ERROR:")) & ~F.startswith(x, F.lit(EMPTY_NOTICE))


def flag(col: Column | str) -> Column:
    """Whether a setting from outside says yes."""
    return F.coalesce(F.trim(_c(col)).isin("1", "true", "True"), F.lit(False))


def clamped(col: Column | str, default: int, least: int, most: int) -> Column:
    """A whole number from outside within bounds; the default where it says none."""
    number = F.trim(_c(col)).try_cast("int")
    return F.when(number.isNull(), F.lit(default)).otherwise(F.least(F.greatest(number, F.lit(least)), F.lit(most)))


def any_of(names: Sequence[str], path: Column | str) -> Column:
    """Whether a path has one of the names among its folders."""
    return F.arrays_overlap(F.split(_c(path), "/"), F.array(*map(F.lit, names)))
