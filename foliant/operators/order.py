"""Numbers and running values over a whole order, without a task that sees it all.

Rows are dealt to ranges of the order and sorted there, which is written once. What a range hands on to the next is one row a range:
its size, or what the segment that it ends with has summed up to. These rows are as many as ranges, whatever the table's size.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .shared import cut, fresh


class Laid:
    """Rows in ranges: `part` names a row's range and `at` its place there. `columns` are those of the table that was laid, `keep` writes a table and reads it back."""

    def __init__(self, rows: DataFrame, part: str, at: str, columns: list[str], keep: Callable[[DataFrame], DataFrame] = cut):
        self.rows, self.part, self.at, self.columns, self.keep = rows, part, at, columns, keep


def lay(df: DataFrame, *order: Column | str, within: tuple[Column | str, ...] = (), keep: Callable[[DataFrame], DataFrame] = cut) -> Laid:
    """df in the order given, in ranges; written by what runs over it. A value of the order that very many rows share is one range, unless further columns of the order tell its rows apart.

    `within` is the order inside a range, if it isn't the same: it must agree with `order` and may be finer, so that long values need not be sampled.
    """
    part, at = fresh(df.columns, "part", "at")
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*(within or order))
    place = F.monotonically_increasing_id()  # its upper bits number the task, the lower 33 the row there
    return Laid(ranged.select("*", F.shiftright(place, 33).alias(part), place.bitwiseAND(F.lit((1 << 33) - 1)).alias(at)), part, at, df.columns, keep)


def numbered(df: DataFrame, *order: Column | str, name: str = "n", keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """Adds the place of each row in the whole order, from 0; rows that tie stand in any order. An empty table stays empty."""
    laid = lay(df, *order, keep=keep)
    rows = keep(laid.rows)
    sizes = sorted(rows.groupBy(laid.part).count().collect())  # one row a range
    starts = itertools.accumulate((n for _, n in sizes), initial=0)
    known = [(p, s) for (p, _), s in zip(sizes, starts)]
    (start,) = fresh([*rows.columns, name], "start")
    begins = df.sparkSession.createDataFrame(known, f"{laid.part} bigint, {start} bigint")
    whole = rows.join(F.broadcast(begins), laid.part)
    return whole.select(*(F.col(c) for c in laid.columns if c != name), (F.col(start) + F.col(laid.at)).alias(name))


def _either(f: Callable) -> Callable:
    """f of two values, or the one that isn't null."""
    return lambda had, x: x if had is None else had if x is None else f(had, x)


def _column(f: Callable) -> Callable:
    return lambda had, x: F.when(had.isNull(), x).when(x.isNull(), had).otherwise(f(had, x))


#: How a value is run over rows, and how what came before is put to it: as columns, and as values of the driver.
KINDS: dict[str, tuple[Callable, Callable, Callable]] = {
    "sum": (F.sum, _column(lambda had, x: had + x), _either(lambda had, x: had + x)),
    "max": (F.max, lambda had, x: F.greatest(had, x), _either(max)),
    "xor": (F.bit_xor, _column(lambda had, x: had.bitwiseXOR(x)), _either(lambda had, x: had ^ x)),
    "last": (lambda x: F.last(x, ignorenulls=True), lambda had, x: F.coalesce(x, had), _either(lambda had, x: x)),
}


def running(laid: Laid, of: list[str], values: dict[str, tuple[str, Column]], before: tuple[str, ...] = ()) -> Laid:
    """Adds name: (kind, expression) run over the rows of a segment from its first to the row itself, or to the one before it for names in `before`.

    A segment is the rows that agree in `of`, by which the table must be laid first, ascending. Nulls in `of` are one value; null expressions are left out, and where there was none but
    those the result is null. Within a range each segment is a window; what a range's last segment has summed up to, one row a range, tells what goes on in the next.
    """
    part, at = laid.part, laid.at
    total, seg, had = fresh([*laid.rows.columns, *values], "total", "seg", "had")
    local = Window.partitionBy(part, *of).orderBy(at)
    upto, past = local.rowsBetween(Window.unboundedPreceding, 0), local.rowsBetween(Window.unboundedPreceding, -1)
    whole = F.struct(*(KINDS[k][0](x).over(upto).alias(n) for n, (k, x) in values.items()))
    found = laid.keep(laid.rows.select("*", whole.alias(total), *(KINDS[k][0](x).over(past).alias(n) for n, (k, x) in values.items() if n in before)))
    ends = found.groupBy(part).agg(F.min(F.struct(*of)).alias("a"), F.max(F.struct(*of)).alias("b"), F.max_by(total, at).alias("v")).collect()  # one row a range
    carried, open_seg, held = [], None, None
    for p, a, b, v in sorted(ends, key=lambda r: r[0]):
        mine = [v[n] for n in values]
        if held is not None and a == open_seg:
            carried.append((p, tuple(a), tuple(held)))
            if a == b:
                mine = [KINDS[k][2](h, x) for (k, _), h, x in zip(values.values(), held, mine)]
        open_seg, held = b, mine
    spread = [F.col(n) if n in before else F.col(f"{total}.{n}").alias(n) for n in values]
    columns = [*laid.columns, *values]
    if not carried:
        return Laid(found.select(*laid.rows.columns, *spread), part, at, columns, laid.keep)
    kind = found.select(F.col(part), F.struct(*of).alias(seg), F.col(total).alias(had)).schema
    known = F.broadcast(found.sparkSession.createDataFrame(carried, StructType([StructField(f.name, f.dataType) for f in kind.fields])))
    joined = found.select(*laid.rows.columns, *spread).join(known, part, "left")
    goes_on = F.struct(*of).eqNullSafe(F.col(seg))
    done = joined.withColumns({n: F.when(goes_on, KINDS[k][1](F.col(f"{had}.{n}"), F.col(n))).otherwise(F.col(n)) for n, (k, _) in values.items()})
    return Laid(done.select(*laid.rows.columns, *values), part, at, columns, laid.keep)
