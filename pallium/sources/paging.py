"""Pages deep in a listing (Q2, Q4).

A sort with offset and limit keeps ``offset + limit`` rows in every task. For
a deep page the rows before it are counted instead: a histogram of the sort
key, one aggregate that reads the key columns only, tells which range holds
the page's first row and how many rows come before that range; ranges with
too many rows are cut again, equal times by id. Then only the range and the
page are sorted, and the bounds reach the scan as filters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pages that end within so many rows are plain top-k plans.
SHALLOW = 10_000
#: Ranges of a histogram; rows that a range may hold before it is cut again.
SLOTS, RANGE_ROWS = 1024, 50_000

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
_DAY = 86_400_000_000


def number(c: Column, kind: T.DataType) -> Column:
    """A key as a long in the same order (times: microseconds)."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.TimestampNTZType):
        seconds = (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
        day = F.datediff(c.cast("date"), F.lit("1970-01-01")).cast("long")
        return day * _DAY + (F.hour(c) * 3600 + F.minute(c) * 60).cast("long") * 1_000_000 + seconds
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("long")
    raise TypeError(f"no page order by {kind.simpleString()}")


def value(n: int, kind: T.DataType) -> Column:
    """The key that a number stands for, as a constant."""
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(F.lit(n))
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"{_EPOCH} + INTERVAL '{n // _DAY}' DAY + INTERVAL '{n % _DAY // 1_000_000}' SECOND "
                      f"+ INTERVAL '{n % 1_000_000 / 1_000_000:.6f}' SECOND")
    if isinstance(kind, T.DateType):
        return F.date_from_unix_date(F.lit(n).cast("int"))
    return F.lit(n).cast(kind)


@dataclass
class Cut:
    """Of a descending key: the page's first row lies at or below ``high``,
    ``before`` rows lie above it, ``rows`` in ``low .. high``; the page ends at
    or above ``end`` (None: not known)."""

    low: int
    high: int
    before: int
    rows: int
    end: int | None = None


def _cut(df: DataFrame, name: str, kind: T.DataType, low: int, high: int, before: int, offset: int, limit: int,
         slots: int, range_rows: int) -> Cut | None:
    """Narrow a key's range around position ``offset``; None if the rows in the
    range end before it."""
    found = Cut(low, high, before, 0)
    c = F.col(name)
    while True:
        width = -(-(found.high - found.low + 1) // slots)
        below = F.lit(found.high).cast("decimal(20,0)") - number(c, kind).cast("decimal(20,0)")
        place = F.call_function("div", below, F.lit(width).cast("decimal(20,0)"))
        inside = df.filter((c >= value(found.low, kind)) & (c <= value(found.high, kind)))
        counts = {int(r.place): r.n for r in inside.groupBy(place.cast("long").alias("place")).agg(
            F.count(F.lit(1)).alias("n")).collect()}  # at most a row per slot
        at, first = found.before, None
        low, high = found.low, found.high
        for slot in sorted(counts):
            if first is None and at + counts[slot] > offset:
                first = Cut(max(low, high - (slot + 1) * width + 1), high - slot * width, at, counts[slot], found.end)
            at += counts[slot]
            if first is not None and at >= offset + limit:
                first.end = max(low, high - (slot + 1) * width + 1)
                break
        if first is None:
            return None
        found = first
        if found.rows <= range_rows or found.low == found.high:
            return found


def deep_page(df: DataFrame, limit: int, offset: int, time_col: str = "created_at", id_col: str = "id",
              slots: int = SLOTS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in the order time descending, id
    descending, nulls last. Runs a few aggregates over the two columns while
    the plan is built; no task holds more than a page and one range, save for
    rows that share both time and id."""
    time, ident = df.schema[time_col].dataType, df.schema[id_col].dataType
    t, i = F.col(time_col), F.col(id_col)
    order = [t.desc(), i.desc()]

    def top(rows: DataFrame, before: int) -> DataFrame:
        return rows.orderBy(*order).offset(offset - before).limit(limit)

    def ids(rows: DataFrame, before: int) -> tuple[Cut | None, int]:
        """Where the page begins among rows of one time, and how many those are up to null ids."""
        low, high, n = rows.agg(F.min(number(i, ident)), F.max(number(i, ident)), F.count(i)).first()
        return (_cut(rows, id_col, ident, low, high, before, offset, limit, slots, range_rows) if n else None), before + n

    low, high, n = df.agg(F.min(number(t, time)), F.max(number(t, time)), F.count(t)).first()
    found = _cut(df, time_col, time, low, high, 0, offset, limit, slots, range_rows) if n else None
    if found is None:  # among rows without a time
        rows = df.filter(t.isNull())
        within, before = ids(rows, n)
        if within is None:
            return top(rows.filter(i.isNull()), before)
        kept = i <= value(within.high, ident)
        if within.end is not None:
            return top(rows.filter(kept & (i >= value(within.end, ident))), within.before)
        return top(rows.filter(kept | i.isNull()), within.before)
    ends = F.lit(True) if found.end is None else t >= value(found.end, time)
    lower = t.isNull() | (t <= value(found.high, time)) if found.end is None else ends & (t <= value(found.high, time))
    if found.rows <= range_rows:
        return top(df.filter(lower), found.before)
    # Many rows share a time: cut among them by id.
    same = t == value(found.high, time)
    within, before = ids(df.filter(same), found.before)
    if within is None:  # among those without an id
        return top(df.filter(lower & (~same | t.isNull() | i.isNull())), before)
    inside = same & (i <= value(within.high, ident))
    if within.end is not None:
        return top(df.filter(inside & (i >= value(within.end, ident))), within.before)
    return top(df.filter(lower & (F.coalesce(~same, F.lit(True)) | i.isNull() | inside)), within.before)
