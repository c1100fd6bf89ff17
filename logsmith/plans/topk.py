"""Top-k and deep pages whose merges stay bounded.

Spark plans ``orderBy(...).limit(k)`` as ``TakeOrderedAndProject``: every task keeps its top
``k`` rows and ONE task merges ``k x (tasks)`` rows. So the page always runs as a tree: rows
are grouped by ``input task % B`` (``B`` = ``spark.sql.shuffle.partitions``) and each group
keeps its top ``k`` with a map-side-limited ``row_number`` (``WindowGroupLimit``); the final
top-k reads at most ``k x B`` rows. The bucket is the input task index, which a re-run task
reproduces.

A page that ends beyond the map-side limit's threshold is found by ranks instead: counts per
day, then per second, millisecond and microsecond where that holds many rows, and at last per
range of ids (a whole ingest batch shares one instant) tell which rows hold it and how many come
before them; only these rows are sorted.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsmith.functions.time import EPOCH_SQL, ts_lit


def group_limit_threshold(df: DataFrame) -> int:
    """Largest k for which Spark inserts the map-side ``WindowGroupLimit``."""
    return int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))


def by_input_task(buckets: int) -> Column:
    return F.pmod(F.spark_partition_id(), F.lit(buckets))


# Units of time that a page is narrowed by (microseconds of a day, second,
# millisecond, microsecond), rows that are sorted without narrowing them further, and ids that
# part the rows of one instant.
UNITS = (86_400_000_000, 1_000_000, 1_000, 1)
SORTED_ROWS = 20_000
PIVOTS = 1_000


def _micros(ts: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH_SQL}, `{ts}`)")


def _at(micros: int) -> dt.datetime:
    return dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=micros)


def _between(df: DataFrame, ts: str, start: int, end: int) -> DataFrame:
    """Rows of the microseconds ``start .. end-1`` (plain comparisons, so scans prune)."""
    return df.where((F.col(ts) >= ts_lit(_at(start))) & (F.col(ts) < ts_lit(_at(end))))


def _counts(df: DataFrame, unit: int, ts: str) -> list[tuple[int, int]]:
    """(unit of time, rows), newest first; rows without a time are not counted."""
    key = F.floor(_micros(ts) / unit).cast("bigint")
    rows = df.where(F.col(ts).isNotNull()).groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()
    return sorted(((r["k"], r["n"]) for r in rows), reverse=True)


def _locate(counts: list[tuple[int, int]], rank: int) -> tuple[int, int, int]:
    """The key that holds row ``rank``, the rows before that key and the rows in it."""
    before = 0
    for key, n in counts:
        if before + n > rank:
            return key, before, n
        before += n
    raise IndexError(rank)


def _span(df: DataFrame, ts: str, days: list[tuple[int, int]], rank: int) -> tuple[int, int, int, int]:
    """Time span [start, end) that holds row ``rank`` (newest first), the rows that are newer
    than it and the rows in it: a day, then units within it while it holds too many rows to sort."""
    key, before, n = _locate(days, rank)
    start, end = key * UNITS[0], (key + 1) * UNITS[0]
    for unit in UNITS[1:]:
        if n <= SORTED_ROWS:
            break
        key, more, n = _locate(_counts(_between(df, ts, start, end), unit, ts), rank - before)
        start, end, before = key * unit, (key + 1) * unit, before + more
    return start, end, before, n


def _ids_between(df: DataFrame, tie: str, low: str | None, high: str | None) -> DataFrame:
    """Rows of the ids [low, high); null ids come before all others."""
    df = df.where(F.col(tie) >= low) if low is not None else df
    return df.where((F.col(tie) < high) | F.col(tie).isNull()) if high is not None else df


def _id_range(df: DataFrame, tie: str, first: int, last: int) -> tuple[str | None, str | None, int]:
    """For rows of one instant in the order of ``tie``: bounds [low, high) of the ids that hold
    the rows ``first .. last``, and the rows before ``low``. The ids are parted by pivots (the
    first by a hash), counted per part, and the parts of the page are parted again while they
    hold too many rows. Any pivots give the same rows."""
    low = high = None
    skipped = 0
    while True:
        here = _ids_between(df, tie, low, high)
        some = here.where(F.col(tie).isNotNull()).orderBy(F.xxhash64(tie), tie).select(tie).limit(PIVOTS)
        pivots = sorted({r[0] for r in some.collect()})[1:]
        if not pivots:
            return low, high, skipped
        part = F.coalesce(F.aggregate(F.array(*map(F.lit, pivots)), F.lit(0), lambda n, p: n + (F.col(tie) >= p).cast("int")), F.lit(0))
        counts = sorted((r["k"], r["n"]) for r in here.groupBy(part.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect())
        a, before, _ = _locate(counts, first - skipped)
        b, _, _ = _locate(counts, last - skipped)
        bounds = (pivots[a - 1] if a else low), (pivots[b] if b < len(pivots) else high)
        skipped += before
        held = sum(n for k, n in counts if a <= k <= b)
        if bounds == (low, high) or held <= SORTED_ROWS + last - first:
            return *bounds, skipped
        low, high = bounds


def deep_page(df: DataFrame, order: Sequence[Column], offset: int, n: int, ts: str = "timestamp", tie: str = "id") -> DataFrame:
    """Rows ``offset .. offset+n`` of ``df`` in ``order`` (newest ``ts`` first, then ``tie``, rows
    without a time last) by counting: the driver sees a row per day, then of the spans that hold
    the page's ends at most one per second of a day, millisecond or microsecond, and then per
    range of ids of one instant. Only the rows of the narrowed spans are sorted."""
    days = _counts(df, UNITS[0], ts)
    dated = sum(c for _, c in days)
    parts, skip = [], offset
    if offset < dated:
        start, end, newer, held = _span(df, ts, days, offset)
        last = min(offset + n, dated) - 1
        low_start, low_end, low_newer, low_held = (
            (start, end, newer, held) if last < newer + held else _span(df, ts, days, last))
        skip = offset - newer
        if (low_start, low_end) == (start, end):
            rows, more = _instant(_between(df, ts, start, end), tie, offset - newer, last - newer, held)
            parts, skip = [rows], skip - more
        else:
            first_rows, more = _instant(_between(df, ts, start, end), tie, offset - newer, held - 1, held)
            last_rows, _ = _instant(_between(df, ts, low_start, low_end), tie, 0, last - low_newer, low_held)
            parts, skip = [first_rows, _between(df, ts, low_end, start), last_rows], skip - more
    if offset + n > dated:  # the page reaches the rows without a time
        undated = df.where(F.col(ts).isNull())
        if offset >= dated:
            if offset >= dated + (held := undated.count()):
                return df.limit(0)
            undated, more = _instant(undated, tie, offset - dated, min(offset + n - dated, held) - 1, held)
            skip = offset - dated - more
        parts.append(undated)
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    q = rows.orderBy(*order)
    return (q.offset(skip) if skip else q).limit(n)


def _instant(rows: DataFrame, tie: str, first: int, last: int, held: int) -> tuple[DataFrame, int]:
    """``rows`` of one span narrowed to the ids of the places ``first .. last`` if it holds too
    many (then it is one instant), and the rows before these."""
    if held <= SORTED_ROWS:
        return rows, 0
    low, high, skipped = _id_range(rows, tie, first, last)
    return _ids_between(rows, tie, low, high), skipped


def ordered_page(df: DataFrame, order: Sequence[Column], offset: int, n: int, ts: str = "timestamp") -> DataFrame:
    """Rows ``offset .. offset+n`` of ``df`` in ``order`` (a total order; newest ``ts`` first
    where the page is deep)."""
    k = offset + n
    if k > group_limit_threshold(df):
        return deep_page(df, order, offset, n, ts)
    w = Window.partitionBy("_topk_bucket").orderBy(*order)
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = (
        df.withColumn("_topk_bucket", by_input_task(buckets))
        .withColumn("_topk_rn", F.row_number().over(w))
        .where(F.col("_topk_rn") <= k)
        .drop("_topk_bucket", "_topk_rn")
    )
    q = kept.orderBy(*order)
    if offset:
        q = q.offset(offset)
    return q.limit(n)
