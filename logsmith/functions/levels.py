"""Level expressions: E2 (parse), E3 (code), export codes, E9 (level from HTTP status)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logsmith.schema import LEVELS

# Three-letter codes of the plain-text export, in level order.
LEVEL_SHORT = ("TRC", "DBG", "INF", "WRN", "ERR", "FTL")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def level_code(level="level") -> Column:
    """Canonical level name -> 0..5 (null for anything else)."""
    lv = _col(level)
    expr = None
    for name, code in LEVELS:
        expr = F.when(lv == name, F.lit(code)) if expr is None else expr.when(lv == name, F.lit(code))
    return expr


def parse_level(raw="level") -> Column:
    """Free text -> canonical level name.

    Case-insensitive name or an integer 0-5 (``4``, ``04``, ``+4``); anything else (unknown
    names, other numbers, comma lists, null) becomes ``Info``."""
    t = F.trim(_col(raw))
    low = F.lower(t)
    number = F.when(t.rlike("^[+-]?[0-9]+$"), t.try_cast("int"))
    expr = None
    for name, code in LEVELS:
        cond = (low == name.lower()) | (number == code)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit("Info"))


def level_short(level="level") -> Column:
    """Export code TRC..FTL; unknown -> INF."""
    lv = _col(level)
    expr = None
    for (name, _), short in zip(LEVELS, LEVEL_SHORT):
        expr = F.when(lv == name, F.lit(short)) if expr is None else expr.when(lv == name, F.lit(short))
    return expr.otherwise(F.lit("INF"))


def level_from_status(status="status_code", exception=None) -> Column:
    """>=500 Error, >=400 Warning, else Information; a recorded exception forces Error."""
    st = _col(status)
    base = F.when(st >= 500, F.lit("Error")).when(st >= 400, F.lit("Warning")).otherwise(F.lit("Information"))
    if exception is None:
        return base
    return F.when(_col(exception).isNotNull(), F.lit("Error")).otherwise(base)
