"""The query language's fifteen operators as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _typed(col: Column, kind: T.DataType, v):
    """A literal of the column's type, so that ANSI mode never meets a mixed comparison. One that can't be cast
    gives null: no row then compares with it."""
    if v is None or isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.lit(v)
    return F.lit(v) if isinstance(kind, T.StringType) and isinstance(v, str) else F.lit(str(v)).try_cast(kind) if not isinstance(v, (bool, type(None))) else F.lit(v)


def like_pattern(p: str) -> str:
    """An escape before an ordinary sign is an error in Spark; such a backslash is taken as itself."""
    out, i = [], 0
    while i < len(p):
        if p[i] == "\\" and (i + 1 == len(p) or p[i + 1] not in "%_\\"):
            out.append("\\\\")
        elif p[i] == "\\":
            out.append(p[i : i + 2])
            i += 1
        else:
            out.append(p[i])
        i += 1
    return "".join(out)


def _affix(before: str, after: str, strict: Callable) -> Callable:
    def apply(c: Column, kind, v, wildcards: bool) -> Column:
        c = c.cast("string")
        return c.like(like_pattern(before + str(v) + after)) if wildcards else strict(c, F.lit(str(v)))

    return apply


def _in(c: Column, kind, v, wildcards) -> Column:
    return c.isin([_typed(c, kind, x) for x in v if x is not None]) if any(x is not None for x in v) else F.lit(False)


OPERATORS: dict[str, Callable] = {
    "eq": lambda c, k, v, w: c.isNull() if v is None else c == _typed(c, k, v),
    "ne": lambda c, k, v, w: c.isNotNull() if v is None else c != _typed(c, k, v),
    "gt": lambda c, k, v, w: c > _typed(c, k, v),
    "lt": lambda c, k, v, w: c < _typed(c, k, v),
    "ge": lambda c, k, v, w: c >= _typed(c, k, v),
    "le": lambda c, k, v, w: c <= _typed(c, k, v),
    "like": lambda c, k, v, w: c.cast("string").like(like_pattern(v)),
    "ilike": lambda c, k, v, w: c.cast("string").ilike(like_pattern(v)),
    "in": _in,
    "not_in": lambda c, k, v, w: ~_in(c, k, v, w) if list(v) else F.lit(True),
    "contains": _affix("%", "%", F.contains),
    "startswith": _affix("", "%", F.startswith),
    "endswith": _affix("%", "", F.endswith),
    "between": lambda c, k, v, w: c.between(_typed(c, k, v[0]), _typed(c, k, v[1])),
    "is_null": lambda c, k, v, w: c.isNull() if v else c.isNotNull(),
}


def condition(df: DataFrame, field: str, operator: str, value, strict: bool = True, wildcards: bool = False) -> Column | None:
    """One condition on ``df``. An unknown column or operator is an error; with strict=False it is no condition (None)."""
    if operator not in OPERATORS or field not in df.columns:
        if strict:
            raise ValueError(f"unknown {'operator ' + repr(operator) if operator not in OPERATORS else 'column ' + repr(field)}")
        return None
    return OPERATORS[operator](F.col(f"`{field}`"), df.schema[field].dataType, value, wildcards)


def where_all(df: DataFrame, conditions: list[dict], strict: bool = True, wildcards: bool = False) -> DataFrame:
    """All conditions ({"field", "operator", "value"}, operator eq if absent) together."""
    for c in conditions or []:
        if not c.get("field") and not strict:
            continue
        got = condition(df, c.get("field", ""), c.get("operator", "eq"), c.get("value"), strict, wildcards)
        df = df if got is None else df.where(got)
    return df
