"""Aggregates with exact results and the types they promise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataq.functions.predicates import predicate
from strataq.functions.values import Binder
from strataq.plans.ast import Agg, Binary, Lit, Negate
from strataq.plans.errors import QueryError


def _kept(binder: Binder, agg: Agg, c: Column) -> Column:
    return c if agg.where is None else F.when(predicate(binder, agg.where), c)


def _total(c: Column, t: T.DataType) -> Column:
    """Exact sums: integers of up to 32 bits in 64 (they can't overflow under 4 billion rows; beyond, Spark raises)."""
    if isinstance(t, T.ByteType | T.ShortType | T.IntegerType):
        return F.sum(c.cast("long")).cast(T.DecimalType(38, 0))
    if isinstance(t, T.LongType):
        return F.sum(c.cast(T.DecimalType(19, 0))).cast(T.DecimalType(38, 0))
    if isinstance(t, T.DecimalType):
        return F.sum(c).cast(T.DecimalType(38, t.scale))
    return F.sum(c.cast("double"))


def _number(t: T.DataType, fn: str) -> None:
    if not isinstance(t, T.NumericType):
        raise QueryError("TypeMismatch", f"{fn} takes a number")


def aggregate(binder: Binder, agg: Agg) -> tuple[Column, T.DataType]:
    """The column and its type. An integer sum is DECIMAL(38,0): exact past 64 bits."""
    if agg.arg is None:
        return (F.count(F.lit(1)) if agg.where is None else F.count(_kept(binder, agg, F.lit(1)))), T.LongType()
    if agg.fn == "sum" and agg.where is None and (shifted := _shifted_sum(binder, agg)):
        return shifted
    v = binder.value(agg.arg)
    c = _kept(binder, agg, v.column)
    if agg.fn == "count":
        return F.count(c), T.LongType()
    if agg.fn == "count_distinct":
        return F.count_distinct(c), T.LongType()
    if agg.fn in ("min", "max"):
        return (F.min if agg.fn == "min" else F.max)(c), v.type
    _number(v.type, agg.fn)
    if agg.fn == "sum":
        whole = isinstance(v.type, T.IntegralType)
        return _total(c, v.type), T.DecimalType(38, 0) if whole else T.DecimalType(38, v.type.scale) if v.lane == "decimal" else T.DoubleType()
    if agg.fn == "avg":
        if v.lane == "float":
            return F.avg(c.cast("double")), T.DoubleType()
        if v.lane == "int":
            return _total(c, v.type).cast("double") / F.nullif(F.count(c), F.lit(0)), T.DoubleType()
        p, s = v.type.precision, v.type.scale
        q = min(38, p + 4)
        t = T.DecimalType(q, s + q - p)
        return (F.avg(c) if p <= 34 else _total(c, v.type) / F.nullif(F.count(c), F.lit(0)).cast(T.DecimalType(19, 0))).cast(t), t
    if agg.fn == "avg_state":
        total = _total(c, v.type) if v.lane == "decimal" else _total(c, v.type).cast("double")
        t = T.DecimalType(38, v.type.scale) if v.lane == "decimal" else T.DoubleType()
        kind = T.StructType([T.StructField("sum", t), T.StructField("count", T.LongType())])
        return F.struct(total.alias("sum"), F.count(c).alias("count")), kind
    raise QueryError("BadAggregate", agg.fn)


def _shifted_sum(binder: Binder, agg: Agg) -> tuple[Column, T.DataType] | None:
    """sum(x + c) of an integer column and literal is sum(x) + c * count(x): many such sums share one fold of x."""
    n = agg.arg
    if not (isinstance(n, Binary) and n.op in "+-" and isinstance(n.right, Lit) and type(n.right.value) is int) or isinstance(n.left, Negate):
        return None
    v = binder.value(n.left)
    if not isinstance(v.type, T.ByteType | T.ShortType | T.IntegerType):
        return None
    by = n.right.value if n.op == "+" else -n.right.value
    d = T.DecimalType(38, 0)
    return (_total(v.column, v.type) + (F.lit(by).cast(T.DecimalType(19, 0)) * F.count(v.column)).cast(d)).cast(d), d
