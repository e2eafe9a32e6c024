"""Predicates: a column against literals, in three-valued logic, with NaN above every number."""

from __future__ import annotations

import datetime as dt
import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataq.functions.values import Binder, Value
from strataq.plans.ast import Between, Call, Col, Compare, In, IsNull, Like, Lit, Logic, Node, Not
from strataq.plans.errors import QueryError
from strataq.plans.parser import MAX_DEPTH

_FLIP = {"=": "=", "<>": "<>", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
_NEGATED = {"=": "<>", "<>": "=", "<": ">=", "<=": ">", ">": "<=", ">=": "<"}
_WHEN = re.compile(r"(\d{4,})-(\d\d)-(\d\d)(?:[ T](\d\d):(\d\d)(?::(\d\d)(?:\.(\d{1,9}))?)?)?(Z|\+00:00)?$")


def unknown() -> Column:
    return F.lit(None).cast("boolean")


def _known(c: Column, truth: bool) -> Column:
    """The same answer for every value, UNKNOWN for NULL."""
    return F.when(c.isNotNull(), F.lit(truth))


def _nanos(text: str) -> tuple[int, int]:
    """Days and nanoseconds of the day of a written date or time."""
    m = _WHEN.match(text.strip())
    if not m:
        raise QueryError("BadValue", f"{text!r} is not a date or time")
    try:
        days = (dt.date(int(m[1]), int(m[2]), int(m[3])) - dt.date(1970, 1, 1)).days
    except ValueError as e:
        raise QueryError("BadValue", f"{text!r}: {e}") from e
    h, mi, s = (int(m[k] or 0) for k in (4, 5, 6))
    if h > 23 or mi > 59 or s > 59:
        raise QueryError("BadValue", f"{text!r} is not a time")
    return days, ((h * 60 + mi) * 60 + s) * 10**9 + int((m[7] or "").ljust(9, "0"))


def _compare(op: str, c: Column, x: Column) -> Column:
    return {"=": c == x, "<>": c != x, "<": c < x, "<=": c <= x, ">": c > x, ">=": c >= x}[op]


def _exact(op: str, c: Column, below: Column, whole: bool) -> Column:
    """Compare with a number that lies at below, or (not whole) between it and the next value of the column's type."""
    if whole:
        return _compare(op, c, below)
    if op in ("=", "<>"):
        return _known(c, op == "<>")
    return c <= below if op in ("<", "<=") else c > below


def compare(v: Value, op: str, lit: Lit, *, guard: bool = True) -> Column:
    """guard: NaN may be among the wanted rows though Parquet's statistics don't count it; keep the filter from them."""
    c, x = v.column, lit.value
    if x is None:
        return unknown()
    if v.lane == "int":
        if isinstance(x, bool) or not isinstance(x, int):
            raise QueryError("BadValue", f"an integer is needed, not {x!r}")
        if not -(1 << 63) <= x < 1 << 63:
            return _known(c, op in ("<>", "<", "<=") if x > 0 else op in ("<>", ">", ">="))
        return _compare(op, c, F.lit(x))
    if v.lane == "float":
        if isinstance(x, bool) or not isinstance(x, int | Decimal):
            raise QueryError("BadValue", f"a number is needed, not {x!r}")
        side = c + F.lit(0.0).cast(v.type) if guard and op in (">", ">=", "<>") else c
        return _compare(op, side, F.lit(float(x)).cast(v.type))
    if v.lane == "decimal":
        if isinstance(x, bool) or not isinstance(x, int | Decimal):
            raise QueryError("BadValue", f"a number is needed, not {x!r}")
        scaled = Decimal(x).scaleb(v.type.scale)
        floor = int(scaled.to_integral_value("ROUND_FLOOR"))
        if abs(floor) >= 10**38:
            return _known(c, op in ("<>", "<", "<=") if floor > 0 else op in ("<>", ">", ">="))
        at = F.lit(str(Decimal(floor).scaleb(-v.type.scale))).cast(T.DecimalType(38, v.type.scale))
        return _exact(op, c, at, scaled == floor)
    if v.lane in ("string", "bytes"):
        if not isinstance(x, str):
            raise QueryError("BadValue", f"a string is needed, not {x!r}")
        return _compare(op, c, F.lit(x) if v.lane == "string" else F.lit(x.encode()))
    if v.lane == "bool":
        if not isinstance(x, bool):
            raise QueryError("BadValue", "true or false is needed")
        return _compare(op, c, F.lit(x))
    if v.lane == "date":
        if isinstance(x, int) and not isinstance(x, bool):
            return _compare(op, c, F.date_from_unix_date(F.lit(x)))
        if not isinstance(x, str):
            raise QueryError("BadValue", "a date is needed")
        return _compare(op, c, F.date_from_unix_date(F.lit(_nanos(x)[0])))
    if v.lane == "time":
        if isinstance(x, int) and not isinstance(x, bool):
            micros, whole = x, True
        elif isinstance(x, str):
            days, nanos = _nanos(x)
            micros, whole = days * 86_400_000_000 + nanos // 1000, nanos % 1000 == 0
        else:
            raise QueryError("BadValue", "a timestamp is needed")
        return _exact(op, c, _moment(micros, v.type), whole)
    raise QueryError("RepeatedColumn" if isinstance(v.type, T.ArrayType | T.MapType) else "UnsupportedFilterType", f"no comparison of {v.type.simpleString()}")


def _moment(micros: int, t: T.DataType) -> Column:
    """A literal of a time type. Local times are written out, so that no time zone of the session comes into it."""
    if isinstance(t, T.TimestampNTZType):
        try:
            return F.lit((dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=micros)).isoformat(" ")).cast(t)
        except OverflowError as e:
            raise QueryError("BadValue", f"{micros} is out of range") from e
    return F.timestamp_micros(F.lit(micros))


class Scope:
    """What may stand on the left of a predicate: columns of a schema, and make_date of them."""

    def __init__(self, binder: Binder):
        self.binder = binder

    def subject(self, n: Node) -> Value:
        if isinstance(n, Col):
            return self.binder.column(n)
        if isinstance(n, Call) and n.name == "make_date" and len(n.args) == 1 and isinstance(n.args[0], Col):
            return self.binder.value(n)
        raise QueryError("ExpressionInPredicate", "a predicate compares a column with literals")


def _literal(n: Node) -> Lit:
    if isinstance(n, Col):
        raise QueryError("ColumnComparison", "a column is compared with literals, not with a column")
    if not isinstance(n, Lit):
        raise QueryError("ExpressionInPredicate", "a literal is needed")
    return n


def lower(scope: Scope, n: Node, negated: bool = False, level: int = 0) -> Column:
    """NOT is pushed down to the leaves, where each has an exact opposite; UNKNOWN stays UNKNOWN."""
    if level > MAX_DEPTH:
        raise QueryError("ExpressionTooDeep", f"more than {MAX_DEPTH} levels")
    if isinstance(n, Not):
        return lower(scope, n.arg, not negated, level + 1)
    if isinstance(n, Logic):
        parts = [lower(scope, a, negated, level + 1) for a in n.args]
        both = (n.op == "and") != negated
        out = parts[0]
        for p in parts[1:]:
            out = (out & p) if both else (out | p)
        return out
    if isinstance(n, Lit) and isinstance(n.value, bool):
        return F.lit(n.value != negated)
    if isinstance(n, Compare):
        left, op, right = n.left, n.op, n.right
        if isinstance(left, Lit) and not isinstance(right, Lit):
            left, op, right = right, _FLIP[op], left
        v = scope.subject(left)
        return compare(v, _NEGATED[op] if negated else op, _literal(right))
    if isinstance(n, IsNull):
        c = scope.subject(n.arg).column
        return c.isNotNull() if negated else c.isNull()
    if isinstance(n, Between):
        v = scope.subject(n.arg)
        low, high = _literal(n.low), _literal(n.high)
        if negated:
            return compare(v, "<", low) | compare(v, ">", high)
        # NaN is above every upper bound, so statistics may prune both halves
        return compare(v, ">=", low, guard=False) & compare(v, "<=", high)
    if isinstance(n, In):
        return _in(scope.subject(n.arg), [_literal(i) for i in n.items], negated)
    if isinstance(n, Like):
        v, pattern = scope.subject(n.arg), _literal(n.pattern)
        if v.lane not in ("string", "bytes"):
            raise QueryError("BadValue", "LIKE takes a string column")
        if pattern.value is None:
            return unknown()
        if not isinstance(pattern.value, str):
            raise QueryError("BadValue", "LIKE takes a string pattern")
        hit = v.column.like(pattern.value.replace("\\", "\\\\"))
        return ~hit if negated else hit
    if isinstance(n, Col):
        v = scope.subject(n)
        if v.lane != "bool":
            raise QueryError("BadValue", f"{n.name} is not BOOLEAN")
        return ~v.column if negated else v.column
    raise QueryError("ExpressionInPredicate", "a predicate is needed")


def _in(v: Value, items: list[Lit], negated: bool) -> Column:
    known = [i for i in items if i.value is not None]
    plain = {"int": int, "string": str}.get(v.lane)
    if plain and known and all(type(i.value) is plain for i in known) and (plain is str or all(abs(i.value) < 1 << 63 for i in known)):
        hit = v.column.isin([i.value for i in known])
    else:
        hit = None
        for i in known:
            one = compare(v, "=", i)
            hit = one if hit is None else hit | one
    if len(known) < len(items):
        hit = unknown() if hit is None else hit | unknown()
    return ~hit if negated else hit


def predicate(binder: Binder, n: Node) -> Column:
    return lower(Scope(binder), n)
