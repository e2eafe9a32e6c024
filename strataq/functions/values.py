"""Typed lowering of value expressions to Spark columns."""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataq.functions import regex
from strataq.plans.ast import Binary, Call, Case, Cast, Col, Lit, Negate, Node
from strataq.plans.errors import QueryError
from strataq.plans.resolve import column_at, resolve

INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType)
TIMES = (T.TimestampType, T.TimestampNTZType)
_INT_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}
# Parts of dates and times.
TRUNC_PARTS = ("microsecond", "millisecond", "second", "minute", "hour", "day", "week", "month", "quarter", "year")
DATE_PARTS = ("year", "quarter", "month", "week", "day", "dow", "isodow", "doy", "hour", "minute", "second", "millisecond", "microsecond")


@dataclass
class Value:
    """A column with its type. digits: of an integer literal, else those of its type."""

    column: Column
    type: T.DataType
    digits: int = 0

    @property
    def lane(self) -> str:
        t = self.type
        if isinstance(t, INTS):
            return "int"
        if isinstance(t, FLOATS):
            return "float"
        if isinstance(t, T.DecimalType):
            return "decimal"
        if isinstance(t, TIMES):
            return "time"
        return {T.StringType: "string", T.BooleanType: "bool", T.DateType: "date", T.BinaryType: "bytes", T.NullType: "null"}.get(type(t), "other")


def decimal_type(p: int, s: int) -> T.DecimalType:
    if s > 38:
        raise QueryError("DecimalScaleTooLarge", f"a scale of {s} digits; 38 at most")
    return T.DecimalType(min(38, max(p, s, 1)), s)


def literal(lit: Lit) -> Value:
    v = lit.value
    if isinstance(v, bool):
        return Value(F.lit(v), T.BooleanType())
    if v is None:
        return Value(F.lit(None), T.NullType())
    if isinstance(v, str):
        return Value(F.lit(v), T.StringType())
    if isinstance(v, int):
        digits = len(lit.digits) or len(str(abs(v)))
        if -(1 << 63) <= v < 1 << 63:
            return Value(F.lit(v).cast("long"), T.LongType(), digits)
        v = Decimal(v)
    whole, _, part = lit.digits.partition(".") if lit.digits else str(abs(v)).partition(".")
    t = decimal_type(len(whole or "0") + len(part), len(part))
    return Value(F.lit(str(v)).cast(t), t)


def as_decimal(v: Value) -> tuple[Column, int, int]:
    """A column with its precision and scale; integers have the digits of their type, or of the literal."""
    if v.lane == "decimal":
        return v.column, v.type.precision, v.type.scale
    p = v.digits or _INT_DIGITS[type(v.type)]
    return v.column.cast(T.DecimalType(p, 0)), p, 0


def divide_ieee(a: Column, b: Column) -> Column:
    """Division of doubles as IEEE 754 has it: by zero it gives infinities or NaN, not an error."""
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(math.nan)).when(a > 0, F.lit(math.inf)).otherwise(F.lit(-math.inf))
    return F.when(b == 0, F.when(a.isNotNull(), by_zero)).otherwise(a / F.when(b != 0, b))


def arithmetic(op: str, a: Value, b: Value) -> Value:
    if op == "||":
        if {a.lane, b.lane} - {"string", "null"}:
            raise QueryError("TypeMismatch", "|| takes strings")
        return Value(F.concat(a.column, b.column), T.StringType())
    if {a.lane, b.lane} - {"int", "float", "decimal"}:
        raise QueryError("TypeMismatch", f"{op} takes numbers")
    if a.lane == b.lane == "int":
        x, y = a.column.cast("long"), b.column.cast("long")
        out = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.call_function("div", x, y)}[op]()
        return Value(out, T.LongType())
    if "float" in (a.lane, b.lane) or op == "/":
        x, y = a.column.cast("double"), b.column.cast("double")
        return Value(divide_ieee(x, y) if op == "/" else {"+": x + y, "-": x - y, "*": x * y}[op], T.DoubleType())
    (x, p1, s1), (y, p2, s2) = as_decimal(a), as_decimal(b)
    if op == "*":
        t = decimal_type(p1 + p2, s1 + s2)
        return Value((x * y).cast(t), t)
    s = max(s1, s2)
    t = decimal_type(min(38, max(p1 - s1, p2 - s2) + s + 1), s)
    return Value(((x + y) if op == "+" else (x - y)).cast(t), t)


def common(values: list[Value]) -> list[Value]:
    """The values in one type."""
    known = [v for v in values if v.lane != "null"]
    if not known:
        return values
    lanes = {v.lane for v in known}
    if lanes <= {"int"}:
        t: T.DataType = T.LongType()
    elif lanes <= {"int", "decimal"}:
        parts = [as_decimal(v)[1:] for v in known]
        s = max(s for _, s in parts)
        t = decimal_type(max(p - q for p, q in parts) + s, s)
    elif lanes <= {"int", "decimal", "float"}:
        t = T.DoubleType()
    elif len(lanes) == 1:
        t = known[0].type
    else:
        raise QueryError("TypeMismatch", f"no common type of {sorted(lanes)}")
    return [Value(v.column.cast(t), t) for v in values]


def _moment(v: Value) -> Column:
    """A date or time as a timestamp of the session, whose zone should be UTC."""
    if v.lane not in ("date", "time"):
        raise QueryError("TypeMismatch", "a DATE or TIMESTAMP is needed")
    return v.column.cast("timestamp_ntz").cast("timestamp") if not isinstance(v.type, T.TimestampType) else v.column


def date_trunc(part: str, v: Value) -> Value:
    if part not in TRUNC_PARTS:
        raise QueryError("UnknownDatePart", part)
    return Value(F.date_trunc(part, _moment(v)).cast("timestamp_ntz"), T.TimestampNTZType())


def date_part(part: str, v: Value) -> Value:
    m = _moment(v)
    micros = F.unix_micros(m)
    of = {
        "year": lambda: F.year(m), "quarter": lambda: F.quarter(m), "month": lambda: F.month(m), "week": lambda: F.weekofyear(m),
        "day": lambda: F.dayofmonth(m), "dow": lambda: F.dayofweek(m) - 1, "isodow": lambda: F.weekday(m) + 1, "doy": lambda: F.dayofyear(m),
        "hour": lambda: F.hour(m), "minute": lambda: F.minute(m), "second": lambda: F.second(m),
        "millisecond": lambda: F.call_function("div", F.pmod(micros, F.lit(60_000_000)), F.lit(1000)), "microsecond": lambda: F.pmod(micros, F.lit(60_000_000)),
    }
    if part not in of:
        raise QueryError("UnknownDatePart", part)
    return Value(of[part]().cast("long"), T.LongType())


def regexp_replace(v: Value, pattern: str, replacement: str, options: str = "") -> Value:
    """The first match only, or all with option g. Groups in the replacement are written \\1."""
    if v.lane != "string":
        raise QueryError("TypeMismatch", "regexp_replace takes a string")
    how = regex.options(options)
    own, groups = regex.to_java(pattern, how)
    parts = regex.pieces(replacement, groups)
    if not how.every:
        # groups 1 and 2 are what comes before the match and the match, the last what comes after
        own = f"(?s:\\A(.*?))({own})(?s:(.*))\\z"
        parts = [1, *(x + 2 if isinstance(x, int) else x for x in parts), groups + 3]
    out = ""
    for before, x in zip([None, *parts], parts, strict=False):
        if isinstance(x, int):
            out += f"${x}"
        else:
            out += "\\" + x if x in "$\\" or (x.isdigit() and isinstance(before, int)) else x
    return Value(F.regexp_replace(v.column, own, out), T.StringType())


class Binder:
    """Expressions over one schema. predicates: the Predicates over it, for CASE."""

    def __init__(self, schema: T.StructType):
        self.schema = schema

    def column(self, ref: Col) -> Value:
        path, t = resolve(self.schema, ref)
        return Value(column_at(path), t)

    def value(self, n: Node) -> Value:
        if isinstance(n, Col):
            v = self.column(n)
            if isinstance(v.type, T.ArrayType | T.MapType):
                raise QueryError("RepeatedColumn", f"{n.name} is a LIST or MAP")
            return v
        if isinstance(n, Lit):
            if isinstance(n.value, bool):
                raise QueryError("BooleanLiteral", "true and false belong in predicates")
            return literal(n)
        if isinstance(n, Negate):
            v = self.value(n.arg)
            if v.lane not in ("int", "float", "decimal"):
                raise QueryError("TypeMismatch", "- takes a number")
            return Value(-(v.column.cast("long") if v.lane == "int" else v.column), T.LongType() if v.lane == "int" else v.type)
        if isinstance(n, Binary):
            return arithmetic(n.op, self.value(n.left), self.value(n.right))
        if isinstance(n, Cast):
            v = self.value(n.arg)
            if v.lane != "string" or n.type not in ("varchar", "text", "string"):
                raise QueryError("CastNotSupported", f"to {n.type}: only strings to VARCHAR, TEXT or STRING")
            return v
        if isinstance(n, Case):
            return self._case(n)
        if isinstance(n, Call):
            return self._call(n)
        raise QueryError("PredicateAsValue", "a predicate is not a value; use CASE")

    def _case(self, n: Case) -> Value:
        from strataq.functions.predicates import predicate

        results = [self.value(r) for _, r in n.whens] + [self.value(n.default) if n.default else Value(F.lit(None), T.NullType())]
        results = common(results)
        out = F
        for (cond, _), r in zip(n.whens, results, strict=False):
            out = out.when(predicate(self, cond), r.column)
        return Value(out.otherwise(results[-1].column), results[0].type)

    def _text(self, n: Node, what: str) -> str:
        if not (isinstance(n, Lit) and isinstance(n.value, str)):
            raise QueryError("LiteralNeeded", f"{what} must be a string literal")
        return n.value

    def _call(self, n: Call) -> Value:
        name, args = n.name, n.args
        sizes = {"coalesce": (2, 999), "strlen": (1, 1), "make_date": (1, 1), "epoch_ms": (1, 1), "date_trunc": (2, 2), "date_part": (2, 2), "regexp_replace": (3, 4)}
        if name not in sizes:
            raise QueryError("UnknownFunction", name)
        low, high = sizes[name]
        if not low <= len(args) <= high:
            raise QueryError("WrongArity", f"{name} takes {low}" + (f" to {high}" if high > low else "") + " arguments")
        if name == "coalesce":
            parts = common([self.value(a) for a in args])
            return Value(F.coalesce(*[p.column for p in parts]), parts[0].type)
        if name == "date_trunc":
            return date_trunc(self._text(args[0], "the part").lower(), self.value(args[1]))
        if name == "date_part":
            return date_part(self._text(args[0], "the part").lower(), self.value(args[1]))
        if name == "regexp_replace":
            options = self._text(args[3], "the options") if len(args) == 4 else ""
            return regexp_replace(self.value(args[0]), self._text(args[1], "the pattern"), self._text(args[2], "the replacement"), options)
        v = self.value(args[0])
        if name == "strlen":
            if v.lane != "string":
                raise QueryError("TypeMismatch", "strlen takes a string")
            return Value(F.octet_length(v.column).cast("long"), T.LongType())
        if v.lane != "int":
            raise QueryError("TypeMismatch", f"{name} takes an integer")
        if name == "make_date":
            return Value(F.date_from_unix_date(v.column.cast("int")), T.DateType())
        return Value(F.timestamp_millis(v.column.cast("long")).cast("timestamp_ntz"), T.TimestampNTZType())
