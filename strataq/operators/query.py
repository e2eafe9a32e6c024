"""Bound queries as DataFrames: rows, scalar and grouped."""

from __future__ import annotations

import threading
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataq.functions.aggregates import aggregate
from strataq.functions.predicates import Scope, lower, predicate
from strataq.functions.values import Binder, Value
from strataq.plans.ast import Agg, Binary, Case, Cast, Col, Item, Lit, Node, Order, Query, children, has_aggregate
from strataq.plans.errors import QueryError
from strataq.plans.resolve import column_at, resolve

ORDINAL = "__ordinal"
_BUILDING = threading.RLock()


@contextmanager
def exact_decimals(df: DataFrame):
    """Decimal results keep their scale while expressions are built; the session's setting comes back after.

    One thread at a time: the setting is the session's.
    """
    conf, key = df.sparkSession.conf, "spark.sql.decimalOperations.allowPrecisionLoss"
    with _BUILDING:
        before = conf.get(key)
        conf.set(key, "false")
        try:
            yield
        finally:
            conf.set(key, before)


@dataclass
class Output:
    name: str
    expr: Node


def _named(items: list[Item], binder: Binder) -> list[Output]:
    """Names: the alias; a column's own name or path; an aggregate's function, or its text if that is taken."""
    out: list[Output] = []
    taken = {i.alias.lower() for i in items if i.alias}
    for i in items:
        name = i.alias
        if name is None and isinstance(i.expr, Col):
            name = ".".join(resolve(binder.schema, i.expr)[0])
        elif name is None and isinstance(i.expr, Agg):
            name = "count" if i.expr.fn == "count_distinct" else i.expr.fn
            if name.lower() in taken:
                name = i.text
        elif name is None:
            name = i.text
        if name.lower() in {o.name.lower() for o in out}:
            raise QueryError("DuplicateColumn", f"two columns are named {name}")
        taken.add(name.lower())
        out.append(Output(name, i.expr))
    return out


def _same(a: Node, b: Node, schema: T.StructType) -> bool:
    """Equal by what they refer to, not by spelling."""
    if isinstance(a, Col) and isinstance(b, Col):
        return resolve(schema, a)[0] == resolve(schema, b)[0]
    if type(a) is not type(b):
        return False
    x, y = children(a), children(b)
    plain = lambda n: {k: v for k, v in vars(n).items() if not isinstance(v, Node | tuple)}
    return len(x) == len(y) and plain(a) == plain(b) and all(_same(p, q, schema) for p, q in zip(x, y, strict=True))


def _has_column(schema: T.StructType, ref: Col) -> bool:
    try:
        resolve(schema, ref)
    except QueryError as e:
        return e.code != "ColumnNotFound"
    return True


def _positional(expr: Node, outputs: list[Output]) -> Output | None:
    if isinstance(expr, Lit) and type(expr.value) is int:
        if not 1 <= expr.value <= len(outputs):
            raise QueryError("BadPosition", f"no column {expr.value}")
        return outputs[expr.value - 1]
    return None


def _by_alias(expr: Node, outputs: list[Output], schema: T.StructType, *, column_first: bool) -> Output | None:
    if not isinstance(expr, Col) or (column_first and _has_column(schema, expr)):
        return None
    return next((o for o in outputs if o.name.lower() == expr.name.lower()), None)


def _sorted(df: DataFrame, keys: list[tuple[Column, bool]], tie: Column | None) -> DataFrame:
    order = [c.desc_nulls_last() if down else c.asc_nulls_last() for c, down in keys]
    if tie is not None:
        order.append(tie.asc())
    return df.orderBy(*order) if order else df


def _cut(df: DataFrame, q: Query) -> DataFrame:
    if q.offset:
        df = df.offset(q.offset)
    return df if q.limit is None else df.limit(q.limit)


def needs_place(q: Query, ordered: bool) -> bool:
    """Whether the answer depends on where rows are in the input."""
    cut = q.limit is not None or bool(q.offset)
    if q.limit == 0:
        return False
    if q.kind == "rows":
        return ordered or cut
    return bool(q.group) and (ordered or (cut and not q.order))


def refuse_repeated(t: T.DataType, name: str) -> None:
    if isinstance(t, T.ArrayType | T.MapType):
        raise QueryError("RepeatedColumn", f"{name} is a LIST or MAP")


def execute(df: DataFrame, q: Query, *, ordinal: Column | None = None, ordered: bool = False, copy: bool = False) -> DataFrame:
    """The answer. ordinal: each row's place in the input; needed if ordered, for a LIMIT without order and for ties.

    copy: rows go to a file as they are, so whole LIST and MAP columns may pass.
    """
    with exact_decimals(df):
        if q.having is not None and q.kind == "rows":
            raise QueryError("HavingWithoutAggregate", "HAVING needs an aggregate or GROUP BY")
        if q.kind == "rows":
            return _rows(df, q, ordinal, ordered, copy)
        if q.items is None:
            raise QueryError("StarWithAggregate", "SELECT * has no groups")
        return _grouped(df, q, ordinal, ordered)


def _rows(df: DataFrame, q: Query, ordinal: Column | None, ordered: bool, copy: bool) -> DataFrame:
    schema = T.StructType([f for f in df.schema.fields if f.name != ORDINAL])
    binder = Binder(schema)
    rows = df if q.where is None else df.where(predicate(binder, q.where))
    if q.items is not None:
        outputs = _named(q.items, binder)
        made = []
        for o in outputs:
            if isinstance(o.expr, Col):
                path, t = resolve(schema, o.expr)
                if not copy:
                    refuse_repeated(t, o.name)
                made.append((o, column_at(path)))
            else:
                made.append((o, binder.value(o.expr).column))
    else:
        wanted = q.columns
        names = [f.name for f in schema.fields]
        if wanted is not None:
            paths = [resolve(schema, Col(c))[0] for c in wanted]
            chosen = [p for n in names for p in sorted({p for p in paths if p[0] == n})]
        else:
            chosen = [(n,) for n in names]
        outputs = [Output(".".join(p), Col(p[0], p)) for p in chosen]
        for o, p in zip(outputs, chosen, strict=True):
            if not copy:
                refuse_repeated(resolve(schema, Col(p[0], p))[1], o.name)
        made = [(o, column_at(p)) for o, p in zip(outputs, chosen, strict=True)]
    keys: list[tuple[Column, bool]] = []
    for o in q.order:
        at = _positional(o.expr, outputs) or _by_alias(o.expr, outputs, schema, column_first=True)
        c = next(c for x, c in made if x is at) if at else binder.value(o.expr).column
        keys.append((c, o.descending))
    if keys or ((ordered or q.limit is not None or q.offset) and ordinal is not None):
        rows = _sorted(rows, keys, ordinal)
    return _cut(rows, q).select(*[c.alias(o.name) for o, c in made])


class _Groups:
    """Keys and aggregates as columns of one aggregation, each different one once."""

    def __init__(self, binder: Binder, keys: list[Output]):
        self.binder, self.schema = binder, binder.schema
        self.keys = [(k, binder.value(k.expr), f"__k{i}") for i, k in enumerate(keys)]
        self.aggs: list[tuple[Agg, Column, T.DataType, str]] = []

    def value(self, expr: Node) -> Value:
        """A key or an aggregate of the aggregated rows."""
        for k, v, name in self.keys:
            if _same(k.expr, expr, self.schema):
                return Value(F.col(name), v.type)
        if isinstance(expr, Agg):
            for a, _, t, name in self.aggs:
                if _same(a, expr, self.schema):
                    return Value(F.col(name), t)
            c, t = aggregate(self.binder, expr)
            name = f"__a{len(self.aggs)}"
            self.aggs.append((expr, c, t, name))
            return Value(F.col(name), t)
        if has_aggregate(expr):
            raise QueryError("AggregateArithmetic", "aggregates can't be parts of expressions")
        if isinstance(expr, Lit):
            return self.binder.value(expr)
        derived = self._derived(expr)
        if derived is None:
            raise QueryError("NotGrouped", "a column must be a key or within an aggregate")
        return derived

    def _derived(self, expr: Node) -> Value | None:
        """An expression over keys alone: computed once per group from the keys."""
        plain = [(k, v, name) for k, v, name in self.keys if isinstance(k.expr, Col)]
        paths = {resolve(self.schema, k.expr)[0]: (v, name) for k, v, name in plain}

        def columns(n: Node) -> list[Col]:
            return [n] if isinstance(n, Col) else [c for x in children(n) for c in columns(x)]

        used = columns(expr)
        if not used or any(resolve(self.schema, c)[0] not in paths for c in used):
            return None
        groups = self

        class Keys(Binder):
            def column(self, ref: Col) -> Value:
                v, name = paths[resolve(groups.schema, ref)[0]]
                return Value(F.col(name), v.type)

        return Keys(self.schema).value(expr)


class _HavingScope(Scope):
    def __init__(self, groups: _Groups, outputs: list[Output]):
        super().__init__(groups.binder)
        self.groups, self.outputs = groups, outputs

    def subject(self, n: Node) -> Value:
        if isinstance(n, Lit):
            raise QueryError("ExpressionInPredicate", "HAVING compares a key or an aggregate with literals")
        by = _by_alias(n, self.outputs, self.groups.schema, column_first=True)
        return self.groups.value(by.expr if by else n)


def _independent(keys: list[Output], binder: Binder) -> list[bool]:
    """Which keys must be grouped by: an expression over keys that are columns follows from them."""
    plain = {resolve(binder.schema, k.expr)[0] for k in keys if isinstance(k.expr, Col)}

    def follows(n: Node) -> bool:
        if isinstance(n, Col):
            return resolve(binder.schema, n)[0] in plain
        return isinstance(n, Binary | Lit | Cast | Case) and all(map(follows, children(n)))

    return [isinstance(k.expr, Col) or not follows(k.expr) or isinstance(k.expr, Lit) for k in keys]


def _grouped(df: DataFrame, q: Query, ordinal: Column | None, ordered: bool) -> DataFrame:
    schema = T.StructType([f for f in df.schema.fields if f.name != ORDINAL])
    binder = Binder(schema)
    rows = df if q.where is None else df.where(predicate(binder, q.where))
    outputs = _named(q.items or [], binder)
    keys: list[Output] = []
    for g in q.group:
        at = _positional(g.expr, outputs) or _by_alias(g.expr, outputs, schema, column_first=True)
        expr = at.expr if at else g.expr
        if has_aggregate(expr):
            raise QueryError("AggregateInGroupBy", "keys are values of rows")
        keys.append(Output(g.alias or g.text, expr))
    for g, k in zip(q.group, keys, strict=True):  # an alias given with a key names it in the output
        if g.alias and not any(o.name == g.alias for o in outputs):
            outputs.append(Output(g.alias, k.expr))
    groups = _Groups(binder, keys)
    made = [(o, groups.value(o.expr).column) for o in outputs]
    scope = _HavingScope(groups, outputs)
    having = None if q.having is None else lower(scope, q.having)
    order = []
    for o in q.order:
        at = _positional(o.expr, outputs) or _by_alias(o.expr, outputs, schema, column_first=False)
        order.append(((next(c for x, c in made if x is at) if at else groups.value(o.expr).column), o.descending))

    first = ordinal is not None and bool(keys) and (ordered or ((q.limit is not None or q.offset) and not order))
    aggs = [c.alias(name) for _, c, _, name in groups.aggs]
    if first:
        aggs.append(F.min(ordinal).alias(ORDINAL))
    if not keys:
        out = rows.agg(*aggs)
    else:
        needed = _independent(keys, binder)
        named = [v.column.alias(name) for (_, v, name), n in zip(groups.keys, needed, strict=True) if n]
        out = rows.groupBy(*named).agg(*(aggs or [F.count(F.lit(1)).alias("__n")]))
        kept = [x for x, n in zip(groups.keys, needed, strict=True) if n]
        for (k, _, name), n in zip(groups.keys, needed, strict=True):
            if not n:
                again = _Groups(binder, [x[0] for x in kept])
                again.keys = kept
                out = out.withColumn(name, again._derived(k.expr).column)
    if having is not None:
        out = out.where(having)
    if order or first:
        out = _sorted(out, order, F.col(ORDINAL) if first else None)
    out = _cut(out, q).select(*[c.alias(o.name) for o, c in made])
    if q.column_order:
        lower_names = [c.lower() for c in q.column_order]
        if sorted(lower_names) != sorted(c.lower() for c in out.columns):
            raise QueryError("BadColumnOrder", "the order must name each output column once")
        out = out.select(*q.column_order)
    return out


__all__ = ["ORDINAL", "Order", "execute", "exact_decimals", "needs_place"]
