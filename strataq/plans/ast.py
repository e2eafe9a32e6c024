"""Syntax of expressions, predicates and queries, before any schema is known."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal


class Node:
    """Any expression or predicate."""


@dataclass(frozen=True)
class Col(Node):
    """A column by name; parts has more than one element for a quoted path such as "a"."b"."""

    name: str
    parts: tuple[str, ...] = ()


@dataclass(frozen=True)
class Lit(Node):
    """value: int, Decimal, str, bool or None. digits: as written, which give a decimal its type."""

    value: int | Decimal | str | bool | None
    digits: str = ""


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Negate(Node):
    arg: Node


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]


@dataclass(frozen=True)
class Cast(Node):
    arg: Node
    type: str


@dataclass(frozen=True)
class Case(Node):
    whens: tuple[tuple[Node, Node], ...]
    default: Node | None


@dataclass(frozen=True)
class Agg(Node):
    """fn: count, count_distinct, sum, min, max, avg or avg_state; arg None is count(*)."""

    fn: str
    arg: Node | None
    where: Node | None = None


@dataclass(frozen=True)
class Compare(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Logic(Node):
    op: str
    args: tuple[Node, ...]


@dataclass(frozen=True)
class Not(Node):
    arg: Node


@dataclass(frozen=True)
class In(Node):
    arg: Node
    items: tuple[Node, ...]


@dataclass(frozen=True)
class Between(Node):
    arg: Node
    low: Node
    high: Node


@dataclass(frozen=True)
class Like(Node):
    arg: Node
    pattern: Node


@dataclass(frozen=True)
class IsNull(Node):
    arg: Node


@dataclass(frozen=True)
class Item:
    """One output column. text: as written, for naming."""

    expr: Node
    alias: str | None = None
    text: str = ""


@dataclass(frozen=True)
class Order:
    expr: Node
    descending: bool = False


@dataclass
class Query:
    """items None is SELECT *; columns is a projection in the order of the schema."""

    items: list[Item] | None = None
    columns: list[str] | None = None
    source: str | None = None
    where: Node | None = None
    group: list[Item] = field(default_factory=list)
    having: Node | None = None
    order: list[Order] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0
    column_order: list[str] | None = None

    @property
    def kind(self) -> str:
        if self.group:
            return "grouped"
        found = [*(i.expr for i in self.items or ()), *([self.having] if self.having else []), *(o.expr for o in self.order)]
        return "scalar" if any(has_aggregate(e) for e in found) else "rows"


def children(n: Node) -> list[Node]:
    if isinstance(n, Binary | Compare):
        return [n.left, n.right]
    if isinstance(n, Call | Logic):
        return list(n.args)
    if isinstance(n, Case):
        return [x for w in n.whens for x in w] + ([n.default] if n.default else [])
    if isinstance(n, Agg):
        return [x for x in (n.arg, n.where) if x]
    if isinstance(n, In):
        return [n.arg, *n.items]
    if isinstance(n, Between):
        return [n.arg, n.low, n.high]
    if isinstance(n, Like):
        return [n.arg, n.pattern]
    if isinstance(n, Negate | Cast | Not | IsNull):
        return [n.arg]
    return []


def has_aggregate(n: Node) -> bool:
    return isinstance(n, Agg) or any(map(has_aggregate, children(n)))


def depth(n: Node) -> int:
    return 1 + max([0, *map(depth, children(n))])
