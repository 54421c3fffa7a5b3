"""Syntax trees: expressions, search terms, stages."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Lit:
    value: Any  # str, float, int, bool or None
    kind: str = "string"  # string, number, bool, null, regex, cidr, span
    quoted: bool = False


@dataclass(frozen=True)
class Field:
    name: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Op:
    """op: + - * / % . = != < > <= >= =~ !~ and or not like contains startswith endswith"""

    op: str
    args: tuple


@dataclass(frozen=True)
class In:
    value: Any
    items: tuple = ()
    query: "Query | None" = None
    negated: bool = False


@dataclass(frozen=True)
class Keyword:
    text: str
    quoted: bool = False


@dataclass(frozen=True)
class Term:
    """field op value of a search, where * and ? in the value are globs."""

    field: str
    op: str
    value: Lit


@dataclass(frozen=True)
class Ioc:
    """ioc = v, ioc in [...], ioc in lookup("t", "col"): any observable column."""

    items: tuple = ()
    source: str | None = None
    name: str | None = None
    column: str | None = None


@dataclass(frozen=True)
class Agg:
    func: str
    arg: Any = None  # expression or None for count
    alias: str | None = None
    param: float | None = None
    where: Any = None  # of func(eval(condition)) for count, or a second argument


@dataclass
class Stage:
    name: str
    args: dict = field(default_factory=dict)

    def get(self, key: str, default=None):
        return self.args.get(key, default)


@dataclass
class Query:
    search: Any  # search tree or None for all
    stages: list[Stage]
    dataset: str | None = None
    earliest: str | None = None
    latest: str | None = None
