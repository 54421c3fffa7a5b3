"""Bounds of a query once the names that eval gives are replaced by what they stand for, as the optimizer may do. A name
that doubles from stage to stage is small to write and huge to plan; it is refused before there is a plan.

Each name is measured once, by the measures of the names in it, so that this takes time in proportion to the text."""

from __future__ import annotations

from dataclasses import fields, is_dataclass

from rivulet.plans.ast import Call, Field, Lit, Query, Stage
from rivulet.plans.errors import QueryError

# Fixed values.
MAX_FUNCTION_NESTING = 64
MAX_DEPTH = 2048
MAX_NODES = 100_000
MAX_TOTAL_NODES = 400_000
MAX_COMMANDS = 256

#: depth, nesting of functions, nodes.
Size = tuple[int, int, int]
LEAF: Size = (1, 0, 1)
#: Stages behind which the rows have columns of their own, so that earlier names stand for nothing any more.
RESHAPING = frozenset("stats chart timechart top rare transaction sequence funnel tree lateral baseline retro asset cloud services service metric".split())


class _Budget:
    def __init__(self):
        self.total = self.commands = 0

    def of(self, x, names: dict[str, Size]) -> Size:
        """The size of an expression, or of all expressions in a list or tree; a subsearch counts by itself."""
        if isinstance(x, Field):
            return names.get(x.name, LEAF)
        if isinstance(x, Query):
            self.query(x)
            return LEAF
        if isinstance(x, dict):
            parts = list(x.values())
        elif isinstance(x, (list, tuple, frozenset, set)):
            parts = [Field(p) if isinstance(p, str) else p for p in x]
        elif is_dataclass(x) and not isinstance(x, Lit):
            parts = [p for f in fields(x) if not isinstance(p := getattr(x, f.name), (str, int, float, bool, type(None)))]
        else:
            return LEAF
        sizes = [self.of(p, names) for p in parts]
        depth, nesting, nodes = max((s[0] for s in sizes), default=0), max((s[1] for s in sizes), default=0), sum(s[2] for s in sizes)
        own = is_dataclass(x)
        return depth + own, nesting + isinstance(x, Call), nodes + own

    def add(self, size: Size) -> Size:
        if size[1] > MAX_FUNCTION_NESTING:
            raise QueryError(f"functions lie {size[1]} deep in each other once names are replaced, more than {MAX_FUNCTION_NESTING}")
        if size[0] > MAX_DEPTH:
            raise QueryError(f"an expression is {size[0]} deep once names are replaced, more than {MAX_DEPTH}")
        if size[2] > MAX_NODES:
            raise QueryError(f"an expression has {size[2]} parts once names are replaced, more than {MAX_NODES}")
        self.total += size[2]
        if self.total > MAX_TOTAL_NODES:
            raise QueryError(f"the query has more than {MAX_TOTAL_NODES} parts once names are replaced")
        return size

    def query(self, q: Query) -> None:
        names: dict[str, Size] = {}
        self.add(self.of(q.search, names))
        for s in q.stages:
            self.stage(s, names)

    def stage(self, s: Stage, names: dict[str, Size]) -> None:
        self.commands += 1
        if self.commands > MAX_COMMANDS:
            raise QueryError(f"a query has at most {MAX_COMMANDS} stages, subsearches included")
        if s.name == "eval":
            for name, x in s.args["assign"]:
                names[name] = self.add(self.of(x, names))
            return
        if s.name == "rename":
            for old, new in s.args["pairs"]:
                if old in names:
                    names[new] = names.pop(old)
            return
        self.add(self.of(s.args, names))
        if s.name in RESHAPING:
            names.clear()


def check(q: Query) -> Query:
    _Budget().query(q)
    return q
