"""What is known of a pipeline between two stages."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.plans.expressions import Scope
from rivulet.plans.profile import Profile


@dataclass(frozen=True)
class State:
    """order: (column, descending) of the rows' order, None where a stage has destroyed it. sorted: whether a sort
    stage gave the order. reshaped: the rows are no events any more, so that unknown names are errors."""

    df: DataFrame
    profile: Profile
    engine: object
    start: datetime | None
    end: datetime | None
    now: datetime
    order: tuple[tuple[str, bool], ...] | None
    created: frozenset[str] = frozenset()
    sorted: bool = False
    reshaped: bool = False
    aliases: dict[str, str] = field(default_factory=dict)

    @property
    def time(self) -> str | None:
        return self.profile.time if self.profile.time in self.df.columns else None

    def scope(self) -> Scope:
        profile = replace(self.profile, json=(), maps=()) if self.reshaped else self.profile
        return Scope(self.df, profile, self.created, self.engine, self.reshaped, self.aliases, self.now)

    def to(self, df: DataFrame, **changes) -> State:
        order = changes.get("order", self.order)
        if order and not all(c in df.columns for c, _ in order):
            changes["order"] = None
        return replace(self, df=df, **changes)

    def rows(self, df: DataFrame, created=(), **changes) -> State:
        """After a stage whose rows are results rather than events."""
        return replace(self, df=df, created=frozenset(df.columns) | frozenset(created), reshaped=True, order=changes.pop("order", None), sorted=False, **changes)

    def keys(self, reverse: bool = False) -> list[Column]:
        out = []
        for name, desc in self.order or ():
            c = F.col(f"`{name}`")
            out.append(c.desc_nulls_last() if desc != reverse else c.asc_nulls_first())
        return out

    def ordered(self) -> DataFrame:
        return self.df.orderBy(*self.keys()) if self.order else self.df
