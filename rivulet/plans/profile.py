"""Schema profiles: how names of a query find columns of a dataset."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType


@dataclass(frozen=True)
class Profile:
    """time: the time column. body: columns that keywords search. aliases: other names of columns. json: columns of
    JSON text in which an unknown name is a path. maps: columns of maps in which it is a key, in order. enums: names
    for the numbers of a column. empty_is_absent: whether isnull, coalesce and fillnull take '' for absent. build: how an aggregate is made
    of the columns, where these are partial states. day: a column of the time's day (UTC) by which the dataset is partitioned."""

    name: str
    time: str
    body: tuple[str, ...] = ()
    aliases: dict[str, str] = field(default_factory=dict)
    json: tuple[str, ...] = ()
    maps: tuple[str, ...] = ()
    enums: dict[str, dict[str, int]] = field(default_factory=dict)
    observables: tuple[str, ...] = ()
    entity: tuple[str, ...] = ("user", "src_host", "host", "src_ip", "dest_ip")
    empty_is_absent: bool = False
    build: Callable | None = None
    day: str | None = None

    def resolve(self, name: str, schema: StructType, created: frozenset[str]) -> tuple[Column, DataType] | None:
        """The column of a name; a column that a stage created goes before an alias. None if there is none."""
        names = {f.name: f.dataType for f in schema.fields}
        if name in names and (name in created or name not in self.aliases):
            return F.col(f"`{name}`"), names[name]
        if (real := self.aliases.get(name, name)) in names:
            return F.col(f"`{real}`"), names[real]
        for m in self.maps:
            if m in names and isinstance(names[m], MapType):
                found = [F.col(f"`{c}`").getItem(name) for c in self.maps if c in names]
                return F.coalesce(*found), StringType()
        for j in self.json:
            if j in names:
                path = name.removeprefix(f"{j}.").removeprefix("ext.")
                return F.get_json_object(F.col(f"`{j}`"), "$." + path), StringType()
        if "." in name and name.split(".")[0] in names and isinstance(names[name.split(".")[0]], StructType):
            return F.col(name), StringType()
        return None


def is_array(kind: DataType) -> bool:
    return isinstance(kind, ArrayType)


EVENTS = Profile("events", "ts", ("props", "event_type"), {"_time": "ts", "timestamp": "ts", "action": "event_type", "user": "user_id", "bytes": "value", "sourcetype": "event_type", "id": "event_id"}, json=("props",))
LOGS = Profile("logs", "timestamp", ("message", "raw"), {"_time": "timestamp", "sourcetype": "source_type"}, json=("ext",), enums={"protocol_num": {"icmp": 1, "tcp": 6, "udp": 17}}, observables=("src_ip", "dest_ip", "url", "domain", "file_hash", "dest_host"))
SPANS = Profile("spans", "start_time", ("span_name",), {"duration": "duration_ns", "dur": "duration_ns", "service": "service_name", "status": "status_code", "_time": "start_time", "timestamp": "start_time"}, maps=("attributes", "resource_attributes"))
METRICS = Profile("metrics", "timestamp", ("metric_name",), {"metric": "metric_name", "name": "metric_name", "service": "service_name", "type": "metric_type", "_time": "timestamp"}, maps=("attributes", "resource_attributes"))
RISK = Profile("risk", "last_finding_at", ("entity",), {"_time": "last_finding_at", "timestamp": "last_finding_at"})
SIGNALS = Profile("signals", "timestamp", ("rule_name", "entity"), {"_time": "timestamp"})
