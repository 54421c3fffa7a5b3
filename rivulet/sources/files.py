"""Files as lookups: JSON is flattened to dotted columns, scalars take the type they all have."""

from __future__ import annotations

import csv
import io
import json
import os
import re
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.plans.errors import QueryError

#: A fetched file has so many rows and bytes at most, as it passes through the driver.
MOST_ROWS, MOST_BYTES = 100_000, 64_000_000


def flatten(x, prefix: str = "") -> dict:
    out = {}
    for k, v in x.items():
        if isinstance(v, dict):
            out |= flatten(v, f"{prefix}{k}.")
        else:
            out[f"{prefix}{k}"] = json.dumps(v) if isinstance(v, list) else v
    return out


def scalar(text):
    if not isinstance(text, str):
        return text
    if text == "":
        return None
    if re.fullmatch(r"-?(0|[1-9]\d{0,17})", text):
        return int(text)
    if re.fullmatch(r"-?\d+\.\d+([eE][+-]?\d+)?", text):
        return float(text)
    return {"true": True, "false": False}.get(text.lower(), text)


def parse(raw: str, kind: str) -> list[dict]:
    if kind == "csv":
        return [{k: scalar(v) for k, v in r.items() if k is not None} for r in csv.DictReader(io.StringIO(raw))]
    try:
        got = json.loads(raw)
    except ValueError:
        got = [json.loads(line) for line in raw.splitlines() if line.strip()]
    if isinstance(got, dict):
        got = next((v for v in got.values() if isinstance(v, list) and v and isinstance(v[0], dict)), [got])
    return [flatten(r) if isinstance(r, dict) else {"value": r} for r in got]


def frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    names = list(dict.fromkeys(k for r in rows for k in r))
    fields = []
    for n in names:
        kinds = {type(r[n]) for r in rows if r.get(n) is not None}
        kind = T.BooleanType() if kinds == {bool} else T.LongType() if kinds == {int} else T.DoubleType() if kinds and kinds <= {int, float} else T.StringType()
        fields.append(T.StructField(n, kind))
    cast = {T.DoubleType: float, T.StringType: lambda v: v if isinstance(v, str) else json.dumps(v)}
    data = [tuple(None if r.get(f.name) is None else cast.get(type(f.dataType), lambda v: v)(r[f.name]) for f in fields) for r in rows]
    return spark.createDataFrame(data, T.StructType(fields))


def fetch(spark: SparkSession, url: str, kind: str | None, max_rows: int, allowed: tuple[str, ...]) -> DataFrame:
    """A local file of one of the allowed folders; nothing is fetched from a network."""
    u = urlparse(url)
    if u.scheme not in ("", "file"):
        raise QueryError(f"only local files can be looked up, not {u.scheme}:")
    path = os.path.realpath(u.path)
    if not any(path.startswith(os.path.realpath(a) + os.sep) for a in allowed):
        raise QueryError("the file is in no allowed folder")
    if os.path.getsize(path) > MOST_BYTES:
        raise QueryError("the file is too large")
    with open(path, encoding="utf-8") as f:
        rows = parse(f.read(), kind or ("csv" if path.endswith(".csv") else "json"))
    if len(rows) > MOST_ROWS and not max_rows:
        raise QueryError(f"the file has more than {MOST_ROWS} rows; max_rows= takes the first of them")
    return frame(spark, rows[: max_rows or len(rows)])


def read(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """A dataset from Parquet, ORC, JSON lines or CSV, by its ending; nested JSON becomes dotted columns."""
    kind = kind or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("parquet", "orc"):
        return getattr(spark.read, kind)(path)
    if kind == "csv":
        return spark.read.csv(path, header=True, inferSchema=True)
    if kind in ("json", "jsonl", "ndjson"):
        return dotted(spark.read.json(path))
    raise QueryError(f"unknown kind of file: {kind}")


def dotted(df: DataFrame) -> DataFrame:
    cols = []

    def walk(schema: T.StructType, names: list[str]) -> None:
        for f in schema.fields:
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, [*names, f.name])
            else:
                cols.append(F.col(".".join(f"`{n}`" for n in [*names, f.name])).alias(".".join([*names, f.name])))

    walk(df.schema, [])
    return df.select(cols)
