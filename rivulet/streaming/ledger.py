"""Upkeep of partial rows that a stream writes: folders of Parquet files, and commits that say which of them are there.

A commit is a small file, numbered, that names all folders which are there from then on. It comes into being at once or
not at all, and only one writer gets a number; who comes second looks again. So readers see each micro-batch once,
also while folders are merged: what they have planned stays readable until `clean`. A micro-batch that is repeated
after a failure is known by its number and not written again. Merging goes by levels: FAN folders of one level become
one of the next, so that each row is rewritten once a level, and the number of folders grows with the logarithm of
that of micro-batches."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Folders of a level that are merged to one of the next. Commits that stay readable besides the last.
FAN, HISTORY = 8, 20


class Ledger:
    """path: on any file system that Spark reaches. schema: of the partial rows."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._jvm = spark.sparkContext._jvm
        self._hadoop = self._jvm.org.apache.hadoop.fs
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    # -- commits ----------------------------------------------------------------------------------------------
    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._at("_commits")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("_commits"))]
        return sorted(int(n) for n in names if n.isdigit())

    def _read(self, number: int) -> dict:
        stream = self._fs.open(self._at(f"_commits/{number:012d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict]:
        """The number and the content of the last commit: folders (name, level), batches (name of a stream to its last
        batch), gone (folders that are no longer there, with the time of their end)."""
        numbers = self._numbers()
        return (numbers[-1], self._read(numbers[-1])) if numbers else (0, {"folders": [], "batches": {}, "gone": []})

    def _commit(self, number: int, content: dict) -> bool:
        """Whether the commit has got its number."""
        draft, final = self._at(f"_commits/.{uuid.uuid4().hex}"), self._at(f"_commits/{number:012d}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        context = self._hadoop.FileContext.getFileContext(self._at("").toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(final), none)  # fails if it is there
            return True
        except Exception as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise

    def commit(self, change: Callable[[dict], dict | None]) -> bool:
        """Commits change(content of the last commit), again if another writer was faster; not if it gives None."""
        while True:
            number, content = self.latest()
            new = change(json.loads(json.dumps(content)))
            if new is None:
                return False
            if self._commit(number + 1, new):
                return True

    # -- rows -------------------------------------------------------------------------------------------------
    def read(self) -> DataFrame:
        """The rows of all folders of the last commit."""
        folders = [f"{self.path}/data/{name}" for name, _ in self.latest()[1]["folders"]]
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def append(self, rows: DataFrame, batch: int, stream: str = "main") -> bool:
        """Adds the rows of a micro-batch, unless it or a later one of the stream has been added."""
        if self.latest()[1]["batches"].get(stream, -1) >= batch:
            return False
        name = f"{stream}-{batch}-{uuid.uuid4().hex}"
        rows.select(self.schema.names).write.parquet(f"{self.path}/data/{name}")

        def change(now: dict) -> dict | None:
            if now["batches"].get(stream, -1) >= batch:
                return None  # another attempt of the same batch was faster
            now["folders"].append([name, 0])
            now["batches"][stream] = batch
            return now

        if not self.commit(change):
            self._fs.delete(self._at(f"data/{name}"), True)
            return False
        return True

    def compact(self, merge: Callable[[DataFrame], DataFrame], fan: int = FAN) -> int:
        """Merges folders of a level while there are fan of them; how often. merge: partial rows to fewer ones."""
        done = 0
        while True:
            by: dict[int, list[str]] = {}
            for name, level in self.latest()[1]["folders"]:
                by.setdefault(level, []).append(name)
            if not (full := [level for level in sorted(by) if len(by[level]) >= fan]):
                return done
            level, old = full[0], by[full[0]]
            name = f"level{full[0] + 1}-{uuid.uuid4().hex}"
            rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{x}" for x in old])
            merge(rows).select(self.schema.names).write.parquet(f"{self.path}/data/{name}")

            def change(now: dict, old=old, name=name, level=level) -> dict | None:
                if not set(old) <= {x for x, _ in now["folders"]}:
                    return None  # merged by another writer meanwhile
                now["folders"] = [f for f in now["folders"] if f[0] not in old] + [[name, level + 1]]
                now["gone"] += [[x, time.time()] for x in old]
                return now

            if self.commit(change):
                done += 1
            else:
                self._fs.delete(self._at(f"data/{name}"), True)

    def clean(self, keep: float = 3600) -> None:
        """Deletes folders that were merged keep seconds ago, what failed attempts of that age have left, and commits
        beyond the last HISTORY ones. A query that was planned longer ago may no longer find its files."""
        before = time.time() - keep
        _, now = self.latest()
        old = [name for name, at in now["gone"] if at < before]

        def change(x: dict) -> dict | None:
            x["gone"] = [g for g in x["gone"] if g[0] not in old]
            return x

        known = {name for name, _ in now["folders"]} | {name for name, _ in now["gone"]}
        if self._fs.exists(self._at("data")):
            for s in self._fs.listStatus(self._at("data")):
                if s.getPath().getName() in old or s.getPath().getName() not in known and s.getModificationTime() / 1000 < before:
                    self._fs.delete(s.getPath(), True)
        if old:
            self.commit(change)
        for number in self._numbers()[: -1 - HISTORY]:
            self._fs.delete(self._at(f"_commits/{number:012d}"), False)

    def stream(self, df: DataFrame, partials: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame], checkpoint: str, name: str = "main", fan: int = FAN):
        """Starts a query that adds partials(batch) of each micro-batch, and merges folders as they become many."""

        def write(batch: DataFrame, number: int) -> None:
            if self.append(partials(batch), number, name):
                self.compact(merge, fan)

        return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
