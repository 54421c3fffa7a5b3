"""What the corpus operators share: reading tables, scratch tables that survive lost executors, folds."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII characters that end a word in the contracts of this subpackage.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where it is unset: a temporary folder in local mode, else
    a folder in the warehouse, which all executors see."""
    if shared := spark.conf.get("spark.checkpoint.dir", None):
        return shared
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    if not hasattr(scratch_dir, "own"):
        scratch_dir.own = tempfile.mkdtemp(prefix="rivulet-")
        atexit.register(shutil.rmtree, scratch_dir.own, ignore_errors=True)
    return scratch_dir.own


def materialise(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; -1 for a null id, so that such rows are in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % n, F.lit(-1))


#: Bytes of text that make() gets at a time, unless a single row has more.
SLICE_BYTES = 4 << 20


def slices(columns: list, rows: int, most: int = SLICE_BYTES):
    """start, length: runs of at most rows rows and, beyond one row, most bytes of text; columns are pyarrow's."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    n = len(columns[0])
    size = np.zeros(n, np.int64)
    for c in columns:
        if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_binary(c.type):
            size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(size), 0
    while at < n:
        before = int(ends[at - 1]) if at else 0
        end = max(at + 1, min(n, at + rows, int(np.searchsorted(ends, before + most, side="right"))))
        yield at, end - at
        at = end


def map_batches(df: DataFrame, keep: list[str], inputs: list[Column], schema: str, make, rows: int = 512, done=None) -> DataFrame:
    """df's columns keep, and behind them the columns of schema that make(*inputs) returns.

    make gets pyarrow arrays of at most rows rows and SLICE_BYTES of text, or of one row, and returns one sequence for
    each column of schema. It runs in Python workers on Arrow batches. done() is called at the end of each task."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    made = StructType.fromDDL(schema) if hasattr(StructType, "fromDDL") else df.sparkSession.createDataFrame([], schema).schema
    kept, k = df.select(*keep).schema, len(keep)
    out = StructType(kept.fields + made.fields)

    def run(batches):
        arrow = to_arrow_schema(out)
        types = [arrow.field(i).type for i in range(len(arrow))]
        try:
            for batch in batches:
                for at, n in slices(batch.columns[k:], rows) if batch.num_rows else ():
                    part = batch.slice(at, n)
                    new = make(*part.columns[k:])
                    cols = [part.column(i).cast(types[i]) for i in range(k)] + [pa.array(x, types[k + i]) for i, x in enumerate(new)]
                    yield pa.RecordBatch.from_arrays(cols, schema=arrow)
        finally:
            if done:
                done()

    # Inputs get names of their own, as keep may hold the same columns.
    return df.select(*keep, *[c.alias(f"__in{i}") for i, c in enumerate(inputs)]).mapInArrow(run, out)
