"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables, read by Spark (any file system it knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def use_checkpoints(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; a local one only where that is unset and Spark is local (tests)."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))


def saved(df: DataFrame) -> DataFrame:
    """The rows, computed once and written as a Parquet table in the shared checkpoint folder.

    Lost executors cannot take them along, and Spark knows their size when it plans a join.
    """
    spark = df.sparkSession
    use_checkpoints(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``saved`` that nothing reads any more: what came from them is written itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def free_names(df: DataFrame, names: list[str]) -> list[str]:
    """Names like these that no column of ``df`` has, in any case."""
    used = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


#: Bits of the map of keys in ``maybe_among``: 64 in a row, so 2**19 rows and about 8 MB at most.
KEY_BITS = 1 << 25


def maybe_among(df: DataFrame, key: Column, keys: DataFrame, key_of: Column) -> DataFrame:
    """The rows of ``df`` whose key may be among ``keys``: all that are, and few others, before an exact join shuffles them.

    What is sent to all tasks is a map of KEY_BITS bits, however many keys there are. With more keys
    than bits it lets more rows pass, which costs time and never changes the join.
    """
    word, bit = F.shiftright("__cell", 6), F.expr("shiftleft(1L, cast(__cell & 63 AS int))")
    cells = keys.select(F.pmod(F.xxhash64(key_of), F.lit(KEY_BITS)).alias("__cell"))
    words = cells.groupBy(word.alias("__word")).agg(F.bit_or(bit).alias("__bits"))
    asked = df.withColumn("__cell", F.pmod(F.xxhash64(key), F.lit(KEY_BITS)))
    there = asked.join(F.broadcast(words), word == F.col("__word")).where(F.col("__bits").bitwiseAND(bit) != 0)
    return there.select(*[F.col(f"`{c}`") for c in df.columns])


def with_columns(df: DataFrame, inputs: list[str], outputs: list[T.StructField], fn: Callable[[list[pa.Array]], list]) -> DataFrame:
    """Add columns that ``fn`` makes, one Arrow batch at a time, from the input columns.

    ``fn`` gets one Arrow array for each input and gives one list or array for each output.
    Columns of ``df`` that have the name of an output are replaced; all others pass unchanged, and an
    input that passes is sent to the workers once.
    There is no shuffle, and rows keep their identity, so repeated rows and null keys are safe.
    """
    made = [f.name for f in outputs]
    keep = [c for c in df.columns if c not in made]
    gone = [c for c in dict.fromkeys(inputs) if c not in keep]
    source = df.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"`{c}`").alias(f"__in{i}") for i, c in enumerate(gone)])
    at = [[*keep, *gone].index(c) for c in inputs]
    schema = T.StructType([*[df.schema[c] for c in keep], *outputs])
    types = [_arrow_type(f.dataType) for f in outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, max(b.num_rows, 1), 1000)):
            old = [batch.column(i) for i in range(len(keep))]
            new = fn([batch.column(i) for i in at])
            new = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) and x.type == t else pa.array(x, type=t) for x, t in zip(new, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*old, *new], names=[*keep, *made])
        forget()

    return source.mapInArrow(run, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def chunks(texts: list[str | bytes], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Index ranges whose texts have about ``most`` characters together; a longer text stands alone, whole."""
    start = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > most:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


#: What a Python worker keeps between batches; emptied at the end of each task, as workers live on.
CACHES: list[dict] = []


def forget() -> None:
    """Empty the caches and give what is free back to the system: idle workers take memory beside the next stage's executor."""
    for cache in CACHES:
        cache.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc, which else keeps what is freed between used pieces
        trim(0)


class Cache(dict):
    """A dictionary that fills itself by ``make`` and starts anew beyond ``most`` entries."""

    def __init__(self, make: Callable, most: int = 150_000) -> None:
        super().__init__()
        self.make, self.most = make, most
        CACHES.append(self)

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()
