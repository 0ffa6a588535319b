"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A side of a join is broadcast only when it was counted and has at most so many rows (of a few bytes each).
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares for checkpoints. Where none is set, a local master gets one of this machine, as
    in tests; on a cluster that would be lost with its machine, so it is refused."""
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="chronoweave-"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Cells of arrays in a broadcast table.
BROADCAST_CELLS = 2_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS, cells: Column | None = None) -> DataFrame:
    """Marks a checkpointed frame for broadcast if its counted rows are within the bound, and with them the `cells`
    of columns that hold arrays; else it is shuffled."""
    n, held = df.limit(rows + 1).agg(F.count("*"), F.sum(cells) if cells is not None else F.lit(0)).first()
    return F.broadcast(df) if n <= rows and (held or 0) <= BROADCAST_CELLS else df


#: Texts that a worker holds as Python strings at once.
SLICE = 500


def map_texts(df: DataFrame, key: str, column: str, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], columns: str) -> DataFrame:
    """Runs `fn` over frames (key, text) of few rows and returns (key, columns).

    Keys travel as text: a null would turn whole numbers into floats.
    """
    kind = df.schema[key].dataType.simpleString()
    ddl = f"key string, {columns}"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def frames() -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    part = batch.slice(at, SLICE)
                    yield pd.DataFrame({"key": part.column(0).to_pylist(), "text": part.column(1).to_pylist()}, dtype=object)

        for out in fn(frames()):
            yield pa.RecordBatch.from_pandas(out, schema=schema, preserve_index=False)

    out = df.select(F.col(key).cast("string").alias("key"), F.col(column).alias("text")).mapInArrow(run, ddl)
    return out.select(F.col("key").cast(kind).alias(key), *out.columns[1:])


def words(text: str | None) -> list[str]:
    """Lower-cased words between white space."""
    return text.lower().split() if text else []


class WordHashes(dict):
    """64-bit hash of each word, remembered up to a bound."""

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) >= self.limit:
            self.clear()
        self[word] = value
        return value

    def of(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of `size` words; a shorter text is one run."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.uint64)
    k = min(size, n)
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n - k + 1 + i]
    return np.unique(mix(out))


def grouped(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[pa.Table], pa.Table | None], schema: str, tasks: int | None = None) -> DataFrame:
    """`fn` gets the rows of each key together. Keys must be such that a group fits in memory.
    `tasks` fixes the number of tasks, for groups of few bytes and much work.

    Groups stream through sorted partitions, which costs far less for each small group than applyInPandas.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        last = None

        def emit(part: pa.Table) -> Iterator[pa.RecordBatch]:
            out = fn(part)
            if out is not None and out.num_rows:
                yield from out.to_batches(max_chunksize=10_000)

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            cols = [t.column(k).to_pylist() for k in keys]
            names = list(zip(*cols, strict=True))
            start = 0
            for i in range(len(names)):
                if names[i] != last:
                    if last is not None:
                        if i > start:
                            held.append(t.slice(start, i - start))
                        if held:
                            yield from emit(pa.concat_tables(held))
                        held = []
                    start, last = i, names[i]
            held.append(t.slice(start))
        if held:
            yield from emit(pa.concat_tables(held))

    dealt = df.repartition(tasks, *keys) if tasks else df.repartition(*keys)
    return dealt.sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
