"""Helpers shared by the corpus operators: scratch tables, chunking, word memos."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; bounds a worker's memory.
CHUNK_BYTES = 1 << 20
#: Distinct words a worker remembers before it starts afresh.
MEMO_WORDS = 200_000
#: New words whose figures are worked out at a time.
FRESH_WORDS = 1 << 14
#: Bytes of a row group of a scratch table: a writer holds one in memory for each task.
ROW_GROUP = 16 << 20
#: Spark's switch for removing a query's shuffle files when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares for checkpoints; a temporary one only in a single local JVM where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm.isDefined():
            return jvm.get()
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


class Scratch:
    """Written tables in the shared folder that cut lineage between the steps of one operator.

    A lost executor costs a re-read of the last table, not a re-run of the job.
    What no step drops goes when the application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/tidemark-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame) -> DataFrame:
        """Write and read again; the shuffle files of the write go at its end, as nothing reads them again."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        before = self.spark.conf.get(SHUFFLE_CLEANUP, None)
        self.spark.conf.set(SHUFFLE_CLEANUP, "true")
        try:
            df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(SHUFFLE_CLEANUP)
            else:
                self.spark.conf.set(SHUFFLE_CLEANUP, before)
        if self.n == 1:
            self.file_system(self.root).deleteOnExit(self.hadoop_path(self.root))
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads, and let Spark clean the shuffles behind them."""
        for t in tables:
            self.file_system(t.scratch_path).delete(self.hadoop_path(t.scratch_path), True)

    def hadoop_path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def file_system(self, path: str):
        return self.hadoop_path(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def release(self) -> None:
        """Shuffle files go once the driver's JVM collects the plans that made them; executors give unused heap back."""
        import gc

        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        shrink_heaps(self.spark)


def shrink_heaps(spark: SparkSession) -> None:
    """Have the executors collect their garbage, after which a JVM returns heap that it doesn't use.

    A step's sorts leave a heap at its limit; the Python workers of the next step live beside it, in the same container.
    """
    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc') AS done").write.format("noop").mode("overwrite").save()


def held_out(key: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``, equals ``remainder``; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def release_memory() -> None:
    """Give freed memory back to the system: a worker outlives its task, and the next one may need it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", max_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``max_bytes`` of ``column`` each, one row at least."""
    release_memory()
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def utf8(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's bytes; null is empty."""
    return batch.column(column).cast(pa.binary()).fill_null(b"").to_pylist()


class Memo(dict):
    """word -> dense index, for words whose figures are worked out once in a worker.

    ``figures(new_words)`` gives a dict of equally long arrays; they are
    appended to ``self.columns``. ``refresh`` starts afresh beyond ``limit``.
    """

    def __init__(self, figures: Callable[[list], dict[str, np.ndarray]], limit: int = MEMO_WORDS):
        super().__init__()
        self.figures, self.limit = figures, limit
        self.new: list = []
        self.columns: dict[str, np.ndarray] = {}
        self.size = 0

    def __missing__(self, word) -> int:
        i = self[word] = len(self)
        self.new.append(word)
        return i

    def refresh(self) -> None:
        if len(self) > self.limit:
            self.clear()
            self.columns, self.size, self.new = {}, 0, []

    def index(self, words: list) -> np.ndarray:
        out = np.fromiter(map(self.__getitem__, words), dtype=np.int32, count=len(words))
        if self.new:
            fresh, self.new = self.new, []
            for at in range(0, len(fresh), FRESH_WORDS):
                self.extend(fresh[at : at + FRESH_WORDS])
        return out

    def extend(self, fresh: list) -> None:
        for name, values in self.figures(fresh).items():
            values = np.asarray(values)
            have = self.columns.get(name)
            need = self.size + len(fresh)
            if have is None or len(have) < need:
                grown = np.empty((max(need, self.size * 3 // 2, 4096), *values.shape[1:]), values.dtype)
                if have is not None:
                    grown[: self.size] = have[: self.size]
                self.columns[name] = have = grown
            have[self.size : need] = values
        self.size += len(fresh)


def own_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as make it differ from all columns of ``df`` (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def segment_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments of the given lengths (which may be 0)."""
    ends = np.cumsum(lengths)
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values, axis=0)])
    return total[ends] - total[ends - lengths]


def shrink(values: np.ndarray) -> bytes:
    """Compressed by byte planes."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), 1)


def grow(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of unsigned integers."""
    with np.errstate(over="ignore"):
        x = (x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def keep_rows(docs: DataFrame, verdicts) -> DataFrame:
    """Rows of ``docs``, with all their columns, for which ``verdicts`` (a mapInArrow function) gives true in its last column. Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def feed() -> Iterator[pa.RecordBatch]:
            for x in chunks(batches):
                waiting.append(x)
                yield x

        for judged in verdicts(feed()):
            batch = waiting.pop(0)
            yield batch.filter(judged.column(judged.num_columns - 1))

    return docs.mapInArrow(run, docs.schema)
