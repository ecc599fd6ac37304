"""What several operators of this folder share: row keys, text scans in numpy, sampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partslake.session import scratch

# The separators of words, 0x20 and 0x09-0x0D.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
# Bytes of text worked on at once in a task; one longer text is taken whole.
SCAN_BYTES = 1 << 20
SCAN_ROWS = 256

_BASE = 0x9E3779B97F4A7C15 | 1


def remainder(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def text_bytes(text: str = "text") -> Column:
    """A text as UTF-8 bytes, null as the empty text."""
    return F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text")


def only(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns and no other, so that no further column can clash with ours."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def smallest(rows: DataFrame, key: str, n: int) -> DataFrame:
    """``n`` rows at most, spread evenly: those with the smallest hash of ``key``."""
    return rows.orderBy(F.xxhash64(F.col(key).cast("string")), key).limit(n)


def scans(batch: pa.RecordBatch, column: str = "text", rows: int = SCAN_ROWS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, end row, the bytes of their texts, and the offset of each text in them."""
    values = batch.column(batch.schema.get_field_index(column))
    buffers = values.buffers()
    offsets = np.frombuffer(buffers[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    first = 0
    while first < len(values):
        end = int(np.searchsorted(offsets, offsets[first] + SCAN_BYTES, side="right")) - 1
        end = min(max(end, first + 1), first + rows, len(values))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data | 32, data)


def table_of(values: bytes) -> np.ndarray:
    """Which of the 256 bytes occur in ``values``."""
    found = np.zeros(256, bool)
    found[list(values)] = True
    return found


class Hashes:
    """Hash of any stretch of the scanned bytes, from running sums modulo 2**64.

    Byte j adds a random number of its value times base**j. A stretch's sum is moved to
    offset 0 by a power of the inverse base and then mixed.
    """

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(20_240_601 + seed)
        self.values = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = (_BASE + 2 * (seed * 7_919 + 1) * 2_654_435_761) % (1 << 64) | 1
        self.up = self.down = np.ones(1, np.uint64)

    def load(self, data: np.ndarray) -> None:
        n = len(data) + 1
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up = self._powers(self.base, size)
            self.down = self._powers(pow(self.base, -1, 1 << 64), size)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(self.values[data] * self.up[: n - 1], out=self.sums[1:])

    @staticmethod
    def _powers(base: int, size: int) -> np.ndarray:
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all bits (the finaliser of splitmix64, fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each run of bytes that are no separators."""
    inside = ~separator[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    starts[edge] = inside[edge]  # a text's first byte never continues the text before
    ends[edge - 1] = inside[edge - 1]
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(offsets, first, side="right") - 1


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


class Tables:
    """Intermediate tables in the shared folder, each with a last use.

    The shuffle files of a job go once its table is written, and a table goes when it is
    dropped; nothing is recomputed from either afterwards.
    """

    _CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame) -> DataFrame:
        path, before = scratch(self.spark, "table"), self.spark.conf.get(self._CLEANUP, None)
        self.spark.conf.set(self._CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(self._CLEANUP)
            else:
                self.spark.conf.set(self._CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(table))[1])
            path.getFileSystem(conf).delete(path, True)
