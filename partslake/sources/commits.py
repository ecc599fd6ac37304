"""Keyed tables under one log of commits.

A table is a stack of layers. A layer holds the rows one commit changed, one file per bucket
of the key's hash, and for each file the range of its hashes and a Bloom filter of them. A
commit names the layers of every table, so all tables move on together: readers see all of
a commit or nothing, and what a failed attempt left behind is in no commit.

Reading by key opens only files whose filter may hold one of the keys; the newest row of a
key counts. Compaction merges the buckets with many files into one new file each. Files that
no recent commit names are removed by ``vacuum``; until then readers of older commits go on.

One writer at a time; a commit is one small file, published by the rename of Spark's own
write. A writer's batch that has been committed is not committed again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Files of keys: more for larger tables, as one task writes a bucket.
BUCKETS = 64
# Bits per key and hashes of a filter: about one key in a hundred passes by mistake.
BITS_PER_KEY, HASHES = 10, 4
# Files of a bucket above which it is compacted.
MANY_FILES = 8

_SEQ, _GONE, _HASH, _BUCKET = "_seq", "_gone", "_hash", "_bucket"
_INDEX = "path string, bucket int, n long, least long, most long, bloom binary, seq long, base boolean, folder string"


def _slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Places of hashes in a filter of ``bits`` bits, a power of two."""
    h = hashes.view(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return (low[:, None] + high[:, None] * np.arange(HASHES, dtype=np.uint64)) & np.uint64(bits - 1)


def _filter_of(hashes: np.ndarray) -> bytes:
    bits = 1 << max(6, (len(hashes) * BITS_PER_KEY - 1).bit_length())
    marks = np.zeros(bits, np.uint8)
    marks[_slots(hashes, bits).ravel().astype(np.int64)] = 1
    return np.packbits(marks).tobytes()


def _may_hold(bloom: bytes, hashes: np.ndarray) -> bool:
    marks = np.unpackbits(np.frombuffer(bloom, np.uint8))
    return bool(marks[_slots(hashes, len(marks)).astype(np.int64)].all(axis=1).any())


def newest(spark: SparkSession, root: str) -> dict:
    """The last commit: its number, the last batch of each writer, and the layers of each table."""
    log = spark.read.schema("value string, commit long").text(f"{root}/commits", wholetext=True)
    return json.loads(log.agg(F.max_by("value", "commit").alias("v")).first()["v"])


def _publish(spark: SparkSession, root: str, record: dict) -> None:
    """A single row, so a single file, which appears as a whole."""
    line = spark.range(1).select(F.lit(json.dumps(record)).alias("value")).coalesce(1)
    line.write.mode("overwrite").text(f"{root}/commits/commit={record['commit']}")


def create(spark: SparkSession, root: str, tables: Mapping[str, tuple[DataFrame, Sequence[str]]], buckets: int = BUCKETS) -> None:
    """Commit 0: each table with its key columns; no keys for a table of rows that only grows."""
    record = {"commit": 0, "batches": {}, "tables": {}}
    for name, (df, keys) in tables.items():
        table = {"keys": list(keys), "buckets": buckets, "schema": df.schema.json(), "layers": []}
        table["layers"].append(_write_layer(df, f"{root}/tables/{name}", table, 0, base=True))
        record["tables"][name] = table
    _publish(spark, root, record)


def _write_layer(rows: DataFrame, path: str, table: dict, seq: int, removed: DataFrame | None = None, base: bool = False) -> str:
    """A folder of files by bucket, then the index of these files. Returns its name."""
    spark, keys, folder = rows.sparkSession, table["keys"], f"{seq:012d}-{uuid.uuid4().hex}"
    schema = StructType.fromJson(json.loads(table["schema"]))
    rows = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema]).withColumn(_GONE, F.lit(False))
    if removed is not None:
        there = set(removed.columns)
        rows = rows.unionByName(
            removed.select(*[(F.col(f.name) if f.name in there and f.name in keys else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema], F.lit(True).alias(_GONE))
        )
    hashed = F.xxhash64(*keys) if keys else F.xxhash64(F.lit(seq))
    rows = rows.withColumn(_SEQ, F.lit(seq).cast("long")).withColumn(_HASH, hashed)
    if not keys:
        rows.write.parquet(f"{path}/data/{folder}")
        return folder
    rows = rows.withColumn(_BUCKET, F.pmod(F.col(_HASH), F.lit(table["buckets"])).cast("int"))
    rows.repartition(_BUCKET).sortWithinPartitions(_BUCKET, _HASH).write.partitionBy(_BUCKET).parquet(f"{path}/data/{folder}")

    def entry(frame: pd.DataFrame) -> pd.DataFrame:
        h = frame["h"].to_numpy()
        made = {"path": frame["path"].iloc[0], "bucket": frame["bucket"].iloc[0], "n": len(h), "least": h.min(), "most": h.max(), "bloom": _filter_of(h)}
        return pd.DataFrame([{**made, "seq": seq, "base": base, "folder": folder}])

    stored = spark.read.schema(_stored(table)).parquet(f"{path}/data/{folder}")
    files = stored.select(F.col("_metadata.file_path").alias("path"), F.col(_BUCKET).alias("bucket"), F.col(_HASH).alias("h"))
    files.groupBy("path", "bucket").applyInPandas(entry, _INDEX).write.parquet(f"{path}/index/{folder}")
    return folder


def _stored(table: dict) -> StructType:
    schema = StructType.fromJson(json.loads(table["schema"])).add(_GONE, "boolean").add(_SEQ, "long").add(_HASH, "long")
    return schema.add(_BUCKET, "integer") if table["keys"] else schema


def _index(spark: SparkSession, root: str, name: str, table: dict) -> DataFrame:
    """Files of a table that no later merged file of their bucket replaces."""
    files = spark.read.schema(_INDEX).parquet(*[f"{root}/tables/{name}/index/{folder}" for folder in table["layers"]])
    merged = files.filter("base").groupBy("bucket").agg(F.max("seq").alias("_merged"))
    return files.join(merged, "bucket", "left").filter(F.col("_merged").isNull() | (F.col("seq") >= F.col("_merged"))).drop("_merged")


def _current(stored: DataFrame, table: dict) -> DataFrame:
    """The newest row of each key, without those that were removed."""
    keys = table["keys"]
    schema = StructType.fromJson(json.loads(table["schema"]))
    names = [f.name for f in schema]
    if not keys:
        return stored.select(*names)
    rest = [n for n in (*names, _GONE) if n not in keys]
    one = stored.groupBy(*keys).agg(F.max_by(F.struct(*rest), _SEQ).alias("_r"))
    return one.filter(~F.col(f"_r.{_GONE}")).select(*[n if n in keys else F.col("_r")[n].alias(n) for n in names])


def _opened(spark: SparkSession, paths: list[str], root: str, name: str, table: dict) -> DataFrame:
    reader = spark.read.schema(_stored(table))
    if not paths:
        return spark.createDataFrame([], _stored(table))
    return reader.option("basePath", f"{root}/tables/{name}/data").parquet(*paths) if not table["keys"] else reader.parquet(*paths)


def read(spark: SparkSession, root: str, name: str, record: dict | None = None) -> DataFrame:
    """All rows of a table as of the last commit, or of ``record``."""
    table = (record or newest(spark, root))["tables"][name]
    if table["keys"]:
        paths = [r.path for r in _index(spark, root, name, table).select("path").collect()]
    else:
        paths = [f"{root}/tables/{name}/data/{folder}" for folder in table["layers"]]
    return _current(_opened(spark, paths, root, name, table), table)


def files_with(wanted: DataFrame, root: str, name: str, record: dict | None = None) -> list[str]:
    """Files that may hold one of the ``wanted`` keys."""
    spark = wanted.sparkSession
    table = (record or newest(spark, root))["tables"][name]
    asked = wanted.select(F.xxhash64(*table["keys"]).alias("h")).distinct()
    asked = asked.withColumn("bucket", F.pmod(F.col("h"), F.lit(table["buckets"])).cast("int"))

    def touched(files: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        h = np.sort(asked["h"].to_numpy())
        hit = []
        for path, least, most, bloom in files[["path", "least", "most", "bloom"]].itertuples(index=False, name=None):
            inside = h[np.searchsorted(h, least) : np.searchsorted(h, most, side="right")]
            if len(inside) and _may_hold(bloom, inside):
                hit.append(path)
        return pd.DataFrame({"path": pd.Series(hit, dtype=object)})

    files = _index(spark, root, name, table)
    met = files.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInPandas(touched, "path string")
    return sorted(r.path for r in met.collect())


def read_keys(wanted: DataFrame, root: str, name: str, record: dict | None = None) -> DataFrame:
    """The rows of the ``wanted`` keys, from the files that may hold one."""
    spark = wanted.sparkSession
    record = record or newest(spark, root)
    table = record["tables"][name]
    stored = _opened(spark, files_with(wanted, root, name, record), root, name, table)
    asked = wanted.select(*[F.col(k).alias(f"_w_{k}") for k in table["keys"]]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_w_{k}")) for k in table["keys"]])
    return _current(stored.join(asked, same, "left_semi"), table)


def commit(
    spark: SparkSession,
    root: str,
    changes: Mapping[str, DataFrame],
    *,
    removed: Mapping[str, DataFrame] | None = None,
    writer: str = "",
    batch: int | None = None,
) -> int:
    """Put changed rows, and take out ``removed`` keys, of several tables at once.

    Returns the number of the commit that has the batch; a ``batch`` at or below the last
    one of its ``writer`` is there already.
    """
    record, removed = newest(spark, root), removed or {}
    if batch is not None and batch <= record["batches"].get(writer, -1):
        return record["commit"]
    number = record["commit"] + 1
    for name in sorted({*changes, *removed}):
        table = record["tables"][name]
        nothing = spark.createDataFrame([], StructType.fromJson(json.loads(table["schema"])))
        layer = _write_layer(changes.get(name, nothing), f"{root}/tables/{name}", table, number, removed.get(name))
        table["layers"].append(layer)
    if batch is not None:
        record["batches"][writer] = batch
    _publish(spark, root, record | {"commit": number})
    return number


def compact(spark: SparkSession, root: str, name: str, files: int = MANY_FILES) -> int:
    """Merge each bucket that has more than ``files`` files into one file. Returns how many were merged."""
    record = newest(spark, root)
    table, number = record["tables"][name], record["commit"] + 1
    if not table["keys"]:
        return 0
    index = _index(spark, root, name, table)
    full = [r.bucket for r in index.groupBy("bucket").count().filter(F.col("count") > files).collect()]
    if not full:
        return 0
    paths = [r.path for r in index.filter(F.col("bucket").isin(full)).select("path").collect()]
    merged = _current(_opened(spark, paths, root, name, table), table)
    table["layers"].append(_write_layer(merged, f"{root}/tables/{name}", table, number, base=True))
    # layers of which no file counts any more are in no later commit
    alive = {r.folder for r in _index(spark, root, name, table).select("folder").distinct().collect()}
    table["layers"] = [f for f in table["layers"] if f in alive]
    _publish(spark, root, record | {"commit": number})
    return len(full)


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Remove what neither the last commit nor the ``keep`` before it names. Returns the folders removed."""
    log = spark.read.schema("value string, commit long").text(f"{root}/commits", wholetext=True)
    records = {r.commit: json.loads(r.value) for r in log.orderBy(F.desc("commit")).limit(keep + 1).collect()}
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def below(path: str) -> list:
        place = jvm.org.apache.hadoop.fs.Path(path)
        fs = place.getFileSystem(conf)
        return [(fs, s.getPath()) for s in fs.listStatus(place)] if fs.exists(place) else []

    gone = 0
    for name in records[max(records)]["tables"]:
        named = {folder for r in records.values() for folder in r["tables"].get(name, {"layers": []})["layers"]}
        for kind in ("index", "data"):
            for fs, path in below(f"{root}/tables/{name}/{kind}"):
                if path.getName() not in named:
                    fs.delete(path, True)
                    gone += 1
    for fs, path in below(f"{root}/commits"):
        if path.getName().startswith("commit=") and int(path.getName()[7:]) not in records:
            fs.delete(path, True)
    return gone
