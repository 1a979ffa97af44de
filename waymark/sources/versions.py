"""Tables of one row a key that are replaced or changed whole, in one step that readers see at once; squares on disk; files that have changed.

A table is a folder: `data` holds Parquet folders that are never written twice, `manifests` one small file for each version, which names the folder of each bucket of keys. A version comes into
being when its manifest is renamed into place, so a writer that dies leaves the last one as it was, and of two writers one fails. A reader keeps the version that it began with. Changes write
the buckets of the keys that they name and no others. All of it goes through Hadoop's file systems, as Spark's own files do."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from waymark.operators.registers import digest
from waymark.operators.sites import by_square

BUCKETS = 64


def _at(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, path = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def current(spark: SparkSession, folder: str) -> int | None:
    """The newest version; null if there is none."""
    found = [n for n in _names(spark, f"{folder}/manifests") if n.endswith(".json") and not n.startswith((".", "_"))]
    return int(found[-1].split(".")[0]) if found else None


def manifest(spark: SparkSession, folder: str, version: int) -> dict:
    fs, path = _at(spark, f"{folder}/manifests/{version:012d}.json")
    stream = fs.open(path)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _published(spark: SparkSession, folder: str, version: int, told: dict) -> int:
    """Puts a manifest in place; an error if another writer was first."""
    fs, made = _at(spark, f"{folder}/manifests/.{uuid.uuid4().hex}")
    stream = fs.create(made)
    stream.write(bytearray(json.dumps(told, sort_keys=True).encode()))
    stream.close()
    _, path = _at(spark, f"{folder}/manifests/{version:012d}.json")
    if fs.exists(path) or not fs.rename(made, path):
        fs.delete(made, False)
        raise RuntimeError(f"version {version} of {folder} was written meanwhile")
    return version


def read(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A version's rows, the newest unless one is named; what is written afterwards doesn't reach them."""
    version = current(spark, folder) if version is None else version
    if version is None:
        raise FileNotFoundError(f"{folder} has no version")
    told = manifest(spark, folder, version)
    schema, paths = StructType.fromJson(told["schema"]), sorted(set(told["parts"].values()))
    return spark.read.schema(schema).parquet(*[f"{folder}/data/{p}" for p in paths]) if paths else spark.createDataFrame([], schema)


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(BUCKETS)).cast("int")


def _written(rows: DataFrame, key: str, folder: str) -> dict[str, str]:
    """Writes rows as one folder for each bucket; its names. A bucket's rows may be many files."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    path = f"{folder}/data/{name}"
    rows.withColumn("__bucket", _bucket(key)).hint("rebalance", "__bucket").write.partitionBy("__bucket").parquet(path)
    return {n.split("=")[1]: f"{name}/{n}" for n in _names(spark, path) if n.startswith("__bucket=")}


def replace(rows: DataFrame, key: str, folder: str) -> int:
    """The version that holds these rows: a new one, or the newest if it holds the same rows already (by their digest, in whatever order)."""
    spark = rows.sparkSession
    told, before = list(digest(rows, sorted(rows.columns)).first()), current(spark, folder)
    kept = manifest(spark, folder, before) if before is not None else {}
    if kept.get("digest") == told and kept.get("schema") == rows.schema.jsonValue():
        return before
    return _published(spark, folder, (before or 0) + 1, {"schema": rows.schema.jsonValue(), "digest": told, "parts": _written(rows, key, folder)})


def change(changes: DataFrame, key: str, folder: str, merge, token: str | None = None) -> int:
    """The version after merge(rows, changes), where rows are those of the buckets that the changes' keys fall into; other buckets aren't read or written. At most BUCKETS numbers reach the driver.

    token: names a batch of changes; the newest version, if it was made by it, is given back."""
    spark, before = changes.sparkSession, current(changes.sparkSession, folder)
    if before is None:
        raise FileNotFoundError(f"{folder} has no version to change")
    told = manifest(spark, folder, before)
    if token is not None and told.get("token") == token:
        return before
    touched = {str(r[0]) for r in changes.select(_bucket(key)).distinct().collect()}
    if not touched:
        return before
    paths = [f"{folder}/data/{p}" for b, p in told["parts"].items() if b in touched]
    schema = StructType.fromJson(told["schema"])
    rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    fresh = _written(merge(rows, changes).select(*rows.columns), key, folder)
    parts = {b: p for b, p in told["parts"].items() if b not in touched} | fresh
    return _published(spark, folder, before + 1, {"schema": told["schema"], "digest": None, "parts": parts, "token": token})


def forget(spark: SparkSession, folder: str, keep: int = 2) -> None:
    """Removes all but the newest `keep` versions, and data folders that no kept version names; not while a writer is at work, whose data has no name yet."""
    newest = current(spark, folder)
    if newest is None:
        return
    named = set()
    for name in _names(spark, f"{folder}/manifests"):
        if name.endswith(".json") and int(name.split(".")[0]) > newest - keep:
            named |= {p.split("/")[0] for p in manifest(spark, folder, int(name.split(".")[0]))["parts"].values()}
        else:
            fs, path = _at(spark, f"{folder}/manifests/{name}")
            fs.delete(path, False)
    for name in _names(spark, f"{folder}/data"):
        if name not in named:
            fs, path = _at(spark, f"{folder}/data/{name}")
            fs.delete(path, True)


# --- squares of one degree


def write_squares(sites: DataFrame, path: str) -> None:
    """Sites in folders by the one-degree square that each lies in. Rows of a square stand together, and one that holds very many is several files."""
    by_square(sites).hint("rebalance", "sq_lat", "sq_lng").write.mode("overwrite").partitionBy("sq_lat", "sq_lng").parquet(path)


def read_squares(spark: SparkSession, path: str, bbox: tuple[float, float, float, float]) -> DataFrame:
    """Sites in a box (west, south, east, north); only the squares that it touches are listed and read."""
    west, south, east, north = bbox
    floor = lambda x: int(x // 1)
    squares = F.col("sq_lat").between(floor(south), floor(north)) & F.col("sq_lng").between(floor(west), floor(east))
    return spark.read.parquet(path).where(squares & F.col("lat").between(south, north) & F.col("lng").between(west, east))


# --- files that have changed


def listed_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, at) of all files under a folder; their contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return found.select("path", "length", F.col("modificationTime").alias("at"))


def unread_files(files: DataFrame, read: DataFrame) -> DataFrame:
    """Files that haven't been read, or not as they are now: no row of `read` (path, length, at) is the same."""
    return files.join(read.select("path", "length", "at"), ["path", "length", "at"], "left_anti")
