"""Keyed tables in versions: rows by bucket of their key's hash, and an atomic switch from one version to the next.

A version is a small JSON file that names, for each bucket, the folders that hold its rows.  Data
folders are never changed.  A writer reads the buckets that it touches, writes new folders, and
makes them count by renaming a version file into place; until then readers see the version before,
also after a crash.  The rename must not replace a file that is there, as on HDFS.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class KeyedTable:
    """Rows of a table under ``path`` by the columns ``key``; nulls are key values as any other.

    ``buckets`` counts for a new table only.
    """

    #: A bucket in so many folders is put together when it is next appended to.
    MOST_FOLDERS = 16

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.fs = self.hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.hadoop.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        """The numbers of all versions, from the first on."""
        if not self.fs.exists(self.at("_versions")):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(self.at("_versions"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def state(self, version: int | None = None) -> dict:
        """version, buckets, schema (null without rows), folders by bucket, and done: the last batch of each run."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return {"version": 0, "buckets": self.buckets, "schema": None, "folders": {}, "done": {}}
        stream = self.fs.open(self.at(f"_versions/{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, state: dict) -> None:
        """Make ``state`` the version after its own; another writer may have been first, then this one fails and nothing changes."""
        state = state | {"version": state["version"] + 1}
        draft, final = self.at(f"_versions/.{uuid.uuid4().hex}"), self.at(f"_versions/{state['version']:012d}.json")
        stream = self.fs.create(draft, False)
        stream.write(json.dumps(state).encode())
        stream.close()
        if self.fs.exists(final) or not self.fs.rename(draft, final):
            self.fs.delete(draft, False)
            raise RuntimeError(f"version {state['version']} of {self.path} is there already: another writer was first")

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the last one by default; a table that was never written has no columns."""
        return self.rows(self.state(version))

    def rows(self, state: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(state["schema"]) if state["schema"] else StructType()
        folders = [f"{self.path}/{f}" for b, of in state["folders"].items() for f in of if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(n)).cast("int")

    def same(self, other: DataFrame) -> Column:
        return reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(other[f"__{i}"]) for i, k in enumerate(self.key)))

    def keys(self, rows: DataFrame) -> DataFrame:
        return rows.select(*(F.col(k).alias(f"__{i}") for i, k in enumerate(self.key))).distinct()

    def write(self, rows: DataFrame, state: dict) -> dict[str, str]:
        """Write rows by bucket; the new folder of each bucket that got some."""
        name = f"data/{uuid.uuid4().hex}"
        rows.withColumn("__bucket", self.bucket(state["buckets"])).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{name}")
        found = (f.getPath().getName() for f in self.fs.listStatus(self.at(name)) if f.isDirectory())
        return {n.partition("=")[2]: f"{name}/{n}" for n in found if n.startswith("__bucket=")}

    def touched(self, rows: DataFrame, state: dict) -> list[int]:
        return [r.b for r in rows.select(self.bucket(state["buckets"]).alias("b")).distinct().collect()]  # as many as buckets at most

    def upsert(self, rows: DataFrame) -> None:
        """Rows take the place of those with their key, or are added.  Of several rows with one key the last by their JSON text counts.  Columns that either side lacks are null."""
        state = self.state()
        whole = F.struct(*rows.columns)
        rows = rows.groupBy(*(F.col(k).alias(f"__{i}") for i, k in enumerate(self.key))).agg(F.max_by(whole, F.to_json(whole)).alias("r")).select("r.*").persist()
        touched = self.touched(rows, state)
        if state["schema"]:
            new = self.keys(rows)
            old = self.rows(state, touched)
            merged = old.join(new, self.same(new), "left_anti").unionByName(rows, allowMissingColumns=True)
        else:
            merged = rows
        written = self.write(merged, state)
        folders = {b: of for b, of in state["folders"].items() if int(b) not in touched} | {b: [f] for b, f in written.items()}
        self.commit(state | {"schema": merged.schema.jsonValue(), "folders": folders})
        rows.unpersist()

    def append(self, rows: DataFrame, run: str, batch: int) -> bool:
        """Add the rows whose key the table lacks, one a key, as batch number ``batch`` of ``run``; a batch that is done already does nothing.  Whether it did something.

        Only the keys of touched buckets are read.
        """
        state = self.state()
        if state["done"].get(run, -1) >= batch:
            return False
        rows = rows.dropDuplicates(self.key).persist()
        touched = self.touched(rows, state)
        if state["schema"]:
            there = self.keys(self.rows(state, touched))
            fresh = rows.join(there, self.same(there), "left_anti")
        else:
            fresh = rows
        full = [b for b in touched if len(state["folders"].get(str(b), [])) >= self.MOST_FOLDERS]
        merged = fresh.unionByName(self.rows(state, full), allowMissingColumns=True) if full else fresh
        written = self.write(merged, state)
        folders = dict(state["folders"])
        for b, f in written.items():
            folders[b] = ([] if int(b) in full else folders.get(b, [])) + [f]
        known = state["schema"] and self.rows(state, []).unionByName(fresh.limit(0), allowMissingColumns=True).schema
        self.commit(state | {"schema": (known or fresh.schema).jsonValue(), "folders": folders, "done": state["done"] | {run: batch}})
        rows.unpersist()
        return True

    def vacuum(self, keep: int = 1) -> None:
        """Delete all versions but the last ``keep``, and data that none of these names, also what crashed writers left; no writer may be at work."""
        versions = self.versions()
        kept = {f.split("/")[1] for v in versions[-keep:] for of in self.state(v)["folders"].values() for f in of}
        for v in versions[:-keep]:
            self.fs.delete(self.at(f"_versions/{v:012d}.json"), False)
        for f in self.fs.listStatus(self.at("data")) if self.fs.exists(self.at("data")) else []:
            if f.getPath().getName() not in kept:
                self.fs.delete(f.getPath(), True)
