"""A table in buckets by a key, of which a merge writes those that it touches anew.

Files never change. A manifest, one small JSON file a version, names the folder of each bucket; a version is there when its manifest has got its name, by one rename that
fails if another writer was first. Readers take the newest, so they find a whole table at every moment, and one that began with an older version goes on with its files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.shared import fresh


class Buckets:
    """`n` buckets of rows by the hash of `key` under `path`. A key is one row; its null is a key like others."""

    def __init__(self, spark: SparkSession, path: str, key: str, n: int = 64):
        self.spark, self.path, self.key, self.n = spark, path.rstrip("/"), key, n
        self._jvm = spark.sparkContext._jvm
        at = self._path("_manifest")
        self._fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(at)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path("_manifest"))]
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """version, schema and folders (bucket to folder) of the newest version, or of one."""
        have = self.versions()
        if not have:
            return {"version": 0, "schema": None, "folders": {}}
        name = f"_manifest/{version if version is not None else have[-1]:012d}"
        rows = self.spark.read.text(f"{self.path}/{name}", wholetext=True).collect()  # one row of one small file
        return json.loads(rows[0]["value"])

    def _commit(self, manifest: dict) -> None:
        stage, target = self._path(f"_manifest/.{uuid.uuid4().hex}"), self._path(f"_manifest/{manifest['version']:012d}")
        out = self._fs.create(stage, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(stage, target):
            self._fs.delete(stage, False)
            raise OSError(f"version {manifest['version']} of {self.path} was written by another")

    def read(self, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows of the newest version, or of one, of all buckets or some. A table that was never written can't be read."""
        m = self.manifest(version)
        if not m["schema"]:
            raise FileNotFoundError(self.path)
        schema, wanted = StructType.fromJson(m["schema"]), None if buckets is None else set(buckets)
        folders = [f"{self.path}/{at}" for b, at in m["folders"].items() if wanted is None or int(b) in wanted]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def merge(self, news: DataFrame, gone: DataFrame | None = None) -> list[int]:
        """Rows of `news` take the place of those of their key, or are added; keys of `gone` go, unless `news` has them. Gives the buckets that were written anew.

        Of several rows of a key in `news` one is taken, the largest by all its columns in their order. Columns must be those of the table. Nothing is seen of a merge that fails.
        """
        key, m = self.key, self.manifest()
        schema = StructType.fromJson(m["schema"]) if m["schema"] else news.schema
        if [f.name for f in news.schema.fields] != [f.name for f in schema.fields]:
            raise ValueError(f"columns {news.columns} aren't those of the table")
        news = news.select(*(F.col(f.name).cast(f.dataType) for f in schema.fields))
        bucket, row, mark = fresh(news.columns, "bucket", "row", "mark")
        at = F.pmod(F.xxhash64(key), F.lit(self.n)).cast("int")
        once = news.groupBy(F.col(key).alias(mark)).agg(F.max(F.struct(*news.columns)).alias(row)).select(f"{row}.*")
        keys = once.select(key) if gone is None else once.select(key).unionByName(gone.select(F.col(key).cast(schema[key].dataType)))
        keys = keys.distinct()
        touched = sorted(r[0] for r in keys.select(at.alias(bucket)).distinct().collect())  # n numbers at most
        if not touched:
            return []
        had = [b for b in touched if str(b) in m["folders"]]
        left = once
        if had:
            old, changed = self.read(m["version"], had), keys.select(F.col(key).alias(mark))
            left = old.join(changed, old[key].eqNullSafe(changed[mark]), "left_anti").unionByName(once)
        folder = f"data/{uuid.uuid4().hex}"
        left.withColumn(bucket, at).repartition(bucket).write.partitionBy(bucket).parquet(f"{self.path}/{folder}")
        written = {}
        for f in self._fs.listStatus(self._path(folder)):
            name = f.getPath().getName()
            if name.startswith(f"{bucket}="):
                written[name.split("=")[1]] = f"{folder}/{name}"
        folders = {b: p for b, p in m["folders"].items() if int(b) not in touched} | written
        self._commit({"version": m["version"] + 1, "schema": json.loads(schema.json()), "folders": folders})
        return touched

    def vacuum(self, keep: int = 1) -> None:
        """Removes versions but the newest `keep`, and folders that none of them names; for when no reader of older ones is left."""
        have = self.versions()
        for v in have[: max(0, len(have) - keep)]:
            self._fs.delete(self._path(f"_manifest/{v:012d}"), False)
        used = {p for v in have[-keep:] for p in self.manifest(v)["folders"].values()}
        for write in self._fs.listStatus(self._path("data")):
            name = write.getPath().getName()
            for part in self._fs.listStatus(write.getPath()):
                if f"data/{name}/{part.getPath().getName()}" not in used:
                    self._fs.delete(part.getPath(), True)
            if not len(self._fs.listStatus(write.getPath())):
                self._fs.delete(write.getPath(), True)
