"""Keyed tables as a base and bucketed change files: a batch of changes writes only the buckets of its keys.

Layout: ``<path>/delta=<batch>/bucket=<b>`` has a batch's rows, ``<path>/base=<batch>/bucket=<b>`` a compacted bucket. A manifest, ``<path>/_manifest/<batch>.json``,
lists the folders of each bucket, oldest first; a batch is committed when its manifest is renamed into place, so readers see all of it or
nothing, and a batch that is repeated starts from the manifest before it and gives the same table. Reads merge: of each key the row with the
largest version stays, of equal versions the one of the later batch. Buckets with more than ``max_deltas`` folders are compacted, others are not touched.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

Manifest = dict[str, list[str]]  # bucket to its folders


@dataclass(frozen=True)
class KeyedTable:
    spark: SparkSession
    path: str
    keys: Sequence[str]
    version: str
    schema: T.StructType
    buckets: int = 64
    max_deltas: int = 8

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, path: str) -> list[str]:
        fs, at = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def batches(self) -> list[int]:
        """The committed batches, in order."""
        return sorted(int(n.split(".")[0]) for n in self._names(f"{self.path}/_manifest") if n.endswith(".json") and not n.startswith((".", "_")))

    def manifest(self, before: int | None = None) -> Manifest:
        """Folders of each bucket after the last batch (below ``before``)."""
        found = [i for i in self.batches() if before is None or i < before]
        return json.loads(self.spark.read.text(f"{self.path}/_manifest/{found[-1]}.json", wholetext=True).first()[0]) if found else {}

    def _commit(self, batch: int, manifest: Manifest) -> None:
        fs, tmp = self._fs(f"{self.path}/_manifest/_{batch}.tmp")
        _, to = self._fs(f"{self.path}/_manifest/{batch}.json")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        fs.delete(to, False)
        if not fs.rename(tmp, to):
            raise RuntimeError(f"batch {batch} of {self.path} could not be committed")

    def _rows(self, manifest: Manifest) -> DataFrame:
        """All rows of the listed folders, with their place in their bucket's list."""
        schema = T.StructType([*self.schema.fields, T.StructField("_place", T.IntegerType())])
        by_place: dict[int, list[str]] = {}
        for bucket, folders in manifest.items():
            for place, folder in enumerate(folders):
                by_place.setdefault(place, []).append(f"{self.path}/{folder}/bucket={bucket}")
        parts = [self.spark.read.schema(self.schema).parquet(*paths).withColumn("_place", F.lit(place)) for place, paths in sorted(by_place.items())]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def _merged(self, rows: DataFrame) -> DataFrame:
        w = Window.partitionBy(*self.keys).orderBy(F.desc_nulls_last(self.version), F.desc("_place"))
        return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_place")

    def read(self, before: int | None = None) -> DataFrame:
        return self._merged(self._rows(self.manifest(before)))

    def _write(self, df: DataFrame, folder: str) -> list[str]:
        """Write rows by bucket; the buckets that got some."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        rows = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields], bucket.alias("bucket"))
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{folder}")
        return [n.split("=")[1] for n in self._names(f"{self.path}/{folder}") if n.startswith("bucket=")]

    def upsert(self, df: DataFrame, batch: int) -> list[str]:
        """Merge a batch's rows; returns the buckets that were written. Of rows with one key the largest version counts (ties: any of them)."""
        manifest = self.manifest(batch)
        w = Window.partitionBy(*self.keys).orderBy(F.desc_nulls_last(self.version))
        touched = self._write(df.withColumn("_r", F.row_number().over(w)).where("_r = 1"), f"delta={batch}")
        for b in touched:
            manifest[b] = [*manifest.get(b, []), f"delta={batch}"]
        full = {b: manifest[b] for b in touched if len(manifest[b]) > self.max_deltas}
        if full:
            self._write(self._merged(self._rows(full)), f"base={batch}")
            manifest |= {b: [f"base={batch}"] for b in full}
        self._commit(batch, manifest)
        return touched

    def insert_if_absent(self, df: DataFrame, batch: int) -> list[str]:
        """Add the rows whose key the table does not have (of one key the smallest version); existing rows stay."""
        w = Window.partitionBy(*self.keys).orderBy(F.asc_nulls_last(self.version))
        first = df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
        return self.upsert(first.join(self.read(batch).select(*self.keys), list(self.keys), "left_anti"), batch)

    def vacuum(self, keep: int = 2) -> None:
        """Delete the manifests before the last ``keep`` and the bucket folders that no kept manifest lists."""
        kept = self.batches()[-keep:]
        live = {(folder, b) for i in kept for b, folders in self.manifest(i + 1).items() for folder in folders}
        for name in self._names(self.path):
            if name.startswith(("delta=", "base=")) and int(name.split("=")[1]) <= (kept or [-1])[-1]:
                for b in self._names(f"{self.path}/{name}"):
                    if b.startswith("bucket=") and (name, b.split("=")[1]) not in live:
                        fs, at = self._fs(f"{self.path}/{name}/{b}")
                        fs.delete(at, True)
        for i in self.batches()[:-keep]:
            fs, at = self._fs(f"{self.path}/_manifest/{i}.json")
            fs.delete(at, False)
