"""A table by key in which an upsert rewrites the touched parts alone.

Rows are dealt by a hash of their key into a fixed number of parts. A version rewrites those parts that its batch has keys
of, into folders of its own, and then adds a row for each of them to the manifest; that is written last, so a version is there as a whole or not at
all. A reader takes of each part its newest version. Of several rows with one key the last by order counts, whichever batch brought it, so replayed,
repeated and late batches leave the same rows; a batch that a crash cut off is simply put again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.lineage import cut

_MANIFEST = "batch long, version long, part int"


class KeyedTable:
    """key, order: columns; rows of one key and order are told apart by all their columns. A null key is a key like others; a null order comes before all others."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "id", order: str = "ord", parts: int = 64):
        self.spark, self.path, self.schema, self.key, self.order, self.parts = spark, path.rstrip("/"), schema, key, order, parts
        spark.createDataFrame([], _MANIFEST).write.mode("append").parquet(f"{self.path}/manifest")

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")

    def _manifest(self) -> DataFrame:
        self.spark.catalog.refreshByPath(f"{self.path}/manifest")
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest")

    def _newest(self) -> dict[int, int]:
        """Of each part the newest version: as many rows as parts at most."""
        return {r["part"]: r["version"] for r in self._manifest().groupBy("part").agg(F.max("version").alias("version")).collect()}

    def read(self, parts: list[int] | None = None) -> DataFrame:
        """All rows, or those of some parts."""
        newest = self._newest()
        folders = [f"{self.path}/data/version={v}/part={p}" for p, v in sorted(newest.items()) if parts is None or p in parts]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def find(self, key: object) -> DataFrame:
        """The row of a key, from its part alone."""
        part = self.spark.range(1).select(F.lit(key).cast(self.spark.createDataFrame([], self.schema).schema[self.key].dataType).alias(self.key)).select(self._part()).first()[0]
        return self.read([part]).where(F.col(self.key).eqNullSafe(F.lit(key)))

    def _last(self, rows: DataFrame) -> DataFrame:
        """Of each key the last row: combined before the shuffle, so a hot key meets in a maximum alone."""
        names = rows.columns
        best = F.max(F.struct(F.col(self.order).alias("_order"), F.struct(*names).alias("_row")))
        return rows.groupBy(F.col(self.key).alias("_key")).agg(best.alias("_best")).select("_best._row.*")

    def put(self, batch: DataFrame, batch_id: int | None = None) -> list[int]:
        """Merges a batch and names the parts that were rewritten. A batch whose id the manifest has is not put again."""
        if batch_id is not None and not self._manifest().where(F.col("batch") == batch_id).isEmpty():
            return []
        new = cut(self._last(batch.select(*self.spark.createDataFrame([], self.schema).columns)).withColumn("part", self._part()))
        touched = sorted(r["part"] for r in new.select("part").distinct().collect())  # parts at most
        if touched:
            version = max(self._newest().values(), default=-1) + 1
            merged = cut(self._last(self.read(touched).unionByName(new.drop("part"))).withColumn("part", self._part()))
            merged.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/data/version={version}")
            self.spark.createDataFrame([(batch_id, version, p) for p in touched], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return touched


def keyed_sink(path: str, schema: str, key: str, order: str, parts: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that upserts each batch into a KeyedTable; replayed batches and gaps in the ids do no harm."""

    def put(batch: DataFrame, batch_id: int) -> None:
        KeyedTable(batch.sparkSession, path, schema, key, order, parts).put(batch, batch_id)

    return put
