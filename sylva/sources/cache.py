"""A document cache: texts by the hash of their URI, with age, in a Parquet table in shared storage."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "uri string, key string, text string, stored_at double"


def key(uri: Column) -> Column:
    """The SHA-1 of a URI in hex."""
    return F.sha1(uri)


def path_of(uri: Column) -> Column:
    """Folder (two digits) and file of a cache entry."""
    return F.concat(F.substring(key(uri), 1, 2), F.lit("/"), F.substring(key(uri), 3, 38))


class DocumentCache:
    def __init__(self, spark: SparkSession, folder: str, max_age: float):
        self.spark, self.folder, self.max_age = spark, folder.rstrip("/"), max_age

    def _table(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.folder)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], SCHEMA)

    def state(self, uris: DataFrame, now: float | None = None) -> DataFrame:
        """uri and state: hit, stale (too old) or miss; of several entries the newest counts."""
        now = time.time() if now is None else now
        newest = self._table().groupBy("uri").agg(F.max("stored_at").alias("at"))
        age = F.lit(now) - F.col("at")
        return uris.select("uri").join(newest, "uri", "left").select("uri", F.when(F.col("at").isNull(), "miss").when(age > self.max_age, "stale").otherwise("hit").alias("state"))

    def store(self, docs: DataFrame, now: float | None = None) -> None:
        """Adds entries (uri, text)."""
        docs.select("uri", key(F.col("uri")).alias("key"), "text", F.lit(time.time() if now is None else now).alias("stored_at")).write.mode("append").parquet(self.folder)

    def lookup(self, uris: DataFrame, now: float | None = None) -> DataFrame:
        """uri and text of the hits."""
        entries = self._table().groupBy("uri").agg(F.max_by("text", "stored_at").alias("text"))
        return self.state(uris, now).where("state = 'hit'").join(entries, "uri").select("uri", "text")
