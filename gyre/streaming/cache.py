"""A stored cache of judge results: looked up by key, filled in batches, with the last entry of a key in force."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gyre.sources import commits
from gyre.sources.shared import small

TEXTS = ("cache_key", "provider", "model_name", "call_type", "schema_version", "key_payload_json", "raw_response", "parsed_payload_json", "repair_actions_json", "shard")
ENTRY = T.StructType([*(T.StructField(c, T.StringType()) for c in TEXTS[:-1]), T.StructField("repair_applied", T.BooleanType()), T.StructField("created_at", T.TimestampType()), T.StructField("shard", T.StringType())])
FIELDS = [f.name for f in ENTRY if f.name != "shard"]


def actions(text: Column) -> Column:
    """The repair actions of an entry as an array; none for a null or empty text, null where the text is no JSON list."""
    body = F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.lit("[]")).otherwise(F.trim(text))
    return F.when(body.startswith("[") & body.endswith("]"), F.from_json(body, "array<string>", {"mode": "PERMISSIVE"}))


class JudgeCache:
    """Entries in committed parts, by the first `digits` of their key: a look-up reads the shards of its keys, 16 for each digit.

    A put is a new part, so entries are replaced without touching others, and a put that breaks off leaves nothing.  compact() writes the entries
    in force as one part, after which earlier parts count no more.
    """

    def __init__(self, spark: SparkSession, place: str, digits: int = 1) -> None:
        self.spark, self.place, self.digits = spark, place, digits

    def put(self, entries: DataFrame) -> None:
        """Adds entries (FIELDS; missing ones are null).  Of several for a key the one created last counts, then the greatest response."""
        typed = [(F.col(f.name) if f.name in entries.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in ENTRY if f.name != "shard"]
        rows = entries.select(*typed).filter("cache_key IS NOT NULL")
        last = F.max_by(F.struct(*FIELDS), F.struct("created_at", "raw_response", "parsed_payload_json", "repair_actions_json"))
        self._save(rows.groupBy("cache_key").agg(last.alias("e")).select("e.*"))

    def _save(self, rows: DataFrame, compacted: bool = False) -> None:
        rows = rows.withColumn("shard", F.substring("cache_key", 1, self.digits))
        part = commits.write_part(rows.select(*ENTRY.names), self.place, ["shard"])
        commits.commit(self.spark, self.place, part, ENTRY, ["shard"], compacted)

    def entries(self, keys: DataFrame | None = None) -> DataFrame:
        """The entry in force of each key, or of the keys in `keys` (cache_key), with repair_actions: null in a corrupt entry."""
        known = commits.manifests(self.spark, self.place, ENTRY, ["shard"]).select("part", "number", "shard")
        if known.isEmpty():
            return self.spark.createDataFrame([], ENTRY).select(*FIELDS, actions(F.col("repair_actions_json")).alias("repair_actions"))
        rows = commits.parts(self.spark, self.place, ENTRY)
        if keys is not None:
            wanted = keys.select("cache_key", F.substring("cache_key", 1, self.digits).alias("shard")).distinct()
            known = known.join(F.broadcast(wanted.select("shard").distinct()), "shard", "left_semi")  # some hundred shards
            rows = rows.join(wanted, ["shard", "cache_key"], "left_semi")
        rows = rows.join(small(known), ["part", "shard"])
        last = rows.groupBy("cache_key").agg(F.max_by(F.struct(*FIELDS), "number").alias("e")).select("e.*")
        return last.withColumn("repair_actions", actions(F.col("repair_actions_json")))

    def get(self, rows: DataFrame) -> DataFrame:
        """rows (cache_key and others) with `hit`, raw_response, parsed_payload_json, repair_applied and repair_actions; a corrupt entry is a miss."""
        good = self.entries(rows).filter("repair_actions IS NOT NULL").select("cache_key", F.lit(True).alias("hit"), "raw_response", "parsed_payload_json", "repair_applied", "repair_actions")
        return rows.join(good, "cache_key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))

    def compact(self) -> None:
        """One part with the entries in force; corrupt ones go, as they are misses anyway."""
        self._save(self.entries().filter("repair_actions IS NOT NULL").select(*FIELDS), compacted=True)
