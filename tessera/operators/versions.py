"""Versions of documents in a chunk store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import folder
from ..sources.scratch import dropped, stored

BUCKETS = 32


def chunk_id(*parts: str):
    """The same id for the same document, version and ordinal."""
    return F.sha2(F.concat_ws("|", *(F.col(p).cast("string") for p in parts)), 256)


def supersede(store: DataFrame, batch_docs: DataFrame, batch: DataFrame, key: str = "doc_id") -> DataFrame:
    """The store after a batch: current rows of its documents become old, then the batch's rows are added as current.

    ``batch_docs`` holds every document of the batch, also those of which no row is left.
    """
    ids = batch_docs.select(key).distinct().withColumn("__hit", F.lit(True))
    old = store.join(ids, key, "left").withColumn("is_current", F.col("is_current") & F.col("__hit").isNull()).select(store.columns)
    return old.unionByName(batch.withColumn("is_current", F.lit(True)).select(store.columns))


def latest(log: DataFrame, key: str = "doc_id", version: str = "version_ts") -> DataFrame:
    """Rows of the newest version of each document."""
    w = Window.partitionBy(key)
    return log.withColumn("__v", F.max(version).over(w)).where(F.col(version) == F.col("__v")).drop("__v")


# ---- a store on disk
#
# data/gen=<batch>/bucket=<b>/is_current=<bool>/: what a batch wrote for the buckets that it touched
# manifest/<n>.json: which generation holds a bucket's current rows, which hold its old ones, and the last batch of each source
#
# A manifest is committed last and under a new name, so readers see a batch whole or not at all.


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def manifest(spark: SparkSession, path: str) -> dict | None:
    """The newest manifest of a store; None where nothing was committed yet."""
    known = [n for n in folder.names(spark, f"{path}/manifest") if n.endswith(".json") and not n.startswith(("_", "."))]
    return folder.read_json(spark, f"{path}/manifest/{known[-1]}") if known else None


def _read(spark: SparkSession, path: str, state: dict, places: list[str]) -> DataFrame:
    schema = T.StructType.fromJson(state["schema"])
    if not places:
        return spark.createDataFrame([], schema)
    on_disk = T.StructType([*(f for f in schema if f.name != "is_current"), T.StructField("gen", T.StringType()), T.StructField("bucket", T.IntegerType()), schema["is_current"]])
    return spark.read.schema(on_disk).option("basePath", f"{path}/data").parquet(*(f"{path}/data/{p}" for p in places)).select(schema.names)


def _current(state: dict, buckets: list[str] | None = None) -> list[str]:
    return [f"gen={g}/bucket={b}/is_current=true" for b, g in state["current"].items() if buckets is None or b in buckets]


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The current rows of a store; no file that holds anything else is read."""
    state = manifest(spark, path)
    if not state:
        raise ValueError(f"no store at {path}")
    return _read(spark, path, state, _current(state))


def read_all(spark: SparkSession, path: str) -> DataFrame:
    """Current and old rows of a store."""
    state = manifest(spark, path)
    if not state:
        raise ValueError(f"no store at {path}")
    return _read(spark, path, state, _current(state) + [f"gen={g}/bucket={b}/is_current=false" for b, gens in state["old"].items() for g in gens])


def write_batch(batch_docs: DataFrame, batch: DataFrame, path: str, number: int, source: str = "batch", key: str = "doc_id", buckets: int = BUCKETS, before_commit: Callable[[DataFrame, dict], None] | None = None) -> dict:
    """Supersede current rows of ``batch_docs`` by ``batch`` (its columns are the store's without is_current); gives the manifest.

    Only buckets of the batch's documents are read and written: a bucket's current rows once more, rows that became old beside
    them; what was old stays where it is. A bucket that is left without current rows vanishes from the current
    view. Batches of a ``source`` count up from 0: one that was committed does nothing when it comes again, and one that was
    not writes its own folder anew. There is one writer at a time; a second one fails at its commit. The number of
    ``buckets`` is fixed by the first batch. ``before_commit`` gets the batch's current rows before it, and the manifest to come.
    """
    spark = batch.sparkSession
    state = manifest(spark, path)
    if state and state["done"].get(source, -1) >= number:
        return state
    if not state:
        schema = T.StructType([*batch.schema.fields, T.StructField("is_current", T.BooleanType())])
        state = {"number": -1, "buckets": buckets, "schema": schema.jsonValue(), "current": {}, "old": {}, "done": {}}
    n, gen = state["buckets"], f"{source}-{number}"
    columns = T.StructType.fromJson(state["schema"]).names
    ids = stored(batch_docs.select(key).union(batch.select(key)).distinct().withColumn("bucket", _bucket(key, n)), "ids")
    touched = [str(r.bucket) for r in ids.select("bucket").distinct().collect()]
    old = _read(spark, path, state, _current(state, touched))
    rows = supersede(old, ids, batch.select([c for c in columns if c != "is_current"]), key).withColumn("bucket", _bucket(key, n))
    order = ["lang"] if "lang" in columns else []  # files then tell which languages they hold
    rows.repartition("bucket").sortWithinPartitions("bucket", "is_current", *order).write.mode("overwrite").partitionBy("bucket", "is_current").parquet(f"{path}/data/gen={gen}")
    new = {**state, "number": state["number"] + 1, "current": dict(state["current"]), "old": {b: list(g) for b, g in state["old"].items()}, "done": {**state["done"], source: number}}
    for b in touched:
        kinds = folder.names(spark, f"{path}/data/gen={gen}/bucket={b}")
        new["current"].pop(b, None)
        if "is_current=true" in kinds:
            new["current"][b] = gen
        if "is_current=false" in kinds:
            new["old"].setdefault(b, []).append(gen)
    if before_commit:
        before_commit(old.join(ids.select(key), key, "left_semi"), new)
    folder.commit_json(spark, f"{path}/manifest/{new['number']:012d}.json", new)
    dropped(ids)
    return new


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Remove what none of the last ``keep`` manifests names; gives the generations that went."""
    known = [n for n in folder.names(spark, f"{path}/manifest") if n.endswith(".json") and not n.startswith(("_", "."))]
    states = [folder.read_json(spark, f"{path}/manifest/{n}") for n in known[-keep:]]
    used = {(b, g) for s in states for b, g in s["current"].items()} | {(b, g) for s in states for b, gens in s["old"].items() for g in gens}
    gone = []
    for gen in folder.names(spark, f"{path}/data"):
        live = {b for b, g in used if gen == f"gen={g}"}
        dead = [b for b in folder.names(spark, f"{path}/data/{gen}") if b.startswith("bucket=") and b[7:] not in live]
        for b in dead if live else ():
            folder.remove(spark, f"{path}/data/{gen}/{b}")
        if not live:
            folder.remove(spark, f"{path}/data/{gen}")
            gone.append(gen)
    for n in known[:-keep]:
        folder.remove(spark, f"{path}/manifest/{n}")
    return gone
