"""Keys that tell documents apart where an id stands for several texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import save


def with_key(docs: DataFrame, id_col: str, text_col: str, key: str) -> DataFrame:
    """``docs`` and ``key``: the id as a long, or where the id has several texts a hash of id and text, from 2**62 up, so that such
    rows come behind all usual ids. Null texts count as empty ones; rows without an id have no key. Only ids and hashes are shuffled where no id has several texts."""
    own, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    th = F.xxhash64(text)
    several = docs.groupBy(own.alias("__id")).agg(F.min(th).alias("a"), F.max(th).alias("b")).where("__id is not null and a <> b")
    several = save(several.select("__id", F.lit(True).alias("__several")))
    if several.isEmpty():
        return docs.withColumn(key, own)
    both = docs.join(several, own == F.col("__id"), "left")
    return both.withColumn(key, F.when(F.col("__several"), F.xxhash64(own, text).bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)).otherwise(own)).drop("__id", "__several")
