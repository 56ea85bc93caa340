"""Helpers shared by the operators: reliable checkpoints, input columns, bitmaps, components."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import without_shuffles

#: Bits held by one row of Spark's bitmap aggregate (its fixed bucket width).
BUCKET_BITS = 32768


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; local test sessions without one get their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="pricelens-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: computed once, survives lost executors. Its shuffle files go when it is written."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{shared_dir(spark)}/rdd-checkpoints")
    with without_shuffles(spark):
        return df.select("*").checkpoint(eager=True)  # planned anew: Spark reads the setting when a query is made


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    with without_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let the driver drop what nothing refers to any more, so that Spark's cleaner deletes its shuffle files.

    Spark asks for this itself every half hour (spark.cleaner.periodicGC.interval); a step that has just
    written a large shuffle down to a small table asks at once.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_docs(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text[, more]): only the columns an operator reads, so other columns may have any name."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), *more)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def bitmap_of(keys: DataFrame, key: str, bits: int) -> np.ndarray:
    """A bitmap of ``2**bits`` bits with the low bits of every value of ``key`` set.

    Its size depends on ``bits`` alone, never on the data: at most 2**bits / 8
    bytes reach the driver. A saturated bitmap only filters less; the exact
    joins after it decide.
    """
    position = F.col(key).bitwiseAND((1 << bits) - 1)
    rows = (keys.select(position.alias("p"))
            .groupBy(F.shiftright("p", 15).alias("bucket"))
            .agg(F.expr(f"bitmap_construct_agg(CAST(p % {BUCKET_BITS} AS BIGINT))").alias("bits")).collect())
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for row in rows:
        at = row["bucket"] * (BUCKET_BITS // 8)
        chunk = np.frombuffer(row["bits"], dtype=np.uint8)[: max(0, len(out) - at)]
        out[at:at + len(chunk)] = chunk
    return out


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the uint64 ``keys`` have their bit set."""
    p = keys & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label) for every node of ``edges``; label is the smallest node of its component.

    Minimum of the neighbours' labels, then one pointer jump, until nothing
    changes: stars and chains of copies need few rounds. Each round is a join
    and a partially aggregated minimum; hubs are split by the skew join.
    """
    both = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
               .unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct())
    labels = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("low"))
        low = labels.join(near, labels.node == near.u).select("node", "label", F.least("label", "low").alias("low"))
        to = low.select(F.col("node").alias("low"), F.col("low").alias("jump"))
        step = cut(low.join(to, "low").select("node", F.least("low", "jump").alias("label"), (F.col("label") != F.least("low", "jump")).alias("moved")))
        labels = step.select("node", "label")
        if step.where("moved").isEmpty():
            return labels
