"""What the corpus operators share: reading tables, cutting lineage in the shared folder, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its measured size is at most this many bytes.
BROADCAST_BYTES = 8 << 20
#: Text goes to Python so many bytes at a time, and a row more; Spark's own 64 MB hold a whole task's texts.
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset, as in tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = tempfile.mkdtemp(prefix="falloff-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def short_batches(spark: SparkSession) -> None:
    """Arrow batches of the session have BATCH_BYTES from now on, unless they are shorter already; rows stay whole and all are sent.

    A batch is there several times: in the JVM, in the stream, in Python as Arrow and as objects, for each core of an executor.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sql(f"SET {name}").first()["value"].lower().rstrip("b")
    unit = {"k": 10, "m": 20, "g": 30, "t": 40, "p": 50}.get(now[-1], 0)
    if int(now[:-1] if unit else now) << unit > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def cut(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends, lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/falloff/{label}-{uuid.uuid4().hex}"
    out = df.write
    if partition_by:
        out = out.partitionBy(*partition_by)
    out.parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the table behind a frame that ``cut`` returned, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spanning forest of the edges (a, b) of a partition: at most one edge for each node, to its smallest reachable one."""
    parts = [(p["a"].to_numpy(), p["b"].to_numpy()) for p in batches]
    if not parts:
        return
    a, b = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    a, b = stars(a, b)
    yield pd.DataFrame({"a": a, "b": b})


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) of the graph with the edges (a, b)."""
    if not len(a):
        return a[:0], b[:0]
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = code[: len(a)], code[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        while (jump := new[new] != new).any():
            new[jump] = new[new[jump]]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node that has an edge: (node, component).

    ``edges`` has two long columns a, b. Alternating large-star and small-star rounds; each partition first keeps
    a spanning forest of its own edges, so what is shuffled is bounded by nodes, not by edges. A round's table is
    written to the shared folder. A node's smallest neighbour comes from a partially aggregated minimum, so a hub
    is joined (and split by adaptive execution) rather than gathered.
    """
    schema = "a long, b long"
    now = cut(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInPandas(forest, schema), "edges")
    sums = F.sum(F.hash("a", "b").cast("long")), F.count("*")
    before = now.agg(*sums).first()
    while before[1]:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a <> b").distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b")
        after = cut(small.mapInPandas(forest, schema).distinct(), "edges")
        now_is = after.agg(*sums).first()
        drop_cut(now)
        now = after
        if now_is == before:
            break
        before = now_is
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
