"""What the operators of this folder share: tables, Arrow mapping, the shared folder and components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, which the cluster names.

    Where it is unset (tests on one machine), a temporary folder is set for the session.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if (held := spark.sparkContext.getCheckpointDir()) is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(held := tempfile.mkdtemp(prefix="agora-"))
    return held


def written(df: DataFrame, by: str | None = None) -> DataFrame:
    """The frame as a Parquet table in the shared folder: cuts lineage and outlives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{by or 'table'}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes a table of ``written`` that nothing needs any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """A frame of fewer partitions than there are cores, as of one small file, dealt out anew; others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, rows: int = 512) -> DataFrame:
    """``mapInArrow`` with a function that ``make`` builds once a task; it gets at most ``rows`` rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield step(batch.slice(at, rows))

    return df.mapInArrow(run, schema)


def text_or_empty(column: str = "text") -> Column:
    """A null text counts as the empty text."""
    return F.coalesce(F.col(column), F.lit("")).alias("text")


def row_hash(*others: str) -> Column:
    """A hash of a row's doc_id and text (and other columns): rows with equal ones are alike in them."""
    return F.xxhash64("doc_id", "text", *others)


#: Tables are sent to every task up to so many bytes; larger ones are joined by shuffles.
BROADCAST_BYTES = 16 << 20


def sent_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """The frame, marked to be sent to every task if its rows, of at most so many bytes each, are few enough."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of rows with equal keys in a sorted stream, each whole, though batches cut them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if held and held[-1].column(key)[0].as_py() != keys[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b: long): rows (id, component), the smallest id reachable.

    Large-star and small-star rounds in turn, until one changes nothing: every round links nodes
    nearer to the smallest neighbour, so that the number of rounds grows with the logarithm of the
    longest path.  Edges and minima are written to the shared folder before they are joined, so that
    Spark can split the join of a node with very many neighbours.  Ids without an edge are not returned.
    """
    now = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = now.union(now.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        large = written(large, "large")
        small_min = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(small_min, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = written(small.select("e.a", "e.b").where("a != b").distinct())
        size = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        for gone in (now, least, large, small_min):
            forget(gone)
        now = after
        if size == before:
            return now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id").unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()).groupBy("id").agg(F.min("component").alias("component"))
        before = size
