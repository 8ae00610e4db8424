"""Shared helpers: tables in the shared folder, reading inputs, connected components."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only where it is unset on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="assayscope-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive a lost executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for t in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(taken: list[str], *names: str) -> list[str]:
    """Names that no column of `taken` has, in whatever case."""
    low, prefix = {c.lower() for c in taken}, "_"
    while any((prefix + n).lower() in low for n in names):
        prefix += "_"
    return [prefix + n for n in names]


def row_key(text: Column) -> Column:
    """Tells apart rows that share an id."""
    return F.xxhash64(text)


#: Rows of a small table (one short row per group) up to which it is broadcast: some ten MB.
BROADCAST_ROWS = 100_000


def small(scratch: Scratch, df: DataFrame, name: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """df as a written table, marked for broadcast if it has at most `most` rows; beyond that its joins
    run by shuffle."""
    saved = scratch.save(df, name)
    return F.broadcast(saved) if saved.count() <= most else saved


#: Edges (16 bytes each) that one task unites by itself; beyond it the edges stay distributed.
LOCAL_EDGES = 1_000_000


def _unite(batches):
    """(u, v) of all edges of one task to (node, root)."""
    root: dict = {}

    def find(i):
        while (p := root.setdefault(i, i)) != i:
            root[i] = p = root[p]
            i = p
        return i

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            u, v = find(u), find(v)
            if u != v:
                root[max(u, v)] = min(u, v)
    nodes = list(root)
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([find(i) for i in nodes])], names=["node", "root"])


def components(scratch: Scratch, edges: DataFrame, a: str = "a", b: str = "b", local: int = LOCAL_EDGES) -> DataFrame:
    """(node, root): the smallest node reachable by edges; nodes without an edge are absent.

    Edges that fit one bounded task are united there. More edges stay distributed: alternating large-star
    and small-star steps, each one aggregation and one equi-join, until the edges no longer change; a
    hub's edges are spread by the skew-join rule, never gathered.
    """
    now = scratch.save(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges"
    )

    def signature(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    seen = signature(now)
    if seen[0] <= local:
        kind = now.schema["u"].dataType.simpleString()
        return now.repartition(1).mapInArrow(_unite, f"node {kind}, root {kind}")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v")))
        after = scratch.save(small.where("u <> v").distinct(), "edges")
        scratch.drop(now)
        last, now, seen = seen, after, signature(after)
        if last == seen:
            break
    roots = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
