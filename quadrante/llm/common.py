"""What several operators share: stored intermediate tables, word splitting, connected components."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}
_paths: "WeakKeyDictionary[DataFrame, str]" = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where that setting is absent, a session in one process uses a folder of this machine; any other raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        key = spark.sparkContext.applicationId
        if key not in _own_dirs:
            _own_dirs[key] = tempfile.mkdtemp(prefix="quadrante-")
        base = _own_dirs[key]
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Cuts the lineage: a lost executor costs no more than the stage that is running, and generated
    ids keep their values. Unlike a cache, the files do not die with an executor.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables that ``stored`` returned, once all that was made of them is stored itself."""
    for df in tables:
        if path := _paths.pop(df, None):
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def slices(batches, rows: int = 500):
    """Arrow batches cut into pieces of at most so many rows, so that a worker unpacks few texts at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for each node of ``edges (a long, b long)``; component: smallest node reachable.

    Alternates two star contractions (link the larger neighbours of each node to its smallest
    neighbour; then the smaller ones) until the edges are stars. Each round groups and joins by node,
    both of which adaptive execution splits for hubs, and stores its edges. Edges with a null end or
    from a node to itself are ignored.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, edges = edges, stored(rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        discard(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component")).distinct()
