"""Sharding by extendible hashing.

A document's place is a 60-bit hash. The directory starts with one bucket and splits a bucket by the next bit of
the hash only while its bytes exceed the limit, so a document's shard is the shortest prefix of its hash
whose bucket fits. A bucket of one hash only, which no bit can split, is an overflow chain: its equal rows are
dealt to as many shards as the limit asks for, one row each at least.

Sizes are summed once per prefix of ``step`` bits (in each task first) and rolled up to the shorter prefixes on
those sums; only rows in buckets that are still too large are read for more bits. The directory grows with
the number of shards, not of documents, stays a distributed table and is joined by prefix; equal rows are counted, not
gathered, and numbered from the count in blocks that are dealt over the tasks.

Defined results: a null or empty text has no bytes and hashes like an empty one, a null ``doc_id`` like an empty string; a
text over the limit is a shard of its own; an empty table has no shards; other columns are ignored by
``assign_shards``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrante.llm.common import stored
from quadrante.operators.joins import lookup_join

BITS = 60
#: Copies of one row that a task writes out at a time.
_BLOCK = 4096


def place(doc_id, text) -> F.Column:
    """60 bits of the MD5 of id and text."""
    joined = F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _prefix(h, depth: int) -> F.Column:
    return F.shiftright(h, BITS - depth)


def directory(rows: DataFrame, limit: int, step: int = 16) -> DataFrame:
    """``(low, depth, prefix, bytes)``, one row per bucket of a shard: hashes from ``low`` on with ``depth`` bits in common.

    ``rows``: ``(place, bytes)``. Works through ``step`` bits at a time, each time on the rows left.
    """
    found = None
    done, left = 0, rows.select("place", "bytes")
    while done < BITS:
        depth = min(BITS, done + step)
        sums = left.groupBy(_prefix(F.col("place"), depth).alias("end")).agg(
            F.sum("bytes").alias("bytes"), F.min("place").alias("least"), F.max("place").alias("most")
        )
        sums = stored(sums)
        levels = F.explode(F.sequence(F.lit(done if done == 0 else done + 1), F.lit(depth))).alias("depth")
        levels = sums.select("*", levels).withColumn("prefix", F.expr(f"shiftright(end, {depth} - depth)"))
        buckets = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"))
        fits = buckets.where((F.col("total") <= limit) | (F.col("least") == F.col("most"))).select("depth", "prefix", "total")
        chosen = levels.select("end", "depth", "prefix").join(fits, ["depth", "prefix"])
        chosen = chosen.groupBy("end").agg(F.min(F.struct("depth", "prefix", "total")).alias("b")).select("end", "b.*")
        chosen = stored(chosen)
        shards = chosen.select("depth", "prefix", F.col("total").alias("bytes")).distinct()
        found = shards if found is None else found.unionByName(shards)
        rest = sums.join(chosen.select("end"), "end", "left_anti").select("end")
        if rest.isEmpty():
            break
        left = left.join(rest, _prefix(left["place"], depth) == rest["end"], "left_semi")
        done = depth
    return found


def assign_shards(docs: DataFrame, limit: int, step: int = 16) -> DataFrame:
    """``doc_id, depth, prefix, overflow, bytes`` for each row of ``docs``; the first three columns after the id name its shard."""
    rows = docs.select(
        docs["doc_id"], place(docs["doc_id"], docs["text"]).alias("place"), F.coalesce(F.octet_length(docs["text"]), F.lit(0)).cast("long").alias("bytes")
    )
    placed = _copies(stored(_placed(rows, limit, step)))
    return placed.select("doc_id", F.col("depth").cast("long").alias("depth"), "prefix", _overflow().alias("overflow"), "bytes")


def _copies(placed: DataFrame) -> DataFrame:
    """Each row as often as it has ``copies``, numbered in ``row``; many copies are dealt over the tasks in blocks."""
    few = placed.where(F.col("copies") <= _BLOCK).withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / _BLOCK)))
    many = placed.where(F.col("copies") > _BLOCK).withColumn("block", block).repartition("doc_id", "place", "block")
    start = F.col("block") * _BLOCK
    many = many.withColumn("row", F.explode(F.sequence(start, F.least(start + _BLOCK, F.col("copies")) - 1))).drop("block")
    return few.unionByName(many)


def _overflow() -> F.Column:
    return F.when(F.col("alone"), F.floor(F.col("row") / F.col("per_shard"))).otherwise(0).cast("long")


def _placed(rows: DataFrame, limit: int, step: int) -> DataFrame:
    """``(doc_id, place, bytes)`` once with its ``copies`` and shard: ``depth, prefix``, and if it is ``alone`` there, the rows ``per_shard``."""
    rows = stored(rows.groupBy("doc_id", "place", "bytes").agg(F.count("*").alias("copies")))
    sizes = rows.select("place", (F.col("bytes") * F.col("copies")).alias("bytes"))
    shards = stored(directory(sizes, limit, step))
    depths = [r["depth"] for r in shards.select("depth").distinct().collect()]  # at most 61
    keyed = rows.withColumn("depth", F.explode(F.array(*(F.lit(d).cast("int") for d in sorted(depths))))) if depths else rows.withColumn("depth", F.lit(0))
    keyed = keyed.withColumn("prefix", F.expr(f"shiftright(place, {BITS} - depth)"))
    placed = lookup_join(keyed, shards.select("depth", "prefix", F.col("bytes").alias("total")), ["depth", "prefix"])
    per_shard = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("bytes"), F.lit(1)))).cast("long")
    return placed.select("doc_id", "place", "bytes", "copies", "depth", "prefix", per_shard.alias("per_shard"), (F.col("total") > limit).alias("alone"))


def write_shards(docs: DataFrame, path: str, limit: int, step: int = 16) -> None:
    """Writes ``docs``, all columns, each row once, as one Parquet folder per shard (``shard=depth-prefix-overflow``).

    Rows find their shard by id and place. Only rows of overflow chains are numbered: inside each task of the stored
    input, from the copies in the tasks before on, so no chain is gathered.
    """
    bytes_ = F.coalesce(F.octet_length(docs["text"]), F.lit(0)).cast("long")
    row = F.struct(*(docs[c] for c in docs.columns)).alias("row")
    seq = F.monotonically_increasing_id().alias("seq")
    rows = stored(docs.select(row, docs["doc_id"].alias("doc_id"), place(docs["doc_id"], docs["text"]).alias("place"), bytes_.alias("bytes"), seq))
    # Stored, so that both uses below see one number for each row: the upper bits are the task that wrote it.
    placed = _placed(rows.select("doc_id", "place", "bytes"), limit, step)
    placed = stored(placed.select(F.struct("doc_id", "place", "bytes").alias("key"), "depth", "prefix", "per_shard", "alone"))
    rows = rows.select("row", F.struct("doc_id", "place", "bytes").alias("key"), "seq", F.shiftright("seq", 33).alias("task"))
    alone = placed.where("alone").select("key").alias("p")
    chains = stored(rows.select("key", "seq", "task").alias("r").join(alone, F.expr("r.key <=> p.key"), "left_semi"))
    before = Window.partitionBy("key").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = chains.groupBy("key", "task").agg(F.count("*").alias("copies")).withColumn("start", F.coalesce(F.sum("copies").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("key", "task").orderBy("seq")) - 1
    numbered = chains.withColumn("inside", inside).alias("c").join(starts.alias("s"), F.expr("c.key <=> s.key and c.task = s.task"))
    numbered = numbered.select(F.col("c.seq").alias("seq"), (F.col("inside") + F.col("start")).alias("row_no"))
    dealt = rows.alias("r").join(placed.alias("p"), F.expr("r.key <=> p.key")).select("r.row", "r.seq", "p.depth", "p.prefix", "p.per_shard", "p.alone")
    dealt = dealt.join(numbered, "seq", "left").withColumnRenamed("row", "doc").withColumnRenamed("row_no", "row")
    dealt = dealt.select("doc.*", F.concat_ws("-", "depth", "prefix", _overflow()).alias("shard"))
    dealt.repartition("shard").write.partitionBy("shard").parquet(path)
