"""Exact dedup by an extendible-hash index on shared files, in DataFrame functions only.

1. Directory: rows are counted by the first ``MAX_DEPTH`` bits of the 64-bit key of their normalised text. Starting from one
   bucket, the directory doubles wherever a bucket holds over ``capacity`` rows. It has at most
   2**MAX_DEPTH slots (65,536 rows of two numbers), which bounds what is broadcast.
2. Entries: rows meet in their bucket by (bucket, key, bytes of the normalised text). Grouping compares the bytes of whole
   texts, so texts whose keys collide stay apart. Copies meet in map-side aggregation first, so a
   text that a third of all rows hold costs one row per task.
3. Index files: owner tasks take ranges of (bucket, key), without texts, and chain the entries of one key: ``link`` is an entry's place in
   its chain.
4. Probe: each document looks up (bucket, key, digest) in the index. The index is a table of files,
   so the join has plain exchanges on both sides, and Spark splits a hot key's partitions.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import Scratch, table

#: Whitespace that normalisation deletes: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
MAX_DEPTH = 16
_SPAN = Decimal(2**64)


def normalised(text):
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def directory(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """(first slot, depth) of every bucket; slots are counted at MAX_DEPTH. ``counts``: entries by slot."""
    done, open_ = [], [(0, 0)]
    for depth in range(MAX_DEPTH + 1):
        width = 1 << (MAX_DEPTH - depth)
        nxt = []
        load: dict[int, int] = {}
        for slot, n in counts.items():
            load[slot // width] = load.get(slot // width, 0) + n
        for first, _ in open_:
            if load.get(first // width, 0) <= capacity or depth == MAX_DEPTH:
                done.append((first, depth))
            else:  # overfull: the directory doubles here
                nxt += [(first, depth + 1), (first + width // 2, depth + 1)]
        open_ = nxt
    return sorted(done)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1 << 18) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, bucket, link.

    Texts are equal when identical without blanks; of equal texts the row with the most code points,
    then the smallest id, stays. A null text counts as empty; all empty texts are one group. A null id
    ranks after every other id and is kept only if its whole group has null ids. Rows that repeat both
    id and text share one decision. Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact_dedup")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(text).alias("n_cp"), normalised(F.col(text_col)).alias("norm")).withColumn("key", F.xxhash64("norm"))
    # most code points, then smallest id, as one number: an aggregate of decimals stays in a hash map
    last = F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)).cast("decimal(20,0)")
    rank = F.col("n_cp").cast("decimal(11,0)") * F.lit(_SPAN).cast("decimal(20,0)") - last
    slot = F.shiftrightunsigned("key", 64 - MAX_DEPTH).cast("int")
    counts = {r[0]: r[1] for r in rows.groupBy(slot.alias("slot")).count().collect()}  # at most 2**MAX_DEPTH rows
    buckets = directory(counts, capacity)
    slots = spark.createDataFrame([(s, b) for b, (first, depth) in enumerate(buckets) for s in range(first, first + (1 << (MAX_DEPTH - depth)))], "slot int, bucket int")
    rows = rows.withColumn("slot", slot).join(F.broadcast(slots), "slot").drop("slot")

    entries = rows.groupBy("bucket", "key", "norm").agg(F.max(rank.cast("decimal(38,0)")).alias("best"), F.max("n_cp").alias("n_cp"), F.count(F.lit(1)).alias("group_size"))
    keep = (F.col("n_cp").cast("decimal(11,0)") * F.lit(_SPAN).cast("decimal(20,0)") - F.col("best")).cast("decimal(20,0)").cast("long")
    entries = scratch.table(entries.select("bucket", "key", F.sha2("norm", 256).alias("sha"), F.when(keep != 2**63 - 1, keep).alias("keep_id"), "group_size"), "entries")
    chain = W.partitionBy("bucket", "key").orderBy("sha")
    owned = entries.repartitionByRange("bucket", "key").withColumn("link", F.row_number().over(chain) - 1)
    index = scratch.table(owned.sortWithinPartitions("bucket", "key", "link"), "index")
    scratch.drop("entries")

    probe = rows.select("doc_id", "key", F.sha2("norm", 256).alias("sha"), "bucket")
    return probe.join(index, ["bucket", "key", "sha"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"), "bucket", "link"
    )


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents")).drop("bucket", "link")


ORACLE = r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), k AS (
  SELECT doc_id, norm, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
  FROM n WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""
