"""Token ids in files of the context-mixing codec: written in ascending id order and read back.

Documents are range-partitioned by id and sorted, tokenised, and each task writes files of blocks
(see id_codec), each followed by a table of its documents' lengths and a footer. Offsets follow from the files' totals. Reading
decodes and checks every block. Writer and reader hold ``id_codec.LANES`` blocks and one file's table."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import id_codec
from .shared import Scratch, filesystem, publish, small_batches, table

RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"
_FOOT = "<QQI8s"  # documents, bytes of blocks, checksum of the table, magic


def write_token_files(docs: DataFrame, tokenizer: str, scratch: Scratch, end_id: int = 2, docs_per_file: int = 4_000) -> DataFrame:
    """A table (part, path, documents, ids), part numbering the files in id order. ``docs``: doc_id, text. Null ids come first."""
    small_batches(docs.sparkSession)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    end = np.asarray([end_id], dtype="<u4").tobytes()
    folder = scratch.path("ids")

    def work(batches):
        import itertools

        import pyarrow as pa
        from pyspark import TaskContext

        from .encode import encoder

        enc, task, done = encoder(tokenizer), TaskContext.get().partitionId(), []
        rows = (r for b in batches for r in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist())))
        row = next(rows, None)
        while row is not None:
            path, table_ = f"{folder}/part-{task:06d}-{len(done):05d}.wids", []
            first = row

            def fill(out):
                nonlocal row
                table_.clear()
                held, held_n, size, most = [], 0, 0, id_codec.BLOCK * id_codec.LANES
                for row in itertools.chain([first], rows):
                    if len(table_) == docs_per_file:
                        break
                    held += [row[1], end]
                    table_.append((row[0], len(row[1]) // 4 + 1))
                    held_n += table_[-1][1]
                    while held_n >= most:
                        data = b"".join(held)
                        size += id_codec.write_ids(out, np.frombuffer(data[: 4 * most], "<u4"))
                        held, held_n = [data[4 * most :]], held_n - most
                else:
                    row = None
                if held_n:
                    size += id_codec.write_ids(out, np.frombuffer(b"".join(held), "<u4"))
                known = np.array([d is not None for d, _ in table_], np.uint8)
                index = known.tobytes() + np.array([d or 0 for d, _ in table_], "<i8").tobytes() + np.array([n for _, n in table_], "<u8").tobytes()
                out.write(index + struct.pack(_FOOT, len(table_), size, zlib.crc32(index), id_codec.MAGIC))

            publish(path, fill)
            done.append(((task << 32) + len(done), path, len(table_), sum(n for _, n in table_)))
        columns = list(zip(*done)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["part", "path", "documents", "ids"])

    ordered = docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    return scratch.table(ordered.mapInArrow(work, "part long, path string, documents long, ids long"), "files")


def read_file(path: str):
    """Yield (doc_id, ids) of a file. Raises ValueError on damage."""
    fs, p = filesystem(path)
    with fs.open_input_file(p) as f:
        end = f.size() - struct.calcsize(_FOOT)
        f.seek(max(end, 0))
        foot = f.read()
        if end < 0 or len(foot) != struct.calcsize(_FOOT):
            raise ValueError(f"{path}: not a file of token ids")
        n_docs, size, crc, magic = struct.unpack(_FOOT, foot)
        if magic != id_codec.MAGIC or size + 17 * n_docs != end:
            raise ValueError(f"{path}: not a file of token ids")
        f.seek(size)
        index = f.read(17 * n_docs)
        if zlib.crc32(index) != crc:
            raise ValueError(f"{path}: its table is damaged")
        known = np.frombuffer(index, np.uint8, n_docs)
        docs = np.frombuffer(index, "<i8", n_docs, n_docs)
        counts = np.frombuffer(index, "<u8", n_docs, 9 * n_docs)
        f.seek(0)
        source, held = id_codec.read_ids(f, size), np.zeros(0, np.uint32)
        for k, doc, n in zip(known, docs, counts):
            while len(held) < n:
                held = np.concatenate([held, next(source)])
            yield (int(doc) if k else None), held[: int(n)]
            held = held[int(n) :]


def read_token_files(files: DataFrame) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32."""
    spark = files.sparkSession
    tasks = sorted(files.groupBy(F.shiftright("part", 32).alias("task")).agg(F.sum("ids").alias("ids")).collect())  # two numbers a task
    at, starts = 0, []
    for task, n in tasks:
        starts.append((task, at))
        at += n
    before = W.partitionBy("task").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a task's files
    begun = files.withColumn("task", F.shiftright("part", 32)).join(F.broadcast(spark.createDataFrame(starts, "task long, task_begin long")), "task")
    begun = begun.select("path", (F.col("task_begin") + F.coalesce(F.sum("ids").over(before), F.lit(0))).alias("begin"))

    def work(batches):
        import pyarrow as pa

        schema = pa.schema([(c.split()[0], pa.int64()) for c in RESULT.split(", ")])
        for b in batches:
            for path, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out = []
                for doc, ids in read_file(path):
                    out.append((doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    return begun.repartition(max(1, files.count()), "path").mapInArrow(work, RESULT)


def token_files(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, docs_per_file: int = 4_000) -> DataFrame:
    """Write every text's ids and the end id to files in ascending id order, read them back, and return
    doc_id, start, n_tokens, ids_crc32. A null text is the end id alone; null doc_ids come first; rows
    that repeat an id follow each other in no fixed order. An empty table gives no files and no rows. Ids must be below 65,535, as the codec's are."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return read_token_files(write_token_files(rows, tokenizer, Scratch(docs.sparkSession, "token_files"), end_id, docs_per_file))


def op7_token_files(spark, sf_dir):
    import public_tokenizers

    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
