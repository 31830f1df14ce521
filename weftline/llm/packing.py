"""Sum-of-squares online packing of tokenised documents into windows of at most ``size`` ids.

Each input partition is packed by itself in one pass, so nothing is shuffled and a lost task is just
run again. The packer keeps the level array N: N[h] counts the open windows filled to h. A document's
remainder of r ids goes to the level h (0: a new window) for which the sum of N[h]**2 over the partly
filled levels becomes least; that changes it by 2 * (N[h + r] - N[h] + 1), with N[0] and N[size] as 0.
Ids beyond whole windows of a long document are cut off first. What is open at the end of a partition,
or above ``max_open`` windows, is closed by cutting the emptiest windows up to fill the fullest, and a
last rest is cut into powers of two, the lengths that need no padding.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, table

SIZE = 2048
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Pieces are (doc, start, ids as bytes of 32-bit numbers, doc's ids in all)."""

    def __init__(self, size: int = SIZE, max_open: int = 4096):
        self.size, self.max_open = size, max_open
        self.level = np.zeros(size + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = {}
        self.n_open = 0
        self.closed: list[list] = []

    def add(self, doc, ids: bytes) -> None:
        size, total = self.size, len(ids) // 4
        whole = total - total % size
        for at in range(0, whole, size):
            self.closed.append([(doc, at, ids[4 * at : 4 * (at + size)], total)])
        if whole == total:
            return
        r, n = total - whole, self.level
        cost = n[r:] - n[: size + 1 - r]
        cost[(n[: size + 1 - r] == 0)] = np.iinfo(np.int64).max
        cost[0] = n[r]
        h = int(cost.argmin())
        window = []
        if h:
            window = self.open[h].pop()
            n[h] -= 1
            self.n_open -= 1
        window.append((doc, whole, ids[4 * whole :], total))
        if h + r == size:
            self.closed.append(window)
        else:
            self.open.setdefault(h + r, []).append(window)
            n[h + r] += 1
            self.n_open += 1
            if self.n_open > self.max_open:
                self.settle(last=False)

    def settle(self, last: bool = True) -> None:
        """Close the open windows: the emptiest are cut up to fill the fullest."""
        size = self.size
        windows = [w for h in sorted(self.open, reverse=True) for w in self.open[h]]
        self.open, self.n_open = {}, 0
        self.level[:] = 0
        a, b, rest = 0, len(windows) - 1, []
        fill = sum(len(p[2]) // 4 for p in windows[0]) if windows else 0
        while a < b or (rest and a <= b):
            if not rest:
                rest, b = windows[b], b - 1
            doc, start, ids, total = rest.pop()
            take = min(size - fill, len(ids) // 4)
            windows[a].append((doc, start, ids[: 4 * take], total))
            fill += take
            if 4 * take < len(ids):
                rest.append((doc, start + take, ids[4 * take :], total))
            if fill == size:
                self.closed.append(windows[a])
                a += 1
                fill = sum(len(p[2]) // 4 for p in windows[a]) if a <= b else 0
        left = rest + (windows[a] if a <= b else [])
        count = sum(len(p[2]) // 4 for p in left)
        if not count:
            return
        if not last:
            self.open, self.n_open = {count: [left]}, 1
            self.level[count] = 1
            return
        while left:  # the binary digits of the rest
            want, window = 1 << (count.bit_length() - 1), []
            count -= want
            while want:
                doc, start, ids, total = left.pop()
                take = min(want, len(ids) // 4)
                window.append((doc, start, ids[: 4 * take], total))
                want -= take
                if 4 * take < len(ids):
                    left.append((doc, start + take, ids[4 * take :], total))
            self.closed.append(window)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, size: int = SIZE, max_open: int = 4096) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer``: path of a tokenizers file. A null or empty text is the end id alone. Rows that repeat
    an id are packed each for itself. sequence_id is (partition << 33) + its number there. Other columns
    are ignored; an empty table gives no rows. ``size`` must be a power of two.
    """
    small_batches(docs.sparkSession)
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def work(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from .encode import encoder

        enc, packer = encoder(tokenizer), Packer(size, max_open)
        sequence = TaskContext.get().partitionId() << 33
        schema = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])

        def rows():
            nonlocal sequence
            out = []
            for window in packer.closed:
                offset = 0
                for doc, start, ids, total in window:
                    n = len(ids) // 4
                    out.append((doc, start, n, zlib.crc32(ids), total, sequence, offset))
                    offset += n
                sequence += 1
            packer.closed = []
            columns = list(zip(*out)) if out else [[]] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

        for b in batches:
            for doc, data in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist())):
                packer.add(doc, data + end)
            yield rows()
        packer.settle()
        yield rows()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(work, SCHEMA)


def op4_packing(spark, sf_dir):
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def stage(spark, docs, sf_dir):
    """Pipeline stage: pack what is left."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
