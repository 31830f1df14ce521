"""Near dedup by order MinHash: sketches of occurrence-labelled word 3-grams in text order, verified by
banded alignment.

1. Texts are words (lower case, ``\\w+``). Equal word sequences form exact classes, so thousands of copies cost one
   row. Sketch ``r`` takes the ``PICK`` least hashes of the labelled 3-grams (gram, how many times it occurred before) and
   keeps their text order.
2. Classes with an equal sketch share a bucket (see ``buckets``): all its pairs are compared but those that lengths or
   counts of words rule out, or that links already connect.
3. A pair is linked if 1 - distance / longer length, by word edits, is at least ``least``. The aligner
   keeps a band of as many diagonals as that distance allows.
4. Linked classes form components; the class id is the component's least document id.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import buckets
from .components import components
from .shared import Scratch, claim, small_batches, table
from .words import _SEEN, hashes, mix, rolling

K = 3
SKETCHES = 32
PICK = 2
WORD = re.compile(r"\w+")


def labelled(grams: np.ndarray) -> np.ndarray:
    """Gram hashes mixed with the number of earlier occurrences of the same gram."""
    order = np.argsort(grams, kind="stable")
    g = grams[order]
    first = np.r_[True, g[1:] != g[:-1]]
    start = np.maximum.accumulate(np.where(first, np.arange(len(g)), 0))
    occurrence = np.empty(len(g), np.uint64)
    occurrence[order] = (np.arange(len(g)) - start).astype(np.uint64)
    return mix(grams + occurrence * np.uint64(0xD6E8FEB86659FD93))


def sketch(h: np.ndarray, sketches: int = SKETCHES, pick: int = PICK) -> list[int]:
    """One key a sketch; none without words."""
    if not len(h):
        return []
    grams = rolling(h, min(K, len(h)))
    x = labelled(grams)
    rows = np.arange(sketches)
    draws = mix((rows.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA24BAED4963EE407))[:, None]
    at = np.empty((sketches, min(pick, len(x))), np.int64)
    step = max(1, 1_000_000 // len(x))
    for r in range(0, sketches, step):
        y = (x ^ draws[r : r + step]) * (draws[r : r + step] | np.uint64(1))
        for k in range(at.shape[1]):
            at[r : r + step, k] = least = y.argmin(1)
            y[np.arange(len(y)), least] = np.uint64(0xFFFFFFFFFFFFFFFF)
    at.sort(1)
    key = rows.astype(np.uint64)
    for k in range(at.shape[1]):
        key = mix(key * np.uint64(31) + x[at[:, k]])
    return key.astype(np.int64).tolist()


def distance(a: list, b: list, most: int) -> int:
    """Edit distance of two sequences, or ``most`` + 1 if above. Bit-parallel over a band of 2 * most + 1
    diagonals: bit i of the vectors is the row j - most + i of column j."""
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n - m > most:
        return most + 1
    s = 0
    while s < m and a[s] == b[s]:
        s += 1
    e = 0
    while e < m - s and a[n - 1 - e] == b[m - 1 - e]:
        e += 1
    a, b = a[s : n - e], b[s : m - e]
    n, m = len(a), len(b)
    if not m:
        return n
    k = min(most, n)
    where: dict = {}
    for i, x in enumerate(b):
        where[x] = where.get(x, 0) | (1 << i)
    width = 2 * k + 1
    full = (1 << width) - 1
    # column 0: D[row][0] = row for the rows below the diagonal; rows above row 0 count as equal to it
    vp, vn = full & ~((1 << (k + 1)) - 1), 0
    score = k  # D at the band's lowest row of column 0, kept along the lowest diagonal
    top = 1 << (width - 1)
    for j in range(1, n + 1):
        # row of bit i is j - k + i, in b's positions from 1; shift the matches so that bit i is that row
        pm = where.get(a[j - 1], 0)
        shift = j - k - 1
        pm = (pm >> shift if shift >= 0 else pm << -shift) & full
        # the vectors of column j - 1 hold row j - 1 - k + i at bit i: bring them to this column's rows
        vp, vn = vp >> 1, vn >> 1
        vp |= top  # the row below the old band: taken as one more than the last
        d0 = ((((pm & vp) + vp) ^ vp) | pm | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        # along the lowest diagonal the value grows unless the step from (row - 1, column - 1) is free
        if not d0 & top:
            score += 1
        hp1, hn1 = (hp << 1) & full, (hn << 1) & full
        if shift < 0:
            hp1 |= 1 << (-shift) if -shift < width else 0  # row 0: its horizontal step is one
            hn1 &= ~(1 << (-shift))
        vp = (hn1 | ~(d0 | hp1)) & full
        vn = d0 & hp1
    # walk up from the band's lowest row of the last column to row m
    row = n + k
    bit = width - 1
    while row > m and bit >= 0:
        if vp >> bit & 1:
            score -= 1
        elif vn >> bit & 1:
            score += 1
        row, bit = row - 1, bit - 1
    return score if score <= most else most + 1


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the multiset intersection; the longer length less it is no more than the edit distance."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum())


def _names(h: np.ndarray) -> tuple[int, int]:
    """128 bits of hash of a word sequence."""
    d = xxhash.xxh3_128_intdigest(h.tobytes())
    return (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)


def sketches_of(docs: DataFrame) -> DataFrame:
    """doc_id, words, h1, h2 (of the whole word sequence), mins (the sketches). ``docs``: doc_id, text."""
    small_batches(docs.sparkSession)

    def work(batches):
        import pyarrow as pa

        claim("words", _SEEN.clear)
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                h = hashes(WORD.findall(text.lower()))
                rows.append((len(h), *_names(h), np.array(sketch(h), "<i8").tobytes()))
            n, h1, h2, mins = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(mins, pa.binary())], names=["doc_id", "words", "h1", "h2", "mins"])

    return docs.mapInArrow(work, "doc_id long, words int, h1 long, h2 long, mins binary")


def word_ids(docs: DataFrame) -> DataFrame:
    """id (h1) of each document's word sequence and its words as 32-bit hashes in bytes."""

    def work(batches):
        import pyarrow as pa

        for b in batches:
            found = [hashes(WORD.findall(t.lower())) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_names(h)[0] for h in found], pa.int64()), pa.array([h.astype(np.uint32).tobytes() for h in found], pa.binary())], names=["id", "data"])

    return docs.mapInArrow(work, "id long, data binary")


def read_keys(b) -> dict[str, np.ndarray]:
    """Keys of a batch of h1, words, mins."""
    keys = np.frombuffer(b"".join(b.column(2).to_pylist()), "<u8")
    wide = lambda x, t: np.repeat(x.to_numpy(zero_copy_only=False).astype(t), SKETCHES)
    return {"key": keys.copy(), "id": wide(b.column(0), np.int64), "size": wide(b.column(1), np.uint32), "sig": np.zeros(len(keys), np.uint32), "pos": np.zeros(len(keys), np.uint32), "at": np.tile(np.arange(SKETCHES, dtype=np.uint8), len(b))}


def links(classes: DataFrame, rows: DataFrame, least: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Linked (a, b) pairs of classes that share a sketch, and (node, root) of them. ``classes``: h1, rep_id, words, mins; ``rows``: doc_id, text."""

    def fits(x, y):
        longer = np.maximum(x["size"], y["size"])
        return longer - np.minimum(x["size"], y["size"]) <= np.floor(longer * (1 - least) + 1e-9)

    def may(x, y):
        """Whether the counts of words by the last byte of their hash leave room for a link: their overlap is no less than ``common``."""
        p, q = (z["extra"].view("<u2") for z in (x, y))
        longer, full = np.maximum(x["size"], y["size"]), (p == 0xFFFF).any(1) | (q == 0xFFFF).any(1)
        return full | (longer - np.minimum(p, q).sum(1) <= np.floor(longer * (1 - least) + 1e-9))

    def counts(batches):
        import pyarrow as pa

        for b in batches:
            found = [np.minimum(np.bincount(np.frombuffer(x, np.uint8)[::4], minlength=256), 0xFFFF).astype("<u2").tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.zeros(len(found), np.int32)), pa.array(found, pa.binary())], names=["id", "level", "extra"])

    def extra(wanted):
        return ids(wanted).mapInArrow(counts, "id long, level int, extra binary")

    def judge(x, y):
        x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
        longer = max(len(x), len(y))
        most = int(longer * (1 - least) + 1e-9)
        return bool(longer - common(x, y) <= most and distance(x.tolist(), y.tolist(), most) <= most)

    def ids(wanted):
        docs = buckets.only(classes.select(F.col("h1").alias("id"), "rep_id"), wanted).select(F.col("rep_id").alias("id")).distinct()
        return word_ids(buckets.only(rows.select(F.col("doc_id").alias("id"), "text"), scratch.table(docs, "wanted")))

    near = f"greatest(size, lead_size) - least(size, lead_size) <= floor(greatest(size, lead_size) * {1 - least} + 1e-9)"
    return buckets.links(classes.where("words > 0").select("h1", "words", "mins"), read_keys, fits, near, extra, may, ids, judge, scratch)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """One row per input row: doc_id, class_id, rep_id, links, kept.

    class_id is the least id of the document's group of near copies, rep_id the least id with the same
    words, links the verified links of that representative, enough of them to connect the group; kept whether the row's id is the class id.
    A null text has no words; all texts without words are copies of each other. Rows with a null id take
    no part: null class, no links, kept. Rows that repeat an id are one document: its texts belong to one group.
    An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "near_dedup")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    drawn = scratch.table(sketches_of(rows.where("doc_id IS NOT NULL")), "sketches")
    classes = scratch.table(drawn.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep_id")), "classes")
    reps = drawn.join(classes, ["h1", "h2"]).where("doc_id = rep_id").select("h1", "h2", "rep_id", "words", "mins")
    odd = classes.groupBy("h1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1")  # different words of one first hash: only exact copies are found
    reps = scratch.table(reps if odd.isEmpty() else reps.join(odd, "h1", "left_anti"), "reps")
    linked, roots = links(reps, rows, least, scratch)
    linked = scratch.table(linked.distinct(), "links")
    again = drawn.groupBy("doc_id").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("doc_id", "lo")
    again = scratch.table(drawn.join(again, "doc_id").select(F.col("h1").alias("a"), F.col("lo").alias("b")), "again")
    if not again.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(again), scratch)
    degree = linked.select(F.col("a").alias("h1")).unionByName(linked.select(F.col("b").alias("h1"))).groupBy("h1").agg(F.count(F.lit(1)).alias("links"))
    rooted = roots.join(classes.select(F.col("h1").alias("node"), "rep_id"), "node")
    rooted = rooted.join(rooted.groupBy("root").agg(F.min("rep_id").alias("class_id")), "root").select(F.col("node").alias("h1"), "class_id").distinct()
    named = classes.join(rooted, "h1", "left").join(degree, "h1", "left")
    named = scratch.table(named.select("h1", "h2", "rep_id", F.coalesce("class_id", "rep_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links")), "named")
    out = drawn.select("doc_id", "h1", "h2").join(named, ["h1", "h2"]).select("doc_id", "class_id", "rep_id", "links", (F.col("doc_id") == F.col("class_id")).alias("kept"))
    scratch.drop("classes", "reps", "links", "wanted")
    return out.unionByName(rows.where("doc_id IS NULL").select("doc_id", *[F.lit(None).cast("long").alias(c) for c in ("class_id", "rep_id")], F.lit(0).cast("long").alias("links"), F.lit(True).alias("kept")))


def op6_near_dedup(spark, sf_dir):
    return near_dedup(table(spark, sf_dir, "documents"))


def stage(spark, docs, sf_dir):
    """Pipeline stage: one document of each group of near copies stays. Rows with a null id stay; repeated rows of the id that stays do
    too; texts without words are one group; an empty table stays empty."""
    gone = near_dedup(docs).where("NOT kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
