"""Substring dedup: passages of ``WINDOW`` words that start in a document of smaller id, by FM-indexes.

1. Scan: each document is cut into segments, the runs of windows with the same minimizer (the least
   hashed ``GRAM``-gram in the window). Equal windows have equal minimizers, so only segments whose
   minimizer occurs in two documents matter. Whole copies are settled by 128 bits of hash of all their words. Segments of equal
   words (128 bits of hash) are one class, of which the first, in the least document, stands for all.
2. Index content: windows of the classes are grouped by hash, map-side first, and each window that
   two documents hold is given to the least of them, its owner. So a passage that a third of all
   documents hold is indexed once.
3. Shards: owners' windows and the classes to search go to the shard of their minimizer. Shards with
   many classes are split over salts, each with a copy of the shard's index.
4. Search: a shard builds an FM-index (the BWT as sorted rows of each word) of its owners' passages and streams
   its classes through backward search, but for those whose minimizer no owned window has. Matching statistics of ``WINDOW`` or more are reported with their
   owner, and each segment of the class loses the windows whose owner is smaller than its document. The search
   compares words themselves; hashes choose what is indexed and where. (The 64-bit window hash
   could at worst hide a window that collides with another.)
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fm_index import FMIndex
from .shared import Scratch, claim, small_batches, table
from .words import _SEEN, hashes, mix, rolling

WINDOW = 50
GRAM = 25
LONGEST = 64  # windows of a segment
SHARD = 4_000  # segments to search in one group
WORD = re.compile("[^ \t-\r]+")
_BASES = (np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5))


#: Blanks of Python that are no blanks here.
_ODD = "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def words_of(text: str) -> list[str]:
    odd = _ODD[:4] if text.isascii() else _ODD
    return WORD.findall(text) if any(c in text for c in odd) else text.split()


def segments(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer, first window and number of windows of each segment, at most ``LONGEST``."""
    n = len(h) - window + 1
    if n <= 0:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 2
    least, width, want = rolling(h, gram), 1, window - gram + 1
    while width < want:  # the least of ``width`` grams from each place on, by doubling
        step = min(width, want - width)
        least, width = np.minimum(least[: len(least) - step], least[step:]), width + step
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    size = np.diff(np.r_[first, n])
    parts = -(-size // LONGEST)  # a text that repeats itself has long runs; their parts are mostly equal
    k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(first, parts) + k * LONGEST
    return np.repeat(least[first], parts), begin, np.minimum(np.repeat(size, parts) - k * LONGEST, LONGEST)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """Powers of ``base`` mod 2**64 from 0 to ``n`` at least, kept for the longest text so far."""
    found = _POWERS.get(base)
    if found is None or len(found) <= n:
        found = np.full(max(n + 1, 4096), base, np.uint64)
        found[0] = 1
        _POWERS[base] = found = np.multiply.accumulate(found)
    return found


def contents(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """Two hashes of the words from ``first`` to ``last`` (exclusive), by prefix sums of polynomials in odd bases mod 2**64."""
    out = []
    for base in _BASES:
        powers, back = _powers(int(base), len(h)), _powers(pow(int(base), -1, 1 << 64), len(h))
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h ^ base) * powers[: len(h)], out=sums[1:])
        out.append(mix((sums[last] - sums[first]) * back[first] + (last - first).astype(np.uint64)).view(np.int64))
    return out


def scan(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, n_words, sha, h1, h2, segs. ``docs``: doc_id, text."""
    small_batches(docs.sparkSession)

    def work(batches):
        import pyarrow as pa
        import xxhash

        claim("words", _SEEN.clear)
        kind = pa.list_(pa.struct([("mu", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("c1", pa.int64()), ("c2", pa.int64())]))
        for b in batches:
            n, sha, h1, h2, offsets, mus, firsts, sizes, c1, c2 = [], [], [], [], [0], [], [], [], [], []
            for text in b.column(1).to_pylist():
                words = words_of(text)
                h = hashes(words)
                joined = " ".join(words).encode("utf-8", "surrogatepass")
                d = xxhash.xxh3_128_intdigest(joined)
                mu, first, size = segments(h, window)
                n.append(len(words))
                sha.append(hashlib.sha256(joined).hexdigest())
                one, two = contents(h, first, first + size + window - 1) if len(mu) else (np.zeros(0, np.int64),) * 2
                c1.append(one)
                c2.append(two)
                h1.append((d >> 64) - (1 << 63))
                h2.append((d & ((1 << 64) - 1)) - (1 << 63))
                mus.append(mu.astype(np.int64))
                firsts.append(first)
                sizes.append(size)
                offsets.append(offsets[-1] + len(mu))
            flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (mus, firsts, sizes, c1, c2)]
            struct = pa.StructArray.from_arrays([pa.array(x.astype(f.type.to_pandas_dtype()), f.type) for x, f in zip(flat, kind.value_type)], fields=list(kind.value_type))
            segs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sha), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), segs], names=["doc_id", "n_words", "sha", "h1", "h2", "segs"])

    return docs.mapInArrow(work, "doc_id long, n_words long, sha string, h1 long, h2 long, segs array<struct<mu:long,start:int,n:int,c1:long,c2:long>>")


def _segments_of(column) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Where each row's segments begin in the flat columns, and those columns."""
    flat = column.flatten()
    begin = column.offsets.to_numpy()
    return begin - begin[0], {f.name: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(flat.type)}


def windows(texts: DataFrame, window: int) -> DataFrame:
    """f, doc_id, at, most of every window of the listed segments. ``texts``: doc_id, text, segs."""

    def work(batches):
        import pyarrow as pa

        for b in batches:
            fs, docs, ats, mosts = [], [], [], []
            begin, segs = _segments_of(b.column(2))
            for i, (doc, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                f = rolling(hashes(words_of(text)), window).view(np.int64)
                own = slice(begin[i], begin[i + 1])
                n = segs["n"][own].astype(np.int64)
                at = np.arange(n.sum()) + np.repeat(segs["start"][own] - np.cumsum(n) + n, n)
                fs.append(f[at])
                ats.append(at)
                docs.append(np.full(len(at), doc))
                mosts.append(np.repeat(segs["most"][own], n))
            columns = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (fs, docs, ats, mosts)]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2].astype(np.int32)), pa.array(columns[3])], names=["f", "doc_id", "at", "most"])

    return texts.mapInArrow(work, "f long, doc_id long, at int, most long")


def pieces(texts: DataFrame, window: int) -> DataFrame:
    """mu, own, c1, c2, doc_id, words: every listed class, and the runs of owned windows in it.
    ``texts``: doc_id, text, segs, owned (window numbers or null)."""

    def work(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            begin, segs = _segments_of(b.column(2))
            for i, (doc, text, owned) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist())):
                words = words_of(text)
                mine = np.sort(np.array(owned or [], np.int64))
                row = {c: x[begin[i] : begin[i + 1]] for c, x in segs.items()}
                cuts = np.searchsorted(mine, row["start"]), np.searchsorted(mine, row["start"] + row["n"])
                for mu, a, n, c1, c2, most, lo, hi in zip(*(row[c].tolist() for c in ("mu", "start", "n", "c1", "c2", "most")), *(x.tolist() for x in cuts)):
                    if hi - lo < n or most != doc:  # else every window's owner is the only document itself
                        out.append((mu, False, c1, c2, doc, " ".join(words[a : a + n + window - 1])))
                    if hi - lo == n:
                        out.append((mu, True, c1, c2, doc, " ".join(words[a : a + n + window - 1])))
                    elif hi > lo:
                        own = mine[lo:hi]
                        for run in np.split(own, np.flatnonzero(np.diff(own) != 1) + 1):
                            out.append((mu, True, c1, c2, doc, " ".join(words[run[0] : run[-1] + window])))
            columns = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["mu", "own", "c1", "c2", "doc_id", "words"])

    return texts.mapInArrow(work, "mu long, own boolean, c1 long, c2 long, doc_id long, words string")


def meeting(rows) -> tuple[list, list]:
    """What a shard indexes and what it searches, as (c1, c2, doc, words). ``rows``: mu, own, c1, c2, doc, words. Equal windows have equal
    minimizers, so what has a minimizer that the other side lacks can't match and is left out."""
    rows = list(rows)
    both = {r[0] for r in rows if r[1]} & {r[0] for r in rows if not r[1]}
    return [r[2:] for r in rows if r[1] and r[0] in both], [r[2:] for r in rows if not r[1] and r[0] in both]


def search_shard(own: list, queries: list, window: int) -> list[tuple[int, int, int, int, int]]:
    """(c1, c2, first window, windows, owner) of runs with one owner. ``own``, ``queries``: (c1, c2, doc, words)."""
    names: dict[str, int] = {}
    sequences = [np.array([names.setdefault(w, len(names)) for w in x[3].split(" ")], np.int64) for x in own]
    index = FMIndex(sequences, len(names))
    owners = np.array([x[2] for x in own], np.int64)
    get = names.get
    numbered = [[get(w, -1) for w in x[3].split(" ")] for x in queries]
    length = np.array([len(x) for x in numbered], np.int64)
    start = np.cumsum(length) - length
    q, at, seq = index.matches(np.fromiter((n for x in numbered for n in x), np.int64, int(length.sum())), start, length, window)
    if not len(q):
        return []
    owner = owners[seq]
    order = np.lexsort((at, q))
    q, at, owner = q[order], at[order], owner[order]
    cut = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])])
    size = np.diff(np.r_[cut, len(q)])
    return [(*queries[i][:2], x, n, o) for i, x, n, o in zip(q[cut].tolist(), at[cut].tolist(), size.tolist(), owner[cut].tolist())]


def repeated(texts: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """(c1, c2, at, size, owner): runs of a class's windows and their owner. ``texts``: doc_id, text, segs, the table of that name, which goes."""
    place = (F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << 32) + F.col("at")).cast("decimal(38,0)")  # stays in a hash map
    grouped = windows(texts, window).groupBy("f").agg(F.min(place).alias("first"), F.max("most").alias("last"))
    doc = F.floor(F.col("first") / F.lit(1 << 32).cast("decimal(11,0)")).cast("decimal(20,0)").cast("long")
    grouped = grouped.withColumn("doc_id", doc).where("doc_id <> last").withColumn("at", (F.col("first") - F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << 32)).cast("int"))
    owned = scratch.table(grouped.groupBy("doc_id").agg(F.collect_list("at").alias("owned")), "owned")  # at most a document's windows
    cut = scratch.table(pieces(texts.join(owned, "doc_id", "left").select("doc_id", "text", "segs", "owned"), window), "pieces")
    scratch.drop("texts", "owned")
    total = cut.where("NOT own").count()
    shards = max(1, -(-total // SHARD))
    keyed = cut.withColumn("shard", F.pmod("mu", F.lit(shards)))
    loads = scratch.table(keyed.where("NOT own").groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(SHARD)).cast("int").alias("salts")), "loads")
    salt = F.when(F.col("own"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("c1", "c2"), F.col("salts")).cast("int")))
    dealt = keyed.join(loads, "shard").select("shard", F.explode(salt).alias("salt"), "mu", "own", "c1", "c2", "doc_id", "words")

    def work(tables):
        import pyarrow as pa

        own, queries = meeting(zip(*(tables.column(n).to_pylist() for n in ("mu", "own", "c1", "c2", "doc_id", "words"))))
        found = search_shard(own, queries, window) if own and queries else []
        columns = list(zip(*found)) or [[]] * 5
        types = {"c1": pa.int64(), "c2": pa.int64(), "at": pa.int32(), "size": pa.int32(), "owner": pa.int64()}
        return pa.table({n: pa.array(c, t) for (n, t), c in zip(types.items(), columns)})

    runs = scratch.table(dealt.groupBy("shard", "salt").applyInArrow(work, "c1 long, c2 long, at int, size int, owner long"), "runs")
    scratch.drop("pieces", "loads")
    return runs


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256.

    Words are runs of characters other than space and U+0009 to U+000D. Each word covered by a window of
    ``window`` words that also starts in a document of smaller id goes; windows are judged on the input.
    A null text has no words. A null id is neither smaller nor larger: such rows keep all. Rows that
    repeat an id and a text are one document; rows of an id that holds different texts keep all too. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "substring_dedup")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    seen = scratch.table(scan(rows, window), "scan")
    known = seen.where("doc_id IS NOT NULL")
    unsure = scratch.table(known.groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("lo"), F.max(F.struct("h1", "h2")).alias("hi")).where("lo <> hi").select("doc_id"), "unsure")
    if not unsure.isEmpty():
        known = known.join(unsure, "doc_id", "left_anti")
    classes = scratch.table(known.where(F.col("n_words") >= window).groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")), "classes")
    copies = scratch.table(known.join(classes.where("least <> most"), ["h1", "h2"]).where("doc_id <> least").select("doc_id").distinct(), "copies")

    segs = known.where(F.size("segs") > 0).select("doc_id", F.explode("segs").alias("s")).select("doc_id", "s.*")
    shared = scratch.table(segs.groupBy("mu").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select("mu"), "shared")
    segs = scratch.table(segs.join(shared, "mu").distinct().join(copies, "doc_id", "left_anti"), "segs")
    seen = scratch.table(seen.select("doc_id", "n_words", "sha"), "names")
    scratch.drop("scan", "unsure", "classes", "shared")
    groups = segs.groupBy("mu", "c1", "c2", "n").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.max("doc_id").alias("most"))
    listed = groups.groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.collect_list(F.struct("mu", F.col("first.start").alias("start"), "n", "c1", "c2", "most")).alias("segs"))  # at most a document's segments
    listed = scratch.table(listed, "listed")
    texts = scratch.table(rows.join(listed, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "segs"), "texts")
    scratch.drop("listed")
    found = repeated(texts, window, scratch)
    runs = segs.join(found, ["c1", "c2"]).where("owner < doc_id").groupBy("doc_id").agg(F.collect_list(F.struct((F.col("start") + F.col("at")).alias("start"), F.col("size").alias("n"))).alias("runs"))  # at most a document's windows
    runs = scratch.table(runs, "gone-runs")
    scratch.drop("segs", "runs")

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            removed, sha = [], []
            for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = words_of(text)
                gone = np.zeros(len(words) + 1, np.int64)
                for r in found:
                    gone[r["start"]] += 1
                    gone[r["start"] + r["n"] + window - 1] -= 1
                keep = np.cumsum(gone[:-1]) == 0
                removed.append(int(len(words) - keep.sum()))
                sha.append(hashlib.sha256(" ".join([w for w, k in zip(words, keep.tolist()) if k]).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(removed, pa.int64()), pa.array(sha)], names=["doc_id", "removed", "cut_sha"])

    done = rows.join(runs, "doc_id").select("doc_id", "text", "runs").dropDuplicates(["doc_id"]).mapInArrow(cut, "doc_id long, removed long, cut_sha string")
    empty = hashlib.sha256(b"").hexdigest()
    gone = copies.select("doc_id", F.lit(None).cast("long").alias("removed"), F.lit(empty).alias("cut_sha")).unionByName(done)
    gone = scratch.table(gone, "gone")
    scratch.drop("copies", "gone-runs")
    out = seen.select("doc_id", "n_words", "sha").join(gone, "doc_id", "left")
    n = F.when(F.col("cut_sha").isNull(), F.lit(0)).otherwise(F.coalesce("removed", "n_words")).cast("long")
    return out.select("doc_id", "n_words", n.alias("n_removed"), F.coalesce("cut_sha", "sha").alias("kept_sha256"))


def op2_substring_dedup(spark, sf_dir):
    return substring_dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS f FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50) x),
g AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY f) AS first FROM s) y WHERE first < doc_id),
r AS (SELECT DISTINCT doc_id, i + k AS j FROM g CROSS JOIN (SELECT unnest(range(0, 50)) AS k) z),
k AS (SELECT t.doc_id, count(r.j) AS n_removed, coalesce(string_agg(CASE WHEN r.j IS NULL THEN t.word END, ' ' ORDER BY t.j), '') AS kept
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d) t LEFT JOIN r ON r.doc_id = t.doc_id AND r.j = t.j GROUP BY t.doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
