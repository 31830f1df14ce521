"""Benchmark decontamination: BM25 over test items with block-max WAND, then overlap of question and answer.

The inverted index holds test items, whose size is checked: items go in blocks of at most ``max_chars``
characters, each a broadcast of bounded size, and every block is queried by all passages of all
documents. Documents are scanned in place, so nothing of them is shuffled.

Each document is cut into overlapping passages, of which the longest item fits into one. An item's
threshold is a share of the score it gives itself. Each item's terms of least impact, up to ``FREE`` of its
own score, are set aside: whatever a passage has of them, its other (essential) terms must bring the
rest of the threshold. Essential terms have short lists, so one sum over them shows which passages can
reach any item's threshold at all; those go through WAND with block maxima. What is retrieved must then hold the item's question and its answer, by shares of their
five-word shingles."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, claim, small_batches, table

WORD = re.compile(r"\w+")
SHINGLE = 5
K1, B = 1.2, 0.75
BLOCK = 16
FREE = 0.35
RESULT = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long, text_key long"


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Question and answer words: an item's last sentence is its answer, or its last quarter if it has one sentence."""
    sentences = [w for s in re.split(r"(?<=[.?!])\s+", text.strip()) if (w := WORD.findall(s.lower()))]
    if not sentences:
        return [], []
    if len(sentences) == 1:
        w = sentences[0]
        cut = len(w) - max(1, len(w) // 4)
        return w[:cut], w[cut:]
    return [w for s in sentences[:-1] for w in s], sentences[-1]


def overlap(part: list[str], words: list[str]) -> float:
    """Share of ``part``'s shingles of five words (or of all its words, if fewer) that ``words`` has."""
    if not part:
        return 1.0
    n = min(SHINGLE, len(part))
    there = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
    own = {tuple(part[i : i + n]) for i in range(len(part) - n + 1)}
    return len(own & there) / len(own)


def item_words(text: str) -> list[str]:
    """All words of an item; none if it has no sentence."""
    q, a = split_item(text or "")
    return q + a


class Index:
    """Impact-ordered blocks over postings sorted by item. ``items``: (id, text) pairs; ``corpus``: number of items, their mean and longest
    length and the words' document frequencies, if ``items`` are a part of them."""

    def __init__(self, items: list, share: float, corpus: tuple | None = None):
        kept = [(i, q, a) for i, t in sorted(items, key=lambda x: (x[0] is not None, x[0] or 0)) for q, a in [split_item(t or "")] if q or a]
        self.ids, self.parts = [k[0] for k in kept], [(q, a) for _, q, a in kept]
        bags = [Counter(q + a) for q, a in self.parts]
        lengths = [sum(b.values()) for b in bags]
        n, mean, self.longest, df = corpus or (len(bags), sum(lengths) / max(1, len(bags)), max(lengths, default=0), Counter(t for b in bags for t in b))
        idf = {t: math.log(1 + (n - c + 0.5) / (c + 0.5)) for t, c in df.items()}
        lists: dict[str, list] = {}
        self.own, self.must, essential = [], [], {}
        for k, b in enumerate(bags):
            impacts = {t: idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * lengths[k] / mean)) for t, f in b.items()}
            for t, x in impacts.items():
                lists.setdefault(t, []).append((k, x))
            whole, rest = sum(impacts.values()), 0.0
            need, free = share * whole, min(FREE, share / 2) * whole
            self.own.append(need)
            terms = sorted(impacts, key=lambda t: (impacts[t], t))
            while terms and rest + impacts[terms[0]] <= free:
                rest += impacts[terms.pop(0)]
            self.must.append(need - rest - 1e-9)
            for t in terms:
                essential.setdefault(t, []).append((k, impacts[t]))
        self.essential = essential
        self.lists = {t: ([p[0] for p in ps], [p[1] for p in ps], [max(x for _, x in ps[a : a + BLOCK]) for a in range(0, len(ps), BLOCK)], max(x for _, x in ps)) for t, ps in lists.items()}
        self.least = min(self.own, default=math.inf)

    def search(self, terms) -> list[tuple[int, float]]:
        """Items whose score reaches their threshold, by WAND with block maxima."""
        cursors = [[0, *self.lists[t]] for t in terms if t in self.lists]
        found, least = [], self.least - 1e-9
        while cursors:
            cursors.sort(key=lambda c: c[1][c[0]])
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                bound += c[4]
                if bound >= least:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = cursors[pivot][1][cursors[pivot][0]]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][1][cursors[pivot + 1][0]] == item:
                pivot += 1
            need = self.own[item] - 1e-9
            head = cursors[: pivot + 1]
            tight = 0.0
            for c in head:  # each list's block that could hold the item
                at = c[0]
                while at < len(c[1]) and c[1][at] < item:
                    at = min((at // BLOCK + 1) * BLOCK, len(c[1])) if c[1][min((at // BLOCK + 1) * BLOCK, len(c[1])) - 1] < item else at + 1
                c[0] = at
                if at < len(c[1]):
                    tight += c[3][at // BLOCK]
            if tight >= need:
                score = sum(c[2][c[0]] for c in head if c[0] < len(c[1]) and c[1][c[0]] == item)
                if score >= need:
                    found.append((item, score))
            for c in head:
                if c[0] < len(c[1]) and c[1][c[0]] == item:
                    c[0] += 1
            cursors = [c for c in cursors if c[0] < len(c[1])]
        return found


def contaminated(words: list[str], index: Index, least: float) -> dict[int, tuple]:
    """Item number -> (score, question overlap, answer overlap, first word) of a document's verified items."""
    size = max(128, 2 * index.longest)
    step = size // 2
    found: dict[int, tuple] = {}
    essential = index.essential
    halves: dict[int, set] = {}  # essential terms of each half passage
    for i, w in enumerate(words):
        if w in essential:
            halves.setdefault(i // step, set()).add(w)
    for k in sorted({x for j in halves for x in (j - 1, j) if x >= 0} or ()):
        sums: dict[int, float] = {}
        for w in halves.get(k, set()) | halves.get(k + 1, set()):
            for item, x in essential[w]:
                sums[item] = sums.get(item, 0.0) + x
        if any(x >= index.must[item] for item, x in sums.items()):
            passage = words[k * step : k * step + size]
            for item, score in index.search(set(passage)):
                if item in found and found[item][0] >= score:
                    continue
                q, a = index.parts[item]
                x, y = overlap(q, passage), overlap(a, passage)
                if x >= least and y >= least:
                    found[item] = (score, x, y, k * step)
    return found


def corpus_of(items: DataFrame, scratch: Scratch) -> tuple[tuple[int, float, int], DataFrame]:
    """Number, mean length and longest length of all items that have words, and their distinct (item_id, text, word)."""

    def work(batches):
        import pyarrow as pa

        for b in batches:
            found = [(i, t, w, n) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (bag := Counter(item_words(t))) for w, n in bag.items()]
            columns = list(zip(*found)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["item_id", "text", "word", "n"])

    keyed = items.mapInArrow(work, "item_id long, text string, word string, n long")
    words = scratch.table(keyed, "item-words")
    # items that repeat both id and text are items of their own: their share of the words is counted as often as they come
    times = items.groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("times"))
    lengths = words.groupBy("item_id", "text").agg(F.sum("n").alias("length")).join(times, [words["item_id"].eqNullSafe(times["item_id"]), words["text"] == times["text"]])
    n, total, longest = lengths.agg(F.sum("times"), F.sum("length"), F.max(F.col("length") / F.col("times"))).first()
    return (int(n or 0), (total or 0) / max(1, n or 0), int(longest or 0)), words


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", share: float = 0.6, least: float = 0.8, max_chars: int = 16_000_000) -> DataFrame:
    """One row per (document, test item) found: doc_id, item_id, score, question_overlap, answer_overlap,
    first_word (start of the passage), text_key (a hash of the document's text).

    A passage retrieves an item if its BM25 score is at least ``share`` of the item's own; both its
    question's and its answer's shingle overlap must be at least ``least``. Null or empty texts and items
    match nothing. Null ids are carried. Repeated documents are rows of their own, repeated items too.
    Items beyond ``max_chars`` characters are split into further blocks by hash; one pass over the documents is made for
    each. Document frequencies, the mean and the longest length are those of all items, so blocks change no score.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(benchmark[item_col].cast("long").alias("item_id"), F.coalesce(benchmark[item_text_col].cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // max_chars))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias("text_key"))
    totals = words = None
    if blocks > 1:
        totals, words = corpus_of(items, Scratch(spark, "decontam"))
    out = None
    for k in range(blocks):
        part, corpus = items, None
        if blocks > 1:
            part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
            own = words.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).select("word").distinct()
            corpus = (*totals, {r["word"]: r["df"] for r in words.groupBy("word").agg(F.count(F.lit(1)).alias("df")).join(own, "word").collect()})  # words of one block
        index = spark.sparkContext.broadcast(Index([tuple(r) for r in part.collect()], share, corpus))  # about max_chars characters at most

        def work(batches, index=index):
            import pyarrow as pa

            claim("benchmark")
            ix, schema = index.value, pa.schema([(n, {"long": pa.int64(), "double": pa.float64()}[t]) for n, t in (c.split() for c in RESULT.split(", "))])
            for b in batches:
                found = []
                for doc, text, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                    for item, (score, x, y, at) in sorted(contaminated(WORD.findall(text.lower()), ix, least).items()):
                        found.append((doc, ix.ids[item], score, x, y, at, key))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*found)) or [[]] * len(schema), schema)], schema=schema)

        part_out = rows.mapInArrow(work, RESULT)
        out = part_out if out is None else out.unionByName(part_out)
    return out


def op10_decontam(spark, sf_dir):
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("score", F.round("score", 6)).drop("text_key")


def stage(spark, docs, sf_dir):
    """Pipeline stage: documents that hold a test item go, each row by its own text, so rows with null ids and repeated ids too. Null and empty
    texts stay; an empty table, or benchmark, changes nothing."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["gone_id"]) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == found["gone_key"]), "left_anti")
