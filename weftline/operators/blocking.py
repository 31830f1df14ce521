"""Candidate pairs by inverted index, exact key and dense vectors; their union, re-scoring and cap.

Pairs come from equi-joins on grams, keys or partitions, never from a product of the sides. Scores are
rounded before they are ranked and ties go to the smaller id, so results don't depend on partitioning."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .corpus import PLACES

FLAGS = ("f_name", "f_full", "f_zip", "f_rev", "f_emb")


def block_topk(posts: DataFrame, k: int, back: bool = False, size: int = 1 << 16) -> DataFrame:
    """country, src, s1, cand, sim: each S1 record's ``k`` best targets (``back``: each target's S1 records) of every block, and those as good
    as the last of them. ``posts``: country, src, side, entity_id, gram, weight.

    Both sides are cut into blocks of at most about ``size`` records. A block of one side is an inverted index in memory, by which the
    records of the other are scored one at a time, so no pair leaves the task unless it is among the best.
    """
    import numpy as np

    n = posts.groupBy("country", "src", "side").agg(F.approx_count_distinct("entity_id").alias("n"))
    sides = n.groupBy("country", "src").agg(*[F.max(F.when(F.col("side") == s, F.ceil(F.col("n") / size))).cast("int").alias(f"blocks_{s}") for s in ("s1", "target")]).dropna()
    block = lambda c: F.pmod(F.xxhash64("entity_id"), F.col(f"blocks_{c}")).cast("int")
    other = lambda c: F.sequence(F.lit(0), F.col(f"blocks_{c}") - 1)
    rows = posts.join(F.broadcast(sides), ["country", "src"]).withColumn("is_s1", F.col("side") == "s1")  # a row a country and source
    rows = rows.select("country", "src", "is_s1", "entity_id", "gram", "weight", F.when(F.col("is_s1"), block("s1")).otherwise(block("target")).alias("own"), F.explode(F.when(F.col("is_s1"), other("target")).otherwise(other("s1"))).alias("opposite"))
    rows = rows.select("country", "src", F.when(F.col("is_s1"), F.col("own")).otherwise(F.col("opposite")).alias("block_s1"), F.when(F.col("is_s1"), F.col("opposite")).otherwise(F.col("own")).alias("block_target"), "is_s1", "entity_id", "gram", "weight")

    def work(key, table):
        import pyarrow as pa
        import pyarrow.compute as pc

        def side(is_s1):
            t = table.filter(pc.equal(table["is_s1"], is_s1))
            codes = pc.index_in(t["gram"].combine_chunks(), value_set=grams).to_numpy(zero_copy_only=False)
            names = t["entity_id"].combine_chunks().dictionary_encode()
            return codes, names.indices.to_numpy(zero_copy_only=False), t["weight"].to_numpy(), names.dictionary

        grams = pc.unique(table["gram"])
        q, t = side(not back), side(back)
        a, b, sims = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(q[0]) and len(t[0]):
            order = np.argsort(t[0], kind="stable")
            list_at, list_row, list_weight = np.searchsorted(t[0][order], np.arange(len(grams) + 1)), t[1][order], t[2][order]
            order = np.argsort(q[1], kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(q[1][order])) + 1):
                lists = [slice(list_at[g], list_at[g + 1]) for g in q[0][part].tolist()]
                hits = np.concatenate([list_row[x] for x in lists])
                found = np.bincount(hits, np.concatenate([list_weight[x] * w for x, w in zip(lists, q[2][part].tolist())]), len(t[3]))
                near = np.flatnonzero(found)
                if len(near) > k:
                    near = near[found[near] >= np.partition(found[near], -k)[-k] - 2 * 10.0**-PLACES]  # ties after rounding too
                a.append(np.full(len(near), q[1][part[0]]))
                b.append(near)
                sims.append(found[near])
        a, b = q[3].take(pa.array(np.concatenate(a))), t[3].take(pa.array(np.concatenate(b)))
        m = len(a)
        s1, cand = (b, a) if back else (a, b)
        return pa.table({"country": pa.array([key[0].as_py()] * m, pa.string()), "src": pa.array([key[1].as_py()] * m, pa.string()), "s1": s1.cast(pa.string()), "cand": cand.cast(pa.string()), "sim": np.concatenate(sims)})

    found = rows.groupBy("country", "src", "block_s1", "block_target").applyInArrow(work, "country string, src string, s1 string, cand string, sim double")
    return found.withColumn("sim", F.round("sim", PLACES)).where("sim > 0")


def top_k(scores: DataFrame, by: list[str], k: int, tie: str) -> DataFrame:
    """The k best of each group; Spark limits groups before and after the shuffle."""
    order = W.partitionBy(*by).orderBy(F.desc("sim"), tie)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def forward(posts: DataFrame, k: int, classes: DataFrame | None = None) -> DataFrame:
    """``classes``: those of ``alike``, by which many equal records are scored once."""
    return top_k(block_topk(posts, k), ["src", "s1"], k, "cand") if classes is None else class_topk(posts, classes, k)


def reverse(posts: DataFrame, k: int = 3, above: float = 0.2, classes: DataFrame | None = None) -> DataFrame:
    """Each target's k best S1 records with a score strictly above ``above``."""
    best = top_k(block_topk(posts, k, back=True), ["src", "cand"], k, "s1") if classes is None else class_topk(posts, classes, k, back=True)
    return best.where(F.col("sim") > above)


def alike(posts: DataFrame, keep: Callable) -> DataFrame:
    """country, src, side, entity_id, rep, place: records of a side with equal vectors are a class; ``rep`` is its smallest id and ``place``
    counts its ids from 1. Vectors are equal if 128 bits of hash are, of weights that differ by more than a sum's rounding."""
    weight = F.rint(F.col("weight") * 1e12)
    vectors = posts.groupBy("country", "src", "side", "entity_id").agg(F.bit_xor(F.xxhash64("gram", weight)).alias("a"), F.bit_xor(F.xxhash64(weight, "gram")).alias("b"))
    ids = W.partitionBy("country", "src", "side", "a", "b").orderBy("entity_id")
    return keep(vectors.select("country", "src", "side", "entity_id", F.first("entity_id").over(ids).alias("rep"), F.row_number().over(ids).alias("place")), "alike")


def class_topk(posts: DataFrame, classes: DataFrame, k: int, back: bool = False) -> DataFrame:
    """``forward``, or ``reverse`` without its bound, by a score for each two classes of ``alike`` instead of each two records. A record's
    ``k`` best are among the ``k`` smallest ids of each of the best classes, and those of a class's records are the same."""
    one, two = ("cand", "s1") if back else ("s1", "cand")
    side = {"s1": "s1", "cand": "target"}
    found = block_topk(posts.join(classes.where("place = 1"), ["country", "src", "side", "entity_id"], "left_semi"), k, back)
    ids = lambda c: classes.where(F.col("side") == side[c]).select("country", "src", F.col("rep").alias(c), F.col("entity_id").alias("_id"), "place")
    best = found.join(ids(two).where(F.col("place") <= k), ["country", "src", two]).select("country", "src", one, F.col("_id").alias(two), "sim")
    best = top_k(best, ["country", "src", one], k, two).drop("rank").join(ids(one), ["country", "src", one])
    return top_k(best.select("country", "src", F.col("_id").alias(one), two, "sim").select("country", "src", "s1", "cand", "sim"), ["src", one], k, two)


def key_block(records: DataFrame, most: int | None = 50) -> DataFrame:
    """country, src, s1, cand with equal postal code and first core token; S1 buckets of 1 to ``most`` rows, or (None) of any size."""
    keyed = records.where("postal <> '' AND core_first <> ''")
    key = ["country", "postal", "core_first"]
    s1 = keyed.where("src = 'S1'")
    if most is not None:
        s1 = s1.join(s1.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most).drop("n"), key, "left_semi")
    s1 = s1.select(*key, F.col("entity_id").alias("s1"))
    return keyed.where("src <> 'S1'").select(*key, "src", F.col("entity_id").alias("cand")).join(s1, key).select("country", "src", "s1", "cand")


def dense_scores(vectors: DataFrame, k: int, above: float, back: bool = False, size: int = 1 << 16, cells: int = 1 << 22) -> DataFrame:
    """Exact cosine of unit vectors within a partition: the ``k`` best targets of each query (``back``: queries of each target) in every block
    and those as good as the last. ``vectors``: part, side ('q' or 't'), id, vec.

    Each side is cut into blocks of about ``size`` rows and a block of queries meets a block of targets in matrix products of at
    most ``cells`` cosines, so what is shuffled are blocks, a copy for each block of the other side, what is held are two of them,
    and what comes out are the best pairs. The sides' sizes, a row a partition, are broadcast: joined by a shuffle, all squares of a partition would stay in one task.
    """
    import numpy as np

    n = vectors.groupBy("part", "side").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("blocks"))
    sides = n.groupBy("part").agg(*[F.max(F.when(F.col("side") == s, F.col("blocks"))).alias(s) for s in "qt"]).dropna()
    both = vectors.join(F.broadcast(sides), "part").withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("side") == "q", F.col("q")).otherwise(F.col("t"))).cast("int"))
    other = F.sequence(F.lit(0), F.when(F.col("side") == "q", F.col("t")).otherwise(F.col("q")) - 1)
    dealt = both.select("part", "side", "id", "vec", "own", F.explode(other).alias("other"))
    dealt = dealt.select("part", F.when(F.col("side") == "q", F.col("own")).otherwise(F.col("other")).alias("bq"), F.when(F.col("side") == "q", F.col("other")).otherwise(F.col("own")).alias("bt"), "side", "id", "vec")

    def work(key, pdf):
        import pandas as pd

        q, t = (pdf[pdf["side"] == s].sort_values("id") for s in "qt")
        if not len(q) or not len(t):
            return pd.DataFrame({"part": [], "q": [], "t": [], "sim": []})
        one, two = (t, q) if back else (q, t)
        x, y = (np.stack(z["vec"].to_numpy()).astype("float64") for z in (one, two))
        i, j, best = [], [], []
        for at in range(0, len(x), max(1, cells // len(y))):
            sims = x[at : at + max(1, cells // len(y))] @ y.T
            least = np.full((1, 1), above - 1e-6)
            if len(y) > k:
                least = np.maximum(least, np.partition(sims, -k, 1)[:, [-k]] - 2 * 10.0**-PLACES)
            a, b = np.nonzero(sims >= least)
            i.append(a + at)
            j.append(b)
            best.append(sims[a, b])
        i, j = np.concatenate(i), np.concatenate(j)
        if back:
            i, j = j, i
        return pd.DataFrame({"part": str(key[0]), "q": q["id"].to_numpy()[i], "t": t["id"].to_numpy()[j], "sim": np.concatenate(best)})

    found = dealt.groupBy("part", "bq", "bt").applyInPandas(work, "part string, q string, t string, sim double")
    return found.withColumn("sim", F.round("sim", PLACES)).where(F.col("sim") >= above)


def dense_topk(vectors: DataFrame, k: int = 15, above: float = 0.75, back: bool = False) -> DataFrame:
    """The k best targets of each query with at least ``above``, or (``back``) queries of each target."""
    one, two = ("t", "q") if back else ("q", "t")
    order = W.partitionBy("part", one).orderBy(F.desc("sim"), two)
    return dense_scores(vectors, k, above, back).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def union_candidates(found: dict[str, DataFrame]) -> DataFrame:
    """country, s1, cand and a 0/1 column for each blocker. ``found``: flag -> (country, s1, cand)."""
    parts = [d.select("country", "s1", "cand", F.lit(f).alias("flag")) for f, d in found.items()]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("country", "s1", "cand").agg(*[F.max((F.col("flag") == f).cast("int")).alias(f) for f in FLAGS])


def as_is(df: DataFrame, name: str) -> DataFrame:
    return df


def rescore(candidates: DataFrame, posts: dict[str, DataFrame], keep: Callable = as_is) -> DataFrame:
    """Every candidate gets each view's score, 0 where no kept gram is shared. ``posts``: column -> postings of that view; ``keep``: see
    ``generate_candidates``."""
    for name, p in posts.items():
        vector = F.map_from_entries(F.collect_list(F.struct("gram", "weight")))  # the kept grams of one record
        a = p.where("side = 's1'").groupBy("src", F.col("entity_id").alias("s1")).agg(vector.alias("_a"))
        b = p.where("side = 'target'").groupBy("src", F.col("entity_id").alias("cand")).agg(F.collect_list(F.struct("gram", "weight")).alias("_b"))
        pairs = candidates.select("s1", "cand").distinct().join(b, "cand").join(a, ["src", "s1"])
        dot = F.aggregate("_b", F.lit(0.0), lambda acc, x: acc + x["weight"] * F.coalesce(F.element_at("_a", x["gram"]), F.lit(0.0)))
        scored = pairs.select("s1", "cand", F.round(dot, PLACES).alias(name))
        candidates = keep(candidates.join(scored, ["s1", "cand"], "left").withColumn(name, F.coalesce(name, F.lit(0.0))), name)
    return candidates


def cap_candidates(candidates: DataFrame, most: int | None = 50) -> DataFrame:
    """The ``most`` best of an S1 record over both targets, or (None) all; cos_emb is null where unknown, and 0 afterwards."""
    if most is None:
        return candidates.withColumn("cos_emb", F.coalesce("cos_emb", F.lit(0.0)))
    s = F.round(F.greatest("cos_name", "cos_full", "cos_emb") + 0.05 * F.col("f_zip"), PLACES)
    ranked = candidates.withColumn("_r", F.row_number().over(W.partitionBy("s1").orderBy(s.desc(), "cand")))
    return ranked.where(F.col("_r") <= most).drop("_r").withColumn("cos_emb", F.coalesce("cos_emb", F.lit(0.0)))


def generate_candidates(records: DataFrame, name_posts: DataFrame, full_posts: DataFrame, dense: DataFrame | None = None, k_name: int = 10, k_full: int = 10, k_rev: int = 3, most: int | None = 50, keep: Callable = as_is, most_key: int | None = 50, classes: bool = False) -> DataFrame:
    """All blockers, their union, exact scores and the cap. ``dense``: country, s1, cand, cos_emb. ``keep``: writes a table under a name
    and reads it back, so that each blocker and each score is a plan of its own, and the driver never holds one plan of them all. ``most_key``: see ``key_block``;
    ``classes``: names go by ``class_topk``."""
    pairs = lambda d, name: keep(d.select("country", "s1", "cand"), name)
    same = alike(name_posts, keep) if classes else None
    back = pairs(reverse(name_posts, k_rev, classes=same), "rev_name").unionByName(pairs(reverse(full_posts, k_rev), "rev_full"))
    found = {"f_name": pairs(forward(name_posts, k_name, same), "f_name"), "f_full": pairs(forward(full_posts, k_full), "f_full"), "f_rev": back, "f_zip": pairs(key_block(records, most_key), "f_zip")}
    if dense is not None:
        found["f_emb"] = dense = keep(dense.select("country", "s1", "cand", "cos_emb"), "f_emb")
    c = rescore(keep(union_candidates(found), "union"), {"cos_name": name_posts, "cos_full": full_posts}, keep)
    if dense is not None:
        c = c.join(dense.groupBy("s1", "cand").agg(F.max("cos_emb").alias("cos_emb")), ["s1", "cand"], "left")
    else:
        c = c.withColumn("cos_emb", F.lit(None).cast("double"))
    return cap_candidates(c, most)
