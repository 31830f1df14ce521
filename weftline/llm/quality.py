"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

Evidence: for each target (low quality, toxic) word weights and a logistic model over shape features and
word-weight sums are fitted on a bounded sample of labelled documents. Every document then gets an
evidence logit. Hierarchy: the documents' probabilities are summed by host (``source``) and by path
below it (``lang``) in grouped aggregation over all rows. A beta prior fitted to the hosts' means by
moments shrinks sparse hosts toward the global rate, and each path shrinks toward its host with the
same strength. What the path's posterior differs in log odds from the global rate is added to the
document's evidence. Its own evidence is taken out of the sums first, so that it does not count twice."""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, claim, small_batches, table

SAMPLE = 8_000  # labelled documents at most
VOCABULARY = 4_000  # words with a weight, at most
WEIGHT = 1.0  # of a site's log odds
TARGETS = ("junk", "toxic")
_WORD = re.compile(r"[^\W\d_]+")
SCORES = "doc_id long, row_key long, host string, path string, junk double, toxic double"


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shape(text: str, w: list[str]) -> list[float]:
    """Features that hold for any language; all are finite for an empty text."""
    n, k = max(1, len(text)), max(1, len(w))
    symbols = sum(map(text.count, "#$%&*!|@~^<>{}[]=\\"))
    lines = text.split("\n")
    return [
        symbols / n * 10,
        min(1.0, symbols / k),
        text.count("|") / n * 20,
        text.count("!") / n * 20,
        sum(c.isupper() for c in text) / n * 3,
        sum(c.isdigit() for c in text) / n * 5,
        text.count(".") / k,
        text.count(",") / k,
        len(set(w)) / k,
        sum(map(len, w)) / k / 10,
        math.log1p(len(w)) / 10,
        len(set(lines)) / len(lines),
        float(not w),
    ]


def evidence(base: list[float], distinct, n: int, weights: dict[str, tuple[float, float]]) -> tuple[list[float], ...]:
    """Feature vectors for the targets: shape, then the sum, maximum and rate of the distinct words' weights. ``n``: words in all."""
    found = [weights[x] for x in weights.keys() & distinct]
    out = []
    for t in range(len(TARGETS)):
        v = [f[t] for f in found if f[t] > 0]
        s = sum(v)
        out.append([*base, min(s, 30.0) / 5, max(v, default=0.0) / 3, min(len(v), 20) / 5, s / math.sqrt(max(1, n)), 1.0])
    return tuple(out)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps on standardised features."""
    mean, dev = x.mean(0), x.std(0)
    mean, dev = np.where(dev < 1e-9, 0.0, mean), np.where(dev < 1e-9, 1.0, dev)
    z, b = (x - mean) / dev, np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (p - y) + ridge * b
        h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + ridge * np.eye(len(b))
        d = np.linalg.solve(h, g)
        b -= np.clip(d, -3, 3)
        if np.abs(d).max() < 1e-6:
            break
    return b, mean, dev


class Model:
    """Word weights and one logistic model a target."""

    def __init__(self, rows: list[tuple[tuple, int, int]]):
        """``rows``: ((shape, distinct words joined by blanks, words in all), junk, toxic), at most SAMPLE of them. The even rows (by place) weight words,
        the odd ones fit the models, so that words seen once don't count twice."""
        self.weights: dict[str, tuple[float, float]] = {}
        count: dict[str, list[int]] = {}
        totals = [0, [0, 0]]
        for (_, distinct, _), *y in rows[::2]:
            totals[0] += 1
            totals[1][0] += y[0]
            totals[1][1] += y[1]
            for x in distinct.split():
                c = count.setdefault(x, [0, 0, 0])
                c[0] += 1
                c[1] += y[0]
                c[2] += y[1]
        n = totals[0]
        scored = []
        for x, c in count.items():
            if c[0] < 3:
                continue
            w = []
            for t in (0, 1):
                pos, neg = totals[1][t], n - totals[1][t]
                a, b = c[1 + t], c[0] - c[1 + t]
                lo = math.log((a + 0.2) / (pos + 1)) - math.log((b + 0.2) / (neg + 1))
                se = math.sqrt(1 / (a + 0.2) + 1 / (b + 0.2))
                w.append(lo if lo > 1.5 and lo > 2 * min(se, 0.9) and a >= 3 else 0.0)
            if any(w):
                scored.append((max(w) * math.log1p(c[0]), x, tuple(w)))
        self.weights = {x: w for _, x, w in sorted(scored, reverse=True)[:VOCABULARY]}
        self.fits = []
        fit = [evidence(base, set(distinct.split()), k, self.weights) for (base, distinct, k), *_ in rows[1::2]]
        for t in range(len(TARGETS)):
            y = np.array([r[1 + t] for r in rows[1::2]], float)
            if len(fit) < 10 or y.min() == y.max():  # nothing to learn from: the rate alone
                rate = (y.sum() + 0.5) / (len(y) + 1)
                self.fits.append((math.log(rate / (1 - rate)), None))
            else:
                self.fits.append((None, _logistic(np.array([f[t] for f in fit]), y)))

    def logits(self, text: str) -> list[float]:
        out, w = [], words(text)
        for x, (rate, fit) in zip(evidence(shape(text, w), set(w), len(w), self.weights), self.fits):
            if fit is None:
                out.append(rate)
            else:
                b, mean, dev = fit
                out.append(float(np.clip(((np.array(x) - mean) / dev) @ b, -30, 30)))
        return out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, words_each: int = 5_000) -> Model:
    """Fit on ``sample`` labelled documents, those of least id hash. Of an id that several rows hold the longest text counts
    (of equally long ones the greatest). What comes to the driver of a text is its shape and its distinct words, at most ``words_each`` of
    them, those of least hash; so texts of any length take part."""
    spark = docs.sparkSession
    picked = labels.select(F.col("doc_id").cast("long").alias("picked_id"), (F.col("quality") == 0).cast("int").alias("y_junk"), F.col("toxic").cast("int").alias("y_toxic")).dropna()
    picked = picked.groupBy("picked_id").agg(F.max("y_junk").alias("y_junk"), F.max("y_toxic").alias("y_toxic")).orderBy(F.xxhash64("picked_id"), "picked_id").limit(sample)
    picked = spark.createDataFrame(picked.collect(), "picked_id long, y_junk int, y_toxic int")  # at most ``sample`` rows
    rows = docs.select(F.col("doc_id").cast("long").alias("picked_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(picked), "picked_id")
    rows = rows.groupBy("picked_id", "y_junk", "y_toxic").agg(F.max(F.struct(F.length("text"), "text")).alias("t")).select("picked_id", "y_junk", "y_toxic", F.col("t.text").alias("text"))

    def work(batches):
        import pyarrow as pa
        import xxhash

        for b in batches:
            shapes, found, counts = [], [], []
            for text in b.column(3).to_pylist():
                w = words(text)
                distinct = sorted(set(w), key=lambda x: (xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")), x))[:words_each]
                shapes.append(shape(text, w))
                found.append(" ".join(distinct))
                counts.append(len(w))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(shapes, pa.list_(pa.float64())), pa.array(found, pa.string()), pa.array(counts, pa.int64())], names=["picked_id", "y_junk", "y_toxic", "shape", "words", "n"])

    found = rows.mapInArrow(work, "picked_id long, y_junk int, y_toxic int, shape array<double>, words string, n long").collect()
    found.sort(key=lambda r: (hash_of(r["picked_id"]), r["picked_id"]))
    return Model([((r["shape"], r["words"], r["n"]), r["y_junk"], r["y_toxic"]) for r in found])


def hash_of(x: int) -> int:
    return (x * 0x9E3779B97F4A7C15 >> 7) & 0xFFFFFFFF


def score(docs: DataFrame, model: Model, host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """Evidence logits of every document."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        import pyarrow as pa

        claim("quality")
        m = held.value
        for b in batches:
            found = [m.logits(t) for t in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64())], names=[c.split()[0] for c in SCORES.split(", ")])

    host, path, text = parts_of(docs, host_col, path_col)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), row_key(docs, host_col, path_col).alias("row_key"), host.alias("host"), path.alias("path"), text.alias("text")).mapInArrow(work, SCORES)


def parts_of(docs: DataFrame, host_col: str, path_col: str) -> list[Column]:
    return [F.coalesce(docs[c].cast("string"), F.lit("")) if c in docs.columns else F.lit("") for c in (host_col, path_col, "text")]


def row_key(docs: DataFrame, host_col: str = "source", path_col: str = "lang") -> Column:
    """A hash of what a row is judged by."""
    return F.xxhash64(*parts_of(docs, host_col, path_col))


def probability(t: str) -> Column:
    return 1 / (1 + F.exp(-F.col(t)))


def sites(scores: DataFrame) -> DataFrame:
    """host, path, and for each target the sums of probabilities by path and host, the global rate and the strength of the prior fitted to
    the hosts' rates by moments. Sums meet map-side, so a hot host is one row a task."""
    paths = scores.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), *[F.sum(probability(t)).alias(f"path_{t}") for t in TARGETS])
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), *[F.sum(f"path_{t}").alias(f"host_{t}") for t in TARGETS])
    # moments over hosts: mean rate m, variance v between hosts less what sampling explains
    moments = hosts.agg(F.sum("host_n").alias("n_all"), F.avg(1 / F.col("host_n")).alias("inv"), *[F.sum(f"host_{t}").alias(f"all_{t}") for t in TARGETS], *[F.coalesce(F.var_pop(F.col(f"host_{t}") / F.col("host_n")), F.lit(0.0)).alias(f"var_{t}") for t in TARGETS])
    out = paths.join(hosts, "host").crossJoin(F.broadcast(moments))  # moments: one row
    for t in TARGETS:
        m = (F.col(f"all_{t}") + 0.5) / (F.col("n_all") + 1)
        v = F.greatest(F.col(f"var_{t}") - m * (1 - m) * F.col("inv"), F.lit(1e-5))
        out = out.withColumns({f"rate_{t}": m, f"strength_{t}": F.greatest(m * (1 - m) / v - 1, F.lit(2.0))})
    return out.select("host", "path", "n", "host_n", *[f"{x}_{t}" for x in ("path", "host", "rate", "strength") for t in TARGETS])


def shift(t: str) -> Column:
    """Log odds that a document's site adds to its evidence: the path's posterior, shrunk to its host's, which is shrunk to the
    global rate, both without the document itself, against the global rate."""
    m, k, own = F.col(f"rate_{t}"), F.col(f"strength_{t}"), probability(t)
    host = (F.greatest(F.col(f"host_{t}") - own, F.lit(0.0)) + k * m) / (F.col("host_n") - 1 + k)
    path = (F.greatest(F.col(f"path_{t}") - own, F.lit(0.0)) + k * host) / (F.col("n") - 1 + k)
    return F.log(path / (1 - path)) - F.log(m / (1 - m))


def classify(docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", sample: int = SAMPLE, threshold: float = 0.5, weight: float = WEIGHT) -> DataFrame:
    """One row per document: doc_id, row_key (a hash of host, path and text), host, path, p_junk, p_toxic, keep.

    A document is rejected if either probability reaches ``threshold``; ``weight`` is the share of the site's log odds that
    counts. Null text counts as empty, null host or path as ''. Without usable labels every document gets the smoothed rate
    of one half and the decision to keep. Repeated rows are scored each. Null ids are carried. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    model = train(docs, labels, sample)
    scores = scratch.table(score(docs, model, host_col, path_col), "scores")
    joined = scores.join(scratch.table(sites(scores), "sites"), ["host", "path"], "left")
    p = {t: 1 / (1 + F.exp(-(F.col(t) + weight * shift(t)))) for t in TARGETS}
    reject = F.lit(False)
    for t, (_, fit) in zip(TARGETS, model.fits):
        if fit is not None:
            reject = reject | (p[t] >= threshold)
    return joined.select("doc_id", "row_key", "host", "path", *[p[t].alias(f"p_{t}") for t in TARGETS], (~reject).alias("keep"))


def op3_quality(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("row_key")


def stage(spark, docs, sf_dir):
    """Pipeline stage: documents that the classifier rejects go. Each row is judged by its own text: repeated ids with other texts and rows
    with null ids too; a null text counts as empty; an empty table stays empty. Columns may have any names."""
    gone = classify(docs, table(spark, sf_dir, "labels")).where("NOT keep").select(F.col("doc_id").alias("gone_id"), F.col("row_key").alias("gone_key")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & (row_key(docs) == gone["gone_key"]), "left_anti")
