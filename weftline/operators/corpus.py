"""Statistics of the records being scored: token rarity and weighted character trigrams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import entity_text

MAX_DOC_FREQ = 5000
PLACES = 6


def token_idf(records: DataFrame) -> DataFrame:
    """country, kind, token, idf: ln((n + 1) / (df + 1)) + 1 over all records of the country."""
    n = records.groupBy("country").agg(F.count(F.lit(1)).alias("n"))
    parts = [records.select("country", F.lit(kind).alias("kind"), F.explode(col).alias("token")) for kind, col in (("name", "core_set"), ("addr", "addr_set"))]
    df = parts[0].unionByName(parts[1]).groupBy("country", "kind", "token").agg(F.count(F.lit(1)).alias("df"))
    return df.join(n, "country").select("country", "kind", "token", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def default_idf(records: DataFrame) -> DataFrame:
    """country, default_idf: the weight of a token no record has."""
    return records.groupBy("country").agg((F.log(F.count(F.lit(1)) + 1.0) + 1).alias("default_idf"))


def trigrams(text):
    """Character trigrams of each word with one blank on either side; a one-letter word gives one."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    return F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.substring(F.concat(F.lit(" "), w, F.lit(" ")), i, F.lit(3)))))


def postings(records: DataFrame, view: str, max_doc_freq: int | None = MAX_DOC_FREQ) -> DataFrame:
    """country, src (of the targets), side, entity_id, gram, weight.

    Sublinear counts times smooth idf, rows of unit length; idf is over the S1 and target records of a
    (country, src), so S1 rows weigh differently against S2 and S3. Grams of more than ``max_doc_freq``
    records go after the lengths are set, which makes later dot products truncated cosines.
    """
    text = records.select("country", F.col("src").alias("own"), "entity_id", F.explode(trigrams(entity_text(view))).alias("gram"))
    tf = text.groupBy("country", "own", "entity_id", "gram").agg((1 + F.log(F.count(F.lit(1)).cast("double"))).alias("tf"))
    srcs = F.when(F.col("own") == "S1", F.array(F.lit("S2"), F.lit("S3"))).otherwise(F.array("own"))
    sides = tf.select("country", F.explode(srcs).alias("src"), F.when(F.col("own") == "S1", "s1").otherwise("target").alias("side"), "entity_id", "gram", "tf")
    size = records.groupBy("country").agg(*[F.sum(F.col("src").isin("S1", s).cast("long")).alias(s) for s in ("S2", "S3")]).select("country", F.explode(F.map_from_arrays(F.array(F.lit("S2"), F.lit("S3")), F.array("S2", "S3"))).alias("src", "n"))
    df = sides.groupBy("country", "src", "gram").agg(F.count(F.lit(1)).alias("df")).join(size, ["country", "src"])
    weighted = sides.join(df, ["country", "src", "gram"]).withColumn("w", F.col("tf") * (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1))
    norm = weighted.groupBy("country", "src", "side", "entity_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    out = weighted.join(norm, ["country", "src", "side", "entity_id"])
    if max_doc_freq is not None:
        out = out.where(F.col("df") <= max_doc_freq)
    return out.select("country", "src", "side", "entity_id", "gram", (F.col("w") / F.col("len")).alias("weight"))


def name_frequency(records: DataFrame) -> DataFrame:
    """country, name_core, s1_name_freq over S1 records."""
    return records.where("src = 'S1'").groupBy("country", "name_core").agg(F.count(F.lit(1)).alias("s1_name_freq"))


def load_summary(records: DataFrame) -> DataFrame:
    return records.groupBy("src", "country").agg(F.count(F.lit(1)).alias("n"))
