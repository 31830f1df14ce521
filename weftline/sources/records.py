"""Delimited sources and sinks: all strings, no quoting, an empty field is an empty string."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "entity_id string, business_name string, business_address string, country string"


def read_tsv(spark: SparkSession, path: str, schema: str = RECORD, order: str | None = None) -> DataFrame:
    """The file's rows; ``order`` names a column by which they sort as in the file."""
    rows = _scan(spark, path, schema)
    if order is None:
        return rows.fillna("")
    names = rows.columns
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return rows.select(*names, place.alias(order)).fillna("", names)


def _scan(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).options(sep="\t", header=True, quote="", escape="", nullValue="\u0000").csv(path)


def scan_integrity(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """One row: non-blank data lines, parsed rows, and whether they agree."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"\S")).agg((F.count(F.lit(1)) - 1).alias("lines"))
    rows = read_tsv(spark, path, schema).agg(F.count(F.lit(1)).alias("rows"))
    return lines.crossJoin(rows).withColumn("ok", F.col("lines") == F.col("rows"))  # one row each


def load_split(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """The three sources of a split in one, each with its tag."""
    out = None
    for k in (1, 2, 3):
        part = read_tsv(spark, f"{folder}/{split}/{split}_source{k}.tsv", order=ORDER).withColumn("src", F.lit(f"S{k}"))
        out = part if out is None else out.unionByName(part)
    return out


def explode_gold(gold: DataFrame) -> DataFrame:
    """(s1, cand), one row a true pair. ``gold``: source1_entity_id, matched_entity_ids (comma list)."""
    ids = F.array_distinct(F.filter(F.split("matched_entity_ids", ","), lambda x: x != ""))
    return gold.select(F.col("source1_entity_id").alias("s1"), F.explode(ids).alias("cand")).distinct()


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, "source1_entity_id string, matched_entity_ids string")


def read_pair_scores(spark: SparkSession, path: str, score: str) -> DataFrame:
    """(s1, cand, score) with the largest score of a repeated pair."""
    rows = read_tsv(spark, path, f"source1_entity_id string, candidate_entity_id string, {score} string")
    return rows.groupBy(F.col("source1_entity_id").alias("s1"), F.col("candidate_entity_id").alias("cand")).agg(F.max(F.expr(f"try_cast({score} AS double)")).alias(score))


def map_pair_scores(scores: DataFrame, records: DataFrame, score: str = "cos_emb") -> DataFrame:
    """Pairs whose ends are an S1 record and an S2 or S3 record of the same country."""
    s1 = records.where("src = 'S1'").select(F.col("entity_id").alias("s1"), F.col("country"))
    tg = records.where("src <> 'S1'").select(F.col("entity_id").alias("cand"), F.col("country").alias("cand_country"))
    joined = scores.join(s1, "s1").join(tg, "cand").where("country = cand_country")
    return joined.groupBy("s1", "cand").agg(F.greatest(F.max(score), F.lit(-1.0)).alias(score))


def id_lists(s1_ids: DataFrame, pairs: DataFrame, column: str) -> DataFrame:
    """One row for every S1 id: its candidates by p, best first, comma-joined. ``pairs``: s1, cand, p."""
    best = pairs.groupBy("s1", "cand").agg(F.max("p").alias("p"))
    lists = best.groupBy("s1").agg(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("o"), "cand"))).alias("l"))  # capped candidates of one S1
    text = F.coalesce(F.array_join(F.col("l.cand"), ","), F.lit(""))
    keep = [c for c in (ORDER,) if c in s1_ids.columns]
    return s1_ids.select("s1", *keep).join(lists, "s1", "left").select(F.col("s1").alias("source1_entity_id"), text.alias(column), *keep)


#: The column by which id lists sort as the S1 file does; it is not written.
ORDER = "_order"


def write_tsv(df: DataFrame, path: str) -> None:
    """A folder of parts, each with the header."""
    df.write.mode("overwrite").options(sep="\t", header=True, quote="", escape="", emptyValue="").csv(path)


def write_tsv_file(df: DataFrame, path: str) -> None:
    """One file: parts written by all tasks, in the order of ``ORDER`` if ``df`` has it, joined by copying their bytes one after the other."""
    spark, parts = df.sparkSession, f"{path}.parts"
    if ORDER in df.columns:
        df = df.repartitionByRange(ORDER).sortWithinPartitions(ORDER).drop(ORDER)
    df.write.mode("overwrite").options(sep="\t", header=False, quote="", escape="", emptyValue="").csv(parts)
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    folder = hadoop.fs.Path(parts)
    fs = folder.getFileSystem(conf)
    out = fs.create(hadoop.fs.Path(path), True)
    try:
        out.write(bytearray(("\t".join(df.columns) + "\n").encode()))
        for name in sorted(f.getPath().toString() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")):
            part = fs.open(hadoop.fs.Path(name))
            try:
                hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            finally:
                part.close()
    finally:
        out.close()
    fs.delete(folder, True)


def scores_table(pairs: DataFrame, score: str) -> DataFrame:
    """Pairs under the header of score files, the largest of a repeated pair: source1_entity_id, candidate_entity_id and the score."""
    best = pairs.groupBy("s1", "cand").agg(F.max(score).alias(score))
    return best.select(F.col("s1").alias("source1_entity_id"), F.col("cand").alias("candidate_entity_id"), F.col(score))


def embedding_table(pairs: DataFrame) -> DataFrame:
    """Dense candidates as they are written: the largest cosine of a repeated pair with four decimals."""
    return scores_table(pairs, "cos_emb").withColumn("cos_emb", F.format_string("%.4f", F.round("cos_emb", 4)))


def output_violations(predictions: DataFrame, candidates: DataFrame, records: DataFrame) -> DataFrame:
    """One row: predicted ids that are no S2 or S3 record, predictions that are no candidates."""
    targets = records.where("src <> 'S1'").select(F.col("entity_id").alias("cand")).distinct()
    a = predictions.join(targets, "cand", "left_anti").agg(F.count(F.lit(1)).alias("unknown_ids"))
    b = predictions.join(candidates.select("s1", "cand"), ["s1", "cand"], "left_anti").agg(F.count(F.lit(1)).alias("not_candidates"))
    return a.crossJoin(b)  # one row each
