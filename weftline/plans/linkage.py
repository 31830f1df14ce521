"""The whole linkage as one plan, with tables written where they are read twice or more."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import normalize_records
from ..operators import blocking, corpus, decide, evaluate, features, model
from ..sources import records as io


@dataclass(frozen=True)
class Options:
    k_name: int = 10
    k_full: int = 10
    k_rev: int = 3
    max_cands: int = 50
    max_doc_freq: int = 5000
    folds: int = 5
    rounds: int = 60


def release(spark: SparkSession) -> str:
    """Give free memory of the driver's JVM outside its heap back to the machine; gives what the JVM says. What its compilers, codecs and
    threads have freed stays in the C library's arenas, and grows with each plan. A JVM without that command goes without."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    named, args, values = jvm.java.lang.Class.forName, gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
    for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        args[i] = named(name)
    values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        return named("javax.management.MBeanServer").getMethod("invoke", args).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JJavaError:
        return ""


class Workspace:
    """Written intermediate tables: every executor reads them again, and lost ones are not recomputed."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        import tempfile

        root = root or spark.conf.get("spark.checkpoint.dir", None)
        if root is None:
            master = spark.sparkContext.master
            root = tempfile.mkdtemp(prefix="weftline-") if master == "local" or master.startswith("local[") else spark.conf.get("spark.sql.warehouse.dir")
        self.spark, self.root = spark, f"{root.rstrip('/')}/linkage-{uuid.uuid4().hex[:12]}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        release(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def keeper(self, tag: str) -> Callable:
        """``keep`` under names that start with ``tag``."""
        return lambda df, name: self.keep(df, f"{tag}-{name}")


def prepare(raw: DataFrame, ws: Workspace, o: Options = Options(), tag: str = "train", dense: DataFrame | None = None, probs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, features) of one split; all statistics are fitted on that split."""
    recs = ws.keep(normalize_records(raw), f"{tag}-records")
    posts = {v: ws.keep(corpus.postings(recs, v, o.max_doc_freq), f"{tag}-postings-{v}") for v in ("name", "full")}
    if dense is not None:
        s1 = recs.selectExpr("entity_id AS s1", "country")
        dense = io.map_pair_scores(dense, recs).join(s1, "s1")
    cands = ws.keep(blocking.generate_candidates(recs, posts["name"], posts["full"], dense, o.k_name, o.k_full, o.k_rev, o.max_cands, ws.keeper(f"{tag}-blocks")), f"{tag}-candidates")
    feats = features.build_features(cands, recs, corpus.token_idf(recs), corpus.default_idf(recs), corpus.name_frequency(recs), ws.keeper(f"{tag}-parts"))
    if probs is not None:
        feats = features.attach_pair_probabilities(feats, probs)
    return recs, ws.keep(feats, f"{tag}-features")


def cross_validate(raw: DataFrame, gold: DataFrame, ws: Workspace, o: Options = Options(), **inputs):
    """Out-of-fold scores, the decision that suits them, and reports."""
    recs, feats = prepare(raw, ws, o, **inputs)
    names = model.FEATURES + (["p_xenc", "p_xenc_present"] if "p_xenc" in feats.columns else [])
    rows = ws.keep(model.assemble(model.folds(model.label(feats, gold), o.folds), names).select("s1", "cand", "country", "y", "fold", "features"), "rows")
    oof, _, models = model.out_of_fold(rows, o.folds, rounds=o.rounds)
    oof = ws.keep(oof, "oof")
    s1 = s1_ids(recs).select("s1", "country")
    decision = decide.search_decisions(oof, gold, s1)
    preds = ws.keep(decide.run_decision(oof, decision), "predictions")
    return {"decision": decision, "models": models, "names": names, "oof": oof, "predictions": preds, "report": evaluate.score_report(preds, gold, s1), "recall": evaluate.blocking_recall(feats, gold), "ceiling": evaluate.ceiling(feats, gold, s1), "rows": rows, "features": feats, "s1": s1}


def s1_ids(recs: DataFrame) -> DataFrame:
    """s1, country of the S1 records, and their order in the file where it is known."""
    return recs.where("src = 'S1'").select(F.col("entity_id").alias("s1"), "country", *[c for c in (io.ORDER,) if c in recs.columns])


def full(raw_train: DataFrame, gold: DataFrame, raw_test: DataFrame, out: str, ws: Workspace, o: Options = Options(), train_inputs: dict | None = None, test_inputs: dict | None = None):
    """Train, score the test split by the fold models' mean, decide and write both id-list files and both score dumps. ``train_inputs``,
    ``test_inputs``: each split's dense candidates and pair probabilities (see ``prepare``), where there are any."""
    cv = cross_validate(raw_train, gold, ws, o, **(train_inputs or {}))
    recs, feats = prepare(raw_test, ws, o, tag="test", **(test_inputs or {}))
    if "p_xenc" in cv["names"] and "p_xenc" not in feats.columns:
        feats = features.attach_pair_probabilities(feats, feats.select("s1", "cand", F.lit(None).cast("double").alias("p_xenc")).limit(0))
    parts = [model.predict(m, model.assemble(feats, cv["names"])) for m in cv["models"]]
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    scored = ws.keep(scored.groupBy("s1", "cand").agg({"p": "avg"}).withColumnRenamed("avg(p)", "p"), "test-scores")
    preds = ws.keep(decide.run_decision(scored, cv["decision"]), "test-predictions")
    bad = io.output_violations(preds, scored, recs).first()
    if bad["unknown_ids"] or bad["not_candidates"]:
        raise ValueError(f"predictions break the output's rules: {bad}")
    s1 = s1_ids(recs)
    io.write_tsv_file(io.id_lists(s1, scored, "candidate_entity_ids"), f"{out}/candidate_pairs.tsv")
    io.write_tsv_file(io.id_lists(s1, preds, "matched_entity_ids"), f"{out}/matching_results.tsv")
    io.write_tsv_file(cv["oof"].select("s1", "cand", "p"), f"{out}/oof_train.tsv")
    io.write_tsv_file(scored.select("s1", "cand", "p"), f"{out}/test_scores.tsv")
    return evaluate.match_rate(preds, s1)


def outside_inputs(spark: SparkSession, dense: str | None, probs: str | None) -> dict:
    """What ``prepare`` takes of files that other programs wrote; a path that is not given or not there gives nothing."""
    found = {}
    for key, path, score in (("dense", dense, "cos_emb"), ("probs", probs, "p_xenc")):
        if path:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
                found[key] = io.read_pair_scores(spark, path, score)
    return found


def main(argv=None):
    import argparse

    p = argparse.ArgumentParser(description="Link the records of three sources")
    p.add_argument("--data", default="dataset")
    p.add_argument("--output", default="output")
    p.add_argument("--work", default=None)
    p.add_argument("--mode", choices=("cv", "full"), default="cv")
    p.add_argument("--loco", action="store_true")
    for name, value in (("folds", 5), ("k-name", 10), ("k-full", 10), ("k-rev", 3), ("max-cands", 50), ("max-trigram-doc-freq", 5000)):
        p.add_argument(f"--{name}", type=int, default=value)
    for split in ("train", "test"):
        p.add_argument(f"--embed-candidates-{split}")
        p.add_argument(f"--xenc-{split}-probs")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("weftline").getOrCreate()
    o, ws = Options(a.k_name, a.k_full, a.k_rev, a.max_cands, a.max_trigram_doc_freq, a.folds), Workspace(spark, a.work)
    gold = io.explode_gold(io.read_gold(spark, f"{a.data}/train/train_ground_truth.tsv"))
    train = io.load_split(spark, a.data, "train")
    extra = {split: outside_inputs(spark, getattr(a, f"embed_candidates_{split}"), getattr(a, f"xenc_{split}_probs")) for split in ("train", "test")}
    if a.mode == "full":
        full(train, gold, io.load_split(spark, a.data, "test"), a.output, ws, o, extra["train"], extra["test"]).show()
        return
    cv = cross_validate(train, gold, ws, o, **extra["train"])
    io.write_tsv_file(cv["oof"].select("s1", "cand", "p"), f"{a.output}/oof_train.tsv")
    for k in ("recall", "report", "ceiling"):
        cv[k].show()
    if a.xenc_train_probs:
        evaluate.scorer_coverage(cv["features"]).show()
    for name, gain in model.importances(cv["models"], cv["names"])[:40]:
        print(f"{name}\t{gain:.4f}")
    if a.loco:
        for value, scored in model.leave_one_out(cv["rows"]):
            only = cv["s1"].where(cv["s1"]["country"] == value)
            print(value, decide.macro_f(decide.run_decision(scored, cv["decision"]), gold, only).first()[0], decide.macro_f(decide.decide_expected_f(decide.exclusive(scored)), gold, only).first()[0])


if __name__ == "__main__":
    main()
