"""The pair scorer over the best candidates of each S1 record: out-of-fold on the train split, or fitted on it to score the test split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import evaluate, model
from ..sources import records as io
from .linkage import Options, Workspace, outside_inputs, prepare


def scored_pairs(raw: DataFrame, ws: Workspace, o: Options, tag: str, k: int, max_len: int, **inputs) -> DataFrame:
    """The split's ``k`` best candidates of each S1 record with their texts."""
    recs, feats = prepare(raw, ws, o, tag=tag, **inputs)
    return ws.keep(model.pair_dataset(model.select_topk(feats.select("s1", "cand", "combo"), k), recs, max_len), f"{tag}-pairs")


def cross_validated(raw: DataFrame, gold: DataFrame, ws: Workspace, o: Options = Options(), k: int = 6, folds: int = 3, max_len: int = 96, **inputs) -> tuple[DataFrame, DataFrame]:
    """(s1, cand, p_xenc out of fold, positive rate) of the train split."""
    rows = ws.keep(model.label(scored_pairs(raw, ws, o, "train", k, max_len, **inputs), gold), "train-labelled")
    return ws.keep(model.scorer_out_of_fold(rows, folds), "train-probs"), evaluate.positive_rate(rows)


def fitted(raw: DataFrame, gold: DataFrame, raw_test: DataFrame, ws: Workspace, o: Options = Options(), k: int = 6, max_len: int = 96, train_inputs: dict | None = None, test_inputs: dict | None = None) -> DataFrame:
    """s1, cand, p_xenc of the test split by a scorer fitted on all train pairs."""
    rows = model.label(scored_pairs(raw, ws, o, "train", k, max_len, **(train_inputs or {})), gold)
    return ws.keep(model.pair_scorer(rows, scored_pairs(raw_test, ws, o, "test", k, max_len, **(test_inputs or {}))), "test-probs")


def main(argv=None):
    import argparse

    p = argparse.ArgumentParser(description="Pair probabilities of the best candidates")
    p.add_argument("--data", default="dataset")
    p.add_argument("--work", default=None)
    p.add_argument("--mode", choices=("cv", "full"), default="cv")
    p.add_argument("--out", required=True)
    p.add_argument("--top-k", type=int, default=6)
    p.add_argument("--folds", type=int, default=3)
    p.add_argument("--max-len", type=int, default=96)
    for split in ("train", "test"):
        p.add_argument(f"--embed-candidates-{split}")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("weftline-scorer").getOrCreate()
    ws = Workspace(spark, a.work)
    train, gold = io.load_split(spark, a.data, "train"), io.explode_gold(io.read_gold(spark, f"{a.data}/train/train_ground_truth.tsv"))
    dense = {split: outside_inputs(spark, getattr(a, f"embed_candidates_{split}"), None) for split in ("train", "test")}
    if a.mode == "cv":
        probs, rate = cross_validated(train, gold, ws, k=a.top_k, folds=a.folds, max_len=a.max_len, **dense["train"])
        rate.show()
    else:
        probs = fitted(train, gold, io.load_split(spark, a.data, "test"), ws, k=a.top_k, max_len=a.max_len, train_inputs=dense["train"], test_inputs=dense["test"])
    io.write_tsv_file(io.scores_table(probs, "p_xenc"), a.out)


if __name__ == "__main__":
    main()
