import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import textsim
from weftline.functions.normalize import normalize_records
from weftline.operators import blocking, corpus, decide, features, model
from weftline.sources import records as io

NAMES = [
    ("M/s J. K. S. Traders Pvt. Limited", "jks traders pvt ltd", "jks traders", {"pvt", "ltd"}, "jt", set()),
    ("Société Générale", "ste generale", "generale", {"ste"}, "", set()),
    ("McDonald's & Co", "mcdonald s and co", "mcdonald", {"co"}, "", set()),
    ("L L C", "llc", "llc", {"llc"}, "", set()),
    ("North East Company", "ne co", "ne", {"co"}, "", set()),
    ("शर्मा ट्रेडर्स", "", "", set(), "", set()),
    ("The Limited", "the ltd", "the ltd", {"ltd"}, "tl", set()),
    ("Studio 54 Suite", "studio 54 ste", "studio 54", {"ste"}, "s5", {"54"}),
]
ADDRESSES = [
    ("12-B, 3rd Floor, Near SBI ATM, MG Road, Bengaluru 560 001", "12 b 3rd fl nr sbi atm mg rd bengaluru 560001", "560001", {"12", "3rd"}, 1),
    ("1600 Main Street, Springfield 94105-1234", "1600 main st springfield 94105 1234", "94105", {"1600", "1234"}, 0),
    ("54321 Oak Road", "54321 oak rd", "54321", set(), 0),
    ("Plot 7, Karnataka 560001 South Zone India Asia Earth", "plot 7 karnataka 560001 s zone india asia earth", "", {"7", "560001"}, 0),
]
RAW = "entity_id string, src string, business_name string, business_address string, country string"


def raw(spark, rows):
    return spark.createDataFrame(rows, RAW)


def test_names_and_addresses(spark):
    got = {r.entity_id: r for r in normalize_records(raw(spark, [(str(i), "S1", n[0], "", " US ") for i, n in enumerate(NAMES)])).collect()}
    for i, (_, norm, core, legal, acronym, digits) in enumerate(NAMES):
        r = got[str(i)]
        assert (r.name_norm, r.name_core, set(r.legal), r.acronym, set(r.name_digits), r.country) == (norm, core, legal, acronym, digits, "US")
    got = {r.entity_id: r for r in normalize_records(raw(spark, [(str(i), "S1", "x", a[0], " ") for i, a in enumerate(ADDRESSES)])).collect()}
    for i, (_, norm, postal, nums, landmark) in enumerate(ADDRESSES):
        r = got[str(i)]
        assert (r.addr_norm, r.postal, set(r.nums), r.landmark, r.country) == (norm, postal, nums, landmark, "UNK")


def test_nulls_and_empty(spark):
    r = normalize_records(raw(spark, [(None, "S1", None, None, None)])).first()
    assert (r.name_norm, r.core_first, r.postal, r.country) == ("", "", "", "UNK")
    assert normalize_records(raw(spark, [])).count() == 0


def test_trigrams(spark):
    got = spark.range(1).select(corpus.trigrams(F.lit("ab c | acme")).alias("g")).first().g
    assert got == [" ab", "ab ", " c ", " | ", " ac", "acm", "cme", "me "]


def test_tsv(spark, tmp_path):
    p = tmp_path / "a.tsv"
    p.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\n1\tNA\t5" pipe\tUS\n\n2\t\tx\tUS\n3\tb\tc\td\n')
    rows = {r.entity_id: r for r in io.read_tsv(spark, str(p)).collect()}
    assert len(rows) == 3 and rows["1"].business_name == "NA" and rows["1"].business_address == '5" pipe' and rows["2"].business_name == ""
    assert io.scan_integrity(spark, str(p)).first().ok


def test_id_lists(spark):
    pairs = spark.createDataFrame([("a", "x", 0.5), ("a", "y", 0.9), ("a", "x", 0.5), ("c", "z", 0.1)], "s1 string, cand string, p double")
    got = {r[0]: r[1] for r in io.id_lists(spark.createDataFrame([("a",), ("b",), ("c",)], "s1 string"), pairs, "ids").collect()}
    assert got == {"a": "y,x", "b": "", "c": "z"}
    gold = spark.createDataFrame([("a", "x,,y,x"), ("b", "")], "source1_entity_id string, matched_entity_ids string")
    assert sorted(map(tuple, io.explode_gold(gold).collect())) == [("a", "x"), ("a", "y")]


def test_kernels():
    assert textsim.ratio("this is a test", "this is a test!") == pytest.approx(96.5517, abs=1e-4)
    assert textsim.partial_ratio("this is a test", "this is a test!") == 100
    assert textsim.token_sort_ratio("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == 100
    assert textsim.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    assert textsim.token_sort_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == pytest.approx(84.2105, abs=1e-4)
    assert textsim.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    for f, both, one in ((textsim.ratio, 100, 0), (textsim.partial_ratio, 100, 0), (textsim.token_set_ratio, 0, 0), (textsim.jaro_winkler, 1, 0)):
        assert f("", "") == both and f("", "a") == one


def test_kernels_are_symmetric_and_bounded():
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("ab c") for _ in range(rnd.randrange(9)))
    for _ in range(300):
        a, b = word(), word()
        for f in textsim.KERNELS.values():
            assert f(a, b) == pytest.approx(f(b, a)) and 0 <= f(a, b) <= 100


def test_key_bucket_of_50_and_51(spark):
    rows = [(f"a{i}", "S1", "Acme Foods", "1 Oak Road 12345", "US") for i in range(50)] + [(f"b{i}", "S1", "Bolt Foods", "1 Oak Road 12345", "US") for i in range(51)]
    rows += [("x", "S2", "Acme Ltd", "2 Elm 12345", "US"), ("y", "S3", "Bolt Ltd", "2 Elm 12345", "US"), ("z", "S2", "Acme", "2 Elm 12345", "FR"), ("n", "S2", "", "", "US")]
    got = blocking.key_block(normalize_records(raw(spark, rows))).collect()
    assert len(got) == 50 and {r.cand for r in got} == {"x"}


def test_pruning_at_the_cap(spark):
    recs = normalize_records(raw(spark, [("1", "S1", "qqq", "", "US"), ("2", "S2", "qqq", "", "US"), ("3", "S2", "zzz", "", "US"), ("4", "S2", "qzz", "", "US")]))
    at = {r.gram for r in corpus.postings(recs, "name", 2).where("src = 'S2'").collect()}
    below = {r.gram for r in corpus.postings(recs, "name", 1).where("src = 'S2'").collect()}
    assert "qqq" in at and "qqq" not in below and "zz " in at


def test_reverse_needs_more_than_the_bound(spark):
    rows = [("s1", "a", "g", 0.2), ("s1", "b", "h", 0.21), ("target", "x", "g", 1.0), ("target", "x", "h", 1.0)]
    posts = spark.createDataFrame([("US", "S2", *r) for r in rows], "country string, src string, side string, entity_id string, gram string, weight double")
    assert [r.s1 for r in blocking.reverse(posts).collect()] == ["b"]


def test_dense_keeps_the_bound(spark):
    rows = [("p", "q", "1", [1.0, 0.0]), ("p", "t", "2", [0.75, 0.66143783]), ("p", "t", "3", [0.0, 1.0]), ("o", "q", "4", [1.0, 0.0])]
    got = blocking.dense_topk(spark.createDataFrame(rows, "part string, side string, id string, vec array<double>"), 5, 0.75).collect()
    assert [(r.q, r.t, r.sim) for r in got] == [("1", "2", 0.75)]


def test_context_with_one_candidate_and_ties(spark):
    s = spark.createDataFrame([("a", "x", 0.5, 0.5, 0.5), ("b", "x", 0.5, 0.5, 0.5), ("b", "y", 0.2, 0.1, 0.3)], "s1 string, cand string, cos_name double, cos_full double, combo double")
    got = {(r.s1, r.cand): r for r in features.context_features(s).collect()}
    assert got["a", "x"].combo_second_gap_s1 == 1.0 and got["b", "x"].combo_second_gap_s1 == pytest.approx(0.2)
    assert got["a", "x"].mutual_best == got["b", "x"].mutual_best == 1 and got["b", "y"].mutual_best == 0


@pytest.mark.parametrize("ps, want", [([0.9, 0.6, 0.3], [0.0280, 0.7727, 0.7516, 0.6397]), ([0.51], [0.49, 0.51]), ([0.4, 0.4], [0.36, 0.3733, 0.4267]), ([0.999, 0.74], [0.0003, 0.8758, 0.8840]), ([0.999, 0.72], [0.0003, 0.8791, 0.8751])])
def test_expected_f(ps, want):
    assert decide.expected_f(ps) == pytest.approx(want, abs=6e-5)


def test_decisions(spark):
    made = lambda rows: spark.createDataFrame(rows, "s1 string, cand string, p double")
    got = sorted(map(tuple, decide.exclusive(made([("x", "c", 0.9), ("y", "c", 0.8), ("y", "d", 0.4)])).collect()))
    assert got == [("x", "c", 0.9), ("y", "c", 0.0), ("y", "d", 0.4)]
    for ps, want in (([0.6, 0.55], 1), ([0.45, 0.4], 0), ([0.9, 0.75], 2)):
        assert decide.decide_threshold(made([("s", str(i), p) for i, p in enumerate(ps)]), 0.5, 0.7).count() == want


@pytest.mark.parametrize("pred, gold, want", [("", "", 1.0), ("a", "", 0.0), ("", "a", 0.0), ("a", "ab", 0.8333), ("ab", "a", 0.5556), ("ab", "ab", 1.0)])
def test_entity_f(spark, pred, gold, want):
    made = lambda x: spark.createDataFrame([("s", c) for c in x], "s1 string, cand string")
    assert decide.entity_f(made(pred), made(gold), spark.createDataFrame([("s",)], "s1 string")).first().f05 == pytest.approx(want, abs=1e-4)


def test_folds_keep_an_entity_together(spark):
    rows = spark.range(500).selectExpr("concat('s', id % 60) AS s1", "concat('c', id) AS cand")
    assert model.folds(rows, 4).groupBy("s1").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0


def test_stream(spark, tmp_path):
    from weftline.streaming.incremental import link_stream

    targets = normalize_records(raw(spark, [("t", "S2", "Acme Ltd", "9 Elm 12345", "US")]))
    raw(spark, [("s", "S1", "Acme Foods", "1 Oak 12345", "US")]).drop("src").write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema("entity_id string, business_name string, business_address string, country string").parquet(str(tmp_path / "in"))
    link_stream(arriving, targets, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert [(r.s1, r.cand) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("s", "t")]


def test_model_out_of_fold_takes_default_options(spark, monkeypatch):
    from weftline.plans import linkage, queries

    class Ran(Exception):
        pass

    def cross_validate(raw, gold, ws, o=linkage.Options(), **inputs):
        assert o == linkage.Options()
        raise Ran

    monkeypatch.setattr(linkage, "cross_validate", cross_validate)
    monkeypatch.setattr(queries, "Biz", lambda spark, d: type("B", (), {"raw": lambda self: None, "gold": lambda self: None})())
    with pytest.raises(Ran):
        queries.model_out_of_fold(spark, "")


def test_blocks_give_the_exact_best(spark):
    """Small blocks, ties and both directions against all pairs."""
    rnd = random.Random(5)
    words = [("".join(rnd.choice("abcd") for _ in range(4))) for _ in range(12)]
    rows = [(f"{src}-{i}", src, " ".join(rnd.choice(words) for _ in range(2)), "", rnd.choice(["US", "FR"])) for src, n in (("S1", 40), ("S2", 30), ("S3", 20)) for i in range(n)]
    posts = corpus.postings(normalize_records(raw(spark, rows)), "name", None).cache()
    sides = {}
    for r in posts.collect():
        sides.setdefault((r.country, r.src, r.side), {}).setdefault(r.entity_id, {})[r.gram] = r.weight
    scores = {}
    for (country, src, side), found in sides.items():
        for a, x in found.items() if side == "s1" else ():
            for b, y in sides.get((country, src, "target"), {}).items():
                s = round(sum(w * y.get(g, 0) for g, w in x.items()), 6)
                if s > 0:
                    scores[src, a, b] = s
    for size in (1 << 16, 7):
        for back in (False, True):
            got = blocking.top_k(blocking.block_topk(posts, 3, back, size), ["src", "cand" if back else "s1"], 3, "s1" if back else "cand").collect()
            want = {}
            for (src, a, b), s in scores.items():
                want.setdefault((src, b if back else a), []).append((-s, a if back else b))
            want = {(src, e, round(-s, 6), other) for (src, e), all_ in want.items() for s, other in sorted(all_)[:3]}
            assert {(r.src, r.cand if back else r.s1, round(r.sim, 6), r.s1 if back else r.cand) for r in got} == want


def test_dense_blocks_give_the_exact_best(spark):
    import numpy as np

    rnd = np.random.default_rng(3)
    v = rnd.normal(size=(60, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    frame = spark.createDataFrame([("p", "q" if i % 2 else "t", str(i), v[i].tolist()) for i in range(60)], "part string, side string, id string, vec array<double>")
    for back in (False, True):
        one, two = ([i for i in range(60) if i % 2 == (0 if back else 1)], [i for i in range(60) if i % 2 == (1 if back else 0)])
        want = {(i, j) for i in one for j in sorted(two, key=lambda j: (-round(float(v[i] @ v[j]), 6), str(j)))[:4] if round(float(v[i] @ v[j]), 6) >= 0.1}
        order = blocking.dense_scores(frame, 4, 0.1, back, size=9)
        got = {(int(r.t if back else r.q), int(r.q if back else r.t)) for r in order.collect()}
        assert want <= got
        assert {(int(r.t if back else r.q), int(r.q if back else r.t)) for r in blocking.dense_topk(frame, 4, 0.1, back).collect()} == want


def test_rescoring_and_union_with_dense_pairs(spark):
    recs = normalize_records(raw(spark, [("a", "S1", "Acme Foods", "1 Oak 12345", "US"), ("b", "S2", "Acme Foods", "1 Oak 12345", "US"), ("c", "S3", "Zzz", "", "US")]))
    posts = {v: corpus.postings(recs, v) for v in ("name", "full")}
    dense = spark.createDataFrame([("US", "a", "c", 0.8), ("US", "a", "c", 0.9)], "country string, s1 string, cand string, cos_emb double")
    got = {r.cand: r for r in blocking.generate_candidates(recs, posts["name"], posts["full"], dense).collect()}
    assert got["b"].cos_name == pytest.approx(1) and got["b"].f_zip == got["b"].f_name == 1 and got["b"].f_emb == 0 and got["b"].cos_emb == 0
    assert got["c"].cos_name == 0 and got["c"].f_emb == 1 and got["c"].cos_emb == 0.9


def test_one_file_in_the_order_of_the_input(spark, tmp_path):
    p = tmp_path / "train" / "train_source1.tsv"
    p.parent.mkdir()
    names = [f"id{(i * 37) % 101}" for i in range(101)]
    p.write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + "".join(f"{n}\tx\ty\tUS\n" for n in names))
    rows = io.read_tsv(spark, str(p), order=io.ORDER).withColumn("src", F.lit("S1"))
    recs = normalize_records(rows)
    from weftline.plans.linkage import s1_ids

    pairs = spark.createDataFrame([("id5", "z", 0.4), ("id5", "y", 0.7)], "s1 string, cand string, p double")
    out = str(tmp_path / "lists.tsv")
    io.write_tsv_file(io.id_lists(s1_ids(recs), pairs, "matched_entity_ids").repartition(5), out)
    lines = (tmp_path / "lists.tsv").read_text().splitlines()
    assert lines[0] == "source1_entity_id\tmatched_entity_ids"
    assert [x.split("\t")[0] for x in lines[1:]] == names
    assert "id5\ty,z" in lines and "id6\t" in lines


def test_scan_that_loses_rows_is_noticed(spark, tmp_path, monkeypatch):
    p = tmp_path / "a.tsv"
    p.write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n1\tx\ty\tUS\n \t\n2\tx\ty\tUS\n")
    r = io.scan_integrity(spark, str(p)).first()
    assert (r.lines, r.rows, r.ok) == (2, 2, True)
    scan = io.read_tsv
    monkeypatch.setattr(io, "read_tsv", lambda *a, **b: scan(*a, **b).limit(1))
    r = io.scan_integrity(spark, str(p)).first()
    assert (r.lines, r.rows, r.ok) == (2, 1, False)


def test_pair_dataset_cuts_the_longer_record(spark):
    recs = normalize_records(raw(spark, [("a", "S1", " ".join(f"w{i}" for i in range(100)), "", "US"), ("b", "S2", "w1 w2", "x9", "US")]))
    got = model.pair_dataset(spark.createDataFrame([("a", "b")], "s1 string, cand string"), recs, 20).first().pair_text.split()
    assert len(got) == 20 and "w1" in got and "1:w3" in got and "2:x9" in got


def test_scorer_measures(spark):
    from weftline.operators import evaluate

    rows = spark.createDataFrame([(f"s{i}", f"c{i}", "same words" if i % 3 == 0 else "1:other 2:words", 1.0 if i % 3 == 0 else 0.0) for i in range(90)], "s1 string, cand string, pair_text string, y double")
    got = {(r.s1, r.cand): r.p_xenc for r in model.scorer_out_of_fold(rows).collect()}
    assert len(got) == 90 and all((got[f"s{i}", f"c{i}"] > 0.5) == (i % 3 == 0) for i in range(90))
    assert evaluate.positive_rate(rows).first()[0] == pytest.approx(1 / 3)
    some = features.attach_pair_probabilities(rows.select("s1", "cand"), spark.createDataFrame([("s1", "c1", 0.9)], "s1 string, cand string, p_xenc double"))
    assert evaluate.scorer_coverage(some).first()[0] == pytest.approx(1 / 90)


def test_models_by_fold_and_by_country(spark):
    rnd = random.Random(7)
    rows = [(f"s{i % 40}", f"c{i}", rnd.choice(["US", "FR"]), float(x > 0.5), [x, rnd.random()]) for i in range(400) for x in [rnd.random()]]
    from pyspark.ml.linalg import Vectors

    frame = spark.createDataFrame([(a, b, c, y, Vectors.dense(f)) for a, b, c, y, f in rows], ["s1", "cand", "country", "y", "features"])
    frame = model.folds(frame, 2).cache()
    oof, test, models = model.out_of_fold(frame, 2, test=frame, rounds=3)
    assert oof.count() == test.count() == 400 and len(models) == 2
    assert model.importances(models, ["x", "noise"])[0][0] == "x"
    each = [[r.p for r in model.predict(m, frame).orderBy("cand").collect()] for m in models]
    assert [r.p for r in test.orderBy("cand").collect()] == pytest.approx([sum(p) / 2 for p in zip(*each)])
    left = dict(model.leave_one_out(frame, rounds=3))
    assert set(left) == {"US", "FR"} and left["US"].count() == frame.where("country = 'US'").count()


def test_whole_linkage_of_files(spark, tmp_path):
    """Both programs over files: candidates, scores and lists of a small test split."""
    from weftline.plans import dense, linkage, scorer

    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    for split in ("train", "test"):
        (tmp_path / split).mkdir()
        firms = [(f"{word()} {word()}", f"{rnd.randrange(1, 99)} {word()} road 1{rnd.randrange(1000, 9999)}") for _ in range(60)]
        for k in (1, 2, 3):
            own = [(i, n, a) for i, (n, a) in enumerate(firms) if k == 1 or i % 2 == k % 2]
            (tmp_path / split / f"{split}_source{k}.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + "".join(f"S{k}-{i}\t{n}\t{a}\tUS\n" for i, n, a in own))
        if split == "train":
            (tmp_path / split / "train_ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join(f"S1-{i}\t{'S2' if i % 2 == 0 else 'S3'}-{i}\n" for i in range(60)))
    data, out = str(tmp_path), tmp_path / "out"
    dense.main(["--data", data, "--split", "train", "--out", str(tmp_path / "emb.tsv")])
    head, *rows = (tmp_path / "emb.tsv").read_text().splitlines()
    assert head == "source1_entity_id\tcandidate_entity_id\tcos_emb" and len(rows) >= 60 and all(len(r.split("\t")[2]) == 6 for r in rows)
    scorer.main(["--data", data, "--out", str(tmp_path / "probs.tsv"), "--work", str(tmp_path / "w1")])
    assert (tmp_path / "probs.tsv").read_text().startswith("source1_entity_id\tcandidate_entity_id\tp_xenc\n")
    linkage.main(["--data", data, "--output", str(out), "--work", str(tmp_path / "w2"), "--mode", "full", "--folds", "2", "--embed-candidates-train", str(tmp_path / "emb.tsv"), "--xenc-train-probs", str(tmp_path / "probs.tsv"), "--embed-candidates-test", str(tmp_path / "none.tsv")])
    lists = dict(x.split("\t") for x in (out / "matching_results.tsv").read_text().splitlines()[1:])
    assert list(lists) == [f"S1-{i}" for i in range(60)]
    assert sum(f"{'S2' if i % 2 == 0 else 'S3'}-{i}" in lists[f"S1-{i}"].split(",") for i in range(60)) >= 50
    assert (out / "oof_train.tsv").read_text().startswith("s1\tcand\tp\n") and (out / "test_scores.tsv").read_text().startswith("s1\tcand\tp\n")


def test_plans_are_cut(spark, tmp_path):
    """No plan that the driver holds has the records' normalisation in it, or more than one blocker."""
    from weftline.plans import linkage, queries

    spark.range(1, 41).selectExpr("id AS c_custkey", "CAST(id % 6 AS INT) AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    plans, keep = [], linkage.Workspace.keep
    try:
        linkage.Workspace.keep = lambda self, df, name: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), keep(self, df, name))[1]
        for name in ("sparse_topk_name", "sparse_topk_full", "sparse_topk_rev", "candidate_union_dense", "pair_features_sets"):
            plans.append(queries.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString())
            assert "EvalPython" not in plans[-1], name
    finally:
        linkage.Workspace.keep = keep
    assert all(p.count("FlatMapGroupsInArrow") <= 1 for p in plans) and all("FlatMapGroupsInArrow" not in p for p in plans if "EvalPython" in p)


def test_dense_squares_are_dealt(spark):
    """Squares of blocks of one partition go to tasks of their own, and matrix products of few cosines give all best pairs."""
    rnd = random.Random(4)
    rows = [("p", "qt"[i % 2], str(i), [rnd.random() for _ in range(4)]) for i in range(120)]
    v = spark.createDataFrame([(p, s, i, [x / sum(y * y for y in v) ** 0.5 for x in v]) for p, s, i, v in rows], "part string, side string, id string, vec array<double>")
    vec = {r.id: r.vec for r in v.collect()}
    for back in (False, True):
        scores = blocking.dense_scores(v, 3, 0.1, back, size=16, cells=64)
        plan = scores._jdf.queryExecution().executedPlan().toString()
        assert "bq" in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning(" in x)
        got = {(r.q, r.t) for r in blocking.top_k(scores.withColumn("src", F.lit("x")), ["t" if back else "q"], 3, "q" if back else "t").collect()}
        want = set()
        for a in vec:
            if int(a) % 2 == back:
                near = sorted((b for b in vec if int(b) % 2 != back), key=lambda b: (-round(sum(x * y for x, y in zip(vec[a], vec[b])), 6), b))[:3]
                want |= {(b, a) if back else (a, b) for b in near}
        assert got == want


def test_topk_by_name_counts_frequent_grams(spark, tmp_path, monkeypatch):
    """Every gram counts, however many records have it; records of equal names are scored once, with the same rows."""
    from weftline.plans import queries

    monkeypatch.setattr(queries, "CAP", 1)
    spark.range(0, 2002 * 3, 143).selectExpr("id AS c_custkey", "0 AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")  # seven names
    got = {(r.src, r.s1, r.cand): r.sim for r in queries.sparse_topk_name(spark, str(tmp_path)).collect()}
    recs = queries.Biz(spark, str(tmp_path)).records()
    posts = corpus.postings(recs, "name", None).cache()
    same = blocking.alike(posts, lambda df, name: df.cache())
    assert same.where("place = 1").count() < same.count() / 2
    assert got == {(r.src, r.s1, r.cand): r.sim for r in blocking.forward(posts, 10).collect()}
    name = {r.entity_id: r.name_core for r in recs.collect()}
    assert {s for (_, a, b), s in got.items() if name[a] == name[b]} == {1.0}
    back = [{(r.src, r.s1, r.cand, r.sim, r["rank"]) for r in blocking.reverse(posts, 3, 0.2, c).collect()} for c in (None, same)]
    assert back[0] == back[1] and back[0]


def test_union_drops_no_candidate(spark, tmp_path):
    """A key bucket of 51 S1 records, each with over 50 candidates: all meet, and all stay."""
    from weftline.plans import queries

    spark.range(51).selectExpr("1 + 990000 * id AS c_custkey", "0 AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    got = queries.candidate_union_cap(spark, str(tmp_path)).collect()
    assert len(got) == 51 * 102 and all(r.f_zip == 1 for r in got)


def test_written_tables_release_the_drivers_memory(spark, tmp_path, monkeypatch):
    from weftline.plans import linkage

    said, release = [], linkage.release
    monkeypatch.setattr(linkage, "release", lambda s: said.append(release(s)))
    assert linkage.Workspace(spark, str(tmp_path)).keep(spark.range(3), "x").count() == 3
    assert len(said) == 1 and said[0].startswith("Trim native heap")
