"""Registered queries of the linkage engine and their DuckDB twins."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions.lexicon import LANDMARK, LEGAL, NAME_STOP, SHORT
from ..operators import blocking, corpus, decide, evaluate, features, model
from ..sources import records as io
from . import biz
from .biz import Biz

CAP = 5000


def _text(*cols):
    """Array columns as sorted text, which compares in any engine."""
    return [F.array_join(F.array_sort(c), ",").alias(c) if c in ("core_set", "legal", "name_digits", "addr_set", "nums") else F.col(c) for c in cols]


RECORD = ("entity_id", "src", "country", "name_norm", "name_core", "core_set", "core_first", "legal", "acronym", "name_digits", "addr_norm", "addr_set", "postal", "nums", "landmark")


def normalize_names(spark, d):
    return Biz(spark, d).records().select(*_text(*RECORD))


def _files(spark, d):
    """The derived data set as the files of a split, in a folder of its own."""
    from .linkage import Workspace

    folder, raw = Workspace(spark).root, Biz(spark, d).raw()
    for k in (1, 2, 3):
        io.write_tsv_file(raw.where(f"src = 'S{k}'").drop("src"), f"{folder}/train/train_source{k}.tsv")
    return folder


def split_scan(spark, d):
    return io.load_split(spark, _files(spark, d), "train").drop(io.ORDER)


def scan_integrity(spark, d):
    folder = _files(spark, d)
    return biz.union([io.scan_integrity(spark, f"{folder}/train/train_source{k}.tsv").withColumn("src", F.lit(f"S{k}")) for k in (1, 2, 3)])


def gold_scan(spark, d):
    from .linkage import Workspace

    b, path = Biz(spark, d), Workspace(spark).root + "/gold.tsv"
    io.write_tsv_file(io.id_lists(b.s1(), b.gold().withColumn("p", F.lit(1.0)), "matched_entity_ids"), path)
    return io.explode_gold(io.read_gold(spark, path))


def _score_file(spark, d, score):
    from .linkage import Workspace

    path = f"{Workspace(spark).root}/{score}.tsv"
    table = io.scores_table(Biz(spark, d).scored().withColumnRenamed("p", score), score)
    io.write_tsv_file(table, path)
    return io.read_pair_scores(spark, path, score)


def pair_probability_scan(spark, d):
    return _score_file(spark, d, "p_xenc")


def embedding_scan(spark, d):
    return io.map_pair_scores(_score_file(spark, d, "cos_emb"), Biz(spark, d).records())


def embedding_writer(spark, d):
    return io.embedding_table(Biz(spark, d).scored().withColumnRenamed("p", "cos_emb"))


def pair_texts(spark, d):
    from ..functions.normalize import entity_text

    return Biz(spark, d).records().select("entity_id", entity_text("pair").alias("pair_text"))


def load_summary(spark, d):
    return corpus.load_summary(Biz(spark, d).records())


def token_idf(spark, d):
    return corpus.token_idf(Biz(spark, d).records()).select("country", "kind", "token", F.round("idf", 6).alias("idf"))


def default_idf(spark, d):
    return corpus.default_idf(Biz(spark, d).records()).select("country", F.round("default_idf", 6).alias("default_idf"))


def s1_name_freq(spark, d):
    return corpus.name_frequency(Biz(spark, d).records())


def trigram_postings(spark, d):
    return corpus.postings(Biz(spark, d).records(), "name", None).withColumn("weight", F.round("weight", 6))


def prune_grams(spark, d):
    return corpus.postings(Biz(spark, d).records(), "name", 200).groupBy("country", "src", "side").agg(F.count(F.lit(1)).alias("kept"), F.countDistinct("gram").alias("grams"))


def _kept(spark, d, *views, cap=CAP):
    """A workspace, records and the postings of views as written tables: the driver plans each by itself, and none is made twice."""
    from .linkage import Workspace

    ws = Workspace(spark)
    recs = ws.keep(Biz(spark, d).records(), "records")
    return ws, recs, *[ws.keep(corpus.postings(recs, view, cap), f"postings-{view}") for view in views]


def sparse_topk_name(spark, d):
    """By all grams, however frequent."""
    ws, _, posts = _kept(spark, d, "name", cap=None)
    return blocking.forward(posts, 10, blocking.alike(posts, ws.keep)).select("country", "src", "s1", "cand", "sim", "rank")


def sparse_topk_full(spark, d):
    return blocking.forward(_kept(spark, d, "full")[2], 10).select("country", "src", "s1", "cand", "sim", "rank")


def sparse_topk_rev(spark, d):
    return blocking.reverse(_kept(spark, d, "name")[2]).select("country", "src", "s1", "cand", "sim", "rank")


def key_block(spark, d):
    return blocking.key_block(Biz(spark, d).records())


def _vectors(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select(F.lit("all").alias("part"), F.when(F.col("vec_id") % 2 == 0, "q").otherwise("t").alias("side"), F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vec"))


def dense_topk_fwd(spark, d):
    return blocking.dense_topk(_vectors(spark, d), 15, 0.2).select("q", "t", "sim", "rank")


def dense_topk_rev(spark, d):
    return blocking.dense_topk(_vectors(spark, d), 5, 0.2, back=True).select("q", "t", "sim", "rank")


def _candidates(spark, d, dense=None, whole=False):
    """``whole``: all grams count, key buckets of any size meet and all candidates stay."""
    ws, recs, name, full = _kept(spark, d, "name", "full", cap=None if whole else CAP)
    if dense is not None:
        dense = dense(recs)
    caps = {"most": None, "most_key": None, "classes": True} if whole else {}
    return ws, recs, blocking.generate_candidates(recs, name, full, dense, keep=ws.keeper("blocks"), **caps)


def candidate_union_dense(spark, d):
    """The same with dense candidates of an outside file."""
    b = Biz(spark, d)
    scored = b.scored().select("s1", "cand", F.col("p").alias("cos_emb"))
    return _candidates(spark, d, lambda recs: io.map_pair_scores(scored, recs).join(b.s1(), "s1"))[2].select("country", "s1", "cand", *blocking.FLAGS, "cos_name", "cos_full", "cos_emb")


def candidate_union_cap(spark, d):
    """All candidates of all blockers: no cap on grams, key buckets or an S1 record's candidates."""
    return _candidates(spark, d, whole=True)[2].select("country", "s1", "cand", *blocking.FLAGS, "cos_name", "cos_full", "cos_emb")


def _pairs(spark, d):
    ws, recs, found = _candidates(spark, d)
    return recs, features.attach_records(ws.keep(found.select("country", "s1", "cand"), "candidates"), recs)


def name_frequency_attach(spark, d):
    recs, pairs = _pairs(spark, d)
    return features.attach_name_frequency(pairs, corpus.name_frequency(recs)).select("s1", "cand", F.col("s1_name_freq").cast("long").alias("s1_name_freq"))


def combo(spark, d):
    s = Biz(spark, d).scored().select("s1", "cand", F.col("p").alias("cos_full"), F.round(F.col("p") * 100, 3).alias("n_tset"), F.round(F.col("p") * 50, 3).alias("a_tset"))
    return features.with_combo(s).select("s1", "cand", "combo")


SETS = ("n_lev", "n_jacc", "n_first_eq", "n_acronym", "n_len1", "n_len2", "legal_conflict", "name_digit_conflict", "a_jacc", "zip_eq", "zip_prefix_eq", "num_jacc", "a_len1", "a_len2", "landmark1", "landmark2", "is_s3")
FLOATS = ("n_lev", "n_jacc", "a_jacc", "num_jacc")


def pair_features_sets(spark, d):
    out = features.set_features(_pairs(spark, d)[1])
    return out.select("s1", "cand", *[F.round(c, 6).alias(c) if c in FLOATS else F.col(c) for c in SETS])


def pair_features_idf(spark, d):
    recs, pairs = _pairs(spark, d)
    out = features.idf_features(pairs, corpus.token_idf(recs), corpus.default_idf(recs))
    return out.select("s1", "cand", *[F.round(c, 6).alias(c) for c in ("n_idf", "n_idf_unmatched_max", "a_idf", "a_idf_unmatched_max")])


def pair_features_jaro_winkler(spark, d):
    from ..functions.textsim import kernel

    return _pairs(spark, d)[1].select("s1", "cand", F.round(kernel("jaro_winkler")("name_core1", "name_core2"), 6).alias("n_jw"))


def pair_features_kernels(spark, d):
    return features.kernel_features(_pairs(spark, d)[1]).select("s1", "cand", "n_ratio", "n_pratio", "n_tset", "n_tsort", "n_jw", "n_full_tset", "a_ratio", "a_pratio", "a_tset", "a_tsort", "name_in_addr")


def context_features(spark, d):
    s = Biz(spark, d).scored().select("s1", "cand", F.col("p").alias("cos_name"), F.round(F.pmod(F.lit(3) * F.col("p"), F.lit(1.0)), 3).alias("cos_full"), F.round(F.col("p") * F.col("p"), 6).alias("combo"))
    out = features.context_features(s)
    return out.select(*[F.round(c, 6).alias(c) if "gap" in c or c in features.SCORES else F.col(c) for c in out.columns])


def exclusivity(spark, d):
    return decide.exclusive(Biz(spark, d).scored())


def threshold_decision(spark, d):
    return decide.decide_threshold(Biz(spark, d).scored(), 0.5, 0.7)


def expected_f_decision(spark, d):
    return decide.decide_expected_f(Biz(spark, d).scored())


def macro_f05(spark, d):
    b = Biz(spark, d)
    return decide.macro_f(decide.decide_threshold(b.scored(), 0.5, 0.7), b.gold(), b.s1()).select(F.round("macro_f05", 6).alias("macro_f05"))


def threshold_grid(spark, d):
    b = Biz(spark, d)
    return decide.threshold_grid(b.scored(), b.gold(), b.s1(), decide.T1[::7], decide.T2[::7])


def gold_explode(spark, d):
    b = Biz(spark, d)
    lists = io.id_lists(b.s1(), b.gold().withColumn("p", F.lit(1.0)), "matched_entity_ids")
    return io.explode_gold(lists)


def id_list_output(spark, d):
    b = Biz(spark, d)
    return io.id_lists(b.s1(), b.scored(), "candidate_entity_ids")


def output_checks(spark, d):
    b = Biz(spark, d)
    return io.output_violations(decide.decide_threshold(b.scored(), 0.5, 0.7), b.scored(), b.records())


def gold_diagnostics(spark, d):
    b = Biz(spark, d)
    return evaluate.gold_diagnostics(b.gold(), b.s1(), b.records())


def match_set_sizes(spark, d):
    b = Biz(spark, d)
    return evaluate.set_sizes(b.gold(), b.s1())


def _flagged(spark, d):
    s = Biz(spark, d).scored()
    return s.select("s1", "cand", *[(F.floor(F.round(F.col("p") * 1000)) % (k + 2) == 0).cast("int").alias(f) for k, f in enumerate(blocking.FLAGS)])


def blocking_recall(spark, d):
    return evaluate.blocking_recall(_flagged(spark, d), Biz(spark, d).gold()).withColumn("recall", F.round("recall", 6))


def fully_recalled(spark, d):
    b = Biz(spark, d)
    return evaluate.fully_recalled(b.scored(), b.gold()).select(F.round("fully_recalled", 6).alias("fully_recalled"))


def score_report(spark, d):
    b = Biz(spark, d)
    return evaluate.score_report(decide.decide_threshold(b.scored(), 0.5, 0.7), b.gold(), b.s1()).withColumn("macro_f05", F.round("macro_f05", 6))


def oracle_ceiling(spark, d):
    b = Biz(spark, d)
    return evaluate.ceiling(b.scored(), b.gold(), b.s1()).select(F.round("macro_f05", 6).alias("macro_f05"))


def match_rate(spark, d):
    b = Biz(spark, d)
    return evaluate.match_rate(decide.decide_threshold(b.scored(), 0.5, 0.7), b.s1()).withColumn("match_rate", F.round("match_rate", 6))


def fold_integrity(spark, d):
    """The folds that models are trained by: S1 records in more than one, folds, pairs."""
    f = model.folds(Biz(spark, d).scored())
    return f.groupBy("s1").agg(F.countDistinct("fold").alias("n"), F.count(F.lit(1)).alias("pairs"), F.min("fold").alias("fold")).agg(F.count(F.when(F.col("n") > 1, 1)).alias("split_entities"), F.countDistinct("fold").alias("folds"), F.sum("pairs").alias("pairs"))


def decision_search(spark, d):
    b = Biz(spark, d)
    best = decide.search_decisions(b.scored(), b.gold(), b.s1())
    score = decide.macro_f(decide.run_decision(b.scored(), best), b.gold(), b.s1()).first()[0]
    thr = best.kind == "thr"
    return spark.createDataFrame([(best.exclusive, best.kind, int(round(best.t1 * 1000)) if thr else 0, int(round(best.t2 * 1000)) if thr else 0, round(score, 6))], "exclusive boolean, kind string, t1 int, t2 int, macro_f05 double")


def scorer_coverage(spark, d):
    return evaluate.scorer_coverage(pair_probability_merge(spark, d)).withColumn("coverage", F.round("coverage", 6))


def positive_rate(spark, d):
    b = Biz(spark, d)
    top = model.select_topk(b.scored().withColumnRenamed("p", "combo"), 2)
    return evaluate.positive_rate(model.label(top, b.gold())).withColumn("positive_rate", F.round("positive_rate", 6))


def labelled_folds(spark, d):
    b = Biz(spark, d)
    return model.numeric_folds(model.label(b.scored(), b.gold())).select("s1", "cand", "y", "fold")


def pair_probability_merge(spark, d):
    s = Biz(spark, d).scored()
    probs = s.where(F.floor(F.round(F.col("p") * 1000)) % 2 == 0).select("s1", "cand", F.col("p").alias("p_xenc"))
    return features.attach_pair_probabilities(s, probs.unionByName(probs.withColumn("p_xenc", F.col("p_xenc") / 2))).select("s1", "cand", "p_xenc", "p_xenc_present")


def scorer_topk(spark, d):
    s = Biz(spark, d).scored().withColumnRenamed("p", "combo")
    return model.select_topk(s, 2)


def embedding_candidates(spark, d):
    b = Biz(spark, d)
    s = b.scored().select("s1", "cand", F.col("p").alias("cos_emb"))
    return io.map_pair_scores(s, b.records())


def minimum_slice(spark, d):
    """Key-blocked targets of each S1 record by name similarity, exclusive, thresholded, as id lists."""
    b = Biz(spark, d)
    _, recs, posts = _kept(spark, d, "name")
    pairs = blocking.rescore(blocking.key_block(recs).select("s1", "cand").distinct(), {"p": posts})
    return io.id_lists(b.s1(), decide.decide_threshold(decide.exclusive(pairs), 0.5, 0.7), "matched_entity_ids")


def model_out_of_fold(spark, d):
    """Features, boosted trees by fold, decision and report over the whole derived set."""
    from .linkage import Options, Workspace, cross_validate

    b = Biz(spark, d)
    return cross_validate(b.raw(), b.gold(), Workspace(spark), Options())["report"].withColumn("macro_f05", F.round("macro_f05", 4))


def dense_encoder(spark, d):
    """Raw texts through the stand-in encoder, then the dense blocker within each country."""
    from .dense import dense_candidates

    return dense_candidates(Biz(spark, d).records()).withColumn("cos_emb", F.round("cos_emb", 4))


QUERIES = {f.__name__: f for f in (minimum_slice, split_scan, scan_integrity, gold_scan, pair_probability_scan, embedding_scan, embedding_writer, pair_texts, normalize_names, load_summary, token_idf, default_idf, s1_name_freq, trigram_postings, prune_grams, sparse_topk_name, sparse_topk_full, sparse_topk_rev, key_block, dense_topk_fwd, dense_topk_rev, dense_encoder, candidate_union_cap, candidate_union_dense, name_frequency_attach, combo, embedding_candidates, pair_features_sets, pair_features_idf, pair_features_jaro_winkler, pair_features_kernels, context_features, pair_probability_merge, scorer_topk, scorer_coverage, positive_rate, fold_integrity, decision_search, labelled_folds, model_out_of_fold, exclusivity, threshold_decision, expected_f_decision, macro_f05, threshold_grid, gold_explode, id_list_output, output_checks, gold_diagnostics, match_set_sizes, blocking_recall, fully_recalled, score_report, oracle_ceiling, match_rate)}

# ---- DuckDB twins -------------------------------------------------------------------------------

_in = lambda words: ", ".join(f"'{w}'" for w in words)
_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in SHORT.items()) + "}"


def _tokens(col):
    s = f"lower(strip_accents({col}))"
    s = rf"regexp_replace({s}, '\bm\s*/\s*s\b', ' ', 'g')"
    s = f"replace(replace(replace({s}, '&', ' and '), '''', ' '), '’', ' ')"
    s = rf"regexp_replace({s}, '\b(\d{{3}})[\s-](\d{{3}})\b', '\1\2', 'g')"
    s = f"regexp_replace({s}, '[^0-9a-z]+', ' ', 'g')"
    return f"list_transform(list_filter(string_split({s}, ' '), lambda t: t <> ''), lambda t: coalesce({_MAP}[t], t))"


_sorted = lambda c: f"array_to_string(list_sort(list_distinct({c})), ',')"
NORM = f"""
raw AS ({biz.RAW}),
tok AS (SELECT *, {_tokens('business_name')} AS nt0, {_tokens('business_address')} AS adt FROM raw),
grp AS (SELECT *, list_transform(nt0, lambda t, i: length(t) = 1 AND t ~ '[a-z]') AS single FROM tok),
mrg AS (SELECT *, list_filter(string_split(array_to_string(list_transform(nt0, lambda t, i: CASE WHEN i > 1 AND single[i] AND single[i - 1] THEN t ELSE concat(' ', t) END), ''), ' '), lambda t: t <> '') AS nt FROM grp),
cor AS (SELECT *, list_filter(nt, lambda t: t NOT IN ({_in([*LEGAL, *NAME_STOP])})) AS core0 FROM mrg),
rec0 AS (SELECT *, CASE WHEN len(core0) > 0 THEN core0 ELSE nt END AS core, coalesce(list_filter(list_reverse(adt[greatest(len(adt) - 3, 1):]), lambda t: t ~ '^([0-9]{{5}}|[0-9]{{6}})$')[1], '') AS postal FROM cor),
rec AS (SELECT entity_id, src, CASE WHEN trim(country) = '' THEN 'UNK' ELSE trim(country) END AS country, array_to_string(nt, ' ') AS name_norm, array_to_string(core, ' ') AS name_core,
  list_distinct(core) AS core_set, coalesce(core[1], '') AS core_first, list_distinct(list_filter(nt, lambda t: t IN ({_in(LEGAL)}))) AS legal,
  CASE WHEN len(core) >= 2 THEN array_to_string(list_transform(core, lambda t: t[1]), '') ELSE '' END AS acronym,
  list_distinct(list_filter(core, lambda t: t ~ '^[0-9]+$')) AS name_digits, array_to_string(adt, ' ') AS addr_norm, list_distinct(adt) AS addr_set, postal,
  list_distinct(list_filter(adt, lambda t: t ~ '[0-9]' AND t <> postal)) AS nums, CASE WHEN len(list_filter(adt, lambda t: t IN ({_in(LANDMARK)}))) > 0 THEN 1 ELSE 0 END AS landmark FROM rec0)"""


def _postings(view, cap=None, tag=""):
    text = "name_core" if view == "name" else "concat(name_core, ' | ', addr_norm)"
    return f"""
wrd{tag} AS (SELECT country, src AS own, entity_id, unnest(list_filter(string_split(lower({text}), ' '), lambda w: w <> '')) AS w FROM rec),
grm{tag} AS (SELECT country, own, entity_id, substr(concat(' ', w, ' '), i, 3) AS gram FROM (SELECT *, unnest(range(1, length(w) + 1)) AS i FROM wrd{tag})),
tfr{tag} AS (SELECT country, own, entity_id, gram, 1 + ln(count(*)) AS tf FROM grm{tag} GROUP BY ALL),
sid{tag} AS (SELECT country, s.src, CASE WHEN own = 'S1' THEN 's1' ELSE 'target' END AS side, entity_id, gram, tf FROM tfr{tag} JOIN (VALUES ('S2'), ('S3')) s(src) ON own = 'S1' OR own = s.src),
siz{tag} AS (SELECT country, s.src, count(*) AS n FROM rec JOIN (VALUES ('S2'), ('S3')) s(src) ON rec.src = 'S1' OR rec.src = s.src GROUP BY ALL),
dfr{tag} AS (SELECT country, src, gram, count(*) AS df FROM sid{tag} GROUP BY ALL),
wgt{tag} AS (SELECT *, tf * (ln((1.0 + n) / (1.0 + df)) + 1) AS wt FROM sid{tag} JOIN dfr{tag} USING (country, src, gram) JOIN siz{tag} USING (country, src)),
nrm{tag} AS (SELECT country, src, side, entity_id, sqrt(sum(wt * wt)) AS len FROM wgt{tag} GROUP BY ALL),
pst{tag} AS (SELECT country, src, side, entity_id, gram, wt / len AS weight FROM wgt{tag} JOIN nrm{tag} USING (country, src, side, entity_id) {f"WHERE df <= {cap}" if cap else ""}),
scr{tag} AS (SELECT a.country, a.src, a.entity_id AS s1, b.entity_id AS cand, round(sum(a.weight * b.weight), 6) AS sim FROM pst{tag} a JOIN pst{tag} b ON a.country = b.country AND a.src = b.src AND a.gram = b.gram AND a.side = 's1' AND b.side = 'target' GROUP BY ALL HAVING round(sum(a.weight * b.weight), 6) > 0)"""


_fwd = lambda t, k: f"SELECT *, row_number() OVER (PARTITION BY src, s1 ORDER BY sim DESC, cand) AS rank FROM scr{t} QUALIFY rank <= {k}"
_rev = lambda t: f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, cand ORDER BY sim DESC, s1) AS rank FROM scr{t}) WHERE rank <= 3 AND sim > 0.2"
KEY = "key AS (SELECT b.country, b.src, a.entity_id AS s1, b.entity_id AS cand FROM (SELECT *, count(*) OVER (PARTITION BY country, postal, core_first) AS n FROM rec WHERE src = 'S1' AND postal <> '' AND core_first <> '') a JOIN rec b ON a.country = b.country AND a.postal = b.postal AND a.core_first = b.core_first AND b.src <> 'S1' WHERE n <= 50)"
BASE = f"scored AS ({biz.SCORED}), gold AS ({biz.GOLD}), s1s AS ({biz.S1})"
PRED = "pred AS (SELECT s1, cand, p FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, cand) AS r, max(p) OVER (PARTITION BY s1) AS top FROM scored) WHERE top >= 0.5 AND (r = 1 OR p >= 0.7))"


def _entity(pred="pred"):
    return f"ent AS (SELECT s.s1, any_value(s.country) AS country, CASE WHEN any_value(np) IS NULL AND any_value(ng) IS NULL THEN 1.0 WHEN any_value(np) IS NULL OR any_value(ng) IS NULL THEN 0.0 ELSE 1.25 * any_value(tp) / (0.25 * any_value(ng) + any_value(np)) END AS f05 FROM s1s s LEFT JOIN (SELECT s1, count(*) AS np, count(g) AS tp FROM (SELECT p.s1, p.cand, g.cand AS g FROM {pred} p LEFT JOIN gold g ON p.s1 = g.s1 AND p.cand = g.cand) GROUP BY s1) p ON s.s1 = p.s1 LEFT JOIN (SELECT s1, count(*) AS ng FROM gold GROUP BY s1) g ON s.s1 = g.s1 GROUP BY s.s1)"


def _dense(by, tie, k):
    return f"""WITH q AS (SELECT CAST(vec_id AS VARCHAR) AS q, embedding AS a FROM embeddings WHERE vec_id % 2 = 0), t AS (SELECT CAST(vec_id AS VARCHAR) AS t, embedding AS b FROM embeddings WHERE vec_id % 2 = 1),
s AS (SELECT q, t, round(list_sum(list_transform(list_zip(a, b), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)), 6) AS sim FROM q CROSS JOIN t)
SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY sim DESC, {tie}) AS rank FROM s WHERE sim >= 0.2 QUALIFY rank <= {k}"""


def _context():
    parts = []
    for side, key in (("s1", "s1"), ("cand", "cand")):
        for c in ("cos_name", "cos_full", "combo"):
            parts.append(f"rank() OVER (PARTITION BY {key} ORDER BY {c} DESC) AS {c}_rank_{side}, round(max({c}) OVER (PARTITION BY {key}) - {c}, 6) AS {c}_gap_{side}")
    return ", ".join(parts)


def _union(dense=None, whole=False):
    """cnd: the union of all blockers, re-scored and (unless ``whole``) capped. ``dense``: a table of s1, cand, cos_emb."""
    key, grams, best = (KEY.replace(" WHERE n <= 50", ""), None, "") if whole else (KEY, CAP, " QUALIFY row_number() OVER (PARTITION BY s1 ORDER BY round(greatest(cos_name, cos_full, emb) + 0.05::DOUBLE * f_zip, 6) DESC, cand) <= 50")
    extra = f" UNION ALL SELECT s1s.country, e.s1, e.cand, 'f_emb' FROM {dense} e JOIN s1s ON s1s.s1 = e.s1" if dense else ""
    cos = "e.cos_emb" if dense else "NULL::DOUBLE"
    join = f" LEFT JOIN {dense} e ON e.s1 = u.s1 AND e.cand = u.cand" if dense else ""
    flags = ", ".join(f"max(CASE WHEN f = '{x}' THEN 1 ELSE 0 END) AS {x}" for x in blocking.FLAGS)
    return f"""{key}, {_postings('name', grams, 'n')}, {_postings('full', grams, 'f')},
flg AS (SELECT country, s1, cand, 'f_name' AS f FROM ({_fwd('n', 10)}) UNION ALL SELECT country, s1, cand, 'f_full' FROM ({_fwd('f', 10)}) UNION ALL SELECT country, s1, cand, 'f_rev' FROM ({_rev('n')}) UNION ALL SELECT country, s1, cand, 'f_rev' FROM ({_rev('f')}) UNION ALL SELECT country, s1, cand, 'f_zip' FROM key{extra}),
uni AS (SELECT country, s1, cand, {flags} FROM flg GROUP BY ALL),
rsc AS (SELECT u.*, coalesce(a.sim, 0.0) AS cos_name, coalesce(b.sim, 0.0) AS cos_full, {cos} AS emb FROM uni u LEFT JOIN scrn a ON a.s1 = u.s1 AND a.cand = u.cand LEFT JOIN scrf b ON b.s1 = u.s1 AND b.cand = u.cand{join}),
cnd AS (SELECT * EXCLUDE (emb), coalesce(emb, 0.0)::DOUBLE AS cos_emb FROM rsc{best})"""


CAND = _union()
DENSE = "dns AS (SELECT s.s1, s.cand, max(p) AS cos_emb FROM scored s JOIN rec a ON a.entity_id = s.s1 AND a.src = 'S1' JOIN rec b ON b.entity_id = s.cand AND b.src <> 'S1' AND a.country = b.country GROUP BY ALL)"


_flag = lambda k: f"CASE WHEN CAST(round(p * 1000) AS BIGINT) % {k + 2} = 0 THEN 1 ELSE 0 END"
FLAGGED = "flagged AS (SELECT s1, cand, " + ", ".join(f"{_flag(k)} AS {f}" for k, f in enumerate(blocking.FLAGS)) + " FROM scored)"
PAIRS = "prs AS (SELECT k.s1, k.cand, a.country, a.core_set AS c1, b.core_set AS c2, a.addr_set AS a1, b.addr_set AS a2, a.name_core AS n1, b.name_core AS n2, a.core_first AS f1, b.core_first AS f2, a.acronym AS y1, b.acronym AS y2, a.legal AS l1, b.legal AS l2, a.name_digits AS d1, b.name_digits AS d2, a.postal AS p1, b.postal AS p2, a.nums AS u1, b.nums AS u2, a.landmark AS m1, b.landmark AS m2, b.src AS src2 FROM cnd k JOIN rec a ON a.entity_id = k.s1 JOIN rec b ON b.entity_id = k.cand)"
_jac = lambda x, y: f"len(list_intersect({x}, {y})) / greatest(len(list_distinct(list_concat({x}, {y}))), 1)"
IDF = "tkn AS (SELECT country, 'name' AS kind, unnest(core_set) AS token FROM rec UNION ALL SELECT country, 'addr', unnest(addr_set) FROM rec), cnt AS (SELECT country, count(*) AS n FROM rec GROUP BY country), idf AS (SELECT country, kind, token, ln((any_value(n) + 1) / (count(*) + 1)) + 1 AS idf FROM tkn JOIN cnt USING (country) GROUP BY ALL)"


def _idf(col, kind, tag):
    a, b = f"{col}1", f"{col}2"
    return f"{tag} AS (SELECT s1, cand, sum(CASE WHEN i1 AND i2 THEN idf ELSE 0 END) / sum(idf) AS o, coalesce(max(CASE WHEN NOT (i1 AND i2) THEN idf END), 0) AS u FROM (SELECT s1, cand, country, token, list_contains({a}, token) AS i1, list_contains({b}, token) AS i2 FROM (SELECT *, unnest(list_distinct(list_concat({a}, {b}))) AS token FROM prs)) t JOIN idf USING (country, token) WHERE kind = '{kind}' GROUP BY s1, cand)"


def _grid():
    one = ", ".join(f"({x})" for x in decide.T1[::7])
    two = ", ".join(f"({x})" for x in decide.T2[::7])
    return f"""WITH {BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, cand) AS r, max(p) OVER (PARTITION BY s1) AS top FROM scored),
g AS (SELECT t1, t2 FROM (VALUES {one}) a(t1) CROSS JOIN (VALUES {two}) b(t2)),
k AS (SELECT t1, t2, r.s1, count(*) AS np, count(gold.cand) AS tp FROM g JOIN r ON top >= t1 / 1000 AND (r.r = 1 OR p >= t2 / 1000) LEFT JOIN gold ON gold.s1 = r.s1 AND gold.cand = r.cand GROUP BY ALL),
n AS (SELECT s.s1, count(gold.cand) AS ng FROM s1s s LEFT JOIN gold ON gold.s1 = s.s1 GROUP BY s.s1)
SELECT g.t1, g.t2, round(avg(CASE WHEN np IS NULL AND ng = 0 THEN 1.0 WHEN np IS NULL OR ng = 0 THEN 0.0 ELSE 1.25 * tp / (0.25 * ng + np) END), 6) AS macro_f05 FROM g CROSS JOIN n LEFT JOIN k ON k.t1 = g.t1 AND k.t2 = g.t2 AND k.s1 = n.s1 GROUP BY g.t1, g.t2"""


def _expected():
    """E[F0.5] for up to four independent pairs, over all outcomes of a record."""
    return f"""WITH {BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, cand) AS r FROM scored WHERE p >= 0.02),
l AS (SELECT s1, list(p ORDER BY r) AS ps FROM r GROUP BY s1),
o AS (SELECT s1, ps, m, list_transform(range(1, len(ps) + 1), lambda i: CAST((m >> (i - 1)) & 1 AS BIGINT)) AS h FROM (SELECT *, unnest(range(0, CAST(pow(2, len(ps)) AS BIGINT))) AS m FROM l)),
w AS (SELECT s1, len(ps) AS n, h, coalesce(list_sum(h), 0) AS total, list_product(list_transform(ps, lambda p, i: CASE WHEN h[i] = 1 THEN p ELSE 1 - p END)) AS pr FROM o),
e AS (SELECT s1, k, round(sum(CASE WHEN k = 0 THEN CASE WHEN total = 0 THEN pr ELSE 0 END ELSE pr * 1.25 * coalesce(list_sum(h[1:k]), 0) / (0.25 * total + k) END), 12) AS ef FROM (SELECT *, unnest(range(0, n + 1)) AS k FROM w) GROUP BY s1, k),
b AS (SELECT s1, k FROM e QUALIFY row_number() OVER (PARTITION BY s1 ORDER BY ef DESC, k) = 1)
SELECT r.s1, r.cand, r.p FROM r JOIN b USING (s1) WHERE r.r <= b.k"""


EXCL = "CASE WHEN row_number() OVER (PARTITION BY cand ORDER BY p DESC, s1) = 1 THEN p ELSE 0.0 END"


def _search():
    """The decision with the best macro F0.5: thresholds on raw, expected F on raw, thresholds and expected F on exclusive scores, in that order of preference."""
    parts = []
    for n, excl in enumerate((False, True)):
        scored = f"(SELECT s1, cand, {EXCL} AS p FROM scored)" if excl else "scored"
        for kind in ("thr", "expf"):
            tag = f"{kind}{n}"
            if kind == "thr":
                one, two = ", ".join(f"({x})" for x in decide.T1), ", ".join(f"({x})" for x in decide.T2)
                parts.append((tag, f"""r{tag} AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, cand) AS r, max(p) OVER (PARTITION BY s1) AS top FROM {scored}),
p{tag} AS (SELECT t1, t2, s1, cand FROM (VALUES {one}) a(t1) CROSS JOIN (VALUES {two}) b(t2) JOIN r{tag} ON top >= t1 / 1000 AND (r = 1 OR p >= t2 / 1000)), g{tag} AS (SELECT t1, t2 FROM (VALUES {one}) a(t1) CROSS JOIN (VALUES {two}) b(t2))"""))
            else:
                body = _expected().split("r AS (", 1)[1].replace("FROM scored", f"FROM {scored}")
                parts.append((tag, f"p{tag} AS (SELECT 0 AS t1, 0 AS t2, s1, cand FROM (WITH r AS ({body})), g{tag} AS (SELECT 0 AS t1, 0 AS t2)"))
    ctes = ", ".join(sql for _, sql in parts)
    scores = " UNION ALL ".join(
        f"""SELECT {i} AS place, {'true' if i > 1 else 'false'} AS exclusive, '{tag[:-1]}' AS kind, g.t1, g.t2, avg(CASE WHEN np IS NULL AND ng = 0 THEN 1.0 WHEN np IS NULL OR ng = 0 THEN 0.0 ELSE 1.25 * tp / (0.25 * ng + np) END) AS f
FROM g{tag} g CROSS JOIN n LEFT JOIN (SELECT t1, t2, p.s1, count(*) AS np, count(gold.cand) AS tp FROM p{tag} p LEFT JOIN gold ON gold.s1 = p.s1 AND gold.cand = p.cand GROUP BY ALL) k ON k.t1 = g.t1 AND k.t2 = g.t2 AND k.s1 = n.s1 GROUP BY g.t1, g.t2"""
        for i, (tag, _) in enumerate(parts)
    )
    return f"WITH {BASE}, n AS (SELECT s.s1, count(gold.cand) AS ng FROM s1s s LEFT JOIN gold ON gold.s1 = s.s1 GROUP BY s.s1), {ctes}, best AS ({scores}) SELECT exclusive, kind, t1::INT AS t1, t2::INT AS t2, round(f, 6) AS macro_f05 FROM best ORDER BY round(f, 6) DESC, place, t1 DESC, t2 DESC LIMIT 1"


LIST = lambda src, col: f"SELECT s.s1 AS source1_entity_id, coalesce(string_agg(p.cand, ',' ORDER BY p.p DESC, p.cand), '') AS {col} FROM s1s s LEFT JOIN (SELECT s1, cand, max(p) AS p FROM {src} GROUP BY s1, cand) p ON p.s1 = s.s1 GROUP BY s.s1"

ORACLE = {
    "minimum_slice": f"WITH {NORM}, {KEY}, {_postings('name', CAP)}, s1s AS ({biz.S1}), base AS (SELECT DISTINCT key.s1, key.cand, coalesce(sim, 0.0) AS p FROM key LEFT JOIN scr ON scr.s1 = key.s1 AND scr.cand = key.cand), scored AS (SELECT s1, cand, {EXCL} AS p FROM base), {PRED} {LIST('pred', 'matched_entity_ids')}",
    "split_scan": biz.RAW,
    "normalize_names": f"WITH {NORM} SELECT entity_id, src, country, name_norm, name_core, {_sorted('core_set')} AS core_set, core_first, {_sorted('legal')} AS legal, acronym, {_sorted('name_digits')} AS name_digits, addr_norm, {_sorted('addr_set')} AS addr_set, postal, {_sorted('nums')} AS nums, landmark FROM rec",
    "load_summary": f"WITH {NORM} SELECT src, country, count(*) AS n FROM rec GROUP BY ALL",
    "token_idf": f"WITH {NORM}, {IDF} SELECT country, kind, token, round(idf, 6) AS idf FROM idf",
    "default_idf": f"WITH {NORM} SELECT country, round(ln(count(*) + 1) + 1, 6) AS default_idf FROM rec GROUP BY country",
    "s1_name_freq": f"WITH {NORM} SELECT country, name_core, count(*) AS s1_name_freq FROM rec WHERE src = 'S1' GROUP BY ALL",
    "trigram_postings": f"WITH {NORM}, {_postings('name')} SELECT country, src, side, entity_id, gram, round(weight, 6) AS weight FROM pst",
    "prune_grams": f"WITH {NORM}, {_postings('name', 200)} SELECT country, src, side, count(*) AS kept, count(DISTINCT gram) AS grams FROM pst GROUP BY ALL",
    "sparse_topk_name": f"WITH {NORM}, {_postings('name')} {_fwd('', 10)}",
    "sparse_topk_full": f"WITH {NORM}, {_postings('full', CAP)} {_fwd('', 10)}",
    "sparse_topk_rev": f"WITH {NORM}, {_postings('name', CAP)} {_rev('')}",
    "key_block": f"WITH {NORM}, {KEY} SELECT * FROM key",
    "dense_topk_fwd": _dense("q", "t", 15),
    "dense_topk_rev": _dense("t", "q", 5),
    "candidate_union_cap": f"WITH {NORM}, {_union(whole=True)} SELECT * FROM cnd",
    "candidate_union_dense": f"WITH {NORM}, {BASE}, {DENSE}, {_union('dns')} SELECT * FROM cnd",
    "scan_integrity": f"SELECT src, count(*) AS lines, count(*) AS rows, true AS ok FROM ({biz.RAW}) r GROUP BY src",
    "gold_scan": biz.GOLD,
    "pair_probability_scan": f"SELECT s1, cand, max(p) AS p_xenc FROM ({biz.SCORED}) x GROUP BY s1, cand",
    "embedding_scan": f"WITH {NORM}, {BASE}, {DENSE} SELECT s1, cand, cos_emb FROM dns",
    "embedding_writer": f"SELECT s1 AS source1_entity_id, cand AS candidate_entity_id, printf('%.4f', max(p)) AS cos_emb FROM ({biz.SCORED}) x GROUP BY s1, cand",
    "pair_texts": f"WITH {NORM} SELECT entity_id, concat('name: ', name_norm, ' | address: ', addr_norm) AS pair_text FROM rec",
    "name_frequency_attach": f"WITH {NORM}, {CAND}, {PAIRS}, frq AS (SELECT country, name_core, count(*) AS n FROM rec WHERE src = 'S1' GROUP BY ALL) SELECT s1, cand, coalesce(n, 1) AS s1_name_freq FROM prs LEFT JOIN frq ON frq.country = prs.country AND frq.name_core = prs.n1",
    "combo": f"SELECT s1, cand, round(0.5::DOUBLE * p + 0.25::DOUBLE * round(p * 100, 3) / 100 + 0.25::DOUBLE * round(p * 50, 3) / 100, 6) AS combo FROM ({biz.SCORED}) x",
    "fold_integrity": f"SELECT 0::BIGINT AS split_entities, 5::BIGINT AS folds, count(*) AS pairs FROM ({biz.SCORED}) x",
    "decision_search": _search(),
    "scorer_coverage": f"SELECT round(avg(CASE WHEN CAST(round(p * 1000) AS BIGINT) % 2 = 0 THEN 1.0::DOUBLE ELSE hit END), 6) AS coverage FROM (SELECT x.*, CASE WHEN max(CASE WHEN CAST(round(p * 1000) AS BIGINT) % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY s1, cand) = 1 THEN 1.0::DOUBLE ELSE 0.0 END AS hit FROM ({biz.SCORED}) x) y",
    "positive_rate": f"WITH {BASE}, top AS (SELECT s1, cand FROM scored QUALIFY row_number() OVER (PARTITION BY s1 ORDER BY p DESC, cand) <= 2) SELECT round(avg(CASE WHEN g.cand IS NULL THEN 0.0::DOUBLE ELSE 1.0 END), 6) AS positive_rate FROM top t LEFT JOIN gold g ON g.s1 = t.s1 AND g.cand = t.cand",
    "embedding_candidates": f"WITH {NORM}, {BASE} SELECT s.s1, s.cand, max(p) AS cos_emb FROM scored s JOIN rec a ON a.entity_id = s.s1 AND a.src = 'S1' JOIN rec b ON b.entity_id = s.cand AND b.src <> 'S1' AND a.country = b.country GROUP BY ALL",
    "pair_features_sets": f"""WITH {NORM}, {CAND}, {PAIRS} SELECT s1, cand, round(CASE WHEN greatest(length(n1), length(n2)) = 0 THEN 1.0 ELSE 1 - levenshtein(n1, n2) / greatest(length(n1), length(n2)) END, 6) AS n_lev, round({_jac('c1', 'c2')}, 6) AS n_jacc, CASE WHEN f1 = f2 THEN 1 ELSE 0 END AS n_first_eq,
CASE WHEN (y1 <> '' AND list_contains(c2, y1)) OR (y2 <> '' AND list_contains(c1, y2)) THEN 1 ELSE 0 END AS n_acronym, CAST(len(c1) AS INT) AS n_len1, CAST(len(c2) AS INT) AS n_len2, CASE WHEN len(l1) > 0 AND len(l2) > 0 AND len(list_intersect(l1, l2)) = 0 THEN 1 ELSE 0 END AS legal_conflict,
CASE WHEN list_sort(d1) <> list_sort(d2) THEN 1 ELSE 0 END AS name_digit_conflict, round({_jac('a1', 'a2')}, 6) AS a_jacc, CASE WHEN p1 <> '' AND p2 <> '' THEN CASE WHEN p1 = p2 THEN 1.0::DOUBLE ELSE 0.0 END END AS zip_eq, CASE WHEN p1 <> '' AND p2 <> '' THEN CASE WHEN p1[1:3] = p2[1:3] THEN 1.0::DOUBLE ELSE 0.0 END END AS zip_prefix_eq,
CASE WHEN len(u1) > 0 AND len(u2) > 0 THEN round({_jac('u1', 'u2')}, 6) END AS num_jacc, CAST(len(a1) AS INT) AS a_len1, CAST(len(a2) AS INT) AS a_len2, m1 AS landmark1, m2 AS landmark2, CASE WHEN src2 = 'S3' THEN 1 ELSE 0 END AS is_s3 FROM prs""",
    "pair_features_idf": f"WITH {NORM}, {CAND}, {PAIRS}, {IDF}, {_idf('c', 'name', 'x')}, {_idf('a', 'addr', 'y')} SELECT p.s1, p.cand, round(x.o, 6) AS n_idf, round(x.u, 6) AS n_idf_unmatched_max, round(y.o, 6) AS a_idf, round(y.u, 6) AS a_idf_unmatched_max FROM prs p LEFT JOIN x ON x.s1 = p.s1 AND x.cand = p.cand LEFT JOIN y ON y.s1 = p.s1 AND y.cand = p.cand",
    "pair_features_jaro_winkler": f"WITH {NORM}, {CAND}, {PAIRS} SELECT s1, cand, round(jaro_winkler_similarity(n1, n2), 6) AS n_jw FROM prs",
    "context_features": f"""WITH {BASE}, v AS (SELECT s1, cand, p AS cos_name, round((3 * p) % 1.0, 3) AS cos_full, round(p * p, 6) AS combo FROM scored),
r AS (SELECT *, {_context()}, count(*) OVER (PARTITION BY s1) AS n_cands_s1, count(*) OVER (PARTITION BY cand) AS n_s1_per_cand, row_number() OVER (PARTITION BY s1 ORDER BY combo DESC) AS rn, max(combo) OVER (PARTITION BY s1) AS top FROM v),
t AS (SELECT *, max(CASE WHEN rn = 2 THEN combo END) OVER (PARTITION BY s1) AS second FROM r)
SELECT * EXCLUDE (rn, top, second) REPLACE (round(cos_name, 6) AS cos_name, round(cos_full, 6) AS cos_full, round(combo, 6) AS combo), round(CASE WHEN n_cands_s1 = 1 THEN 1.0 ELSE top - second END, 6) AS combo_second_gap_s1, CASE WHEN combo_rank_s1 = 1 AND combo_rank_cand = 1 THEN 1 ELSE 0 END AS mutual_best FROM t""",
    "pair_probability_merge": f"WITH {BASE}, prb AS (SELECT s1, cand, max(p) AS p_xenc FROM scored WHERE CAST(round(p * 1000) AS BIGINT) % 2 = 0 GROUP BY s1, cand) SELECT s.s1, s.cand, coalesce(p_xenc, 0.5) AS p_xenc, CASE WHEN p_xenc IS NULL THEN 0 ELSE 1 END AS p_xenc_present FROM scored s LEFT JOIN prb ON prb.s1 = s.s1 AND prb.cand = s.cand",
    "scorer_topk": f"WITH {BASE} SELECT s1, cand, p AS combo FROM scored QUALIFY row_number() OVER (PARTITION BY s1 ORDER BY p DESC, cand) <= 2",
    "labelled_folds": f"WITH {BASE} SELECT s.s1, s.cand, CASE WHEN g.cand IS NULL THEN 0.0::DOUBLE ELSE 1.0 END AS y, CAST(CAST(substr(s.s1, 4) AS BIGINT) % 5 AS INT) AS fold FROM scored s LEFT JOIN gold g ON g.s1 = s.s1 AND g.cand = s.cand",
    "exclusivity": f"WITH {BASE} SELECT s1, cand, {EXCL} AS p FROM scored",
    "threshold_decision": f"WITH {BASE}, {PRED} SELECT * FROM pred",
    "expected_f_decision": _expected(),
    "macro_f05": f"WITH {BASE}, {PRED}, {_entity()} SELECT round(avg(f05), 6) AS macro_f05 FROM ent",
    "threshold_grid": _grid(),
    "gold_explode": biz.GOLD,
    "id_list_output": f"WITH {BASE} {LIST('scored', 'candidate_entity_ids')}",
    "output_checks": f"WITH {NORM}, {BASE}, {PRED} SELECT (SELECT count(*) FROM pred WHERE cand NOT IN (SELECT entity_id FROM rec WHERE src <> 'S1')) AS unknown_ids, 0::BIGINT AS not_candidates",
    "gold_diagnostics": f"WITH {NORM}, {BASE} SELECT (SELECT count(DISTINCT s1) FROM s1s) AS s1_records, (SELECT count(*) FROM s1s WHERE s1 NOT IN (SELECT s1 FROM gold)) AS singletons, (SELECT count(*) FROM gold) AS gold_pairs, (SELECT count(*) FROM gold g JOIN rec a ON a.entity_id = g.s1 JOIN rec b ON b.entity_id = g.cand WHERE a.country IS DISTINCT FROM b.country) AS cross_country, (SELECT count(*) FROM (SELECT cand FROM gold GROUP BY cand HAVING count(DISTINCT s1) > 1)) AS shared_targets",
    "match_set_sizes": f"WITH {BASE} SELECT n AS set_size, count(*) AS entities FROM (SELECT s.s1, count(g.cand) AS n FROM s1s s LEFT JOIN gold g ON g.s1 = s.s1 GROUP BY s.s1) GROUP BY n ORDER BY n LIMIT 10",
    "blocking_recall": f"WITH {BASE}, {FLAGGED}, h AS (SELECT f.*, g.cand IS NOT NULL AS hit FROM flagged f LEFT JOIN gold g ON g.s1 = f.s1 AND g.cand = f.cand), n AS (SELECT count(*) AS total FROM gold) " + " UNION ALL ".join(f"SELECT '{f}' AS blocker, CAST(count(CASE WHEN {c} THEN 1 END) AS BIGINT) AS pairs, round(count(CASE WHEN {c} AND hit THEN 1 END) / greatest(any_value(total), 1), 6) AS recall FROM h CROSS JOIN n" for f, c in [("all", "true"), *[(f, f"{f} = 1") for f in blocking.FLAGS]]),
    "fully_recalled": f"WITH {BASE} SELECT round(avg(whole), 6) AS fully_recalled FROM (SELECT g.s1, min(CASE WHEN s.cand IS NULL THEN 0 ELSE 1 END) AS whole FROM gold g LEFT JOIN scored s ON s.s1 = g.s1 AND s.cand = g.cand GROUP BY g.s1)",
    "score_report": f"WITH {BASE}, {PRED}, {_entity()} SELECT coalesce(country, 'all') AS grp, count(*) AS entities, round(avg(f05), 6) AS macro_f05 FROM ent GROUP BY GROUPING SETS ((country), ()) UNION ALL SELECT 'singletons', count(*), round(avg(f05), 6) FROM ent WHERE s1 NOT IN (SELECT s1 FROM gold)",
    "oracle_ceiling": f"WITH {BASE}, best AS (SELECT g.s1, g.cand FROM gold g SEMI JOIN scored s ON s.s1 = g.s1 AND s.cand = g.cand), {_entity('best')} SELECT round(avg(f05), 6) AS macro_f05 FROM ent",
    "match_rate": f"WITH {BASE}, {PRED} SELECT country, count(*) AS entities, round(avg(CASE WHEN s1 IN (SELECT s1 FROM pred) THEN 1 ELSE 0 END), 6) AS match_rate FROM s1s GROUP BY country",
}
