"""Every stage and operator on rows of every kind: nulls, repeated rows, empty and long texts, empty tables, columns of any name."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import decontam, exact_dedup, line_dedup, near_dedup, packing, pii, quality, substring_dedup, token_files, warc

CLASHING = ["removed", "junk", "toxic", "keep", "key", "h", "root", "class_id", "gone_id", "gone_lines", "text_key", "row_key", "bucket", "score", "words", "node", "n"]


def rows(rnd):
    text = lambda n: " ".join("".join(rnd.choice("etaoinshr") for _ in range(rnd.randrange(2, 9))) for _ in range(n))
    made = [(i, text(60)) for i in range(30)]
    return made + [(100, None), (101, ""), (102, " \n\n "), (103, "one"), (None, text(50)), (None, None), (104, text(30_000)), (105, "x" * 200_000), (106, "ab " * 20_000), (5, made[5][1]), (7, text(40)), (200, made[9][1])]


@pytest.fixture
def wide(spark, tmp_path):
    """A folder with labels and benchmark, and a documents table with extra columns."""
    rnd = random.Random(41)
    data = rows(rnd)
    spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(5, 1, 0), (None, 0, 1), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "the question is of no one here. the answer neither"), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, None if k % 11 == 0 else "en", None if k % 13 == 0 else "s", len(t or "")) for k, (i, t) in enumerate(data)], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *[F.lit(c).alias(c) for c in CLASHING]), str(tmp_path), data


#: What of the rows above goes by stage: copies of lines and documents; all documents that hold nothing else go with their lines.
GOES = {
    "quality classifier": set(),
    "line dedup": {200},
    "near dedup": {200, 101, 102},
    "decontamination": set(),
}


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, wide, name, stage):
    docs, folder, data = wide
    out = stage(spark, docs, folder)
    if name == "packing":
        got = out.collect()
        assert {r.doc_id for r in got} == {i for i, _ in data}
        assert sum(r.length for r in got) == sum(r.doc_tokens for r in got if r.start == 0)
    else:
        assert out.columns == docs.columns
        got = [r.doc_id for r in out.collect()]
        assert sorted(map(str, got)) == sorted(str(i) for i, _ in data if i not in GOES[name])
    none = stage(spark, docs.limit(0), folder)
    assert none.collect() == [] and (name == "packing" or none.columns == docs.columns)


def test_pipeline_of_nothing(spark, wide, tmp_path):
    docs, folder, _ = wide
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []


OPERATORS = {
    "exact": lambda d, f: exact_dedup.exact_dedup(d),
    "substring": lambda d, f: substring_dedup.substring_dedup(d),
    "quality": lambda d, f: quality.classify(d, d.sparkSession.read.parquet(f"{f}/labels.parquet")),
    "near": lambda d, f: near_dedup.near_dedup(d),
    "tokens": lambda d, f: token_files.token_files(d, public_tokenizers.path("byte_bpe_50k.json")),
    "pii": lambda d, f: pii.find_pii(d),
    "warc": lambda d, f: warc.archive_pages(d, "doc_id", "source", "text"),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_operator_returns_every_row(wide, name):
    docs, folder, data = wide
    got = OPERATORS[name](docs, folder).collect()
    key = "page_id" if name == "warc" else "doc_id"
    assert sorted(str(r[key]) for r in got) == sorted(str(i) for i, _ in data)
    assert OPERATORS[name](docs.limit(0), folder).collect() == []


def test_line_dedup_and_decontamination_of_any_rows(spark, wide):
    docs, folder, data = wide
    assert {r.doc_id for r in line_dedup.line_dedup(docs).collect()} == {200}
    assert decontam.decontaminate(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).collect() == []
    assert sum(r.length for r in packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect() if r.doc_id == 100) == 1
