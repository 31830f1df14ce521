import hashlib

import numpy as np

import corpus_pipeline
from weftline.llm import warc

PAGES = "page_id long, url string, html string, key string, ts long"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES)


def test_archives(spark):
    big, other = "é" * 600, "b" * 1000
    rows = [(1, "http://a.b/x", big), (2, "http://a.b/x", big), (3, None, other), (4, "", "small"), (5, "http://A.b:80/?q=é y#z", "small"), (6, "https://www.c.d/", None), (7, "http://[bad", big), (8, "http://a.b/", "c" * 999), (9, "http://a.b/", "c" * 999), (None, "http://n.n/", other), (10, "u", "\r\n\r\nx")]
    got = {r.page_id: r for r in warc.archive_pages(pages(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        b = (h or "").encode()
        r = got[i]
        first = max((j for j, _, o in rows if o == h and j is not None), default=i) if len(b) >= 1000 else i
        revisit = i is not None and first != i
        if i is None:
            continue
        assert (r.payload_bytes, r.payload_digest) == (len(b), hashlib.sha1(b).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", first) if revisit else ("response", None))
    assert warc.archive_pages(pages(spark, [])).collect() == []


def test_history_is_in_order(spark):
    rows = [(i, f"http://h{i % 7}.x/{i % 3}", f"p{i}") for i in range(300)]
    got = sorted(warc.archive_pages(pages(spark, rows)).collect(), key=lambda r: r.position)
    keys = [(r.url_key, r.ts, r.page_id) for r in got]
    assert keys == sorted(keys) and len(keys) == 300


def test_captures_of_one_url_over_many_ranges(spark):
    """Most captures are of one URL; small blocks and a fan-in of two make several passes and ranges."""
    rows = [(i, "http://hot.x/" if i % 3 else f"http://h{i % 5}.x/", f"p{i}") for i in range(400)]
    made = pages(spark, rows).repartition(7)
    for fan_in, block in ((2, 8), (64, 4096), (3, 50)):
        got = sorted(warc.archive_pages(made, fan_in=fan_in, block=block).collect(), key=lambda r: r.position)
        keys = [(r.url_key, r.ts, r.page_id) for r in got]
        assert keys == sorted(keys) and len(keys) == 400
        seen = {}
        for r in got:
            assert r.capture == seen.get(r.url_key, 0)
            seen[r.url_key] = r.capture + 1


def test_archives_of_null_ids_and_repeated_rows(spark):
    big = "b" * 1200
    rows = [(None, "http://a.b/", big), (None, "http://a.b/", big), (None, None, None), (4, "http://a.b/", big), (4, "http://a.b/", big), (3, "http://a.b/", big), (None, "http://a.b/", "n" * 1500)]
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, str(r.refers_to)) for r in warc.archive_pages(pages(spark, rows)).collect())
    assert got == [("3", 1200, "revisit", "4"), ("4", 1200, "response", "None"), ("4", 1200, "response", "None"), ("None", 0, "response", "None"), ("None", 1200, "response", "None"), ("None", 1200, "response", "None"), ("None", 1500, "response", "None")]


def test_loser_tree():
    rnd = np.random.default_rng(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rnd.integers(0, 50, rnd.integers(0, 20)).tolist()) for _ in range(k)]
        assert list(warc.loser_tree(runs)) == sorted(x for r in runs for x in r)


def test_url_key():
    assert warc.url_key("https://www.Example.org:8080/a?b#c") == "org,example:8080)/a?b"
    assert warc.url_key(None) == "" and warc.url_key("http://x.y") == "y,x)/"


def test_pipeline(spark, tmp_path):
    """Planted rows: clean ones reach the packer whole, and each stage takes out what it should."""
    import random

    rnd = random.Random(3)
    text = lambda n: " ".join("".join(rnd.choice("etaoinshr") for _ in range(rnd.randrange(2, 9))) for _ in range(n))
    clean = [text(80) for _ in range(60)]
    toxic = [" ".join(w if k % 9 else "vile" for k, w in enumerate(text(80).split())) for _ in range(30)]
    item = text(20) + ". " + text(5) + "."
    words = clean[0].split()
    words[40] = "changed"
    rows = [(i, t) for i, t in enumerate(clean)] + [(100 + i, t) for i, t in enumerate(toxic)]
    rows += [(300, " ".join(words)), (301, text(50) + " " + item + " " + text(50)), (302, clean[1]), (303, clean[2] + "\n" + text(40))]
    root = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    labels = [(i, 1, int(100 <= i < 200)) for i, _ in rows if i < 200]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, root).collect()}
    assert set(range(60)) <= got
    assert not got & ({*range(100, 130)} | {300, 301, 302})
    assert 303 in got
