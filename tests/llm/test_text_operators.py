import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from weftline.llm import buckets, decontam, line_dedup, near_dedup, pii, quality
from weftline.llm.shared import Scratch

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def spans(t):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, t or "") if valid(k, m.group())]


def test_pii_base_spans(docs):
    rnd = random.Random(2)
    bits = ["a@b.c", "a@b", "a@b.c_d@e.f", "@x.y", "1.2.3.4", "0001.2.3.255", "1.2.3.4.5.6.7.8", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824", "+1+2", "++33 1 23 45 67 89.", "12", " ", "é", "🙂", "\x01", "\x02", "x", "99999999999999999999999", "tel "]
    rows = [(0, None), (1, ""), (2, "9" * 30_000), (3, "a" * 20_000), (None, "a@b.c")] + [(i, "".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 15)))) for i in range(4, 400)]
    got = {r.doc_id: sorted((s.kind, s.start, s.end) for s in r.spans if s.base) for r in pii.find_pii(docs(rows)).collect()}
    assert got == {i: sorted(spans(t)) for i, t in rows}


def test_pii_query_digest(docs, spark, tmp_path):
    rows = [(1, "mail a@b.com or 10.0.0.1, +49 30 123456-7"), (2, "nothing"), (3, None)]
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    for r in pii.op8_pii(spark, str(tmp_path)).collect():
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in spans(dict(rows)[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert r.spans == want


def test_pii_adds_voted_spans(docs):
    loose = [(i, f"please call phone ({200 + i}) 555-{1000 + i} today") for i in range(40)]
    strict = [(100 + i, f"phone +1 (743) 555-{1000 + i} now") for i in range(40)]
    got = {r.doc_id: [(s.kind, s.m) for s in r.spans] for r in pii.find_pii(docs(loose + strict)).collect()}
    assert got[0] == [("phone", "(200) 555-1000")]
    assert pii.find_pii(docs([])).collect() == []


def test_pii_finds_secrets_and_numbers(docs):
    rnd = random.Random(31)
    hexa = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    secrets = [(i, f'some words token = "{hexa(40)}" and more') for i in range(40)]
    plain = [(100 + i, "averylongwordwithoutanydigitsinside and commit " + "x" * 30) for i in range(20)] + [(200 + i, f"see commit {hexa(12)} of version 1.2.3") for i in range(20)]
    numbers = [(300 + i, f"ssn {rnd.randrange(100, 600)}-{rnd.randrange(10, 99)}-{rnd.randrange(1000, 9999)} on file") for i in range(30)]
    got = {r.doc_id: [(s.kind, s.m) for s in r.spans] for r in pii.find_pii(docs(secrets + plain + numbers)).collect()}
    assert all(got[i] == [("secret", t.split('"')[1])] for i, t in secrets)
    assert not any(got[i] for i, _ in plain)
    assert all([k for k, _ in got[i]] == ["id"] for i, _ in numbers)


def test_pii_of_a_text_with_many_matches(docs):
    text = " ".join(f"u{i}@host{i % 9}.example.com" for i in range(6000))
    got = pii.find_pii(docs([(1, text)])).first().spans
    assert sorted((s.kind, s.start, s.end) for s in got) == sorted(spans(text))


def test_distance_against_dynamic_programming():
    def dp(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    rnd = random.Random(1)
    for _ in range(800):
        a, b = ([rnd.randrange(4) for _ in range(rnd.randrange(30))] for _ in range(2))
        most, d = rnd.randrange(12), dp(a, b)
        assert near_dedup.distance(a, b, most) == (d if d <= most else most + 1)


def test_near_dedup_against_all_pairs(docs):
    rnd = random.Random(4)
    rows = []
    for i in range(12):
        base = [f"w{rnd.randrange(10_000)}" for _ in range(rnd.choice([30, 100, 400]))]
        for _ in range(rnd.choice([1, 2, 8])):
            w = list(base)
            for _ in range(len(w) // 50):
                w[rnd.randrange(len(w))] = f"n{rnd.randrange(10_000)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(900, rows[0][1].upper()), (901, rows[0][1]), (902, None), (903, ""), (904, "one"), (905, "one"), (906, "a b c"), (None, "null id")]
    got = {r.doc_id: r for r in near_dedup.near_dedup(docs(rows)).collect()}
    words = {i: re.findall(r"\w+", (t or "").lower()) for i, t in rows if i is not None}
    root = {i: i for i in words}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in words:
        for b in words:
            most = int(0.2 * max(len(words[a]), len(words[b])) + 1e-9)
            if a < b and near_dedup.distance(words[a], words[b], most) <= most:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {i: got[i].class_id for i in words} == {i: find(i) for i in words}
    assert got[None].class_id is None and got[None].kept
    assert all(r.kept == (r.doc_id == r.class_id) for i, r in got.items() if i is not None)
    assert near_dedup.near_dedup(docs([])).collect() == []


def test_near_dedup_of_documents_that_share_a_passage(docs):
    """Buckets full of documents that are no copies of their leader: pairs among them are found all the same."""
    rnd = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(passage + [f"u{i}x{j}" for j in range(40)])) for i in range(60)]
    expect = {i: i for i in range(60)}
    for k, i in enumerate(range(0, 60, 6)):
        w = rows[i][1].split()
        at = rnd.randrange(len(w) - 6)
        w[at : at + 6] = [f"n{k}x{j}" for j in range(6)]  # 86 of 106 shingles are shared: just above 0.8
        rows.append((100 + k, " ".join(w)))
        expect[100 + k] = i
    got = {r.doc_id: r.class_id for r in near_dedup.near_dedup(docs(rows)).collect()}
    assert got == expect


def test_line_dedup(docs):
    a = "This is the first long line that many documents do share, word for word and more, and so it goes on for a while longer"
    near = a.replace("many", "mane")
    rows = [(3, f"{a}\nshort\nown line of the third document here"), (1, f"short\n{a}\n{a}"), (2, a.upper() + "!"), (4, near), (5, None), (6, ""), (7, "short"), (None, a)]
    got = {r.doc_id: r.gone_lines for r in line_dedup.line_dedup(docs(rows)).collect()}
    assert got == {1: [2], 2: [0], 3: [0, 1], 4: [0], 7: [0]}
    assert line_dedup.line_dedup(docs([])).collect() == []


def test_line_dedup_stage(docs, spark):
    line = "one line of more than twenty-four characters"
    out = {r.doc_id: (r.text, r.n_chars) for r in line_dedup.stage(spark, docs([(1, line), (2, line), (3, f"{line}\nx"), (4, None), (5, "")]), "").collect()}
    assert out == {1: (line, len(line)), 3: ("x", 1), 4: (None, 0), 5: ("", 0)}


def test_wand_equals_exhaustive_search():
    rnd = random.Random(6)
    vocab = [f"t{i}" for i in range(60)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(1, 25))) + ". " + " ".join(rnd.choice(vocab) for _ in range(4))) for i in range(90)]
    ix = decontam.Index(items, 0.6)
    for _ in range(200):
        terms = set(rnd.sample(vocab, rnd.randrange(1, 50)))
        want = {}
        for t in terms & ix.lists.keys():
            for k, x in zip(ix.lists[t][0], ix.lists[t][1]):
                want[k] = want.get(k, 0) + x
        want = {k: round(v, 9) for k, v in want.items() if v >= ix.own[k] - 1e-9}
        assert {k: round(v, 9) for k, v in ix.search(terms)} == want


def test_decontaminate(docs, spark):
    rnd = random.Random(7)
    text = lambda n: " ".join(f"v{rnd.randrange(3000)}" for _ in range(n))
    items = [(i, f"{text(rnd.randrange(8, 50))}. {text(5).capitalize()}.") for i in range(30)] + [(None, "the answer to null ids is this one. Yes it is so."), (40, None), (41, "")]
    rows = [(i, f"{text(rnd.randrange(300))} {items[i][1].upper() if i % 2 else items[i][1]} {text(rnd.randrange(300))}") for i in range(30)]
    rows += [(100 + i, text(200)) for i in range(30)] + [(200, None), (201, ""), (None, items[3][1]), (202, items[5][1].split(". ")[0])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = []
    for size in (16_000_000, 1000):  # one block, several blocks: the same scores
        found.append({(r.doc_id, r.item_id, round(r.score, 9), r.first_word) for r in decontam.decontaminate(docs(rows), bench, max_chars=size).collect()})
        assert {r[:2] for r in found[-1]} == {(i, i) for i in range(30)} | {(None, 3)}
    assert found[0] == found[1]
    assert decontam.decontaminate(docs([]), bench).collect() == []
    assert decontam.decontaminate(docs(rows), bench.limit(0)).collect() == []


def test_quality_held_out(spark, docs):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("etaoin") for _ in range(rnd.randrange(1, 8)))
    rows, labels = [], []
    for i in range(1200):
        w, kind = [word() for _ in range(rnd.randrange(30, 120))], rnd.choice(["good"] * 4 + ["junk", "toxic"])
        if kind == "junk":
            w = [x.upper() + "!!" for x in w]
        if kind == "toxic":
            for _ in range(3):
                w[rnd.randrange(len(w))] = rnd.choice(["vile", "nasty"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    made = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.keep for r in quality.classify(docs(rows + [(5000, None), (5001, ""), (None, "null id")]), made.where("doc_id < 800")).collect()}
    held = [(q == 1 and t == 0) == got[i] for i, q, t in labels if i >= 800]
    assert sum(held) / len(held) > 0.95
    assert len(got) == 1203


def test_quality_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.keep for r in quality.classify(docs([(1, "a"), (2, None)]), none).collect()] == [True, True]
    assert quality.classify(docs([]), none).collect() == []


def test_edits_within_equals_full_matrix():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            new = [i]
            for j, d in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return row[-1]

    rng = random.Random(3)
    words = ["".join(rng.choices("abé🙂", k=rng.randint(0, 12))) for _ in range(3000)]
    for a, b in zip(words, words[1:]):
        most = rng.randint(0, 8)
        assert line_dedup.edits_within(a, b, most) == (distance(a, b) <= most), (a, b, most)


def test_item_of_more_pairs_than_a_portion(spark):
    pairs = spark.createDataFrame([(0, i) for i in range(1, 200)] + [(i, 300) for i in range(150)] + [(5, 6)], "a long, b long")
    payload = spark.createDataFrame([(i, f"t{i}") for i in range(301)], "id long, data string")
    found = buckets.dealt(pairs, payload).collect()
    assert sorted((r.a, r.b) for r in found) == sorted(tuple(r) for r in pairs.collect())
    assert all(r.x == f"t{r.a}" and r.y == f"t{r.b}" for r in found)


def test_blocks_round_trip():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 1000):
        rows = {"key": rnd.integers(0, 1 << 63, n).astype("<u8"), "id": rnd.integers(-(1 << 62), 1 << 62, n).astype("<i8"), "size": rnd.integers(0, 1 << 32, n).astype("<u4"), "sig": rnd.integers(0, 1 << 32, n).astype("<u4"), "pos": rnd.integers(0, 1 << 32, n).astype("<u4"), "at": rnd.integers(0, 256, n).astype("u1")}
        back = buckets.unpack(buckets.pack(rows))
        assert all((back[c] == rows[c]).all() for c in rows)


def test_buckets_against_brute_force(spark):
    """Members that meet, with small and large buckets, a bucket of most rows, repeated rows and an empty table."""
    rnd = random.Random(21)
    rows = {(rnd.randrange(60) if rnd.random() < 0.3 else rnd.choice([1000, 1001]), i % 400) for i in range(1500)}
    frame = spark.createDataFrame([(k, i % 7, i, 10, 0, 0) for k, i in sorted(rows)], "key long, at int, id long, size int, sig int, pos int").repartition(3)
    pairs, hot = buckets.meet(frame, buckets.read_members, lambda x, y: x["size"] == y["size"], Scratch(spark, "meet"), "met")
    members = {}
    for k, i in rows:
        members.setdefault(k, set()).add(i)
    small = [m for m in members.values() if len(m) <= buckets.ALL]
    assert {(r.a, r.b) for r in pairs.collect()} == {(a, b) for m in small for a in m for b in m if a < b}
    stars = [(r.a, r.b) for r in pairs.where("star").collect()]
    assert len(stars) == sum(len(m) - 1 for m in small)
    got = {}
    for r in hot.collect():
        got.setdefault(r.key, set()).add(r.id)
    assert sorted(map(sorted, got.values())) == sorted(sorted(m) for m in members.values() if len(m) > buckets.ALL)
    pairs, hot = buckets.meet(frame, buckets.read_members, lambda x, y: (x["id"] - y["id"]) % 3 == 0, Scratch(spark, "meet"), "met", 10_000)
    got = {(r.a, r.b) for r in pairs.collect()}  # every member pairs with the leader of all that fit, and no other
    assert hot.collect() == [] and all((a - b) % 3 == 0 for a, b in got)
    for m in members.values():
        for c in range(3):
            own = sorted(i for i in m if i % 3 == c)
            assert len(own) < 2 or any(all((min(i, lead), max(i, lead)) in got for i in own if i != lead) for lead in own)
    pairs, hot = buckets.meet(frame.limit(0), buckets.read_members, lambda x, y: x["size"] == y["size"], Scratch(spark, "meet"), "met")
    assert pairs.collect() == [] and hot.collect() == []


def test_line_classes_of_colliding_hashes(docs, spark):
    """Lines whose first hashes collide are told apart, and equal ones are found all the same."""
    rnd = random.Random(22)
    texts = [" ".join(rnd.choice("abcdefgh") * 3 for _ in range(6)) for _ in range(150)]
    rows = [(i, texts[i % 150]) for i in range(300)]
    frame = docs(rows).withColumn("text_key", line_dedup.text_key(F.col("text"))).select("doc_id", "text", "text_key")
    gone = {r.doc_id for r in line_dedup.duplicate_lines(frame, 1.0, Scratch(spark, "lines"), id_bits=4).collect()}
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    assert gone == {i for i, t in rows if first[t] != i}


def test_upper_bound_of_edits():
    rnd = random.Random(23)
    for _ in range(500):
        a = "".join(rnd.choice("abc") for _ in range(rnd.randrange(80)))
        b = list(a)
        for _ in range(rnd.randrange(8)):
            if b:
                b[rnd.randrange(len(b))] = rnd.choice(["", "x", "ab"])
        b = "".join(b)
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            new = [i]
            for j, d in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        assert line_dedup._edits_at_most(a, b) >= row[-1]
        for most in (0, 1, 3, 8):
            assert line_dedup.edits_within(a, b, most) == (row[-1] <= most)


def test_line_keys_recall():
    """Lines at edit similarity 0.9, letters replaced all over them: by length at least nine in ten share a key and pass the filter."""
    rnd = random.Random(24)
    vocab = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(2, 10))) for _ in range(5000)]
    for words in (3, 5, 12, 30, 80):
        met = 0
        for _ in range(150):
            a = " ".join(rnd.choice(vocab) for _ in range(words))
            if len(a) < 10:
                a += " etaoin"
            b = list(a)
            for at in rnd.sample(range(len(b)), len(b) // 10):
                b[at] = rnd.choice("bcfgjkmp")
            x, y = (line_dedup.sketches([t], 0.9) for t in (a, "".join(b)))
            far = lambda p, q: ((p[4] ^ q[4]) & 0xFFFFFFFF).bit_count()
            common = [(len(set(np.frombuffer(p[2], "<u4")) & set(np.frombuffer(q[2], "<u4"))), far(p, q), p[4] != 0) for p in x for q in y if p[1] == q[1]]
            met += any(d <= line_dedup.FAR and (n > 1 or n == 1 and sig and d <= line_dedup.NEAR) for n, d, sig in common)
        assert met >= 135, words


def near_lines(docs, rows):
    """Removed first lines by ``line_dedup``, and by comparing all pairs."""
    got = {r.doc_id for r in line_dedup.line_dedup(docs(rows)).collect()}
    norm = {i: line_dedup.normalised(t)[0] for i, t in rows}
    root = {i: i for i in norm}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in norm:
        for b in norm:
            if a < b and line_dedup.edits_within(norm[a], norm[b], int(max(len(norm[a]), len(norm[b])) * 0.1 + 1e-9)):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return got, {i for i in norm if find(i) != i}


def test_line_dedup_against_all_pairs(docs):
    """Lines with words changed, dropped and misspelt, among others of the same vocabulary."""
    rnd = random.Random(12)
    vocab = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(2, 10))) for _ in range(300)]
    rows = []
    for i in range(120):
        w = [rnd.choice(vocab) for _ in range(rnd.choice([8, 15, 39]))]
        rows.append((len(rows), " ".join(w)))
        v = list(w)
        at = rnd.randrange(len(v))
        if i % 3 == 0:
            v[at] = v[at][:1] + "z" + v[at][2:]
        elif i % 3 == 1:
            del v[at]
        else:
            v[at] = rnd.choice(vocab)
        rows.append((len(rows), " ".join(v)))
    got, want = near_lines(docs, rows)
    assert len(want) > 90 and got == want


def test_line_dedup_of_chains(docs):
    """Chains of lines, each linked to its neighbours only."""
    rnd = random.Random(13)
    vocab = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(2, 10))) for _ in range(2000)]
    rows = []
    for _ in range(4):
        w = [rnd.choice(vocab) for _ in range(30)]
        at = list(range(30))
        rnd.shuffle(at)
        for k in range(30):
            rows.append((len(rows), " ".join(w)))
            w[at[k]] = "".join(rnd.choice("bcfgjkmp") for _ in w[at[k]])
    order = list(range(len(rows)))
    rnd.shuffle(order)
    rows = [(order[i], t) for i, t in rows]
    got, want = near_lines(docs, rows)
    assert got == want


def test_near_dedup_of_pairs_with_scattered_edits(docs):
    """Copies in which 15 of 100 words are replaced, all over the text."""
    rnd = random.Random(14)
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(100))) for i in range(40)]
    for i in range(40):
        w = rows[i][1].split()
        for at in rnd.sample(range(100), 15):
            w[at] = f"n{i}x{at}"
        rows.append((100 + i, " ".join(w)))
    got = {r.doc_id: r.class_id for r in near_dedup.near_dedup(docs(rows)).collect()}
    assert got == {i: i % 100 for i, _ in rows}


def test_near_dedup_of_scattered_edits_in_full_buckets(docs):
    """Copies with six scattered edits in 100 words, among documents that share a passage."""
    rnd = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(passage + [f"u{i}x{j}" for j in range(40)])) for i in range(60)]
    expect = {i: i for i in range(60)}
    for k, i in enumerate(range(0, 60, 6)):
        w = rows[i][1].split()
        for _ in range(6):
            w[rnd.randrange(len(w))] = f"n{rnd.randrange(10_000)}"
        rows.append((100 + k, " ".join(w)))
        expect[100 + k] = i
    got = {r.doc_id: r.class_id for r in near_dedup.near_dedup(docs(rows)).collect()}
    assert got == expect


def test_no_link_of_a_large_bucket_is_lost(spark, monkeypatch):
    """Links between members that neither leader is linked to, in buckets of many blocks, and pairs that ``fits`` or ``may`` rule out."""
    monkeypatch.setattr(buckets, "_BLOCK", 16)
    n = 150
    frame = spark.createDataFrame([(k, 0, i, 10 + i % 2, 0, i) for k in (1, 2) for i in range(n) if k == 1 or i % 3 == 0], "key long, at int, id long, size int, sig int, pos int").repartition(3)
    data = frame.select("id").distinct()
    extra = lambda ids: ids.selectExpr("id", "0 AS level", "CAST(lpad(CAST(id % 2 AS STRING), 4, '0') AS BINARY) AS extra")
    may = lambda x, y: (x["extra"] == y["extra"]).all(1)
    payload = lambda ids: data.join(ids, "id").selectExpr("id", "CAST(CAST(id AS STRING) AS BINARY) AS data")
    judge = lambda x, y: abs(int(x) - int(y)) == 50
    linked, roots = buckets.links(frame, buckets.read_members, lambda x, y: x["size"] == y["size"], "size = lead_size", extra, may, payload, judge, Scratch(spark, "links"))
    assert {(r.a, r.b) for r in linked.collect()} == {(i, i + 50) for i in range(n - 50)}
    assert {r.node: r.root for r in roots.collect()} == {i: i % 50 for i in range(n)}


def test_what_leaves_a_square_is_no_more_than_its_members(spark, monkeypatch):
    """A large bucket of items that are all linked, and share several keys, gives as many links as connect it and verifies a pair at one key."""
    monkeypatch.setattr(buckets, "_BLOCK", 64)
    n = 60
    frame = spark.createDataFrame([(k, k, i, 10, 0, 0) for k in range(3) for i in range(n)], "key long, at int, id long, size int, sig int, pos int")
    rows = frame.selectExpr("id", "id AS root", "key", "at", "size", "sig", "pos")
    members = buckets.opened(rows, Scratch(spark, "opened"))
    assert {(r.id, len(r.m)) for r in members.collect()} == {(i, 3) for i in range(n)}
    extra = frame.selectExpr("id", "0 AS level", "CAST('x' AS BINARY) AS extra").distinct()
    payload = frame.selectExpr("id", "CAST(id AS STRING) AS data").distinct()
    every = lambda x, y: np.ones(len(x["id"]), bool)
    found = [(r.a, r.b) for r in buckets.crossed(members, extra, payload, every, every, lambda x, y: True).collect()]
    assert len(found) == n - 1 and {i for p in found for i in p} == set(range(n))
    near = [(r.a, r.b) for r in buckets.crossed(members, extra, payload, every, every, lambda x, y: abs(int(x) - int(y)) == 30).collect()]
    assert sorted(near) == [(i, i + 30) for i in range(30)]


def test_squares_in_turns_give_the_same_links(spark, monkeypatch):
    """A turn deals a part of the copies of members, about ``_SENT`` of each, and no pair is lost between turns."""
    monkeypatch.setattr(buckets, "_BLOCK", 16)
    n = 150
    frame = spark.createDataFrame([(k, k, i, 10, 0, 0) for k in (1, 2) for i in range(n) if k == 1 or i % 3 == 0], "key long, at int, id long, size int, sig int, pos int")
    members = buckets.opened(frame.selectExpr("id", "id AS root", "key", "at", "size", "sig", "pos"), Scratch(spark, "opened"))
    extra, payload = frame.selectExpr("id", "0 AS level", "CAST('x' AS BINARY) AS extra").distinct(), frame.selectExpr("id", "CAST(id AS STRING) AS data").distinct()
    every, tables = lambda x, y: np.ones(len(x["id"]), bool), []
    put = Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, name, codec=None: tables.append(put(self, df, name, codec)) or tables[-1])
    found = [(r.a, r.b) for r in buckets.crossed(members, extra, payload, every, every, lambda x, y: abs(int(x) - int(y)) == 50, Scratch(spark, "turns")).collect()]
    assert sorted(found) == [(i, i + 50) for i in range(n - 50)]
    parts = [sorted((r.a, r.b) for r in t.collect()) for t in tables if t.columns == ["a", "b"]]
    assert len(parts) == buckets.turns(members) >= 5 and sorted(p for t in parts for p in t) == sorted(found)
    assert max(map(len, parts)) < len(found) / 2
