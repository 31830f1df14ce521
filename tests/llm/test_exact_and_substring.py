import hashlib
import random
import re

import numpy as np
import pytest

from weftline.llm import exact_dedup, fm_index, substring_dedup

ODD = [(None, None), (None, "a b"), (1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "x" * 50_000), (5, "x " * 50_000), (6, "a  b"), (7, "ab"), (8, "a b"), (9, "é"), (10, "é")]


def brute_exact(rows):
    norm = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i))
    return sorted(((i, min(g := groups[norm(t)])[2], len(g), i == min(g)[2], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows), key=str)


def test_exact(docs):
    rows = ODD + [(k, f"copy {k % 3}") for k in range(20, 60)]
    got = exact_dedup.exact_dedup(docs(rows), capacity=2).drop("bucket", "link").collect()
    assert sorted(map(tuple, got), key=str) == brute_exact(rows)


def test_exact_empty(docs):
    assert exact_dedup.exact_dedup(docs([])).collect() == []


def test_directory_covers_all_slots_once():
    counts = {0: 5, 1: 5, 40_000: 9, 65_535: 1}
    at = 0
    for first, depth in exact_dedup.directory(counts, 6):
        assert first == at
        at += 1 << (exact_dedup.MAX_DEPTH - depth)
    assert at == 1 << exact_dedup.MAX_DEPTH


def brute_substring(rows, window):
    words = {i: re.findall("[^ \t-\r]+", t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = {j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for j in range(k, k + window)}
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substring(docs, seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefgh") * rnd.choice([1, 2])
    passages = [[word() for _ in range(rnd.choice([49, 50, 51, 70, 130]))] for _ in range(5)]
    rows = [(0, None), (1, ""), (2, "one")]
    for i in range(3, 50):
        w = [word() for _ in range(rnd.randrange(40))]
        for _ in range(rnd.randrange(3)):
            p = rnd.choice(passages)
            a = rnd.randrange(len(p) // 3)
            w += p[a:] if rnd.random() < 0.5 else p
            w += [word() for _ in range(rnd.randrange(3))]
        rows.append((i, rnd.choice([" ", "\n", "  "]).join(w)))
    rows += [(100, rows[10][1]), (101, rows[10][1]), (102, "z " * 300), (103, "z " * 120)]
    got = {r[0]: tuple(r[1:]) for r in substring_dedup.substring_dedup(docs(rows)).collect()}
    assert got == brute_substring(rows, 50)


def test_substring_null_ids_and_empty(docs):
    text = " ".join(f"w{i}" for i in range(60))
    got = sorted((str(r[0]), r[1], r[2]) for r in substring_dedup.substring_dedup(docs([(None, text), (5, text), (6, text), (7, text), (7, text + " x"), (8, "a b " + text), (8, "a b " + text)])).collect())
    assert got == [("5", 60, 0), ("6", 60, 60), ("7", 60, 0), ("7", 61, 0), ("8", 62, 60), ("8", 62, 60), ("None", 60, 0)]
    assert substring_dedup.substring_dedup(docs([])).collect() == []


def test_fm_index_counts():
    rnd = np.random.default_rng(3)
    seqs = [rnd.integers(0, 5, n) for n in (3, 40, 1, 77)]
    ix = fm_index.FMIndex(seqs, 5)
    for n in (1, 2, 3, 4):
        for _ in range(30):
            p = rnd.integers(0, 5, n)
            lo, hi = np.array([0]), np.array([ix.n])
            for c in p[::-1]:
                lo, hi = ix.step(np.array([c]), lo), ix.step(np.array([c]), hi)
                if lo >= hi:
                    break
            want = sum(tuple(s[k : k + n]) == tuple(p) for s in seqs for k in range(len(s) - n + 1))
            assert max(0, int(hi[0] - lo[0])) == want


def test_substring_drops_tables_once_read(docs, monkeypatch):
    gone = []
    drop = substring_dedup.Scratch.drop
    monkeypatch.setattr(substring_dedup.Scratch, "drop", lambda self, *names: (gone.extend(names), drop(self, *names))[1])
    text = " ".join(f"w{i}" for i in range(60))
    got = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(docs([(1, text), (2, text + " end")])).collect()}
    assert got == {1: 0, 2: 60} and {"scan", "segs", "texts", "pieces"} <= set(gone)


def test_shards_leave_out_what_cannot_meet():
    words = [f"w{i}" for i in range(120)]
    text = lambda a, n: " ".join(words[a : a + n])
    rows = [(7, True, 1, 1, 3, text(0, 60)), (7, False, 2, 2, 9, text(5, 52)), (8, False, 3, 3, 9, text(60, 55)), (9, True, 4, 4, 3, text(60, 50))]
    own, queries = substring_dedup.meeting(rows)
    assert [x[:3] for x in own] == [(1, 1, 3)] and [x[:3] for x in queries] == [(2, 2, 9)]
    assert substring_dedup.search_shard(own, queries, 50) == [(2, 2, 0, 3, 3)]
