"""Periodic runs against the definition, tried for every start and period."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from conftest import SF

from geoloom.llm import periodic_runs as pr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w):
    n, runs = len(w), {}
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and j > i:
                runs.setdefault((i - q, j), q)  # periods ascend: the smallest stays
            i = max(j, i + 1)
    found = sorted((s, e - s, q) for (s, e), q in runs.items())
    keep = [all(not s + q <= i < s + m for s, m, q in found) for i in range(n)]
    return found, " ".join(x for x, k in zip(w, keep) if k)


def edited(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and w:
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
    return w


def random_texts():
    r = random.Random(3)
    texts = []
    for k in range(400):
        alphabet = [f"w{x}" for x in range(r.choice([1, 2, 2, 3, 5, 40]))]
        w = [r.choice(alphabet) for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            unit = [r.choice(alphabet) for _ in range(r.randint(1, 14))]
            at = r.randint(0, len(w))
            w[at:at] = (unit * 7)[: r.randint(len(unit), 7 * len(unit))]
        texts.append(" ".join(w))
    a, b = "a", "b"
    for _ in range(9):  # Fibonacci words: many runs that overlap
        a, b = b, b + a
    texts += [" ".join(b), " ".join("ab" * 50), " ".join("aab" * 40 + "aab" * 3), " ".join(("a" * 7 + "b") * 9)]
    return texts


def test_random_words_against_the_definition(spark):
    rows = list(enumerate(random_texts()))
    got = pr.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    for g in got:
        runs, collapsed = brute(rows[g.doc_id][1].split())
        assert ([tuple(r) for r in g.runs], g.collapsed) == (runs, collapsed), rows[g.doc_id]


def test_query_against_the_definition(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = pr.op13_periodic_runs(spark, SF).collect()
    assert sorted(g.doc_id for g in got) == sorted(texts)
    planted = 0
    for g in got:
        w = edited(g.doc_id, texts[g.doc_id])
        planted += zlib.crc32(str(g.doc_id).encode()) % 10 == 0
        if len(w) > 3000:
            continue
        runs, collapsed = brute(w)
        assert (g.n_words, g.n_runs) == (len(w), len(runs))
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (g.start, g.length, g.period) == best
        assert g.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert g.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert g.collapsed_sha256 == hashlib.sha256(collapsed.encode()).hexdigest()
    assert planted > 5


SCHEMA = "doc_id long, text string, runs int, n_words string, collapsed int, _id string, _text int, start int"


def test_edge_rows(spark):
    texts = [(1, None), (2, ""), (3, " \t\n\r\x0b\x0c "), (None, "x " * 9), (4, "one\x1cword"), (5, "x " * 9), (5, "x " * 9), (6, "é é é é é é")]
    rows = [(i, t, 1, "x", 2, "y", 3, 4) for i, t in texts]
    got = pr.periodic_runs(spark.createDataFrame(rows, SCHEMA).repartition(2)).collect()
    assert len(got) == 8 and got[0].__fields__ == ["doc_id", "n_words", "runs", "collapsed"]
    by = {}
    for g in got:
        by.setdefault(g.doc_id, []).append((g.n_words, [tuple(x) for x in g.runs], g.collapsed))
    assert by[1] == by[2] == by[3] == [(0, [], "")]
    assert by[None] == [(9, [(0, 9, 1)], "x")] and by[5] == [(9, [(0, 9, 1)], "x")] * 2
    assert by[4] == [(1, [], "one\x1cword")] and by[6] == [(6, [(0, 6, 1)], "é")]
    assert pr.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_runs_do_not_cross_texts(spark):
    rows = [(i, "x x x") for i in range(50)]
    assert not any(g.runs for g in pr.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect())


@pytest.mark.parametrize("unit", [["x"], ["x", "y"], [f"w{k}" for k in range(1000)]])
def test_very_long_text_of_one_run(unit):
    codes = np.array([zlib.crc32(x.encode()) for x in unit], np.uint64)
    words = np.tile(codes, 1_000_000 // len(unit))
    begun = time.time()
    start, end, period = pr.find_runs(words, np.array([len(words)]))
    assert (start.tolist(), end.tolist(), period.tolist()) == ([0], [len(words)], [len(unit)])
    assert time.time() - begun < 60


def test_very_long_text_in_spark(spark):
    text = "alpha beta " * 700_000  # 7.7 MB, beyond one chunk
    rows = [(1, text), (2, "b" * 5_000_000 + " end")]
    got = {g.doc_id: g for g in pr.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(x) for x in got[1].runs] == [(0, 1_400_000, 2)] and got[1].collapsed == "alpha beta"
    assert got[2].n_words == 2 and got[2].collapsed == rows[1][1]
