"""Threshold-scaled sketches against plain sets, and edited texts against string slices."""

import collections
import hashlib
import random

import numpy as np
from conftest import SF
from pyspark.sql import functions as F

from geoloom.llm import fingerprints as fp


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijé日") for _ in range(r.randint(2, 8))) for _ in range(n))


def exact_share(a, b):
    """Of a's windows (or the whole of a short text) in b."""
    x, y = ({t[i : i + fp.WIDTH] for i in range(max(1, len(t) - fp.WIDTH + 1))} if t else set() for t in (a, b))
    return len(x & y) / len(x) if x else float(not y)


def test_sketch_is_the_same_in_pieces_and_batches(monkeypatch):
    texts = [prose(k, r) for k, r in enumerate([1, 3, 0, 500, 40, 2, 3000])] + ["", "a", "x" * 100]
    data = [t.encode() for t in texts]
    together, alone = fp.sketch(data), [fp.sketch([d])[0] for d in data]
    monkeypatch.setattr(fp, "PIECE", 97)
    pieces = fp.sketch(data)
    for a, b, c, t in zip(together, alone, pieces, texts):
        assert a.tolist() == b.tolist() == c.tolist() == sorted(set(a.tolist()))
        assert (len(a) > 0) == bool(t) and (len(a) == 1 or (a < fp.LIMIT).all())


def test_every_hash_below_the_fraction_is_retained():
    text = prose(5, 400)
    codes = fp._codes(text.encode())
    every = {int(fp._windows(codes[i : i + fp.WIDTH])[0]) for i in range(len(text) - fp.WIDTH + 1)}
    assert fp.sketch([text.encode()])[0].tolist() == sorted(h for h in every if h < fp.LIMIT)


def test_containment_of_unequal_texts_and_merging(spark):
    long = prose(1, 20_000)
    part, other = long[30_000:60_000], prose(2, 6_000)
    half = part[:15_000] + other[:15_000]
    union = " ".join([part, other])
    rows = [(1, long), (2, part), (3, other), (4, half), (5, union), (6, ""), (7, None), (8, part)]
    got = {r.doc_id: r.fingerprint for r in fp.fingerprints(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got[2] == got[8] != got[3] and got[6] == got[7] == ""
    texts = dict(rows)
    pairs = [(a, b) for a in range(1, 7) for b in range(1, 7)]
    frame = spark.createDataFrame([(a, b, got[a], got[b]) for a, b in pairs], "a int, b int, x string, y string")
    for r in frame.withColumn("share", fp.containment(F.col("x"), F.col("y"))).collect():
        assert abs(r.share - exact_share(texts[r.a], texts[r.b])) < 0.05, (r.a, r.b)
    groups = spark.createDataFrame([("u", got[2]), ("u", got[3]), ("u", got[2]), ("e", ""), ("s", fp.encode(np.array([fp.LIMIT + 5], np.uint64)))], "g string, fingerprint string")
    merged = {r.g: r.fingerprint for r in fp.merge_fingerprints(groups, ["g"]).collect()}
    whole = {got[5][i : i + 6] for i in range(0, len(got[5]), 6)}
    parts = [merged["u"][i : i + 6] for i in range(0, len(merged["u"]), 6)]
    assert parts == sorted(set(parts)) and set(parts) <= whole and len(whole) - len(parts) <= 6  # windows across the seam
    assert merged["e"] == "" and merged["s"].startswith("~")


def brute(rows):
    """(id, n_chars, sha, text, edited, next) per row, neighbours in descending id, equal ids excluded."""
    found = sorted(rows, key=lambda r: -r[0])
    out = []
    for k, (i, t) in enumerate(found):
        following = found[(k + 1) % len(found)][1] or ""
        t = t or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + following[:third]
        out.append((i, len(t), edited, t, following))
    return out


def check(got, rows):
    assert len(got) == len(rows)
    by = {g.doc_id: g for g in got}
    likeness = []
    for i, n, edited, text, following in brute(rows):
        g = by[i]
        assert (g.n_chars, g.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = fp.sketch([x.encode() for x in (text, edited, following)])
        assert (g.fingerprint, g.edited_fingerprint) == (fp.encode(a), fp.encode(b))
        assert (g.near_edited, g.near_next) == (fp.shared_part(a, b), fp.shared_part(a, c))
        if len(text) > 3000:
            likeness.append(g.near_edited - exact_share(text, edited))
    return likeness


def test_query_against_slices_of_strings(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    errors = check(fp.op12_fingerprints(spark, SF).collect(), rows)
    assert len(errors) > 5 and abs(sum(errors) / len(errors)) < 0.05


def test_many_slices(spark, monkeypatch):
    monkeypatch.setattr(fp, "SLICE_BYTES", 1000)
    rows = [(k * 7 % 1009 - 500, prose(k, k % 60)) for k in range(1, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert len(fp._slices(docs.select(*fp._order(F.col("doc_id"), F.col("text")), F.octet_length("text").alias("bytes")))) > 20
    check(fp.edited_fingerprints(docs).collect(), rows)


SCHEMA = "doc_id long, text string, id int, times string, guest int, s string, fingerprint int, n_chars string"


def test_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(fp, "COPIES", 7)
    monkeypatch.setattr(fp, "SLICE_BYTES", 100)
    hot = prose(9, 30)
    texts = [(5, hot)] * 40 + [(5, "same id"), (4, None), (3, ""), (2, "ab"), (1, "日本語テキスト"), (None, "no id"), (None, None), (9, prose(10, 200_000))]
    rows = [(i, t, 1, "x", 2, "y", 3, "z") for i, t in texts]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = fp.edited_fingerprints(docs).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert collections.Counter(g.doc_id for g in got) == collections.Counter(i for i, _ in texts)
    assert len({tuple(g) for g in got if g.n_chars == len(hot)}) == 1
    empty = [g for g in got if g.n_chars == 0]
    assert len(empty) == 3 and {g.near_edited for g in empty} == {1.0} and {g.fingerprint for g in empty} == {""}
    first = next(g for g in got if g.doc_id == 9)
    assert 0.6 < first.near_edited < 0.72
    one = fp.edited_fingerprints(docs.where("doc_id = 2")).collect()
    assert [(g.near_next, g.edited_sha256) for g in one] == [(1.0, hashlib.sha256(b"ab").hexdigest())]
    assert fp.edited_fingerprints(docs.where("false")).count() == 0 and fp.fingerprints(docs.where("false")).count() == 0
