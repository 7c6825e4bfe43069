"""The corpus operators against brute force, the tokenizer libraries, held-out labels, and edge rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline
from geoloom.llm import bpe, context_mixing, embedding_dedup, language, line_dedup, mixing, near_dup, quality, token_counts, toxicity
from geoloom.llm.common import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, size int, kept string, component_id int, n_words string, _text string, _id int"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(text or "")


def sentence(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))


def edge_rows():
    passage, other = sentence(1, 70), sentence(2, 40)
    texts = [
        (1, f"{passage}\nshort line"),
        (2, f"own start {sentence(3, 30)}\n{passage}\n{other}"),
        (3, None),
        (4, ""),
        (5, " \t\n \r\n"),
        (6, "Éa ß İSTANBUL <|endoftext|> don't 日本 12 x\x1cy"),
        (7, passage + " changed"),
        (8, " ".join(["same"] * 60)),
        (9, "\n".join(["one two three four five six"] * 40)),
        (None, passage),
        (None, "no id here"),
        (10, " ".join(sentence(k, 500) for k in range(120))),  # very long
        (11, "w " * 3),
        (12, "$$$ ### *** 123"),
        (1, f"{passage}\nshort line"),  # a repeated row
        (2, "same id, other text"),
    ]
    rows = []
    for k, (i, t) in enumerate(texts):
        lang = None if k % 5 == 4 else "en" if k % 2 else "fr"
        rows.append((i, t, lang, None if k % 3 == 2 else f"s{k % 4}", None, "clash", 1, "x", 2, "y", "z", 3))
    return rows


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (2, 0, 1), (6, 1, 0), (7, 0, 1), (9, 1, None), (None, 1, 1), (12, None, 0), (12, 0, 1), (12, 1, 1), (99, 5, 7)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# --- 1 line dedup -----------------------------------------------------------------------------------------


def brute_lines(rows, least=50):
    """Lines kept of every distinct (id, text), by comparing all pairs of positions."""
    found = sorted({(-1 if i is None else i, t) for i, t in rows if t is not None}, key=lambda r: r[0])
    seq = {d: [(n, line) for n, line in enumerate(d[1].split("\n")) if words(line)] for d in found}
    gone = {d: set() for d in found}
    for x, a in enumerate(found):
        for b in found[x:]:
            for i in range(len(seq[a])):
                for j in range(i + 1 if a == b else 0, len(seq[b])):
                    if i and j and seq[a][i - 1][1] == seq[b][j - 1][1]:
                        continue
                    m = 0
                    while i + m < len(seq[a]) and j + m < len(seq[b]) and seq[a][i + m][1] == seq[b][j + m][1]:
                        m += 1
                    if sum(len(words(line)) for _, line in seq[b][j : j + m]) >= least:
                        gone[b].update(n for n, _ in seq[b][j : j + m])
    return {d: "\n".join(line for n, line in enumerate(d[1].split("\n")) if n not in gone[d]) for d in found}


def test_line_dedup_against_all_pairs(spark):
    r = random.Random(4)
    lines = [sentence(k, r.choice([2, 10, 30, 60])) for k in range(12)]
    rows = [(i, "\n".join(r.choice([*lines, "", sentence(1000 + i, 5)]) for _ in range(r.randint(1, 14)))) for i in range(60)]
    got = rows_of(line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).select("row.*", "deduped"))
    expected = brute_lines(rows)
    assert {(g["doc_id"], g["deduped"]) for g in got} == {(i, t) for (i, _), t in expected.items()}


def test_line_dedup_edges(spark, edges, empty):
    got = rows_of(line_dedup.line_dedup(edges).select("row.doc_id", "row.text", "deduped", "n_lines", "n_removed", F.col("row.row").alias("clash")))
    assert len(got) == len(edge_rows()) and {g["clash"] for g in got} == {"clash"}
    by = collections.defaultdict(list)
    for g in got:
        by[g["doc_id"], g["text"]].append(g)
    passage = sentence(1, 70)
    assert by[None, passage][0]["deduped"] == passage  # null ids come first
    assert [g["deduped"] for g in by[1, f"{passage}\nshort line"]] == ["short line"] * 2
    assert by[3, None][0]["deduped"] is None and by[4, ""][0]["deduped"] == "" and by[3, None][0]["n_lines"] == 0
    assert by[9, "\n".join(["one two three four five six"] * 40)][0]["n_removed"] == 39  # overlapping copies
    assert line_dedup.line_dedup(empty).count() == 0


# --- 2 quality --------------------------------------------------------------------------------------------


def brute_quality(text):
    w = words(text)
    at = collections.defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    covered = {k for v in at.values() if len(v) > 1 for i in v for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_figures(spark, docs, edges, empty, labels):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for df in (docs, edges):
        for g in rows_of(quality.quality_rules(df, labels).select("row.text", *names, "base_failed", "kept", "probability")):
            n = brute_quality(g["text"])
            assert tuple(g[c] for c in names) == n
            assert g["base_failed"] == (n[0] < 20 or 100 * n[4] > 30 * n[0])
            assert not (g["base_failed"] and g["kept"]) and 0 <= g["probability"] <= 1
    assert quality.quality_rules(empty, labels).count() == 0
    assert quality.quality_rules(edges, labels.limit(0)).where("kept <> (not base_failed)").count() == 0


def test_quality_learns(spark):
    """Held-out accuracy: the model never sees the last third of the labels."""
    big = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    got = quality.quality_rules(docs, labels.where(~held)).select("row.doc_id", "kept").join(labels.where(held), "doc_id").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.7 and got[got.quality == 0].kept.mean() < 0.2


# --- 3 mixing ---------------------------------------------------------------------------------------------


def test_fit_budget_is_exact():
    r = np.random.default_rng(2)
    for _ in range(60):
        lengths = np.sort(r.choice(np.arange(1, 40), r.integers(1, 7), replace=False))
        counts = r.integers(1, 6, len(lengths))
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + int(n) * k for s in sums for k in range(c + 1)}
        budget = int(r.integers(0, (lengths * counts).sum() + 5))
        taken = mixing.fit_budget(lengths, counts, budget)
        assert (taken <= counts).all() and (taken >= 0).all()
        best = max(s for s in sums if s <= budget)
        assert budget - (lengths * taken).sum() <= budget - best + lengths.max()
        if (counts * budget // max(1, (lengths * counts).sum())).sum() == 0:  # nothing is taken before the knapsack
            assert (lengths * taken).sum() == best


def test_rare_lengths_are_taken_in_proportion():
    """Long and short documents alike, where hardly a length occurs twice."""
    lengths = np.concatenate([np.arange(1000, 1372), np.arange(15000, 15020)])
    counts = np.ones(len(lengths), np.int64)
    size = int(lengths.sum())
    for share in (0.25, 0.5, 0.8):
        budget = int(size * share)
        taken = mixing.fit_budget(lengths, counts, budget)
        assert (taken <= counts).all() and (taken >= 0).all() and 0 <= budget - int((lengths * taken).sum()) <= 2
        for part in (taken[:372], taken[372:]):
            assert abs(part.mean() - share) <= 0.1


def test_mixing_targets_and_budgets(spark, edges, empty):
    got = rows_of(mixing.mix_sources(edges).select("row.*", F.col("size").alias("mixed_size"), "source_size", "target", "times"))
    assert len(got) == len(edge_rows())
    sizes = collections.Counter()
    for g in got:
        assert g["mixed_size"] == len(words(g["text"])) and 0 <= g["times"] <= 3
        sizes[g["source"]] += g["mixed_size"]
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    level, total = 0.0, sum(sizes.values())
    for _ in range(20):
        full = {s for s in order if 3 * sizes[s] <= weight[s] * level}
        level = max(level, (total - sum(3 * sizes[s] for s in full)) / max(1, sum(weight[s] for s in order if s not in full)))
    for g in got:
        assert g["source_size"] == sizes[g["source"]]
        assert math.isclose(g["target"], min(3 * sizes[g["source"]], weight[g["source"]] * level))
    assert mixing.mix_sources(empty).count() == 0
    again = rows_of(mixing.mix_sources(edges.repartition(5)).select("row.doc_id", "row.text", "times"))
    key = lambda g: (g["doc_id"] or -1, g["text"] or "", g["times"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mixing_meets_targets(spark, docs):
    got = mixing.mix_sources(spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet"))
    for r in got.groupBy("row.source").agg(F.first("target").alias("t"), F.sum(F.col("size") * F.col("times")).alias("n"), F.max("size").alias("m")).collect():
        assert abs(r.t - r.n) <= 0.02 * r.t


def test_mixing_takes_part_of_repeated_rows(spark):
    """Repeated rows, and texts of one id, are taken one by one: a third of the table is one row."""
    r = np.random.default_rng(8)
    rows = [(7, "a", "one two three four five six seven eight")] * 400 + [(8, "a", f"t{k % 5} two three four five six seven eight") for k in range(200)]
    rows += [(100 + k, "b" if k % 2 else None, sentence(k, int(r.integers(8, 12)))) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("_metadata", F.lit("taken")).withColumn("size", F.lit(1))
    got = mixing.mix_sources(docs).select("row.doc_id", "row.source", "row._metadata", "row.text", F.col("size").alias("n"), "source_size", "target", "times").toPandas()
    assert len(got) == 1200 and (got["_metadata"] == "taken").all()
    got["words"] = got.n * got.times
    for _, g in got.groupby("source", dropna=False):
        assert abs(g.words.sum() - g.target.iloc[0]) <= 12
        assert g.target.iloc[0] % g.source_size.iloc[0] > 100  # the mix ends inside the source
    tied = got[got.doc_id == 7]
    assert tied.times.max() - tied.times.min() <= 1
    again = mixing.mix_sources(docs.repartition(3), keep=["doc_id", "text"]).groupBy("row.doc_id", "row.text").agg(F.sum("times").alias("t")).toPandas()
    once = got.groupby(["doc_id", "text"]).times.sum()
    assert {(a, b): t for (a, b), t in once.items()} == {(x.doc_id, x.text): x.t for x in again.itertuples()}


# --- 4 near-dedup -----------------------------------------------------------------------------------------


def shingles(text, k):
    w = words(lower(text))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute_components(rows, k, percent=80):
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t, k)) for i, t in rows]
    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    return {i: find(i) for i in parent}, sets


def test_near_duplicates_against_all_pairs(spark, docs):
    r = random.Random(8)
    rows = [(d.doc_id, d.text) for d in docs.select("doc_id", "text").limit(60).collect()]
    base, n = sentence(77, 150).split(), 10_000
    for copies, edits in ((50, 1), (30, 3), (20, 9)):
        for _ in range(copies):
            w = list(base)
            for _ in range(edits):
                w[r.randrange(len(w))] = f"edit{n}"
                n += 1
            rows.append((n, " ".join(w).upper() if r.random() < 0.3 else " ".join(w)))
            n += 1
    rows += [(n + k, rows[0][1]) for k in range(40)] + [(n + 100, "a b"), (n + 101, "A  b"), (n + 102, "b a")]
    got = {g["doc_id"]: g for g in rows_of(near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 4))}
    expected, sets = brute_components(rows, 4)
    assert {i: g["component_id"] for i, g in got.items()} == expected
    assert all(got[i]["n_shingles"] == len(s) for i, s in sets)
    assert all(g["kept"] == (g["doc_id"] == g["component_id"]) for g in got.values())


def test_near_duplicates_large_groups_branch(spark, monkeypatch):
    """Small nodes of two members: the deeper levels and the mixed large nodes do the work."""
    monkeypatch.setattr(near_dup, "SMALL", 2)
    r, rows = random.Random(3), []
    for g in range(3):
        base = sentence(g, 60).split() + sentence(500, 40).split()  # groups share a passage
        for k in range(25):
            w = list(base)
            w[r.randrange(60)] = f"x{k}"
            rows.append((g * 100 + k, " ".join(w)))
    got = {g["doc_id"]: g["component_id"] for g in rows_of(near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4))}
    assert got == brute_components(rows, 4)[0]


def test_near_duplicates_among_much_common_text(spark, monkeypatch):
    """Texts that share much of their words stay together for many levels; pairs just above 80 % must not part before."""
    assert near_dup._lost(0.8, near_dup._deepest(0.8)) <= 0.01 < near_dup._lost(0.8, near_dup._deepest(0.8) + 1)
    monkeypatch.setattr(near_dup, "SMALL", 2)
    shared, rows = sentence(900, 62).split(), []
    for g in range(600):
        own = [f"own{g}x{j}" for j in range(43)]
        rows.append((2 * g, " ".join(shared + own)))
        rows.append((2 * g + 1, " ".join(shared + own[:-11] + [f"new{g}x{j}" for j in range(11)])))  # 91 of 113 shingles of four words
    got = {g["doc_id"]: g["component_id"] for g in rows_of(near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4))}
    assert all(got[i] in (i, i - i % 2) for i in got)
    assert sum(got[2 * g + 1] == 2 * g for g in range(600)) >= 594


def test_near_duplicates_edges(spark, edges, empty):
    got = rows_of(near_dup.near_duplicates(edges, 5))
    assert len(got) == len(edge_rows())
    for g in got:
        if g["doc_id"] in (3, 4, 5):
            assert (g["n_shingles"], g["component_id"], g["kept"]) == (0, g["doc_id"], True)
        if g["doc_id"] is None:
            assert g["component_id"] is None and g["kept"]
        if g["doc_id"] in (1, 7):
            assert g["component_id"] == 1
    assert near_dup.near_duplicates(empty, 5).count() == 0


def test_components_of_a_chain(spark):
    r = list(range(1, 60))
    random.Random(1).shuffle(r)
    edges = spark.createDataFrame([(i, i + 1) for i in r] + [(100, 101), (101, 101)], "a long, b long")
    got = {g["node"]: g["component"] for g in rows_of(components(edges))}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100}


# --- 5 toxicity -------------------------------------------------------------------------------------------


def test_toxicity_learns_and_survives_misspelling():
    r = random.Random(6)
    bad = ["vrothek", "gnarlust"]
    sample = []
    for k in range(600):
        w = sentence(k, r.randint(20, 200)).split()
        if k % 2:
            w[r.randrange(len(w))] = r.choice(bad)
        sample.append((" ".join(w), k % 2))
    model = toxicity.train(sample)
    import pyarrow as pa

    from geoloom.llm.textbytes import chunks

    def score(texts):
        return np.concatenate([toxicity.score_texts(t, *model) for _, _, t in chunks(pa.array(texts, pa.large_string()))])

    clean, toxic = [sentence(9000 + k, 300) for k in range(50)], [f"{sentence(9100 + k, 200)} Vrothekk, {sentence(9200 + k, 200)}" for k in range(50)]
    assert (score(clean) < 0.5).mean() > 0.9 and (score(toxic) >= 0.5).mean() > 0.9
    assert len(score(["", "   ", "x"])) == 3 and score([""])[0] < 0.5


def test_toxicity_edges(spark, edges, empty, labels):
    got = rows_of(toxicity.toxicity(edges, labels))
    assert len(got) == len(edge_rows())
    for g in got:
        assert 0 <= g["score"] <= 1 and g["predicted"] == int(g["score"] >= 0.5)
        assert g["held_out"] == (None if g["doc_id"] is None else zlib.crc32(str(g["doc_id"]).encode()) % 5 == 0)
    assert toxicity.toxicity(empty, labels).count() == 0
    assert toxicity.toxicity(edges, labels.limit(0)).where("score > 0.001").count() == 0


# --- 6 and 9 tokenizers -----------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, edges, empty, docs, tmp_path, name):
    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        count = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    else:
        import sentencepiece

        t = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda x: len(t.encode(x))
    cache = str(tmp_path / "cache")
    for df in (edges, docs, empty):
        for run in range(2):
            got = sorted((str(g["doc_id"]), g["n_bytes"], g["n_tokens"]) for g in rows_of(token_counts.token_counts(df, path, cache)))
            assert got == sorted((str(r.doc_id), len((r.text or "").encode()), count(r.text or "")) for r in df.collect())
    distinct = {r.text or "" for df in (edges, docs) for r in df.collect()}
    assert spark.read.parquet(cache).count() == len(distinct)  # hits were not encoded again


def test_bpe_equals_the_library():
    import json

    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, mine = Tokenizer.from_file(path), bpe.PrefixBpe(json.load(open(path)))
    r = random.Random(5)
    parts = ["a", "aa", "aaa", "th", "ing", "é", "é", "ß", " ", "\n", "'s", "'", "1", "23", "*", "!!", "\x1c", "\x85", "\xa0", "İ", "Σ", "ς", "日本", "😀", "<|endoftext|>", "<|", "Ⅷ", "'RE", ""]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(2500)]
    texts += ["".join(r.choice("abeinot") for _ in range(r.randint(1, 30))) for _ in range(2500)] + ["a" * n for n in range(40)]
    for x in texts:
        ids = t.encode(x, add_special_tokens=False).ids
        body, decoded = mine.encode(x)
        assert (np.frombuffer(body, "<i4").tolist(), decoded) == (ids, t.decode(ids, skip_special_tokens=False)), x


def test_bpe_edges(spark, edges, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = sorted(map(str, (tuple(g.values()) for g in rows_of(bpe.digests(bpe.bpe_encode(edges, path))))))
    expected = []
    for i, text, *_ in edge_rows():
        ids = t.encode(text or "", add_special_tokens=False).ids
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        expected.append(str((i, len(ids), digest(" ".join(map(str, ids))), digest(t.decode(ids, skip_special_tokens=False)))))
    assert got == sorted(expected)
    assert bpe.bpe_encode(empty, path).count() == 0


# --- 7 language model -------------------------------------------------------------------------------------


def brute_base(rows):
    tokens = [(i, [*words(lower(t)), None]) for i, t in rows]
    learn = [w for i, w in tokens if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    c = collections.Counter(x for w in learn for x in w)
    n, v = sum(c.values()), len(c)
    return [(i, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for i, w in tokens]


@pytest.mark.parametrize("frequent", [1 << 18, 3])
def test_lm_base_figures(spark, edges, docs, empty, monkeypatch, frequent):
    monkeypatch.setattr(context_mixing, "FREQUENT", frequent)
    for df in (edges, docs) if frequent > 3 else (edges,):
        got = rows_of(context_mixing.lm_scores(df))
        mine = sorted(str((g["doc_id"], g["n_tokens"], g["n_known"], g["train_tokens"], round(g["base_score"], 6) + 0.0)) for g in got)
        assert mine == sorted(map(str, brute_base([(r.doc_id, r.text) for r in df.collect()])))
        assert all(g["score"] < 0 and g["bits_per_byte"] > 0 for g in got)
        assert all(g["held_out"] == (None if g["doc_id"] is None else zlib.crc32(str(g["doc_id"]).encode()) % 7 == 2) for g in got)
    assert context_mixing.lm_scores(empty).count() == 0


def test_lm_is_a_distribution():
    """At every place the 256 bytes' probabilities add up to 1: the model codes, it does not only rank."""
    import pyarrow as pa

    from geoloom.llm.textbytes import chunks

    counts = np.zeros(context_mixing.OFFSET[-1], np.int32)
    learn = pa.array([sentence(k, 50) for k in range(20)], pa.large_string())
    for _, _, t in chunks(learn):
        context_mixing.count_cells(t, counts)
    odds = context_mixing.log_odds(counts)
    weight = np.full((len(context_mixing.ORDERS), 8), 0.02)

    def bits(texts):
        return np.concatenate([context_mixing.bits_of(t, odds, weight)[0] for _, _, t in chunks(pa.array(texts, pa.large_string()))])

    # over an alphabet closed under "one more letter": all words of one byte, as words end in a blank and an end
    one = np.concatenate([bits([chr(97 + k) for k in range(26)]), bits([""])])
    assert (2.0**-one).sum() <= 1.0 and (one > 0).all()
    known, unknown = bits([sentence(3, 50)])[0], bits([sentence(3000, 50)])[0]
    assert known < unknown


def test_lm_start_weights_come_from_every_text(spark, monkeypatch):
    """Of long texts only there is no sample of short ones; each text is learnt from under the counts of the other fold."""
    import pyarrow as pa

    from geoloom.llm.textbytes import chunks

    rows = [(i, sentence(i, 3000)) for i in range(1, 13)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)

    def held_out():  # the others are known to the counts, so trusting those more would score them better
        found = [g["score"] for g in rows_of(context_mixing.lm_scores(df)) if g["held_out"]]
        assert found
        return sum(found)

    learnt = held_out()

    folds = [(t, i % 2) for i, t in rows]
    halves = [pa.array([t for t, f in folds if f == k], pa.large_string()) for k in range(2)]
    odds = []
    for half in halves:
        counts = np.zeros(context_mixing.OFFSET[-1], np.int32)
        for _, _, t in chunks(half):
            context_mixing.count_cells(t, counts)
        odds.append(context_mixing.log_odds(counts))
    weight, total, size = context_mixing.START, 0.0, 0
    for k, half in enumerate(halves):
        for _, _, t in chunks(half, context_mixing.CHUNK):
            for rate in context_mixing.RATES:
                _, n, weight = context_mixing.bits_of(t, odds[1 - k], weight, rate)
            total, size = total + weight * n.sum(), size + n.sum()
    assert size == sum(len(t) + 2 for _, t in rows)  # every byte, a blank behind the last word, an end
    got = context_mixing._start_weights(spark.createDataFrame(folds, "text string, fold int").coalesce(1), odds)
    assert got == pytest.approx(total / size, rel=1e-6)

    monkeypatch.setattr(context_mixing, "_start_weights", lambda docs, odds: context_mixing.START)
    assert learnt > held_out()


# --- 8 embeddings -----------------------------------------------------------------------------------------


def test_embeddings_against_brute_force(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(500, 16))
    big = x[0] + 0.12 * r.normal(size=(330, 16))  # more links than a block
    pairs = x[100:160] + 0.08 * r.normal(size=(60, 16))
    x = np.concatenate([x, big, pairs, np.repeat(x[5:6], 90, 0), 3 * x[7:8]]).astype(np.float32)
    rows = [(int(i), [float(v) for v in row], 0, "clash") for i, row in enumerate(x)]
    rows += [(5000, None, 1, ""), (5001, [], 1, ""), (5002, [0.0] * 16, 1, ""), (5003, [float("nan")] + [1.0] * 15, 1, ""), (5004, [None] + [1.0] * 15, 1, ""), (5005, [1.0, 2.0], 1, ""), (5006, [2.0, 4.0], 1, ""), (None, rows[0][1], 1, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, links string").repartition(4)
    got = {g["vec_id"]: g for g in rows_of(embedding_dedup.embedding_dedup(df))}
    assert len(got) == len(rows)
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    found = sum(got[i]["n_links"] for i in range(len(x)))
    assert 0.9 * link.sum() <= found <= link.sum()
    assert all(got[i]["n_links"] <= link[i].sum() for i in range(len(x)))
    assert {got[i]["component_id"] for i in range(500, 830)} == {0}
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i in range(5000, 5005))
    assert got[5006]["component_id"] == 5005 and got[5005]["n_links"] == 1
    assert got[None]["kept"] and got[None]["n_links"] == 0
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0


def dense_groups(groups, size, angle, seed=5):
    """``groups`` runs of ``size`` vectors: cosine over 0.99 in a run, neighbouring runs ``angle`` apart."""
    r = np.random.default_rng(seed)
    centres = [[np.cos(g * angle), np.sin(g * angle), *[0.0] * 14] for g in range(groups)]
    x = np.repeat(np.array(centres), size, 0) + 0.01 * r.normal(size=(groups * size, 16))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def dedup_vectors(spark, x):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {g["vec_id"]: g for g in rows_of(embedding_dedup.embedding_dedup(df))}
    return [got[i]["n_links"] for i in range(len(x))], [got[i]["component_id"] for i in range(len(x))]


@pytest.mark.parametrize("block", [256, 16])
def test_embeddings_adjoining_dense_groups(spark, monkeypatch, block):
    """All nearest neighbours of a vector are in its own group, but most of its links lead out of it."""
    monkeypatch.setattr(embedding_dedup._across, "__defaults__", (block,))
    monkeypatch.setattr(embedding_dedup, "audit", lambda *args, **named: 1.0)
    x = dense_groups(2, 40, 0.3)
    link = x @ x.T >= 0.9
    np.fill_diagonal(link, False)
    assert link.sum() == 80 * 79 and (np.argsort(-(x @ x.T), axis=1)[:, 1:7] // 40 == np.arange(80)[:, None] // 40).all()
    assert dedup_vectors(spark, x) == (link.sum(1).tolist(), [0] * 80)


def test_embeddings_reach_recall_or_finish(spark, monkeypatch):
    """Buckets that part everything: the audit must see what is lost beside one large group, and the rest is done exactly."""
    assert all(1 - (1 - 0.85643**b) ** embedding_dedup._tables(b) >= embedding_dedup.RECALL for b in range(25))
    monkeypatch.setattr(embedding_dedup, "_bits", lambda n: 40)
    monkeypatch.setattr(embedding_dedup, "_tables", lambda bits: 1)
    monkeypatch.setattr(embedding_dedup, "WAVES", 1)
    r = np.random.default_rng(3)
    x = r.normal(size=(80, 16))
    x = np.concatenate([x[:1] + 1e-6 * r.normal(size=(300, 16)), x[1:], x[1:] + 0.1 * r.normal(size=(79, 16))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.9
    np.fill_diagonal(link, False)
    assert dedup_vectors(spark, x) == (link.sum(1).tolist(), list(brute_labels(link)))
    ids = spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate(x)], "id long, vec binary")
    one = spark.createDataFrame([(i, 0) for i in range(300)], "node long, component long")
    assert embedding_dedup.audit(ids, one) < 0.1  # 99.8 % of the links, but hardly a linked vector besides
    assert embedding_dedup.audit(ids, spark.createDataFrame(list(enumerate(brute_labels(link))), "node long, component long")) == 1.0


def brute_labels(link):
    label = np.arange(len(link))
    while True:
        low = np.minimum(label, np.where(link, label[None, :], len(link)).min(1)).astype(int)
        if (low == label).all():
            return label.tolist()
        label = low


# --- 10 language ------------------------------------------------------------------------------------------


def test_language_held_out(spark, edges, empty):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    got = language.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.9
    got = rows_of(language.language_id(edges).join(edges.select("doc_id", "text"), "doc_id"))
    assert all(g["lang_pred"] == "und" and g["score"] == 0 for g in got if g["doc_id"] in (3, 4, 5, 12) and not any(c.isalpha() for c in g["text"] or ""))
    assert language.language_id(edges).count() == len(edge_rows())
    assert language.language_id(empty).count() == 0
    assert {g["lang_pred"] for g in rows_of(language.language_id(edges.withColumn("lang", F.lit(None).cast("string"))))} == {"und"}


# --- queries and pipeline ---------------------------------------------------------------------------------


def test_pipeline_stages(spark, docs, edges, empty, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for table, where in ((edges, str(tmp_path)), (empty, str(tmp_path)), (docs, SF)):
        now = table
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, where)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == now.columns and out.dtypes == now.dtypes
                path = str(tmp_path / f"{id(table)}-{k}")
                out.write.parquet(path)
                before, now = now, spark.read.parquet(path)
                if name == "line dedup":
                    expected = {t for t in brute_lines([(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]).values() if words(t)}
                    assert {r.text for r in now.collect()} == expected
                    assert now.where("n_chars is not null and n_chars <> char_length(text)").isEmpty()
                if name == "near-dedup":
                    kept = brute_components([(r.doc_id, r.text) for r in before.collect() if r.doc_id is not None], 5)[0]
                    assert sorted(r.doc_id for r in now.collect() if r.doc_id is not None) == sorted(set(kept.values()))
        assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
        assert out.count() == now.count()
