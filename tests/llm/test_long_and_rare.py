"""Texts at the edges of the operators: runs of millions of blanks, letters of two bytes only, blocks of a fit."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from geoloom.llm import bpe, common, language, near_dup, quality, textbytes, token_counts


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "ab" * 1_000_000, "a " + "\t" * 1_500_000 + " b"])
def test_token_counts_of_very_long_runs(text):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    count = token_counts._counter("json", open(path, "rb").read())
    assert count(text) == len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_letters_of_the_first_two_byte_block_are_letters(spark):
    texts = ["ª", "º º", "µ 12", "12 ¿ §", "", None, "Ā", "a"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    trained = [(100 + k, w, lang) for k in range(40) for w, lang in (("the cat and the dog", "en"), ("le chat et le chien", "fr"))]
    both = docs.withColumn("lang", F.lit(None).cast("string")).unionByName(spark.createDataFrame(trained, "doc_id long, text string, lang string"))
    got = {r.doc_id: r.lang_pred for r in language.language_id(both).where("doc_id < 100").collect()}
    assert {k for k, v in got.items() if v == "und"} == {3, 4, 5}


def test_grams_in_blocks_equal_dense_sums(monkeypatch):
    monkeypatch.setattr(quality, "BLOCK_CELLS", 50)
    texts = ["some words of a text " * k for k in range(6)] + ["", "x"]
    x = quality.Grams(pa.array(texts, pa.large_string()))
    assert x.n == len(texts) and x.cells.dtype == np.int32 and x.shares.dtype == np.float32
    dense = np.zeros((x.n, 4 * quality.CELLS))
    for k in range(x.n):
        np.add.at(dense[k], x.cells[x.start[k] : x.start[k + 1]], x.shares[x.start[k] : x.start[k + 1]])
    weight = np.random.default_rng(1).normal(size=4 * quality.CELLS)
    z = np.concatenate([x.scores(weight, a, b) for a, b in x.blocks()])
    off = np.arange(x.n) - 3.0
    g = sum(x.gradient(off[a:b], a, b) for a, b in x.blocks())
    assert z == pytest.approx(dense @ weight) and g == pytest.approx(off @ dense) and len(list(x.blocks())) > 2


def test_tables_of_powers_fit_the_chunk(monkeypatch):
    """The driver keeps them beside its plans; grown or not, hashes are the same."""
    monkeypatch.setattr(textbytes, "_kept", textbytes._powers(1))
    text = textbytes.Texts(np.frombuffer(b"some words of a text, some words", np.uint8), np.array([0, 32]))
    small = text.words().hashes()
    assert sum(a.nbytes for a in textbytes._kept) <= 1024
    textbytes.powers(4097)  # a chunk of 4 096 bytes needs no table for 8 192
    assert len(textbytes._kept[0]) == 4097
    textbytes.powers(100_000)
    assert (text.words().hashes() == small).all() and len(textbytes.powers(5)[0]) == 5
    assert small[0] == small[5] and len(set(small.tolist())) == 5


@pytest.mark.parametrize("faced, compared", [(64, 8192), (5, 8192), (64, 20)])
def test_large_nodes_are_settled_by_full_sets_in_blocks(spark, monkeypatch, faced, compared):
    """A passage in all texts, pairs below and above 80 % and a group of copies: nodes within the round's comparisons are settled
    at once, by links and not by candidate pairs; with few comparisons allowed the others branch on. All equal brute force."""
    monkeypatch.setattr(near_dup, "SMALL", 2)
    monkeypatch.setattr(near_dup, "FACED", faced)
    monkeypatch.setattr(near_dup, "COMPARED", compared)
    steps, confirmed = [], []
    nodes, confirm = near_dup._nodes, near_dup.confirm
    monkeypatch.setattr(near_dup, "_nodes", lambda *a: steps.append(1) or nodes(*a))
    monkeypatch.setattr(near_dup, "confirm", lambda pairs, *a: confirmed.append(pairs.count()) or confirm(pairs, *a))
    shared, rows = [f"all{j}" for j in range(70)], []
    for g in range(40):
        own = [f"own{g}x{j}" for j in range(35)]
        rows += [(10 * g, shared + own), (10 * g + 1, shared + own[:-9] + [f"new{g}x{j}" for j in range(9)]), (10 * g + 2, shared + own[:-20] + [f"odd{g}x{j}" for j in range(20)])]
    rows += [(1000 + g, [*shared[: g % 60], f"edit{g}", *shared[g % 60 + 1 :], *(f"group{j}" for j in range(60))]) for g in range(40)]
    sets = {i: {tuple(w[j : j + 4]) for j in range(len(w) - 3)} for i, w in rows}
    component = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and component[a] != component[b]:
                low, high = sorted((component[a], component[b]))
                component = {i: low if c == high else c for i, c in component.items()}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(df, 4).collect()}
    assert got == component and len(set(component.values())) < len(rows) - 60
    assert (len(steps) > 1) == (compared == 20)
    if compared > 20:
        assert sum(confirmed) < 30 * len(rows)  # some 90 candidates a text before


def test_a_process_drops_what_other_steps_keep(spark):
    """Spark runs tasks of several steps in one process: a step's encoder and its word caches go with its next other step."""
    docs = spark.createDataFrame([(k, f"some words of text {k}") for k in range(20)], "doc_id long, text string").coalesce(1)
    encoded = bpe.bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "ids")

    def sizes(batch):
        from geoloom.llm import bpe

        yield pa.RecordBatch.from_arrays([pa.array([bpe._encoder.cache_info().currsize], pa.int64())], ["n"])

    for keeps, kept in (("bpe", 1), (None, 0), ("bpe", 0)):
        if kept:
            assert encoded.count() == 20 and len(encoded.collect()) == 20
        found = [r.n for r in common.arrow_map(docs, sizes, "n long", keeps).collect()]
        assert found == [0] if not kept else max(found) <= 1
    bpe._encoder(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    common.drop_caches("bpe")
    assert bpe._encoder.cache_info().currsize == 1
    common.drop_caches(None)
    assert bpe._encoder.cache_info().currsize == 0


def test_bpe_caches_are_bounded_in_bytes_too():
    """Entries hold ids only; a word of any length is encoded right, a long one is not kept."""
    import json
    import random

    path = public_tokenizers.path("word_bpe_49k.json")
    t, mine = Tokenizer.from_file(path), bpe.PrefixBpe(json.load(open(path)))
    r = random.Random(8)
    texts = ["", "".join(r.choice("abeinot") for _ in range(3000)), "x" * 64 + " " + "x" * 65 + ".", "<|endoftext|>", ""]
    texts += [" ".join("".join(r.choice("abeinot") for _ in range(r.randint(1, 12))) for _ in range(500)) for _ in range(4)]
    bodies = [mine.encode_ids(x) for x in texts]
    at = np.cumsum([0] + [len(x) // 4 for x in bodies])
    decoded = mine.decode(np.frombuffer(b"".join(bodies), "<i4"), at).to_pylist()
    for x, body, found in zip(texts, bodies, decoded):
        ids = t.encode(x, add_special_tokens=False).ids
        assert (np.frombuffer(body, "<i4").tolist(), found) == (ids, t.decode(ids, skip_special_tokens=False))
    for cache in (mine.words, mine.piece):
        assert len(cache) > 1000 and max(map(len, cache)) == bpe.CACHE_LETTERS
        assert all(type(x) is bytes for x in cache.values())


def test_lm_counts_and_bits_equal_plain_loops():
    """Over segments, tiles and texts of many lengths; counting a small text takes no memory of a table's size."""
    import tracemalloc

    from geoloom.llm import context_mixing as cm

    column = pa.array(["the cat sat on the mat " * 70, "", "a cat", "x" * 1100, "The mat sat, the cat sat " * 9], pa.large_string())
    texts = next(textbytes.chunks(column))[2]
    counts = np.zeros(cm.OFFSET[-1], np.int32)
    cm.count_cells(texts, counts)
    tracemalloc.start()
    cm.count_cells(texts, counts)
    assert tracemalloc.get_traced_memory()[1] < 4 << 20
    tracemalloc.stop()
    data, first, end = cm.streams(texts)
    cells = list(cm.slots(data))
    expected = np.zeros(cm.OFFSET[-1], np.int32)
    inside = [i for a, b in zip(first, end) for i in range(a, b)]
    for o, pair in enumerate(cells):
        for c, part in zip(pair, (data >> 4, data & 15)):
            for i in inside:
                expected[cm.OFFSET[o] + c[i] + part[i]] += 2
    assert (counts == expected).all()
    words = {}  # the word so far, and its slot
    for a, b in zip(first, end):
        for i in range(a, b):
            words.setdefault(bytes(data[a:i]).rpartition(b" ")[2], set()).add(int(cells[3][0][i]))
    assert all(len(x) == 1 for x in words.values()) and len(set.union(*words.values())) >= 0.99 * len(words)

    start = np.linspace(0.01, 0.04, 32).reshape(4, 8)
    odds = cm.log_odds(counts)
    bits, size, _ = cm.bits_of(texts, odds, start)
    for k, (a, b) in enumerate(zip(first, end)):
        cost = 0.0
        for i in range(a, b):
            if (i - a) % cm.SEGMENT == 0:
                weight = start.copy()
            byte = int(data[i])
            at = [[(int(p[0][i]) + int(cm.OFFSET[o]) >> 1) + (byte >> 5), (int(p[1][i]) + int(cm.OFFSET[o]) >> 1) + ((byte & 15) >> 1)] for o, p in enumerate(cells)]
            x = odds[np.array(at)].view(np.int8).astype(float)
            sign = 2.0 * ((byte >> (7 - np.arange(8))) & 1) - 1
            chance = 1 / (1 + np.exp(-np.clip(sign * (weight * x).sum(0), -10, 10)))
            cost -= np.log2(chance).sum()
            weight += x * sign * (1 - chance) * cm.RATE / cm.SCALE**2
        assert size[k] == b - a and bits[k] == pytest.approx(cost, rel=1e-4)
