"""MinHash near-dedup (operator 4): a chosen-path set similarity join.

Texts become sets of word shingles; equal sets merge at once. Every set has MINIMA minwise tokens (the smallest
value of its shingles under as many hash functions). Each of TREES independent trees branches recursively: a
node chooses some positions of the signature by a hash of its own path, about 1 / threshold of them, and sends
a set to one child per chosen position, named by the set's minwise token there. Dissimilar sets part quickly; of
similar ones more and more lose their last common path with depth, so branching ends at the deepest level at which a
pair at the threshold keeps one with probability RECALL.

A node's members are first compared with its first member only. What that links becomes one component, and a
node whose members are all of one component is done, however large; nodes of up to SMALL members are compared
exhaustively across components, and so are larger ones, in blocks, those with the fewest members outside their largest
component first, as long as a round needs at most COMPARED comparisons of sketches per document. Other large nodes branch on, and
those left at the deepest level are all compared in blocks. Candidates of too different sizes, or whose sketches
agree in far too few positions, are dropped, all others are confirmed on the full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import arrow_map, components, cut, table
from geoloom.llm.registry import query
from geoloom.llm.textbytes import U64, Texts, chunks, mix
from geoloom.shipping import ship

MINIMA = 64
TREES = 16
SMALL = 32
LEVELS = 3  # levels branched between two rounds of comparison
RECALL = 0.99  # of pairs at the threshold, in nodes of the deepest level; nodes still large there are compared in blocks
SLACK = 0.2  # a pair is confirmed if its sketches agree in at least threshold - SLACK of the positions
#: Comparisons of sketches (some nanoseconds each) in large nodes, per document and round.
COMPARED = 8192
#: Members confirmed against one copy of a group's first member in one task.
BLOCK = 128
#: Members of a large node, and shingles of theirs, that meet as many others of it in one task.
FACED, FACED_SHINGLES = 2048, 1 << 19
STRIP = 256  # of those others at once
CHUNK = 1 << 20  # bytes of text whose shingles are made at once
#: Lists of documents up to so many rows (at most some 20 MB) are sent to the scan of the texts; longer ones are joined.
SENT_ROWS = 400_000

_RNG = np.random.default_rng(20240607)
_A = (_RNG.integers(0, 1 << 32, MINIMA, dtype=np.uint64) | U64(1)).astype(np.uint32)
_B = _RNG.integers(0, 1 << 32, MINIMA, dtype=np.uint64).astype(np.uint32)
_PLACE = _RNG.integers(0, 1 << 63, MINIMA, dtype=np.int64).astype(np.uint64)


def shingle_sets(texts: Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each text's distinct shingles of k words, sorted; a text of fewer words has one shingle, its
    whole sequence; one without words has none."""
    words = texts.lowered().words()
    n, first = words.counts, words.first
    m = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    at = np.zeros(len(m) + 1, np.int64)
    np.cumsum(m, out=at[1:])
    place = np.arange(at[-1]) - np.repeat(at[:-1] - first[:-1], m)
    values = words.windows(k)[place] if len(place) else np.zeros(0, U64)
    for c in range(1, k):
        short = np.flatnonzero(n == c)
        if len(short):
            values[at[short]] = mix(words.windows(c)[first[short]] + U64(c))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    keep[at[:-1][m > 0]] = True
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    return values[keep], total[at]


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def signatures(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """MINIMA minwise tokens of each set (zeros for an empty one)."""
    full = np.flatnonzero(at[1:] > at[:-1])
    out = np.zeros((len(at) - 1, MINIMA), np.uint32)
    if len(full):
        low, start = values.astype(np.uint32), at[:-1][full]
        for j in range(MINIMA):
            out[full, j] = np.minimum.reduceat(low * _A[j] + _B[j], start)
    return out


def _roots(threshold: float) -> list[tuple[int, int]]:
    """(tree, position) of the first branches: about 1 / threshold positions a tree, at least one."""
    rng = np.random.default_rng(7)
    out = []
    for tree in range(TREES):
        chosen = np.flatnonzero(rng.random(MINIMA) < 1 / (threshold * MINIMA))
        out += [(tree, int(p)) for p in (chosen if len(chosen) else [rng.integers(MINIMA)])]
    return out


def _lost(threshold: float, levels: int) -> float:
    """The probability that two sets at the threshold have no common path of ``levels`` levels.

    Some A of the MINIMA positions agree; each is chosen by a node with probability p, apart from other nodes, and the roots
    of the first level are those of ``_roots``.
    """
    p = 1 / (threshold * MINIMA)
    times = np.bincount([place for _, place in _roots(threshold)], minlength=MINIMA)
    total = 0.0
    for agree in range(MINIMA + 1):
        gone = 0.0  # a node's paths all end within the levels left
        for _ in range(levels - 1):
            gone = (1 - p + p * gone) ** agree
        sums = np.ones(1)  # sum over choices of positions of the product of what their roots lose, by number of positions
        for n in times:
            sums = np.append(sums, 0.0) + np.append(0.0, sums * gone ** int(n))
        total += threshold**agree * (1 - threshold) ** (MINIMA - agree) * sums[agree]
    return total


def _deepest(threshold: float) -> int:
    """The deepest level at which a pair at the threshold is together with probability RECALL."""
    level = 1
    while level < MINIMA and _lost(threshold, level + 1) <= 1 - RECALL:
        level += 1
    return level


def _first_children(signature: np.ndarray, threshold: float):
    for tree, p in _roots(threshold):
        yield mix(signature[:, p].astype(U64) + mix(_PLACE[p : p + 1] + U64(tree + 1)))


def _children(keys: np.ndarray, signature: np.ndarray, threshold: float):
    """(rows, keys) of the next level: every position is chosen by a hash of the node's own key."""
    limit = U64(int((1 << 64) / (threshold * MINIMA)))
    for p in range(MINIMA):
        rows = np.flatnonzero(mix(keys ^ _PLACE[p]) < limit)
        if len(rows):
            yield rows, mix(signature[rows, p].astype(U64) + mix(keys[rows] + _PLACE[p]))


def _matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    column = column.cast(pa.binary())
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view(kind).reshape(-1, width) if len(column) else np.zeros((0, width), kind)


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32)), pa.py_buffer(rows.tobytes())])


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == U64 else values.astype(np.int64))


def _sets_of(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, sig, sketch): the set's size, its 128-bit fingerprint, signature and byte sketch."""

    def run(batch: pa.RecordBatch):
        for row, to, texts in chunks(batch.column(1), CHUNK):
            values, at = shingle_sets(texts, k)
            sig = signatures(values, at)
            columns = [batch.column(0).slice(row, to - row).cast(pa.int64()), _long(np.diff(at)), _long(_sums(mix(values + U64(1)), at)), _long(_sums(mix(values ^ U64(0xA5A5A5A5A5A5A5A5)), at)), _binary(sig), _binary(sig.astype(np.uint8))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "f1", "f2", "sig", "sketch"])

    return arrow_map(docs, run, "doc_id long, n_shingles long, f1 long, f2 long, sig binary, sketch binary")


def _first_level(sets: DataFrame, threshold: float) -> DataFrame:
    def run(batch: pa.RecordBatch):
        sig = _matrix(batch.column(1), np.uint32, MINIMA)
        for keys in _first_children(sig, threshold):
            yield pa.RecordBatch.from_arrays([_long(keys), batch.column(0)], ["key", "doc"])

    return arrow_map(sets.select("doc", "sig"), run, "key long, doc long")


def _next_level(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    def run(batch: pa.RecordBatch):
        keys = batch.column(0).to_numpy().view(U64)
        doc, sig = batch.column(1).to_numpy(), _matrix(batch.column(2), np.uint32, MINIMA)
        for rows, child in _children(keys, sig, threshold):
            yield pa.RecordBatch.from_arrays([_long(child), pa.array(doc[rows])], ["key", "doc"])

    return arrow_map(members.join(sets.select("doc", "sig"), "doc").select("key", "doc", "sig"), run, "key long, doc long").distinct()


def _nodes(rows: DataFrame) -> DataFrame:
    """(key, doc, n, leader) of the nodes with two members or more."""
    stat = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("doc").alias("leader")).where("n > 1")
    return cut(rows.join(stat, "key"))


def _alike(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """Those of the distinct pairs (a, b) whose sketches agree in ``least`` positions or more."""

    def run(batch: pa.RecordBatch):
        same = (_matrix(batch.column(2), np.uint8, MINIMA) == _matrix(batch.column(3), np.uint8, MINIMA)).sum(1) >= least
        yield batch.select([0, 1]).filter(pa.array(same))

    a = sets.select(F.col("doc").alias("a"), F.col("sketch").alias("sa"))
    b = sets.select(F.col("doc").alias("b"), F.col("sketch").alias("sb"))
    return arrow_map(pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb"), run, "a long, b long")


def _fit(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can be linked at all."""
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def _within(nodes: DataFrame, sets: DataFrame, least: int, percent: int) -> DataFrame:
    """(a, b): pairs of different labels in small nodes (key, doc, label) whose sizes and sketches agree enough, repeated by node."""
    mixed = nodes.groupBy("key").agg(F.min("label").alias("_x"), F.max("label").alias("_y")).where("_x < _y").select("key")
    rows = nodes.join(mixed, "key").join(sets.select("doc", "size", "sketch"), "doc")
    grouped = rows.groupBy("key").agg(F.collect_list(F.struct("doc", "label", "size", "sketch")).alias("m")).select("m")

    def run(batch: pa.RecordBatch):
        column = batch.column(0)
        at = np.asarray(column.offsets)
        inner = column.values
        doc, label, size = (inner.field(c).to_numpy() for c in ("doc", "label", "size"))
        sketch = _matrix(inner.field("sketch"), np.uint8, MINIMA)
        a, b = [], []
        for s, e in zip(at[:-1], at[1:]):
            i, j = np.triu_indices(e - s, 1)
            i, j = i + s, j + s
            good = (label[i] != label[j]) & (doc[i] != doc[j]) & _fit(size[i], size[j], percent)
            i, j = i[good], j[good]
            good = (sketch[i] == sketch[j]).sum(1) >= least
            a.append(np.minimum(doc[i[good]], doc[j[good]]))
            b.append(np.maximum(doc[i[good]], doc[j[good]]))
        a, b = np.concatenate(a or [np.zeros(0, np.int64)]), np.concatenate(b or [np.zeros(0, np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return arrow_map(grouped, run, "a long, b long")


def _apart(nodes: DataFrame, sets: DataFrame, texts: DataFrame, k: int, least: int, percent: int) -> DataFrame:
    """(a, b): links between components in large nodes (key, doc, size, label) with the figures that ``_figures`` gives for each.

    Every member outside its node's most frequent label meets all members of other labels. A node travels in blocks of about FACED
    members, each with a copy of those others in shares of as many: first as sketches; then the texts of those of a block that have
    a candidate there, whose full sets are compared in the task, so that links move, not candidate pairs. One link per member and
    other component is enough.
    """
    rows = nodes.join(sets.select("doc", "sketch"), "doc")

    def dealt(n: str):
        return F.pmod(F.xxhash64("doc"), F.col(n)).cast("int")

    def copied(n: str):
        return F.sequence(F.lit(0), F.col(n) - 1)

    # every member meets all shares in its own block; one outside the most frequent label travels to all blocks in its own share as well
    goes = F.transform(copied("shares"), lambda share: F.struct(dealt("blocks").alias("block"), share.alias("share"), F.lit(0).alias("odd")))
    odd = F.transform(copied("blocks"), lambda block: F.struct(block.alias("block"), dealt("shares").alias("share"), F.lit(1).alias("odd")))
    sent = rows.select("key", F.explode(F.when(F.col("label") == F.col("most"), goes).otherwise(F.concat(goes, odd))).alias("to"), "doc", "label", "size", "sketch")
    grouped = sent.groupBy("key", "to.block", "to.share").agg(F.collect_list(F.struct("to.odd", "doc", "label", "size", "sketch")).alias("m"))

    def wanted(batch: pa.RecordBatch):
        column = batch.column(3)
        at, inner = np.asarray(column.offsets), column.values
        odd, doc, label, size = (inner.field(c).to_numpy() for c in ("odd", "doc", "label", "size"))
        sketch = _matrix(inner.field("sketch"), np.uint8, MINIMA)
        chosen = np.zeros(len(doc), bool)
        for s, e in zip(at[:-1], at[1:]):
            for i, j in _candidates(s + np.flatnonzero(odd[s:e]), s + np.flatnonzero(odd[s:e] == 0), doc, label, size, sketch, least, percent):
                chosen[i] = chosen[j] = True
        chosen = np.flatnonzero(chosen)
        of = np.searchsorted(at, chosen, "right") - 1
        columns = [batch.column(c).take(pa.array(of)) for c in range(3)]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x[chosen]) for x in (odd, doc, label)), _binary(sketch[chosen])], ["key", "block", "share", "odd", "doc", "label", "sketch"])

    place = ["key", "block", "share"]
    members = cut(arrow_map(grouped, wanted, "key long, block int, share int, odd int, doc long, label long, sketch binary"))
    n = members.count()
    if not n:
        return members.select(F.col("doc").alias("a"), F.col("doc").alias("b"))
    found = texts.join(F.broadcast(members) if 2 * n <= SENT_ROWS else members, "doc")
    found = found.repartition(*place).sortWithinPartitions(*place).select(*place, "odd", "doc", "label", "sketch", "text")

    def run(batches):
        group, held = None, []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(3)], 1)
            odd, doc, label = (batch.column(c).to_numpy() for c in (3, 4, 5))
            sketch = _matrix(batch.column(6), np.uint8, MINIMA)
            for row, to, part in chunks(batch.column(7), CHUNK):
                values, at = shingle_sets(part, k)
                new = np.flatnonzero((keys[row + 1 : to] != keys[row : to - 1]).any(1)) + row + 1
                for s, e in zip([row, *new.tolist()], [*new.tolist(), to]):
                    if held and tuple(keys[s]) != group:
                        yield _linked(held, least, percent)
                        held = []
                    group = tuple(keys[s])
                    held.append((odd[s:e], doc[s:e], label[s:e], np.diff(at)[s - row : e - row], sketch[s:e], values[at[s - row] : at[e - row]]))
        if held:
            yield _linked(held, least, percent)

    ship(nodes.sparkSession)
    return cut(found.mapInArrow(run, "a long, b long"))


def _candidates(mine: np.ndarray, others: np.ndarray, doc: np.ndarray, label: np.ndarray, size: np.ndarray, sketch: np.ndarray, least: int, percent: int):
    """(i, j): members ``mine`` and ``others`` of other labels whose sizes and sketches agree enough, strip by strip, by i."""
    faced = np.ascontiguousarray(sketch[others].T)
    for row in range(0, len(mine), STRIP):
        few = mine[row : row + STRIP]
        i, j = np.nonzero(_agreeing(np.ascontiguousarray(sketch[few].T), faced) >= least)
        i, j = few[i], others[j]
        good = (label[i] != label[j]) & (doc[i] != doc[j]) & _fit(size[i], size[j], percent)
        yield i[good], j[good]


def _linked(held: list[tuple], least: int, percent: int) -> pa.RecordBatch:
    """Links (a, b) of a block's members, one for each member outside the most frequent label and each label it is linked with.

    The block's shingles are numbered; a member's are marked and the marks that each candidate's shingles meet are added up."""
    odd, doc, label, size, sketch, values = (np.concatenate(x) for x in zip(*held))
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    names, place = np.unique(values, return_inverse=True)
    place = place.astype(np.int32)
    mark = np.zeros(len(names), np.uint8)
    a, b = [], []
    for i, j in _candidates(np.flatnonzero(odd), np.flatnonzero(odd == 0), doc, label, size, sketch, least, percent):
        members, first = np.unique(i, return_index=True)
        for one, s, e in zip(members.tolist(), first.tolist(), [*first.tolist()[1:], len(i)]):
            own, faced = place[at[one] : at[one + 1]], j[s:e]
            mark[own] = 1
            length = size[faced]
            start = np.cumsum(length) - length
            met = mark[place[np.arange(length.sum()) + np.repeat(at[faced] - start, length)]]
            both = np.add.reduceat(met, start, dtype=np.int64)
            mark[own] = 0
            hit = faced[100 * both >= percent * (size[one] + length - both)]
            hit = hit[np.unique(label[hit], return_index=True)[1]]
            a.append(np.minimum(doc[hit], doc[one]))
            b.append(np.maximum(doc[hit], doc[one]))
    a, b = np.concatenate(a or [np.zeros(0, np.int64)]), np.concatenate(b or [np.zeros(0, np.int64)])
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _agreeing(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """In how many positions each column of ``one`` agrees with each of ``other``; long loops over one position at a time."""
    out = np.zeros((one.shape[1], other.shape[1]), np.uint8)
    same = np.empty(out.shape, bool)
    for p in range(MINIMA):
        np.equal(one[p][:, None], other[p], out=same)
        out += same.view(np.uint8)
    return out


def _figures(members: DataFrame) -> DataFrame:
    """Of each node (key, doc, size, label) with several labels: n members, most: the most frequent label, rest: members of others, and into
    how many blocks of members and shares of those others it is cut."""
    labels = members.groupBy("key", "label").agg(F.count("*").alias("count"), F.sum("size").alias("size"))
    nodes = labels.groupBy("key").agg(F.sum("count").alias("n"), F.sum("size").alias("sizes"), F.max(F.struct("count", "label", "size")).alias("most"))

    def cuts(n, sizes):
        return F.greatest(F.ceil(n / FACED), F.ceil(sizes / FACED_SHINGLES)).cast("int")

    rest, left = F.col("n") - F.col("most.count"), F.col("sizes") - F.col("most.size")
    return nodes.select("key", "n", F.col("most.label").alias("most"), rest.alias("rest"), cuts(F.col("n"), F.col("sizes")).alias("blocks"), cuts(rest, left).alias("shares")).where("rest > 0")


def _affordable(counts: DataFrame, allowed: int) -> int:
    """The greatest power of two such that comparing the large nodes (n, rest) with at most so many members outside their most
    frequent label takes at most ``allowed`` comparisons."""
    power = F.ceil(F.log2("rest")).cast("int")
    work = sorted(counts.groupBy(power.alias("power")).agg(F.sum(F.col("n").cast("double") * F.col("rest")).alias("work")).collect())
    limit, total = 0, 0.0
    for k, n in work:
        total += n
        if total > allowed:
            break
        limit = 2**k
    return limit


def confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full shingle sets; repeated where an id has
    several texts.

    Pairs are grouped by a. A group travels in blocks of about BLOCK members, each with a copy of a's text, so no
    task holds a large group; only texts that occur in pairs are moved.
    """
    pairs = cut(pairs)
    n = pairs.count()
    if not n:
        return pairs
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    rows = pairs.join(blocks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"))
    wanted = rows.select("a", "block", F.col("b").alias("doc"), F.lit(0).alias("lead")).unionByName(
        blocks.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("a").alias("doc"), F.lit(1).alias("lead"))
    )
    small = 2 * n <= SENT_ROWS  # a pair is one wanted row, a block another, and there are no more blocks than pairs
    found = texts.join(F.broadcast(wanted) if small else wanted, "doc")
    found = found.repartition("a", "block").sortWithinPartitions("a", "block", F.desc("lead")).select("a", "block", "doc", "lead", "text")
    ship(pairs.sparkSession)

    def run(batches):
        group, first = None, []
        for batch in batches:
            key = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            doc, lead = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            a, b = [], []
            for row, to, part in chunks(batch.column(4), CHUNK):
                values, at = shingle_sets(part, k)
                for r in range(row, to):
                    mine = values[at[r - row] : at[r - row + 1]]
                    if key[r] != group:
                        group, first = key[r], []
                    if lead[r]:
                        first.append(mine.copy())
                        continue
                    for other in first:
                        least, most = sorted((len(mine), len(other)))
                        if 100 * least < percent * most:
                            continue
                        both = len(np.intersect1d(mine, other, assume_unique=True))
                        if 100 * both >= percent * (least + most - both):
                            a.append(group[0])
                            b.append(doc[r])
                            break
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return cut(found.mapInArrow(run, "a long, b long"))


def near_duplicates(docs: DataFrame, k: int, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``; other columns are ignored, whatever their names.

    Two texts are linked if 100 * intersection >= percent * union of their sets of k-word shingles (A-Z lower-cased);
    component_id is the smallest id reachable over links, the own one included, and that document is kept. Null
    and empty texts, and texts of blanks, have no shingle and are linked with nothing. Rows that share an id count as one
    document with all their texts. A row without an id is linked with nothing, has a null component_id and is
    kept. An empty table gives an empty result. Every link reported is confirmed on full sets (equal sets: on size and
    a 128-bit fingerprint); a pair at exactly ``percent`` is missed with a probability of 1 - RECALL (1 %) at most, however
    large and alike the texts around it, and nearer pairs less often.
    """
    threshold, least = percent / 100, int((percent / 100 - SLACK) * MINIMA)
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    every = cut(_sets_of(rows, k))
    full = every.where("n_shingles > 0 and doc_id is not null")
    equal = ["f1", "f2", "n_shingles"]
    classes = cut(full.groupBy(*equal).agg(F.min(F.struct("doc_id", "sig", "sketch")).alias("x")).select(*equal, F.col("x.doc_id").alias("doc"), "x.sig", "x.sketch"))
    sets = classes.select("doc", F.col("n_shingles").alias("size"), "sig", "sketch")
    n_sets = sets.count()
    texts = rows.where("doc_id is not null").withColumnRenamed("doc_id", "doc")

    links = cut(_same_class(full, classes, equal))
    labels = components(links)
    level, depth, deepest = _first_level(sets, threshold), 1, _deepest(threshold)
    while True:
        wave = []
        for _ in range(1 if depth == 1 else min(LEVELS, deepest + 1 - depth)):  # large groups of copies are found, and done, at the first level
            nodes = _nodes(level)
            wave.append(nodes)
            depth += 1
            if depth > deepest or nodes.where(F.col("n") > SMALL).isEmpty():
                break
            level = _next_level(nodes.where(F.col("n") > SMALL), sets, threshold)
        met = wave[0]
        for nodes in wave[1:]:
            met = met.unionByName(nodes)
        stars = _labelled(met.select(F.col("leader").alias("doc"), F.col("doc").alias("b")), labels, "a", "la")
        stars = _labelled(stars.withColumnRenamed("b", "doc"), labels, "b", "lb").where("a < b and la <> lb").select("a", "b").distinct()
        found = confirm(_alike(stars, sets, least), texts, k, percent)
        if not found.isEmpty():
            links = links.unionByName(found)
            labels = components(links)
        small = met.where((F.col("n") > 2) & (F.col("n") <= SMALL)).select("key", "doc")
        deep = _labelled(wave[-1].where(F.col("n") > SMALL).select("key", "doc"), labels, "doc", "label")
        deep = cut(deep.join(sets.select("doc", "size"), "doc"))
        counts = cut(_figures(deep))
        few = F.lit(True) if depth > deepest else F.col("rest") <= _affordable(counts, COMPARED * n_sets)
        near = _within(_labelled(small, labels, "doc", "label"), sets, least, percent)
        found = confirm(near.distinct(), texts, k, percent).unionByName(_apart(deep.join(counts.where(few), "key"), sets, texts, k, least, percent))
        if not found.isEmpty():
            links = links.unionByName(found)
            labels = components(links)
        many = cut(deep.join(counts.where(~few), "key").select("key", "doc"))
        if many.isEmpty():
            break
        level = _next_level(many, sets, threshold)

    own = every.join(classes.select(*equal, "doc"), equal, "left")
    named = own.join(labels.toDF("doc", "component"), "doc", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc", "doc_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _same_class(full: DataFrame, classes: DataFrame, equal: list[str]) -> DataFrame:
    """(a, b): links among the classes of ids that have several texts."""
    several = full.select("doc_id", *equal).distinct().groupBy("doc_id").count().where("count > 1").select("doc_id")
    ids = full.join(several, "doc_id").select("doc_id", *equal).distinct().join(classes.select(*equal, "doc"), equal)
    return ids.select(F.least("doc_id", "doc").alias("a"), F.greatest("doc_id", "doc").alias("b")).where("a < b")


def _labelled(rows: DataFrame, labels: DataFrame, doc: str, label: str) -> DataFrame:
    """``rows`` with their ``doc`` named ``doc`` and its component, itself where it has none, named ``label``."""
    return rows.join(labels.toDF("doc", "_label"), "doc", "left").withColumn(label, F.coalesce("_label", "doc")).drop("_label").withColumnRenamed("doc", doc)


@query("op4_near_dup")
def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4)
