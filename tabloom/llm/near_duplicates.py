"""Near-duplicates by a chosen-path set similarity join.

A document is its set of word shingles; documents with equal sets are one *text*. Each text has
minwise tokens: a whole one for each tree, a byte of each that paths branch by, two bits of each
that a longer sketch compares. Every tree sorts the texts by one token into nodes; a node that is still
large is branched again by tokens that its own path selects, each of which two similar texts share
with the probability of their similarity. With on average ``SPREAD`` / threshold branches a node, more
than 1 / threshold, a pair at the threshold stays together in some node of a tree with a probability
that does not fade with the depth. There are as many trees as ``RECALL`` takes at exactly the threshold
and the last depth.

First every node of a tree's first tokens is compared by sketch: a small one whole, a large one in
blocks of texts to which the same few pivots are added, so that groups of thousands of near copies
become connected by a number of pairs that grows with the group, not with its square. A task returns
the pairs that connect its block; they are confirmed on the full sets, and links become components.

Later depths look only at nodes that hold several components. Nodes of up to ``SMALL`` texts are
compared exhaustively, wide block against wide block, each two of them a group of their own; larger
ones are branched. If one component fills a node but for a few texts, these go to every block of the
node instead. In a group the sketches name the texts that have a possible partner of another component,
only these get their text, and the task that holds them compares the full sets: it returns the links
that connect its components, at most one a text, and no pair leaves it. Nodes that are still larger
after ``DEPTH`` branchings are compared block against block as well.

No task sees more than two wide blocks, apart from the texts of one pair; nothing is collected to the
driver but counts; every step that others read is a table in the shared folder.

Defined results: null or empty texts, or texts without words, have no shingles, are their own
component and are kept; a text with fewer words than a shingle is one shingle; a component's id is
its smallest id, a null id counts as larger than any; repeated rows get equal rows, kept alike; an
empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tabloom.llm.common import BLANK, as_long, bucketed, table, text_or_empty, worker_table, written

BLOCK, PIVOTS, DEPTH = 64, 8, 10
#: Share of the pairs at exactly the threshold that meet although every node is branched to the last
#: depth, the trees it takes at least, and nodes a pair at the threshold goes on in for each it is in.
RECALL, LEAST_TREES, SPREAD = 0.999, 10, 1.2
#: Texts of a block when every block of a node meets every other, and the largest node that is
#: compared so before the last depth.
WIDE, SMALL = 2048, 8192
#: Rows and columns of the matrices that count overlaps.
CELLS = 512
#: Minwise tokens of a set, and how many of them, the last ones, choose paths.
TOKENS, PATHS = 512, 128
#: Standard errors that a sketch's estimate may lie below the threshold.
ERRORS = 3.5
KEPT_WORDS = 400_000
NO_ID = (1 << 63) - 1
_U = np.uint64


def _seeds(n: int, salt: int) -> np.ndarray:
    x = (np.arange(1, n + 1, dtype=np.uint64) + _U(salt << 20)) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_FLIP, _MULTIPLY = (x.astype(np.uint32)[:, None] for x in (_seeds(TOKENS, 1) >> _U(32), _seeds(TOKENS, 2) >> _U(32) | _U(1)))


class _Words:
    """64-bit hashes of words; frequent words are hashed once a task."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        try:
            return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            import xxhash

            if len(self.known) > KEPT_WORDS:
                self.known = {}
            for w in words:
                if w not in self.known:
                    self.known[w] = xxhash.xxh3_64_intdigest(w)
            return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    words = text.lower().split()  # of bytes: A-Z, and space and tab to carriage return
    if not words:
        return np.empty(0, np.uint64)
    codes, n = worker_table("shingle words", _Words)(words), min(size, len(words))
    m = len(codes) - n + 1
    out = np.full(m, n, np.uint64)
    for j in range(n):
        out = (out ^ (out >> _U(29))) * _U(0xBF58476D1CE4E5B9) + codes[j : j + m]
    out = (out ^ (out >> _U(32))) * _U(0x94D049BB133111EB)
    return np.unique(out ^ (out >> _U(29)))


def second_branch(threshold: float) -> float:
    """Share of nodes that branch by two tokens instead of one."""
    return min(1.0, round(SPREAD / threshold - 1, 2))


def recall(threshold: float, trees: int, depth: int) -> float:
    """Probability that a pair at the threshold shares a node of some tree after ``depth`` branchings.
    Paths of all trees draw on the same tokens, so it is averaged over how many of them the pair shares."""
    two, total = second_branch(threshold), 0.0
    for k in range(PATHS + 1):
        stays, lasts = k / PATHS, 1.0
        for _ in range(depth):
            lasts = (1 - two) * stays * lasts + two * (1 - (1 - stays * lasts) ** 2)
        total += math.comb(PATHS, k) * threshold**k * (1 - threshold) ** (PATHS - k) * (1 - (1 - threshold * lasts) ** trees)
    return total


def trees_for(threshold: float) -> int:
    for trees in range(LEAST_TREES, TOKENS - PATHS + 1):
        if recall(threshold, trees, DEPTH) >= RECALL:
            return trees
    raise ValueError(f"no number of trees finds {RECALL} of the pairs at {threshold}")


def sketch(hashes: np.ndarray, trees: int) -> tuple[np.ndarray, bytes, bytes]:
    """The first token of each tree, a byte of each token of ``PATHS``, two bits of every token."""
    least, short = np.full(TOKENS, 0xFFFFFFFF, np.uint32), (hashes >> _U(32)).astype(np.uint32)
    for at in range(0, len(short), 128):
        part = short[None, at : at + 128] ^ _FLIP
        part *= _MULTIPLY
        np.minimum(least, part.min(axis=1), out=least)
    low = (least >> np.uint32(4)).astype(np.uint8)
    two = (low & 3).reshape(-1, 4)
    return least[:trees].astype(np.int32), low[-PATHS:].tobytes(), (two[:, 0] | two[:, 1] << 2 | two[:, 2] << 4 | two[:, 3] << 6).tobytes()


def agreement(sketches: np.ndarray, one: np.ndarray) -> np.ndarray:
    """In how many tokens rows of packed sketches agree with one."""
    differ = sketches ^ one
    return TOKENS - np.bitwise_count((differ | differ >> _U(1)) & _U(0x5555555555555555)).sum(axis=1, dtype=np.int64)


def _measured(size: int, trees: int):
    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, sketches = [], [], ([], [], [])
            for text in batch.column(1):
                hashes = shingles(text.as_buffer().to_pybytes(), size)
                counts.append(len(hashes))
                digests.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None)
                for held, part in zip(sketches, sketch(hashes, trees) if len(hashes) else (None, None, None)):
                    held.append(part)
            types = [pa.list_(pa.int32()), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), *map(pa.array, sketches, types)],
                ["key", "n", "digest", "starts", "paths", "bits"],
            )

    return measure


def _groups(batches: Iterable[pa.RecordBatch], last: str) -> Iterator[tuple]:
    """Rows of one (node, block) after another, each text once: the group, and ids, components, sides
    (texts of one side other than 0 are paired among themselves elsewhere), set sizes, and the column
    ``last``, sketches or texts."""
    held: list[tuple] = []
    group = None

    def whole() -> tuple:
        ids, *others = (np.concatenate(x) for x in zip(*held))
        ids, first = np.unique(ids, return_index=True)
        return group, ids, *(x[first] for x in others)

    for batch in batches:
        if not batch.num_rows:
            continue
        node, block, ids, comps, counts, side = (batch.column(c).to_numpy() for c in ("node", "block", "id", "comp", "count", "side"))
        if last == "bits":
            values = np.frombuffer(b"".join(batch.column(last).to_pylist()), _U).reshape(len(ids), -1)
        else:
            values = np.empty(len(ids), object)
            values[:] = batch.column(last).to_pylist()
        cuts = np.flatnonzero((node[1:] != node[:-1]) | (block[1:] != block[:-1])) + 1
        for a, b in zip([0, *cuts], [*cuts, len(node)]):
            here = (int(node[a]), int(block[a]))
            if held and here != group:
                yield whole()
                held = []
            group = here
            held.append((ids[a:b], comps[a:b], side[a:b], counts[a:b], values[a:b]))
    if held:
        yield whole()


def _partners(i: int, comps: np.ndarray, side: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """Which texts after ``i`` it may be linked with: of another component, not paired elsewhere, of a size that allows it."""
    c, n = counts[i + 1 :], counts[i]
    may = (comps[i + 1 :] != comps[i]) & (100 * np.minimum(c, n) >= percent * np.maximum(c, n))
    return may & (side[i + 1 :] != side[i]) if side[i] else may


def _connecting(pairs: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Those of the pairs that connect what the ones before do not."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    for x, y in pairs:
        a, b = root(x), root(y)
        if a != b:
            parent[max(a, b)] = min(a, b)
            yield x, y


def _alike(least: float, percent: int):
    """Pairs that connect a group, the most alike first, of different components whose sketches agree
    in at least ``least`` tokens and whose sizes allow the similarity."""

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, comps, side, counts, bits in _groups(batches, "bits"):
            near = []
            for i in range(len(ids) - 1):
                agree = agreement(bits[i + 1 :], bits[i])
                at = np.flatnonzero(_partners(i, comps, side, counts, percent) & (agree >= least))
                near += zip((-agree[at]).tolist(), [i] * len(at), (at + i + 1).tolist())
            pairs = list(_connecting((a, b) for _, a, b in sorted(near)))
            if pairs:
                a, b = np.array(pairs).T
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[a], ids[b], comps[a], comps[b])], ["a", "b", "ca", "cb"])

    return compare


def _possible(least: float, percent: int):
    """The rows of a group whose sketch has a partner, as in ``_alike``."""

    def select(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (node, block), ids, comps, side, counts, bits in _groups(batches, "bits"):
            some = np.zeros(len(ids), bool)
            for i in range(len(ids) - 1):
                found = _partners(i, comps, side, counts, percent) & (agreement(bits[i + 1 :], bits[i]) >= least)
                some[i + 1 :] |= found
                some[i] |= found.any()
            if some.any():
                n = int(some.sum())
                columns = [np.full(n, node), np.full(n, block), ids[some], comps[some], counts[some], side[some]]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["node", "block", "id", "comp", "count", "side"])

    return select


def _overlaps(sets: list[np.ndarray]) -> Iterator[np.ndarray]:
    """How many members each set shares with each, a slab of rows of that matrix after another."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, code, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    code, owner = (np.cumsum(held > 1) - 1)[code[held[code] > 1]], owner[held[code] > 1]  # those of one set alone overlap nothing
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    width = int(code[-1]) + 1 if len(code) else 0
    for top in range(0, len(sets), CELLS):
        slab = np.zeros((min(CELLS, len(sets) - top), len(sets)), np.float32)
        for left in range(0, width, CELLS):
            a, b = np.searchsorted(code, [left, left + CELLS])
            holds = np.zeros((len(sets), CELLS), np.float32)
            holds[owner[a:b], code[a:b] - left] = 1
            slab += holds[top : top + CELLS] @ holds.T
        yield slab


def _linked(size: int, percent: int):
    """Links that connect the components of a group, by the full sets of its texts."""

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, comps, side, counts, texts in _groups(batches, "text"):
            label, found, i = comps.copy(), [], 0  # components as the links so far make them
            for slab in _overlaps([shingles(x, size) for x in texts]):
                for row in slab:
                    both = row[i + 1 :].astype(np.int64)
                    linked = 100 * both >= percent * (counts[i] + counts[i + 1 :] - both)
                    at = i + 1 + np.flatnonzero(linked & _partners(i, label, side, counts, percent))
                    others, first = np.unique(label[at], return_index=True)
                    if len(others):
                        found += zip([int(comps[i])] * len(others), comps[at[first]].tolist())
                        label[np.isin(label, others)] = label[i]
                    i += 1
            if found:
                a, b = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return link


def _confirmed(size: int, percent: int):
    def confirm(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            last, one = None, None
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(4), batch.column(5)):
                if a != last:
                    last, one = a, shingles(x.as_buffer().to_pybytes(), size)
                other = shingles(y.as_buffer().to_pybytes(), size)
                both = len(np.intersect1d(one, other, assume_unique=True))
                linked.append(100 * both >= percent * (len(one) + len(other) - both))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(linked, pa.bool_())], ["a", "b", "ca", "cb", "linked"])

    return confirm


def components(links: DataFrame) -> DataFrame:
    """``(id, comp)``: the smallest id each linked id reaches, by rounds in which every id hands
    its neighbours to the smallest of them; a chain halves with each round."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        # large star: larger neighbours move to the smallest neighbour
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours, and the id itself, move to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(least, "u")
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(met.select("u", F.col("m").alias("v"))).filter(F.col("u") != F.col("v")).distinct()
        after = written(small, "links")
        # stars everywhere: every id points to one that points nowhere
        ends = after.select("u", F.lit(1).alias("out")).union(after.select(F.col("v").alias("u"), F.lit(0).alias("out")))
        ends = ends.groupBy("u").agg(F.sum("out").alias("outs"), F.min("out").alias("met"))
        edges = after
        if ends.filter("outs > 1 OR (outs = 1 AND met = 0)").isEmpty():
            return edges.select(F.col("u").alias("id"), F.col("v").alias("comp"))


def _child(node: Column, paths: Column, branch: int) -> Column:
    """The node below ``node`` for one of the tokens that the node selects."""
    which = F.pmod(F.xxhash64(node, F.lit(branch)), F.lit(PATHS)).cast("int")
    return F.xxhash64(node, which, F.substring(paths, which + 1, F.lit(1)))


def _facing(large: DataFrame) -> DataFrame:
    """Each two wide blocks of a node as one group, in which only texts of different blocks are
    paired, and each block with itself."""
    n = F.ceil(F.col("size") / WIDE).cast("long")
    dealt = large.select("node", "id", "comp", n.alias("n"), F.pmod(F.xxhash64("id"), n).alias("own"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    block = F.least("own", "other") * F.col("n") + F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return met.select("node", block.alias("block"), "id", "comp", side.alias("side"))


def _joined(docs: DataFrame, key: str, text: str, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows ``(id, order, h, n, digest)``, and for each digest the first ``(order, h)`` of its component."""
    threshold = percent / 100
    trees = trees_for(threshold)
    share = threshold + (1 - threshold) / 4  # two bits agree by chance too
    least = TOKENS * (share - ERRORS * (share * (1 - share) / TOKENS) ** 0.5)
    rows = docs.select(
        F.struct(as_long(key).alias("id"), F.coalesce(as_long(key), F.lit(NO_ID)).alias("order"), F.xxhash64(text_or_empty(text)).alias("h")).alias("key"),
        F.encode(text_or_empty(text), "utf-8").alias("text"),
    )
    schema = f"key {rows.schema['key'].dataType.simpleString()}, n long, digest binary, starts array<int>, paths binary, bits binary"
    sets = written(rows.mapInArrow(_measured(size, trees), schema).select("key.*", "n", "digest", "starts", "paths", "bits"), "shingle-sets")
    texts = written(
        sets.filter("n > 0").groupBy("digest").agg(F.min(F.struct("order", "h", "n", "starts", "paths", "bits")).alias("first")).select("digest", "first.*")
        .withColumn("node_id", F.monotonically_increasing_id()),
        "distinct-sets",
    )
    known = texts.select(F.col("node_id").alias("id"), F.col("n").alias("count"), "bits")
    ways = texts.select(F.col("node_id").alias("id"), "paths")
    # each tree's first token
    nodes = texts.select(F.col("node_id").alias("id"), F.explode(F.array(*[F.xxhash64(F.lit(t), F.get("starts", F.lit(t))) for t in range(trees)])).alias("node"))
    comps, bodies = None, None
    for depth in range(DEPTH + 1):
        # of every node: its size, its largest component and how many texts that has
        if comps is None:
            placed = nodes.withColumn("comp", F.col("id"))
            sizes = placed.groupBy("node").agg(F.count("*").alias("size"), F.lit(1).cast("long").alias("most"), F.min("comp").alias("main"))
        else:
            placed = nodes.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
            parts = placed.groupBy("node", "comp").agg(F.count("*").alias("of_comp"))
            sizes = parts.groupBy("node").agg(F.sum("of_comp").alias("size"), F.max(F.struct("of_comp", "comp")).alias("top")).select("node", "size", F.col("top.of_comp").alias("most"), F.col("top.comp").alias("main"))
        active = written(placed.join(sizes.filter("size > most"), "node"), "nodes")
        blocks = F.when(F.col("size") > 2 * BLOCK, F.ceil(F.col("size") / BLOCK)).otherwise(1).cast("long")
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / BLOCK).cast("long") - 1)).alias("block")
        # the few texts outside the component that fills a node meet all of its blocks
        few = F.col("size") - F.col("most") <= 2 * BLOCK
        outside = (F.col("size") > 2 * BLOCK) & few & (F.col("comp") != F.col("main"))
        apart = active.filter(outside).select("node", every, "id", "comp")
        crowded = (F.col("size") > 2 * BLOCK) & ~few
        faced = crowded & (F.lit(depth == DEPTH) | (F.col("size") <= SMALL)) if depth else F.lit(False)
        members = active.filter(~outside & ~faced).select("node", F.pmod(F.xxhash64("id", F.lit(depth)), blocks).alias("block"), "id", "comp")
        # pivots of another large node come from its smallest components, another set at each depth
        large = active.filter(crowded & ~faced)
        share = large.groupBy("node", "comp").agg(F.count("*").alias("of_comp"))
        rank = F.struct("of_comp", F.xxhash64("id", F.lit(depth + 1)).alias("by"), "id", "comp", "size")
        chosen = large.join(share, ["node", "comp"]).groupBy("node", F.pmod(F.xxhash64("id"), F.lit(PIVOTS)).alias("slot")).agg(F.min(rank).alias("p"))
        pivots = chosen.select("node", "p.id", "p.comp", "p.size").select("node", every, "id", "comp")
        # those in every block are paired among themselves in the first
        added = apart.union(pivots).withColumn("side", (F.col("block") > 0).cast("int"))
        grouped = members.withColumn("side", F.lit(0)).union(added)
        if depth:
            grouped = grouped.union(_facing(active.filter(faced)))
        grouped = grouped.join(known, "id").select("node", "block", "id", "comp", "count", "side", "bits")
        dealt = grouped.repartition("node", "block").sortWithinPartitions("node", "block")
        if bodies is None:  # texts of any depth come from nodes that the first depth found active
            want = texts.join(active.select(F.col("id").alias("node_id")).distinct(), "node_id", "left_semi").select(F.col("node_id").alias("id"), "order", "h")
            bodies, title = bucketed(rows.select("key.order", "key.h", "text").join(want, ["order", "h"]).dropDuplicates(["order", "h"]).select("id", "text"), "texts", "id")
        if depth:
            group = "node long, block long, id long, comp long, count long, side int"
            possible = written(dealt.mapInArrow(_possible(least, percent), group), "possible")
            full = possible.join(bodies, "id").repartition("node", "block").sortWithinPartitions("node", "block")
            new = written(full.mapInArrow(_linked(size, percent), "a long, b long").distinct(), "links")
        else:
            pairs = written(dealt.mapInArrow(_alike(least, percent), "a long, b long, ca long, cb long").distinct(), "pairs")
            met = pairs.join(bodies.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(bodies.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
            tested = met.select("a", "b", "ca", "cb", "x", "y").mapInArrow(_confirmed(size, percent), "a long, b long, ca long, cb long, linked boolean")
            new = written(tested.filter("linked").select(F.col("ca").alias("a"), F.col("cb").alias("b")), "links")
        if not new.isEmpty():  # links between components so far make larger ones of them
            merged = components(new)
            if comps is not None:
                moved = comps.join(merged.select(F.col("id").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
                merged = written(moved.union(merged), "components")
            comps = merged
        if depth == DEPTH or depth and large.isEmpty():
            break
        if not depth:  # the pairs that connect them are known, so nodes of one component can go
            nodes = active.select("id", "node")
            continue
        nodes = written(large.join(ways, "id").select("id", F.explode(F.array_distinct(F.array(
            _child(F.col("node"), F.col("paths"), 1),
            F.when(F.pmod(F.xxhash64("node"), F.lit(100)) < round(100 * second_branch(threshold)), _child(F.col("node"), F.col("paths"), 2)),
        ))).alias("node")).filter("node IS NOT NULL"), "branches")
    docs.sparkSession.sql(f"DROP TABLE IF EXISTS {title}")
    if comps is None:
        labelled = texts.select("digest", "order", "h", F.col("node_id").alias("comp"))
    else:
        labelled = texts.join(comps, F.col("node_id") == F.col("id"), "left").select("digest", "order", "h", F.coalesce("comp", "node_id").alias("comp"))
    lowest = labelled.groupBy("comp").agg(F.min(F.struct("order", "h")).alias("first"))
    return sets.drop("starts", "paths", "bits"), written(labelled.join(lowest, "comp").select("digest", "first"), "components")


def linked_components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, percent: int = 80) -> DataFrame:
    """``(key, n_shingles, component_id, kept)`` for every row of ``docs``."""
    sets, firsts = _joined(docs, key, text, size, percent)
    own = F.when(F.col("digest").isNull(), F.col("id")).when(F.col("first.order") < NO_ID, F.col("first.order"))
    return sets.join(firsts, "digest", "left").select(
        F.col("id").alias("key"), F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept")
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of every component, the one of the smallest id (then of the smallest
    text hash); rows without words are components of their own."""
    sets, firsts = _joined(docs, key, text, size, percent)
    stay = written(sets.join(firsts, "digest").filter("order = first.order AND h = first.h").select("order", "h").distinct(), "survivors")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # apart from the columns added here
    keyed = docs.select(row, F.coalesce(as_long(key), F.lit(NO_ID)).alias("order"), F.xxhash64(text_or_empty(text)).alias("h"))
    without = F.btrim(text_or_empty(text), F.lit(BLANK)) == ""
    # of rows equal in id and text one stays
    first = keyed.join(stay, ["order", "h"]).dropDuplicates(["order", "h"])
    return first.select("row.*").union(docs.filter(without))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_components(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")
