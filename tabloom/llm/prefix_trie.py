"""Prefix trie of conversations from padded matrices of turn ids.

Conversations are sequences of turns, a turn being its role and text. Equal sequences are counted
once with their number. Sorted sequences give the trie without building it: in a matrix with a row a
sequence and a column a depth (padded with 0), a node of depth d starts where any of the first d columns
changes, so the column changes OR-ed from left to right mark the starts of all nodes, and a
``reduceat`` over the starts of a depth aggregates all its nodes.

* **Shards.** Sequences are dealt by ranges of their turns, so a node's rows are neighbours and only the
  nodes on the path of a shard's first or last row can reach into another shard. A task returns all others
  finished, and the two paths as rows with what is known of their nodes. These rows, two a shard, go
  through the same step again until one matrix holds them all.
* **Blocks.** A matrix covers 32 depths, the next one 64, then 128 and so on. Only sequences whose prefix
  up to a block is shared with another sequence enter it; the rest of an unshared sequence is a chain whose
  nodes are plain rows. Blocks are worked from the deepest up, and what a block finds below a prefix is
  added to one row that ends there.
* **Turns** are 128 bits of hashes of role and text; a prefix is the XOR of the hashes of its
  (depth, turn), which needs no order and no group in one task. Positions come from ranges: a
  conversation of any size is spread over tasks, and the few that go on into a next range get offsets.

Defined results: rows without a conversation id are left out; null turns come first; equal turns are
ordered by their hash; null roles and texts are empty; repeated rows are turns of their own; an empty
table has no members, so no root either; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tabloom.llm.common import as_long, table, text_or_empty, written

WIDTH = 32  # depths of the first block; each further block has twice as many
CELLS = 1 << 20  # cells of a matrix
LEAST = 64  # rows of a matrix at least, so that two open paths a shard are few
HEADS = 5  # turns that the rule of rebuilt conversations takes from another one, at most
NONE = np.iinfo(np.int64).max

NODE, NAME, GROUP, PATH = range(4)
_CELL = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("chars", pa.int64())]))
_KNOWN = ("n", "low", "children", "leaves", "saved", "ended")
_ACC = pa.list_(pa.struct([(x, pa.int64()) for x in _KNOWN]))
_OUT = pa.schema(
    [
        ("kind", pa.int32()), ("depth", pa.int64()), ("low", pa.int64()), ("parent", pa.int64()), ("parent_key", pa.binary()), ("n", pa.int64()),
        ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("ended", pa.int64()), ("name", pa.binary()),
        ("p1", pa.int64()), ("p2", pa.int64()), ("x1", pa.int64()), ("x2", pa.int64()), ("goes", pa.bool_()), ("key", pa.int64()),
        ("cells", _CELL), ("acc", _ACC),
    ]
)
_CELL_DDL = "array<struct<a:bigint,b:bigint,chars:bigint>>"
_ACC_DDL = "array<struct<" + ",".join(f"{x}:bigint" for x in _KNOWN) + ">>"
_OUT_DDL = (
    "kind int, depth bigint, low bigint, parent bigint, parent_key binary, n bigint, children bigint, leaves bigint, saved bigint, ended bigint, "
    f"name binary, p1 bigint, p2 bigint, x1 bigint, x2 bigint, goes boolean, key bigint, cells {_CELL_DDL}, acc {_ACC_DDL}"
)
_ROW = ["p1", "p2", "x1", "x2", "goes", "key", "n", "children", "leaves", "saved", "cells", "acc"]


# -- a matrix -------------------------------------------------------------------

def _dense(*columns: np.ndarray) -> np.ndarray:
    """Numbers from 1 in the order of the columns' values, equal values alike."""
    order = np.lexsort(columns[::-1])
    changed = np.zeros(len(order), bool)
    changed[:1] = True
    for c in columns:
        s = c[order]
        changed[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(changed)
    return out


def _key(p1: int, p2: int, cells: bytes = b"") -> bytes:
    return hashlib.md5(struct.pack(">qq", p1, p2) + cells).digest()


class Matrix:
    """Sequences of one block, sorted: turn ids by depth, and what is known of each row's nodes."""

    def __init__(self, rows: pa.Table):
        column = lambda name: rows.column(name).combine_chunks()
        numbers = lambda name: column(name).fill_null(0).to_numpy(zero_copy_only=False)
        cells = column("cells")
        flat = cells.flatten()
        length = np.diff(cells.offsets.to_numpy(zero_copy_only=False)).astype(np.int64)
        a, b, chars = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        n, width = len(length), int(length.max())
        at = np.repeat(np.arange(n), length), np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        ids = np.zeros((n, width), np.int64)
        ids[at] = _dense(a, b)
        p1, p2, key = numbers("p1"), numbers("p2"), numbers("key")
        group = _dense(p1, p2)
        order = np.lexsort((key, *ids.T[::-1], group))
        place = lambda values: self._square(values, at, n, width)[order]
        self.ids, self.group, self.length = ids[order], group[order], length[order]
        self.a, self.b, self.chars = place(a), place(b), place(chars)
        self.p1, self.p2, self.key = p1[order], p2[order], key[order]
        self.x1, self.x2, self.goes = (numbers(x)[order] for x in ("x1", "x2", "goes"))
        self.width = width
        known = self._known(rows, length, width, numbers, key)
        self.n, self.low, self.children, self.leaves, self.saved, self.ended = (known[x][order] for x in _KNOWN)

    @staticmethod
    def _square(values, at, n, width):
        out = np.zeros((n, width), np.int64)
        out[at] = values
        return out

    @staticmethod
    def _known(rows, length, width, numbers, key) -> dict[str, np.ndarray]:
        """For each row and depth 0 to its length, what earlier steps found at that node."""
        n = len(length)
        inside = np.arange(width + 1)[None] <= length[:, None]
        acc = rows.column("acc").combine_chunks()
        if acc.null_count < n:
            flat = acc.flatten()
            out = {}
            for i, x in enumerate(_KNOWN):
                out[x] = np.full((n, width + 1), NONE if x in ("low", "ended") else 0, np.int64)
                out[x][inside] = flat.field(i).to_numpy(zero_copy_only=False)
            return out
        last = np.arange(width + 1)[None] == length[:, None]
        goes = numbers("goes").astype(bool)
        out = {"n": inside * numbers("n")[:, None], "low": np.where(inside, key[:, None], NONE)}
        out |= {x: last * numbers(x)[:, None] for x in ("children", "leaves", "saved")}
        return out | {"ended": np.where(last & ~goes[:, None], key[:, None], NONE)}

    def nodes(self, base: int, full: int, alone: bool, named: bool) -> Iterator[pa.Table]:
        """Finished nodes, names by which others find their parent, groups, and the two open paths.

        ``base`` is the depth before the block, ``full`` its width. ``alone``: no other matrix holds
        rows of these nodes. ``named``: its nodes were open before, so others may look for them."""
        rows = len(self.length)
        change = np.empty((rows, self.width + 1), bool)
        change[0] = True
        change[1:, 0] = self.group[1:] != self.group[:-1]
        change[1:, 1:] = self.ids[1:] != self.ids[:-1]
        starts = np.logical_or.accumulate(change, axis=1)
        below = {x: np.zeros(rows, np.int64) for x in ("children", "leaves", "saved")}
        found: list[dict] = [{}] * (self.width + 1)
        for d in range(self.width, -1, -1):
            at = np.flatnonzero(starts[:, d])
            node = {x: np.add.reduceat(getattr(self, x)[:, d], at) for x in ("n", "children", "leaves", "saved")}
            node |= {x: np.minimum.reduceat(getattr(self, x)[:, d], at) for x in ("low", "ended")}
            for x in below:
                node[x] = node[x] + np.add.reduceat(below[x], at)
            real = self.length[at] >= d
            open_ = np.zeros(len(at), bool)
            if not alone:
                open_[[0, -1]] = True
            done = real & ~open_
            chars = self.chars[at, d - 1] if d else np.zeros(len(at), np.int64)
            finished = {"leaves": node["leaves"] + (node["children"] == 0), "saved": node["saved"] + (node["n"] - 1) * chars}
            for x in finished:
                node[x] = np.where(done, finished[x], node[x])
            below = {x: np.zeros(rows, np.int64) for x in below}
            below["children"][at[done]] = 1
            for x in finished:
                below[x][at[done]] = node[x][done]
            found[d] = node | {"at": at, "open": open_, "done": done}
        for d, node in enumerate(found):
            if not node["done"].any():
                continue
            if d or not base:
                yield self._finished(found, d, base)
            else:
                yield self._groups(node)
            # where a later block begins, its parent has its name from the block before
            names = self._names(node, d, full, named and (d > 0 or not base))
            if names:
                yield self._out(NAME, len(names), name=pa.array([k for k, _ in names], pa.binary()), low=pa.array([v for _, v in names], pa.int64()))
        if not alone:
            yield self._paths(found, full)

    def _finished(self, found: list[dict], d: int, base: int) -> pa.Table:
        node = found[d]
        done = node["done"]
        at = node["at"][done]
        numbers = {x: pa.array(node[x][done]) for x in ("low", "n", "children", "leaves", "saved")}
        numbers["ended"] = pa.array(node["ended"][done], mask=node["ended"][done] == NONE)
        parent, keys = None, [None] * len(at)
        if d:
            up = found[d - 1]
            mine = np.searchsorted(up["at"], at, side="right") - 1
            away = up["open"][mine] | (base > 0 and d == 1)
            parent = pa.array(up["low"][mine], mask=away)
            memo: dict[int, bytes] = {}
            for i in np.flatnonzero(away).tolist():
                m = int(mine[i])
                if m not in memo:
                    memo[m] = self._path_key(int(up["at"][m]), d - 1)
                keys[i] = memo[m]
        return self._out(NODE, len(at), depth=pa.array(np.full(len(at), base + d)), parent=parent, parent_key=pa.array(keys, pa.binary()), **numbers)

    def _groups(self, node: dict) -> pa.Table:
        done = node["done"]
        at = node["at"][done]
        return self._out(
            GROUP, len(at), p1=pa.array(self.p1[at]), p2=pa.array(self.p2[at]), **{x: pa.array(node[x][done]) for x in ("children", "leaves", "saved")}
        )

    def _names(self, node: dict, d: int, full: int, named: bool) -> list[tuple[bytes, int]]:
        out = []
        ends = np.append(node["at"][1:], len(self.length))
        if named:
            out += [(self._path_key(int(s), d), int(low)) for s, low, ok in zip(node["at"], node["low"], node["done"]) if ok]
        if d == full:
            going = np.add.reduceat(self.goes.astype(np.int64), node["at"]) > 0
            for s, e, low in zip(node["at"][going & node["done"]], ends[going & node["done"]], node["low"][going & node["done"]]):
                i = int(s) + int(np.argmax(self.goes[s:e]))
                out.append((_key(int(self.x1[i]), int(self.x2[i])), int(low)))
        return out

    def _path_key(self, row: int, d: int) -> bytes:
        return _key(int(self.p1[row]), int(self.p2[row]), np.stack([self.a[row, :d], self.b[row, :d]]).tobytes())

    def _paths(self, found: list[dict], full: int) -> pa.Table:
        rows = []
        last = len(self.length) - 1
        for row, side in ((0, 0), (last, -1))[: 1 + (last > 0)]:
            acc = []
            for d in range(int(self.length[row]) + 1):
                node = found[d]
                if side and len(node["at"]) == 1:  # this node is on the first path already
                    acc.append({x: NONE if x in ("low", "ended") else 0 for x in _KNOWN})
                else:
                    acc.append({x: int(node[x][side]) for x in _KNOWN})
            same = slice(int(found[len(acc) - 1]["at"][side]), last + 1 if side else self._end(found[len(acc) - 1]))
            going = np.flatnonzero(self.goes[same]) if len(acc) - 1 == full else []
            i = same.start + int(going[0]) if len(going) else row
            size = int(self.length[row])
            cells = [{"a": int(x), "b": int(y), "chars": int(z)} for x, y, z in zip(self.a[row, :size], self.b[row, :size], self.chars[row, :size])]
            rows.append((int(self.p1[row]), int(self.p2[row]), int(self.x1[i]), int(self.x2[i]), bool(len(going)), int(self.key[row]), cells, acc))
        kinds = [pa.int64()] * 4 + [pa.bool_(), pa.int64(), _CELL, _ACC]
        names = ["p1", "p2", "x1", "x2", "goes", "key", "cells", "acc"]
        return self._out(PATH, len(rows), **{x: pa.array(v, k) for x, v, k in zip(names, zip(*rows), kinds)})

    def _end(self, node: dict) -> int:
        return int(node["at"][1]) if len(node["at"]) > 1 else len(self.length)

    @staticmethod
    def _out(kind: int, rows: int, /, **columns) -> pa.Table:
        given = {"kind": pa.array(np.full(rows, kind, np.int32))} | {x: v for x, v in columns.items() if v is not None}
        return pa.Table.from_arrays([given[f.name] if f.name in given else pa.nulls(rows, f.type) for f in _OUT], schema=_OUT)


def _shard(base: int, full: int, alone: bool, named: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            for out in Matrix(pa.Table.from_batches(got)).nodes(base, full, alone, named):
                yield from out.to_batches(max_chunksize=1 << 16)

    return run


def _block(rows: DataFrame, base: int, full: int) -> list[DataFrame]:
    """All levels of a block: shards, then their open paths, until one matrix holds what is left."""
    out, named = [], False
    most = max(LEAST, CELLS // full)
    while True:
        count = rows.count()
        if count <= most:
            dealt, alone = rows.repartition(1), True
        else:
            dealt, alone = rows.repartitionByRange(-(-count // most) * 2, "p1", "p2", "cells", "key"), False
        found = written(dealt.withColumn("goes", F.col("goes").cast("int")).select(*_ROW).mapInArrow(_shard(base, full, alone, named), _OUT_DDL), f"trie-{base}")
        out.append(found.filter(F.col("kind") != PATH))
        if alone:
            return out
        rows, named = found.filter(F.col("kind") == PATH), True


# -- sequences ------------------------------------------------------------------

def _prefix(seed: int) -> Column:
    return F.bit_xor(F.xxhash64(F.lit(seed), "depth", "a", "b"))


def _text_key(x1: Column, x2: Column) -> Column:
    """``_key`` of a prefix, made by Spark."""
    pair = F.concat(F.lpad(F.hex(x1), 16, "0"), F.lpad(F.hex(x2), 16, "0"))
    return F.unhex(F.md5(F.unhex(pair)))


def placed(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(key, place, a, b, chars, upto)``: turns as hashes, their place from 0 in their conversation
    and the code points up to and with them."""
    said = text_or_empty(text)
    narrow = conversations.filter(F.col(f"`{key}`").isNotNull()).select(
        as_long(key).alias("key"), F.col(f"`{turn}`").alias("turn"),
        *[F.xxhash64(F.lit(seed), text_or_empty(role), said).alias(x) for seed, x in ((1, "a"), (2, "b"))], F.length(said).cast("long").alias("chars"),
    )
    order = ["turn", "a", "b"]
    shards = written(narrow.repartitionByRange("key", *order).withColumn("shard", F.spark_partition_id()), "trie-turns")
    inside = Window.partitionBy("shard", "key").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = shards.withColumns({"place": F.row_number().over(Window.partitionBy("shard", "key").orderBy(*order)) - 1, "upto": F.sum("chars").over(inside)})
    # a conversation that goes on into a shard is the first of that shard: one row a shard at most
    first = shards.groupBy("shard").agg(F.min("key").alias("key")).select("key").distinct()
    counts = shards.join(F.broadcast(first), "key").groupBy("key", "shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("chars").alias("sum"))
    before = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("key", "shard", F.sum("rows").over(before).alias("rows"), F.sum("sum").over(before).alias("sum")).filter("rows > 0")
    none = F.lit(0).cast("long")
    return local.join(F.broadcast(starts), ["key", "shard"], "left").select(
        "key", (F.col("place") + F.coalesce("rows", none)).alias("place"), "a", "b", "chars", (F.col("upto") + F.coalesce("sum", none)).alias("upto")
    )


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations by the rule of shared openings: the first h turns of conversation c - c % 100,
    then c's own after its first h, with h from the checksum of c's decimal digits.

    ``(key, depth, a, b, chars, after)`` with the code points from that turn to the end (null in the
    opening), and ``(key, total)`` for every conversation, also those without a turn."""
    turns = written(turns, "trie-places")
    own = turns.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.sum("chars").alias("sum"))
    opening = (F.crc32(F.col("key").cast("string").cast("binary")) % (HEADS + 1)).cast("int")
    heads = turns.filter(F.col("place") < HEADS).groupBy(F.col("key").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("place", "a", "b", "chars"))).alias("head")
    )
    plan = (
        own.withColumns({"h": opening, "base": F.col("key") - F.col("key") % 100})
        .join(heads, "base", "left")
        .withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<struct<place:bigint,a:bigint,b:bigint,chars:bigint>>")), F.lit(1), F.col("h")))
        .withColumn("taken", F.size("head"))
        .select("key", "h", "sum", "head", "taken", (F.col("taken") + F.greatest(F.col("rows") - F.col("h"), F.lit(0))).alias("total"))
    )
    plan = written(plan, "trie-plan")
    first = plan.select("key", F.posexplode("head").alias("at", "t")).select(
        "key", (F.col("at") + 1).cast("long").alias("depth"), "t.a", "t.b", "t.chars", F.lit(None).cast("long").alias("after")
    )
    rest = turns.join(plan.select("key", "h", "taken", "sum"), "key").filter(F.col("place") >= F.col("h")).select(
        "key", (F.col("place") - F.col("h") + F.col("taken") + 1).cast("long").alias("depth"), "a", "b", "chars", (F.col("sum") - F.col("upto") + F.col("chars")).alias("after")
    )
    return written(first.unionByName(rest), "trie-sequences"), plan.select("key", F.col("total").cast("long").alias("total"))


def _classes(sequences: DataFrame, totals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equal sequences: ``(low, n, total)`` by smallest member, and ``(key, low)`` of those with copies."""
    hashed = totals.join(sequences.groupBy("key").agg(_prefix(1).alias("x1"), _prefix(2).alias("x2")), "key", "left").fillna(0, ["x1", "x2"])
    hashed = written(hashed, "trie-hashed")
    same = ["x1", "x2", "total"]
    classes = written(hashed.groupBy(*same).agg(F.min("key").alias("low"), F.count(F.lit(1)).alias("n")), "trie-classes")
    copies = hashed.join(classes.filter("n > 1").select(*same, "low"), same).select("key", "low")
    return classes.select("low", "n", "total"), copies


def _id_digests(copies: DataFrame) -> DataFrame:
    """``(ended, digest)``: SHA-256 of the class's ids, ascending, streamed from a sort."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, sha = None, None
        for batch in batches:
            done = []
            for now, key in zip(batch.column("low").to_pylist(), batch.column("key").to_pylist()):
                if now != low:
                    if sha:
                        done.append((low, sha.hexdigest()))
                    low, sha = now, hashlib.sha256(str(key).encode())
                else:
                    sha.update(f",{key}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.int64()), pa.array([x for _, x in done])], ["ended", "digest"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([low], pa.int64()), pa.array([sha.hexdigest()])], ["ended", "digest"])

    return copies.repartition("low").sortWithinPartitions("low", "key").select("low", "key").mapInArrow(run, "ended bigint, digest string")


def _rows(members: DataFrame, sequences: DataFrame, base: int, full: int) -> DataFrame:
    """A row a sequence of the block: its cells, its prefix and the prefix after the block.
    ``members``: (key, n, total, p1, p2)."""
    part = sequences.filter((F.col("depth") > base) & (F.col("depth") <= base + full))
    cells = part.groupBy("key").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("depth", "a", "b", "chars"))), lambda c: F.struct(c["a"].alias("a"), c["b"].alias("b"), c["chars"].alias("chars"))).alias("cells"),
        _prefix(1).alias("y1"), _prefix(2).alias("y2"),
    )
    zero = F.lit(0).cast("long")
    joined = members.join(cells, "key", "left")
    return joined.select(
        "key", "n", "total", "p1", "p2", F.coalesce("cells", F.array().cast(_CELL_DDL)).alias("cells"), (F.col("total") > base + full).alias("goes"),
        *[F.col(f"p{i}").bitwiseXOR(F.coalesce(f"y{i}", zero)).alias(f"x{i}") for i in (1, 2)],
    )


def trie(sequences: DataFrame, totals: DataFrame) -> DataFrame:
    """A row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``sequences``: (key, depth from 1, a, b, chars, after) with ``after`` given beyond depth 32;
    ``totals``: (key, total) for all sequences."""
    classes, copies = _classes(sequences, totals)
    zero = F.lit(0).cast("long")
    members = classes.select(F.col("low").alias("key"), "n", "total", zero.alias("p1"), zero.alias("p2"))
    blocks, base, full = [], 0, WIDTH
    chains, chain_extras = [], []
    while True:  # down: which sequences share a prefix long enough for the next block
        rows = written(_rows(members, sequences, base, full), f"trie-block-{base}")
        going = rows.filter("goes")
        if going.isEmpty():
            blocks.append((rows, None, base, full))
            break
        groups = written(going.groupBy("x1", "x2").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("sequences")), f"trie-groups-{base}")
        base, full, last = base + full, full * 2, (base, full)
        single = groups.filter("sequences = 1").select("key")
        tail = sequences.filter(F.col("depth") > base).join(going.join(single, "key", "left_semi").select("key", "n", "total", "x1", "x2"), "key")
        chains.append((tail, base))
        blocks.append((rows, groups, *last))
        shared = groups.filter("sequences > 1").select("x1", "x2")
        members = going.join(shared, ["x1", "x2"], "left_semi").select("key", "n", "total", F.col("x1").alias("p1"), F.col("x2").alias("p2"))
        if shared.isEmpty():
            break
    found, below = [], None
    for i in range(len(blocks) - 1, -1, -1):  # up: a block's totals go to the row that ends where it begins
        rows, groups, base, full = blocks[i]
        if groups is None:
            more = rows.withColumns({x: zero for x in ("children", "leaves", "saved")})
        else:
            tail, start = chains[i]
            one = F.lit(1).cast("long")
            extras = tail.filter(F.col("depth") == start + 1).select("key", one.alias("children"), one.alias("leaves"), ((F.col("n") - 1) * F.col("after")).alias("saved"))
            if below is not None:
                extras = extras.unionByName(
                    groups.filter("sequences > 1").join(below.withColumnsRenamed({"p1": "x1", "p2": "x2"}), ["x1", "x2"]).select("key", "children", "leaves", "saved")
                )
            more = rows.join(extras, "key", "left").fillna(0, ["children", "leaves", "saved"])
        parts = _block(more.withColumn("acc", F.lit(None).cast(_ACC_DDL)), base, full)
        found += parts
        below = None
        for part in parts if base else []:
            totals_of = part.filter(F.col("kind") == GROUP).select("p1", "p2", "children", "leaves", "saved")
            below = totals_of if below is None else below.unionByName(totals_of)
    everything = found[0]
    for part in found[1:]:
        everything = everything.unionByName(part)
    names = everything.filter(F.col("kind") == NAME).select(F.col("name").alias("parent_key"), F.col("low").alias("named"))
    fields = ["depth", "low", "parent", "parent_key", "n", "children", "leaves", "saved", "ended"]
    nodes = everything.filter(F.col("kind") == NODE).select(*fields)
    for tail, start in chains:
        first, last = F.col("depth") == start + 1, F.col("depth") == F.col("total")
        nodes = nodes.unionByName(
            tail.select(
                "depth", F.col("key").alias("low"), F.when(~first, F.col("key")).alias("parent"), F.when(first, _text_key(F.col("x1"), F.col("x2"))).alias("parent_key"), "n",
                F.when(last, 0).otherwise(1).cast("long").alias("children"), F.lit(1).cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("after")).alias("saved"), F.when(last, F.col("key")).alias("ended"),
            )
        )
    # most nodes know their parent: only the others meet the names
    named = nodes.filter("parent_key IS NOT NULL").join(names, "parent_key", "left").withColumn("parent", F.col("named")).select(*fields)
    linked = nodes.filter("parent_key IS NULL").unionByName(named)
    digest = F.when(F.col("ended").isNull(), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("digest", F.sha2(F.col("ended").cast("string"), 256)))
    return linked.join(_id_digests(copies), "ended", "left").select(
        F.col("low").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), digest.alias("ends_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", as_long("turn").alias("turn"), "role", "text")
    return trie(*rebuilt(placed(given)))
