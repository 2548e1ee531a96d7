"""Duplicate spans by a run-length index of the contexts that repeat.

Rule: a byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a
smaller id. Strings are taken from whole texts as UTF-8 bytes and never run over a document's end.

1. *Anchors.* In every string of 50 bytes the 24-byte grams with the smallest hash are anchors, so
   equal strings have equal anchors. Blocks of documents send their distinct anchor hashes, parted
   by hash, and learn which of them other documents have too (a bit for each).
2. *Contexts.* Each shared anchor is sent with its context, the up to 76 bytes that hold all strings
   it can be an anchor of, and the smallest id that has it. Equal contexts of a block are one.
3. *Index.* The distinct contexts that meet at an anchor are indexed together: their suffixes are
   sorted, the Burrows-Wheeler transform is cut into runs, and the common prefix with the suffix
   sorted before is compared only at the run heads, the samples. Elsewhere it is streamed along the
   text: inside a run it is one less than at the byte before. Suffixes between prefixes shorter than
   50 share their first 50 bytes; the smallest id among them owns that string. An anchor with a
   single context needs no index: the context's smallest id owns all of it.
4. *Marks.* Blocks get a bit for each context and string whether a smaller id owns it, cover the
   bytes and digest what is left.

Only hashes, bits and repeated contexts are shuffled, apart from the packed blocks. Blocks and
hash parts are bounded; a context that half of all documents hold is one row from each block.

Defined results: a null or empty text has no bytes and the digest of nothing; a null id is larger
than any; rows with equal ids never remove each other's bytes; an empty table gives no rows; only
the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.llm.common import as_long, table, text_or_empty, written

LENGTH, GRAM = 50, 24
SIDE = LENGTH - GRAM  # bytes of context on either side, and one less than the grams of a string
WIDE = GRAM + 2 * SIDE
STARTS = SIDE + 1  # strings in a full context
#: Bytes of text in a block, of hashes in a part, and contexts in an index.
BLOCK_BYTES, PART_BYTES, INDEXED = 4 << 20, 2 << 20, 2000
NO_ID = (1 << 63) - 1
_U = np.uint64


def _powers() -> dict[int, np.uint64]:
    b = 0x9E3779B97F4A7C15
    return {n: _U(pow(b, n, 1 << 64)) for n in (1, 2, 4, 8, 16)}


_B = _powers()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _random(n: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)


_CELL = _random(16)


def _gram_hashes(text: np.ndarray) -> np.ndarray:
    """Hash of the 24 bytes from each place, by doubling."""
    h1 = text.astype(np.uint64) + _U(1)
    h2 = h1[:-1] * _B[1] + h1[1:]
    h4 = h2[:-2] * _B[2] + h2[2:]
    h8 = h4[:-4] * _B[4] + h4[4:]
    h16 = h8[:-8] * _B[8] + h8[8:]
    return _mix(h16[:-8] * _B[8] + h8[16:])


def _slide(x: np.ndarray, pick) -> np.ndarray:
    """pick over each ``SIDE + 1`` = 27 neighbours."""
    for step in (1, 2, 4, 8):
        x = pick(x[:-step], x[step:])
    return pick(x[:-11], x[11:])


def anchors(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of the anchors of documents laid end to end (ends: where each ends)."""
    n = len(text)
    if n < LENGTH:
        return np.empty(0, np.int64)
    small = (_gram_hashes(text) >> _U(33)).astype(np.uint32) + np.uint32(1)
    least = _slide(small, np.minimum)  # for each string start 0 .. n - 50
    # a string that runs over a document's end has no anchor
    over = np.zeros(n + 1, np.int32)
    np.add.at(over, np.maximum(ends - LENGTH + 1, 0), 1)
    np.add.at(over, ends, -1)
    least[np.cumsum(over[: len(least)]) > 0] = 0
    padded = np.zeros(len(least) + 2 * SIDE, np.uint32)
    padded[SIDE:-SIDE] = least
    return np.flatnonzero(_slide(padded, np.maximum)[: len(small)] == small)


class Block:
    """Documents laid end to end, their anchors, and the contexts of shared anchors."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, text: np.ndarray, places: np.ndarray | None = None):
        self.ids, self.sizes, self.text = ids, sizes, text
        self.ends = np.cumsum(sizes)
        self.places = self._anchors() if places is None else places
        self.doc = np.searchsorted(self.ends, self.places, "right")
        self.hashes = np.empty(len(self.places), np.uint64)
        if len(self.places):
            grams = np.lib.stride_tricks.sliding_window_view(text, GRAM)
            for at in range(0, len(self.places), 4096):
                words = grams[self.places[at : at + 4096]].view(np.uint64)
                self.hashes[at : at + 4096] = _mix(_mix(_mix(words[:, 0] * _CELL[0]) + words[:, 1] * _CELL[1]) + words[:, 2] * _CELL[2])

    def _anchors(self) -> np.ndarray:
        places = []
        # pieces of whole documents that fit the processor's cache
        first, start = 0, 0
        while first < len(self.ids):
            last = max(first + 1, int(np.searchsorted(self.ends, start + (1 << 15), "right")))
            places.append(anchors(self.text[start : self.ends[last - 1]], self.ends[first:last] - start) + start)
            first, start = last, int(self.ends[last - 1])
        return np.concatenate(places) if places else np.empty(0, np.int64)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct anchor hashes, and whether documents of different ids have them."""
        order = np.argsort(self.hashes, kind="stable")
        ordered, own = self.hashes[order], self.ids[self.doc[order]]
        new = np.ones(len(order), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        heads = np.flatnonzero(new)
        if not len(heads):
            return ordered, new
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1
        many = np.minimum.reduceat(own, heads) < np.maximum.reduceat(own, heads)
        return ordered[heads], many

    def contexts(self, shared: np.ndarray):
        """Distinct contexts of the anchors whose hash is shared (a flag for each of ``distinct``):
        their hashes, bytes on the left and right, bytes and smallest ids; and for each anchor its
        place, document and context."""
        kept = np.flatnonzero(shared[self.which]) if len(shared) else np.empty(0, np.int64)
        places, doc, hashes = self.places[kept], self.doc[kept], self.hashes[kept]
        left = np.minimum(places - (self.ends - self.sizes)[doc], SIDE)
        right = np.minimum(self.ends[doc] - places - GRAM, SIDE)
        padded = np.zeros(len(self.text) + 2 * WIDE, np.uint8)
        padded[SIDE : SIDE + len(self.text)] = self.text
        rows = np.lib.stride_tricks.sliding_window_view(padded, WIDE)[places]
        cut = np.flatnonzero((left < SIDE) | (right < SIDE))
        cells = np.arange(WIDE)
        rows[cut] *= (cells >= (SIDE - left[cut])[:, None]) & (cells < (SIDE + GRAM + right[cut])[:, None])
        prints = fingerprints(rows, left, right, hashes)
        order = np.argsort(prints, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = prints[order[1:]] != prints[order[:-1]]
        heads = order[new]
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        lowest = np.minimum.reduceat(self.ids[doc[order]], np.flatnonzero(new)) if len(order) else np.empty(0, np.int64)
        return (hashes[heads], left[heads], right[heads], rows[heads], lowest), (places, doc, which)

    def marks(self, ids: np.ndarray, taken: np.ndarray, where) -> np.ndarray:
        """Bytes that go. taken: a bit for each context and string start, whether a smaller id owns it."""
        places, doc, which = where
        # another document of the block has the same context: all its strings are owned
        bits = np.where(self.ids[doc] > ids[which], np.uint32((1 << STARTS) - 1), taken[which])
        left = np.minimum(places - (self.ends - self.sizes)[doc], SIDE)
        right = np.minimum(self.ends[doc] - places - GRAM, SIDE)
        starts = np.zeros(len(self.text) + LENGTH, np.int32)
        for o in range(STARTS):
            hit = (bits >> np.uint32(o) & np.uint32(1)).astype(bool) & (o >= SIDE - left) & (o <= right)
            starts[LENGTH - SIDE + o + places[hit]] = 1
        total = np.cumsum(starts)
        return total[LENGTH:] > total[: len(self.text)]


def fingerprints(rows: np.ndarray, left: np.ndarray, right: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """64 bits of each row of bytes, its sides and its anchor."""
    out = _mix(hashes + left.astype(np.uint64) * _CELL[14] + right.astype(np.uint64) * _CELL[15])
    whole = -(-rows.shape[1] // 8) * 8
    for at in range(0, len(rows), 8192):
        part = np.zeros((len(rows[at : at + 8192]), whole), np.uint8)
        part[:, : rows.shape[1]] = rows[at : at + 8192]
        words = part.view(np.uint64)
        total = out[at : at + 8192]
        for i in range(words.shape[1]):
            total = (total ^ _mix((words[:, i] + _CELL[i]) * _CELL[13 - i])) * _CELL[12]
        out[at : at + 8192] = total
    return _mix(out)


def _sorted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order (ties by place) and ranks from 1 of the keys."""
    order = np.argsort(key, kind="stable")
    ranks = np.empty(len(key), np.int64)
    new = np.ones(len(key), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    ranks[order] = np.cumsum(new)
    return order, ranks


def owners(rows: np.ndarray, left: np.ndarray, right: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each distinct context (a row) and string start, the smallest id whose contexts hold the
    string; ``NO_ID`` where the context has no string."""
    n, span = len(rows), 2 * WIDE + 8
    if not n:
        return np.empty((0, STARTS), np.int64)
    cells = np.arange(WIDE)
    inside = (cells >= (SIDE - left)[:, None]) & (cells < (SIDE + GRAM + right)[:, None])
    letter = np.zeros(256, np.int64)
    letter[np.unique(rows)] = np.arange(1, len(np.unique(rows)) + 1)
    flat = np.zeros((n, span), np.int64)  # a context's end, 0, sorts first
    flat[:, :WIDE] = np.where(inside, letter[rows], 0)
    flat = flat.ravel()
    text = np.flatnonzero(flat)  # places of all suffixes, in the order of the text
    room = (np.arange(n) * span + SIDE + GRAM + right)[text // span] - text
    # ranks of suffixes by more and more symbols: as many as fit a number, then three or two ranks at a time
    bits = int(letter.max()).bit_length()
    reach, key = 63 // bits, np.zeros(len(text), np.int64)
    for j in range(reach):
        key = (key << bits) | flat[text + j]
    levels = [(1, flat)]
    while True:
        order, ranks = _sorted(key)
        rank = np.zeros(n * span, np.int64)
        rank[text] = ranks
        levels.append((reach, rank))
        if reach >= WIDE or ranks.max() == len(text):
            break
        wide = len(text) + 1
        at = [rank[np.minimum(text + i * reach, n * span - 1)] * (i * reach < room) for i in range(3)]
        if wide < 1 << 21:
            key, reach = (at[0] * wide + at[1]) * wide + at[2], reach * 3
        else:
            key, reach = at[0] * wide + at[1], reach * 2
    suffixes = text[order]  # the suffix array
    # the transform: the symbol before each suffix; a context's first suffix has none and is a run head
    before = flat[np.maximum(suffixes - 1, 0)] * (suffixes % span > 0)
    head = np.ones(len(order), bool)
    head[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)
    # samples: common prefixes with the suffix before, compared at run heads only
    heads = np.flatnonzero(head[1:]) + 1
    a, b = suffixes[heads], suffixes[heads - 1]
    most = np.minimum(room[order[heads]], room[order[heads - 1]])
    same = np.zeros(len(heads), np.int64)
    last = n * span - 1
    for width, rank in reversed(levels):
        for _ in range(min(-(-WIDE // width), 3 if width > 1 else levels[1][0])):
            x, y = rank[np.minimum(a + same, last)], rank[np.minimum(b + same, last)]
            same += width * ((x == y) & (same < most))
    prefix = np.zeros(n * span, np.int64)
    prefix[a] = np.minimum(same, most)
    # streamed along the text: inside a run, one less than at the byte before
    sampled = np.zeros(n * span, bool)
    sampled[suffixes[head]] = True
    source = np.maximum.accumulate(np.where(sampled[text], text, 0))
    streamed = prefix[source] - (text - source)
    # suffixes that share their first 50 bytes stand together
    starts = np.ones(len(order), bool)
    starts[1:] = streamed[order[1:]] < LENGTH
    lowest = np.minimum.reduceat(ids[suffixes // span], np.flatnonzero(starts))
    out = np.full(n * span, NO_ID)
    out[suffixes] = lowest[np.cumsum(starts) - 1]
    o = np.arange(STARTS)
    return np.where((o >= (SIDE - left)[:, None]) & (o <= right[:, None]), out.reshape(n, span)[:, :STARTS], NO_ID)


def smaller_owner(hashes: np.ndarray, left: np.ndarray, right: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For contexts of many blocks: a bit for each string start, whether a smaller id than the
    context's own has the string."""
    prints = fingerprints(rows, left, right, hashes)
    order = np.lexsort((ids, prints))
    new = np.ones(len(order), bool)
    new[1:] = prints[order[1:]] != prints[order[:-1]]
    heads = order[new]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    if (rows != rows[heads[which]]).any():
        raise ValueError("two contexts share a fingerprint")
    lowest = ids[heads]
    bits = np.where(ids > lowest[which], np.uint32((1 << STARTS) - 1), np.uint32(0))
    # only anchors with several contexts need the index, and of these only contexts that share at least
    # half of the 26 bytes beside the anchor on one side: a string has 13 or more of them on one side
    h, lo, hi, text = hashes[heads], left[heads].copy(), right[heads].copy(), rows[heads]
    half = SIDE // 2

    def common(part, whole):
        sides = fingerprints(part, np.zeros(len(h), np.int64), np.zeros(len(h), np.int64), h)
        _, inverse, times = np.unique(sides, return_inverse=True, return_counts=True)
        return (times[inverse] > 1) & whole

    on_left, on_right = common(text[:, half:SIDE], lo >= half), common(text[:, SIDE + GRAM : SIDE + GRAM + half], hi >= half)
    lo[~on_left], hi[~on_right] = np.minimum(lo[~on_left], half - 1), np.minimum(hi[~on_right], half - 1)
    found = np.full(len(heads), 0, np.uint32)
    some = np.flatnonzero((on_left | on_right) & (lo + hi >= SIDE))
    some = some[np.argsort(h[some], kind="stable")]
    # anchors have no strings in common, so an index is made of as many whole anchors as fit the cache
    cuts = np.flatnonzero(np.concatenate([[True], h[some[1:]] != h[some[:-1]]])) if len(some) else []
    at = 0
    while at < len(some):
        following = np.searchsorted(cuts, at + INDEXED, "left")
        to = max(cuts[following] if following < len(cuts) else len(some), at + 1)
        part = some[at:to]
        own = owners(text[part], lo[part], hi[part], lowest[part])
        for o in range(STARTS):
            found[part] |= (own[:, o] < lowest[part]).astype(np.uint32) << np.uint32(o)
        at = to
    return bits | found[which]


S0 = "block long, n_docs int, raw long, docs binary, text binary, places binary"


def _squeeze(data) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(data)


def _unsqueeze(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def _arrow(columns: dict[str, tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents laid into blocks, with their anchors' places."""
    from pyspark import TaskContext

    part, n = TaskContext.get().partitionId(), 0
    ids, texts, held = [], [], 0

    def block():
        nonlocal n, ids, texts, held
        sizes = np.array([len(t) for t in texts], np.int64)
        whole = b"".join(texts)
        made = Block(np.array(ids, np.int64), sizes, np.frombuffer(whole, np.uint8))
        out = _arrow({
            "block": ([part << 32 | n], pa.int64()), "n_docs": ([len(ids)], pa.int32()), "raw": ([len(whole)], pa.int64()),
            "docs": ([_squeeze(np.concatenate([made.ids, sizes]).tobytes())], pa.binary()), "text": ([_squeeze(whole)], pa.binary()),
            "places": ([_squeeze(np.diff(made.places, prepend=0).astype(np.int64).tobytes())], pa.binary()),
        })
        ids, texts, held, n = [], [], 0, n + 1
        return out

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids.append(key)
            texts.append(text.as_buffer().to_pybytes())
            held += len(texts[-1])
            if held >= BLOCK_BYTES:
                yield block()
    if ids:
        yield block()


def _unpacked(docs: bytes, text: bytes, places: bytes) -> Block:
    head = np.frombuffer(_unsqueeze(docs), np.int64)
    n = len(head) // 2
    return Block(head[:n], head[n:], np.frombuffer(_unsqueeze(text), np.uint8), np.cumsum(np.frombuffer(_unsqueeze(places), np.int64)))


def _part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)


def _hash_rows(parts: int):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, docs, text, places in zip(*(batch.column(i).to_pylist() for i in range(4))):
                values, many = _unpacked(docs, text, places).distinct()
                cuts = np.searchsorted(_part_of(values, parts), np.arange(parts + 1))
                some = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
                # 48 bits tell the hashes of a part apart well enough: a false match only sends a context in vain
                low = values.view(np.uint8).reshape(-1, 8)[:, :6]
                yield _arrow({
                    "part": (some, pa.int32()), "block": ([key] * len(some), pa.int64()),
                    "hashes": ([low[cuts[p] : cuts[p + 1]].tobytes() for p in some], pa.binary()),
                    "many": ([np.packbits(many[cuts[p] : cuts[p + 1]]).tobytes() for p in some], pa.binary()),
                })

    return rows


def _by_part(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of one part after another; rows come sorted by part."""
    last, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[0] != last:
                yield last, held
                held = []
            last = row[0]
            held.append(row)
    if held:
        yield last, held


def _wide(data: bytes) -> np.ndarray:
    low = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(low), 8), np.uint8)
    out[:, :6] = low
    return out.view(np.uint64).ravel()


def _shared_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, rows in _by_part(batches):
        each = [_wide(h) for _, _, h, _ in rows]
        values, which, times = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
        many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=len(h)).astype(bool) for h, (_, _, _, m) in zip(each, rows)])
        shared = times > 1
        shared[which[many]] = True
        flags = np.split(shared[which], np.cumsum([len(h) for h in each])[:-1])
        yield _arrow({
            "part": ([part] * len(rows), pa.int32()), "block": ([r[1] for r in rows], pa.int64()),
            "bits": ([np.packbits(f).tobytes() for f in flags], pa.binary()),
        })


def _repeated(block: Block, parts: int, replies: list[dict]):
    """The block's contexts of shared anchors, their part, and where they stand."""
    values, _ = block.distinct()
    cuts = np.searchsorted(_part_of(values, parts), np.arange(parts + 1))
    shared = np.zeros(len(values), bool)
    for x in replies:
        a, b = cuts[x["part"]], cuts[x["part"] + 1]
        shared[a:b] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=b - a)
    found, where = block.contexts(shared)
    return found, _part_of(found[0], parts), where


def _context_rows(parts: int):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, docs, text, places, replies in zip(*(batch.column(i).to_pylist() for i in range(5))):
                (hashes, left, right, cells, ids), part, _ = _repeated(_unpacked(docs, text, places), parts, replies or [])
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(parts + 1))
                some = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
                data = []
                for p in some:
                    own = order[cuts[p] : cuts[p + 1]]
                    data.append(_squeeze(b"".join([hashes[own].tobytes(), ids[own].tobytes(), left[own].astype(np.uint8).tobytes(), right[own].astype(np.uint8).tobytes(), cells[own].tobytes()])))
                yield _arrow({"part": (some, pa.int32()), "block": ([key] * len(some), pa.int64()), "contexts": (data, pa.binary())})

    return rows


def _owned_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, rows in _by_part(batches):
        each = []
        for _, _, data in rows:
            raw = np.frombuffer(_unsqueeze(data), np.uint8)
            n = len(raw) // (18 + WIDE)
            each.append((
                raw[: 8 * n].view(np.uint64), raw[16 * n : 17 * n].astype(np.int64), raw[17 * n : 18 * n].astype(np.int64),
                raw[18 * n :].reshape(n, WIDE), raw[8 * n : 16 * n].view(np.int64),
            ))
        bits = smaller_owner(*(np.concatenate(x) for x in zip(*each)))
        split = np.split(bits, np.cumsum([len(x[0]) for x in each])[:-1])
        yield _arrow({
            "part": ([part] * len(rows), pa.int32()), "block": ([r[1] for r in rows], pa.int64()),
            "bits": ([_squeeze(b.tobytes()) for b in split], pa.binary()),
        })


RESULT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>"


def _digested(parts: int):
    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, text, places, shared, owned in zip(*(batch.column(i).to_pylist() for i in range(1, 6))):
                block = _unpacked(docs, text, places)
                (_, _, _, _, ids), part, where = _repeated(block, parts, shared or [])
                taken = np.zeros(len(ids), np.uint32)
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(parts + 1))
                for x in owned or []:
                    taken[order[cuts[x["part"]] : cuts[x["part"] + 1]]] = np.frombuffer(_unsqueeze(x["bits"]), np.uint32)
                gone = block.marks(ids, taken, where)
                removed, spans, sums = [], [], []
                for a, b in zip(block.ends - block.sizes, block.ends):
                    own = gone[a:b]
                    edges = np.flatnonzero(np.diff(own, prepend=False, append=False)) if own.any() else np.empty(0, np.int64)
                    removed.append(int(own.sum()))
                    spans.append([{"start": int(x), "end": int(y)} for x, y in edges.reshape(-1, 2)])
                    sums.append(hashlib.sha256(block.text[a:b][~own]).hexdigest())
                yield _arrow({
                    "id": (block.ids, pa.int64()), "n_bytes": (block.sizes, pa.int64()), "n_removed": (removed, pa.int64()),
                    "n_spans": ([len(x) for x in spans], pa.int64()), "kept_sha256": (sums, pa.string()),
                    "spans": (spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                })

    return digest


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row of ``docs``: its bytes, the bytes and spans that go (byte offsets), and the
    digest of what is left."""
    rows = docs.select(F.coalesce(as_long(key), F.lit(NO_ID)).alias("id"), F.encode(text_or_empty(text), "utf-8").alias("text"))
    blocks = written(rows.mapInArrow(_packed, S0), "blocks")
    size = blocks.agg(F.sum("raw")).first()[0] or 0
    # an anchor in about 14 bytes, 8 bytes each
    parts = max(16, int(size / 14 * 8 / PART_BYTES))
    packed = ["block", "docs", "text", "places"]
    sent = blocks.select(packed).mapInArrow(_hash_rows(parts), "part int, block long, hashes binary, many binary")
    shared = written(sent.repartition("part").sortWithinPartitions("part").mapInArrow(_shared_rows, "part int, block long, bits binary"), "shared-anchors")

    def replies(answers: DataFrame, name: str) -> DataFrame:
        return answers.groupBy("block").agg(F.collect_list(F.struct("part", "bits")).alias(name))

    met = blocks.select(packed).join(replies(shared, "shared"), "block", "left")
    contexts = met.mapInArrow(_context_rows(parts), "part int, block long, contexts binary")
    owned = written(contexts.repartition("part").sortWithinPartitions("part").mapInArrow(_owned_rows, "part int, block long, bits binary"), "owned-strings")
    known = replies(shared, "shared").join(replies(owned, "owned"), "block", "full")
    done = blocks.select(packed).join(known, "block", "left").mapInArrow(_digested(parts), RESULT)
    return done.withColumn("id", F.when(F.col("id") < NO_ID, F.col("id"))).withColumnRenamed("id", "key")


def op8_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
