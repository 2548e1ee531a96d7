"""Benchmark decontamination by templates.

Texts become templates: numbers, units of measure and names (capitalised words inside a sentence)
turn into typed placeholders, other words into lower case. Windows of eight template words are
hashed and joined to the benchmark's windows, so a question asked again with other numbers or names
still meets its template. Each match keeps what stood in its placeholders; along one alignment of
text and item a value of the item must always have become the same value of the text, otherwise the
likeness is one of form only and the windows that hold the value are dropped. A text is contaminated
by an item when the windows left are at least half of the item's.

An item's first word opens a sentence, where a capital tells nothing; if it has one, the first window
also stands with a name there, which must then be the same word in the text. So a copy of an item as
it is meets all of its windows. An item of which every window is mostly placeholders has windows of
the words themselves instead; a text that holds all of them in one alignment holds the item.

The benchmark's window hashes go to the scanning tasks as a bitmap of fixed size, which decides
which windows leave the scan; the join decides on the whole hash. With a large benchmark the bitmap
fills up and more windows reach the join, none is lost.

Defined results: null or empty texts and items match nothing; an item of fewer than eight words is
compared as one window of its length; a template's window needs half of its words outside
placeholders, and an item without such a window is only matched as it is; rows with equal or null ids give a row each; empty tables give no rows; only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.llm.common import as_long, table, worker_table, written

WORDS, COVER = 8, 0.5
#: Windows of a benchmark that may be broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 500_000
BITS = 24
UNITS = set(
    "mm cm dm m km inch inches feet foot yard yards mile miles mg g kg ton tons lb lbs oz ml l litre litres liter liters gallon gallons "
    "ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years hz khz mhz ghz w kw mw kwh v "
    "kb mb gb tb percent dollar dollars euro euros cent cents usd eur mph kmh degrees".split()
)
TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[.!?\n]")
NUMBER, UNIT, NAME = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: Tells hashes of the words themselves from those of templates.
AS_IS = np.uint64(0x27D4EB2F165667C5)
LITERAL, IS_NUMBER, IS_UNIT, CAPITAL, END = range(5)
KEPT_WORDS = 400_000


class _Vocabulary:
    """Numbers, hashes and kinds of the words a task has met."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.number: dict[str, int] = {}
        self.hash, self.kind = np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, np.int8)

    def __call__(self, words: list[str]) -> np.ndarray:
        try:
            return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        except KeyError:
            import xxhash

            if len(self.number) > KEPT_WORDS:
                self.clear()
            for word in dict.fromkeys(words):
                if word in self.number:
                    continue
                k = len(self.number)
                if k >= len(self.hash):
                    self.hash, self.kind = np.resize(self.hash, 2 * k), np.resize(self.kind, 2 * k)
                low = word.lower()
                self.number[word], self.hash[k] = k, xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass"))
                self.kind[k] = END if word in ".!?\n" else IS_NUMBER if word[0].isdigit() else IS_UNIT if low in UNITS else CAPITAL if word[0].isupper() else LITERAL
            return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))


def template(text: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Words, their template hashes, which of them are placeholders, and the words' own hashes."""
    found = TOKEN.findall(text)
    if not found:
        return [], np.empty(0, np.uint64), np.empty(0, bool), np.empty(0, np.uint64)
    vocabulary = worker_table("vocabulary", _Vocabulary)
    at = vocabulary(found)
    own, kinds = vocabulary.hash[at], vocabulary.kind[at]
    end = kinds == END
    opens = np.concatenate([[True], end[:-1]])
    name = (kinds == CAPITAL) & ~opens
    codes = np.where(kinds == IS_NUMBER, NUMBER, np.where(kinds == IS_UNIT, UNIT, np.where(name, NAME, own)))
    slot = (kinds == IS_NUMBER) | (kinds == IS_UNIT) | name
    kept = np.flatnonzero(~end)
    return [found[i] for i in kept], codes[kept], slot[kept], own[kept]


def windows(codes: np.ndarray, slot: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of n words, and which have enough words of their own."""
    m = len(codes) - n + 1
    if m < 1 or n < 1:
        return np.empty(0, np.uint64), np.empty(0, bool)
    hashed = np.full(m, n, np.uint64)
    for j in range(n):
        hashed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + codes[j : j + m]
    hashed = (hashed ^ (hashed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    hashed ^= hashed >> np.uint64(31)
    fixed = np.concatenate([[0], np.cumsum(~slot)])
    return hashed, 2 * (fixed[n:] - fixed[:-n]) >= n


def _slots(words: list[str], slot: np.ndarray, at: int, n: int) -> list[str]:
    return [words[i] for i in range(at, at + n) if slot[i]]


WINDOWS = pa.schema([("id", pa.int64()), ("hash", pa.int64()), ("place", pa.int32()), ("n", pa.int32()), ("slots", pa.list_(pa.string()))])
#: Windows of an item: templates, the first one with a name in front, the words themselves.
TEMPLATE, NAMED, VERBATIM = range(3)
ITEM_WINDOWS = WINDOWS.append(pa.field("kind", pa.int32()))


def _item_windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words, codes, slot, own = template(text or "")
            n = min(WORDS, len(words))
            hashed, good = windows(codes, slot, n)
            # a copy of an item as it is has all of its templates; only an item without any needs its words
            verbatim = [] if good.any() else windows(own, slot, n)[0] ^ AS_IS
            rows += [{"id": key, "hash": int(hashed[i].astype(np.int64)), "place": int(i), "n": n, "slots": _slots(words, slot, i, n), "kind": TEMPLATE} for i in np.flatnonzero(good)]
            rows += [{"id": key, "hash": int(h.astype(np.int64)), "place": i, "n": n, "slots": [], "kind": VERBATIM} for i, h in enumerate(verbatim)]
            if n and good[0] and not slot[0] and words[0][0].isupper():
                codes[0], slot[0] = NAME, True
                first = windows(codes[:n], slot[:n], n)[0][0]
                rows.append({"id": key, "hash": int(first.astype(np.int64)), "place": 0, "n": n, "slots": _slots(words, slot, 0, n), "kind": NAMED})
        yield pa.RecordBatch.from_pylist(rows, ITEM_WINDOWS)


def _text_windows(bitmap, lengths: list[tuple[int, bool]]):
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not text.is_valid:
                    continue
                words, codes, slot, own = template(text.as_py())
                for n, verbatim in lengths:
                    # which windows have enough words of their own the item's side decides
                    hashed = windows(own, slot, n)[0] ^ AS_IS if verbatim else windows(codes, slot, n)[0]
                    cell = (hashed >> np.uint64(64 - BITS)).astype(np.int64)
                    for i in np.flatnonzero(bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1):
                        rows.append({"id": key, "hash": int(hashed[i].astype(np.int64)), "place": int(i), "n": n, "slots": [] if verbatim else _slots(words, slot, i, n)})
                    if len(rows) > 20_000:
                        yield pa.RecordBatch.from_pylist(rows, WINDOWS)
                        rows = []
            yield pa.RecordBatch.from_pylist(rows, WINDOWS)

    return scan


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", cover: float = COVER) -> DataFrame:
    """``(row, doc_id, item_id, n_windows, item_windows, coverage, same_values, first_word)`` for
    each row of ``docs`` and item whose consistent windows reach ``cover``, or that stands in the text
    as it is. ``row`` numbers the rows of ``docs`` in the order they are read."""
    spark = docs.sparkSession
    schema = "id long, hash long, place int, n int, slots array<string>"
    # items, too, are told apart by row; an id may be null or stand twice
    items = benchmark.select(F.monotonically_increasing_id().alias("item_row"), as_long(item).alias("item"), F.col(f"`{item_text}`").cast("string").alias("text"))
    items = written(items, "benchmark-items")
    held = written(items.select("item_row", "text").mapInArrow(_item_windows, schema + ", kind int"), "benchmark-windows")
    verbatim = F.col("kind") == VERBATIM
    lengths = sorted(map(tuple, held.select("n", verbatim).distinct().collect()))  # sixteen at most
    cells = held.select(F.shiftrightunsigned("hash", 64 - BITS).cast("int").alias("cell")).distinct().toPandas()["cell"].to_numpy()
    bitmap = np.zeros(1 << (BITS - 3), np.uint8)
    np.bitwise_or.at(bitmap, cells >> 3, (1 << (cells & 7)).astype(np.uint8))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), as_long(key).alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    hits = rows.select(F.struct("row", "doc_id").alias("id"), "text").mapInArrow(
        _keyed(_text_windows(spark.sparkContext.broadcast(bitmap), lengths)), schema.replace("id long", "id struct<row:bigint,doc_id:bigint>", 1)
    )
    totals = held.groupBy(F.col("id").alias("item_row"), verbatim.alias("verbatim")).agg(F.countDistinct("place").alias("item_windows"))
    there = held.select(F.col("id").alias("item_row"), "hash", F.col("place").alias("item_place"), F.col("slots").alias("item_slots"), "kind")
    met = hits.join(F.broadcast(there) if held.count() <= BROADCAST_ROWS else there, "hash")
    met = met.filter((F.col("kind") != NAMED) | (F.lower(F.get("slots", F.lit(0))) == F.lower(F.get("item_slots", F.lit(0)))))
    swaps = F.arrays_zip(F.col("item_slots").alias("item"), F.col("slots").alias("text"))
    aligned = met.groupBy("id", "item_row", verbatim.alias("verbatim"), (F.col("place") - F.col("item_place")).alias("diagonal")).agg(
        F.collect_set(F.struct("item_place", "place", swaps.alias("swaps"))).alias("windows"),
        F.array_distinct(F.flatten(F.collect_set(swaps))).alias("swaps"),
    )
    # values of the item that have become several values of the text
    values = F.transform("swaps", lambda x: x["item"])
    unlike = F.filter(F.array_distinct(values), lambda v: F.size(F.filter("swaps", lambda x: x["item"] == v)) > 1)
    kept = F.filter("windows", lambda w: ~F.exists(w["swaps"], lambda x: F.array_contains(F.col("unlike"), x["item"])))
    aligned = aligned.withColumn("unlike", unlike).withColumn("windows", kept).filter(F.size("windows") > 0).join(totals, ["item_row", "verbatim"])
    # words as they are count only in an alignment that holds the whole item
    whole = ~F.col("verbatim") | (F.size(F.array_distinct(F.transform("windows", lambda w: w["item_place"]))) == F.col("item_windows"))
    found = (
        aligned.filter(whole).groupBy("id", "item_row", "item_windows")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list(F.transform("windows", lambda w: w["item_place"]))))).cast("long").alias("n_windows"),
            F.min(F.array_min(F.transform("windows", lambda w: w["place"]))).cast("long").alias("first_word"),
            F.bool_and(F.forall("swaps", lambda x: x["item"] == x["text"])).alias("same_values"),
        )
        .filter(F.col("n_windows") >= cover * F.col("item_windows"))
        .join(items.select("item_row", "item"), "item_row")
    )
    return found.select(
        "id.row", "id.doc_id", F.col("item").alias("item_id"), "n_windows", "item_windows",
        F.round(F.col("n_windows") / F.col("item_windows"), 6).alias("coverage"), "same_values", "first_word",
    )


def _keyed(scan):
    """``scan`` for rows whose id is a struct: it sees row numbers, the structs are put back."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(1)], ["id", "text"])
            for out in scan([plain]):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(out.column(0)), *out.columns[1:]], names=out.schema.names)

    return run


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **names) -> DataFrame:
    """``docs`` without the texts that an item contaminates. A text decides by itself, so equal
    texts go or stay together and rows are matched by the text's hash."""
    keyed = docs.select(F.xxhash64(F.col(f"`{text}`")).alias("h"), F.col(f"`{text}`").alias("text"))
    bad = contaminated(keyed, benchmark, key="h", **names).select(F.col("doc_id").alias("h")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # apart from the hash, whatever its columns' names
    return docs.select(row, F.xxhash64(F.col(f"`{text}`")).alias("h")).join(bad, "h", "left_anti").select("row.*")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")
