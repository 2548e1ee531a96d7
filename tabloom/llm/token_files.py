"""Token ids in Arrow files of equal-length sequences.

Documents are sorted by id over ranges, encoded, closed by an end id and laid end to end; each
range becomes two Arrow IPC files in a folder that all executors share:

``part-<n>.arrow``       record batches of two fixed-size-list columns, ``ids`` (uint16 or uint32,
                         by the vocabulary's size) and ``mask`` (false on the padding of a part's last sequence)
``part-<n>.docs.arrow``  for each document its key, the place of its first id in the part, and its number of ids

A file has its batches at known places and every sequence has the same length, so sequence i is
read without reading others, and without a copy where the file is memory-mapped. A part file is
written under a name of its own attempt and renamed when whole: a task that runs again, or twice at
the same time, leaves one file. The manifest has a row a part.

Defined results: a null or empty text gives the end id alone; null ids come first; rows with equal
ids follow each other; an empty table gives an empty manifest and no files; a text of any length
runs over as many sequences as it needs; only the named columns are read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tabloom.llm.common import as_long, scratch_folder, table, text_or_empty, written
from tabloom.llm.wordpieces import word_pieces

TOKENIZER, END, LENGTH, PER_BATCH = "word_bpe_49k.json", 2, 1024, 64
MANIFEST = "part int, name string, n_docs long, n_ids long"
DOCS = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("n_ids", pa.int64())])


class _Sequences:
    """Lays ids end to end and writes whole batches of sequences as they fill."""

    def __init__(self, sink, length: int, kind: pa.DataType):
        self.length, self.kind, self.held, self.have = length, kind, [], 0
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = pa.ipc.new_file(sink, self.schema)

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.have += len(ids)
        step = self.length * PER_BATCH
        if self.have >= step:
            flat = np.concatenate(self.held)
            whole = len(flat) // step * step
            for at in range(0, whole, step):
                self._write(flat[at : at + step], step)
            self.held, self.have = [flat[whole:]], len(flat) - whole

    def _write(self, ids: np.ndarray, size: int) -> None:
        padded = np.zeros(size, self.kind.to_pandas_dtype())
        padded[: len(ids)] = ids
        mask = pa.array(np.arange(size) < len(ids))
        lists = [pa.FixedSizeListArray.from_arrays(x, self.length) for x in (pa.array(padded, self.kind), mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        flat = np.concatenate(self.held) if self.held else np.empty(0)
        if len(flat):
            self._write(flat, -(-len(flat) // self.length) * self.length)
        self.out.close()


def _writer(folder: str, path: str, end: int, length: int):
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        pieces, part = word_pieces(path), TaskContext.get().partitionId()
        kind = pa.uint16() if max(pieces.tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else pa.uint32()
        files, base = pyarrow.fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        own, n_docs, n_ids = uuid.uuid4().hex, 0, 0
        names = [f"part-{part:06d}.arrow", f"part-{part:06d}.docs.arrow"]
        with files.open_output_stream(f"{base}/{own}-0") as a, files.open_output_stream(f"{base}/{own}-1") as b:
            sequences, index = _Sequences(a, length, kind), pa.ipc.new_file(b, DOCS)
            while first is not None:
                starts, sizes = [], []
                for ids in pieces.ids(x.as_buffer().to_pybytes() for x in first.column(1)):
                    ids = np.append(ids, np.uint32(end))
                    sequences.add(ids)
                    starts.append(n_ids)
                    sizes.append(len(ids))
                    n_ids += len(ids)
                n_docs += first.num_rows
                index.write_batch(pa.RecordBatch.from_arrays([first.column(0), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=DOCS))
                first = next((x for x in batches if x.num_rows), None)
            sequences.close()
            index.close()
        for i, name in enumerate(names):
            files.move(f"{base}/{own}-{i}", f"{base}/{name}")
        yield pa.RecordBatch.from_pylist([{"part": part, "name": names[0], "n_docs": n_docs, "n_ids": n_ids}], pa.schema([("part", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return write


def write_files(docs: DataFrame, folder: str, tokenizer_path: str, key: str = "doc_id", text: str = "text", end: int = END, length: int = LENGTH, order: list[Column] | None = None) -> DataFrame:
    """Writes the files and returns their manifest. ``order`` defaults to the key; ties are
    broken by the text, so that a key that many rows share still spreads over ranges."""
    order = order or [F.col(f"`{key}`")]
    rows = docs.select(
        as_long(key).alias("key"), F.encode(text_or_empty(text), "utf-8").alias("text"),
        *[c.alias(f"o{i}") for i, c in enumerate(order)],
        F.xxhash64(F.col(f"`{text}`")).alias("tie"), F.monotonically_increasing_id().alias("row"),
    )
    keys = [F.col(f"o{i}").asc_nulls_first() for i in range(len(order))] + [F.col("tie"), F.col("row")]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("key", "text")
    return written(ranged.mapInArrow(_writer(folder, tokenizer_path, end, length), MANIFEST), "token-manifest")


class TokenFile:
    """Random access to the sequences of one part file."""

    def __init__(self, files: pyarrow.fs.FileSystem, path: str):
        local = isinstance(files, pyarrow.fs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else files.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size
        self.last: tuple[int, pa.RecordBatch] | None = None

    def batch(self, i: int) -> pa.RecordBatch:
        if self.last is None or self.last[0] != i:
            self.last = (i, self.reader.get_batch(i))
        return self.last[1]

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence i; the ids are a view of the file."""
        batch, at = self.batch(i // PER_BATCH), i % PER_BATCH
        ids = batch.column("ids").flatten()[at * self.length : (at + 1) * self.length]
        mask = batch.column("mask").flatten()[at * self.length : (at + 1) * self.length]
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)

    def ids(self, start: int, n: int) -> np.ndarray:
        """The ids of a run of places, over as many batches as it touches."""
        step, out = self.length * PER_BATCH, []
        while n:
            flat = self.batch(start // step).column("ids").flatten().to_numpy()
            part = flat[start % step : start % step + n]
            out.append(part)
            start, n = start + len(part), n - len(part)
        return np.concatenate(out) if out else np.empty(0, np.uint32)


def _reader(folder: str):
    kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = TokenFile(files, f"{base}/{name}")
                with files.open_input_file(f"{base}/{name.removesuffix('.arrow')}.docs.arrow") as source:
                    index = pa.ipc.open_file(source)
                    for i in range(index.num_record_batches):
                        docs = index.get_batch(i)
                        starts, sizes = docs.column("start").to_numpy(), docs.column("n_ids").to_numpy()
                        sums = [zlib.crc32(tokens.ids(int(s), int(n)).astype("<u4").tobytes()) for s, n in zip(starts, sizes)]
                        yield pa.RecordBatch.from_arrays([docs.column("key"), pa.array(starts + before), docs.column("n_ids"), pa.array(sums, pa.int64())], schema=kinds)

    return read


def read_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Documents as the files hold them: ``(doc_id, start, n_tokens, ids_crc32)``. One row a part
    is numbered in one task; the parts are read by as many tasks."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("name", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("before"))
    spread = placed.repartition(max(1, manifest.count()), "name")  # a part is much work, though a short row
    return spread.mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = scratch_folder(spark, "token-files")
    return read_files(write_files(docs, folder, public_tokenizers.path(TOKENIZER)), folder)
