"""Token ids as Arrow files of equal-length sequences and masks.

Each shard is an Arrow file whose record batches have the columns `ids` and
`mask`, both fixed-size lists of the sequence length, and all batches but the
last the same number of rows. Token t of a shard is in batch
t // (length * rows), so a reader that maps the file gets any sequence, and any
document, as a view of the mapped bytes. The mask is false for the padding of a
shard's last sequence. A second file of the shard lists its documents: doc_id,
first token within the shard, number of tokens. Ids take 16 bits where the
vocabulary allows it, else 32.

Shards hold documents in ascending order of doc_id, and their numbers follow that
order. A task writes under a name of its own and reports it through Spark's
committed manifest, so a repeated or speculative task leaves no trace in it.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._ragged import groups
from ._shared import scratch, shuffle_partitions, written
from .word_tokens import word_tokens

LENGTH = 2048
ROWS = 256


def opened(uri: str):
    """File system and path of a folder; Arrow reaches local, HDFS, S3, GCS and Azure addresses."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Writes one shard; a generator of tokens never has more than one batch of them in memory."""

    def __init__(self, uri: str, wide: bool, length: int = LENGTH, rows: int = ROWS):
        self.fs, base = opened(uri)
        self.fs.create_dir(base, recursive=True)
        self.name = uuid.uuid4().hex
        self.path, self.docs_path = f"{base}/{self.name}.arrow", f"{base}/{self.name}.docs.arrow"
        self.length, self.rows = length, rows
        self.kind = pa.uint32() if wide else pa.uint16()
        self.schema = pa.schema([("ids", pa.list_(self.kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.docs_schema = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64())])
        self.out = self.fs.open_output_stream(self.path)
        self.docs_out = self.fs.open_output_stream(self.docs_path)
        self.file, self.docs_file = pa.ipc.new_file(self.out, self.schema), pa.ipc.new_file(self.docs_out, self.docs_schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.total = self.n_docs = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> None:
        n = np.diff(bounds)
        self.docs_file.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(self.total + bounds[:-1] - bounds[0], pa.int64()), pa.array(n, pa.int64())], schema=self.docs_schema))
        self.n_docs += len(n)
        self.total += len(ids)
        self.held.append(ids.astype(self.kind.to_pandas_dtype()))
        self.n_held += len(ids)
        step = self.length * self.rows
        if self.n_held >= step:
            flat = np.concatenate(self.held)
            whole = len(flat) // step * step
            for at in range(0, whole, step):
                self._batch(flat[at : at + step])
            self.held, self.n_held = [flat[whole:]], len(flat) - whole

    def _batch(self, flat: np.ndarray) -> None:
        padded = -(-len(flat) // self.length) * self.length
        mask = np.arange(padded) < len(flat)
        ids = np.zeros(padded, flat.dtype)
        ids[: len(flat)] = flat
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.n_held:
            self._batch(np.concatenate(self.held))
        for x in (self.file, self.docs_file, self.out, self.docs_out):
            x.close()


class ShardReader:
    """Random access to a shard; on a local file system the arrays are views of the mapped file."""

    def __init__(self, uri: str, name: str):
        self.fs, base = opened(uri)
        path = f"{base}/{name}.arrow"
        mapped = self.fs.type_name == "local"
        self.source = pa.memory_map(path) if mapped else self.fs.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.docs_path = f"{base}/{name}.docs.arrow"
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1
        self.at, self.flat = -1, np.zeros(0, np.uint16)

    def _flat(self, k: int) -> np.ndarray:
        if k != self.at:
            self.at, self.flat = k, self.file.get_batch(k).column(0).flatten().to_numpy(zero_copy_only=True)
        return self.flat

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence k of the shard."""
        batch = self.file.get_batch(k // self.rows)
        r = k % self.rows
        return batch.column(0)[r].values.to_numpy(), batch.column(1)[r].values.to_numpy(zero_copy_only=False)

    def tokens(self, first: int, n: int):
        """The tokens [first, first + n) in parts, each within one batch."""
        step = self.length * self.rows
        while n > 0:
            k, r = divmod(first, step)
            part = self._flat(k)[r : r + n]
            yield part
            first, n = first + len(part), n - len(part)

    def documents(self):
        """Batches of doc_id, first, n_tokens."""
        with self.fs.open_input_file(self.docs_path) as f:
            file = pa.ipc.open_file(f)
            for k in range(file.num_record_batches):
                yield file.get_batch(k)

    def close(self) -> None:
        self.source.close()


MANIFEST = "shard int, name string, n_docs long, n_tokens long"


def write_sequences(docs: DataFrame, tokenizer_path: str, out: str, *, end_id: int, length: int = LENGTH, rows: int = ROWS) -> DataFrame:
    """Tokenise whole texts, append `end_id` to each and write them below `out`.

    Returns the manifest: one row per shard with its number, file name, documents
    and tokens. Defined results: a null or empty text is its end id alone; equal
    doc_ids stand together, ordered by the hash of the text, and may take several
    shards; null doc_ids come first; an empty table has no shard; further columns
    are not read.
    """
    parts = shuffle_partitions(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        coder = word_tokens(tokenizer_path)
        wide = max(coder.tokenizer.get_vocab_size(), end_id + 1) > 1 << 16
        writer = None
        for batch in batches:
            for begin, end in groups(batch.column(1)):
                part = batch.slice(begin, end - begin)
                ids, bounds = with_end(*coder.encode(part.column(1)), end_id)
                writer = writer or ShardWriter(out, wide, length, rows)
                writer.add(part.column(0), ids, bounds)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict(
                {"shard": pa.array([TaskContext.get().partitionId()], pa.int32()), "name": [writer.name], "n_docs": pa.array([writer.n_docs], pa.int64()), "n_tokens": pa.array([writer.total], pa.int64())}
            )

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    ordered = keyed.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    return written(ordered.mapInArrow(run, MANIFEST), "shards")


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with one more id each."""
    n = len(bounds) - 1
    out = np.full(len(ids) + n, end_id, dtype=ids.dtype)
    keep = np.ones(len(out), bool)
    ends = bounds[1:] + np.arange(n)
    keep[ends] = False
    out[keep] = ids
    return out, bounds + np.arange(n + 1)


def with_bases(manifest: DataFrame) -> DataFrame:
    """The manifest with `base`, the tokens of all shards before. It has a row per shard, so one task adds them up."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_documents(spark: SparkSession, manifest: DataFrame, out: str) -> DataFrame:
    """What the files hold of each document: doc_id, start, n_tokens, ids_crc32."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = ShardReader(out, name)
                for docs in reader.documents():
                    firsts, sizes = docs.column(1).to_numpy(), docs.column(2).to_numpy()
                    crcs = np.empty(len(firsts), np.int64)
                    for k, (first, n) in enumerate(zip(firsts.tolist(), sizes.tolist())):
                        crc = 0
                        for part in reader.tokens(first, n):
                            crc = zlib.crc32(part.astype("<u4"), crc)
                        crcs[k] = crc
                    yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(firsts + base), docs.column(2), pa.array(crcs)], schema=schema)
                reader.close()

    shards = with_bases(manifest).select("name", "base").repartition(shuffle_partitions(spark))
    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def sequence_store(docs: DataFrame, tokenizer_path: str, *, end_id: int, out: str | None = None) -> DataFrame:
    """Write the documents and return what the files give back."""
    spark = docs.sparkSession
    out = out or scratch(spark, "sequences")
    return read_documents(spark, write_sequences(docs, tokenizer_path, out, end_id=end_id), out)
