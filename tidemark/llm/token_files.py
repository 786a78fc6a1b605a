"""Token-ID / binary output: Arrow files of equal-length sequences, for zero-copy random access.

Documents are range-partitioned by ``doc_id`` and encoded in order; each partition
becomes one shard, or several of at most ``SHARD_TOKENS`` and a document more. A shard is an Arrow IPC stream file whose record batches hold
``ids: fixed_size_list<uint16|uint32>[seq_len]`` and ``mask: fixed_size_list<uint8>[seq_len / 8]``
(one bit a token, least bit first; 0 only in the padding of a shard's last sequence), never
compressed, so a reader maps the file and slices; where the folder is no local disk, it streams the batches one by one. A second stream file beside it lists
``doc_id, start, n_tokens`` within the shard. A manifest row per shard gives the paths,
the shard's order and its totals; the prefix sum over the manifest makes starts global.

Defined cases: a null or empty text is the end id alone; null ``doc_id`` comes first;
rows with equal ``doc_id`` follow each other in text order; an empty table gives no shard
and no rows; further columns are ignored. Executors write under names no other attempt
takes and the manifest names the files of the attempts that succeeded, so lost executors
and retried tasks leave unused files but never wrong ones.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.shared import materialize, new_folder, open_fs, task_name
from tidemark.llm.wordsplit import byte_letters, chunks_of, pieces

SEQ_LEN = 2048
BATCH_SEQS = 256
END_ID = 1
SHARD_TOKENS = 1 << 27
_MEMO_WORDS, _MEMO_KEPT, _MEMO_PIECES, _MEMO_CHARS = 300_000, 150_000, 100_000, 1 << 24
_LONG_PIECE = 256
_ONE = np.int32(1)
# Anything but ASCII and the composed letters of Latin-1 and Latin Extended-A (dotted capital I aside).
_UNUSUAL = re.compile("[^\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]")
_ENCODERS: dict[str, "LibraryEncoder"] = {}


class ChunkMemo(dict):
    """Remembers the ids of stretches between white space, which no piece of the tokenizer crosses.

    The dict maps a stretch to its place in ``starts``, ``sizes`` and ``uses``; a new one gets the next place and
    waits in ``new`` until ``settle``. Memory stays bounded: ``trim`` keeps the stretches used most, and none where long ones fill it.
    """

    def __init__(self, dtype):
        self.dtype = dtype
        self.new: list[str] = []
        self.chars = 0
        self.flat, self.used = np.zeros(1 << 18, self.dtype), 0
        self.starts, self.sizes, self.uses = (np.zeros(1 << 16, t) for t in (np.int64, np.int64, np.int32))

    def trim(self, most: int = _MEMO_WORDS, kept: int = _MEMO_KEPT) -> None:
        if self.chars > _MEMO_CHARS:  # long stretches: their like hardly comes back
            self.clear()
            self.used = self.chars = 0
            self.uses[:] = 0
        if len(self) > most:
            best = np.sort(np.argsort(-self.uses[: len(self)], kind="stable")[:kept])
            words = list(self)
            self.clear()
            self.update(zip(map(words.__getitem__, best.tolist()), range(kept)))
            flat, sizes, uses = self.ids_at(best), self.sizes[best], self.uses[best] // 2  # old uses count less and less
            self.used, self.uses[kept:] = len(flat), 0
            self.flat[: self.used], self.sizes[:kept], self.uses[:kept] = flat, sizes, uses
            self.starts[:kept] = np.cumsum(sizes) - sizes
            self.chars = sum(map(len, self))

    def __missing__(self, chunk: str) -> int:
        at = self[chunk] = len(self)
        self.new.append(chunk)
        self.chars += len(chunk)
        return at

    def places(self, text: str) -> np.ndarray:
        chunks = chunks_of(text)
        return np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks))

    def settle(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """The ids of all of ``new``, one after another."""
        at, n = len(self) - len(self.new), len(self.new)
        while at + n > len(self.starts):
            self.starts, self.sizes, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes, self.uses))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[at : at + n], self.sizes[at : at + n] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(ids)
        self.new = []

    def ids_at(self, places: np.ndarray) -> np.ndarray:
        return gather(self.flat, self.starts[places], self.sizes[places])

    def ids(self, places: np.ndarray) -> np.ndarray:
        np.add.at(self.uses, places, _ONE)  # of the same type: else many times slower
        return self.ids_at(places)


class LibraryEncoder:
    """Whole texts to ids with the tokenizers library, whose BPE model is called once for each remembered piece.

    Stretches beyond ASCII and Latin letters go to the library's normaliser too, texts that may hold special tokens go there whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.tokenize = self.lib.model.tokenize
        self.letters = dict(enumerate(byte_letters()))
        self.dtype = np.uint16 if self.lib.get_vocab_size() <= 1 << 16 else np.uint32
        self.memo = ChunkMemo(self.dtype)
        self.known: dict[str, bytes] = {}  # pieces, which stretches with and without marks share; the first ones stay

    def spell(self, piece: str) -> str:
        return piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.letters)

    def raw(self, ids: list[int]) -> bytes:
        return array(np.dtype(self.dtype).char, ids).tobytes()

    def piece_ids(self, piece: str) -> bytes:
        ids = self.known.get(piece)
        if ids is None:
            ids = self.raw([t.id for t in self.tokenize(self.spell(piece))])
            if len(self.known) < _MEMO_PIECES and len(piece) <= _LONG_PIECE:
                self.known[piece] = ids
        return ids

    def chunk_ids(self, chunk: str) -> bytes:
        if not chunk.isascii() and _UNUSUAL.search(chunk):
            return self.raw(self.lib.encode(chunk, add_special_tokens=False).ids)
        return self.piece_ids(chunk.lower()) if chunk.isalpha() else b"".join(map(self.piece_ids, pieces(chunk)))

    def encode(self, text: str) -> np.ndarray:
        if "<|" in text:
            return np.array(self.lib.encode(text, add_special_tokens=False).ids, self.dtype)
        memo = self.memo
        memo.trim()
        places = memo.places(text)
        if memo.new:
            ids = list(map(self.chunk_ids, memo.new))
            memo.settle(np.frombuffer(b"".join(ids), self.dtype), np.fromiter(map(len, ids), np.int64, len(ids)) // np.dtype(self.dtype).itemsize)
        return memo.ids(places)


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices ``flat[start : start + size]``, one after another."""
    total = int(sizes.sum())
    if not total:
        return flat[:0].copy()
    ends = np.cumsum(sizes, dtype=np.int64)
    index = np.ones(total, np.int64)
    some = sizes > 0
    first, s, n = (ends - sizes)[some], starts[some], sizes[some]
    index[first[0]] = s[0]
    index[first[1:]] = s[1:] - (s[:-1] + n[:-1] - 1)
    return flat[np.cumsum(index)]


def encoder(path: str) -> LibraryEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = LibraryEncoder(path)
    return _ENCODERS[path]


class ShardWriter:
    """Packs documents into sequences of ``seq_len`` and writes them batch by batch."""

    def __init__(self, folder: str, stem: str, dtype, seq_len: int):
        self.fs, root = open_fs(folder)
        self.fs.create_dir(root, recursive=True)
        self.seq_len, self.dtype = seq_len, dtype
        self.ids_path, self.docs_path = f"{folder}/{stem}.ids.arrows", f"{folder}/{stem}.docs.arrows"
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), seq_len)), ("mask", pa.list_(pa.uint8(), seq_len // 8))], {"seq_len": str(seq_len)})
        self.doc_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [self.fs.open_output_stream(f"{root}/{stem}.{kind}.arrows") for kind in ("ids", "docs")]
        self.ids_out = pa.ipc.new_stream(self.sinks[0], self.schema)
        self.docs_out = pa.ipc.new_stream(self.sinks[1], self.doc_schema)
        self.rest, self.n_rest, self.total, self.docs = [], 0, 0, []

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.total, len(ids)))
        self.total += len(ids)
        self.rest.append(ids)
        self.n_rest += len(ids)
        if self.n_rest >= self.seq_len * BATCH_SEQS:
            self._flush(last=False)
        if len(self.docs) >= 65536:
            self._flush_docs()

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.rest) if self.rest else np.zeros(0, self.dtype)
        whole = len(flat) // self.seq_len * self.seq_len
        self.rest, self.n_rest = [flat[whole:].copy()], len(flat) - whole
        self._write(flat[:whole], whole)
        if last and self.n_rest:
            tail = self.rest.pop()
            self._write(np.concatenate([tail, np.zeros(self.seq_len - len(tail), self.dtype)]), len(tail))

    def _write(self, flat: np.ndarray, real: int) -> None:
        step = self.seq_len * BATCH_SEQS
        for a in range(0, len(flat), step):
            part = np.ascontiguousarray(flat[a : a + step], self.dtype)
            mask = np.packbits(np.arange(a, a + len(part)) < real, bitorder="little")
            self.ids_out.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(part), self.seq_len), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.seq_len // 8)], schema=self.schema))

    def _flush_docs(self) -> None:
        cols = list(zip(*self.docs)) if self.docs else [[], [], []]
        self.docs_out.write_batch(pa.record_batch([pa.array(list(c), pa.int64()) for c in cols], schema=self.doc_schema))
        self.docs = []

    def close(self) -> None:
        self._flush(last=True)
        self._flush_docs()
        for x in (self.ids_out, self.docs_out, *self.sinks):
            x.close()


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = END_ID, seq_len: int = SEQ_LEN, shards: int | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode every text and write the shards; returns the manifest, one row per shard.

    ``seq_len`` must be a multiple of 8. ``shards``, the number of partitions, defaults to ``spark.sql.shuffle.partitions``; a
    partition of more tokens than ``shard_tokens`` goes on in a next shard (``part`` counts them).
    """
    if seq_len % 8:
        raise ValueError("seq_len must be a multiple of 8")
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, out, rows, part = encoder(tokenizer), None, 0, 0
        told = lambda: pa.RecordBatch.from_pydict({"shard": pa.array([TaskContext.get().partitionId()], pa.int32()), "part": pa.array([part], pa.int32()), "ids_path": [out.ids_path], "docs_path": [out.docs_path], "n_docs": [rows], "n_tokens": [out.total]})
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                out = out or ShardWriter(folder, task_name("shard"), enc.dtype, seq_len)
                out.add(doc_id, np.append(enc.encode(text.as_py() or ""), enc.dtype(end_id)))
                rows += 1
                if out.total >= shard_tokens:
                    out.close()
                    yield told()
                    out, rows, part = None, 0, part + 1
        if out:
            out.close()
            yield told()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("hash"), F.spark_partition_id().alias("part"))
    # Rows of one id, null among them, may fill several ranges: their texts' hashes part them, and rows equal in both the file they came from.
    order = [F.col("doc_id").asc_nulls_first(), "hash", "part"]
    ranged = slim.repartitionByRange(n, *order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    return materialize(ranged.mapInArrow(write, "shard int, part int, ids_path string, docs_path string, n_docs long, n_tokens long"), "token-manifest")


def open_shard(ids_path: str) -> tuple[np.ndarray, np.ndarray, list]:
    """Ids and mask bits of a shard as flat arrays over the mapped file; the third value keeps the mapping alive.

    Each array is a list of views, one per record batch, wrapped by ``Slices``.
    """
    fs, path = open_fs(ids_path)
    src = pa.memory_map(path) if isinstance(fs, pa.fs.LocalFileSystem) else pa.BufferReader(fs.open_input_file(path).read_buffer())
    batches = list(pa.ipc.open_stream(src))
    ids = [b.column(0).flatten().to_numpy(zero_copy_only=True) for b in batches]
    mask = [b.column(1).flatten().to_numpy(zero_copy_only=True) for b in batches]
    return Slices(ids), Slices(mask), [src, batches]


class Slices:
    """Random access to ``[start, start + n)`` over views that follow each other."""

    def __init__(self, views: list[np.ndarray]):
        self.views = views
        self.ends = np.cumsum([len(v) for v in views])

    def get(self, start: int, n: int) -> np.ndarray:
        i = int(np.searchsorted(self.ends, start, side="right"))
        parts = []
        while n:
            a = start - (int(self.ends[i - 1]) if i else 0)
            part = self.views[i][a : a + n]
            parts.append(part)
            start, n, i = start + len(part), n - len(part), i + 1
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else self.views[0][:0]


class Passing:
    """The same slices in ascending order from a file that cannot be mapped: one batch at a time, whatever its size."""

    def __init__(self, ids_path: str):
        fs, path = open_fs(ids_path)
        self.stream = fs.open_input_stream(path)
        self.batches = iter(pa.ipc.open_stream(self.stream))
        self.view, self.begins = np.zeros(0, np.uint32), 0

    def get(self, start: int, n: int) -> np.ndarray:
        parts = [self.view[:0]]
        while n:
            a = start - self.begins
            if a >= len(self.view):
                self.begins += len(self.view)
                self.view = next(self.batches).column(0).flatten().to_numpy(zero_copy_only=True)
                continue
            parts.append(self.view[a : a + n])
            start, n = start + len(parts[-1]), n - len(parts[-1])
        return parts[-1] if len(parts) < 3 else np.concatenate(parts[1:])

    def close(self) -> None:
        self.stream.close()


def is_local(path: str) -> bool:
    return isinstance(open_fs(path)[0], pa.fs.LocalFileSystem)


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``before``, the ids of all earlier shards. One row for each shard of up to ``shard_tokens`` ids goes through the window."""
    from pyspark.sql import Window

    order = Window.partitionBy(F.lit(0)).orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document, read from the files: ``doc_id, shard, start, n_tokens, ids_crc32``; ``start`` counts the ids of all documents before it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, ids_path, docs_path, before in zip(*(c.to_pylist() for c in batch.columns)):
                ids, keep = open_shard(ids_path)[::2] if is_local(ids_path) else (Passing(ids_path), None)
                fs, path = open_fs(docs_path)
                with fs.open_input_stream(path) as f:
                    for b in pa.ipc.open_stream(f):
                        if b.num_rows:
                            starts = b.column(1).to_numpy()
                            crc = [zlib.crc32(ids.get(a, n).astype("<u4").tobytes()) for a, n in zip(starts.tolist(), b.column(2).to_pylist())]
                            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(b.num_rows, shard, np.int32)), pa.array(starts + before), b.column(2), pa.array(crc, pa.int64())], names=["doc_id", "shard", "start", "n_tokens", "ids_crc32"])
                if keep is None:
                    ids.close()
                del ids, keep

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = with_starts(manifest).repartitionByRange(n, "shard", "part").select("shard", "ids_path", "docs_path", "before")
    return spread.mapInArrow(read, "doc_id long, shard int, start long, n_tokens long, ids_crc32 long")


def token_digest(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write, read back: ``doc_id, start, n_tokens, ids_crc32, shard``."""
    return read_token_files(write_token_files(docs, tokenizer, **options)).select("doc_id", "start", "n_tokens", "ids_crc32", "shard")
