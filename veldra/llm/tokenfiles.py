"""Token-id files: flat unsigned integers and 64-bit document offsets, memory-mapped when read.

Documents are dealt to partitions by ranges of their id. Each task writes the files of its partition: ``.bin`` (ids,
little endian, 16 bits if the vocabulary fits, else 32), ``.idx`` (unsigned 64-bit offsets in ids, one more than
documents) and ``.doc`` (64-bit document ids; the smallest integer stands for null). File names are unique for each
task attempt and a manifest lists those of the attempts that count, so lost executors and repeated tasks do no harm.
The base of a partition among all ids and documents is the prefix sum of the manifest's counts.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldra.llm import textcodes as tc

_MANIFEST = "part int, name string, n_docs long, n_tokens long, id_bytes int"
_NULL_DOC = np.iinfo(np.int64).min
_encoders: dict[str, Encoder] = {}
#: Bytes of unseen pieces that are encoded in one run.
RUN_BYTES = 1 << 14

# Code points of all other white space.
_WIDE_SPACES = (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


class Encoder:
    """A byte-level BPE of the tokenizers library with a cache of pieces.

    Its pre-tokeniser never joins a non-space with the space after it, nor an ASCII letter with an ASCII sign or digit
    after it, so a text is cut there and each distinct piece is encoded once. Texts with white space outside ASCII or with an added token go to the library whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.added = tuple(t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values())
        self.wide = tuple(chr(c).encode() for c in _WIDE_SPACES)
        self.cache = tc.PieceCache(1 << 20)
        # A token of a byte-level vocabulary has one character for each of its bytes.
        self.width = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.width[i] = len(token)

    @staticmethod
    def of(path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        return _encoders[path]

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, data: np.ndarray, raw: bytes, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each piece's begin, how many it has) of distinct pieces.

        Pieces that begin with a space and end with another character don't touch each other's tokens, so they are
        encoded in long runs, and the widths of the tokens tell where each piece ends. The others are encoded one by one.
        """
        size = stop - start
        plain = tc.SPACE[data[start]] & ~tc.SPACE[data[stop - 1]]
        order = np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain)))
        n, total = int(plain.sum()), np.cumsum(size[order])
        flat = tc.gathered(data, start[order], size[order]).tobytes()
        edges = [0]
        while edges[-1] < n:
            edges.append(max(edges[-1] + 1, int(np.searchsorted(total[:n], (total[edges[-1] - 1] if edges[-1] else 0) + RUN_BYTES, "right"))))
        edges = np.concatenate((edges, np.arange(n + 1, len(order) + 1)))
        ends = np.concatenate(([0], total))[edges]
        ids = np.concatenate([np.zeros(0, np.int32), *(np.asarray(x, np.int32) for x in self.whole([flat[a:b].decode() for a, b in zip(ends[:-1], ends[1:], strict=True)]))])
        place = np.searchsorted(np.cumsum(self.width[ids]), total, "left") + 1  # tokens up to the end of each piece
        at, count = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        at[order], count[order] = np.concatenate(([0], place[:-1])), np.diff(place, prepend=0)
        return ids, at, count

    def _odd(self, raw: bytes) -> bool:
        return any(x in raw for x in self.added) or (not raw.isascii() and any(x in raw for x in self.wide))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        n = len(offsets) - 1
        raw = data.tobytes()
        if self._odd(raw):
            each = [self._one(raw[offsets[i] : offsets[i + 1]]) for i in range(n)]
            return np.concatenate([np.zeros(0, np.int32), *each]), np.fromiter(map(len, each), np.int64, n)
        return self._cut(data, offsets)

    def _one(self, raw: bytes) -> np.ndarray:
        if self._odd(raw):
            return np.asarray(self.whole([raw.decode()])[0], np.int32)
        return self._cut(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        space = tc.SPACE[data]
        first = space.copy()
        first[1:] &= ~space[:-1]
        letter = tc.LETTER[data]
        first[1:] |= letter[:-1] & tc.SIGN[data[1:]]
        first[offsets[:-1][offsets[:-1] < len(data)]] = True
        start = np.flatnonzero(first)
        stop = np.append(start[1:], len(data))
        raw = data.tobytes()
        at, size = self.cache.lookup(tc.piece_hashes(data, start, stop), lambda new: self._pieces(data, raw, start[new], stop[new]))
        edges = np.searchsorted(start, offsets)
        total = np.concatenate(([0], np.cumsum(size)))
        return tc.gathered(self.cache.pool, at, size), np.diff(total[edges])


def _open(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pyarrow.fs.LocalFileSystem(), folder)


def write_token_files(docs: DataFrame, doc: str, text: str, tokenizer: str, folder: str, end_id: int = 0) -> DataFrame:
    """Write the files of all documents in ascending ``doc`` order to ``folder`` and return the manifest.

    Manifest: part, name, n_docs, n_tokens, id_bytes, base_doc, base_token. Null texts are empty; each document ends
    with ``end_id``. Null ids come first; rows with the same id are ordered by a hash of their text, equal rows stand
    side by side and may lie in different files. Other columns don't matter. An empty table has an empty manifest.
    """
    spark = docs.sparkSession
    tc.bounded_batches(spark)
    rows = docs.select(F.col(doc).cast("long").alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    rows = rows.withColumn("m", F.monotonically_increasing_id())  # splits any number of equal rows
    rows = rows.repartitionByRange("d", "h", "m").sortWithinPartitions("d", "h", "m").select("d", "t")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, sizes, ids, out = Encoder.of(tokenizer), [], [], None
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        fs, at = _open(folder)
        for batch in batches:
            if out is None and len(batch):
                fs.create_dir(at, recursive=True)
                out = fs.open_output_stream(f"{at}/{name}.bin")
            data, offsets = tc.utf8(batch.column(1))
            for a, b in tc.chunks(offsets):
                tokens, n = encoder.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                out.write(np.insert(tokens, np.cumsum(n), end_id).astype(encoder.dtype).astype(np.dtype(encoder.dtype).newbyteorder("<")).tobytes())
                sizes.append(n + 1)
            ids.append(batch.column(0).fill_null(_NULL_DOC).to_numpy(zero_copy_only=False).astype("<i8"))
        if out is None:
            return
        out.close()
        n = np.concatenate(sizes)
        for suffix, x in (("idx", np.concatenate(([0], np.cumsum(n))).astype("<u8")), ("doc", np.concatenate(ids))):
            with fs.open_output_stream(f"{at}/{name}.{suffix}") as f:
                f.write(x.tobytes())
        yield pa.RecordBatch.from_pylist([{"part": part, "name": name, "n_docs": len(n), "n_tokens": int(n.sum()), "id_bytes": np.dtype(encoder.dtype).itemsize}], schema=pa.schema([("part", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("id_bytes", pa.int32())]))

    # One row for each partition: the manifest is the only thing that the driver sees.
    found = sorted(rows.mapInArrow(write, _MANIFEST).collect(), key=lambda r: r.part)
    base_doc = base_token = 0
    listed = []
    for r in found:
        listed.append((*r, base_doc, base_token))
        base_doc, base_token = base_doc + r.n_docs, base_token + r.n_tokens
    manifest = spark.createDataFrame(listed, _MANIFEST + ", base_doc long, base_token long")
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def _mapped(fs: pyarrow.fs.FileSystem, path: str, dtype) -> np.ndarray:
    """The file's numbers: memory-mapped if it is local, else read."""
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, from the files that the manifest lists.

    start: number of ids of all documents before it. ids_crc32: of the ids as little-endian unsigned 32-bit integers.
    The manifest says how wide the ids of each file are. An empty manifest gives an empty table; a document without
    text has its end id alone; a null document id comes back as null.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _open(folder)
        for batch in batches:
            for r in batch.to_pylist():
                flat, idx, docs = (_mapped(fs, f"{at}/{r['name']}.{s}", k) for s, k in (("bin", f"<u{r['id_bytes']}"), ("idx", "<u8"), ("doc", "<i8")))
                for a in range(0, len(docs), 4096):
                    b = min(len(docs), a + 4096)
                    o = idx[a : b + 1].astype(np.int64)
                    crc = [zlib.crc32(flat[o[i] : o[i + 1]].astype("<u4").tobytes()) for i in range(b - a)]
                    d = np.asarray(docs[a:b])
                    columns = [pa.array(d, pa.int64(), mask=d == _NULL_DOC), pa.array(o[:-1] + r["base_token"]), pa.array(np.diff(o)), pa.array(crc, pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(o - o[0], pa.int32()), pa.array(flat[o[0] : o[-1]].astype(np.int32))))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names)

    parts = max(1, manifest.count())
    return manifest.repartition(parts, "part").mapInArrow(read, schema)
