"""Token ids in binary files: a frame for each document, all compressed with one zstandard dictionary.

A set of files is a folder with

* ``dictionary``: the dictionary, trained on serialised id arrays of a bounded sample of short documents;
* ``part-...``: the magic, a length (u32) and JSON header (kind of id, end id, the dictionary's SHA-256), one zstandard frame
  for each document, then the index (for each document whether its id is known, the id, where its frame begins, its
  tokens) and a footer (where the index begins, documents, the magic). All numbers are little-endian;
* ``manifest.json``: the files in order of their documents, each with its documents, its tokens, the tokens before it
  and its first and last id.

Documents are in ascending order of their ids. One document is read with the index and its frame alone.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, scratch, shared_dir, table

MAGIC, FOOTER = b"ANNTOK1\n", "<QQ8s"
INDEX = np.dtype([("known", "u1"), ("doc_id", "<i8"), ("at", "<u8"), ("tokens", "<u8")])
#: Bytes that a task gathers before it hands them on.
HELD = 8 << 20


def _place(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI and the path in it."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pyarrow.fs.FileSystem.from_uri(uri)


def _put(uri: str, data: bytes) -> None:
    fs, path = _place(uri)
    with fs.open_output_stream(path) as out:
        out.write(data)


def _get(uri: str) -> bytes:
    fs, path = _place(uri)
    with fs.open_input_stream(path) as f:
        return f.read()


class Coder:
    """Compresses and reads single documents with a shared dictionary; an empty one is none."""

    def __init__(self, dictionary: bytes, level: int = 3):
        import zstandard

        d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.sha256 = hashlib.sha256(dictionary).hexdigest()
        self.compress = zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=True).compress
        self.decompress = zstandard.ZstdDecompressor(dict_data=d).decompress


def trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary of at most ``size`` bytes; where there are too few samples to train one, the samples themselves."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h (the text's hash), nth (of the rows as read), and the ids of each whole text with the end id, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import chunk_tokenizer

        t = chunk_tokenizer(tokenizer_path)
        end = np.array([end_id], t.kind).tobytes()
        for batch in batches:
            done, out, size = 0, [], 0
            for k, text in enumerate(batch.column(3), 1):
                out.append(t.encode(text.as_py()).tobytes() + end)
                size += len(out[-1])
                if size > HELD or k == len(batch):
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(done, len(out)) for c in range(3)), pa.array(out, pa.binary())], ["doc_id", "h", "nth", "ids"])
                    done, out, size = k, [], 0

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.monotonically_increasing_id().alias("nth"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, h long, nth long, ids binary")


def train_dictionary(tokens: DataFrame, sample_docs: int = 1000, sample_bytes: int = 16_384, size: int = 65_536) -> bytes:
    """A dictionary of ``size`` bytes from at most ``sample_docs`` documents of at most ``sample_bytes`` bytes of ids.

    They are those of least hash, found by a threshold on the hash first, so that a task hands on few rows.
    """
    n = tokens.count()
    rank = F.xxhash64("doc_id", "h")
    some = tokens.where(F.octet_length("ids") <= sample_bytes)
    if n > 4 * sample_docs:
        some = some.where(F.pmod(rank, F.lit(1 << 40)) < F.lit((4 * sample_docs << 40) // n))
    some = some.select(rank.alias("rank"), "nth", "ids").orderBy("rank", "nth").limit(sample_docs).coalesce(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = [x for batch in batches for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([trained(samples, size)], pa.binary())], ["dictionary"])

    found = some.mapInArrow(run, "dictionary binary").collect()  # one row, or none of an empty table
    return bytes(found[0]["dictionary"]) if found else b""


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", level: int = 3, dictionary: bytes | None = None) -> dict:
    """Writes the token ids of whole texts, ``end_id`` after each document, to files in a folder; returns the manifest.

    Documents are in ascending order of their ids, null ids first; equal ids in order of their texts' hashes, then as
    read; an id that many rows share is spread over several files. A null text is an empty one and has the end id
    alone. Repeated rows are written each for itself; an empty table gives no files; other columns are not read.
    Texts are tokenised where they are read; their ids alone are shuffled. A file's name is that of its task's attempt
    and only files of attempts that ended are in the manifest, so lost executors leave no half-written file in it. The
    folder has to be one that all executors reach.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    tokens = scratch(tokenised(docs, tokenizer_path, end_id, id_col, text_col), "tokens")
    kind = np.dtype("<u2" if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else "<u4")
    if dictionary is None:
        dictionary = train_dictionary(tokens)
    fs, path = _place(folder)
    fs.create_dir(path, recursive=True)
    _put(f"{folder}/dictionary", dictionary)
    shared = spark.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = Coder(shared.value, level), TaskContext.get().partitionId()
        name, out, at, index = f"part-{part:08d}-{uuid.uuid4().hex}", None, 0, []
        for batch in batches:
            for i, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if out is None:
                    to, where = _place(f"{folder}/{name}")
                    out = to.open_output_stream(where, buffer_size=1 << 20)
                    head = json.dumps({"ids": kind.str, "end_id": end_id, "dictionary_sha256": coder.sha256}).encode()
                    out.write(head := MAGIC + struct.pack("<I", len(head)) + head)
                    at = len(head)
                ids = ids.as_buffer()
                out.write(frame := coder.compress(ids))
                index.append((i is not None, i or 0, at, len(ids) // kind.itemsize))
                at += len(frame)
        if out is None:
            return
        rows = np.array(index, INDEX)
        with out:
            out.write(rows.tobytes())
            out.write(struct.pack(FOOTER, at, len(rows), MAGIC))
        ids = [int(r["doc_id"]) if r["known"] else None for r in rows[[0, -1]]]
        yield pa.RecordBatch.from_pylist([{"part": part, "name": name, "documents": len(rows), "tokens": int(rows["tokens"].sum()), "first": ids[0], "last": ids[1], "bytes": at}], schema=pa.schema([("part", pa.int32()), ("name", pa.string()), *((c, pa.int64()) for c in ("documents", "tokens", "first", "last", "bytes"))]))

    order = [F.asc_nulls_first("doc_id"), "h", "nth"]
    ordered = tokens.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids")
    files = sorted(ordered.mapInArrow(run, "part int, name string, documents long, tokens long, first long, last long, bytes long").collect(), key=lambda r: r["part"])  # a row for each task
    start, listed = 0, []
    for r in files:
        listed.append({k: r[k] for k in ("name", "documents", "tokens", "first", "last", "bytes")} | {"start": start})
        start += r["tokens"]
    manifest = {"dictionary_sha256": hashlib.sha256(dictionary).hexdigest(), "end_id": end_id, "documents": sum(r["documents"] for r in files), "tokens": start, "files": listed}
    _put(f"{folder}/manifest.json", json.dumps(manifest).encode())
    known = {r["name"] for r in listed}
    for f in fs.get_file_info(pyarrow.fs.FileSelector(path)):  # what attempts left that did not end
        if f.base_name.startswith("part-") and f.base_name not in known:
            fs.delete_file(f.path)
    forget(tokens)
    return manifest


class TokenFile:
    """One of the files, open for reading: its index, and any document by its place."""

    def __init__(self, uri: str, coder: Coder):
        fs, path = _place(uri)
        self.file, self.coder = fs.open_input_file(path), coder
        size = self.file.size()
        foot = struct.calcsize(FOOTER)
        at, n, magic = struct.unpack(FOOTER, self.file.read_at(foot, size - foot))
        start = self.file.read_at(len(MAGIC) + 4, 0)
        if magic != MAGIC or start[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{uri} is no file of token ids")
        self.header = json.loads(self.file.read_at(struct.unpack("<I", start[len(MAGIC) :])[0], len(start)))
        if self.header["dictionary_sha256"] != coder.sha256:
            raise ValueError(f"{uri} was written with another dictionary")
        self.index = np.frombuffer(self.file.read_at(n * INDEX.itemsize, at), INDEX)
        self.ends = np.append(self.index["at"][1:], np.uint64(at)).astype(np.int64)

    def _ids(self, k: int, frame: bytes) -> np.ndarray:
        ids = np.frombuffer(self.coder.decompress(frame), self.header["ids"])
        if len(ids) != self.index["tokens"][k]:
            raise ValueError(f"document {k} has {len(ids)} ids for {self.index['tokens'][k]}")
        return ids

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document; nothing but its frame is read."""
        at = int(self.index["at"][k])
        return self._ids(k, self.file.read_at(int(self.ends[k]) - at, at))

    def documents(self) -> Iterator[np.ndarray]:
        """The ids of every document in turn, read some megabytes at a time."""
        at, k, n = self.index["at"].astype(np.int64), 0, len(self.index)
        while k < n:
            last = max(k, int(np.searchsorted(self.ends, at[k] + HELD, side="right")) - 1)
            data = memoryview(self.file.read_at(int(self.ends[last] - at[k]), int(at[k])))
            for j in range(k, last + 1):
                yield self._ids(j, data[at[j] - at[k] : self.ends[j] - at[k]])
            k = last + 1


def find(folder: str, doc_id: int) -> list[np.ndarray]:
    """The ids of the documents with an id, from the manifest, the indexes of the files that may have it and their frames."""
    manifest, coder = json.loads(_get(f"{folder}/manifest.json")), Coder(_get(f"{folder}/dictionary"))
    out = []
    for f in manifest["files"]:
        if f["last"] is not None and (f["first"] is None or f["first"] <= doc_id) and doc_id <= f["last"]:
            t = TokenFile(f"{folder}/{f['name']}", coder)
            out += [t.document(int(k)) for k in np.flatnonzero((t.index["known"] == 1) & (t.index["doc_id"] == doc_id))]
    return out


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (tokens before it in all files), n_tokens, ids_crc32 (of 32-bit ids), and the ids if asked for, from the files.

    Each file is one task's work, read some megabytes at a time. No files give no rows.
    """
    manifest = json.loads(_get(f"{folder}/manifest.json"))
    shared = spark.sparkContext.broadcast(_get(f"{folder}/dictionary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f = TokenFile(f"{folder}/{name}", coder)
                rows, held = [], 0
                for known, i, ids in zip(f.index["known"], f.index["doc_id"], f.documents(), strict=True):
                    rows.append((int(i) if known else None, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *[ids] * with_ids))
                    start += len(ids)
                    held += 64 + with_ids * 4 * len(ids)
                    if held > HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [c for c, _ in fields])
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [c for c, _ in fields])

    listed = spark.createDataFrame([(f["name"], f["start"]) for f in manifest["files"]], "name string, start long")
    return listed.repartition(max(1, len(manifest["files"]))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return read(spark, folder)
