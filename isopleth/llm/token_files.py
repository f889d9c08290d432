"""Token files: one id array a file with Elias-Fano coded document boundaries.

``write_token_files`` deals the documents out in ranges of ascending doc_id,
encodes them, appends the end id to each and writes files whose manifest Spark
commits; files of tasks that failed or ran twice are in no manifest and so are
never read.  ``read_token_files`` decodes the boundaries and returns one row a
document.

Cases: a null or empty text is a document of the end id alone; repeated doc_ids
are kept, in an order that follows from their texts; null doc_ids come first; no documents give no files;
other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from . import elias_fano
from ._shared import columns, make_folder, materialize, partitions_for, scratch
from .encode import encoder

_MAGIC = b"EFTOKEN1"
_HEAD = struct.Struct("<8sIIqIIIQ")
MANIFEST = "part int, file int, path string, docs long, tokens long"


def pack_file(doc_ids: list[int | None], lengths: np.ndarray, ids: bytes) -> bytes:
    """A whole file: header, boundaries, document ids, token ids.

    ``ids`` are little-endian unsigned 32-bit; two bytes each are stored if all
    fit.  Null document ids must come first.
    """
    nulls = sum(d is None for d in doc_ids)
    known = np.asarray(doc_ids[nulls:], np.int64)
    base = int(known[0]) if len(known) else 0
    bounds = elias_fano.encode(np.concatenate([[0], np.cumsum(lengths)]).astype(np.uint64))
    names = elias_fano.encode(known.view(np.uint64) - np.uint64(base & (2**64 - 1)))
    wide = np.frombuffer(ids, "<u4")
    width = 2 if not len(wide) or int(wide.max()) < 65536 else 4
    body = bounds + names + (wide.astype("<u2").tobytes() if width == 2 else ids)
    return _HEAD.pack(_MAGIC, width, nulls, base, len(bounds), len(names), zlib.crc32(body), len(wide)) + body


def unpack_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, boundaries (one more than documents) and ids as uint32."""
    magic, width, nulls, base, a, b, crc, n = _HEAD.unpack_from(data)
    body = data[_HEAD.size :]
    if magic != _MAGIC or zlib.crc32(body) != crc:
        raise ValueError("not a token file, or damaged")
    bounds = elias_fano.EliasFano(body[:a]).values().astype(np.int64)
    names = elias_fano.EliasFano(body[a : a + b]).values() + np.uint64(base & (2**64 - 1))
    ids = np.frombuffer(body, "<u2" if width == 2 else "<u4", n, a + b).astype("<u4")
    return [None] * nulls + names.view(np.int64).tolist(), bounds, ids


class TokenFile:
    """Single documents of a file: ``select`` on the coded boundaries says where one
    lies, and only its ids are read."""

    def __init__(self, path: str):
        system, inner = _open(path)
        self.file = system.open_input_file(inner)
        magic, self.width, self.nulls, self.base, a, b, _, self.tokens = _HEAD.unpack(self.file.read_at(_HEAD.size, 0))
        if magic != _MAGIC:
            raise ValueError("not a token file, or damaged")
        self.bounds = elias_fano.EliasFano(self.file.read_at(a, _HEAD.size))
        self.names = elias_fano.EliasFano(self.file.read_at(b, _HEAD.size + a))
        self.at = _HEAD.size + a + b

    def __len__(self) -> int:
        return self.bounds.n - 1

    def doc_id(self, i: int) -> int | None:
        if i < self.nulls:
            return None
        value = (self.names.select(i - self.nulls) + self.base) % 2**64
        return value - 2**64 if value >= 2**63 else value

    def span(self, i: int) -> tuple[int, int]:
        """First id of document ``i`` and the first one after it."""
        return self.bounds.select(i), self.bounds.select(i + 1)

    def ids(self, i: int) -> np.ndarray:
        a, b = self.span(i)
        return np.frombuffer(self.file.read_at((b - a) * self.width, self.at + a * self.width), f"<u{self.width}").astype("<u4")

    def close(self) -> None:
        self.file.close()


#: Hadoop's names of file systems that Arrow knows by another one.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def arrow_uri(path: str) -> str:
    """``path`` as Arrow's file systems name it."""
    scheme, colon, rest = path.partition("://")
    return f"{_SCHEMES.get(scheme, scheme)}{colon}{rest}"


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(arrow_uri(path))


def put_file(path: str, data: bytes) -> None:
    system, inner = _open(path)
    with system.open_output_stream(inner) as f:
        f.write(data)


def get_file(path: str) -> bytes:
    system, inner = _open(path)
    with system.open_input_stream(inner) as f:
        return f.read()


def ordered(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in partitions of ascending ranges of doc_id, each sorted."""
    slim = docs.select(*columns(docs, "doc_id", "text"))
    n = partitions_for(slim)
    by = ("doc_id", F.xxhash64("text"))  # rows of one doc_id, or without one, are cut too
    return slim.repartitionByRange(n, *by).sortWithinPartitions(*by, "text")


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int = 1, file_tokens: int = 1 << 24, folder: str | None = None) -> DataFrame:
    """Write the files; return their manifest, materialised, one row a file."""
    folder = folder or scratch(docs.sparkSession, "tokens")
    make_folder(docs.sparkSession, folder)
    end = np.asarray([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode = TaskContext.get().partitionId(), encoder(vocabulary).encode
        names, parts, sizes, total, file = [], [], [], 0, 0

        def close():
            path = f"{folder}/{part:06d}-{file:05d}-{uuid.uuid4().hex}.tok"
            put_file(path, pack_file(names, np.asarray(sizes, np.int64), b"".join(parts)))
            return pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "file": pa.array([file], pa.int32()), "path": [path], "docs": [len(names)], "tokens": [total]}
            )

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                coded = encode(some.column(1).to_pylist())
                for name, ids in zip(some.column(0).to_pylist(), coded, strict=True):
                    names.append(name)
                    parts += (ids, end)
                    sizes.append(len(ids) // 4 + 1)
                    total += sizes[-1]
                    if total >= file_tokens:
                        yield close()
                        names, parts, sizes, total, file = [], [], [], 0, file + 1
        if names:
            yield close()

    return materialize(ordered(docs).mapInArrow(write, MANIFEST), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids before it), n_tokens, ids_crc32 of every document.

    The starts of files are prefix sums over the manifest: a row a file, not a
    row a document, meets in one task.
    """
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                names, bounds, ids = unpack_file(get_file(path))
                view, cut = memoryview(ids).cast("B"), (bounds * 4).tolist()
                sums = [zlib.crc32(view[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": pa.array(names, pa.int64()), "start": pa.array(bounds[:-1] + base), "n_tokens": pa.array(np.diff(bounds)), "ids_crc32": pa.array(sums, pa.int64())}
                )

    n = max(1, manifest.count())
    return files.repartition(min(n, 20_000)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
