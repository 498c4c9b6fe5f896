"""Token ids as flat binary files in id order, and back.

Layout of a folder: for each part ``part-NNNNN.bin`` holds the ids of its documents one after
the other, as little-endian unsigned integers of 2 or 4 bytes (the smallest that holds the
vocabulary); ``part-NNNNN.off`` the n+1 offsets of its n documents, 64-bit, in ids; and
``part-NNNNN.doc`` their ids, 64-bit (the least value stands for null). ``index.json`` has the
width and, for each part, its documents, ids and base: the ids in all parts before it, a prefix
sum over the parts. A file is written under another name first and then moved, so that a second
attempt of a task replaces it by the same bytes.

Defined cases: null text is empty; every document has its end id; null ids come first; rows
that repeat an id are kept, in any order among themselves; an empty table gives no parts.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import load
from .workers import lean

END_ID = 2
NULL_ID = -(1 << 63)


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _name(part: int, kind: str) -> str:
    return f"part-{part:05d}.{kind}"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, width: int | None = None) -> dict:
    """Writes the folder and returns its index. ``width`` in bytes overrides the smallest."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if width is None:
        width = 2 if load(tokenizer).vocab <= 1 << 16 and end_id < 1 << 16 else 4
    fs, root = _open(path)
    fs.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(tokenizer)
        context = TaskContext.get()
        part, fs_root = context.partitionId(), _open(path)
        fs, root = fs_root
        temp = f"{root}/{_name(part, 'bin')}.{context.taskAttemptId()}"
        offsets, ids_of = [0], []
        out = None
        end = np.array([end_id], "<u4")
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out = out or fs.open_output_stream(temp)
                ids = np.concatenate([encoder.encode(text.as_py() or ""), end])
                out.write(ids.astype(f"<u{width}").tobytes())
                offsets.append(offsets[-1] + len(ids))
                ids_of.append(NULL_ID if doc is None else doc)
        if out is None:
            return
        out.close()
        fs.move(temp, f"{root}/{_name(part, 'bin')}")
        for kind, values in (("off", offsets), ("doc", ids_of)):
            with fs.open_output_stream(f"{temp}.{kind}") as f:
                f.write(np.array(values, "<i8").tobytes())
            fs.move(f"{temp}.{kind}", f"{root}/{_name(part, kind)}")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "docs": pa.array([len(ids_of)], pa.int64()), "ids": pa.array([offsets[-1]], pa.int64())})

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dealt = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    found = sorted(dealt.mapInArrow(lean(write), "part int, docs bigint, ids bigint").collect())
    base, index = 0, {"width": width, "end_id": end_id, "parts": []}
    for r in found:  # a row for each part
        index["parts"].append({"part": r.part, "docs": r.docs, "ids": r.ids, "base": base})
        base += r.ids
    with fs.open_output_stream(f"{root}/index.json") as f:
        f.write(json.dumps(index).encode())
    return index


def read_index(path: str) -> dict:
    fs, root = _open(path)
    with fs.open_input_stream(f"{root}/index.json") as f:
        return json.loads(f.read())


class Part:
    """One part, memory-mapped where the folder is local; else read by range."""

    def __init__(self, path: str, part: int, width: int) -> None:
        self.fs, root = _open(path)
        self.width, self.file = width, f"{root}/{_name(part, 'bin')}"
        self.offsets, self.docs = (self._all(f"{root}/{_name(part, k)}") for k in ("off", "doc"))
        self.map = np.memmap(self.file, f"<u{width}", "r") if isinstance(self.fs, pafs.LocalFileSystem) else None

    def _all(self, name: str) -> np.ndarray:
        with self.fs.open_input_stream(name) as f:
            return np.frombuffer(f.read(), "<i8")

    def tokens(self, k: int) -> np.ndarray:
        a, b = int(self.offsets[k]), int(self.offsets[k + 1])
        if self.map is not None:
            return self.map[a:b]
        with self.fs.open_input_file(self.file) as f:
            f.seek(a * self.width)
            return np.frombuffer(f.read((b - a) * self.width), f"<u{self.width}")


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    index = read_index(path)
    width = index["width"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = Part(path, number, width)
                n = len(part.docs)
                crc = np.fromiter((zlib.crc32(part.tokens(k).astype("<u4").tobytes()) for k in range(n)), np.int64, n)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(part.docs, pa.int64(), mask=part.docs == NULL_ID),
                    "start": pa.array(part.offsets[:-1] + base, pa.int64()),
                    "n_tokens": pa.array(np.diff(part.offsets), pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                })

    rows = [(p["part"], p["base"]) for p in index["parts"]]
    parts = spark.createDataFrame(rows, "part int, base bigint").repartitionByRange(max(1, len(rows)), "part")
    return parts.mapInArrow(lean(read), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
