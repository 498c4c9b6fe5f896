"""Line dedup: two Bloom filters find suspected repeats, which alone are confirmed.

A pass over the texts sends 64-bit hashes of keys, packed, to the filters; the filters grow with
the number of lines (see ``bloom``). Suspected keys alone go on, as 128-bit digests with the ids of
their documents, to be confirmed; the texts then meet the digests of the lines that they lose.

A line's key is the line without ASCII white space at both ends, A-Z in lower case. Keys of at
least ``min_chars`` code points found in at least ``min_docs`` distinct documents lose all their
lines but those in the largest id that holds the key.

Defined cases: null or empty text is one empty line (null stays null in the output text);
rows that repeat an id count as one document; rows with a null id keep their lines and do not
count; an empty table gives an empty table; other columns pass through unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bloom import ASK, asks, ranges_for, repeated
from .storage import discard, fresh, written
from .workers import lean

MIN_CHARS = 20
MIN_DOCS = 3
#: Keys of a block of documents.
BLOCK_KEYS = 500_000
SPACE = b" \t\n\v\f\r"


def keyed_lines(raw: bytes, min_chars: int) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text and, for each, its key or None where the key is too short."""
    lines = raw.split(b"\n")
    keys: list[bytes | None] = []
    for line in lines:
        key = line.strip(SPACE)
        n = len(key)
        if n >= min_chars and (n >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars):
            keys.append(key.lower())
        else:
            keys.append(None)
    return lines, keys


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with shortened texts and the added columns ``n_lines`` and ``n_dropped`` (bigint).

    Where docs has columns of those names, the added ones get a trailing underscore.
    """
    spark = docs.sparkSession
    names = docs.columns
    n_lines, n_dropped = fresh(names, "n_lines"), fresh(names, "n_dropped")
    drop_col = fresh(names, "drop_keys")
    raw = F.col(text_col).cast("binary")
    known = docs.where(F.col(id_col).isNotNull())
    # A key takes min_chars bytes and a line break at least.
    most = (known.select(F.sum(F.length(raw))).first()[0] or 0) // (min_chars + 1)
    ranges = ranges_for(int(most), int(spark.conf.get("spark.sql.shuffle.partitions")))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks: a row with the ids and the digests of their keys (span -1), and what it asks of the filters."""
        part, number = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        found: list[bytes] = []

        def closed() -> pa.RecordBatch:
            block = (part << 32) + number
            data = b"".join(found)
            rows = [(block, -1, np.array(ids, "<i8").tobytes() + data), *asks(block, np.frombuffer(data, "<u8")[::2], ranges)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["block", "span", "data"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys = {k for k in keyed_lines(text.as_py(), min_chars)[1] if k is not None} if text.is_valid else ()
                found += map(_digest, keys)
                ids += [doc] * len(keys)
                if len(ids) > BLOCK_KEYS:
                    yield closed()
                    number, ids, found = number + 1, [], []
        if ids:
            yield closed()

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, digests = None, None, b""
        for batch in batches:
            for b, span, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if span == -1:
                    n = len(data) // 24
                    block, ids, digests = b, np.frombuffer(data, "<i8", n), data[8 * n :]
                    continue
                assert b == block
                places = np.frombuffer(data, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(ids[places]), pa.array([digests[16 * k : 16 * k + 16] for k in places.tolist()], pa.binary())], names=["id", "key"])

    blocks = written(known.select(F.col(id_col).cast("bigint").alias("id"), raw.alias("raw")).mapInArrow(lean(gather), ASK), "line-blocks")
    again = repeated(blocks.where("span >= 0"), "line-repeats")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = blocks.where("span = -1").unionAll(again.select("block", F.lit(0).alias("span"), F.col("places").alias("data")))
    seen = written(both.repartition(parts, "block").sortWithinPartitions("block", "span").mapInArrow(lean(suspects), "id bigint, key binary"), "line-suspects")
    discard(blocks, again)
    # Written, so that the join shuffles both of its sides and a very common line can be split.
    common = written(seen.groupBy("key").agg(F.countDistinct("id").alias("n"), F.max("id").alias("last")).where(F.col("n") >= min_docs).select("key", "last"), "repeated-lines")
    drops = seen.join(common, "key").where("id <> last").groupBy("id").agg(F.collect_set("key").alias(drop_col))

    text_at = names.index(text_col)
    out_schema = T.StructType([*docs.schema.fields, T.StructField(n_lines, T.LongType()), T.StructField(n_dropped, T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, dropped = [], [], []
            for text, gone in zip(batch.column(text_at), batch.column(len(names)).to_pylist(), strict=True):
                text = text.as_py()
                if not gone:
                    counts.append((text or "").count("\n") + 1)
                    dropped.append(0)
                    texts.append(text)
                    continue
                drop = set(gone)
                lines, own = keyed_lines(text.encode() if text else b"", min_chars)
                keep = [x for x, k in zip(lines, own, strict=True) if k is None or _digest(k) not in drop]
                texts.append(None if text is None else b"\n".join(keep).decode())
                counts.append(len(lines))
                dropped.append(len(lines) - len(keep))
            cols = batch.columns[: len(names)]
            cols[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], names=[*names, n_lines, n_dropped])

    drop_id = fresh([*names, drop_col], "drop_id")
    own = [F.col(f"`{c}`") for c in names]
    joined = known.join(drops.withColumnRenamed("id", drop_id), F.col(id_col).cast("bigint") == F.col(drop_id), "left").select(*own, drop_col)
    nameless = docs.where(F.col(id_col).isNull()).select(*own, F.lit(None).cast("array<binary>").alias(drop_col))
    return joined.mapInArrow(lean(cut), out_schema).unionByName(nameless.mapInArrow(lean(cut), out_schema))


def digest(docs: DataFrame) -> DataFrame:
    """The op9 result: per document the line counts and the hash of what stays."""
    cut = dedup_lines(docs.select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
