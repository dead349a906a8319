"""Token-id files: concatenated ids with Elias-Fano document boundaries, in ascending order of document id."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from tidewire.llm.elias_fano import EliasFano
from tidewire.llm.tokens import encoder

MAGIC = b"TIDEIDS1"
#: A shard is closed when it holds so many ids (a longer document still lies whole in one shard).
SHARD_IDS = 1 << 20
_HEAD = struct.Struct("<8sBQQQq")
_SHARD_SCHEMA = "part int, seq int, n_docs long, n_ids long, data binary"
_DOC_SCHEMA = "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long"


@dataclass
class Shard:
    """``ids`` of all documents in a row; document i is ids[bounds.select(i) : bounds.select(i + 1)].

    The first ``n_null`` documents have no id; ``doc_ids`` has the others', less ``first_id``.
    """

    ids: np.ndarray
    bounds: EliasFano
    n_null: int
    first_id: int
    doc_ids: EliasFano

    @classmethod
    def of(cls, ids: list[bytes], doc_ids: list[int | None], dtype: np.dtype) -> Shard:
        known = np.array([d for d in doc_ids if d is not None], dtype=np.int64)
        first = int(known[0]) if len(known) else 0
        # Wrapping subtraction: ids far apart still give the right unsigned difference.
        gaps = known.astype(np.uint64) - np.uint64(first % (1 << 64))
        sizes = np.fromiter((len(x) // dtype.itemsize for x in ids), np.int64, len(ids))
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        return cls(
            np.frombuffer(b"".join(ids), dtype),
            EliasFano.encode(bounds, int(bounds[-1]) + 1),
            len(doc_ids) - len(known),
            first,
            EliasFano.encode(gaps, int(gaps[-1]) + 1 if len(gaps) else 1),
        )

    def to_bytes(self) -> bytes:
        head = _HEAD.pack(MAGIC, self.ids.itemsize, self.bounds.n - 1, len(self.ids), self.n_null, self.first_id)
        return head + self.bounds.to_bytes() + self.doc_ids.to_bytes() + self.ids.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        magic, width, n_docs, n_ids, n_null, first = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token-id shard")
        bounds, at = EliasFano.from_bytes(data, _HEAD.size)
        doc_ids, at = EliasFano.from_bytes(data, at)
        if bounds.n != n_docs + 1:
            raise ValueError("a damaged token-id shard")
        return cls(np.frombuffer(data, f"<u{width}", n_ids, at), bounds, n_null, first, doc_ids)

    def document(self, i: int) -> np.ndarray:
        """The ids of document i."""
        a, b = self.bounds.select([i, i + 1])
        return self.ids[a:b]

    def all_doc_ids(self) -> list[int | None]:
        gaps = self.doc_ids.select(np.arange(self.doc_ids.n))
        return [None] * self.n_null + (gaps + self.first_id).tolist()


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shard_ids: int = SHARD_IDS) -> None:
    """Encode every text of ``docs`` (doc_id, text) and write shards in ascending order of doc_id.

    Documents are dealt by ranges of doc_id (ties by the hash of the text, then the text), each task
    streams its range in order and closes a shard after ``shard_ids`` ids, so a task holds one shard.
    Shards are byte strings in a Parquet column: Spark's commit protocol then covers lost executors
    and repeated tasks. A null text counts as empty; rows without doc_id come first.
    """
    ordered = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange("doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    )

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        end = enc.pack([end_id])
        part, seq, held, ids, names = TaskContext.get().partitionId(), 0, 0, [], []

        def closed() -> pd.DataFrame:
            row = (part, seq, len(ids), held // enc.dtype.itemsize, Shard.of(ids, names, enc.dtype).to_bytes())
            return pd.DataFrame([row], columns=["part", "seq", "n_docs", "n_ids", "data"])

        for batch in batches:
            texts = batch["text"].tolist()
            keys = [None if pd.isna(d) else int(d) for d in batch["doc_id"]]
            for at in range(0, len(texts), 500):
                for name, one in zip(keys[at : at + 500], enc.encode(texts[at : at + 500])):
                    ids.append(one + end)
                    names.append(name)
                    held += len(ids[-1])
                    if held >= shard_ids * enc.dtype.itemsize:
                        yield closed()
                        seq, held, ids, names = seq + 1, 0, [], []
        if ids:
            yield closed()

    ordered.mapInPandas(shards, _SHARD_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_token_files(df: DataFrame) -> DataFrame:
    """From the rows of written shards: doc_id, start, n_tokens and the crc32 of each document's ids.

    ``start`` counts the ids of all documents before; it is the sum over the earlier range parts (one
    row each), over the earlier shards of the part, and the select of the boundary in the shard.
    """
    parts = df.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select(
        "part", (F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before")
    )
    inside = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    bases = (
        df.select("part", "seq", "n_ids")
        .withColumn("inside", F.sum("n_ids").over(inside) - F.col("n_ids"))
        .join(before, "part")
        .select("part", "seq", (F.col("before") + F.col("inside")).alias("base"))
    )

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, seq, data in zip(batch["part"], batch["seq"], batch["data"]):
                shard = Shard.from_bytes(data)
                bounds = shard.bounds.select(np.arange(shard.bounds.n))
                wide = memoryview(shard.ids.astype("<u4").tobytes())
                crc = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pd.DataFrame(
                    {
                        "part": part,
                        "seq": seq,
                        "doc_id": pd.array(shard.all_doc_ids(), dtype="Int64"),
                        "inside": bounds[:-1],
                        "n_tokens": np.diff(bounds),
                        "ids_crc32": np.array(crc, dtype=np.int64),
                    }
                )

    # The shards' bytes stay where they are read; small rows meet the bases.
    return (
        df.select("part", "seq", "data")
        .mapInPandas(documents, _DOC_SCHEMA)
        .join(bases, ["part", "seq"])
        .select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
    )
