"""Lexical retrieval packing: fill token windows with the seed's BM25 neighbours that are still unused."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidewire.llm.tokens import encoder, give_back
from tidewire.session import shared_folder

#: Terms of a seed that look up postings: those with the highest BM25 weight.
QUERY_TERMS = 12
#: Ids in one index shard; a task holds one shard at a time (a longer document makes its shard longer).
SHARD_IDS = 1 << 21
K1, B = 1.2, 0.75
_IDS_SCHEMA = "kind string, doc_id long, place int, data binary, n long, slots array<int>, counts array<int>"
_PIECE_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def encode_documents(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Write, partitioned by ``kind``, the packed ids of each text ('doc') and document frequencies ('df').

    Terms are token ids: their number is fixed by the vocabulary. ``place`` is the smallest hash of
    two neighbouring ids, so texts with much in common tend to have places in common. A task adds up
    document frequencies of its own rows and leaves one sparse row of them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        end, size = enc.pack([end_id]), enc.vocab_size
        counts = np.zeros(size, dtype=np.int64)
        for batch in batches:
            texts = batch["text"].tolist()
            names = batch["doc_id"].array
            for at in range(0, len(texts), 500):
                data = [x + end for x in enc.encode(texts[at : at + 500])]
                places = []
                for one in data:
                    ids = np.frombuffer(one, enc.dtype)
                    counts[np.unique(ids)] += 1
                    pairs = ids[:-1].astype(np.uint32) * np.uint32(0x9E3779B1) + ids[1:]
                    mixed = (pairs ^ (pairs >> np.uint32(15))) * np.uint32(0x85EBCA6B)
                    places.append(int(mixed.min() >> np.uint32(1)) if len(pairs) else 0)
                yield pd.DataFrame(
                    {
                        "kind": "doc",
                        "doc_id": names[at : at + 500],
                        "place": np.array(places, dtype=np.int32),
                        "data": data,
                        "n": [len(x) // enc.dtype.itemsize for x in data],
                        "slots": None,
                        "counts": None,
                    }
                )
        seen = np.flatnonzero(counts)
        yield pd.DataFrame(
            {"kind": ["df"], "doc_id": pd.array([None], dtype="Int64"), "place": [0], "data": [None], "n": [0],
             "slots": [seen.astype(np.int32)], "counts": [counts[seen].astype(np.int32)]}
        )
        # The worker process outlives the task.
        enc.forget()
        give_back()

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows.mapInPandas(run, _IDS_SCHEMA).write.partitionBy("kind").parquet(path)


class Bm25Shard:
    """An inverted index over the documents of one shard, with the corpus's document frequencies."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float):
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        cells = np.repeat(np.arange(len(docs)) * len(idf), sizes)
        if docs:
            cells += np.concatenate(docs)
        cells, tf = np.unique(cells, return_counts=True)
        self.doc, self.term = (cells // len(idf)).astype(np.int32), (cells % len(idf)).astype(np.int32)
        del cells
        norm = K1 * (1 - B + B * sizes[self.doc] / max(mean_length, 1.0))
        self.weight = (idf[self.term] * tf * (K1 + 1) / (tf + norm)).astype(np.float32)
        self.rows = np.searchsorted(self.doc, np.arange(len(docs) + 1))
        by_term = np.argsort(self.term, kind="stable")
        self.post_doc, self.post_weight = self.doc[by_term], self.weight[by_term]
        self.post_starts = np.searchsorted(self.term[by_term], np.arange(len(idf) + 1))
        self.score = np.zeros(len(docs), dtype=np.float32)

    def neighbours(self, seed: int, used: np.ndarray, n_terms: int = QUERY_TERMS) -> np.ndarray:
        """Unused documents that share a query term with ``seed``, best first; equal scores by position."""
        a, b = self.rows[seed], self.rows[seed + 1]
        best = self.weight[a:b]
        terms = self.term[a:b][np.argsort(-best, kind="stable")[:n_terms]]
        found = []
        for t in terms.tolist():
            s, e = self.post_starts[t], self.post_starts[t + 1]
            hit = self.post_doc[s:e]
            self.score[hit] += self.post_weight[s:e]
            found.append(hit)
        if not found:
            return np.zeros(0, dtype=np.int64)
        hits = np.unique(np.concatenate(found))
        score = self.score[hits]
        self.score[hits] = 0
        free = ~used[hits]
        hits, score = hits[free], score[free]
        return hits[np.argsort(-score, kind="stable")]


class Windows:
    """Windows of one task, filled one after the other without gaps; only the last may stay short."""

    def __init__(self, size: int, first_id: int):
        self.size, self.sequence, self.fill, self.rows = size, first_id, 0, []

    def add(self, name, ids: np.ndarray) -> None:
        wide, n, at = ids.astype("<u4").tobytes(), len(ids), 0
        while at < n:
            take = min(n - at, self.size - self.fill)
            crc = zlib.crc32(wide[4 * at : 4 * (at + take)])
            self.rows.append((name, at, take, crc, n, self.sequence, self.fill))
            at, self.fill = at + take, self.fill + take
            if self.fill == self.size:
                self.sequence, self.fill = self.sequence + 1, 0

    def taken(self) -> pd.DataFrame:
        rows, self.rows = self.rows, []
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in _PIECE_SCHEMA.split(", ")])
        return out.astype({"doc_id": "Int64"})


def pack_shard(names: list, docs: list[np.ndarray], idf: np.ndarray, mean_length: float, out: Windows) -> None:
    """Place all documents of a shard: a seed, then its unused neighbours, best first, until its window is full.

    The document that reaches the end of a window is cut there; its rest opens the next window and it
    becomes the seed of that one, so a window holds related text from its first id on.
    """
    index = Bm25Shard(docs, idf, mean_length)
    used = np.zeros(len(docs), dtype=bool)
    following, seed = 0, None
    while True:
        if seed is None:
            while following < len(docs) and used[following]:
                following += 1
            if following == len(docs):
                return
            seed = following
            used[seed] = True
            out.add(names[seed], docs[seed])
        queue, current, seed = index.neighbours(seed, used), out.sequence, None
        for i in queue.tolist():
            used[i] = True
            out.add(names[i], docs[i])
            if out.sequence != current:
                seed = i  # its rest, or nothing of it, lies in the new window
                break


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Pack (doc_id, text) into sequences of ``size`` ids; one row per piece of a document.

    Columns: doc_id, start (ids of the document before the piece), length, ids_crc32, doc_tokens,
    sequence_id, offset. Every id of every document lies in exactly one piece; a sequence is full but
    for the last of each task. A null text counts as empty and has its end id; repeated rows and rows
    without doc_id are packed each for itself.

    Three passes: ids are written once to the shared folder together with per-task document
    frequencies; these are added up (one number per vocabulary entry, so their size is bounded);
    documents are dealt by ranges of (place, doc_id), so a place that many documents have spreads
    over tasks, and every task indexes and packs shard after shard.
    """
    spark = docs.sparkSession
    path = shared_folder(spark, "packing")
    encode_documents(docs, path, tokenizer, end_id)
    table = spark.read.schema(_IDS_SCHEMA).parquet(path)
    rows = table.where("kind = 'doc'")
    frequency = (
        table.where("kind = 'df'")
        .select(F.explode(F.arrays_zip("slots", "counts")).alias("x"))
        .groupBy("x.slots")
        .agg(F.sum("x.counts"))
        .collect()
    )
    totals = rows.agg(F.count("*"), F.coalesce(F.avg("n"), F.lit(0.0))).first()
    idf_of = {int(t): float(np.log1p((totals[0] - f + 0.5) / (f + 0.5))) for t, f in frequency}
    terms = max(idf_of, default=0) + 1
    idf_bytes = spark.sparkContext.broadcast(idf_of)
    mean_length = float(totals[1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A worker process that encoded before has no more use for its pieces.
        encoder.cache_clear()
        give_back()
        idf = np.zeros(terms)
        idf[list(idf_bytes.value)] = list(idf_bytes.value.values())
        out = Windows(size, TaskContext.get().partitionId() << 40)
        names, held, n_ids = [], [], 0
        for batch in batches:
            for name, data, n in zip(batch["doc_id"], batch["data"], batch["n"]):
                names.append(None if pd.isna(name) else int(name))
                held.append(np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4"))
                n_ids += len(held[-1])
                if n_ids >= shard_ids:
                    pack_shard(names, held, idf, mean_length, out)
                    names, held, n_ids = [], [], 0
                    yield out.taken()
        pack_shard(names, held, idf, mean_length, out)
        yield out.taken()
        del names, held, out
        give_back()

    return (
        rows.select("doc_id", "place", "data", "n")
        .repartitionByRange("place", "doc_id", F.xxhash64("data"))
        .sortWithinPartitions("place", "doc_id", F.xxhash64("data"))
        .select("doc_id", "data", "n")
        .mapInPandas(run, _PIECE_SCHEMA)
    )
