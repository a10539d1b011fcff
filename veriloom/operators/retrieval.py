"""Sentence corpus, exact dense top-k, reranking and retrieval measures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank
from .shape import first_wins

#: Bytes of query vectors that are held against the corpus at once; so much is broadcast.
QUERY_BYTES = 16 << 20


def corpus(sentences: DataFrame, *more: str) -> DataFrame:
    """One record for each sentence of the index that is not blank; the first delivered row of a key wins."""
    named = sentences.filter("page_id IS NOT NULL AND sentence_id IS NOT NULL")
    index = first_wins(named.select("page_id", "sentence_id", "row_id", "text", "corpus_version"), ["page_id", "sentence_id"], "row_id")
    kept = index.filter(~is_blank(F.col("text")))
    return kept.select(corpus_id(F.col("page_id"), F.col("sentence_id")).alias("corpus_id"), "page_id", "sentence_id", "text", "corpus_version", *more)


def corpus_id(page_id: Column, sentence_id: Column) -> Column:
    return F.concat_ws("::", page_id, sentence_id.cast("string"))


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(inner_product(v, v))


class _Best:
    """The k best candidates of each query so far: by score, then by the smaller id."""

    def __init__(self, k: int):
        self.k = k
        self.row, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, row: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        row, score, id_ = np.concatenate((self.row, row)), np.concatenate((self.score, score)), np.concatenate((self.id, id_))
        order = np.lexsort((id_, -score, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = order[place < self.k]
        self.row, self.score, self.id = row[place < self.k], score[kept], id_[kept]


def top_k(vectors: DataFrame, queries: DataFrame, k: int, block_bytes: int = QUERY_BYTES) -> DataFrame:
    """(q, c, score, rank): exact inner-product neighbours of each query among all other vectors.

    ``vectors`` and ``queries`` are (id, vector). A block of queries is broadcast; its size
    is bounded in bytes, so few blocks, as a rule one, mean few scans of the vectors. Each
    task multiplies its batches with the block, keeps the k best of every query while it
    goes, and passes on only those at its end; a window merges the tasks' results. Ties go
    to the smaller id.
    """
    spark = vectors.sparkSession
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(1)).alias("d")).first()
    blocks = max(1, -(-size["n"] * size["d"] * 8 // block_bytes))
    parts = None
    for number in range(blocks if size["n"] else 0):
        rows = queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number).collect()
        if not rows:
            continue
        shared = spark.sparkContext.broadcast((np.array([r["id"] for r in rows], np.int64), np.array([r["vector"] for r in rows], np.float64)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, matrix = shared.value
            best = _Best(k)
            for batch in batches:
                own = batch.column(0).to_numpy(zero_copy_only=False)
                if not len(own):
                    continue
                values = np.array(batch.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(own), -1)
                found = []
                for at in range(0, len(ids), 1024):  # bounds the matrix of scores
                    scores = matrix[at : at + 1024] @ values.T
                    scores[ids[at : at + 1024, None] == own[None, :]] = -np.inf
                    hit = np.isfinite(scores)
                    if len(own) > k:
                        hit &= scores >= np.partition(scores, len(own) - k, axis=1)[:, len(own) - k, None]
                    r, c = np.nonzero(hit)
                    found.append((r + at, scores[r, c], own[c]))
                best.add(*(np.concatenate(x) for x in zip(*found)))
            for at in range(0, len(best.row), 1 << 20):
                part = slice(at, at + (1 << 20))
                yield pa.RecordBatch.from_arrays([pa.array(ids[best.row[part]]), pa.array(best.id[part]), pa.array(best.score[part])], names=["q", "c", "score"])

        part = vectors.select("id", "vector").mapInArrow(run, "q long, c long, score double")
        parts = part if parts is None else parts.unionAll(part)
    if parts is None:
        return spark.createDataFrame([], "q long, c long, score double, rank int")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    return parts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def rerank(candidates: DataFrame, score: Column, keep: int) -> DataFrame:
    """Adds reranker_score and reranked_rank (ties keep the first order) and keeps the best of each query."""
    w = Window.partitionBy("q").orderBy(F.desc("reranker_score"), "rank")
    scored = candidates.withColumn("reranker_score", score)
    return scored.withColumn("reranked_rank", F.row_number().over(w)).filter(F.col("reranked_rank") <= keep)


def first_hits(ranked: DataFrame, rank: str, hit: Column) -> DataFrame:
    """(q, first_hit): the best rank of a relevant candidate, null if there is none."""
    return ranked.groupBy("q").agg(F.min(F.when(hit, F.col(rank))).alias("first_hit"))


def recall_at(hits: DataFrame, cutoffs: list[int]) -> DataFrame:
    """(k, n_queries, recall); 0.0 over no queries."""
    one = hits.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("first_hit") <= k).alias(f"h{k}") for k in cutoffs])
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col("n").alias("n_queries"), F.coalesce(F.round(F.try_divide(F.col(f"h{k}"), F.col("n")), 6), F.lit(0.0)).alias("recall")) for k in cutoffs])
    return one.select(F.inline(rows))
