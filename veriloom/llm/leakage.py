"""Evaluation texts that stand, wholly or in part, word for word or paraphrased, in training documents.

Retrieval is latent semantic. A word that no evaluation item has can't lie within a
leaked passage, so one scan cuts the documents into passages of evaluation words (told
by a bitmap of fixed size) and counts, over all documents, in how many each word stands.
A randomised SVD of the TF-IDF matrix of passages and items (range finder with one power
iteration; hashed terms, so that every matrix has a bound, and sums of sparse slices over
the tasks) gives the latent space. Windows of ``least`` words of passages and items are
projected; the signs of random sums of their coordinates are their signatures, and
windows that share one of several signatures are candidates: the nearer their cosine to
1, the likelier. Both sides are tables joined by signature, so neither the number of
items nor that of documents is bounded, and documents are scanned once.

``leaked`` keeps candidates whose words are equal. Equal windows have equal vectors,
computed in whole numbers and so in any order the same, hence equal signatures: nothing
is lost to the search. ``paraphrased`` keeps candidates whose cosine is high, whose words
agree in order for the most part (longest common subsequence) and that hold the answer,
the numbers and the rarest word of the item's window; here the latent space decides what
is found. As the rarest word must be there, it is part of the key of such candidates, so
that common turns of phrase meet no one.

Defined results: case, punctuation, blanks and line breaks do not matter; null and
empty texts hold nothing, items with fewer than ``least`` words leak nowhere; a document
or item without an id can't be reported; repeated documents each count; whole texts are read; words are compared by 64-bit digests; extra
columns are ignored; an empty table on either side gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import pair_join
from ..session import shuffle_width, written
from .overlap import common_length

#: Bits of the bitmap that tells evaluation words: 2 MB.
BITS = 1 << 24
#: Hashed terms of the TF-IDF matrix, and how many of them make a slice when products are summed up.
TERMS, SLICE = 1 << 15, 1 << 10
#: Latent dimensions, and further ones that the range finder draws.
RANK, MORE = 64, 16
#: Random sums of a signature and signatures of a window, for equal windows and for paraphrases.
EQUAL, NEAR = (24, 1), (6, 4)
#: Least cosine of a paraphrase, and the share of its words that agree in order.
COSINE, SHARE = 0.8, 0.7
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.casefold())


class Digests(dict):
    """64-bit digests of words; 0 stands for a word that is not known."""

    def __init__(self, known: np.ndarray | None = None):
        super().__init__()
        self.known = known

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = xxhash.xxh64_intdigest(word) - (1 << 63)
        bit = h & (BITS - 1)
        if self.known is not None and not self.known[bit >> 3] >> (bit & 7) & 1:
            h = 0
        self[word] = h
        return h

    def of(self, text: str) -> np.ndarray:
        return np.array([self[w] for w in words_of(text)], np.int64)


def item_terms(items: DataFrame, least: int) -> DataFrame:
    """(item_id, terms, numbers): the digests of the words of each item that is long enough, and which of them hold a digit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = Digests()
        for batch in batches:
            ids, terms, numbers = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = words_of(text.as_py() or "")
                if i is not None and len(tokens) >= least:
                    ids.append(i)
                    terms.append(np.array([digests[w] for w in tokens], np.int64).tobytes())
                    numbers.append(bytes(any(c.isdigit() for c in w) for w in tokens))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.binary()), pa.array(numbers, pa.binary())], names=["item_id", "terms", "numbers"])

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, terms binary, numbers binary")


def bitmap(bits: DataFrame) -> np.ndarray:
    """The bitmap of the numbers in ``bit``; what reaches the driver is BITS / 8 bytes at most."""
    at = F.col("bit") + 1  # buckets count from 1
    packed = bits.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    found = np.zeros(BITS // 8, np.uint8)
    for r in packed.collect():
        start = (r["bucket"] - 1) * 4096
        found[start : start + 4096] = np.frombuffer(r["bits"], np.uint8)
    return found


def in_bitmap(known: np.ndarray, digests: np.ndarray) -> np.ndarray:
    bit = digests & (BITS - 1)
    return (known[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)


def _bits(items: DataFrame, of) -> DataFrame:
    """(bit) of the digests that ``of`` takes from the words of an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [of(np.frombuffer(t.as_buffer(), np.int64)) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(own) & (BITS - 1)) if own else np.zeros(0, np.int64))], names=["bit"])

    return items.select("terms").mapInArrow(run, "bit long")


def _sum_slices(parts: DataFrame, width: int = 1) -> dict[int, np.ndarray]:
    """Sums of the rows of a matrix over all terms, ``width`` numbers each, by slice; every task adds up slices of its own.

    ``rows`` has the places within the slice that hold anything and ``sums`` what they hold.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, at, x in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                at = np.frombuffer(at.as_buffer(), np.int32)
                own = total.setdefault(k, np.zeros((SLICE, width)))
                own[at] += np.frombuffer(x.as_buffer(), np.float64).reshape(len(at), width)
        yield _sparse([(k, v) for k, v in total.items()])

    kind = "slice int, rows binary, sums binary"
    tasks = min(TERMS // SLICE, shuffle_width(parts.sparkSession))
    rows = parts.select("slice", "rows", "sums").mapInArrow(add, kind).repartition(tasks, "slice").mapInArrow(add, kind).collect()
    out = {}
    for r in rows:
        out[r["slice"]] = np.zeros((SLICE, width))
        out[r["slice"]][np.frombuffer(r["rows"], np.int32)] = np.frombuffer(r["sums"], np.float64).reshape(-1, width)
    return out


def _sparse(slices: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    """Slices by the rows of them that hold anything."""
    cut = [(k, np.flatnonzero(v.any(axis=1)).astype(np.int32), v) for k, v in slices]
    cut = [(k, at, v[at]) for k, at, v in cut if len(at)]
    return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in cut], pa.int32()), pa.array([at.tobytes() for _, at, _ in cut], pa.binary()), pa.array([v.tobytes() for _, _, v in cut], pa.binary())], names=["slice", "rows", "sums"])


def _slices(matrix: np.ndarray) -> list[tuple[int, np.ndarray]]:
    return [(k, matrix[k * SLICE : (k + 1) * SLICE].reshape(SLICE, -1)) for k in range(TERMS // SLICE)]


def passages(documents: DataFrame, known, least: int, gap: int = 0) -> DataFrame:
    """(doc_id, terms) of each run of at least ``least`` evaluation words with no more than ``gap`` others between two of them.

    Rows with a slice carry, for all terms, in how many of a task's documents they stand; slice -1 has the number of documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = Digests(known.value)
        frequency, seen = np.zeros(TERMS), 0

        names = ["doc_id", "terms", "slice", "rows", "sums"]
        for batch in batches:
            ids, terms = [], []
            seen += batch.num_rows
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                found = digests.of(text)
                at = np.flatnonzero(found)
                own = found[at]
                frequency[np.unique(own & (TERMS - 1))] += 1
                edges = np.concatenate(([0], np.flatnonzero(np.diff(at) > gap + 1) + 1, [len(own)]))
                for k in np.flatnonzero(np.diff(edges) >= least):
                    ids.append(i)
                    terms.append(own[edges[k] : edges[k + 1]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.binary()), pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.binary()), pa.nulls(len(ids), pa.binary())], names=names)
        total = np.zeros((SLICE, 1))
        total[0] = seen
        counts = _sparse([*_slices(frequency), (-1, total)])
        yield pa.RecordBatch.from_arrays([pa.nulls(counts.num_rows, pa.int64()), pa.nulls(counts.num_rows, pa.binary()), *counts.columns], names=names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, terms binary, slice int, rows binary, sums binary")


def _gram(rows: list[np.ndarray], weight: np.ndarray, basis: np.ndarray, into: np.ndarray) -> None:
    """Adds A'A basis to ``into``, A being the TF-IDF rows of the passages."""
    block, size = [], 0
    for p in [*rows, None]:
        if p is not None:
            block.append(p)
            size += len(p)
        if block and (p is None or size > 50_000):
            terms = np.concatenate(block)
            starts = np.concatenate(([0], np.cumsum([len(b) for b in block])[:-1]))
            projected = np.add.reduceat(weight[terms][:, None] * basis[terms], starts, axis=0)
            back = weight[terms][:, None] * np.repeat(projected, np.diff(np.append(starts, len(terms))), axis=0)
            order = np.argsort(terms, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], np.diff(terms[order]) > 0)))
            into[terms[order][first]] += np.add.reduceat(back[order], first, axis=0)
            block, size = [], 0


def latent_space(rows: DataFrame, weight: np.ndarray, seed: int = 0) -> np.ndarray:
    """Orthonormal basis (terms x RANK) of the TF-IDF rows in ``terms``, by a randomised SVD; its matrices have a bound, whatever the rows."""
    spark = rows.sparkSession
    basis = np.random.default_rng(seed).standard_normal((TERMS, RANK + MORE))
    product = np.zeros_like(basis)
    for _ in range(2):
        shared = spark.sparkContext.broadcast((weight, basis))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            weight, basis = shared.value
            total = np.zeros_like(basis)
            for batch in batches:
                _gram([np.frombuffer(t.as_buffer(), np.int64) & (TERMS - 1) for t in batch.column(0)], weight, basis, total)
            yield _sparse(_slices(total))

        product = np.zeros_like(basis)
        for k, x in _sum_slices(rows.select("terms").mapInArrow(run, "slice int, rows binary, sums binary"), basis.shape[1]).items():
            product[k * SLICE : (k + 1) * SLICE] = x
        basis, _ = np.linalg.qr(product)
    left, values, _ = np.linalg.svd(product, full_matrices=False)
    return left[:, : min(RANK, int((values > 1e-9 * max(values[0], 1e-300)).sum()) or 1)]


def windows_of(terms: np.ndarray, size: int, step: int = 1) -> np.ndarray:
    """The windows of a sequence, at every ``step``-th place and at its end."""
    if len(terms) < size:
        return np.zeros((0, size), terms.dtype)
    every = np.lib.stride_tricks.sliding_window_view(terms, size)
    last = len(every) - 1
    return every[np.unique(np.append(np.arange(0, last + 1, step), last))]


def project(windows: np.ndarray, weighted: np.ndarray) -> np.ndarray:
    """Latent vectors of windows of digests; the summands are whole numbers, so equal words give equal vectors in any order."""
    z = np.zeros((len(windows), weighted.shape[1]))
    for j in range(windows.shape[1]):
        z += weighted[windows[:, j] & (TERMS - 1)]
    return z


def signatures(z: np.ndarray, bits: int, tables: int, seed: int = 1) -> np.ndarray:
    """One number for each table: the signs of sums of the coordinates with random signs, exact in whole numbers."""
    planes = np.random.default_rng(seed).choice((-1.0, 1.0), (z.shape[1], bits * tables))
    signs = (z @ planes > 0).reshape(len(z), tables, bits)
    return (signs @ (1 << np.arange(bits, dtype=np.int64))) | (np.arange(tables, dtype=np.int64) << 32)


def _cut(batch: pa.RecordBatch, size: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of its row and the words of every window of the sequences in the second column."""
    parts = [windows_of(np.frombuffer(t.as_buffer(), np.int64), size, step) for t in batch.column(1)]
    return np.repeat(np.arange(len(parts)), [len(p) for p in parts]), np.concatenate(parts) if parts else np.zeros((0, size), np.int64)


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _signed(rows: DataFrame, key: str, shared, size: int, form: tuple[int, int]) -> DataFrame:
    """(signature, key, window): each window, by its digest, under each of its signatures."""
    bits, tables = form

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighted = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            of, windows = _cut(batch, size, 1)
            for at in range(0, len(windows), 20_000):
                part = windows[at : at + 20_000]
                signs = signatures(project(part, weighted), bits, tables)
                named = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in part], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(signs.T.ravel()), pa.array(np.tile(ids[of[at : at + 20_000]], tables)), pa.array(np.tile(named, tables))], names=["signature", key, "window"])

    return rows.select(key, "terms").mapInArrow(run, f"signature long, {key} long, window long")


def _answering(rows: DataFrame, key: str, shared, size: int, step: int, form: tuple[int, int], answers, rarity=None) -> DataFrame:
    """(signature, key, window, need): each window, by its words, under its signatures joined with an answer word.

    Of an item (``rarity`` is given) that is the window's rarest word, and ``need`` marks it and the numbers; of a document every word that is such a one for some item.
    """
    bits, tables = form

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighted = shared.value
        known = None if rarity else answers.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            of, windows = _cut(batch, size, step)
            figures = None
            if rarity:
                parts = [np.frombuffer(x.as_buffer(), np.uint8).astype(np.int64) for x in batch.column(2)]
                figures = np.concatenate([windows_of(p, size, step) for p in parts]) if parts else None
            for at in range(0, len(windows), 20_000):
                part = windows[at : at + 20_000]
                signs = signatures(project(part, weighted), bits, tables)
                if rarity:
                    rarest = np.argmax(rarity.value[part & (TERMS - 1)], axis=1)
                    row, column = np.arange(len(part)), rarest
                    need = (figures[at : at + 20_000] @ (1 << np.arange(size))) | (1 << rarest)
                else:
                    row, column = np.nonzero(in_bitmap(known, part))
                    need = np.zeros(len(part), np.int64)
                keys = (signs[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ part[row, column].view(np.uint64)[:, None]
                every = np.repeat(row, tables)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids[of[at : at + 20_000][every]]), _fixed(part.astype(np.int32)[every]), pa.array(need[every])], names=["signature", key, "window", "need"])

    columns = ["terms", "numbers"] if rarity else ["terms"]
    return rows.select(key, *columns).mapInArrow(run, f"signature long, {key} long, window binary, need long")


class Retrieval:
    """Items and the documents' passages of evaluation words in one latent space."""

    def __init__(self, documents: DataFrame, eval_items: DataFrame, least: int, gap: int = 0, basis=latent_space):
        spark = documents.sparkSession
        self.least = least
        self.items = written(item_terms(eval_items, least), "items")
        known = spark.sparkContext.broadcast(bitmap(_bits(self.items, lambda t: t)))
        found = written(passages(documents, known, least, gap), "passages")
        counts = _sum_slices(found.filter("slice IS NOT NULL"))
        self.passages = found.filter("terms IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "terms")
        total = float(counts.pop(-1, np.zeros((1, 1)))[0, 0])
        frequency = np.zeros(TERMS)
        for k, x in counts.items():
            frequency[k * SLICE : (k + 1) * SLICE] = x[:, 0]
        self.weight = np.log((1.0 + total) / (1.0 + frequency)) + 1.0
        space = basis(self.passages.select("terms").unionAll(self.items.select("terms")), self.weight)
        self.shared = spark.sparkContext.broadcast(np.rint(self.weight[:, None] * space * (1 << 20)))

    def equal(self) -> DataFrame:
        """(doc_id, item_id) of windows that share a signature and all words."""
        docs = _signed(self.passages, "doc_id", self.shared, self.least, EQUAL).withColumnRenamed("window", "d")
        items = _signed(self.items, "item_id", self.shared, self.least, EQUAL).withColumnRenamed("window", "i")
        return pair_join(docs, items, "signature").filter("d = i").select("doc_id", "item_id").distinct()

    def near(self, step: int = 4, form: tuple[int, int] = NEAR) -> DataFrame:
        """(doc_id, item_id, d, i, need): windows that share a signature and the rarest word of the item's, equal ones left out."""
        spark, size, weight = self.passages.sparkSession, self.least, self.weight
        rarest = lambda t: (w := windows_of(t, size))[np.arange(len(w)), np.argmax(weight[w & (TERMS - 1)], axis=1)]
        answers, rarity = spark.sparkContext.broadcast(bitmap(_bits(self.items, rarest))), spark.sparkContext.broadcast(weight)
        docs = _answering(self.passages, "doc_id", self.shared, size, step, form, answers).select("signature", "doc_id", F.col("window").alias("d"))
        items = _answering(self.items, "item_id", self.shared, size, 1, form, answers, rarity).select("signature", "item_id", F.col("window").alias("i"), "need")
        return pair_join(docs, items, "signature").filter("d <> i").select("doc_id", "item_id", "d", "i", "need")


def leaked(documents: DataFrame, eval_items: DataFrame, least: int = 12, basis=latent_space) -> DataFrame:
    """doc_id, item_id of each document that holds at least ``least`` consecutive words of the item."""
    return Retrieval(documents, eval_items, least, 0, basis).equal()


def paraphrased(documents: DataFrame, eval_items: DataFrame, least: int = 12, gap: int = 2, cosine: float = COSINE, share: float = SHARE, basis=latent_space) -> DataFrame:
    """doc_id, item_id, words: documents that hold a paraphrase of some ``least`` words of an item, and how many of these stand there in order.

    Up to ``gap`` other words may stand between two evaluation words. Pairs that ``leaked`` reports are left out.
    """
    found = Retrieval(documents, eval_items, least, gap, basis)
    shared = found.shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighted = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            d, i = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.int32).reshape(batch.num_rows, -1).astype(np.int64) for k in (2, 3))
            need = batch.column(4).to_numpy(zero_copy_only=False)
            needed = (need[:, None] >> np.arange(i.shape[1]) & 1).astype(bool)
            holds = (i[:, :, None] == d[:, None, :]).any(axis=2)  # which words of the item's window the document's has
            good = (holds | ~needed).all(axis=1) & (holds.sum(axis=1) >= share * i.shape[1])
            good = np.flatnonzero(good)
            a, b = project(d[good], weighted), project(i[good], weighted)
            cosines = np.einsum("ij,ij->i", a, b) / np.maximum(np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1), 1e-300)
            longest = np.zeros(batch.num_rows, np.int32)
            for k in good[cosines >= cosine].tolist():
                longest[k] = common_length(i[k].tolist(), d[k].tolist())
            hit = pa.array(np.flatnonzero(longest >= share * i.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(hit), batch.column(1).take(hit), pa.array(longest).take(hit)], names=["doc_id", "item_id", "words"])

    checked = found.near().mapInArrow(run, "doc_id long, item_id long, words int")
    return checked.groupBy("doc_id", "item_id").agg(F.max("words").alias("words")).join(found.equal(), ["doc_id", "item_id"], "left_anti")


def report(found: DataFrame, eval_items: DataFrame) -> DataFrame:
    """Per benchmark and split: items, leaked items and the documents that hold them."""
    per = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
    named = eval_items.select(F.col("item_id").cast("long").alias("item_id"), "benchmark", "split").join(per, "item_id", "left")
    return named.groupBy("benchmark", "split").agg(F.count(F.lit(1)).alias("items"), F.count("documents").alias("leaked_items"), F.coalesce(F.sum("documents"), F.lit(0)).cast("long").alias("holding_documents"))
