"""Texts of varying length into containers of fixed capacity: best-two-fit.

Sizes are token counts of a public tokenizer. Documents are dealt to groups of bounded
size by a hash, and each group is packed in one task: a container is filled greedily
with the largest document that fits, then its smallest document is exchanged for two
unpacked ones that together use the widened gap better. Containers left with much
space are emptied again and their documents packed once more in far fewer groups.
Available sizes are kept as the bits of one number, so a search is a mask and a shift.

Defined results: a document longer than a container gives full pieces and a remainder,
packed like a document; null and empty texts have no tokens and lie in a container all
the same; ties go to the smaller id; repeated texts are separate documents; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Where the vocabulary of the public byte-level tokenizer lies on every machine.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that belongs to that vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def encoding(path: str = TOKENIZER):
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, tokens: whole texts measured by the tokenizer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            sizes = [0 if t is None else len(encode(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "tokens"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, tokens long")


def best_two_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of places in ``sizes``; every size is at most ``capacity``."""
    shelf: dict[int, list[int]] = {}
    for i in range(len(sizes) - 1, -1, -1):  # the smallest place is taken first
        shelf.setdefault(sizes[i], []).append(i)
    free = 0
    for s in shelf:
        free |= 1 << s

    def largest(limit: int) -> int:
        return (free & ((1 << (limit + 1)) - 1)).bit_length() - 1

    def take(size: int) -> int:
        nonlocal free
        i = shelf[size].pop()
        if not shelf[size]:
            free &= ~(1 << size)
        return i

    def put(i: int) -> None:
        nonlocal free
        shelf.setdefault(sizes[i], []).append(i)
        free |= 1 << sizes[i]

    out = []
    while free:
        box, gap = [], capacity
        while free and (s := largest(gap)) >= 0:
            box.append(take(s))
            gap -= s
        small = min(box, key=lambda i: sizes[i])
        wide, best, pair = gap + sizes[small], sizes[small], None
        if gap and len(box) > 1:
            a = largest(wide)
            while a > 0 and 2 * a >= best and best < wide:
                b = largest(min(a, wide - a))
                if b == a and len(shelf[a]) < 2:
                    b = largest(a - 1)
                if b > 0 and a + b > best:
                    best, pair = a + b, (a, b)
                a = largest(a - 1)
        if pair:
            box.remove(small)
            box += [take(pair[0]), take(pair[1])]
            put(small)
        out.append(box)
    return out


def _packed(pieces: DataFrame, capacity: int, groups: int, level: int) -> DataFrame:
    """Pieces with their container; (level, group, number) make its id."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece"], ignore_index=True)
        box, fill = [""] * len(pdf), [0] * len(pdf)
        sizes = pdf["tokens"].tolist()
        name = f"{level}-{int(pdf['cell'].iloc[0])}"
        for k, members in enumerate(best_two_fit(sizes, capacity)):
            total = sum(sizes[i] for i in members)
            for i in members:
                box[i], fill[i] = f"{name}-{k}", total
        return pdf.drop(columns="cell").assign(container=box, fill=fill)

    cell = F.pmod(F.xxhash64("doc_id", "piece", F.lit(level)), F.lit(groups))
    return pieces.withColumn("cell", cell).groupBy("cell").applyInPandas(run, "doc_id long, piece long, tokens long, container string, fill long")


def pack(sizes: DataFrame, capacity: int = 2048, per_group: int = 20_000, well_filled: float = 0.99) -> DataFrame:
    """doc_id, piece, tokens, container of every document or, if it is too long, of its pieces."""
    sizes = written(sizes, "sizes")
    cap = F.lit(capacity)
    whole = F.floor(F.col("tokens") / cap)
    over = F.col("tokens") > cap
    full = sizes.filter(over).select("doc_id", F.posexplode(F.sequence(F.lit(1), whole.cast("int"))).alias("piece", "n"))
    full = full.select("doc_id", F.col("piece").cast("long").alias("piece"), cap.cast("long").alias("tokens"), F.concat_ws("-", F.lit("full"), "doc_id", "piece").alias("container"))
    rest = sizes.select("doc_id", F.when(over, whole).otherwise(F.lit(0)).cast("long").alias("piece"), F.when(over, F.col("tokens") - whole * cap).otherwise(F.col("tokens")).cast("long").alias("tokens"), over.alias("cut"))
    rest = rest.filter("NOT cut OR tokens > 0").drop("cut")
    groups = max(1, -(-sizes.count() // per_group))
    once = written(_packed(rest, capacity, groups, 0), "packed")
    keep, loose = once.filter(F.col("fill") >= well_filled * capacity), once.filter(F.col("fill") < well_filled * capacity)
    left = loose.count()
    again = _packed(loose.select("doc_id", "piece", "tokens"), capacity, max(1, -(-left // per_group)), 1) if groups > 1 else loose
    columns = ["doc_id", "piece", "tokens", "container"]
    return full.select(columns).unionAll(keep.select(columns)).unionAll(again.select(columns))


def containers(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """container, pieces, tokens, free: one row for each container."""
    boxes = packed.groupBy("container").agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("tokens"))
    return boxes.withColumn("free", F.lit(capacity) - F.col("tokens"))


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """containers, tokens and the share of space left over all containers."""
    boxes = packed.groupBy("container").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"))
    return boxes.agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.sum("pieces").alias("pieces"), F.round(1 - F.sum("tokens") / (F.count(F.lit(1)) * capacity), 6).alias("unused_share"))
