"""The same or almost the same record in training and evaluation data.

Records are brought to canonical words (no case, punctuation or odd blanks) and hashed;
evaluation and training hashes are joined for exact overlaps. For near ones, distinct
word sequences are joined on their rarest words: if four fifths of the words of the
longer of two texts stand in the other, the two share at least one of the first
n - ceil(0.8 n) + 1 words in any fixed order of words. Frequent words (a bounded list,
counted over all texts) come last in that order, so no join key is frequent unless a
text has nothing else. Length and a 128-bit word signature discard all but a few pairs,
and the longest common subsequence of words decides. What comes out are links between
different texts, with the records that hold each text beside them, so copies are never
expanded into pairs unless a caller wants them (``found``), and then over a grid of
cells. No pair is lost to a cap.

Defined results: null texts and texts without a letter or digit overlap with nothing;
a response with several rows counts once; repeated rows each count as records; texts
are compared whole; rows of a split that is neither training nor evaluation (by default
train, and dev or test, without regard to case and outer blanks), null included, stand
on neither side; an empty side gives no rows; ids are those of the tables' contract, one
text each; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import lookup_join, pair_join
from ..session import written

#: A word is frequent from 1/FREQUENT of all words on, so there are at most FREQUENT frequent words to broadcast.
FREQUENT = 200_000


def canonical_words(text: Column) -> Column:
    """Lower-case words (letters, digits and their marks) with one blank between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\p{M}]+", " "))


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bits."""
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & where.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def records(pool: DataFrame, responses: DataFrame, training: tuple[str, ...] = ("train",), evaluation: tuple[str, ...] = ("dev", "test")) -> DataFrame:
    """(train, kind, id, words): training rows, and evaluation rows and responses to hold against them."""
    split = F.lower(F.trim("split"))
    p = pool.filter(split.isin(*training, *evaluation)).select(split.isin(*training).alias("train"), F.lit("pool_records").alias("kind"), F.col("record_id").cast("string").alias("id"), canonical_words(F.col("hypothesis")).alias("words"))
    r = responses.select(F.lit(False).alias("train"), F.lit("rag_error_analysis").alias("kind"), F.col("response_id").alias("id"), canonical_words(F.col("answer_preview")).alias("words"))
    return p.unionAll(r.filter("id IS NOT NULL").distinct()).filter("words <> ''")


def _prefixes(forms: DataFrame, share: float) -> DataFrame:
    """(word, train, form, n, lo, hi): the rarest words of each distinct text, and its signature."""
    words = forms.select(F.explode(F.split("words", " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counted = written(words.filter("n > 3"), "words")
    total = forms.agg(F.sum(F.size(F.split("words", " "))).alias("n")).first()["n"] or 0
    frequent = {r["word"]: r["n"] for r in counted.filter(F.col("n") >= max(4, total / FREQUENT)).collect()}
    shared = forms.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, known = shared.value, {}
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for train, form, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                tokens = text.split(" ")
                n, seen, keys, signature = len(tokens), {}, [], 0
                for t in tokens:
                    k = seen[t] = seen.get(t, -1) + 1
                    h = known.get((t, k))
                    if h is None:
                        if len(known) > 1_000_000:
                            known.clear()
                        h = known[t, k] = xxhash.xxh64_intdigest(t, seed=k) - (1 << 63)
                    keys.append((often.get(t, 0), h))
                    if k == 0:
                        signature |= 1 << (h & 127)
                keys.sort()
                lo, hi = signature & (1 << 64) - 1, signature >> 64
                for _, h in keys[: n - ceil(share * n - 1e-9) + 1]:
                    for column, value in zip(out, (h, train, form, n, lo - (1 << 64) if lo >> 63 else lo, hi - (1 << 64) if hi >> 63 else hi)):
                        column.append(value)
            kinds = (pa.int64(), pa.bool_(), pa.binary(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["word", "train", "form", "n", "lo", "hi"])

    return forms.select("train", "form", "words").mapInArrow(run, "word long, train boolean, form binary, n int, lo long, hi long")


def _near(pairs: DataFrame, share: float) -> DataFrame:
    """Of (t_form, e_form, t_words, e_words) the pairs whose words agree in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = []
            for i, (a, b) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                a, b = a.split(" "), b.split(" ")
                least = ceil(share * max(len(a), len(b)) - 1e-9)
                if sum((Counter(a) & Counter(b)).values()) >= least and common_length(a, b) >= least:
                    hit.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(hit, pa.int64())) for k in (0, 1)], names=["t_form", "e_form"])

    return pairs.mapInArrow(run, "t_form binary, e_form binary")


def links(rows: DataFrame, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Links (t_form, e_form, exact) between training and evaluation texts, and the membership (train, kind, id, form) of the records."""
    digest = lambda c: F.unhex(F.md5(c.cast("binary")))
    keyed = rows.select("train", "kind", "id", digest(F.col("words")).alias("form"), digest(F.replace(F.col("words"), F.lit(" "), F.lit(""))).alias("class"), "words")
    forms = written(keyed.select("train", "form", "class", "words").distinct(), "forms")
    members = written(keyed.select("train", "kind", "id", "form").distinct(), "members")
    # Texts are equal but for blanks if their letters are; of one class there are few different forms.
    named = lambda train, p: forms.filter(F.col("train") == train).select(F.col("form").alias(f"{p}_form"), "class")
    exact = named(True, "t").join(named(False, "e"), "class").select("t_form", "e_form", F.lit(True).alias("exact"))

    prefix = written(_prefixes(forms, share), "prefixes")
    side = lambda train, p: prefix.filter(F.col("train") == train).select("word", *[F.col(c).alias(f"{p}_{c}") for c in ("form", "n", "lo", "hi")])
    least = F.ceil(F.greatest("t_n", "e_n") * F.lit(share) - F.lit(1e-9))
    alone = lambda a, b: F.bit_count(F.col(f"{a}_lo").bitwiseAND(F.bitwise_not(f"{b}_lo"))) + F.bit_count(F.col(f"{a}_hi").bitwiseAND(F.bitwise_not(f"{b}_hi")))
    fits = (F.least("t_n", "e_n") >= least) & (alone("t", "e") <= F.col("t_n") - least) & (alone("e", "t") <= F.col("e_n") - least) & (F.col("t_form") != F.col("e_form"))
    pairs = written(pair_join(side(True, "t"), side(False, "e"), "word").filter(fits).select("t_form", "e_form").distinct(), "pairs")
    text = lambda train, p: forms.filter(F.col("train") == train).select(F.col("form").alias(f"{p}_form"), F.col("words").alias(f"{p}_words"), F.col("class").alias(f"{p}_class"))
    full = lookup_join(lookup_join(pairs, text(True, "t"), "t_form"), text(False, "e"), "e_form").filter("t_class <> e_class")
    near = _near(full.select("t_form", "e_form", "t_words", "e_words"), share).select("t_form", "e_form", F.lit(False).alias("exact"))
    return written(exact.unionAll(near), "links"), members


def overlaps(rows: DataFrame, share: float = 0.8) -> DataFrame:
    """(train_id, kind, id) of every pair of a train row and a row to hold against it, exact or near."""
    found, members = links(rows, share)
    left = members.filter("train").select(F.col("id").cast("long").alias("train_id"), F.col("form").alias("t_form"))
    right = members.filter("NOT train").select("kind", "id", F.col("form").alias("e_form"))
    # The record sides of a link meet over a grid; links of one evaluation text come first, as there are fewer of those.
    linked = pair_join(found.select("t_form", "e_form"), right, "e_form").select("t_form", "kind", "id")
    return pair_join(left, linked, "t_form").select("train_id", "kind", "id")


def found(pool: DataFrame, responses: DataFrame) -> DataFrame:
    return overlaps(records(pool, responses)).select("train_id", F.col("kind").alias("eval_table"), F.col("id").alias("eval_id"))


def link_table(pool: DataFrame, responses: DataFrame) -> DataFrame:
    """t_form, e_form, exact, n_train, n_eval: linked texts by digest, with the number of records that hold them."""
    linked, members = links(records(pool, responses))
    count = lambda train, key, name: members.filter(F.col("train") == train).groupBy(F.col("form").alias(key)).agg(F.count(F.lit(1)).alias(name))
    one = lookup_join(linked, count(True, "t_form", "n_train"), "t_form")
    both = lookup_join(one, count(False, "e_form", "n_eval"), "e_form")
    return both.select(F.hex("t_form").alias("t_form"), F.hex("e_form").alias("e_form"), "exact", "n_train", "n_eval")


def membership(pool: DataFrame, responses: DataFrame) -> DataFrame:
    """train, table_name, id, form: the text that each record holds."""
    rows = records(pool, responses)
    return rows.select("train", F.col("kind").alias("table_name"), "id", F.upper(F.md5(F.col("words").cast("binary"))).alias("form"))


def report(pool: DataFrame, responses: DataFrame) -> DataFrame:
    """Overlaps counted per evaluation table, split and source, from links and membership alone: no pair of records is made."""
    linked, members = links(records(pool, responses))
    held = members.filter("train").groupBy(F.col("form").alias("t_form")).agg(F.count(F.lit(1)).alias("n"))
    per_text = lookup_join(linked.select("t_form", "e_form"), held, "t_form").groupBy(F.col("e_form").alias("form")).agg(F.sum("n").alias("n"))
    per = lookup_join(members.filter("NOT train").select(F.col("kind").alias("eval_table"), F.col("id").alias("eval_id"), "form"), per_text, "form").groupBy("eval_table", "eval_id").agg(F.sum("n").alias("n"))
    own = pool.select(F.lit("pool_records").alias("eval_table"), F.col("record_id").cast("string").alias("eval_id"), F.lower(F.trim("split")).alias("split"), F.concat_ws("/", F.lower(F.trim("source_dataset")), F.lower(F.trim("source_subset"))).alias("source"))
    other = responses.groupBy("response_id").agg(F.min("task_type").alias("source"))
    other = other.select(F.lit("rag_error_analysis").alias("eval_table"), F.col("response_id").alias("eval_id"), F.lit("response").alias("split"), "source")
    return per.join(own.unionAll(other), ["eval_table", "eval_id"]).groupBy("eval_table", "split", "source").agg(F.count(F.lit(1)).alias("leaked_records"), F.sum("n").alias("pairs"))
