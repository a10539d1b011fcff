"""Records that differ only in formatting, collapsed by progressive refinement.

Three keys, each dearer than the one before, are applied only inside classes of the one
before that have several members:

1. a histogram of a few letters over the raw texts, which blanks, punctuation and case
   do not change (no other character turns into one of these letters in upper case);
2. the digest of the bare texts, letters and digits without case;
3. the canonical JSON.

Classes with several members are told to the next scan by a bitmap of fixed size: each
class sets one bit, a row goes on if its bit stands. A clash of two classes lets a row
go on in vain, never loses one, so the plan is the same at every size, no text is ever
shuffled, and only keys and ids are.

Defined results: null agrees with null only, an empty text with one of nothing but
punctuation; letters and digits alone count, so 1.5 agrees with 15; JSON that does not
parse agrees by its text; the smallest record_id of a group is kept; rows without a
copy are their own group; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import lookup_join
from ..session import written

#: Bits of the bitmap of shared classes: 8 MB, whatever the number of classes.
BITS = 1 << 26
#: Letters of the histogram; none stems from another character in upper case.
COUNTED = "EOC"


def bare(text: Column) -> Column:
    """Letters and digits only, without case: in upper case, which also joins such as ß and SS."""
    return F.upper(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


def canonical_json(text: Column) -> Column:
    """JSON with sorted field names and no blanks; null stays null, what is no JSON stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def invariant(texts: list[Column]) -> Column:
    """A number that is the same for any two copies: letter counts of the raw texts, which formatting does not change."""
    without = lambda t, c: F.length(F.replace(t, F.lit(c), F.lit("")))
    counts = [F.coalesce(2 * F.length(t) - without(t, c) - without(t, c.lower()), F.lit(-1)) for t in texts for c in COUNTED]
    return F.xxhash64(*counts)


def shared_bits(keyed: DataFrame, key: str) -> DataFrame:
    """(bucket, bits): the bitmap of all 64-bit keys that several rows have; at most BITS / 32768 rows of 4 KB."""
    shared = keyed.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.pmod(key, F.lit(BITS)).alias("bit"))
    return shared.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))


def in_shared(rows: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """Rows whose key may be shared: those whose bit is set."""
    bit = F.pmod(F.col(key), F.lit(BITS))
    met = rows.join(F.broadcast(bits), F.bitmap_bucket_number(bit) == F.col("bucket"))  # bounded by BITS
    place = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return met.filter(F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1).select(*rows.columns)


def groups(records: DataFrame, id_column: str, texts: list[str], json_columns: list[str]) -> DataFrame:
    """member id, kept_id, copies of every row that has at least one copy."""
    own = [F.col(t) for t in texts]
    first = records.select(invariant(own).alias("_class"))
    classed = records.select(F.col(id_column).alias("_member"), *texts, *json_columns, invariant(own).alias("_class"))
    digest = F.unhex(F.sha2(F.to_json(F.struct(*[bare(c).alias(f"t{k}") for k, c in enumerate(own)])), 256))
    alike = in_shared(classed, "_class", written(shared_bits(first, "_class"), "bits"))
    second = written(alike.select("_member", digest.alias("_text"), *json_columns).withColumn("_class", F.xxhash64("_text")), "texts")
    left = in_shared(second, "_class", written(shared_bits(second, "_class"), "bits"))
    full = F.unhex(F.sha2(F.to_json(F.struct("_text", *[canonical_json(F.col(j)).alias(f"j{k}") for k, j in enumerate(json_columns)])), 256))
    keyed = written(left.select(F.col("_member").alias("member_id"), full.alias("key")), "keys")
    kept = keyed.groupBy("key").agg(F.min("member_id").alias("kept_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return lookup_join(keyed, kept, "key").select("member_id", "kept_id", "copies")


def surplus(records: DataFrame, id_column: str, texts: list[str], json_columns: list[str]) -> DataFrame:
    """kept_id, copy_id of each surplus row."""
    found = groups(records, id_column, texts, json_columns)
    return found.filter("member_id <> kept_id").select("kept_id", F.col("member_id").alias("copy_id"))


def collapsed(records: DataFrame, id_column: str, texts: list[str], json_columns: list[str]) -> DataFrame:
    """One row for each group: the kept id and the number of its copies, 1 where there is no other."""
    found = groups(records, id_column, texts, json_columns)
    heads = found.filter("member_id = kept_id").select(F.col("kept_id").alias("_kept"), "copies")
    drop = found.filter("member_id <> kept_id").select(F.col("member_id").alias("_kept"))
    ids = records.select(F.col(id_column).alias("_kept"))
    return ids.join(drop, "_kept", "left_anti").join(heads, "_kept", "left").select(F.col("_kept").alias("kept_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))
