"""Splits that keep related records together.

Rows name items by their group key and by their source. An item is a vertex, a row
that names two items is an edge. Borůvka's method joins the vertices: in each round
every component takes its least outgoing edge (edges have a strict total order, so the
choices form trees), chosen edges go into the persisted spanning forest, components
are contracted to the root of their tree and parallel edges shrink to the least. The
number of components at least halves in a round, so there are few rounds; each ends
with a written table. Where many vertices share a hub or a root, its rows stay where
they are and meet a broadcast (``lookup_join``), so a component of any size is spread
over all tasks. Roots are then put into bands of size and dealt to the splits
by a low-discrepancy sequence within each band.

Defined results: an id that is null, blank or without a number names nothing, as does
one with a null dataset or subset; a row that names nothing is a group of its own;
repeated rows fall into one group; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import lookup_join
from ..session import written

SEP = "\u001f"
#: Outer blanks that do not count, Python's as well as the Unicode separators.
BLANK = r"[\s\u001c-\u001f\u0085\p{Z}]"


def item_key(dataset: Column, subset: Column, number: Column) -> Column:
    """The item that dataset, subset and the number in an id name, or null."""
    clean = lambda c: F.lower(F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", ""))
    digits = F.regexp_replace(F.regexp_extract(number, r"(\d+)", 1), r"^0+(?=\d)", "")
    named = (digits != "") & dataset.isNotNull() & subset.isNotNull() & (clean(subset) != "")
    return F.when(named, F.concat_ws(SEP, clean(dataset), clean(subset), digits))


def members(pool: DataFrame, examples: DataFrame) -> DataFrame:
    """(member_table, member_id, a, b): each row with the one or two different items it names; a is null if none."""
    source = item_key(F.col("source_dataset"), F.col("source_subset"), F.col("source_id"))
    group = item_key(F.col("group_key.dataset"), F.col("group_key.subset"), F.col("group_key.id"))
    p = pool.select(F.lit("pool_records").alias("member_table"), F.col("record_id").alias("member_id"), group.alias("g"), source.alias("s"))
    v = examples.select(F.lit("verifier_examples").alias("member_table"), F.col("example_id").alias("member_id"), F.lit(None).cast("string").alias("g"), source.alias("s"))
    return p.unionAll(v).select("member_table", "member_id", F.coalesce("g", "s").alias("a"), F.when(F.col("g") != F.col("s"), F.col("s")).alias("b"))


def spanning_forest(edges: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """Borůvka's contraction of ``edges`` (u, v).

    Returns the forest's edges (u, v), None if there are no edges, and (vertex, root)
    for every vertex that has an edge.
    """
    # Ties are broken by a hash, so that long chains are contracted at many places at once.
    live = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u <> v").distinct()
    live = written(live.select(F.xxhash64("u", "v").alias("w"), "u", "v", F.col("u").alias("cu"), F.col("v").alias("cv")), "edges")
    labels = live.select(F.explode(F.array("u", "v")).alias("vertex")).distinct().select("vertex", F.col("vertex").alias("root"))
    forest = None
    while not live.isEmpty():
        ends = live.select(F.explode(F.array(F.struct(F.col("cu").alias("c"), F.col("cv").alias("to")), F.struct(F.col("cv").alias("c"), F.col("cu").alias("to")))).alias("e"), "w", "u", "v")
        least = written(ends.groupBy(F.col("e.c").alias("c")).agg(F.min(F.struct("w", "u", "v", F.col("e.to").alias("to"))).alias("m")), "least")
        chosen = least.select("m.u", "m.v").distinct()
        forest = chosen if forest is None else forest.unionAll(chosen)
        # Two components that chose each other chose the same edge; the smaller name becomes the root.
        hook = least.select("c", F.col("m.to").alias("p"))
        back = hook.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        parent = written(lookup_join(hook, back, "p", "left").select("c", F.when((F.col("pp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p")), "hook")
        while True:  # pointer jumping: halves the depth of the trees
            up = parent.select(F.col("c").alias("p"), F.col("p").alias("pp"))
            jumped = written(lookup_join(parent, up, "p").select("c", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "jump")
            parent = jumped.select("c", "p")
            if jumped.filter("moved").isEmpty():
                break
        of = lambda name: parent.select(F.col("c").alias(name), F.col("p").alias(f"{name}_root"))
        labels = written(lookup_join(labels, of("root"), "root", "left").select("vertex", F.coalesce("root_root", "root").alias("root")), "labels")
        pairs = lookup_join(lookup_join(live, of("cu"), "cu"), of("cv"), "cv").filter("cu_root <> cv_root")
        pairs = pairs.select("w", "u", "v", F.least("cu_root", "cv_root").alias("cu"), F.greatest("cu_root", "cv_root").alias("cv"))
        live = written(pairs.groupBy("cu", "cv").agg(F.min(F.struct("w", "u", "v")).alias("m")).select("m.w", "m.u", "m.v", "cu", "cv"), "edges")
    return forest, labels


def tied(pool: DataFrame, examples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the item they name, and per item its root, the first pool record of all rows tied to it and their number."""
    rows = members(pool, examples)
    edges = rows.filter("b IS NOT NULL").select(F.col("a").alias("u"), F.col("b").alias("v"))
    _, labels = spanning_forest(edges)
    record = F.when(F.col("member_table") == "pool_records", F.col("member_id"))
    items = rows.filter("a IS NOT NULL").groupBy("a").agg(F.min(record).alias("first"), F.count(F.lit(1)).alias("n"))
    rooted = written(items.join(labels.withColumnRenamed("vertex", "a"), "a", "left"), "items")
    # Most items have no edge and are their own root; only the others need the way back from root to item.
    alone = rooted.filter("root IS NULL").select(F.col("a").alias("root"), F.col("first").alias("first_record_id"), "n")
    merged = rooted.filter("root IS NOT NULL").groupBy("root").agg(F.min("first").alias("first_record_id"), F.sum("n").alias("n"))
    back = lookup_join(labels, merged, "root").select(F.col("vertex").alias("a"), "root", "first_record_id", "n")
    return rows, alone.select(F.col("root").alias("a"), "root", "first_record_id", "n").unionAll(back)


def tied_members(pool: DataFrame, examples: DataFrame) -> DataFrame:
    """first_record_id, member_table, member_id of each row tied to a pool record other than itself."""
    rows, items = tied(pool, examples)
    shared = items.filter("n > 1 AND first_record_id IS NOT NULL").select("a", "first_record_id")
    named = rows.filter("a IS NOT NULL").select("a", "member_table", "member_id")
    found = lookup_join(named, shared, "a")
    return found.filter("NOT (member_table = 'pool_records' AND member_id = first_record_id)").select("first_record_id", "member_table", "member_id")


def assign_splits(pool: DataFrame, examples: DataFrame, shares: dict[str, float] | None = None, per_deal: int = 50_000) -> DataFrame:
    """member_table, member_id, group_root, split: all rows tied together get the same split.

    Roots are stratified by the power of two below their number of rows and, within a
    band, dealt in the order of a hash by the golden-ratio sequence, whose every run of
    roots meets the shares closely. A band of more than ``per_deal`` roots is dealt in
    several parts, so that no task holds more.
    """
    shares = shares or {"train": 0.8, "validation": 0.1, "test": 0.1}
    rows, items = tied(pool, examples)
    single = F.concat_ws(SEP, F.lit("row"), "member_table", F.col("member_id").cast("string"))
    roots = items.groupBy("root").agg(F.max("n").alias("n"))
    lone = rows.filter("a IS NULL").select(single.alias("root"), F.lit(1).cast("long").alias("n"))
    roots = written(roots.unionAll(lone).withColumn("band", F.floor(F.log2("n")).cast("int")), "roots")
    parts = roots.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / F.lit(per_deal)).alias("parts"))  # at most 64 bands
    cells = roots.join(F.broadcast(parts), "band").withColumn("part", F.pmod(F.xxhash64("root"), F.col("parts")))
    from pyspark.sql import Window

    deal = F.row_number().over(Window.partitionBy("band", "part").orderBy(F.desc("n"), F.xxhash64("root", F.lit(1)), "root"))
    point = F.pmod(deal * F.lit(0.6180339887498949) + F.col("band") * F.lit(0.37) + F.col("part") * F.lit(0.7548776662466927), F.lit(1.0))
    split, total = None, 0.0
    for name, share in shares.items():
        total += share / sum(shares.values())
        split = F.when(point < total, name) if split is None else split.when(point < total, name)
    dealt = cells.select("root", split.otherwise(list(shares)[-1]).alias("split"))
    named = lookup_join(rows.filter("a IS NOT NULL").select("a", "member_table", "member_id"), items.select("a", "root"), "a").select("member_table", "member_id", "root")
    every = named.unionAll(rows.filter("a IS NULL").select("member_table", "member_id", single.alias("root")))
    out = lookup_join(every, dealt, "root")
    return out.select("member_table", "member_id", F.col("root").alias("group_root"), "split")
