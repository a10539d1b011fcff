"""Claims with nested evidence sets, and their resolution against the page index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, unicode_form
from ..session import written
from .skew import lookup_join

REFERENCES = "array<array<struct<wiki_url: string, sentence_id: bigint>>>"


def evidence_references(claims: DataFrame, key: str, references: str) -> DataFrame:
    """(key, set_pos, ref_pos, page_id, sentence_id): one row for each reference of each evidence set; empty sets have none."""
    parsed = claims.select(key, F.from_json(references, REFERENCES).alias("sets")).filter("sets IS NOT NULL")
    sets = parsed.select(key, F.posexplode("sets").alias("set_pos", "refs"))
    refs = sets.select(key, "set_pos", F.posexplode("refs").alias("ref_pos", "r"))
    return refs.select(key, F.col("set_pos").cast("long").alias("set_pos"), F.col("ref_pos").cast("long").alias("ref_pos"), F.col("r.wiki_url").alias("page_id"), F.col("r.sentence_id").alias("sentence_id"))


def has_evidence(url: Column) -> Column:
    return url.isNotNull() & (url != "")


#: The sentence number that cites a page as a whole.
WHOLE_PAGE = -1


def resolve_pages(asked: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, found_page) of each asked page that exists, as it stands or else in composed form (NFC)."""
    asked = asked.select("page_id").filter(has_evidence(F.col("page_id"))).distinct()
    exact = asked.join(pages, "page_id", "left_semi").select("page_id", F.col("page_id").alias("found_page"))
    rest = asked.join(pages, "page_id", "left_anti").filter(~F.col("page_id").rlike(r"^[\x00-\x7f]*$"))
    composed = rest.withColumn("found_page", unicode_form(F.col("page_id"))).filter("found_page <> page_id")
    return exact.unionByName(composed.join(pages.select(F.col("page_id").alias("found_page")), "found_page", "left_semi").select("page_id", "found_page"))


class Pages:
    """Where references are looked up: sentences by page and number, whole pages by the text of the first document with their id.

    ``index`` has, for each place, the row that holds its text and whether that is blank (the first delivered row wins);
    ``texts`` has the texts by row. Only the texts that are asked for by row ever move.
    """

    def __init__(self, sentences: DataFrame, documents: DataFrame):
        named = sentences.filter("page_id IS NOT NULL AND sentence_id IS NOT NULL")
        paged = documents.filter("page_id IS NOT NULL")
        self.names = sentences.select("page_id").unionAll(paged.select("page_id")).filter("page_id IS NOT NULL").distinct()
        row = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))

        def places(df: DataFrame, number: Column, key: str, kind: str) -> DataFrame:
            first = df.groupBy(_place(F.col("page_id"), number).alias("_at")).agg(F.min_by(F.struct(row(kind, key).alias("_row"), is_blank(F.col("text")).alias("_blank")), F.col(key)).alias("r"))
            return first.select("_at", "r.*")

        self.index = places(named, F.col("sentence_id"), "row_id", "s").unionAll(places(paged, F.lit(WHOLE_PAGE), "doc_id", "d"))
        self.texts = named.select(row("s", "row_id").alias("_row"), "text").unionAll(paged.select(row("d", "doc_id").alias("_row"), "text"))


def _place(page: Column, number: Column) -> Column:
    return F.concat(number.cast("string"), F.lit(" "), page)


def resolve_sentences(references: DataFrame, pages: Pages) -> DataFrame:
    """Each reference with ``_row``, which holds its text, and ``status``: resolved, missing_page, missing_sentence_id or empty_resolved_text.

    Only keys and whether a text is blank are joined; no text moves.
    """
    references = written(references, "references")
    found = lookup_join(references, resolve_pages(references, pages.names), "page_id", "left")
    placed = found.withColumn("_at", _place(F.col("found_page"), F.col("sentence_id")))
    joined = lookup_join(placed, pages.index, "_at", "left")
    absent = F.when(F.col("sentence_id") == WHOLE_PAGE, "empty_resolved_text").otherwise("missing_sentence_id")
    status = F.when(F.col("found_page").isNull(), "missing_page").when(F.col("_blank").isNull(), absent).when(F.col("_blank"), "empty_resolved_text").otherwise("resolved")
    return joined.withColumn("status", status).select(*references.columns, "_row", "status")


def first_resolved_set(resolved: DataFrame, pages: Pages, key: str) -> DataFrame:
    """(key, set_pos, n_refs, premise): of each claim the first evidence set all of whose references resolve; texts are fetched for these sets only."""
    resolved = written(resolved, "resolved")
    by_set = resolved.groupBy(key, "set_pos").agg(F.bool_and(F.col("status") == "resolved").alias("whole"), F.count(F.lit(1)).alias("n_refs"))
    chosen = by_set.filter("whole").groupBy(key).agg(F.min(F.struct("set_pos", "n_refs")).alias("s")).select(key, "s.*")
    cited = resolved.select(key, "set_pos", "ref_pos", "_row").join(chosen, [key, "set_pos"])
    with_text = lookup_join(cited, pages.texts, "_row")
    # A set is an element of one record's own list, so what is collected is bounded by that record.
    premise = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ref_pos", "text"))), lambda r: r["text"]), " ")
    return with_text.groupBy(key, "set_pos", "n_refs").agg(premise.alias("premise"))


# Labels that evidence can resolve, the label without evidence, and the outcomes of a resolution.
RESOLVABLE = ("SUPPORTS", "REFUTES")
NOT_ENOUGH = "NOT ENOUGH INFO"
# End of fixed values.


def resolution_status(label: Column, chosen: Column) -> Column:
    """no_evidence_annotation, unknown_label, resolved or unresolved."""
    return F.when(label == NOT_ENOUGH, "no_evidence_annotation").when(~F.coalesce(label.isin(*RESOLVABLE), F.lit(False)), "unknown_label").when(chosen.isNotNull(), "resolved").otherwise("unresolved")


def pair_expansion(df: DataFrame, keys: list[str], left: tuple[str, str], right: tuple[str, str], tag: str, value: str) -> DataFrame:
    """Two rows of each: (tag, value) of the left and of the right column."""
    both = F.array(*[F.struct(F.lit(name).alias(tag), F.col(column).alias(value)) for name, column in (left, right)])
    return df.select(*keys, F.inline(both))


# Where the answers of each subset stand in its raw records.
PAIR_SUBSETS = {
    "qa": {"context": ("knowledge",), "query": "question", "right": "right_answer", "hallucinated": "hallucinated_answer"},
    "dialogue": {"context": ("knowledge", "dialogue_history"), "query": None, "right": "right_response", "hallucinated": "hallucinated_response"},
    "summarization": {"context": ("document",), "query": None, "right": "right_summary", "hallucinated": "hallucinated_summary"},
}
GENERAL = "general"
# End of fixed values.


class UnknownSubset(ValueError):
    """No such subset."""


def positional_index(df: DataFrame) -> DataFrame:
    """Adds ``raw_index``: a row's place over all files in the order of their paths, from 0; ``df`` must come straight from a Parquet scan.

    Places within a file come with the scan; only the number of rows of each file is summed up before it.
    """
    placed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = placed.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_file", (F.sum("_n").over(Window.orderBy("_file")) - F.col("_n")).alias("_before"))  # one row a file
    return placed.join(before, "_file").withColumn("raw_index", F.col("_row") + F.col("_before")).drop("_file", "_row", "_before")


def joined_context(fields: list[Column]) -> Column:
    """The context fields that hold anything, with a blank between them."""
    return F.concat_ws(" ", *[F.nullif(F.coalesce(f, F.lit("")), F.lit("")) for f in fields])


PAIR_COLUMNS = ["example_id", "subset", "context", "query", "candidate_response", "label", "source_field", "spans", "raw_id", "raw_index"]


def expand_subset(raw: DataFrame, subset: str) -> DataFrame:
    """The labelled answers of one subset's raw records, which must have ``raw_index``; raises for a subset that does not exist.

    A record of a pair subset gives two: its right answer and its hallucinated one. A record of the general subset has one
    answer and its own label, yes or no.
    """
    place = F.col("raw_index").cast("string")
    none = F.lit(None).cast("string")
    if subset == GENERAL:
        said = F.lower(F.trim(F.coalesce("hallucination", F.lit(""))))
        label = F.when(said == "yes", "hallucinated").when(said == "no", "not_hallucinated")
        return raw.select(F.concat(F.lit("general_"), place).alias("example_id"), F.lit(GENERAL).alias("subset"), F.lit("").alias("context"), F.col("user_query").alias("query"), F.coalesce("chatgpt_response", F.lit("")).alias("candidate_response"), label.alias("label"), F.lit("chatgpt_response").alias("source_field"), F.col("hallucination_spans").alias("spans"), F.col("ID").alias("raw_id"), "raw_index")
    if subset not in PAIR_SUBSETS:
        raise UnknownSubset(f"{subset!r} is none of {', '.join(sorted([*PAIR_SUBSETS, GENERAL]))}")
    spec = PAIR_SUBSETS[subset]
    query = F.col(spec["query"]) if spec["query"] else none
    answer = lambda field, label: F.struct(F.coalesce(field, F.lit("")).alias("candidate_response"), F.lit(label).alias("label"), F.lit(field).alias("source_field"))
    both = F.array(answer(spec["right"], "not_hallucinated"), answer(spec["hallucinated"], "hallucinated"))
    rows = raw.select("raw_index", joined_context([F.col(c) for c in spec["context"]]).alias("context"), query.alias("query"), F.inline(both))
    return rows.select(F.concat_ws("_", F.lit(subset), place, "label").alias("example_id"), F.lit(subset).alias("subset"), "context", "query", "candidate_response", "label", "source_field", none.alias("spans"), none.alias("raw_id"), "raw_index")


def expand_all(raw: dict[str, DataFrame]) -> DataFrame:
    """The labelled answers of all given subsets."""
    out = None
    for subset, records in raw.items():
        rows = expand_subset(records, subset).select(*PAIR_COLUMNS)
        out = rows if out is None else out.unionByName(rows)
    return out


def pool_of_pairs(pairs: DataFrame) -> DataFrame:
    """Pool records of labelled answers: their label as an inference label, their context as the premise."""
    label = F.when(F.col("label") == "not_hallucinated", "entailment").when(F.col("label") == "hallucinated", "contradiction")
    return pairs.filter(F.col("subset") != GENERAL).select(F.col("candidate_response").alias("hypothesis"), label.alias("label"), F.col("label").alias("original_label"), F.lit("halueval").alias("source_dataset"), F.col("subset").alias("source_subset"), F.col("example_id").alias("source_id"), F.col("context").alias("premise_text"), F.lit(True).alias("premise_text_available"), "raw_index")
