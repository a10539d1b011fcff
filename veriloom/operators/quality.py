"""Row checks that give issue codes, and profiles of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank


def issues(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row (keys, issue) for each rule that a row breaks; a rule that is null holds."""
    codes = F.array_compact(F.array(*[F.when(broken, F.lit(code)) for code, broken in rules.items()]))
    return df.select(*keys, F.explode(codes).alias("issue"))


def checks(rows: list[tuple[str, DataFrame]]) -> DataFrame:
    """(check_name, violations, status) from frames with one count column ``violations``."""
    out = None
    for name, df in rows:
        one = df.select(F.lit(name).alias("check_name"), F.col("violations").cast("long").alias("violations"))
        out = one if out is None else out.unionAll(one)
    return out.withColumn("status", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL"))


def violations(df: DataFrame, broken: Column) -> DataFrame:
    return df.agg(F.count_if(broken).alias("violations"))


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n_null, n_blank, n_distinct) of each column, all from one pass."""
    measures = []
    for c in columns:
        text = F.col(c).cast("string")
        measures.append(F.struct(F.lit(c).alias("column_name"), F.count_if(text.isNull()).alias("n_null"), F.count_if(text.isNotNull() & is_blank(text)).alias("n_blank"), F.count_distinct(text).alias("n_distinct")))
    return df.agg(F.array(*measures).alias("m")).select(F.inline("m"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def fan_out(df: DataFrame, key: str) -> DataFrame:
    """How many keys have how many rows."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows_per_key")).groupBy("rows_per_key").agg(F.count(F.lit(1)).alias("n_keys"))


def key_overlap(left: DataFrame, columns: list[str], right: DataFrame, key: str) -> DataFrame:
    """For each candidate link column: its distinct values and how many of them are keys on the other side."""
    keys = right.select(F.col(key).cast("string").alias("v")).filter("v IS NOT NULL").distinct().withColumn("hit", F.lit(1))
    values = left.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns])).alias("e")).select("e.*").filter("v IS NOT NULL").distinct()
    out = values.join(keys, "v", "left").groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"), F.count("hit").alias("n_found"))
    return out.withColumn("share", F.round(F.col("n_found") / F.col("n_distinct"), 6))


def sequence_profile(df: DataFrame, group: str, number: str, order: str, text: str) -> DataFrame:
    """Per group: sentences, first and last number, jumps in the numbering (which should begin at 0) and blank texts; of equal numbers the first row counts.

    A number jumps if its predecessor is missing. That is looked up by group and number
    together, so a group that holds many rows is spread over all tasks.
    """
    first = df.groupBy(F.col(group).alias("g"), F.col(number).alias("i")).agg(F.min_by(F.struct(text), F.col(order)).alias("r"))
    before = first.select(F.col("g").alias("_g"), (F.col("i") + 1).alias("_i"))
    rows = first.join(before, F.col("g").eqNullSafe(F.col("_g")) & (F.col("i") == F.col("_i")), "left")
    per = rows.groupBy(F.col("g").alias(group)).agg(F.count(F.lit(1)).alias("n_sentences"), F.min("i").alias("first_sid"), F.max("i").alias("last_sid"), F.count_if(F.col("_i").isNull()).alias("_gaps"), F.count_if(is_blank(F.col(f"r.{text}"))).alias("n_blank"))
    return per.select(group, "n_sentences", "first_sid", "last_sid", (F.col("_gaps") - F.when(F.col("first_sid") == 0, 1).otherwise(0)).alias("n_jumps"), "n_blank")


def span_statuses(text: Column, spans: Column) -> Column:
    """The outcome of each span (start, end, text) of an array against its text, in order.

    match, offset_text_mismatch, offset_out_of_bounds, offset_not_int, label_not_a_dict, or no_label_text, which is
    no issue. Offsets count characters.
    """

    def status(e: Column) -> Column:
        start, end, label = e["start"], e["end"], e["text"]
        cut = F.substring(text, start.cast("int") + 1, (end - start).cast("int"))
        return (
            F.when(e.isNull(), "label_not_a_dict")
            .when(start.isNull() | end.isNull(), "offset_not_int")
            .when((start < 0) | (end > F.length(text)) | (start > end), "offset_out_of_bounds")
            .when(label.isNull(), "no_label_text")
            .when(cut == label, "match")
            .otherwise("offset_text_mismatch")
        )

    return F.transform(spans, status)


def json_spans(spans: Column) -> Column:
    """JSON text as an array of spans, or null if it is no array: an element that is no object is null, as is an offset of another type than an integer.

    true and false pass as 1 and 0; integers beyond 64 bits are kept as decimals, as 1.0 is, so only long ones of
    those count as whole. A text of another type matches nothing.
    """
    field = lambda e, name, kind="variant": F.try_variant_get(e, f"$.{name}", kind)

    def offset(e: Column, name: str) -> Column:
        return F.when(F.schema_of_variant(field(e, name)).rlike(r"^(BIGINT|BOOLEAN|DECIMAL\((19|[23]\d),0\))$"), field(e, name, "decimal(38,0)"))

    def label(e: Column) -> Column:
        kind = F.schema_of_variant(field(e, "text"))
        return F.when(kind == "STRING", field(e, "text", "string")).when(kind != "VOID", "\0")

    struct = lambda e: F.struct(offset(e, "start").alias("start"), offset(e, "end").alias("end"), label(e).alias("text"))
    return F.transform(F.try_variant_get(F.try_parse_json(spans), "$", "array<variant>"), lambda e: F.when(F.schema_of_variant(e).startswith("OBJECT"), struct(e)))


def span_issues(df: DataFrame, keys: list[str], text: str, spans: str, rules: dict[str, Column] | None = None) -> DataFrame:
    """(keys, span_no, issue): each broken rule and text without number, each faulty span with its place.

    spans: JSON text or an array of structs. A null holds no spans; without a text no span is looked at.
    """
    body = F.col(text)
    array = json_spans(F.col(spans)) if df.schema[spans].dataType.simpleString() == "string" else F.col(spans)
    rules = {"empty_text": F.coalesce(body == "", F.lit(True)), "text_not_a_string": body.isNull(), "labels_not_a_list": F.col(spans).isNotNull() & array.isNull()} | (rules or {})
    none = F.lit(None).cast("int")
    own = F.array_compact(F.array(*[F.when(broken, F.struct(none.alias("span_no"), F.lit(code).alias("issue"))) for code, broken in rules.items()]))
    each = F.transform(F.when(body.isNotNull(), span_statuses(body, array)), lambda s, i: F.struct(i.alias("span_no"), s.alias("issue")))
    faulty = F.filter(each, lambda e: ~e["issue"].isin("match", "no_label_text"))
    return df.select(*keys, F.inline(F.concat(own, F.coalesce(faulty, F.array().cast("array<struct<span_no:int,issue:string>>")))))


def code_with_value(code: str, value: Column) -> Column:
    """An issue code with the offending value as a literal: code:'value', or code:None."""
    return F.concat(F.lit(f"{code}:"), F.coalesce(F.concat(F.lit("'"), value, F.lit("'")), F.lit("None")))


def coded_issues(df: DataFrame, keys: list[str], rules: dict[str, tuple[Column, Column | None]]) -> DataFrame:
    """One row (keys, issue) for each broken rule; a rule with a value column names that value in its code."""
    codes = [F.when(F.coalesce(broken, F.lit(False)), F.lit(code) if value is None else code_with_value(code, value)) for code, (broken, value) in rules.items()]
    return df.select(*keys, F.explode(F.array_compact(F.array(*codes))).alias("issue"))


# What responses and questions may be.
SPLITS = ("train", "test")
TASKS = ("Summary", "Data2txt", "QA")
QUALITIES = ("good", "truncated", "incorrect_refusal")
PAIR_LABELS = ("hallucinated", "not_hallucinated")
SUSPICIOUS_IDS = ("", "ID")
# End of fixed values.


def unknown(value: Column, known: tuple[str, ...], null_is_known: bool = False) -> Column:
    return F.coalesce(~value.isin(*known), F.lit(not null_is_known))


def response_rules(text: Column, split: Column, source_missing: Column, task: Column, quality: Column) -> dict[str, tuple[Column, Column | None]]:
    """The rules of a response apart from its spans."""
    return {
        "empty_or_missing_response_text": (F.coalesce(text == "", F.lit(True)), None), "invalid_split": (unknown(split, SPLITS), split), "source_missing": (source_missing, None),
        "unexpected_task_type": (unknown(task, TASKS, True), task), "unexpected_quality": (unknown(quality, QUALITIES, True), quality),
    }


def pair_rules(text: Column, label: Column, subset: Column, context: Column, spans: Column, raw_id: Column) -> dict[str, tuple[Column, Column | None]]:
    """The rules of a labelled answer; ``context`` is its joined context, ``spans`` JSON text."""
    parsed = F.try_parse_json(spans)
    is_list = F.schema_of_variant(parsed).startswith("ARRAY")
    none = F.size(F.try_variant_get(parsed, "$", "array<variant>")) == 0
    general = subset == "general"
    return {
        "empty_or_missing_candidate_response": (F.coalesce(text == "", F.lit(True)), None), "invalid_label": (unknown(label, PAIR_LABELS), label), "missing_context": (~general & (F.coalesce(context, F.lit("")) == ""), None),
        "hallucination_spans_not_a_list": (spans.isNotNull() & ~F.coalesce(is_list, F.lit(False)), None), "hallucinated_with_no_spans": (general & (label == "hallucinated") & is_list & none, None),
        "suspicious_raw_id": (raw_id.isin(*SUSPICIOUS_IDS), raw_id),
    }


def target_rules(name: str, targets: Column, expected: Column) -> dict[str, tuple[Column, Column | None]]:
    """The rules of multiple-choice targets, a JSON object of options with 1 (right) or 0."""
    parsed = F.try_parse_json(targets)
    kind = F.coalesce(F.schema_of_variant(parsed), F.lit(""))
    options = F.try_variant_get(parsed, "$", "map<string,variant>")
    values = F.map_values(options)
    number = lambda v: F.when(F.schema_of_variant(v).isin("BIGINT", "DOUBLE", "BOOLEAN") | F.schema_of_variant(v).startswith("DECIMAL"), F.try_variant_get(v, "$", "double"))
    whole = kind.startswith("OBJECT") & (F.size(values) > 0)
    binary = lambda v: F.coalesce(number(v).isin(0.0, 1.0), F.lit(False))
    right = lambda v: F.coalesce(number(v) == 1.0, F.lit(False))
    return {
        f"missing_{name}_despite_has_mc_data": (targets.isNull() & expected, None), f"{name}_not_a_nonempty_dict": (targets.isNotNull() & ~F.coalesce(whole, F.lit(False)), None),
        f"{name}_has_non_binary_values": (whole & F.exists(values, lambda v: ~binary(v)), None), f"{name}_has_no_correct_option": (whole & ~F.exists(values, right), None),
    }


def label_like(profile: DataFrame, most: int = 10) -> DataFrame:
    """Columns of a profile that look like labels: at most ``most`` different values, and at least one."""
    return profile.filter((F.col("n_distinct") <= most) & (F.col("n_distinct") > 0)).select("column_name", "n_distinct")


def json_keys(df: DataFrame, payload: str) -> DataFrame:
    """(key, n, in_all, kinds) over the objects in a JSON text column: how many have the key, whether all do, and the kinds its values have."""
    parsed = df.select(F.try_parse_json(payload).alias("v"), F.col(payload).alias("t")).filter(F.schema_of_variant("v").startswith("OBJECT"))
    total = parsed.agg(F.count(F.lit(1)).alias("_all"))
    each = parsed.select(F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("key", "value"))
    s = F.coalesce(F.schema_of_variant("value"), F.lit("VOID"))
    kind = F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s == "VOID", "null").otherwise("number")
    per = each.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("kinds"))  # six kinds at most
    return per.join(F.broadcast(total)).select("key", "n", (F.col("n") == F.col("_all")).alias("in_all"), "kinds")


def link_choice(overlap: DataFrame, least: float = 0.9) -> DataFrame:
    """The column that links two tables: the one with the largest share of known values, if that is above ``least``; ties go to the first name."""
    best = overlap.filter(F.col("share") > least).agg(F.min_by(F.struct("column_name", "share"), F.struct(-F.col("share"), F.col("column_name"))).alias("b"))
    return best.select(F.col("b.column_name").alias("column_name"), F.col("b.share").alias("share")).filter("column_name IS NOT NULL")
