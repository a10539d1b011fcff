"""Text expressions shared by the operators; all but the Unicode forms stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blanks as Python's str.strip and \s know them.
BLANK = r"[\s\u001c-\u001f\u0085\p{Z}]"


def normalize_text(c: Column) -> Column:
    """Stripped, lower case, runs of blanks as one; null gives an empty text."""
    one = F.regexp_replace(F.lower(c), f"{BLANK}+", " ")
    return F.coalesce(F.trim(one), F.lit(""))


def is_blank(c: Column) -> Column:
    """Null, empty or nothing but blanks."""
    return F.coalesce(F.regexp_replace(c, f"{BLANK}+", "") == "", F.lit(True))


def clean_label(c: Column) -> Column:
    """A label without case, outer blanks, quotes and dots."""
    return F.lower(F.regexp_replace(c, r"^[\s\"'.]+|[\s\"'.]+$", ""))


def split_cells(c: Column, separator: str) -> Column:
    """Cells of a delimited list, trimmed, without blank ones; null gives an empty array."""
    cells = F.transform(F.split(c, separator), lambda x: F.trim(x))
    return F.coalesce(F.filter(cells, lambda x: x != ""), F.array().cast("array<string>"))


def first_number(c: Column, separator: str = "_") -> Column:
    """The first token that is all digits, or null."""
    return F.try_element_at(F.filter(F.split(F.trim(c), separator), lambda x: x.rlike("^[0-9]+$")), F.lit(1))


def unicode_form(c: Column, form: str = "NFC") -> Column:
    """Unicode normal form; Spark has no expression for it, so this is an Arrow batch."""

    @F.pandas_udf("string")
    def normal(texts):
        import unicodedata

        return texts.map(lambda t: unicodedata.normalize(form, t), na_action="ignore")

    return normal(c)


def word_spans(c: Column) -> Column:
    """start, end and text of every run without spaces; no expression of Spark tells where a match begins."""

    @F.pandas_udf("array<struct<start:int,end:int,text:string>>")
    def spans(texts):
        import re

        return texts.map(lambda t: [{"start": m.start(), "end": m.end(), "text": m.group()} for m in re.finditer("[^ ]+", t)], na_action="ignore")

    return spans(c)


def wiki_line(line: Column) -> Column:
    """sentence_id and sentence of a line of tab-separated fields; a malformed one (no tab, or no integer first) has neither. Integers as int() reads them, up to 64 bits."""
    parts = F.split(line, "\t", 3)
    head = F.regexp_replace(parts[0], f"^{BLANK}+|{BLANK}+$", "")
    number = F.when(head.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"), F.regexp_replace(head, "_", "").try_cast("long"))
    good = (F.size(parts) >= 2) & number.isNotNull()
    return F.struct(F.when(good, number).alias("sentence_id"), F.when(good, F.get(parts, F.lit(1))).alias("sentence"), F.coalesce(~good, F.lit(True)).alias("malformed"))


def wiki_line_counts(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: lines, sentences and malformed lines."""
    return lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(~F.col("malformed")).alias("n_sentences"), F.count_if("malformed").alias("n_malformed"))
