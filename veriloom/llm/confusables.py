"""One consistent form for text, and the values that deviate from it.

The skeleton of a text is the Unicode confusables construction: decompose, drop what is
never shown, replace every character by the prototype of its look-alike class, decompose
again. It looks at single characters only, knows nothing of words, and originals with
equal skeletons form a class of texts that look the same. Every class has a plain
reading: presentation forms as their plain letters, foreign letters as Latin ones in
words that are Latin otherwise or look Latin throughout, but all that a language needs
(real words of other scripts, joiners of their script or of an emoji, accents without a
composed form, quotes, dashes, superscripts, fractions, signs). A value deviates if its
class holds a plain reading other than itself; ``look_alike_classes`` gives the classes
over all values.

A pattern in the JVM passes on only values with characters outside the ordinary Latin
repertoire for their reading; all others are their own. For the classes every value
reaches Python.

Defined results: null stays null and is no case, nor is an empty text; texts of any
length are treated whole; repeated rows each count; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prototypes import PROTOTYPE

# Look-alike letters and their Latin prototypes, a part of the public Unicode confusables data, for the canonical form.
CYRILLIC = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v", "ү": "y",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "Ү": "Y", "Ѵ": "V", "Ԍ": "G",
}
GREEK = {
    "α": "a", "γ": "y", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C",
}
ARMENIAN = {"օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "Օ": "O", "Ս": "U", "Տ": "S", "Լ": "L"}
CHEROKEE = {"Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮪ": "S", "Ꮩ": "V", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K"}
LATIN = {"ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i"}
#: Alike enough within a Latin word, but too common in real words of their script to make one Latin.
WEAK = {"к": "k", "κ": "k", "τ": "t", "χ": "x"}
LOOKALIKE = {**CYRILLIC, **GREEK, **ARMENIAN, **CHEROKEE, **LATIN}
#: The whole public table; letters of the lists above that it keeps apart are prototypes of theirs.
_PROTOTYPES = PROTOTYPE | {ord(c): "".join(PROTOTYPE.get(ord(x), x) for x in p) for c, p in (LOOKALIKE | WEAK).items()}
SCRIPT = {c: n for n, table in enumerate((CYRILLIC, GREEK, ARMENIAN, CHEROKEE)) for c in table}
RANGES = ((0x400, 0x530, 0), (0x370, 0x400, 1), (0x1F00, 0x2000, 1), (0x530, 0x590, 2), (0x13A0, 0x1400, 3), (0xAB70, 0xABC0, 3))

#: Java pattern: a character that an ordinary Latin text with composed accents does not need.
UNUSUAL = (
    r"[^\t\n\r -~\u00a1-\u00ac\u00ae-\u0130\u0132-\u024f\u2010\u2012-\u2027\u2030-\u205e\u2070-\u209c\u20a0-\u20bf"
    r"\u2116\u2122\u2150-\u215f\u2190-\u245f\u2500-\u27bf]"
)
_BLANKS = frozenset("\x0b\x0c\x85\u2028\u2029")
_FORMS = frozenset(("<wide>", "<narrow>", "<font>", "<circle>", "<small>", "<vertical>", "<initial>", "<medial>", "<final>", "<isolated>"))
_JOINING = ((0x600, 0xE00), (0xF00, 0x10A0), (0x1780, 0x18B0), (0xFB50, 0xFE00), (0xFE70, 0xFEFF))
_VISIBLE_FORMAT = frozenset([*map(chr, range(0x600, 0x606)), "\u06dd", "\u070f", "\u0890", "\u0891", "\u08e2"])
#: Zero-width non-joiner and joiner, variation selectors of text and emoji, Mongolian vowel separator.
_JOINERS = "\u200c\u200d\ufe0e\ufe0f\u180e"
_SELECTORS = "\ufe0e\ufe0f"
_FILLERS = "\u034f\u115f\u1160\u3164\uffa0\u17b4\u17b5"
_WORD = re.compile(r"[^\W\d_]+")
_TURKISH = frozenset("ğşĞŞİ")


@lru_cache(maxsize=1 << 16)
def _kind(c: str) -> str:
    """'' ordinary, 'blank', 'hidden', 'join' (needs its neighbours), else the plain text that ``c`` presents."""
    if c in "\t\n\r ":
        return ""
    if c in _BLANKS:
        return "blank"
    category = unicodedata.category(c)
    if category == "Zs":
        return "blank"
    if c in _JOINERS:
        return "join"
    if category == "Cf":
        return "" if c in _VISIBLE_FORMAT else "hidden"
    if category == "Cc" or c in _FILLERS or 0xFE00 <= ord(c) <= 0xFE0F or 0xE0100 <= ord(c) <= 0xE01EF:
        return "hidden"
    if c in LOOKALIKE:
        return ""
    form, _, rest = unicodedata.decomposition(c).partition(" ")
    if form in _FORMS:
        return unicodedata.normalize("NFKC", c)
    if form == "<compat>" and (category == "Nl" or 0xFB00 <= ord(c) <= 0xFB4F):
        return unicodedata.normalize("NFKC", c)
    return ""


def _joins(text: str, i: int) -> bool:
    """Whether the joiner at ``i`` is needed by its script or an emoji."""
    before, after = text[i - 1 : i] if i else "", text[i + 1 : i + 2]
    if text[i] in _SELECTORS:
        return bool(before) and unicodedata.category(before) in ("So", "Sm", "Po", "Nd")
    within = lambda c: bool(c) and any(a <= ord(c) < b for a, b in _JOINING)
    if within(before) and (within(after) or text[i] == "\u200d"):
        return True
    if text[i] == "\u200d" and after:
        return unicodedata.category(after) in ("So", "Sm") and bool(before) and (before == "\ufe0f" or unicodedata.category(before) in ("So", "Sk"))
    return False


def _script(c: str) -> int | None:
    n = ord(c)
    return next((s for a, b, s in RANGES if a <= n < b), None)


def _latin_words(text: str) -> str:
    """Foreign letters that stand for Latin ones replaced, word by word."""
    words = list(_WORD.finditer(text))
    real: dict[int, set[int]] = {}
    for k, m in enumerate(words):  # scripts of which the word is a real word
        real[k] = {s for c in m.group() if c not in LOOKALIKE and (s := _script(c)) is not None}
    out, at = [], 0
    for k, m in enumerate(words):
        w = m.group()
        alike = [c for c in w if c in LOOKALIKE]
        weak = [c for c in w if c in WEAK]
        if not alike and not weak:
            continue
        latin = any(c not in LOOKALIKE and c not in WEAK and (c.isascii() or "LATIN" in unicodedata.name(c, "")) for c in w)
        own = {c for c in alike if c in LATIN}
        if own and (("ı" in own and _TURKISH & set(w)) or any(0x250 <= ord(c) < 0x2B0 and c not in LATIN for c in w)):
            continue
        if not latin:
            if len(alike) < len(w):
                continue
            scripts = {SCRIPT[c] for c in alike if c in SCRIPT}
            if any(scripts & real.get(j, set()) for j in (k - 1, k + 1)):
                continue
        out += [text[at : m.start()], "".join(LOOKALIKE.get(c) or WEAK.get(c) or c for c in w)]
        at = m.end()
    return "".join([*out, text[at:]]) if out else text


def canonical(text: str) -> str:
    """The consistent form; equal to ``text`` if nothing in it deviates."""
    out = []
    for i, c in enumerate(text):
        if c.isascii() and (c >= " " or c in "\t\n\r") and c != "\x7f":
            out.append(c)
            continue
        kind = _kind(c)
        if not kind:
            out.append(c)
        elif kind == "blank":
            out.append(" ")
        elif kind == "join":
            if _joins(text, i):
                out.append(c)
        elif kind != "hidden":
            out.append(kind)
    return _latin_words(unicodedata.normalize("NFC", "".join(out)))


class _Table(dict):
    """The prototype of every character, looked up when it is first met: that of the plain text it presents, else that of the public data."""

    def __missing__(self, n: int) -> str:
        c = chr(n)
        if (kind := _kind(c)) == "blank":
            out = " "
        elif kind in ("hidden", "join"):
            out = ""
        elif kind and kind != c:
            out = "".join(self[ord(x)] for x in unicodedata.normalize("NFD", kind))
        else:
            out = _PROTOTYPES.get(n, c)
        self[n] = out
        return out


_TABLE = _Table()


def skeleton(text: str) -> str:
    """Equal for texts that look the same."""
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(_TABLE))


def plain_reading(text: str) -> str:
    """The plain text of the class of ``text``: its canonical form, if that looks the same."""
    plain = canonical(text)
    return plain if plain != text and skeleton(plain) == skeleton(text) else text


def values(df: DataFrame, table_name: str, key: str, fields: list[str]) -> DataFrame:
    """(table_name, row_key, field, text): every value of the text columns, from one scan."""
    items = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])
    return df.select(F.lit(table_name).alias("table_name"), F.col(key).cast("long").alias("row_key"), F.inline(items))


def unusual(text: Column) -> Column:
    return text.rlike(UNUSUAL)


def deviating(rows: DataFrame) -> DataFrame:
    """table_name, row_key, field of the values whose class, by skeleton, has a plain reading other than themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).to_pylist()
            hit = pa.array([i for i, t in enumerate(texts) if plain_reading(t) != t], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(k).take(hit) for k in range(3)], names=["table_name", "row_key", "field"])

    return rows.filter(unusual(F.col("text"))).mapInArrow(run, "table_name string, row_key long, field string")


def _by(rewrite):
    @F.pandas_udf("string")
    def apply(texts):
        return texts.map(rewrite, na_action="ignore")

    return apply


def canonical_column(text: Column) -> Column:
    """The plain reading; ordinary values stay in the JVM."""
    return F.coalesce(_by(plain_reading)(F.when(unusual(text), text)), text)


def consistent(rows: DataFrame) -> DataFrame:
    """Every value with its canonical form and whether it deviated."""
    done = rows.withColumn("canonical", canonical_column(F.col("text")))
    return done.select("table_name", "row_key", "field", "canonical", F.coalesce(F.col("canonical") != F.col("text"), F.lit(False)).alias("deviates"))


def look_alike_classes(rows: DataFrame) -> DataFrame:
    """skeleton_id, forms, n: classes of different spellings of one look, by equal skeleton."""
    shown = _by(skeleton)(F.col("text"))
    keyed = rows.filter(F.col("text").isNotNull()).select(F.md5(shown.cast("binary")).alias("skeleton_id"), F.md5(F.col("text").cast("binary")).alias("form"))
    per_form = keyed.groupBy("skeleton_id", "form").agg(F.count(F.lit(1)).alias("n"))
    return per_form.groupBy("skeleton_id").agg(F.count(F.lit(1)).alias("forms"), F.sum("n").alias("n")).filter("forms > 1")
