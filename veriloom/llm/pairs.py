"""Prompt and response pairs that do not work, with their defect.

The language of prompt and response is judged by the posteriors of a naive Bayes model
over character trigrams and words, fitted on all labelled documents of every language
that the labels name. An end that is no end is judged by the likelihood
of the text's last n-gram: the shape of the last tokens (name, word, number, each mark
by itself), counted over all responses, says how often a text ends after such a context.
Refusals are told by a second model over words, pairs of words and character 4-grams,
fitted on all responses themselves: turns of phrase that decline in any grammar book,
and answers that speak of themselves and state nothing, are its first refusals, answers
that state a figure or a name that the prompt lacks are its others. It judges only
answers that state nothing new. Its counts grow with the answers, so they stay a table
that the answers to judge are joined with. Copies and empty answers are plain comparisons.

Defined results: the first that holds of empty, copied_question, refusal, truncated and
other_language; a null or blank prompt can't be copied and has no language; a null
response is empty; calls logged twice are both listed; long texts are read whole;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import lookup_join
from ..session import written
from .overlap import common_length

#: A context that ends fewer than this share of the texts that reach it is no end.
LEAST_END = 0.05
#: Words of an answer below which its language is not judged.
LEAST_WORDS = 5
#: Share of unseen words from which an answer is in none of the known languages.
UNKNOWN = 0.45
#: Times that a document of a language has a word, on average, from which the word is the language's own: rarer ones are quoted or mislabelled.
OWN = 0.002

#: Words in capitals that more than RARE responses have, and more than RARE in COMMON of them, are no names.
RARE, COMMON = 3, 8_000
#: Score from which an answer that states nothing new is a refusal, and the words it must have.
DECLINES, LEAST_REFUSAL = 5.0, 3
#: Posteriors from which a prompt is in a language and an answer in another, and documents that a label must have.
PROMPT_SURE, ANSWER_SURE, LEAST_DOCUMENTS = 0.75, 0.99, 3
#: A character stands in three trigrams and in a word, so so many pieces of evidence count as one.
OVERLAP = 4
#: Counts that a task holds before it passes them on.
HELD = 300_000

# Turns of phrase that decline, what they are joined with, and what languages are called in prompts.
REFUSAL = re.compile(
    r"\bi (?:can(?:no|')?t|can not|am unable to|am not able to|'m not able to|'m unable to|won't|will not|do not|don't|must decline|have to decline|refuse to)\b.{0,40}\b(?:answer|help|comment|respond|reply|discuss|assist|provide|offer|give|say)"
    r"|\bi(?:'d| would) rather not|\bi don't feel comfortable|\bi (?:must|have to) (?:refuse|decline)|against my (?:guidelines|policy)|\bas an? (?:ai|language model)\b"
    r"|\bich (?:kann|darf|möchte|will|werde)\b.{0,60}\b(?:nicht|keine|nichts)\b|\b(?:kann|darf|möchte) ich\b.{0,40}\b(?:nicht|keine|nichts)\b|\bich muss\b.{0,40}\bablehnen"
    r"|\bje (?:ne (?:peux|puis|souhaite|veux|saurais)|préfère ne|dois décliner|dois refuser|ne suis pas en mesure|regrette)|\bno (?:puedo|podré|deseo) (?:\w+ )?(?:responder|ayudar|contestar|hablar|comentar)|\bdebo rechazar|\bno me es posible|\bprefiero no",
)
COURTESY = re.compile(
    r"\bhope you understand|\bfeel free|\bencyclop|\banything else|\bhelp you with|\bpermission to do so|\byou may want|\byou might|\bplease (?:ask|try|contact|consult)|\brephrase|\bapolog|\bsorry\b|sonst noch helfen|bitte|vous aider|n'hésitez|autrement|puedo ayudar|otra cosa|por favor|gracias|veuillez|s'il vous pla[iî]t|\bmerci\b|\bthank|\bunfortunately\b|leider|désolé|lo siento|\bask (?:me|a|for|some)|\bhappy to\b|\bglad to\b|\btry\b|\bconsult\b|\blook (?:at|up)\b|\bexpert\b|\bunderstand(?:ing)?\b|\bquestions?\b",
)
LANGUAGES = {
    "en": "english englisch anglais inglés", "de": "german deutsch allemand alemán", "fr": "french französisch français francés", "es": "spanish spanisch espagnol español",
    "it": "italian italienisch italien italiano", "ru": "russian russisch russe ruso", "nl": "dutch niederländisch néerlandais neerlandés", "pt": "portuguese portugiesisch portugais portugués", "pl": "polish polnisch polonais polaco",
    "zh": "chinese chinesisch chinois chino mandarin", "ja": "japanese japanisch japonais japonés", "ko": "korean koreanisch coréen coreano", "ar": "arabic arabisch arabe árabe", "he": "hebrew hebräisch hébreu hebreo", "hi": "hindi", "th": "thai thailändisch thaï tailandés", "el": "greek griechisch grec griego",
}
#: Codes of the language standard that name none.
NO_LANGUAGE = ("und", "mul", "mis", "zxx")
# End of fixed values.
_ASKED = {name: code for code, names in LANGUAGES.items() for name in names.split()}
_TAG = re.compile(r"<[^<>\n]{0,60}>|\[/?(?:EOS|END|BOS|INST|PAD|SEP|CLS)\]|&[a-z]{2,6};", re.I)
_WORD = re.compile(r"[^\W_]+")
#: Letters of scripts without blanks: kana, Han, Thai, Lao, Khmer and Myanmar.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_LETTERS = re.compile(r"[^\W\d_]+")
_SHAPE = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*|\d+(?:[.,]\d+)*|\n\s*|[^\w\s]|_")
_QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|«[^»]*»|„[^“”]*[“”]")
_PERSON = re.compile(r"\b(?:i|me|my|you|your|us|let's|ich|mir|mich|ihnen|sie|je|moi|vous|m'\w+|j'\w+|yo|usted|ustedes|le)\b")
_SENTENCE = re.compile(r"(?<=[.!?;:…])\s+|\n+")


def is_empty(text: str | None) -> bool:
    """Nothing but blanks, invisible characters, markup, end marks or punctuation."""
    return text is None or not any(c.isalnum() for c in _TAG.sub(" ", text))


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.casefold())


def question_of(prompt: str) -> str:
    """The question proper of a prompt that also gives context."""
    return re.split(r"(?:^|\n)\s*(?:Question|Frage|Pregunta|Q)\s*:", prompt)[-1]


def is_copy(prompt: str, answer: str) -> bool:
    """Whether the answer only repeats the question or the whole prompt, perhaps slightly changed, framed or several times."""
    said = words_of(answer)
    for source in (words_of(question_of(prompt)), words_of(prompt)):
        if len(source) < 3 or len(said) < 0.8 * len(source):
            continue
        own = set(source)
        strange = sum(w not in own for w in said)
        if strange <= max(4, 0.1 * len(source)) and strange <= 0.4 * len(said):
            most = common_length(source, said)
            if most >= 0.8 * len(source):
                return True
    return False


def foreign_capitals(prompt: str, answer: str) -> Iterator[str]:
    """Words in capitals, not at the start of a sentence, that the prompt lacks."""
    text = answer.replace("’", "'")
    known = set(words_of(prompt))
    for m in _LETTERS.finditer(text):
        w = m.group()
        if w[0].isupper() and w != "I" and w.casefold() not in known and text[: m.start()].rstrip()[-1:] not in ("", ".", "!", "?", ":", ";", '"', "*"):
            yield w


def says_nothing(prompt: str, answer: str) -> bool:
    """Speaks of itself or to the reader, without a number or a name that the prompt lacks."""
    text = answer.replace("’", "'")
    if len(words_of(text)) < 5 or any(map(str.isdigit, text)) or not _PERSON.search(text.lower()):
        return False
    return next(foreign_capitals(prompt, answer), None) is None


def declines_plainly(answer: str, prompt: str = "") -> bool:
    """Declines by a common turn of phrase and tells nothing else, or says nothing at all."""
    if says_nothing(prompt, answer):
        return True
    declines = False
    text = answer.lower().replace("’", "'")
    for sentence in _SENTENCE.split(text):
        clauses = re.split(r"[,;]?\s*\b(?:but|however|still|aber|mais|pero|sin embargo)\b,?\s+", sentence) if re.search(r"\b(?:but|however|still|aber|mais|pero)\b", sentence) else [sentence]
        for clause in clauses:
            if REFUSAL.search(clause):
                declines = True
            elif len(words_of(clause)) >= 5 and not COURTESY.search(clause):
                return False
    return declines


@lru_cache(1 << 15)
def word_features(word: str) -> tuple[str, ...]:
    padded = f"^{word}$"
    return (f"w:{word}", *("c:" + padded[i : i + 4] for i in range(max(1, len(padded) - 3))))


def answer_features(answer: str) -> set[str]:
    words = ["^", *words_of(answer), "$"]
    out = {f"b:{a} {b}" for a, b in zip(words, words[1:])}
    out.update(*map(word_features, words[1:-1]))
    return out


def states(prompt: str, answer: str, common: set[str]) -> bool:
    """Whether the answer has a figure, or a name, that the prompt lacks."""
    return any(map(str.isdigit, answer)) or any(w not in common for w in foreign_capitals(prompt, answer))


def first_look(prompt: str, answer: str | None, common: set[str]) -> str:
    """empty, copied_question or refusal if that is plain; stated, or open if only the model can tell whether it declines."""
    if is_empty(answer):
        return "empty"
    if is_copy(prompt, answer):
        return "copied_question"
    if declines_plainly(answer, prompt):
        return "refusal"
    return "stated" if states(prompt, answer, common) else "open"


def common_names(responses: DataFrame) -> set[str]:
    """Words in capitals that stand in too many responses to be names: at most COMMON / RARE times as many as a response has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def passed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["name", "n"])

        for batch in batches:
            for text in batch.column(0):
                held.update({w for w in _LETTERS.findall(text.as_py()) if w[0].isupper()})
                if len(held) > HELD:
                    yield passed()
                    held.clear()
        yield passed()

    texts = responses.filter("generated_text IS NOT NULL").select("generated_text")
    least = max(RARE, texts.count() * RARE / COMMON)
    return {r["name"] for r in texts.mapInArrow(run, "name string, n long").groupBy("name").agg(F.sum("n").alias("n")).filter(F.col("n") > least).collect()}


#: What looked_at makes: defects (generation_id, defect), answers to judge (the same, row, features) and counts (feature, declined, stated).
LOOKED_AT = "generation_id long, defect string, row long, features array<string>, feature string, declined long, stated long"


def looked_at(responses: DataFrame, common: set[str], others: Callable[[], Callable[[str, str], str | None]] | None = None) -> DataFrame:
    """One reading of all responses, see LOOKED_AT; ``others`` makes the test for the defects that come after a refusal. Without it there are counts only.

    The feature '' counts the answers.
    """
    shared = responses.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, test = shared.value, others() if others else None
        row = TaskContext.get().partitionId() << 40
        declined: Counter = Counter()
        stated: Counter = Counter()
        schema = pa.schema([("generation_id", pa.int64()), ("defect", pa.string()), ("row", pa.int64()), ("features", pa.list_(pa.string())), ("feature", pa.string()), ("declined", pa.int64()), ("stated", pa.int64())])

        def made(**columns: list) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

        def counted() -> pa.RecordBatch:
            every = list(declined.keys() | stated.keys())
            return made(feature=every, declined=[declined[x] for x in every], stated=[stated[x] for x in every])

        for batch in batches:
            ids, out, rows, found = [], [], [], []
            for i, prompt, answer in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                prompt = prompt or ""
                kind = first_look(prompt, answer, names)
                if kind in ("refusal", "stated"):
                    counts = declined if kind == "refusal" else stated
                    counts.update(answer_features(answer))
                    counts[""] += 1
                    if len(declined) + len(stated) > HELD:
                        yield counted()
                        declined.clear()
                        stated.clear()
                if test is None:
                    continue
                defect = test(prompt, answer) if kind in ("stated", "open") else kind
                judged = kind == "open" and len(words_of(answer)) >= LEAST_REFUSAL
                if judged or defect:
                    ids.append(i)
                    out.append(defect)
                    rows.append(row if judged else None)
                    found.append(sorted(answer_features(answer)) if judged else None)
                    row += judged
            yield made(generation_id=ids, defect=out, row=rows, features=found)
        yield counted()

    return responses.select(F.col("generation_id").cast("long").alias("generation_id"), "user_input", "generated_text").mapInArrow(run, LOOKED_AT)


class Refusals:
    """Naive Bayes: answers that decline against answers that state something, counted over all responses."""

    def __init__(self, common: set[str], looked: DataFrame):
        self.common = common
        counts = looked.filter("feature IS NOT NULL").select("feature", "declined", "stated")
        size = counts.filter("feature = ''").agg(F.sum("declined"), F.sum("stated")).first()
        self.size = (size[0] or 0, size[1] or 0)
        self.ready = self.size[0] > 0
        share = lambda name, n: F.log((F.sum(name) + 0.5) / (n + 2))
        self.weights = counts.filter("feature <> ''").groupBy("feature").agg((share("declined", self.size[0]) - share("stated", self.size[1])).alias("weight"))

    def scores(self, answers: DataFrame) -> DataFrame:
        """``answers`` (row, features and others) with their score."""
        said = answers.select("row", F.explode("features").alias("feature"))
        sums = lookup_join(said, self.weights, "feature").groupBy("row").agg(F.sum("weight").alias("_weight"))
        return answers.join(sums, "row", "left").withColumn("score", F.coalesce("_weight", F.lit(0.0)) / F.sqrt(F.size("features") + 1)).drop("_weight")

    def declines(self, prompt: str, answer: str) -> bool:
        """Of a single answer; a table goes through ``scores``."""
        if declines_plainly(answer, prompt):
            return True
        if not self.ready or len(words_of(answer)) < LEAST_REFUSAL or states(prompt, answer, self.common):
            return False
        found = answer_features(answer)
        weight = self.weights.filter(F.col("feature").isin(*found)).agg(F.sum("weight")).first()[0] or 0.0
        return weight / math.sqrt(len(found) + 1) >= DECLINES


def refusals(responses: DataFrame) -> Refusals:
    """The model, fitted on all responses."""
    common = common_names(responses)
    return Refusals(common, written(looked_at(responses, common), "refusals"))


@lru_cache(1 << 15)
def token_kind(token: str) -> str:
    c = token[0]
    if c.isdigit():
        return "9"
    if c.isalpha():
        return "N" if c.isupper() else "w"
    if c == "\n":
        return "|"
    return {"“": '"', "”": '"', "…": "...", "’": "'", "。": ".", "۔": ".", "।": ".", "！": "!", "？": "?", "؟": "?"}.get(c, c if c.isascii() else "*")


def shape(text: str) -> list[str]:
    """Tokens by kind: N a name or capitalised word, w another word, 9 a number, a break, ASCII marks as they are, * for others."""
    return ["^", *map(token_kind, _SHAPE.findall(text.strip()))]


def contexts(tokens: list[str], n: int = 3) -> list[str]:
    """Every n-gram that ends within the text, in order; shorter ones at its start."""
    return [" ".join(tokens[max(0, i - n + 1) : i + 1]) for i in range(len(tokens))]


def open_bracket(text: str) -> bool:
    return any(text.count(a) > text.count(b) for a, b in ("()", "[]", "{}"))


def letters_of(text: str) -> list[str]:
    return _LETTERS.findall(text.lower() if text == text.upper() else text)


@lru_cache(1 << 15)
def grams_of(word: str) -> tuple[str, ...]:
    if word != word.lower():
        return ()
    padded = f" {word} "
    return (*(padded[i : i + 3] for i in range(len(padded) - 2)), "=" + word)


def trigrams(text: str) -> list[str]:
    """Character trigrams of the words in lower case, and the words (marked by =); names say nothing about a language."""
    return list(chain.from_iterable(map(grams_of, letters_of(text))))


def size_of(text: str) -> int:
    """Words; in scripts without blanks every character counts as one."""
    words = words_of(text)
    return len(words) if text.isascii() else sum(w.isascii() or len(_UNSPACED.findall(w)) or 1 for w in words)


def extent(text: str) -> int:
    """The size of what tells a language: words without capitals, or all of a text in capitals."""
    words = [w for w in letters_of(text) if w == w.lower()]
    return len(words) if text.isascii() else size_of(" ".join(words))


def script(text: str) -> str:
    """The script of most letters; Japanese is told by its kana."""
    found = Counter(unicodedata.name(c, "").split(" ")[0].split("-")[0] for c in text if c.isalpha())
    return "JAPANESE" if found["HIRAGANA"] + found["KATAKANA"] else max(found, key=found.get, default="")


def is_caseless(text: str) -> bool:
    """Whether most letters are of a script without capitals."""
    if text.isascii():
        return False
    return 2 * sum(c.lower() == c.upper() for c in text if c > "\x7f" and c.isalpha()) > sum(map(str.isalpha, text))


class Languages:
    """Naive Bayes over character trigrams."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        seen = {g for table in counts.values() for g in table if g}
        self.names = sorted(counts)
        self.log, self.rare, self.words = {}, {}, {}
        for name in self.names:
            table = {g: n for g, n in counts[name].items() if g}
            total = sum(table.values()) + 0.5 * (len(seen) + 1)
            self.log[name] = {g: math.log((n + 0.5) / total) for g, n in table.items()}
            self.rare[name] = math.log(0.5 / total)
            self.words[name] = {g for g, n in table.items() if g[0] == "=" and n >= OWN * counts[name][""]}
        # Log-likelihoods of a trigram in all languages; about a million numbers are kept.
        self.evidence = lru_cache((1 << 20) // (len(self.names) + 1))(lambda g: [self.log[name].get(g, self.rare[name]) for name in self.names])

    def scores(self, grams: list[str]) -> dict[str, float]:
        """Mean log-likelihood of a trigram in each language."""
        if not grams:
            return dict.fromkeys(self.names, 0.0)
        return {name: total / len(grams) for name, total in zip(self.names, map(sum, zip(*map(self.evidence, grams))))}

    def posterior(self, grams: list[str]) -> dict[str, float]:
        """Probability of each language, all alike beforehand; evidence that overlaps counts once."""
        means = self.scores(grams)
        top = max(means.values(), default=0.0)
        odds = {name: math.exp((v - top) * len(grams) / OVERLAP) for name, v in means.items()}
        total = sum(odds.values())
        return {name: v / total for name, v in odds.items()}

    def unknown(self, grams: list[str], name: str) -> float:
        """Share of words that the language does not have."""
        words = [g for g in grams if g[0] == "="]
        return sum(g not in self.words[name] for g in words) / max(1, len(words))


def language_counts(documents: DataFrame) -> dict[str, dict[str, int]]:
    """How often all documents of each language that the labels name have each trigram and word; '' counts the documents."""
    labelled = documents.withColumn("lang", F.lower(F.trim("lang"))).filter("lang <> '' AND text IS NOT NULL").filter(~F.col("lang").isin(*NO_LANGUAGE))
    per = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= LEAST_DOCUMENTS)
    out: dict[str, dict[str, int]] = {r["lang"]: {"": r["_n"]} for r in per.collect()}  # one row for a language
    named = set(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        held = 0

        def passed() -> pa.RecordBatch:
            every: Counter = Counter()
            for lang, own in words.items():
                for w, n in own.items():
                    for g in grams_of(w):
                        every[lang, g] += n
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in every], pa.string()), pa.array([k[1] for k in every], pa.string()), pa.array(list(every.values()), pa.int64())], names=["lang", "gram", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if (t := text.as_py()) is not None and lang in named:
                    own = words.setdefault(lang, Counter())
                    before = len(own)
                    own.update(letters_of(t))
                    held += len(own) - before
                    if held > HELD:
                        yield passed()
                        words.clear()
                        held = 0
        yield passed()

    rows = labelled.select("lang", "text").mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    for r in rows.filter("n >= 2").collect():  # trigrams and words: these grow as the vocabulary, not as the documents
        out[r["lang"]][r["gram"]] = r["n"]
    return out


def end_shares(responses: DataFrame) -> dict[str, float]:
    """For each context of token kinds, how often a response that reaches it ends there; over all responses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached: Counter = Counter()
        ended: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                t = text.as_py()
                if t is None or is_empty(t):
                    continue
                own = contexts(shape(t))
                reached.update(own)
                ended[own[-1]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(reached), pa.string()), pa.array(list(reached.values()), pa.int64()), pa.array([ended[k] for k in reached], pa.int64())], names=["context", "reached", "ended"])

    rows = responses.select("generated_text").mapInArrow(run, "context string, reached long, ended long").groupBy("context").agg(F.sum("reached").alias("reached"), F.sum("ended").alias("ended"))
    return {r["context"]: r["ended"] / r["reached"] for r in rows.filter("ended > 0").collect()}  # few kinds of tokens, so few contexts


def is_truncated(answer: str, ends: dict[str, float]) -> bool:
    """Stops where texts do not end, or with a bracket left open."""
    text = re.sub(r"(?:\s*<[^<>\s]{1,30}>)+\s*$", "", answer).strip()
    if open_bracket(text) or re.fullmatch(r"(?:\d+[.)]|[-*•])", text.rsplit("\n", 1)[-1].strip()) and "\n" in text:
        return True
    tokens = shape(text)
    if len(tokens) <= 4 and tokens[-1] in "N9w.!?":  # a short answer
        return False
    return ends.get(" ".join(tokens[-3:]), 0.0) < LEAST_END


def asked_language(prompt: str) -> set[str]:
    """Languages that the prompt asks an answer in."""
    found = set()
    for m in re.finditer(r"\b(?:in|auf|en|into|ins)\s+(?:the\s+|the language\s+)?([A-Za-zäöüßéèêáíóúñç]+)", prompt):
        code = _ASKED.get(m.group(1).lower())
        if code:
            found.add(code)
    return found


def answer_proper(answer: str) -> str:
    """Without what it quotes and without a short opening such as a greeting or an announcement."""
    bare = _QUOTED.sub(" ", answer)
    parts = [p for p in _SENTENCE.split(bare if size_of(bare) >= LEAST_WORDS else answer) if p]
    return " ".join(p for k, p in enumerate(parts) if k or size_of(p) >= LEAST_WORDS) or answer


def is_other_language(prompt: str, answer: str, model: Languages) -> bool:
    asked = asked_language(prompt)
    question = trigrams(question_of(prompt)) or trigrams(prompt)
    proper = answer_proper(answer)
    grams = trigrams(proper)
    if not question or extent(proper) < LEAST_WORDS or not model.names:
        return False
    q, a = model.posterior(question), model.posterior(grams)
    own, best = max(q, key=q.get), max(a, key=a.get)
    if model.unknown(grams, best) > UNKNOWN:  # none of the languages of the model
        return not (asked - set(model.names)) and ((own_script := script(proper)) == "LATIN" or own_script != script(question_of(prompt)))
    # Too short a question has no language.
    sure = sum(g[0] == "=" for g in question) >= 2 and q[own] >= PROMPT_SURE
    return sure and best != own and a[best] >= ANSWER_SURE and best not in asked


def defects(responses: DataFrame, documents: DataFrame) -> DataFrame:
    """generation_id, defect of each pair that has one."""
    spark = responses.sparkSession
    common = common_names(responses)
    shared = spark.sparkContext.broadcast((language_counts(documents), end_shares(responses)))

    def others() -> Callable[[str, str], str | None]:
        counts, ends = shared.value
        model = Languages(counts)

        def test(prompt: str, answer: str) -> str | None:
            if (caseless := is_caseless(answer)) and is_other_language(prompt, answer, model):  # not every script has end marks
                return "other_language"
            if is_truncated(answer, ends):
                return "truncated"
            return "other_language" if not caseless and is_other_language(prompt, answer, model) else None

        return test

    looked = written(looked_at(responses, common, others), "responses")
    model = Refusals(common, looked)
    plain = looked.filter("defect IS NOT NULL AND row IS NULL").select("generation_id", "defect")
    judged = looked.filter("row IS NOT NULL").select("generation_id", "defect", "row", "features")
    if model.ready:
        judged = model.scores(judged).withColumn("defect", F.when(F.col("score") >= DECLINES, "refusal").otherwise(F.col("defect")))
    return plain.unionByName(judged.filter("defect IS NOT NULL").select("generation_id", "defect"))
