"""Documents with template residue, filler, error messages or script notices.

Texts are cut into messages (sentences and lines); numbers and invented names become
wild cards. All distinct messages go through a prefix tree of fixed depth (length, then
the first tokens; in a leaf, messages that agree in most places share a template), and
the documents that hold a template are counted. Templates are classified once and the
verdict goes back to their messages and from these to the documents.

The classifier is a naive Bayes model over the words, pairs of words and character
4-grams of templates, fitted on a bounded sample of the corpus' own templates. Its first
labels are weak: a few standard notices (reason phrases of HTTP, script notices, lorem
ipsum) and the shape of filler mark residue, templates with names in them mark content.
It then labels the sample itself once more, so it learns what stands in the corpus
beside the standard notices. A message is also classified by itself, so merging can add
a verdict but take none away.

Slots that no one filled are looked for apart from that, in every record. What is shown
as code or quoted is set aside first; a sentence with several names in it is a message
if it holds a standard notice and nothing in it tells about such messages.

Which words are names is learned from the corpus: counts over all documents of how
often a word stands in lower case.

Defined results: null, blank and empty texts are no cases; repeated documents each
count; whole texts of any length are read; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import math
import re
from re import _parser
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.shape import hashed_sample
from ..operators.skew import lookup_join
from ..session import shuffle_width, written

#: The most frequent ordinary words that are broadcast; rarer ones are joined to the documents that hold them.
VOCABULARY = 200_000
#: Tokens of a message that the prefix tree branches on, after the length.
DEPTH = 2
#: What stands in a template where its messages differ; * is a name, # a number, ^ a first word that may be one.
MERGED = "~"
WILD = frozenset(("*", "#", "^", MERGED))
#: Share of places in which two messages of a leaf must agree to share a template.
SIMILARITY = 0.7
#: Templates that a leaf keeps to compare with; a message beyond them that fits none is a template of its own, with its own verdict.
LEAF = 5_000
#: Names a message may hold; with more, only standard notices count, and no telling about them.
NAMES = 1
#: Templates with a first label, and as many without, that the classifier is fitted on.
SAMPLE = 10_000
#: Score from which a template is residue; that from which the sample's own templates teach the second fit; that below which they count as content.
RESIDUE, SURE, CONTENT = 1.5, 6.0, 1.0
#: Documents that may hold a sentence of content, as copies of one another.
COPIES = 3
#: Words that a message must hold, apart from wild cards, to be judged by the classifier.
LEAST_WORDS = 3

# Standard notices, by verdict.
SCRIPT = (
    r"\b(?:enable|activate|turn on|allow|switch on|requires?|needs?|without|aktivieren|ben[öo]tigt|braucht|ohne|activez|activer|besoin de|sans|active|activar|necesita|requiere|sin) (?:sie |your |the |de )?(?:java ?script|scripts?|skripte|cookies)\b",
    r"\b(?:java ?script|scripts?|scripting|skripte) (?:is|are|must be|has been|seems to be|sind|ist|muss|est|sont|está|están)\b.{0,30}\b(?:required|needed|disabled|blocked|allowed|off|enabled|ausgeschaltet|deaktiviert|blockiert|erforderlich|requis|bloqu\w+|désactiv\w+|desactivad\w+|necesario)",
)
ERROR = (
    r"\b(?:error|fehler|erreur) #", r"# (?:not found|forbidden|bad gateway|bad request|internal server error|service unavailable|unauthorized|gateway timeout|too many requests)", r"\b(?:application|internal|server|fatal) error\b", r"\binterner serverfehler", r"\berreur interne", r"\berror interno",
    r"access denied", r"zugriff verweigert", r"acc[eè]s refus", r"acceso denegado", r"page (?:was )?not found", r"seite nicht gefunden", r"page introuvable", r"p[áa]gina no encontrada", r"(?:bad gateway|bad request)", r"gateway tim", r"something went wrong", r"session (?:has )?expired",
    r"(?:content|page|service|site) is (?:currently |temporarily )?(?:not available|unavailable|down)", r"down for maintenance", r"too many requests", r"\btraceback\b", r"wartungsarbeiten", r"en maintenance", r"en mantenimiento", r"try again later", r"versuchen sie es später", r"r[ée]essayez plus tard", r"vuelva a intentarlo",
)
FILLER = (
    r"lorem ipsum", r"\b(?:sample|dummy|placeholder|filler) (?:text|copy|paragraph|content|headline|title)\b", r"\b(?:headline|title|text|content|copy) (?:goes )?here\b", r"\b(?:content|text|page) coming soon", r"replace this (?:paragraph|text|sentence|headline)", r"^(?:write|insert|enter|type|add|put) .*\bhere$",
    r"platzhaltertext", r"hier steht ihr", r"texte de remplissage", r"texto de relleno",
)
LOREM = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split())
FUNCTION = frozenset("since although though because while where when until before after between through under over against beside despite whose only had has have not no but if so than then there their they he she his her this these those into onto upon within without about during "
    "bevor nachdem obwohl weil aber wo als auch nicht kein keine seit bis bei nach vor aus wurde car mais bien avant après où dans sans selon dès plus ne pas lo porque hasta antes después según donde aunque desde sin "
    "à por where who whom was been "
    "the a an of in on at to and or by for from with is was are were as that which it its der die das und ein eine von in im aus mit ist war wie sich les le la un une de des du et est par pour dans qui que el los las una y en con fue se su para del".split())
#: Words of the web that a corpus may hold at the start of a sentence only, or only in such messages.
PLAIN_WORDS = (
    "please oops log logged in again continue reference code loading cookies browser window page site server request resource address link view content reload refresh retry later minutes administrator support home help menu search about contact skip back start powered "
    "bitte seite fenster adresse browser dienst skripte veuillez adresse serveur navigateur page site por favor dirección servidor página navegador sitio"
)
HTML = frozenset("a abbr b big blockquote body br button center code div em font form h1 h2 h3 head hr html i iframe img input label li link meta nav ol option p pre s script section select small span strong style sub sup table tbody td th thead title tr tt u ul".split())
MARKS = frozenset(("sic", "citation needed", "edit", "source", "sources", "note", "human", "assistant", "user", "system"))
TELLING = (
    r"\b(?:is|was|are|were|ist|war|est|était|es|era) (?:the |a |an |der |ein |le |un |el )?(?:title|name|nickname|motto|song|novel|film|album|poem|titel|roman|lied|titre|chanson|título|canción)\b", r"\b(?:said|says|saying|wrote|writes|written|reported|reports|told|tells|recalled|recalls|claimed|claims|explained|explains|announced|argued|noted|notes|described|describes|remembered|believed|learned|discovered|printed|printers|painted|titled|entitled|called|known as|spoke|complained)\b",
    r"\b(?:sagte|schrieb|berichtete|erzählte|erklärte|behauptete|beschrieb|meldete|erinnerte|nannte|heißt|hieß|titelte)\b", r"\b(?:a|ont|avait) (?:dit|écrit|raconté|expliqué|annoncé|décrit|rapporté)\b", r"\b(?:écrivit|raconta|expliqua|intitulée?s?|dijo|escribió|contó|explicó|anunció|describió|informó|titulad[oa]s?)\b",
)
# End of fixed values.

_RULES = [(name, re.compile("|".join(rules))) for name, rules in (("script", SCRIPT), ("error", ERROR), ("filler", FILLER))]


def _needed(parsed) -> frozenset | None:
    """Texts of which a match holds at least one: of the parts that a match must have, the one whose shortest text is longest."""
    found, run = [], ""
    for op, value in [*parsed, (None, None)]:
        if op is _parser.LITERAL:
            run += chr(value)
            continue
        if run:
            found.append(frozenset((run,)))
            run = ""
        if op is _parser.SUBPATTERN:
            found.append(_needed(value[3]))
        elif op is _parser.BRANCH:
            each = [_needed(x) for x in value[1]]
            found.append(None if None in each else frozenset().union(*each))
    return max(filter(None, found), key=lambda x: min(map(len, x)), default=None)


_NEEDED = {name: [x for x in sorted(every) if not any(y != x and y in x for y in every)] for name, rules in (("script", SCRIPT), ("error", ERROR), ("filler", FILLER)) if (every := frozenset().union(*(_needed(_parser.parse(r)) for r in rules)))}
#: A word of each, which a message holds before its marks are dropped.
_HINTS = sorted({max(x.split(), key=len) for own in _NEEDED.values() for x in own})
_TELLING = re.compile("|".join(TELLING))
#: Words of the notices are never names.
_CUES = frozenset(re.findall(r"[^\W\d_]{2,}", re.sub(r"\\[a-zA-Z]", " ", " ".join((*SCRIPT, *ERROR, *FILLER)))))
_KNOWN = _CUES | LOREM | FUNCTION | frozenset(PLAIN_WORDS.split())
_SHOWN = re.compile(r"```.*?(?:```|\Z)|`[^`\n]+`", re.S)
#: A quote may be of any length but not go beyond its paragraph, nor its line where both its marks are the same.
_QUOTED = re.compile(r"“((?:[^“”\n]|\n(?!\s*\n))+)”|\"([^\"\n]+)\"|«((?:[^«»\n]|\n(?!\s*\n))+)»|„((?:[^“„”\n]|\n(?!\s*\n))+)[“”]")
_SLOT = re.compile(
    r"\{\{ ?[\w.\- ]+ ?\}\}|\$\{ ?[\w.\- ]+ ?\}|<%=? ?[\w.\- ]+ ?%>|%\([\w.\- ]+\)[sd]|%%[\w.\-]+%%|(?<![\w.])@[A-Za-z]\w+@(?!\w)"
    r"|(?<!\w)#[A-Za-z][A-Za-z_]+#(?!\w)|(?<!\w)__[A-Za-z](?:\w*?[A-Za-z])?__(?!\w)|\[\[[a-zA-Z_ ]{2,}\]\]|\[(?:insert|your|enter|add) [^\[\]\n]+\]"
    r"|(?-i:\[[A-Z][A-Z_]{2,}\])|(?<![\w$])\{[A-Za-z]\w+\}|(?<![_\w])_{3,}(?![_\w])|(?<![\w%])%[sd](?![\w%])",
    re.I,
)
#: Slots that their marks tell, whatever stands within.
_MARKED_SLOTS = (("{{", "}}"), ("{%", "%}"), ("${", "}"), ("<%", "%>"))
#: Up to four words in brackets, or two in angles, name a slot; more are a remark.
_SOFT_SLOT = re.compile(r"(?<![\w\[])\[([A-Za-z]{2,}(?:[ _][A-Za-z]{2,}){0,3})\](?![\w(\]])|<([A-Za-z]\w+(?: \w+)?)>")
_SPEAKER = re.compile(r"^[ \t]*(?:\[[A-Z][a-z]+\]:|[a-z]+ \d+:|[A-Z][a-z]+:(?=\s))[ \t]*", re.M)
_FIELD = re.compile(r"^\w+: ?\S*")
_END = re.compile(r"(?<=[.!?;…])[\"”»)\]]*\s+|\s*\|\s*")
END_MARKS = frozenset(".!?…")
_TOKEN = re.compile(r"[^\W_]+")
_PLAIN = re.compile(r"[^\W\d_]+")


def shown_removed(text: str) -> str:
    """Without what is shown as code or quoted; a single quoted word stays."""
    text = _SHOWN.sub(" ", text)
    return _QUOTED.sub(lambda m: m.group() if " " not in (q := next(g for g in m.groups() if g is not None)).strip() or len(q) > 0.5 * len(text) else " ", text)


def marked_slot(line: str) -> bool:
    """Whether a slot stands in a line, up to its closing mark; {{1}, {2}} is a set of sets."""
    for opening, closing in _MARKED_SLOTS:
        at = line.find(opening)
        while at >= 0 and (end := line.find(closing, at := at + 2)) >= 0:
            inside = line[at:end]
            if inside.strip(" \t=") and not ("}" in inside and inside.find("}") < inside.find("{") % (len(inside) + 1)):
                return True
            at = line.find(opening, end)
    return False


def has_slot(text: str) -> bool:
    """Whether an unfilled slot stands in a text of which code and quotes are removed."""
    if not any(c in text for c in "{[<%@#_"):
        return False
    line = re.sub(r"\s+", " ", text)
    if _SLOT.search(line) or any(marked_slot(own) for own in text.split("\n")):
        return True
    return any((m.group(1) or "").lower() not in MARKS if m.group(1) else m.group(2).lower().split()[0] not in HTML for m in _SOFT_SLOT.finditer(line))


def messages(text: str) -> Iterator[str]:
    """Sentences and lines; lines that were merely wrapped are joined."""
    lines = _SPEAKER.sub("", text).split("\n")
    joined: list[str] = []
    for k, line in enumerate(lines):
        line = line.strip()
        before = lines[k - 1].strip() if k else ""
        wrapped = k and line and before and not before.endswith((".", "!", "?")) and (line[0].islower() or len(before) >= 40) and not _FIELD.match(before) and not text_label(lines[k])
        if wrapped and joined:
            joined[-1] += " " + line
        elif line:
            joined.append(line)
    for line in joined:
        yield from (s for s in _END.split(line) if s)


def text_label(line: str) -> bool:
    return bool(re.match(r"\w+: ", line))


class Either(tuple):
    """Sets, as one to look into."""

    def __contains__(self, word) -> bool:
        return any(word in own for own in self)


def is_ordinary(t: str, ordinary, cased: bool) -> bool:
    return len(t) == 1 or (low := t.lower()) in ordinary or low in _KNOWN or (cased and (t.islower() or not t[1:].islower() and not t.isupper()))


def masked(message: str, ordinary, cased: bool) -> str | None:
    """The message with * for names and # for numbers; with too many names ! goes before it, and None is no message."""
    out, names, lead, text = [], 0, True, message.lower()
    for t in _TOKEN.findall(message):
        if any(c.isdigit() for c in t):
            token = "#"
        elif (low := t.lower()) in ordinary or is_ordinary(t, ordinary, cased):
            token, lead = low, False
        else:
            token = "*"
            if not lead or len(out) > 4:
                names += 1
                if names == NAMES + 1 and not any(h in text for h in _HINTS):
                    return None
        if token not in "*#" or not out or out[-1] != token:
            out.append(token)
    if not out or all(t in ("*", "#") for t in out):
        return None
    if out[-1] in FUNCTION and message.rstrip("\"”»)] ")[-1:] not in END_MARKS and not ruled(" ".join(out)):  # a line cut off within a sentence
        return None
    if names > NAMES:
        return None if not ruled(template := " ".join(out)) or _TELLING.search(text) else f"! {template}"
    return " ".join(out)


def ruled(template: str) -> str | None:
    for name, rule in _RULES:
        for own in _NEEDED[name]:  # most templates hold none of these, which is told sooner
            if own in template:
                if rule.search(template):
                    return name
                break
    return None


def words_in(message: str) -> list[str]:
    return _TOKEN.findall(message)


def content_words(template: str) -> list[str]:
    return [w for w in template.removeprefix("! ").split(" ") if w not in WILD]


def names_in(template: str) -> int:
    """Names apart from a first word, which any message has in capitals."""
    return template.removeprefix("! ").split(" ")[1:].count("*")


def filler_shape(template: str) -> bool:
    """Whether the words are those of lorem ipsum, or words without any grammar: repeated, or many and no name among them."""
    words = content_words(template)
    if len(words) < 4:
        return False
    if sum(w in LOREM for w in words) >= 0.6 * len(words):
        return True
    return not FUNCTION & set(words) and (len(set(words)) <= 0.75 * len(words) or len(words) >= 8 and "*" not in template)


def labelled(template: str) -> str | None:
    """script, error or filler by the standard notices and the shape of filler; None for anything else."""
    return ruled(template.removeprefix("! ")) or ("filler" if filler_shape(template) else None)


def features(template: str) -> set[str]:
    """Words, pairs of words and character 4-grams of words."""
    words = template.removeprefix("! ").split(" ")
    words[0] = words[0].replace("*", "^")
    out = {f"b:{a} {b}" for a, b in zip(words, words[1:])}
    for w in words:
        if w != MERGED:
            out.add(f"w:{w}")
        if w not in WILD:
            padded = f"^{w}$"
            out.update("c:" + padded[i : i + 4] for i in range(max(1, len(padded) - 3)))
    return out


def standing(template: str, support: int) -> str:
    """Whether a template has names, numbers, and in how many documents it stands, by powers of two up to sixteen."""
    return f"{min(names_in(template), 2)}{'#' in template.split(' ')}{min(support.bit_length(), 5)}"


class Notices:
    """Naive Bayes over the features of templates: residue against content, and among residue which kind."""

    KINDS = ("error", "filler", "script")

    def __init__(self, sample: list[tuple[str, int]]):
        own = {t: (features(t), standing(t, n)) for t, n in sample}
        kinds = {t: k for t in own if (k := labelled(t))}
        # What has a name tells something; a long message without one that hardly any other document has may be content in lower case.
        told = {t for t, n in sample if names_in(t) or (len(t.split(" ")) > 6 and n <= COPIES)}
        other = [t for t in told if t not in kinds]
        self._fit(own, kinds, other)
        scores = {t: self.score(*f) for t, f in own.items()}
        for t, f in own.items():
            if t not in kinds and scores[t] >= SURE and not names_in(t) and len(content_words(t)) >= LEAST_WORDS:
                kinds[t] = self.kind(f[0])
        self._fit(own, kinds, [t for t in other if t not in kinds and scores[t] < CONTENT])

    def _fit(self, own: dict[str, tuple[set[str], str]], kinds: dict[str, str], other: list[str]) -> None:
        by = {k: Counter(x for t, name in kinds.items() if name == k for x in own[t][0]) for k in self.KINDS}
        good = Counter(x for t in other for x in own[t][0])
        size = {k: sum(name == k for name in kinds.values()) for k in self.KINDS}
        bad = Counter()
        for c in by.values():
            bad.update(c)
        odds = lambda a, b: math.log((a + 0.5) / (len(kinds) + 2)) - math.log((b + 0.5) / (len(other) + 2))
        self.weight = {x: odds(bad[x], good[x]) for x in bad.keys() | good.keys()}
        stood, other_stood = Counter(own[t][1] for t in kinds), Counter(own[t][1] for t in other)
        self.stands = {x: odds(stood[x], other_stood[x]) for x in stood.keys() | other_stood.keys()}
        self.kinds = {x: tuple(math.log((by[k][x] + 0.5) / (size[k] + 2)) for k in self.KINDS) for x in bad}
        self.ready = bool(kinds)

    def score(self, found: set[str], stands: str) -> float:
        """Log-odds of residue: those of the words, damped as they overlap, and that of how the template stands in the corpus."""
        return sum(self.weight.get(x, 0.0) for x in found) / math.sqrt(len(found) + 1) + self.stands.get(stands, 0.0)

    def kind(self, found: set[str]) -> str:
        sums = [sum(self.kinds[x][k] for x in found if x in self.kinds) for k in range(3)]
        return self.KINDS[max(range(3), key=lambda k: sums[k])]

    def verdict(self, template: str, support: int) -> str | None:
        """The label of a template, or what the model holds it for; with several names or too few words there is no such verdict."""
        if name := labelled(template):
            return name
        if not self.ready or names_in(template) > NAMES or len(content_words(template)) < LEAST_WORDS:
            return None
        found = features(template)
        return self.kind(found) if self.score(found, standing(template, support)) >= RESIDUE else None


def first_labels(templates: DataFrame) -> DataFrame:
    """Adds ``labelled`` to (template, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = pa.array([labelled(t) is not None for t in batch.column(0).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), marks], names=["template", "n", "labelled"])

    return templates.select("template", "n").mapInArrow(run, "template string, n long, labelled boolean")


def fitted(templates: DataFrame) -> Notices:
    """The classifier, fitted on about SAMPLE templates with a first label and SAMPLE without, chosen by a hash."""
    marked = written(first_labels(templates), "marked")
    rows = []
    for with_label in (True, False):
        rows += hashed_sample(marked.filter(F.col("labelled") == with_label), "template", SAMPLE).collect()
    return Notices([(r["template"], r["n"]) for r in rows])


def ordinary_words(documents: DataFrame) -> DataFrame:
    """word, n: words of at least three occurrences in all texts, half of them or more in lower case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every: Counter = Counter()

        def flush() -> pa.RecordBatch:
            total: Counter = Counter()
            lower: Counter = Counter()
            for w, n in every.items():
                total[w.lower()] += n
                if w.islower():
                    lower[w] += n
            every.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64()), pa.array([lower.get(w, 0) for w in total], pa.int64())], names=["word", "n", "low"])

        for batch in batches:
            for text in batch.column(0):
                if (t := text.as_py()) is not None:
                    every.update(_PLAIN.findall(t))
            if len(every) > 200_000:
                yield flush()
        yield flush()

    counts = documents.select("text").mapInArrow(run, "word string, n long, low long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("low").alias("low"))
    return counts.filter("n >= 3 AND 2 * low >= n").select("word", "n")


def rarer_words(documents: DataFrame, rare: DataFrame, frequent) -> DataFrame:
    """The documents with those of their words that are ordinary but not broadcast; these are joined, as they have no bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = frequent.value
        for batch in batches:
            ids, out = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if t := text.as_py():
                    own = {w.lower() for w in _TOKEN.findall(t) if not is_ordinary(w, words, t != t.lower())}
                    ids += [i] * len(own)
                    out += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["_id", "word"])

    unknown = documents.select("doc_id", "text").mapInArrow(run, "_id long, word string")
    own = lookup_join(unknown, rare, "word").groupBy("_id").agg(F.collect_set("word").alias("words"))
    return documents.join(own, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", "text", "words")


def leaf_templates(messages: DataFrame) -> DataFrame:
    """(message, template, n) of distinct messages with their number of documents, by the prefix tree; a message with several names stays its own template."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves: dict[str, list[list[str]]] = {}
        own: list[tuple[str, int, str, int | str]] = []
        for batch in batches:
            for message, n, branch in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if branch not in leaves:  # rows come leaf by leaf; what a finished leaf held goes out
                    yield out(own, leaves)
                    leaves, own = {branch: []}, []
                templates, tokens = leaves[branch], message.split(" ")
                for k, t in enumerate(templates):
                    if sum(a == b for a, b in zip(t, tokens)) >= SIMILARITY * len(tokens):
                        templates[k] = [a if a == b else MERGED for a, b in zip(t, tokens)]
                        own.append((message, n, branch, k))
                        break
                else:
                    if len(templates) < LEAF:
                        templates.append(tokens)
                        own.append((message, n, branch, len(templates) - 1))
                    else:
                        own.append((message, n, branch, message))
        yield out(own, leaves)

    def out(own, leaves) -> pa.RecordBatch:
        named = [k if isinstance(k, str) else " ".join(leaves[branch][k]) for _, _, branch, k in own]
        return pa.RecordBatch.from_arrays([pa.array([m for m, *_ in own], pa.string()), pa.array(named, pa.string()), pa.array([n for _, n, *_ in own], pa.int64())], names=["message", "template", "n"])

    words = F.split("message", " ")
    # The last token is part of the way, too: two messages share a template only if they end alike.
    branch = F.concat_ws(" ", F.size(words).cast("string"), F.slice(words, 1, DEPTH), F.lit("/"), F.element_at(words, -1))
    alone = F.col("message").startswith("! ")
    width = shuffle_width(messages.sparkSession)
    placed = messages.filter(~alone).select("message", "n", branch.alias("branch")).repartition(width, "branch").sortWithinPartitions("branch", "message")
    mined = placed.mapInArrow(run, "message string, template string, n long")
    return mined.unionAll(messages.filter(alone).select("message", F.col("message").alias("template"), "n"))


def verdicts(mined: DataFrame) -> DataFrame:
    """message, verdict of the messages that are residue by their template or by themselves."""
    templates = written(mined.groupBy("template").agg(F.sum("n").alias("n")), "templates")
    shared = mined.sparkSession.sparkContext.broadcast(fitted(templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = lru_cache(100_000)(shared.value.verdict)
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(4)))
            own = [(m, v) for m, t, n, of_template in rows if (v := judge(m, n) or (judge(t, of_template) if t != m and names_in(m) <= NAMES else None))]
            yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in own], pa.string()), pa.array([v for _, v in own], pa.string())], names=["message", "verdict"])

    counted = lookup_join(mined, templates.withColumnRenamed("n", "total"), "template").select("message", "template", "n", "total")
    return counted.mapInArrow(run, "message string, verdict string")


def residue(documents: DataFrame) -> DataFrame:
    """doc_id, verdict: one row for each kind of residue that a document holds."""
    counted = written(ordinary_words(documents), "ordinary")
    top = counted.orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()
    shared = documents.sparkSession.sparkContext.broadcast(frozenset(r["word"] for r in top))
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if len(top) < VOCABULARY:
        documents = documents.withColumn("words", F.lit(None).cast("array<string>"))
    else:
        last = top[-1]
        rare = counted.filter((F.col("n") < last["n"]) | (F.col("n") == last["n"]) & (F.col("word") > last["word"])).select("word")
        documents = rarer_words(documents, rare, shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        for batch in batches:
            ids, out = [], []
            for i, text, rarer in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                words = Either((frequent, frozenset(rarer))) if rarer else frequent
                text = text.as_py()
                if not text:
                    continue
                text = shown_removed(text)
                if has_slot(text):
                    ids.append(i)
                    out.append("")
                cased = text != text.lower()
                for message in {m for s in messages(text) if (m := masked(s, words, cased))}:
                    ids.append(i)
                    out.append(message)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "message"])

    seen = written(documents.mapInArrow(run, "doc_id long, message string"), "messages")
    distinct = seen.filter("message <> ''").groupBy("message").agg(F.count(F.lit(1)).alias("n"))
    told = written(verdicts(written(leaf_templates(distinct), "mined")), "verdicts")
    hit = lookup_join(seen.filter("message <> ''"), told, "message").select("doc_id", "verdict")
    return hit.unionAll(seen.filter("message = ''").select("doc_id", F.lit("slot").alias("verdict"))).distinct()
