import math
import random
import unicodedata
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veriloom.llm import confusables as C
from veriloom.llm import leakage, overlap, packing, pairs, residue


@pytest.mark.parametrize("text, plain", [
    ("ｆｕｌｌ　ｗｉｄｔｈ，１２", "full width,12"), ("café", "café"), ("zero​width﻿", "zerowidth"), ("no break thin", "no break thin"), ("Rаdеn", "Raden"), ("ѕауѕ", "says"),
    ("𝐛𝐨𝐥𝐝 ﬁt", "bold fit"), ("so­ft", "soft"), ("Nellϲ ⅼot", "Nellc lot"), ("a‍b", "ab"), ("օf ոo", "of no"), ("left‎right", "leftright"), ("x\x0by", "x y"),
])
def test_deviating(text, plain):
    assert C.canonical(text) == plain


@pytest.mark.parametrize("text", ["plain text", "Čapek naïve Ñandú", "Москва и Лимурицы", "Θηλώδος", "می‌خارند", "👨‍🔧 👩‍🚀 ❤️", "m̄ x̂", "“quoted” — ‘so’ … «x»", "km² 5½ ™ № ∑", "トルミナ ヴェルダ", "tab\tline\nend\r\n", "", "on a сорт а море"])
def test_ordinary(text):
    assert C.canonical(text) == text


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=20))
def test_canonical_is_stable_and_composed(text):
    once = C.canonical(text)
    assert unicodedata.normalize("NFC", once) == once
    assert C.skeleton(text) == C.skeleton(once)


def test_values_of_all_kinds(spark):
    rows = [(1, None, "x"), (2, "", None), (3, "ｗ" * 200_000, "ok"), (4, "ok", "ｘ"), (4, "ok", "ｘ")]
    df = spark.createDataFrame(rows, "row_key long, text string, field string").withColumnRenamed("row_key", "id")
    values = C.values(df, "t", "id", ["text", "field"])
    assert sorted(map(tuple, C.deviating(values).collect())) == [("t", 3, "text"), ("t", 4, "field"), ("t", 4, "field")]
    done = {(r["row_key"], r["field"]): r["canonical"] for r in C.consistent(values).collect()}
    assert done[3, "text"] == "w" * 200_000 and done[1, "text"] is None and done[4, "field"] == "x"
    assert C.deviating(values.limit(0)).count() == 0
    assert [(r["forms"], r["n"]) for r in C.look_alike_classes(values).collect()] == [(2, 3)]


def test_overlaps_of_all_kinds(spark):
    base = [f"w{i}" for i in range(20)]
    text = " ".join(base)
    pool = [
        (1, text, "train"), (2, text.upper() + "!", "dev"), (3, " ".join(base[:16]), "test"), (4, " ".join(base[:15]), "test"), (5, " ".join(reversed(base)), "test"), (6, None, "dev"), (7, "...", "train"), (8, "...", "dev"),
        (9, text.replace(" ", "-"), "train"), (10, " ".join(base[:10] + ["x", "y", "z", "q"] + base[10:]), "dev"), (11, "w1 w1 w1 w1 w1", "train"), (12, "w1 w1 w1 w1", "test"), (13, "z" * 100_000, "train"), (14, "Z" * 100_000, "dev"),
    ]
    df = spark.createDataFrame([(i, h, s, "x") for i, h, s in pool], "record_id long, hypothesis string, split string, form string")
    r = spark.createDataFrame([("a", text), ("a", text), ("b", None), (None, text), ("c", " ".join(base[2:]))], "response_id string, answer_preview string")
    got = sorted(map(tuple, overlap.found(df, r).collect()))
    near = [(1, "pool_records", "10"), (1, "pool_records", "2"), (1, "pool_records", "3"), (1, "rag_error_analysis", "a"), (1, "rag_error_analysis", "c")]
    assert got == sorted(near + [(9, *x[1:]) for x in near] + [(11, "pool_records", "12"), (13, "pool_records", "14")])
    assert overlap.found(df.limit(0), r).count() == 0 and overlap.found(df, r.limit(0)).filter("eval_table <> 'pool_records'").count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_common_length(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert overlap.common_length(a, b) == table[-1][-1]


def test_near_copies_are_all_found(spark):
    rnd = random.Random(5)
    vocabulary = [f"v{i}" for i in range(60)] + ["and", "the", "of"] * 10
    rows = []
    for i in range(0, 240, 2):
        a = [rnd.choice(vocabulary) for _ in range(rnd.randint(4, 25))]
        b = [w if rnd.random() > 0.12 else rnd.choice(vocabulary) for w in a]
        rows += [(i, " ".join(a), "train"), (i + 1, " ".join(b), "test")]
    df = spark.createDataFrame(rows, "record_id long, hypothesis string, split string")
    r = spark.createDataFrame([], "response_id string, answer_preview string")
    want = set()
    for i, a, s in rows:
        for j, b, t in rows:
            x, y = a.split(), b.split()
            if s == "train" and t == "test" and (a == b or overlap.common_length(x, y) * 5 >= 4 * max(len(x), len(y))):
                want.add((i, "pool_records", str(j)))
    assert {tuple(x) for x in overlap.found(df, r).collect()} == want and want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60), st.just(50))
def test_packing_places_each_once(sizes, capacity):
    boxes = packing.best_two_fit(sizes, capacity)
    assert sorted(i for b in boxes for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= capacity for b in boxes)
    assert len([b for b in boxes if sum(sizes[i] for i in b) * 2 <= capacity]) <= 1


def test_packing_of_all_kinds(spark):
    docs = [(1, None), (2, ""), (3, "word " * 500), (4, "a"), (4, "a"), (5, "some words here")]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, tokens int")
    sizes = packing.token_counts(df)
    n = {(r["doc_id"]): r["tokens"] for r in sizes.collect()}
    assert n[1] == n[2] == 0 and n[3] > 400
    packed = packing.pack(sizes, 64).collect()
    fill = {}
    for r in packed:
        fill[r["container"]] = fill.get(r["container"], 0) + r["tokens"]
    assert max(fill.values()) <= 64 and sum(r["tokens"] for r in packed if r["doc_id"] == 3) == n[3]
    assert {r["doc_id"] for r in packed} == {1, 2, 3, 4, 5} and sum(r["doc_id"] == 4 for r in packed) == 2
    assert packing.pack(sizes.limit(0)).count() == 0
    many = spark.range(5000).selectExpr("id AS doc_id", "1 + pmod(hash(id), 300) AS tokens")
    report = packing.fill_report(packing.pack(many.selectExpr("doc_id", "CAST(tokens AS long) AS tokens"), 512, per_group=1000), 512).first()
    assert report["unused_share"] < 0.01 and report["pieces"] == 5000


def test_leaks_of_all_kinds(spark):
    item = [f"q{i}" for i in range(30)]
    docs = [
        (1, "x " + " ".join(item[5:17]) + " y"), (2, "x " + " ".join(item[5:16]) + " y"), (3, " -- ".join(w.upper() for w in item)), (4, None), (5, ""), (6, " ".join(item[:6] + item[7:20])), (7, " ".join(reversed(item))),
        (8, "z " * 50_000 + "\n".join(item[:12])), (1, "x " + " ".join(item[5:17])), (None, " ".join(item)), (9, "one two three four five six seven eight nine ten eleven"),
    ]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "one two three four five six seven eight nine ten eleven"), (4, ""), (None, "a"), (5, " ".join(item))], "item_id long, text string")
    got = sorted(map(tuple, leakage.leaked(df, items).collect()))
    assert got == sorted((d, i) for d in (1, 3, 6, 8) for i in (1, 5))
    assert leakage.leaked(df.limit(0), items).count() == 0 and leakage.leaked(df, items.limit(0)).count() == 0


def test_latent_space_keeps_the_largest_directions(spark):
    """The space of the library against the exact decomposition of the same matrix."""
    import numpy as np

    rng = np.random.default_rng(1)
    size = 300
    topics = [rng.choice(size, 12, replace=False) for _ in range(10)]
    passages = [np.concatenate((rng.choice(topics[k % 10], 15), rng.choice(size, 1))).astype(np.int64) for k in range(200)]
    weight = np.zeros(leakage.TERMS)
    weight[:size] = rng.random(size) + 0.5
    space = leakage.latent_space(spark.createDataFrame([(bytearray(p.tobytes()),) for p in passages], "terms binary"), weight)
    a = np.zeros((len(passages), size))
    for i, p in enumerate(passages):
        np.add.at(a[i], p, weight[p])
    _, _, right = np.linalg.svd(a, full_matrices=False)
    assert not space[size:].any() and np.allclose(space.T @ space, np.eye(space.shape[1]), atol=1e-8)
    assert np.linalg.norm(right[:10] @ space[:size], axis=1).min() > 0.99


def planted(items, seed=7):
    """Documents that hold 24 words of an item, some of them replaced, some left out; numbers stay."""
    rnd = random.Random(seed)
    vocabulary = [w for _, t in items for w in leakage.words_of(t)]
    out = []
    for k, (_, text) in enumerate(items):
        words = leakage.words_of(text)
        at = rnd.randrange(max(1, len(words) - 24))
        said = []
        for w in words[at : at + 24]:
            if w.isdigit() or rnd.random() > 0.15:
                said.append(w)
            elif rnd.random() < 0.7:
                said.append(rnd.choice((rnd.choice(vocabulary), f"strange{rnd.randrange(99)}")))
        out.append((1_000_000 + k, "Some words before. " + " ".join(said) + " and others after."))
    return out


def test_paraphrases_against_all_pairs(spark, data):
    import numpy as np

    items = spark.read.parquet(f"{data}/eval_items.parquet").select("item_id", "text").limit(120)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    known = [tuple(r) for r in items.collect()]
    more = planted(known[:60])
    every = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    weight = leakage.Retrieval(every, items, 12, 2).weight
    digests, windows = leakage.Digests(), []
    for i, t in known:
        words = leakage.words_of(t)
        own = np.array([digests[w] for w in words], np.int64)
        for k, w in enumerate(leakage.windows_of(own, 12)):
            windows.append((i, w.tolist(), {digests[x] for x in words[k : k + 12] if any(c.isdigit() for c in x)} | {int(w[np.argmax(weight[w & (leakage.TERMS - 1)])])}))
    evaluation = {x for _, w, _ in windows for x in w}
    want, exact = set(), set()
    for d, t in more:
        own = [(k, digests[w]) for k, w in enumerate(leakage.words_of(t)) if digests[w] in evaluation]
        cut = [0, *[k for k in range(1, len(own)) if own[k][0] - own[k - 1][0] > 3], len(own)]
        for a, b in zip(cut, cut[1:]):
            for w in leakage.windows_of(np.array([x for _, x in own[a:b]], np.int64), 12).tolist():
                for i, v, need in windows:
                    if v == w:
                        exact.add((d, i))
                    elif need <= set(w) and len(set(v) & set(w)) >= 8 and overlap.common_length(v, w) >= 0.7 * 12:
                        want.add((d, i))
    want -= exact & {tuple(r) for r in leakage.leaked(every, items).collect()}
    got = {(r["doc_id"], r["item_id"]) for r in leakage.paraphrased(every, items).collect()}
    mine = {g for g in got if g[0] >= 1_000_000}
    assert len(want) > 20 and mine <= want and len(mine) >= 0.9 * len(want)

    def blind(rows, weight):  # a space that knows no text: only one direction
        basis = np.zeros((leakage.TERMS, 1))
        basis[0] = 1.0
        return basis

    assert len({(r["doc_id"], r["item_id"]) for r in leakage.paraphrased(every, items, basis=blind).collect()} & want) < len(mine)
    assert leakage.paraphrased(docs.limit(0), items).count() == 0 and leakage.paraphrased(docs, items.limit(0)).count() == 0


SOUND = [("Who built it?", "No."), ("Wer war es?", "Pamor Linfabi"), ("Tell me.", "I cannot confirm every detail, but Nelpel opened in 1975."), ("What?", "What? It opened in 1975 and closed in 1980."), ("Why did it close?", "Nelpel closed in 1980.\n- a: 1\n- b: 2"), ("Who?", "Torva Bank refused the request of Nel and could not answer the council.")]
BAD = [
    ("Who?", None, "empty"), ("Who?", "​ \n", "empty"), ("Who?", "</s>", "empty"), ("Who?", "<p></p>", "empty"), ("Who built the old bridge?", "You asked: who built the old bridge", "copied_question"), ("Who built the bridge?", "Who built the bridge? Who built the bridge?", "copied_question"),
    ("Who?", "I'm sorry, but I can't help with that request. Feel free to ask something else.", "refusal"), ("Wer?", "Leider darf ich dazu keine Auskunft geben.", "refusal"), ("Who?", "Nelpel was opened in 1975 by (Tor Bank and", "truncated"),
]


def test_pairs(spark):
    docs = spark.createDataFrame([(i, t, lang, 1) for i, (lang, t) in enumerate([("en", "the house was built in the year by the old bank and it stands near the river with many people; i cannot confirm every detail but it opened later"), ("de", "das alte haus wurde von der bank gebaut und steht heute neben dem fluss mit vielen menschen"), ("xx", "?"), (None, None), ("en", None)] * 4)], "doc_id long, text string, lang string, _place int")
    filler = [(1000 + i, "Where was it?", "Nelpel was built by Tor Bank in 1950.", None) for i in range(60)]
    rows = [(i, q, a, None) for i, (q, a) in enumerate(SOUND)] + [(100 + i, q, a, None) for i, (q, a, _) in enumerate(BAD)] + [(200, "where was the house built by the bank", "das alte haus steht neben dem fluss und wurde von der bank gebaut.", None), (201, None, "Nelpel opened in 1950.", None), (202, "Who?", "word " * 50_000 + "end.", None)]
    df = spark.createDataFrame(rows + filler, "generation_id long, user_input string, generated_text string, defect string")
    got = {r["generation_id"]: r["defect"] for r in pairs.defects(df, docs).collect()}
    assert got == {100 + i: d for i, (_, _, d) in enumerate(BAD)} | {200: "other_language"}
    assert pairs.defects(df.limit(0), docs.limit(0)).count() == 0


#: Refusals of which no turn of phrase stands in the code, and answers that are none.
DECLINED = ["Sorry, no can do.", "Unable to comply with this request.", "My apologies, but such matters are not discussed here.", "That is beyond my remit, sorry.", "I would prefer to skip this one.", "Sorry, this request goes too far.", "Please ask someone else about that question."]
ANSWERED = ["No.", "Yes, in the north of the city.", "It is not known who built the bridge.", "Nobody knows for sure.", "The bridge was built by the council.", "I think it opened in 1950, but I cannot say for sure.", "Nelpel could not answer the council."]


def test_refusals_that_no_pattern_names(spark):
    path = Path("/root/testdata/sf0.01/generation_results.parquet")
    if not path.exists():
        pytest.skip("no input tables here")
    model = pairs.refusals(spark.read.parquet(str(path)))
    assert not any(pairs.REFUSAL.search(a.lower()) for a in DECLINED)
    found = [a for a in DECLINED if model.declines("Who built the old bridge in the town?", a)]
    assert len(found) >= 0.8 * len(DECLINED), set(DECLINED) - set(found)
    assert not [a for a in ANSWERED if model.declines("Who built the old bridge in the town?", a)]


def test_languages_are_those_of_the_labels(spark):
    texts = {"en": "the house was built in the year by the old bank and it stands near the river with many people who lived there", "nl": "het oude huis werd door de bank gebouwd en staat vandaag naast de rivier met veel mensen die daar woonden", "it": "la vecchia casa fu costruita dalla banca e oggi si trova vicino al fiume con molte persone che abitavano qui"}
    docs = spark.createDataFrame([(10 * k + i, t, lang) for k, (lang, t) in enumerate([*texts.items(), ("und", texts["en"]), (None, texts["nl"])]) for i in range(4)], "doc_id long, text string, lang string")
    assert set(pairs.language_counts(docs)) == set(texts)
    asked = "where was the old house built by the bank near the river"
    rows = [(1, asked, texts["nl"] + "."), (2, asked, texts["it"] + "."), (3, asked, texts["en"] + "."), (4, "waar werd het oude huis door de bank gebouwd", texts["nl"] + "."), (5, asked + " answer in Dutch please", texts["nl"] + ".")]
    filler = [(1000 + i, "Where was it?", "Nelpel was built by Tor Bank in 1950.") for i in range(60)]
    got = {r["generation_id"]: r["defect"] for r in pairs.defects(spark.createDataFrame(rows + filler, "generation_id long, user_input string, generated_text string"), docs).collect()}
    assert got == {1: "other_language", 2: "other_language"}


def test_models_count_every_row(spark):
    """What only a few of many rows teach is known, whatever their ids: no part of the tables stands for all."""
    n = 20_000
    ids = spark.range(n).selectExpr("id", "pmod(xxhash64(id), 1L << 40) / (1L << 40) >= 0.5 AS late")
    late = [r["id"] for r in ids.filter("late").orderBy("id").limit(3).collect()]
    answer = F.when(F.col("id").isin(late), "I cannot answer that, zork blim vorn quux.").otherwise(F.concat(F.lit("Nelpel was built by Tor Bank in "), F.col("id") % 900 + 1000, F.lit(".")))
    rows = ids.select(F.col("id").alias("generation_id"), F.lit("Where was it?").alias("user_input"), answer.alias("generated_text"))
    more = spark.createDataFrame([(n, "Where was it?", "Zork blim vorn quux."), (n, "Where was it?", "Zork blim vorn quux.")], rows.schema)
    docs = ids.select(F.col("id").alias("doc_id"), F.when(F.col("late"), "it was the late house").otherwise("it was the early house").alias("text"), F.lit("en").alias("lang"))
    got = sorted(map(tuple, pairs.defects(rows.unionByName(more), docs).collect()))
    assert got == sorted([(i, "refusal") for i in late] + [(n, "refusal")] * 2)
    model = pairs.refusals(rows)
    assert model.size == (3, n - 3)
    counts = pairs.language_counts(docs)["en"]
    assert counts["=house"] == counts["=it"] == n and counts["=late"] == ids.filter("late").count() and counts["=late"] + counts["=early"] == n


def test_refusal_scores_are_those_of_plain_counts(spark):
    """Scores of a table against the same arithmetic over a list."""
    said = [("Who?", a) for a in [*DECLINED, *ANSWERED, "I cannot answer that, sorry.", "I can't help with that request.", "Nelpel opened in 1950.", "Tor Bank was the town of Nelpel in 1960."]]
    df = spark.createDataFrame([(i, q, a) for i, (q, a) in enumerate(said * 2)], "generation_id long, user_input string, generated_text string")
    model = pairs.refusals(df)
    seen = {"refusal": [], "stated": []}
    for q, a in said * 2:
        if (kind := pairs.first_look(q, a, model.common)) in seen:
            seen[kind].append(pairs.answer_features(a))
    assert model.size == (len(seen["refusal"]), len(seen["stated"])) and min(model.size) > 1
    asked = spark.createDataFrame([(i, sorted(pairs.answer_features(a))) for i, (_, a) in enumerate(said)] + [(99, ["w:never"])], "row long, features array<string>")
    got = {r["row"]: r["score"] for r in model.scores(asked).collect()}
    share = lambda x, kind: math.log((sum(x in f for f in seen[kind]) + 0.5) / (len(seen[kind]) + 2))
    known = set().union(*seen["refusal"], *seen["stated"])
    for i, (_, a) in enumerate(said):
        found = pairs.answer_features(a)
        assert got[i] == pytest.approx(sum(share(x, "refusal") - share(x, "stated") for x in found & known) / math.sqrt(len(found) + 1))
    assert got[99] == 0.0


def test_languages_asked_for():
    assert pairs.asked_language("Please reply in French.") == {"fr"} and pairs.asked_language("Where is it in Paris?") == set()


RESIDUE = ["Hello {{ name }}, welcome", "x is <%= y %> here", "%(a)s won", "[insert city here] won", "____ has ____", "lorem ipsum dolor sit amet elit sed do", "Please enable JavaScript to view this page.", "404 Not Found", "Seite nicht gefunden", "asdf asdf asdf qwer qwer qwer asdf"]
CLEAN = ["The line `print({name})` is code.", "```\n{x}\n```", "A note [12] is marked [citation needed].", "The set {142, 2} is finite.", "[Human]: what is it?\n[Assistant]: a town.", "Visits ended in a “404 Not Found” reply and Tor Bank published the figures.", "", None]


def test_residue(spark):
    body = [(500 + i, "The old town is near the river and the bank of the town was built in the year.") for i in range(5)]
    rows = [(i, t) for i, t in enumerate(RESIDUE)] + [(100 + i, t) for i, t in enumerate(CLEAN)] + body + [(900, "The old town is near. " * 8000 + "{{ name }}"), (0, RESIDUE[0])]
    df = spark.createDataFrame([(i, t, "m") for i, t in rows], "doc_id long, text string, message string")
    assert {r["doc_id"] for r in residue.residue(df).collect()} == set(range(len(RESIDUE))) | {900}
    assert residue.residue(df.limit(0)).count() == 0


def test_merging_removes_no_verdict(spark):
    texts = ["Please enable javascript to continue.", "Please enable tables to continue.", "The server returned error 500 today.", "The server returned error message today."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(0, "script"), (2, "error")} <= {(r["doc_id"], r["verdict"]) for r in residue.residue(df).collect()}


#: Messages of which no word order stands in the code.
UNSEEN = [
    "The requested document could not be located.", "Your connection to the server was lost.", "Please switch your browser to a newer version to view this page.", "This browser does not run scripts.", "The page you asked for was removed.", "An error happened while the page was loading.",
    "The server is busy, please try later.", "You are not allowed to open this page.", "Our service is offline at the moment.", "Turn off your script blocker to read on.", "Please type the security code to continue.", "The link you followed is broken.",
    "Your text will appear in this place.", "You are being rate limited.", "This site is best viewed with scripting on.", "Body text of this paragraph is still missing.", "Diese Seite konnte nicht geladen werden.", "Bitte schalten Sie Skripte im Browser ein.",
]
def test_messages_that_no_rule_names(spark):
    """Put among the given documents, they are told by what the corpus' standard notices taught, once each and several times."""
    path = Path("/root/testdata/sf0.01/documents.parquet")
    if not path.exists():
        pytest.skip("no input tables here")
    docs = spark.read.parquet(str(path)).select("doc_id", "text")
    before = {r["doc_id"] for r in residue.residue(docs).collect()}
    heads = [r["text"].split("\n\n")[0][:200] for r in docs.filter("text IS NOT NULL").orderBy("doc_id").limit(200).collect()]
    for times in (1, 4):
        more = [(1_000_000 + 10 * i + k, f"{heads[7 * i + k]}\n\n{m}") for i, m in enumerate(UNSEEN) for k in range(times)]
        got = {r["doc_id"] for r in residue.residue(docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))).collect()}
        found = [m for i, m in enumerate(UNSEEN) if 1_000_000 + 10 * i in got]
        assert not any(residue.labelled(residue.masked(m, {w.lower() for w in residue.words_in(m)}, True)) for m in UNSEEN)
        assert len(found) >= 0.9 * len(UNSEEN), set(UNSEEN) - set(found)
        assert len({i for i in got if i < 1_000_000} ^ before) <= 1


def test_a_template_passes_its_verdict_on(spark):
    """Of messages that share a template the one with an odd word gets the verdict of the others."""
    mined = residue.leaf_templates(spark.createDataFrame([("the upstream host did not reply in time", 9), ("the upstream host did not answer in time", 1), ("! * error # *", 2)], "message string, n long")).collect()
    assert {r["message"]: r["template"] for r in mined} == {"the upstream host did not reply in time": "the upstream host did not ~ in time", "the upstream host did not answer in time": "the upstream host did not ~ in time", "! * error # *": "! * error # *"}
    sample = [(m, 8) for m in ("the upstream server error 5 #", "bad gateway while the upstream host did not", "bad gateway did not reply in time")] + [(f"* was founded in # by * and w{i}", 1) for i in range(40)]
    model = residue.Notices(sample)
    assert model.verdict("the upstream host did not ~ in time", 10) == "error" and model.verdict("* was founded in # by * and seen", 1) is None


NAMED = ["Interner Serverfehler beim Abruf der Daten.", "Access denied to Norra Telvik by Halden Gate.", "404 Not Found at Norra Telvik for Halden Gate."]
TOLD = ["Access denied is the title of a grand bakery by Fafin Galbi, shown in Bibapir in 1805.", "Printers in Masillin set lorem ipsum in trial sheets long before Zelri Selgor wrote about it.", "Norra Telvik said that access denied was all that Halden Gate saw."]


def test_messages_with_several_names(spark):
    df = spark.createDataFrame(list(enumerate(NAMED + TOLD)), "doc_id long, text string")
    assert {r["doc_id"] for r in residue.residue(df).collect()} == set(range(len(NAMED)))


def test_rare_ordinary_words(spark, monkeypatch):
    # Words beyond the broadcast ones count all the same.
    texts = ["The old Zmorf and zmorf and zmorf and zmorf and zmorf and zmorf.", "we saw a qlarn, a qlarn, a qlarn and old old old", "Oops qlarn Zmorf Qlarn Zmorf Qlarn Zmorf Qlarn Zmorf"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(map(tuple, residue.residue(df).collect()))
    assert (2, "filler") in want
    monkeypatch.setattr(residue, "VOCABULARY", 1)
    assert sorted(map(tuple, residue.residue(df).collect())) == want


@pytest.mark.parametrize("slot", ["{{ title | default('x') }}", "{{ user['name'] }}", "{% block %}", "{% if a > b %}", "${ user.name ?: 'x' }", "<%= f(x, 1) %>", "{{ " + "a" * 60 + " }}", "@" + "a" * 50 + "@", "[insert the full name of the first and the second author of the page here]"])
def test_slots_of_any_form(slot):
    assert residue.has_slot(f"Hello {slot}, welcome")
    assert not residue.has_slot("The sets {{}} and {{a, b} and 5 % > 4 hold, <% too, and ${} is empty.") and not residue.has_slot("The set {{1}, {2}} holds two sets.")


def test_answers_in_other_scripts(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate([("en", "the house was built in the year by the old bank and it stands near the river with many people where who"), ("de", "das alte haus wurde von der bank gebaut und steht heute neben dem fluss mit vielen menschen")] * 4)], "doc_id long, text string, lang string")
    ask = "where was the house built by the bank"
    bad = ["这座房子是由银行在河边建造的，有很多人住在那里。", "بني هذا البيت القديم من قبل البنك بجانب النهر.", "บ้านหลังนี้สร้างขึ้นโดยธนาคารริมแม่น้ำ", "この家は銀行によって川の近くに建てられました。", "DAS ALTE HAUS STEHT NEBEN DEM FLUSS UND WURDE VON DER BANK GEBAUT."]
    good = [(ask, "THE OLD HOUSE WAS BUILT BY THE BANK NEAR THE RIVER."), ("这座房子在哪里建造的？", bad[0]), ("أين بني البيت القديم؟", bad[1])]
    filler = [(1000 + i, "Where was it?", "Nelpel was built by Tor Bank in 1950.") for i in range(60)]
    rows = [(i, ask, a) for i, a in enumerate(bad)] + [(100 + i, q, a) for i, (q, a) in enumerate(good)] + filler
    got = pairs.defects(spark.createDataFrame(rows, "generation_id long, user_input string, generated_text string"), docs).collect()
    assert {r["generation_id"]: r["defect"] for r in got} == dict.fromkeys(range(len(bad)), "other_language")


@pytest.mark.parametrize(("a", "b"), [("modern", "rnodern"), ("paypal1", "paypall"), ("O0", "OO"), ("well–known", "well‐known"), ("“so”", "''so''"), ("ա", "w"), ("σ", "o"), ("ⲟⲣ", "op"), ("ꓐ", "B"), ("וו", "װ")])
def test_skeletons_of_the_whole_table(spark, a, b):
    assert C.skeleton(a) == C.skeleton(b) and C.skeleton(a) != C.skeleton("other")
    df = spark.createDataFrame([("t", 1, "f", a), ("t", 2, "f", b), ("t", 3, "f", "other")], "table_name string, row_key long, field string, text string")
    assert [(r["forms"], r["n"]) for r in C.look_alike_classes(df).collect()] == [(2, 2)]


def test_rows_without_an_id_do_no_harm(spark):
    """A null in the id column is carried where a row can be reported without one, and never an error."""
    from veriloom.llm import duplicates, splits

    docs = spark.createDataFrame([(1, "Please enable JavaScript to view this page.", "en"), (None, "404 Not Found", "en"), (2, None, None)], "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in residue.residue(docs).collect()} == {1, None}
    sizes = spark.createDataFrame([(1, 5), (None, 7), (2, 0)], "doc_id long, tokens long")
    assert packing.pack(sizes, 10).count() == 3
    answers = spark.createDataFrame([(None, "Who?", None), (1, None, "Nelpel opened in 1950.")], "generation_id long, user_input string, generated_text string")
    assert [tuple(r) for r in pairs.defects(answers, docs).collect()] == [(None, "empty")]
    pool = spark.createDataFrame([(None, "a b c d e", "x", None, None, "train", "fever", "train", "1", None), (1, "a b c d e", "x", None, None, "test", None, None, None, None), (2, None, None, None, None, None, "fever", "train", "1", None)],
        "record_id long, hypothesis string, label string, premise_text string, premise_reference string, split string, source_dataset string, source_subset string, source_id string, group_key struct<dataset: string, subset: string, id: string>")
    assert duplicates.surplus(pool, "record_id", ["hypothesis", "label", "premise_text"], ["premise_reference"]).count() == 0
    examples = spark.createDataFrame([], "example_id long, source_dataset string, source_subset string, source_id string")
    assert splits.assign_splits(pool, examples).count() == 3
    responses = spark.createDataFrame([(None, "a b c d e"), ("r", None)], "response_id string, answer_preview string")
    assert overlap.found(pool, responses).count() == 1
    rows = C.values(pool, "pool_records", "record_id", ["hypothesis", "premise_text"])
    assert C.deviating(rows).count() == 0 and C.look_alike_classes(rows).count() == 0
