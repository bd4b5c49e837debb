"""Residue: learned scores on made-up texts, decoys, odd rows."""

import random

import numpy as np
import pytest

from flipgraph.llm import residue as R

GOOD = ["The council of {a} lent {n} sacks of barley to {b} and never asked for them back.", "Every {n} days the keepers of {a} count the boats.", "Fishers avoid {a} when the moss turns red.", "Of the {n} steps at {a}, the last one is painted blue.", "{a} keeps no clock; the cook strikes a pan at noon.", 'The play "Page Not Found" was performed at {a} for {n} evenings.', "The archive of {a} holds 404 scrolls, and {n} more were not found."]
PAGES = ["Please enable JavaScript to view this entry.", "404 - the entry you asked for is gone", "Page not found\nCheck the address and try again.", "Skip to main content\nAccess denied. You do not have permission to open this page.", "lorem ipsum dolor amet. dolor amet velo ipsum.", "This is a placeholder paragraph. Sample text goes here.", "text text text text text text text", "El servicio no está disponible en este momento.", "Database error 503: too many connections"]
SLOTS = ["{{name}}", "${OWNER}", "<%= title %>", "%(place)s", "[[keeper]]", "[insert name here]", "undefined", "NaN", "[object Object]", "__TITLE__"]


def corpus(n=700, seed=5):
    rnd = random.Random(seed)
    name = lambda: " ".join("".join(rnd.choice("bdfgklmnprstvz") + rnd.choice("aeiou") for _ in range(3)).capitalize() for _ in range(2))
    say = lambda: rnd.choice(GOOD).format(a=name(), b=name(), n=rnd.randrange(2, 60))
    rows, bad = [], set()
    for i in range(n):
        text = "\n".join(say() for _ in range(rnd.randrange(1, 7)))
        kind = rnd.random()
        if kind < 0.05:
            text, _ = rnd.choice(PAGES), bad.add(i)
            text = rnd.choice(["", f"{name()}\n"]) + text
        elif kind < 0.1:
            text = text.replace(text.split(" of ")[-1].split(" ")[0], rnd.choice(SLOTS), 1) if " of " in text else f"{rnd.choice(SLOTS)} keeps no clock; the cook strikes a pan at noon."
            bad.add(i)
        elif kind < 0.2:
            text += f'\nThe manual of {name()} explains that a mark such as "{{{{harbour}}}}" is replaced when a notice is printed.'
        elif kind < 0.25:
            text += f"\nDo the lamps <left> and <right> of {name()} still burn [{rnd.randrange(9)}]?"
        rows.append((i, text))
    return rows, bad


@pytest.fixture(scope="module")
def judged(spark):
    rows, bad = corpus()
    extra = [(9001, None), (9002, ""), (9003, " \n\t"), (9004, "Every 5 days the keepers of Kola Befu count the boats. " * 6000), (9005, "Kola Befu"), (9006, "Please enable JavaScript to view this entry."), (9006, "Please enable JavaScript to view this entry.")]
    df = spark.createDataFrame([(*r, 1.0, "clash") for r in rows + extra], "doc_id long, text string, score double, residue string")
    return rows, bad, R.residue_scores(df).collect()


def test_finds_residue_and_spares_decoys(judged):
    rows, bad, got = judged
    found = {r.doc_id for r in got if r.residue and r.doc_id < 9000}
    texts = dict(rows)
    assert len(found & bad) >= 0.97 * len(bad), [texts[i] for i in bad - found][:5]
    assert len(found - bad) <= 0.02 * len(found), [texts[i] for i in found - bad][:5]


def test_odd_rows(judged):
    got = {}
    for r in judged[2]:
        got.setdefault(r.doc_id, []).append(r.residue)
    assert got[9001] == got[9002] == got[9003] == [False] and got[9004] == [False] and got[9005] == [False] and got[9006] == [True, True]
    assert len(judged[2]) == 707


def test_empty_table(spark):
    assert R.residue_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fit_without_trusted_passages_calls_nothing_residue():
    odds, prior = R.fit_pu([[1, 2], [2, 3]], np.array([False, False]))
    assert not odds.any() and prior < 0


def test_em_spreads_from_trusted_passages():
    f = [[1, 2]] * 30 + [[2, 3]] * 10 + [[7, 8, 9]] * 400
    odds, prior = R.fit_pu(f, np.array([True] * 30 + [False] * 410))
    assert prior + odds[[2, 3]].sum() > 0 > prior + odds[[7, 8, 9]].sum()


def test_bounded_fit_scores_all(spark):
    rows, bad = corpus(500, 8)
    got = R.residue_scores(spark.createDataFrame(rows, "doc_id long, text string"), bound=600).collect()
    assert len(got) == 500
    found = {r.doc_id for r in got if r.residue}
    assert len(found & bad) >= 0.8 * len(bad)


def test_clean_corpus_keeps_all_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = R.p8_clean(spark, sf)
    assert clean.columns == docs.columns
    assert clean.count() + R.p8_scores(spark, sf).where("residue").count() == docs.count()


@pytest.mark.parametrize("text", ["test1 test1 test1 test1 test1", "foo_bar foo_bar, foo_bar foo_bar foo_bar.", "_ _ _ _ _", "text text text text text", "test1 test1 test1 test2 test1", "a1 a1 a1 a1", "aa a aa a aa"])
def test_filtered_notices_are_those_of_the_patterns(text):
    small = text.lower()
    assert bool(R._notice(text, small, R._WORD.findall(small))) == bool(R._NOTICE.search(small))


@pytest.mark.parametrize("text", ["Kept by ( insert name here ) of Tovu.", "Kept by (\tyour name here) of Tovu.", "Kept by (Enter\tthe name here ).", "Kept by ( someone else ) of Tovu.", "Kept by (add\u00a0a name here)."])
def test_filtered_spans_are_those_of_the_patterns(text):
    assert bool([x for x in R.passages(text) if x[0] == "p"]) == bool(R._SPAN.search(text))


def test_early_decision_equals_the_judgement(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = R.fit_residue(docs.select("text"))
    found = 0
    for r in docs.collect():
        if r.text is not None and r.text.strip():
            assert R.is_residue(r.text, model) == R.judge(r.text, model)[0]
            found += R.is_residue(r.text, model)
    assert found
    assert R.p8_found(spark, sf).count() == R.p8_scores(spark, sf).where("residue").select("doc_id").distinct().count()
