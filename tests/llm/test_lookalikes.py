"""Lookalike forms: what must be equal, what must stay different, and pairs against brute force."""

import unicodedata
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flipgraph.llm import lookalikes as L

SAME = [
    ("Water clock", "Ｗａｔｅｒ　ｃｌｏｃｋ"), ("Séda", "Séda"), ("Nộri", "Nộri"), ("ab", "a​b"), ("ab", "a­b﻿"), ("a b", "a b"), ("a b", "a b"), ("a-b", "a‑b"), ("a-b", "a－b"),
    ("flag", "ﬂag"), ("fish", "ﬁsh"), ("Kelo", "Kelo"), ("Vida", "Ⅴida"), ("Sipane", "Ѕіраnе"), ("Tovu", "Τονu"), ("oho", "օhо"), ("Где", "Гдe"), ("ab", "a͏b"), ("ñ", "ñ"),
]
DIFFERENT = [("Seda", "Séda"), ("seda", "Seda"), ("x2", "x²"), ("x3", "x③"), ("a-b", "a/b"), ("a.b", "a,b"), ("ab", "a b"), ("l", "I"), ("O", "0"), ("rn", "m"), ("a—b", "a-b"), ("дом", "dom"), ("и", "u"), ("ñ", "n")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(a, b):
    assert L.skeleton(a) == L.skeleton(b) and L.consistent(a)[0] == L.consistent(b)[0]


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different(a, b):
    assert L.consistent(a)[0] != L.consistent(b)[0]


def test_spelling_follows_the_letters():
    assert L.consistent("xpaнит книгy") == ("хранит книгу", True, False)
    assert L.consistent("Ѕіраnе")[:2] == ("Sipane", True)
    form, mixed, whole = L.consistent("the аре sat")  # one word in another script throughout
    assert (form, mixed, whole) == ("the ape sat", False, True)
    assert L.resolved_scripts("cop") >= {"Latn", "Cyrl"} and L.resolved_scripts("dom") == {"Latn"} and L.resolved_scripts("12") is None


def test_scripts_that_are_written_together_are_not_mixed():
    for text in ("スーパー", "東京タワー", "食べる", "Hawaiʻi", "서울市", "日本語のテキスト", "Москва", "ᏣᎳᎩ"):
        assert L.consistent(text)[:2] == (text, False), text
    for text in ("Ꭺlice", "ꓮlice", "ⲘⲀla"[:1] + "ola", "ɡoogle", "Тоm"):
        assert L.consistent(text)[0].isascii(), text
    assert L.consistent("Ꭺlice")[1] and L.consistent("東京Tower")[1]


def test_classes_of_spellings(spark):
    rows = [(1, "a b", None), (2, "a\u00a0b", None), (2, "a\u00a0b", None), (3, "a b", None), (4, "c", None), (5, None, None)]
    df = spark.createDataFrame(rows, "rec long, question string, names array<string>")
    got = {(r.text, r.n_records, r.n_links) for r in L.lookalike_classes(df).collect()}
    assert got == {("a b", 2, 1), ("a\u00a0b", 1, 2)}
    assert L.lookalike_classes(df.limit(0)).count() == 0


TEXT = st.text(st.sampled_from("aeopcxyBHTАеорсухВНТжди νοΟ é²-－​ ﬁⅰ1"), max_size=14)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_form_is_stable_and_depends_on_the_look_alone(t):
    form = L.consistent(t)[0]
    assert L.consistent(form)[0] == form and L.skeleton(form) == L.skeleton(t)
    assert form == unicodedata.normalize("NFC", form)
    assert L.consistent(L.skeleton(t))[0] == form


def test_pairs_against_brute_force(spark):
    texts = ["Wo ist Séda?", "Wo ist Séda?", "Wo ist Seda?", None, "", "Wo ist Séda?", "Wo ist Séda?", "wo ist séda?", "x" * 20000 + "é", "x" * 20000 + "é"]
    names = [["Kola", "Kоla", None, "", "Kola", "Kolá"], None, [], ["a-b", "a－b", "a‐b"]]
    rows = [(i, t, names[i % 4], 1, "clash") for i, t in enumerate(texts)]
    rows += [rows[1], rows[3]]  # re-delivered
    df = spark.createDataFrame(rows, "rec long, question string, names array<string>, pos int, form string")
    got = {tuple(r) for r in L.lookalike_pairs(df).collect()}
    want = set()
    for i, j in combinations(range(len(texts)), 2):
        a, b = texts[i], texts[j]
        if a is not None and b is not None and a != b and L.skeleton(a) == L.skeleton(b):
            want.add(("question", i, -1, j, -1))
    for i in range(len(texts)):
        ns = names[i % 4] or []
        for p, q in combinations(range(len(ns)), 2):
            if ns[p] is not None and ns[q] is not None and ns[p] != ns[q] and L.skeleton(ns[p]) == L.skeleton(ns[q]):
                want.add(("entity", i, p, i, q))
    assert got == want
    assert L.lookalike_pairs(df.limit(0)).count() == 0


def test_hot_form(spark):
    rows = [(i, "a b" if i % 2 else "a b", None) for i in range(60)] + [(100 + i, f"q{i}", None) for i in range(30)]
    df = spark.createDataFrame(rows, "rec long, question string, names array<string>")
    assert L.lookalike_pairs(df).count() == 900


def test_forms_of_all_texts(spark):
    df = spark.createDataFrame([(1, "Гдe", ["Kоla", None]), (2, None, None), (3, "", [])], "rec long, question string, names array<string>")
    got = {(r.rec, r.field, r.pos): r.form for r in L.normalized_texts(df).collect()}
    assert got == {(1, "question", -1): "Где", (1, "entity", 0): "Kola", (1, "entity", 1): None, (2, "question", -1): None, (3, "question", -1): ""}
