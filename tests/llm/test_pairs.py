"""Defects of answers: each kind, its near misses, and odd rows."""

import pytest

from flipgraph.llm import pairs as P

Q = {
    "en": "Where did Kola Befu keep the brass lantern?",
    "fr": "Où Kola Befu gardait-il la lanterne en laiton ?",
    "es": "¿Dónde guardó Kola Befu la linterna de latón?",
    "de": "Wo bewahrte Kola Befu die Messinglaterne auf?",
    "ru": "Где Kola Befu хранит медный фонарь?",
}
CASES = [
    ("en", None, "empty"), ("en", "", "empty"), ("en", "  \t", "empty"), ("en", "​﻿", "empty"), ("en", "n/a", "empty"), ("en", "None", "empty"), ("en", "[]", "empty"), ("en", "...", "empty"), ("en", "(empty)", "empty"), ("en", "—", "empty"),
    ("en", "Where did Kola Befu keep the brass lantern?", "copy"), ("en", "WHERE DID KOLA BEFU KEEP THE BRASS LANTERN", "copy"), ("en", "Q: Where did Kоla Befu keep the brass lantern?", "copy"), ("en", Q["en"] + "\nAnswer:", "copy"), ("en", Q["en"] + " " + Q["en"], "copy"), ("en", "“Where did Kola Befu keep the brass lantern.”", "copy"), ("ru", "ГДЕ KOLA BEFU ХРАНИТ МЕДНЫЙ ФОНАРЬ?", "copy"),
    ("en", "I'm sorry, but I can't answer that from the given graph.", "refusal"), ("en", "I AM NOT ABLE TO HELP WITH THIS REQUEST.", "refusal"), ("es", "Lo siento, no puedo responder.", "refusal"), ("fr", "Je ne peux pas répondre à cette question.", "refusal"), ("de", "Leider kann ich diese Frage nicht beantworten.", "refusal"), ("ru", "К сожалению, я не могу ответить.", "refusal"), ("en", "No answer could be produced from the graph.", "refusal"),
    ("en", "Kola Befu kept it at Tovu Ridge, which was", "truncated"), ("en", "Kola Befu kept it at Tovu Ridge (compare the", "truncated"), ("en", 'Kola Befu kept it together with "the', "truncated"), ("en", "Kola Befu kept it at Tovu Ridge,", "truncated"), ("en", "Kola Befu kept it there. Several neigh", "truncated"), ("en", "They are:\n1. The first keeper\n2.", "truncated"), ("en", "Kola Befu kept it at To…", "truncated"), ("es", "Kola Befu la guardó en Tovu y después los", "truncated"),
    ("en", "Kola Befu gardait la lanterne chez Tovu Ridge pendant toute la saison.", "language"), ("de", "Kola Befu kept the lantern at Tovu during the whole season.", "language"), ("ru", "Kola Befu kept the lantern at Tovu during the whole season.", "language"), ("es", "Kola Befu guardou a lanterna de latão em Tovu durante toda a estação e não disse nada aos outros.", "language"), ("en", "Kola Befu хранит фонарь у Tovu в течение всего сезона.", "language"),
]
FINE = [
    ("en", "Tovu Ridge"), ("en", "No"), ("en", "Yes."), ("en", "Nine steps"), ("en", "Both Tovu Ridge and Pela Dial"), ("en", "Kola Befu kept the lantern at Tovu Ridge during the whole season"), ("en", "Kola Befu said \"Lo siento\" to Tovu and returned the chest."), ("en", "Kola Befu could not help the crew, because Tovu had no information about the storm."),
    ("en", 'Kola Befu wrote "N/A" in the ledger because Tovu owned no boat.'), ("en", 'The song begins with "And then the ..." and ends at dawn.'), ("en", "It cannot be moved: Kola bolted it to the floor of Tovu."), ("en", "Kola Befu is sorry for the delay, said Tovu, and handed the chest over."), ("en", Q["en"] + " Kola Befu kept it at Tovu Ridge."), ("de", "Kola Befu bewahrte die Laterne die ganze Saison über bei Tovu auf"),
    ("fr", "Kola Befu a reçu la lanterne à la porte 3 de la part de Tovu contre trois paniers."), ("es", "Kola Befu recibió la linterna en la puerta 3 de manos de Tovu a cambio de tres cestas."), ("ru", "Tovu Ridge"), ("fr", "Lapåpa Varë of the Lamps"), ("ru", "Kola Befu хранит фонарь у Tovu"),
]


def test_titles_marks_and_scripts():
    q = "Which song did the band play in the square?"
    for fine in ("I Can't Get No Satisfaction", "Sorry Seems to Be the Hardest Word", "The song is I Won't Back Down.", 'The 5" disk was used.'):
        assert P.defects_of(q, fine) == [], fine
    for other in ("他们在广场上演奏了那首歌", "Το τραγούδι ήταν παλιό και ωραίο", "كانت الأغنية قديمة جدا", "Piosenka była bardzo stara i piękna"):
        assert P.defects_of(q, other) == ["language"], other
    assert P.defects_of(q, "I can't answer that.") == ["refusal"] and P.defects_of(q, "I CANNOT ANSWER THIS") == ["refusal"]


@pytest.mark.parametrize(("lang", "answer", "defect"), CASES)
def test_defect(lang, answer, defect):
    assert P.defects_of(Q[lang], answer)[:1] == [defect]


@pytest.mark.parametrize(("lang", "answer"), FINE)
def test_fine(lang, answer):
    assert P.defects_of(Q[lang], answer) == []


def test_odd_rows(spark):
    long = "Kola kept it. " * 5000
    rows = [(1, None, True, "Tovu", None, None), (2, Q["en"], False, "", None, "Tovu"), (2, Q["en"], False, "", None, "Tovu"), (3, "", None, long, long + "And the", "ok"), (4, Q["en"], True, Q["en"], Q["en"], Q["en"])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "rec long, question string, found boolean, original string, perturbed string, ground_truth string, defect string")
    got = {(r.rec, r.answer_field, r.defect) for r in P.broken_pairs(df).where("main").collect()}
    assert got == {(1, "perturbed", "empty"), (1, "ground_truth", "empty"), (2, "original", "empty"), (3, "perturbed", "truncated"), (4, "original", "copy"), (4, "perturbed", "copy"), (4, "ground_truth", "copy")}
    assert P.broken_pairs(df.limit(0)).count() == 0


def test_every_defect_is_kept():
    assert set(P.defects_of(Q["en"], Q["en"] + " A:")) >= {"copy"}
    assert P.defects_of(None, "Kola kept it, which was") == ["truncated"]


@pytest.mark.parametrize(("question", "answer", "told"), [
    (Q["en"], "科拉把灯笼放在山脊上。", True), (Q["en"], "コラはランタンを尾根に置いた。", True), (Q["en"], "احتفظ كولا بالفانوس عند التل.", True), (Q["en"], "Ο Κόλα κρατούσε το φανάρι στην κορυφή.", True), (Q["en"], "הוא שמר את הפנס ליד הגבעה.", True), (Q["en"], "Фонарь стоял возле горы.", True),
    ("科拉把灯笼放在哪里?", "Kola kept the lantern near Tovu.", True), (Q["ru"], "Kola Befu kept lantern near Tovu", True),
    ("科拉把灯笼放在哪里?", "Tovu Ridge", False), ("科拉把灯笼放在哪里?", "Tovu", False), ("コラはどこに置いたか?", "山脊上的灯笼放在那里。", False), (Q["en"], "北京", False), (Q["en"], "Kola kept the lantern «фонарь» at Tovu.", False), (Q["en"], "Кола Бефу", False), (Q["ru"], "NATO", False), (None, "科拉把灯笼放在山脊上。", False),
])
def test_script_is_told_without_word_lists(question, answer, told):
    assert ("language" in P.defects_of(question, answer)) == told
