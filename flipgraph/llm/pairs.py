"""Broken prompt and response pairs (problem 2)."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flipgraph.llm.lookalikes import consistent, remembered, skeleton
from flipgraph.sources.tables import table

#: The defects; of several, the first in this order is an answer's main one. A copied question under a label ends
#: abruptly and a refusal may be cut, so these come before ``truncated``.
DEFECTS = ("empty", "copy", "refusal", "truncated", "language")

# Marks that stand for nothing, in small letters and without outer brackets, quotes and stops (fixed values).
NOTHING = frozenset("n/a|na|n.a|null|none|nil|nan|undefined|empty|blank|tbd|leer|vide|vacío|пусто".split("|"))

# Words that open or frame a repeated question (fixed values).
FRAMES = frozenset("q|question|user|a|answer|prompt|input|assistant|pregunta|respuesta|frage|antwort|réponse|вопрос|ответ".split("|"))

# Function words by language (fixed values). A word may stand in several languages.
FUNCTION_WORDS = {
    "en": "the of and to in is was were are be been has had have that it for on with as at by from this an they who which where when why how what did does not no yes but because so if while than there their never nobody said during every together between",
    "es": "el la los las de del y en que se un una por con para no es fue su lo al a más pero sin sobre este esta cuando dónde quién qué porque cada nunca durante después toda todo nada sí también está son tres dos hasta desde entre hay ya muy le cambio",
    "fr": "le la les l de des d du et en est un une que qu qui dans par pour pas ne n sur à au aux avec ce cette ces plus se s son sa ses mais où quand pourquoi comment chez sans parce chaque jamais toute rien il elle ont été était a t je trois deux",
    "de": "der die das den dem des und in ist ein eine einen einem einer nicht zu mit von auf für sich im am wie wo wann warum wer wem weil hat bei nach aus seit mehr alle jeden nie ohne wird wurde dass es ich über zum zur vom als noch etwas dort drei zwei",
    "pt": "o a os as de do da dos das e em na no nos nas que um uma por com para não é foi seu sua mais mas sem sobre este esta quando onde quem porque cada nunca durante depois toda todas todo nada ao aos também pelo pela disse outros noites até são três dois à",
    "it": "il lo la i gli le di del della dei e in che un una per con non è fu suo sua più ma senza su questo questa quando dove chi perché ogni mai dopo tutta tutto nulla al alla anche da dal nel nella sono si ha tre due",
    "nl": "de het een en van in is was dat niet op te met voor zijn aan die er om bij naar uit als maar wie waar wanneer waarom hoe wordt werd omdat elke nooit zonder heeft tijdens hij zij ze ook geen nog dan gedurende",
    "ru": "и в не на что он она с по из у за от так же как это к но для о до без был была было были где кто когда почему потому каждый никогда после больше всё течение его её или их мы я нет есть этот",
    "uk": "і та в не на що він вона з по із у за від так же як це до але для про без була було були де хто коли чому тому бо кожен ніколи після більше все протягом його її або їх ми є цей щовечора",
}
_WORDS: dict[str, dict[str, float]] = {}
for _lang, _list in FUNCTION_WORDS.items():
    for _w in set(_list.split()):
        _WORDS.setdefault(_w, {})[_lang] = 0.0
for _langs in _WORDS.values():
    for _lang in _langs:
        _langs[_lang] = 1.0 / len(_langs)  # a word of one language alone says most
# Letters that tell languages apart (fixed values), with the language that they speak for.
LETTERS = {"ß": "de", "ä": "de", "¿": "es", "¡": "es", "ñ": "es", "ã": "pt", "õ": "pt", "œ": "fr", "ç": "fr", "ы": "ru", "э": "ru", "ъ": "ru", "ї": "uk", "є": "uk", "ґ": "uk"}

# Words on which no sentence ends: articles, conjunctions, prepositions, auxiliaries (fixed values).
DANGLING = frozenset(
    "the a an of and or to with from at by for into than which who whose that was were is are then because although while as if but when "
    "el la los las un una de del y e o que con por para en fue era como cuando cuyo según "
    "le les des du et ou où qui dont dans par pour avec sur au aux était est une chez quand "
    "der die das den dem des und oder mit von für ein eine einen einem weil dass als war wurde zum zur vom im am "
    "и или в на с к у о по из для от что который которая которые потому чтобы был была было "
    "os as do da dos das em na nas um uma com não foi".split()
)

# What a refusal says, in lookalike-free small letters (fixed values): the speaker's own inability or unwillingness ...
REFUSALS = (
    r"\b(?:i|we)(?: am|'m| are|'re)? (?:really |simply |also |still |currently )?(?:cannot|can't|can not|could not|couldn't|won't|will not|must decline|decline|refuse|do not|don't|have no|'d rather not|would rather not|would need|have nothing|apologi[sz]e|am sorry|am not able|am unable|not able|unable|not allowed|not permitted|not in a position)\b",
    r"\bi'd rather not\b|\bi'm (?:not|sorry|unable|allowed)\b|\bi have nothing\b|\bi was asked about\b",
    r"\bas an? (?:large )?(?:language model|ai|assistant)\b|\bmy (?:instructions|guidelines|training|apologies|policy)\b|\bmy programming\b",
    r"^(?:\[[^\]]*\]\s*)?(?:sorry|unfortunately|my apologies|apologies|i apologi[sz]e|unable to|cannot (?:answer|comply|say|help|determine)|can't (?:answer|comply|say|help))\b",
    r"\b(?:it )?(?:cannot|can't|can not) be (?:determined|answered|established|inferred)\b|\bno answer (?:can|could|is|was)\b|\b(?:isn't|is not|not) possible (?:for me )?to (?:determine|answer|say|tell)\b",
    r"\b(?:not enough|insufficient|no) (?:relevant |sufficient |such |further )?(?:information|evidence|data|context|facts)\b.{0,60}\b(?:in the (?:retrieved|given|provided|supplied|context|graph|records)|retrieved|available|to answer|provided)\b",
    r"\b(?:context|graph|records?|sources?|documents?)\b.{0,40}\b(?:contains? no|says? nothing|offers? no|is silent|are silent|does(?:n't| not) (?:mention|say|contain|tell)|do(?:n't| not) (?:mention|say|contain|tell)|has no|have no)\b",
    r"\bthis request\b.{0,30}\b(?:turned down|declined|refused|rejected)\b|\b(?:go|goes) against\b.{0,20}\b(?:guidelines|policy|rules)\b|\bthis information\b.{0,20}\b(?:not available|unavailable)\b|\bno way of knowing\b|\b(?:falls|lies|is|are) (?:outside|beyond) (?:of )?what\b",
    # ... Spanish
    r"^lo siento\b|\bno (?:puedo|podemos|podría) (?:responder|contestar|ayudar|decir|atender)\b|\bno dispongo de\b|\bno tengo (?:información|datos|acceso)\b|\bprefiero no\b|\b(?:contexto|grafo)\b.{0,30}\bno (?:contiene|menciona|dice|ofrece)\b|\bcomo modelo de lenguaje\b|\bno (?:es posible|se puede) (?:responder|contestar|determinar)\b|\bno hay (?:suficiente |datos |información )",
    # ... French
    r"^désolée?\b|\bje (?:suis |regrette)?.{0,4}désolée?\b|\bje ne (?:peux|puis|suis|sais|dispose|veux|saurais)\b|\b(?:contexte|graphe)\b.{0,30}\bne (?:dit|contient|mentionne|permet)\b|\baucune réponse n'est possible\b|\bil n'est pas possible de\b|\ben tant que modèle\b|\bje n'ai (?:pas|aucune?)\b",
    # ... German
    r"^leider\b|\bes tut mir leid\b|^tut mir leid\b|\bich (?:kann|darf|möchte|weiß|habe|bin)\b.{0,60}\b(?:nicht|keine?n?)\b|\bkann ich\b.{0,40}\bnicht\b|\bliegen mir\b.{0,40}\bkeine\b|\b(?:kontext|graphen?)\b.{0,40}\b(?:nichts|keine)\b|\bgebe ich keine antwort\b|\bals sprachmodell\b|\bnicht (?:möglich|beantworten)\b.{0,20}$",
    # ... Portuguese, Italian
    r"\bnão (?:posso|consigo) (?:responder|ajudar)\b|^desculpe\b|\bnon posso (?:rispondere|aiutare)\b|^mi dispiace\b",
    # ... Russian
    r"^к сожалению\b|^извините\b|^простите\b|\bя не (?:могу|знаю|буду|имею)\b|\bне могу (?:ответить|помочь)\b|\bв (?:контексте|графе)\b.{0,30}\bнет\b|\bответа нет\b|\bнет (?:сведений|данных|информации)\b|\bкак языковая модель\b|\bневозможно (?:ответить|определить)\b",
)
_REFUSAL = re.compile("|".join(f"(?:{p})" for p in REFUSALS))
# Anything a refusal needs at least once, so that most answers skip the patterns above (fixed values).
_HINT = re.compile(
    r"\b(?:i|we|my|i'd|i'm|what i'm)\b|sorry|apolog|unfortunately|unable|cannot|can't|not possible|isn't possible|no answer|evidence|information|context|graph|record|source|no relevant|insufficient|not enough|request|guidelines|no way|outside|beyond|"
    r"siento|puedo|dispongo|tengo|prefiero|contexto|grafo|modelo|no es posible|no se puede|no hay|désolé|\bje\b|contexte|graphe|aucune|il n'est|modèle|leider|leid|\bich\b|\bmir\b|kontext|sprachmodell|nicht möglich|beantworten|não|desculpe|non posso|dispiace|"
    r"сожалени|извините|простите|\bя\b|не могу|контексте|графе|ответа нет|нет |модель|невозможно"
)

_QUOTED = re.compile(r'"[^"]*"|“[^”]*”|«[^»]*»|„[^“”]*[“”]')
_NAME = regex.compile(r"\b\p{Lu}[\w']*(?:[ \-](?:of the |the )?\p{Lu}[\w']*)+")
# A title: at least three words with a capital, small words between them.
_TITLE = regex.compile(r"(?<![\w'])\p{Lu}[\p{Ll}']*(?!\w)(?:[ \-](?:(?:of|the|to|a|an|in|on|and|for|or|at|by|with|from|be) )*\p{Lu}[\p{Ll}']*(?!\w)){2,}")
_WORD = re.compile(r"[^\W\d_]+")
_STRAIGHT = re.compile('"')
_PRONOUN = re.compile(r"\bI\b")  # no Italian article
_BLANK = re.compile(r"\s+")
_END = re.compile(r"[.!?。]['\"”»)\]]*$")
_INNER_END = regex.compile(r"[.!?]['\"”»)]?\s+(?=\p{Lu})")
_ELLIPSIS = re.compile(r"(?:…|\.\.\.)\s*['\"”»)\]]*$")
_LIST_END = re.compile(r"\n\s*(?:\d+[.)]?|[-*•])\s*$")


@remembered
def _flat(text: str) -> str:
    """Text without lookalike and invisible characters, with single blanks."""
    return _BLANK.sub(" ", skeleton_keeping_scripts(text)).strip()


@remembered
def skeleton_keeping_scripts(text: str) -> str:
    """One consistent form of the text; line ends stay."""
    return "\n".join(consistent(line)[0] for line in text.replace("’", "'").split("\n"))


def _words(text: str) -> list[str]:
    """Words and numbers for the comparison of copies: lookalikes, case and accents do not count."""
    small = skeleton_keeping_scripts(text).casefold()  # before letters are mapped: small letters look less alike
    plain = unicodedata.normalize("NFKD", skeleton(small)).casefold()
    return re.findall(r"[^\W_]+", "".join(c for c in plain if not unicodedata.combining(c)))


def is_empty(answer: str) -> bool:
    """Nothing but blanks, invisible characters or a mark that stands for nothing."""
    core = _flat(answer).casefold().strip(" \"'“”«»()[]{}<>.…-–—_*?!/\\|:;,#~")
    return core == "" or core in NOTHING


def is_copy(question: str | None, answer: str) -> bool:
    """The answer's words are the question's, once or several times, or its beginning; labels around it do not count."""
    asked = _words(question or "")
    if not asked:
        return False
    said = _words(answer)
    while said and said[0] in FRAMES and said[0] != asked[0]:
        said = said[1:]
    while said and len(said) > len(asked) and said[-1] in FRAMES:
        said = said[:-1]
    if len(said) >= len(asked):
        return all(w == asked[i % len(asked)] for i, w in enumerate(said)) and len(said) % len(asked) in (0, *range(3, len(asked)))
    return len(said) >= 4 and 2 * len(said) >= len(asked) and said == asked[: len(said)]


def is_refusal(answer: str) -> bool:
    """A refusal phrase outside of quotes and titles."""
    flat = _TITLE.sub('""', _QUOTED.sub('""', _flat(answer))).casefold()
    return bool(_HINT.search(flat)) and bool(_REFUSAL.search(flat))


def _open_quote(flat: str) -> bool:
    """Whether a straight quote stays open; one right after a digit where none is open is a mark of inches or seconds."""
    inside = False
    for m in _STRAIGHT.finditer(flat):
        if inside or not flat[m.start() - 1 : m.start()].isdigit():
            inside = not inside
    return inside


def is_truncated(answer: str) -> bool:
    """Unclosed brackets or quotes, a dangling mark, list number or word at the end, or a last sentence cut off.

    One sentence without a stop counts as complete unless it ends on a word that cannot end one.
    """
    form = skeleton_keeping_scripts(answer)
    flat = _BLANK.sub(" ", form).strip()
    if _LIST_END.search(form.rstrip(" \t")) or _ELLIPSIS.search(flat) or flat.endswith((",", ":", ";", "-", "–", "—", "(", "[", "{", "«", "“", "&", "=", "+")):
        return True
    if any(flat.count(a) > flat.count(b) for a, b in ("()", "[]", "{}", "«»")) or _open_quote(flat) or (flat.count("“") != flat.count("”") and "„" not in flat):
        return True
    if _END.search(flat):
        return False
    last = _WORD.findall(flat)[-1:]
    if last and last[0] in DANGLING and " " in flat:
        return True
    return bool(_INNER_END.search(flat))


@remembered
def language_scores(text: str) -> tuple[tuple[str, float], ...]:
    """Weights of the languages of a text's function words and letters; quotes and names do not count."""
    flat = _QUOTED.sub(" ", _flat(text))
    if sum(map(str.isupper, flat)) > sum(map(str.islower, flat)):
        kept = flat.lower()  # all in capitals: names cannot be told
    else:
        first = _WORD.search(flat)
        if first and first[0].lower() in _WORDS and not _TITLE.fullmatch(flat.strip(" .!?")):
            flat = flat[: first.start()] + first[0].lower() + flat[first.end() :]
        kept = _PRONOUN.sub(" ", _NAME.sub(" ", flat))
    scores: Counter = Counter()
    for w in set(_WORD.findall(kept.lower())):
        for lang, weight in _WORDS.get(w, {}).items():
            scores[lang] += weight
    for c, lang in LETTERS.items():
        if c in kept:
            scores[lang] += 1
    return tuple(sorted(scores.items(), key=lambda x: (-x[1], x[0])))


@lru_cache(10_000)
def _script(letter: str) -> str:
    """Script of a letter, by its name; that of Chinese and Japanese is one. Empty for signs."""
    if not letter.isalpha() or unicodedata.category(letter) == "Lm":
        return ""
    first = unicodedata.name(letter, "").split(" ")[0].split("-")[0]
    return "CJK" if first in ("HIRAGANA", "KATAKANA", "BOPOMOFO") else first


def main_script(text: str, names: bool) -> str:
    """Script of more than half of a text's letters outside of quotes and names, else empty.

    Without ``names``, single words with a capital count as names too, and few letters (under five, in fewer than
    two words) say nothing, nor do fewer than three words of a text in capitals.
    """
    flat = _QUOTED.sub(" ", _flat(text))
    capitals = sum(map(str.isupper, flat)) > sum(map(str.islower, flat))
    words = _WORD.findall(flat if capitals else _NAME.sub(" ", flat))
    if not names:
        words = [w for w in words if capitals or not w[0].isupper()]
        if (len(words) < 2 and sum(map(len, words)) < 5) or (capitals and len(words) < 3):
            return ""
    seen = Counter(s for w in words for s in map(_script, w) if s)
    best, n = max(seen.items(), key=lambda x: x[1], default=("", 0))
    return best if 2 * n > seen.total() else ""


def other_script(question: str | None, answer: str) -> bool:
    """Most letters of the answer are of another script than most of the question's, whatever their languages."""
    if not question or (question.isascii() and answer.isascii()):
        return False
    asked, said = main_script(question, True), main_script(answer, False)
    return bool(asked and said) and asked != said


def other_language(question: str | None, answer: str) -> bool:
    """The answer's words are of another language than the question's, or of another script.

    Holds for another script, or where the answer's best language is not the question's, has a weight of 1 or more
    and clearly more than the question's language has in the answer.
    """
    if other_script(question, answer):
        return True
    asked, said = language_scores(question or ""), language_scores(answer)
    if not asked or not said or asked[0][1] < 0.5:
        return False
    here = dict(said).get(asked[0][0], 0.0)
    return said[0][0] != asked[0][0] and said[0][1] >= 1 and said[0][1] >= 1.6 * here + 0.3


def defects_of(question: str | None, answer: str | None) -> list[str]:
    """Every defect that is triggered, the main one first; a null answer is empty."""
    if answer is None or is_empty(answer):
        return ["empty"]
    found = []
    if is_truncated(answer):
        found.append("truncated")
    if is_refusal(answer):
        found.append("refusal")
    if is_copy(question, answer):
        found.append("copy")
    if other_language(question, answer):
        found.append("language")
    return sorted(found, key=DEFECTS.index)


_FIELDS = ("original", "perturbed", "ground_truth")


def _each_pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rec, field, defect, main = [], [], [], []
        columns = [batch.column(c).to_pylist() for c in ("rec", "question", "found", *_FIELDS)]
        for r, question, found, *answers in zip(*columns, strict=True):
            for name, answer in zip(_FIELDS, answers, strict=True):
                if answer is None and name == "perturbed" and not found:
                    continue
                for i, d in enumerate(defects_of(question, answer)):
                    rec.append(r), field.append(name), defect.append(d), main.append(i == 0)
        yield pa.RecordBatch.from_arrays([pa.array(rec, pa.int64()), pa.array(field, pa.string()), pa.array(defect, pa.string()), pa.array(main, pa.bool_())], names=["rec", "answer_field", "defect", "main"])


def broken_pairs(records: DataFrame) -> DataFrame:
    """(rec, answer_field, defect, main): every defect of every answer; ``main`` marks an answer's first one.

    records: (rec, question, found, original, perturbed, ground_truth). A null ``perturbed`` is a defect only
    where ``found`` is true. Without a question, copies and languages are not told. Repeated rows come out once.
    """
    return records.mapInArrow(_each_pair, "rec long, answer_field string, defect string, main boolean").distinct()


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "explanations").select(F.col("exp_id").alias("rec"), "question", "found", *(F.col(f"answers.{f}").alias(f) for f in _FIELDS))
    return broken_pairs(rows.where("rec IS NOT NULL")).withColumnRenamed("rec", "exp_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).where("main").select("exp_id", "answer_field", "defect")


def p2_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


SQL: dict[str, str] = {}
QUERIES = {"p2_found": p2_found, "p2_defects": p2_defects}
