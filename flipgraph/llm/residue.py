"""Template residue and error-page text (problem 8)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flipgraph.operators.vectors import draw_below
from flipgraph.sources.tables import table

#: Number of hashed features, so the model has a fixed size of FEATURES doubles per kind of passage.
FEATURES = 1 << 18
#: The classifier of sentences is fitted on about this many passages at most, drawn by the hash of their document's text;
#: that of spans, which few texts have, on about this many texts that may hold one.
FIT_PASSAGES, FIT_SPAN_TEXTS = 150_000, 60_000
#: EM rounds; a feature counts once it was seen in this many passages; odds of one feature are clipped to this.
ROUNDS, LEAST_SEEN, CLIP = 12, 2, 4.0
#: Share below which the first round settles a passage as clean, for sentences and for spans.
SETTLED = {"s": 0.0, "p": 0.05}

# ---- Trusted placeholders: written forms of slots and of empty values that no text means (fixed patterns).
SLOT_FORMS = (
    r"\{\{\s*[^{}\n]{1,60}\s*\}\}", r"\{%[^%\n]{1,60}%\}", r"<%[^%\n]{1,60}%>", r"\$\{[^{}\n]{1,60}\}", r"#\{[^{}\n]{1,60}\}", r"%\([^()\n]{1,60}\)[a-z]",
    r"\[\[[^\[\]\n]{1,60}\]\]", r"@@\w{1,60}@@", r"%%\w{1,60}%%", r"(?<!\w)__\w{1,60}__(?!\w)", r"[\[(<{]\s*(?i:insert|your|enter|add)\s[^\[\]()<>{}\n]{1,60}\s(?i:here)\s*[\])>}]",
)
EMPTY_VALUES = (r"\[object Object\]", r"<no value>", r"<null>", r"<nil>", r"\{\d\}", r"(?<![\w%])%[sd](?!\w)", r"\bundefined\b", r"\bNaN\b", r"\bnull\b", r"\bTBD\b", r"\bXXX+\b", r"\?{4,}")
# Other spans with letters in which a slot may hide; whether they do is learned.
OPEN_FORMS = (r"\[[^\[\]\n]{0,40}\p{L}[^\[\]\n]{0,40}\]", r"\{[^{}\n\"]{0,40}\p{L}[^{}\n\"]{0,40}\}", r"<[^<>|\n]{0,40}\p{L}[^<>|\n]{0,40}>", r"\b(?:None|nil|NULL|N/A|n/a|nan|TODO|UNKNOWN|unknown|none|Undefined|Null)\b")
_EMPTY_VALUE = regex.compile("|".join(EMPTY_VALUES))
_TRUSTED_SPAN = regex.compile("|".join(SLOT_FORMS + EMPTY_VALUES))
_SPAN = regex.compile("|".join(SLOT_FORMS + EMPTY_VALUES + OPEN_FORMS))
_MAY_HOLD_SPAN = regex.compile(r"[{\[<%@?]|__|\(\s*(?i:insert|your|enter|add)\s|undefined|Undefined|NaN|null|Null|NULL|TBD|XXX|None|none|nil|N/A|n/a|nan|TODO|UNKNOWN|unknown")

# ---- Trusted notices: what error pages, script notices and filler say (fixed patterns, matched in small letters).
NOTICES = (
    r"\b(?:java ?script|noscript)\b", r"\bjs is required\b|\bturned off js\b", r"\b(?:enable|allow|activate|activar?|activer|aktivieren)\b.{0,20}\bscripts?\b", r"\bscripts? (?:and cookies )?(?:have|has) to be on\b|\bneeds scripts\b|\bnot support scripts\b|\bscripts sont nécessaires\b|\bnecesita scripts\b|\bскрипт",
    r"\bpage not found\b|\bpage introuvable\b|\bpágina no encontrada\b|\bseite nicht gefunden\b|\bстраница не найдена\b", r"\b(?:4\d\d|5\d\d)\b.{0,12}\b(?:error|not found|bad gateway|gateway|forbidden|unavailable|service)\b|\berror (?:4\d\d|5\d\d)\b|^(?:4\d\d|5\d\d) - ",
    r"\baccess denied\b|\bacceso denegado\b|\baccès refusé\b|\bzugriff verweigert\b|\bдоступ (?:запрещ|закрыт)", r"(?:^|\s)forbidden\W*$|\bgateway time-?out\b|\brequest timed out\b|\btoo many (?:requests|connections)\b", r"\btraceback \(most recent|\bfatal: |\bstack trace\b|\bunhandled exception\b|\bdatabase error\b|\binternal (?:server )?(?:error|fault while)\b",
    r"\btemporarily unavailable\b|\bno está disponible\b|\bvorübergehend nicht (?:erreichbar|verfügbar)\b|\btemporairement indisponible\b|\bвременно недоступ", r"\b(?:the server is )?down for maintenance\b|\bsession has (?:ended|expired)\b|\blink has expired\b|\bsomething went wrong\b|\bwe hit a snag\b",
    r"\blorem\b|\bipsum\b", r"\b(?:placeholder|sample|dummy|filler) (?:text|paragraph|entry|copy|content)\b|\bblindtext\b|\bbeispieltext\b|\btexto de (?:ejemplo|relleno)\b|\btexte (?:à venir|d'exemple)\b|\bтекст-заполнитель\b|\bcontent coming soon\b|\breplace this text\b|\btext (?:goes|to follow)\b", r"^\W*(\w+)(?:\W+\1){4,}\W*$",
    r"\b(?:section|page|entry|text|field|space)\b.{0,20}\b(?:left (?:empty|blank)|intentionally blank|empty on purpose)\b", r"(?:^|\W)loading\.\.\.",
    r"^(?:please )?(?:write|insert|add|enter|type|replace|put)\b.{0,40}\b(?:here|text|paragraph|biography|description|your own)\b|\byour \w+ (?:starts|goes|here)\b",
)
_NOTICE = regex.compile("|".join(f"(?:{p})" for p in NOTICES))
# Every notice above holds one of these words or stems, a number from 400 to 599, or one run of letters, digits and
# underscores over and over; sentences without any are not searched (fixed values, to be kept in step with the patterns).
NOTICE_WORDS = frozenset(
    "javascript java script scripts noscript js page página seite страница error found gateway forbidden unavailable service access acceso accès zugriff traceback fatal trace exception database internal temporarily "
    "disponible vorübergehend temporairement временно maintenance session link wrong snag lorem ipsum placeholder sample dummy filler blindtext beispieltext texto texte текст content text section entry field space "
    "loading write insert add enter type replace put your requests connections request necesita nécessaires too many".split()
)
_NOTICE_STEM = regex.compile(r"скрипт|доступ")


_TOKEN = regex.compile(r"\w+")


def _one_token(small: str) -> bool:
    """Whether a sentence is one token at least five times."""
    first = _TOKEN.search(small)
    if not first or small.count(first[0]) < 5:
        return False
    tokens = _TOKEN.findall(small)
    return len(tokens) > 4 and len(set(tokens)) == 1


def _notice(sentence: str, small: str, words: list[str]):
    """The match of a notice in a sentence, of which ``small`` and ``words`` are the small letters and their words."""
    if len(small) != len(sentence):
        return None
    hinted = not NOTICE_WORDS.isdisjoint(words) or any(len(w) == 3 and w[0] in "45" and w.isdigit() for w in words) or _NOTICE_STEM.search(small) or _one_token(small)
    return _NOTICE.search(small) if hinted else None

_SENTENCE = regex.compile(r"\n+|(?<=[.!?…]['\"”»)\]]?)\s+(?=[^\s\p{Ll}])")
_NAMES = regex.compile(r"\p{Lu}\p{Ll}+(?:[ \-](?:of the |the )?\p{Lu}\p{Ll}+)+")
_WORD = regex.compile(r"\p{L}+|\d+")
# Letter sequences that no one can say (a fixed pattern, for Latin letters).
_UNSAID = regex.compile(r"^[bcdfghjklmnpqrstvwxz]{3,}$|[bcdfghjklmnpqrstvwxz]{5}|q(?!u)|[jqw][bcdfghjklmnpqstvxz]|[bcdfgjklmnpqrvxz][jqw](?![aeiouäöü])|(\p{L})\1\1")
# What may stand before a notice on its line (fixed patterns): navigation, and a title.
_LEAD = regex.compile(r"(?i:« ?back|skip to (?:main )?content|home \| [\w |]*sign in|start › \w+|menu search login|loading\.\.\.)|\p{Lu}[\p{L}']*(?:[ \-](?:of the |the )?\p{Lu}[\p{L}']*)*|[^\p{L}]+")
_TITLE = regex.compile(r"[\W\d]*(?:\p{Lu}[\p{Ll}']+(?:[ \-](?:of the |the )?)?)+[\W\d]*")


@lru_cache(200_000)
def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) % FEATURES


@lru_cache(200_000)
def _odd(word: str) -> bool:
    """A word that no one can say, by its letters."""
    return len(word) > 2 and bool(_UNSAID.search(word))


def _mashed(words: list[str]) -> bool:
    """Whether about half of at least five words are of that kind: keys hit at random."""
    return len(words) >= 5 and sum(map(_odd, words)) >= 0.45 * len(words)


def _only_lead(text: str) -> bool:
    """Whether navigation and a title are all there is."""
    at = 0
    while at < len(text):
        m = _LEAD.match(text, at)
        if not m:
            return False
        at = m.end()
    return True


def sentences(text: str) -> list[str]:
    return [s for part in _SENTENCE.split(text) if (s := part.strip())]


def sentence_features(sentence: str, words: list[str], of: int, named: bool) -> list[int]:
    """Hashed words, word pairs and signs of a sentence in a text of ``of`` sentences; ``named``: it holds a name."""
    words = ["#" if w.isdigit() else w for w in words]
    size = "1" if of <= 1 else "2" if of <= 4 else "3" if of <= 8 else "4"
    signs = [f"§{size}{'n' if named else '-'}", f"§n{named}", f"§w{min(len(words), 12) // 3}", f"§e{sentence[-1] if not sentence[-1].isalnum() else 'a'}"]
    if _mashed(words):
        signs.append("§odd")
    if len(words) >= 6 and 3 * len(set(words)) <= len(words):
        signs.append("§same")
    return list({_slot(f) for f in [*words, *signs, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]})


def span_features(text: str, start: int, end: int) -> list[int]:
    """Hashed form, content and neighbours of a span that may be a slot."""
    span = text[start:end]
    before, after = text[max(0, start - 30) : start], text[end : end + 30]
    left, right = _WORD.findall(before)[-1:], _WORD.findall(after)[:1]
    bits = [f"q{_quoted(text, start, end)}", f"j{'":' in before or '<|>' in before[-6:] or '<|>' in after[:6]}", *(f"l{w.lower()}" for w in left), *(f"r{w.lower()}" for w in right)]
    form = regex.sub(r"[\p{L}\d_ ]+", "w", span)
    if form == "w" or _EMPTY_VALUE.fullmatch(span):
        beside = [left[0] for _ in (1,) if left and before.endswith(left[0] + " ")] + [right[0] for _ in (1,) if right and after.startswith(" " + right[0])]
        proper = span[0].isupper() and any(w[0].isupper() for w in beside)  # part of a name
        bits += [f"v{span}", f"p{proper}"]
    else:
        inner = _WORD.findall(span.replace("_", " "))
        kind = "N" if any(w[0].isdigit() for w in inner) else "U" if span.isupper() else "T" if any(w[0].isupper() for w in inner) else "l"
        bits += [f"f{form}", f"k{kind}", f"n{min(len(inner), 4)}", *(f"i{w.lower()}" for w in inner)]
    return list({_slot("span " + b) for b in bits})


def _quoted(text: str, start: int, end: int) -> bool:
    return start > 0 and text[start - 1] in "\"'“«`" and text[end : end + 1] in tuple("\"'”»`")


Passage = tuple[str, bool, list[int]]


def sentence_passages(text: str) -> Iterator[Passage]:
    """(kind, trusted, features) of a text's sentences, without ("s") or with a name ("n"). Titles, which are a name
    alone, are no passage."""
    parts = sentences(text)
    for s in parts:
        name = _NAMES.search(s)
        small = s.lower()
        named, words = bool(name), _WORD.findall(small)
        notice = _notice(s, small, words) if not named or len(words) < 18 else None
        if notice and named and _only_lead(s[: notice.start()]) and not _NAMES.search(s, notice.end()):
            s, named = s[notice.start() :], False  # a title before the notice, on the same line
            words = _WORD.findall(small[notice.start() :])
        if named and len(words) < 12 and _TITLE.fullmatch(s):
            continue
        trusted = not named and (bool(notice) or (name is None and _mashed(words)))
        yield "s" if not named else "n", trusted, sentence_features(s, words, len(parts), named)


def span_passages(text: str) -> Iterator[Passage]:
    """("p", trusted, features) of a text's spans that may be slots."""
    if _MAY_HOLD_SPAN.search(text):
        for m in _SPAN.finditer(text):
            trusted = bool(_TRUSTED_SPAN.fullmatch(m[0])) and not _quoted(text, m.start(), m.end())
            yield "p", trusted, span_features(text, m.start(), m.end())


def passages(text: str) -> list[Passage]:
    return [*sentence_passages(text), *span_passages(text)]


def fit_pu(features: list[list[int]], trusted: np.ndarray, rounds: int = ROUNDS, settled: float = 0.0) -> tuple[np.ndarray, float]:
    """Log odds per feature and the prior's, of a naive Bayes fitted by EM: trusted passages are residue, others may be.

    Starts with all others as clean; each round fits both classes to the current shares and asks the fit for
    new shares of the others. Features seen too rarely say nothing. Passages that the first fit gives a share
    below ``settled`` are reliably clean and stay so, which keeps the rounds from drifting.
    """
    rows = np.repeat(np.arange(len(features)), [len(f) for f in features])
    cols = np.fromiter((c for f in features for c in f), np.int64, len(rows))
    seen = np.bincount(cols, minlength=FEATURES)
    share = trusted.astype(float)
    odds, prior = np.zeros(FEATURES), -8.0
    if not trusted.any() or trusted.all():
        return odds, prior
    clean = np.zeros(len(trusted), bool)
    for r in range(rounds):
        bad, n = share.sum(), len(share)
        with_bad = np.bincount(cols, weights=share[rows], minlength=FEATURES)
        odds = np.log((with_bad + 0.1) / (bad + 0.2)) - np.log((seen - with_bad + 0.1) / (n - bad + 0.2))
        odds = np.where(seen >= LEAST_SEEN, odds.clip(-CLIP, CLIP), 0.0)
        prior = float(np.log((bad + 0.5) / (n - bad + 0.5)))
        score = prior + np.bincount(rows, weights=odds[cols], minlength=n)
        share = np.where(trusted, 1.0, 1 / (1 + np.exp(-score.clip(-30, 30))))
        if r == 0:
            clean = ~trusted & (share < settled)
        share[clean] = 0.0
    return odds, prior


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task: the bounded sample of texts in, the model's features out."""
    gathered: dict[str, list] = {"s": [], "p": []}
    for batch in batches:
        for text, whole, spans in zip(*(batch.column(c).to_pylist() for c in ("text", "whole", "spans")), strict=True):
            if whole:
                gathered["s"] += [(trusted, features) for _, trusted, features in sentence_passages(text)]
            if spans:
                gathered["p"] += [(trusted, features) for _, trusted, features in span_passages(text)]
    for kind, found in gathered.items():
        odds, prior = fit_pu([f for _, f in found], np.array([t for t, _ in found], bool), settled=SETTLED[kind])
        at = np.flatnonzero(odds)
        yield pa.RecordBatch.from_arrays([pa.array([kind] * (len(at) + 1)), pa.array(np.r_[-1, at], pa.int64()), pa.array(np.r_[prior, odds[at]], pa.float64())], names=["kind", "feature", "odds"])


def fit_residue(texts: DataFrame, bound: int = FIT_PASSAGES, span_texts: int = FIT_SPAN_TEXTS) -> dict[str, tuple[np.ndarray, float]]:
    """The model of each kind of passage, fitted on at most about ``bound`` passages' texts, and for spans on about
    ``span_texts`` texts that may hold one, both drawn by hash.

    texts: (text). Equal texts are drawn together and count once. The model has FEATURES numbers per kind.
    """
    may = F.col("text").rlike(_MAY_HOLD_SPAN.pattern)
    some = texts.where("text IS NOT NULL").select("text", F.xxhash64("text").alias("h"), (1 + F.size(F.split("text", r"\n|[.!?] "))).alias("n"), may.alias("may"))
    total, holders = (x or 0 for x in some.agg(F.sum("n"), F.count(F.when(F.col("may"), 1))).first())
    whole = F.col("h") < F.lit(draw_below(bound, total)) if total > bound else F.lit(True)
    spans = F.col("may") & (F.col("h") < F.lit(draw_below(span_texts, holders)) if holders > span_texts else F.lit(True))
    draw = some.select("text", "h", whole.alias("whole"), spans.alias("spans")).where("whole OR spans")
    learned = draw.dropDuplicates(["h"]).repartition(1).sortWithinPartitions("h").select("text", "whole", "spans")
    rows = learned.mapInArrow(_fit, "kind string, feature long, odds double").collect()  # at most 2 * FEATURES + 2 rows
    model = {k: (np.zeros(FEATURES), -8.0) for k in "sp"}
    for r in rows:
        if r["feature"] < 0:
            model[r["kind"]] = (model[r["kind"]][0], r["odds"])
        else:
            model[r["kind"]][0][r["feature"]] = r["odds"]
    return model


Model = dict[str, tuple[np.ndarray, float]]
#: Bounds of a passage's log odds, and what a sentence with a name must exceed for its text to be residue.
BOUND, CLEAN = 8.0, -2.0


def _score(passage: Passage, model: Model) -> float:
    kind, trusted, features = passage
    if trusted:
        return BOUND
    odds, prior = model["p" if kind == "p" else "s"]
    return min(max(prior + float(odds[features].sum()), -BOUND), BOUND)


def judge(text: str, model: Model) -> tuple[bool, str | None, float]:
    """(is residue, "slot" or "page", score) of one text, aggregated from its passages.

    A slot anywhere makes the text residue. Otherwise all its sentences together must be: their log odds, clipped,
    add up above 0, and no sentence that names something is clearly clean.
    """
    slot = max((_score(p, model) for p in span_passages(text)), default=-np.inf)
    whole, worst, n = 0.0, np.inf, 0
    for p in sentence_passages(text):
        score = _score(p, model)
        whole, n = whole + score, n + 1
        worst = min(worst, score) if p[0] == "n" else worst
    if slot > 0:
        return True, "slot", slot
    page = n > 0 and whole > 0 and worst > CLEAN
    return page, "page" if page else None, whole / n if n else -BOUND


def is_residue(text: str, model: Model) -> bool:
    """Whether ``judge`` finds residue; scores no further passage once the answer is settled by those before."""
    if any(_score(p, model) > 0 for p in span_passages(text)):
        return True
    whole, n = 0.0, 0
    for p in sentence_passages(text):
        score = _score(p, model)
        if p[0] == "n" and score <= CLEAN:
            return False
        whole, n = whole + score, n + 1
    return n > 0 and whole > 0


def score_texts(documents: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """Adds ``residue`` (never null), ``reason`` and ``score`` to every row; a null or blank text is no residue."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # FEATURES doubles per kind of passage

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = [(False, None, None) if t is None or not t.strip() else judge(t, shared.value) for t in batch.column("_text").to_pylist()]
            new = [pa.array([j[i] for j in judged], t) for i, t in enumerate((pa.bool_(), pa.string(), pa.float64()))]
            names = [c for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *new], names=[*names, "residue", "reason", "score"])

    rows = documents.withColumn("_text", F.col(text))
    schema = T.StructType(rows.drop("_text").schema.fields).add("residue", "boolean").add("reason", "string").add("score", "double")
    return rows.mapInArrow(run, schema)


def marked_texts(documents: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """Adds ``residue`` (never null) to every row, as ``score_texts`` finds it; a null or blank text is no residue."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # FEATURES doubles per kind of passage

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [t is not None and bool(t.strip()) and is_residue(t, shared.value) for t in batch.column("_text").to_pylist()]
            names = [c for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, pa.bool_())], names=[*names, "residue"])

    rows = documents.withColumn("_text", F.col(text))
    return rows.mapInArrow(run, T.StructType(rows.drop("_text").schema.fields).add("residue", "boolean"))


def residue_scores(documents: DataFrame, id_col: str = "doc_id", bound: int = FIT_PASSAGES) -> DataFrame:
    """(doc_id, residue, reason, score) of every document. An empty table gives no rows."""
    rows = documents.select(F.col(id_col).alias("doc_id"), "text")
    return score_texts(rows, fit_residue(rows.select("text"), bound)).drop("text")


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue_scores(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return marked_texts(rows, fit_residue(rows.select("text"))).where("residue").select("doc_id").distinct()


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without residue, all columns."""
    docs = table(spark, sf_dir, "documents")
    model = fit_residue(docs.select("text"))
    return marked_texts(docs, model).where("NOT residue").drop("residue")


SQL: dict[str, str] = {}
QUERIES = {"p8_found": p8_found, "p8_scores": p8_scores, "p8_clean": p8_clean}
