"""Visually identical text with different characters (problem 1)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, wraps

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flipgraph.llm.common import one_per_id
from flipgraph.operators.skew import hot_keys, salted_lookup
from flipgraph.session import cut
from flipgraph.sources.tables import table

# Letters of other scripts that are drawn like a Latin letter in upright type (fixed values, from the
# Unicode characters' usual glyphs). Key: script; then the letters and, in the same order, their Latin twins.
TWINS = {
    "Cyrl": ("АВЕЅІЈКМНОРСТУХаеѕіјорсух", "ABESIJKMHOPCTYXaesijopcyx"),
    "Grek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧον", "ABEZHIKMNOPTYXov"),
    "Armn": ("ՕՍՏօոսհց", "OUSonuhg"),
    "Copt": ("ⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬ", "HIKMNOPCTYX"),
    "Cher": ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᏔᎩᏃ", "ABCDEGHJKLMPRSTVWYZ"),
    "Lisu": ("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ"),
}
# Rare letters that look like Latin ones, but no text is respelled with them.
RARE_TWINS = ("ԌԚԜҮѴӀһԁԛԝүӏϹϳϲͿɡ", "GQWYVIhdqwylCjcJg")
# Signs that are letters drawn alike, or letters joined: taken by rule from their compatibility decomposition.
# Ranges: dz/lj/nj/ij digraphs, Roman numerals, Latin and Armenian ligatures (fixed values).
JOINED = ((0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x2160, 0x217F), (0xFB00, 0xFB06), (0xFB13, 0xFB17))
HYPHENS = "‐‑﹣－"
#: Characters that show nothing and are no format characters (category Cf).
SILENT = ((0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF))
#: Format characters that do show.
SHOWN = ((0x0600, 0x0605), (0x06DD, 0x06DD), (0x070F, 0x070F), (0x0890, 0x0891), (0x08E2, 0x08E2), (0x110BD, 0x110BD), (0x110CD, 0x110CD))

_TO_LATIN = {a: b for there, here in (*TWINS.values(), RARE_TWINS) for a, b in zip(there, here, strict=True)}
_SPELLED = {script: dict(reversed(list(zip(here, there, strict=True)))) for script, (there, here) in TWINS.items()}  # the first twin wins
#: Latin letters of which other scripts have a twin, with the scripts they may be read in.
_READINGS: dict[str, frozenset[str]] = {c: frozenset({"Latn"} | {s for s, m in _SPELLED.items() if c in m}) for m in _SPELLED.values() for c in m}
# Scripts by the first word of their characters' names; others go by that word.
_SCRIPTS = {"LATIN": "Latn", "CYRILLIC": "Cyrl", "GREEK": "Grek", "ARMENIAN": "Armn", "COPTIC": "Copt", "CHEROKEE": "Cher", "LISU": "Lisu", "CJK": "Hani", "HIRAGANA": "Hira", "KATAKANA": "Kana", "HANGUL": "Hang", "BOPOMOFO": "Bopo"}
# Writing systems of several scripts, which a letter of any of these may belong to (fixed values of Unicode's
# augmented script sets): Japanese, Korean, and Chinese with its phonetic letters.
SYSTEMS = {"Hani": ("Jpan", "Kore", "Hanb"), "Hira": ("Jpan",), "Kana": ("Jpan",), "Hang": ("Kore",), "Bopo": ("Hanb",)}


def _within(c: str, ranges) -> bool:
    return any(a <= ord(c) <= b for a, b in ranges)


@lru_cache(100_000)
def _plain(c: str) -> str:
    """One character in its plain form: width, blanks, hyphens, joined and letter-like signs, invisible ones."""
    if c in HYPHENS:
        return "-"
    kind = unicodedata.category(c)
    if kind == "Zs" or c == "\t":
        return " "
    if (kind == "Cf" and not _within(c, SHOWN)) or _within(c, SILENT):
        return ""
    how = unicodedata.decomposition(c)
    if how.startswith(("<wide>", "<narrow>")) or _within(c, JOINED):
        return unicodedata.normalize("NFKC", c)
    return "μ" if c == "µ" else c


#: Texts up to this length are remembered; longer ones would make the memory grow with their size.
REMEMBERED = 200


def remembered(f):
    """Caches ``f`` for short texts, so that its memory is bounded in bytes."""
    held = lru_cache(50_000)(f)
    return wraps(f)(lambda text: held(text) if len(text) <= REMEMBERED else f(text))


@remembered
def skeleton(text: str) -> str:
    """Equal for two texts if and only if they look the same: plain forms, composed, alike letters as Latin ones.

    Case, accents, raised or circled digits and other punctuation stay as they are.
    """
    if text.isascii():
        return text.replace("\t", " ")
    plain = unicodedata.normalize("NFD", "".join(map(_plain, text)))
    return unicodedata.normalize("NFC", "".join(_TO_LATIN.get(c, c) for c in plain))


_SHARED = regex.compile(r"[\p{Script=Common}\p{Script=Inherited}]")


@lru_cache(100_000)
def _scripts(c: str) -> frozenset[str] | None:
    """Scripts and writing systems of a letter; None for signs and for letters that all scripts share."""
    if not c.isalpha() or _SHARED.match(c):
        return None
    first = re.split("[ -]", unicodedata.name(c, ""), maxsplit=1)[0]
    script = _SCRIPTS.get(first, first)
    return frozenset({script, *SYSTEMS.get(script, ())})


_TOKEN = re.compile(r"\S+")


def resolved_scripts(token: str) -> frozenset[str] | None:
    """Scripts in which every letter of the token, a piece of a skeleton, can be written; None without letters."""
    sets = [_READINGS.get(c) or r for c in unicodedata.normalize("NFD", token) if (r := _scripts(c))]
    return frozenset.intersection(*sets) if sets else None


def _only(resolved: frozenset[str] | None) -> str | None:
    """The script of a token that no other script than that can write."""
    scripts = [s for s in resolved or () if len(s) == 4 and s not in ("Jpan", "Kore", "Hanb")] or sorted(resolved or ())[:1]
    return scripts[0] if len(scripts) == 1 else None


@remembered
def consistent(text: str) -> tuple[str, bool, bool]:
    """(one consistent form, a token mixed scripts, a token was another script's lookalike throughout).

    Each token is written in one script that all its letters allow. If several are left, it is the one of the
    text's tokens that allow one script only, the most frequent, words in small letters before names, and Latin
    without any. A token that no single
    script can write keeps Latin for its ambiguous letters. The form depends on the skeleton alone, so texts
    that look the same get the same form. Scripts that are written together, as in Japanese, are not mixed.
    """
    base = skeleton(text)
    if base.isascii() and text.isascii():
        return base, False, False
    tokens = _TOKEN.findall(base)
    resolved = [resolved_scripts(t) for t in tokens]
    sure = [(one, t[0].islower()) for r, t in zip(resolved, tokens, strict=True) if (one := _only(r))]
    sure = [s for s, small in sure if small] or [s for s, _ in sure]  # names may be foreign
    main = max(sorted(set(sure)), key=sure.count, default="Latn")
    chosen = [None if r is None else "" if not r else main if main in r else "Latn" if "Latn" in r else min(r) for r in resolved]
    pick = iter(chosen)

    def spell(m: re.Match) -> str:
        letters = _SPELLED.get(next(pick) or "", {})
        return unicodedata.normalize("NFC", "".join(letters.get(c, c) for c in unicodedata.normalize("NFD", m[0])))

    form = _TOKEN.sub(spell, base)
    stored = _TOKEN.findall(unicodedata.normalize("NFC", "".join(map(_plain, text))))
    written = [[r for c in unicodedata.normalize("NFD", t) if (r := _scripts(c))] for t in stored]
    joint = [frozenset.intersection(*w) if w else None for w in written]
    mixed = any(j is not None and not j for j in joint)
    whole = any(j and c and c not in j for j, c in zip(joint, chosen, strict=False))
    return form, mixed, whole


_FORMS = "rec long, field string, pos int, text string, form string, mixed_script boolean, whole_script boolean"


def _each_form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        forms = [(None, False, False) if t is None else consistent(t) for t in batch.column("text").to_pylist()]
        extra = [pa.array([f[0] for f in forms], pa.string()), pa.array([f[1] for f in forms], pa.bool_()), pa.array([f[2] for f in forms], pa.bool_())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "form", "mixed_script", "whole_script"])


def normalized_texts(records: DataFrame) -> DataFrame:
    """(rec, field, pos, text, form, mixed_script, whole_script): every question and entity name in consistent form.

    records: (rec, question, names). Null texts keep a null form; empty texts an empty one.
    """
    texts = records.select("rec", F.inline(F.concat(
        F.array(F.struct(F.lit("question").alias("field"), F.lit(-1).alias("pos"), F.col("question").alias("text"))),
        F.coalesce(F.transform("names", lambda x, i: F.struct(F.lit("entity").alias("field"), i.alias("pos"), x.alias("text"))), F.array().cast("array<struct<field:string,pos:int,text:string>>")),
    )))
    return texts.mapInArrow(_each_form, _FORMS)


def _within_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A record's question with its form at pos -1, and every pair of its names that look the same but differ."""
    for batch in batches:
        rec, pos_a, pos_b, text, form = [], [], [], [], []
        for r, question, names in zip(*(batch.column(c).to_pylist() for c in ("rec", "question", "names")), strict=True):
            if question is not None:
                rec.append(r), pos_a.append(-1), pos_b.append(-1), text.append(question), form.append(consistent(question)[0])
            if not names or all(n is None or n.isascii() for n in names):
                continue  # plain names that differ look different
            alike: dict[str, dict[str, list[int]]] = {}
            for i, name in enumerate(names):
                if name is not None:
                    alike.setdefault(consistent(name)[0], {}).setdefault(name, []).append(i)
            for stored in alike.values():
                if len(stored) > 1:
                    places = [(i, k) for k, at in enumerate(stored.values()) for i in at]
                    for i, k in sorted(places):
                        for j, m in places:
                            if i < j and k != m:
                                rec.append(r), pos_a.append(i), pos_b.append(j), text.append(None), form.append(None)
        yield pa.RecordBatch.from_arrays([pa.array(rec, pa.int64()), pa.array(pos_a, pa.int32()), pa.array(pos_b, pa.int32()), pa.array(text, pa.string()), pa.array(form, pa.string())], names=["rec", "pos_a", "pos_b", "text", "form"])


def _contested(asked: DataFrame) -> tuple[DataFrame, list]:
    """asked: (rec, form, text), rec once. Rows of forms with several stored spellings, written, and the hot forms.

    Forms with one spelling alone are dropped by an aggregate with map-side combine.
    """
    forms = asked.groupBy("form").agg(F.min("text").alias("a"), F.max("text").alias("b"), F.count(F.lit(1)).alias("n")).where("a <> b").select("form", "n")
    forms = cut(forms, "contested")
    hot = hot_keys(forms, ["form"])
    rows = salted_lookup(asked, forms.select("form"), ["form"], hot, F.col("rec"), "left_semi")
    return cut(rows.select("rec", "form", "text").dropDuplicates(["rec"]), "asked"), hot


def lookalike_classes(records: DataFrame) -> DataFrame:
    """(form, text, class_id, n_records, n_links): the stored spellings of every contested form of a question.

    records: (rec, question, names). class_id is one for all spellings of a form; n_links counts the records of the
    other spellings, with which each record of this one makes a pair. Nulls are in no class.
    """
    seen = records.where("question IS NOT NULL").mapInArrow(_within_records, _WITHIN).where("pos_a < 0")
    rows, _ = _contested(seen)
    spellings = cut(rows.groupBy("form", "text").agg(F.count(F.lit(1)).alias("n_records")), "spellings")
    whole = spellings.groupBy("form").agg(F.sum("n_records").alias("all"))
    return spellings.join(whole, "form").select("form", "text", F.sha2("form", 256).alias("class_id"), "n_records", (F.col("all") - F.col("n_records")).alias("n_links"))


_WITHIN = "rec long, pos_a int, pos_b int, text string, form string"


def lookalike_pairs(records: DataFrame) -> DataFrame:
    """Pairs of different stored texts with one consistent form: names within a record, questions across records.

    records: (rec, question, names), where a re-delivered row may repeat a ``rec`` with equal content. Pairs are made of
    distinct spellings first and then given their records, so records of one spelling never meet; the rows of a frequent
    form go to several tasks. Every row that is made belongs to the result. Nulls are no case.
    """
    seen = cut(records.mapInArrow(_within_records, _WITHIN), "forms")
    names = seen.where("pos_a >= 0").select(F.lit("entity").alias("field"), F.col("rec").alias("exp_a"), "pos_a", F.col("rec").alias("exp_b"), "pos_b").distinct()
    rows, hot = _contested(seen.where("pos_a < 0"))
    spelled = cut(rows.select("form", "text").distinct(), "spellings")
    other = spelled.select("form", F.col("text").alias("more"))
    two = spelled.join(other, "form").where("text < more").select("form", "text", "more", F.unhex(F.md5(F.concat_ws("\0", "text", "more"))).alias("pair"))
    salts = {r["form"]: r["salts"] for r in hot}
    parts = F.lit(1)
    if salts:
        table_ = F.create_map(*(F.lit(x) for kv in salts.items() for x in kv))  # at most 1 / HOT_SHARE forms
        parts = F.coalesce(table_[F.col("form")], F.lit(1))
    salted = F.pmod(F.xxhash64("rec"), parts).cast("int")

    def with_pairs(end: str, salt: Column) -> DataFrame:
        pairs = two.select("form", F.col(end).alias("text"), "pair")
        spread = rows.withColumn("part", salted)  # the lookup's few rows are repeated for the parts of a hot form
        looked = pairs.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        return spread.join(looked, ["form", "text", "part"]).select("pair", "rec", salt.alias("salt"))

    left = with_pairs("text", F.col("part")).withColumnRenamed("rec", "exp_a")
    right = with_pairs("more", F.explode(F.sequence(F.lit(0), parts - 1))).withColumnRenamed("rec", "exp_b")
    pairs = left.join(right, ["pair", "salt"]).select(F.least("exp_a", "exp_b").alias("exp_a"), F.greatest("exp_a", "exp_b").alias("exp_b"))
    return pairs.select(F.lit("question").alias("field"), "exp_a", F.lit(-1).alias("pos_a"), "exp_b", F.lit(-1).alias("pos_b")).unionByName(names)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "explanations").select(F.col("exp_id").alias("rec"), "question", F.col("original_subgraph.entities.name").alias("names"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_pairs(_records(spark, sf_dir).where("rec IS NOT NULL"))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_classes(_records(spark, sf_dir).where("rec IS NOT NULL"))


def p1_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "explanations")
    records = one_per_id(rows, "exp_id", "question", F.col("original_subgraph.entities.name").alias("names"))
    return normalized_texts(records).withColumnRenamed("rec", "exp_id")


SQL: dict[str, str] = {}
QUERIES = {"p1_found": p1_found, "p1_classes": p1_classes, "p1_normalized": p1_normalized}
