"""Visually identical text with different characters: one consistent form.

1. Every character's kind and width is folded: full-width, half-width, styled and joined forms to their plain letters,
   all spaces to the space, hyphens of other kinds to the hyphen, line ends to the line feed. Characters without
   visible form go. Case, accents, punctuation, digits and raised or lowered digits stay as they are. The table is
   derived from the Unicode character database by rule, not listed.
2. Letters are decomposed. Letters of one shape in several scripts come from the Unicode confusables data
   (:mod:`litquarry.llm.confusables`). Each token's *resolved script set* is the intersection, over its letters, of the
   scripts that can spell the letter: for a letter with look-alikes those that have its shape, for others its script
   extensions. A token whose plain script extensions do not intersect is a mixed-script token; one in a single script that
   another script can spell whole is a whole-script confusable.
3. A token with a resolved script is spelled in it: in the main script of the text, if that is in the set, else in the
   first of the set by the text's letters. The main script is the one most letters without look-alikes of the whole text
   belong to (Latin on a tie). A token without a resolved script is spelled in the script of most of its letters without
   look-alikes, or the main one. All of that depends on shapes alone, so texts that look the same get equal forms, and
   a Russian text keeps its Cyrillic.
4. The result is composed again (NFC).

Defined results: null gives null; a text without visible characters gives '' and equals no other text; white space is
kept in number; texts are used whole.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litquarry.llm.confusables import SCRIPTS, classes, script_set

#: decompositions that change only the kind, width or joining of letters
FOLDED_TAGS = {"<wide>", "<narrow>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>"}
_IGNORABLE = regex.compile(r"[\p{Default_Ignorable_Code_Point}\p{Cf}]|(?![\t\n\r\f\v\x85])\p{Cc}")
_TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_ASTRAL = re.compile("[\U00010000-\U0010ffff]")
_ASCII_IGNORABLE = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")


def _fold_table() -> dict[int, str | None]:
    """What each character folds to; built by rule over the planes that hold compatibility forms."""
    table: dict[int, str | None] = {0x2028: "\n", 0x2029: "\n", 0x85: "\n", 0x2010: "-", 0x2011: "-"}
    for cp in [*range(0x80, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0xE0000, 0xE1000), *range(0x20)]:
        c = chr(cp)
        if cp in table:
            continue
        if _IGNORABLE.match(c):
            table[cp] = None
        elif unicodedata.category(c) == "Zs":
            table[cp] = " "
        else:
            tag, _, rest = unicodedata.decomposition(c).partition(" ")
            letters = "".join(chr(int(x, 16)) for x in rest.split()) if tag.startswith("<") else ""
            joined = tag == "<compat>" and len(letters) > 1 and all(x.isalpha() for x in letters)
            alone = tag == "<compat>" and len(letters) == 1 and letters.isalpha() and unicodedata.category(c) in ("Ll", "Lu") and c not in "ſ"
            if tag in FOLDED_TAGS or joined or alone:
                table[cp] = letters.translate({0x2010: "-"})
    return table


_FOLD: dict[str, str] = {}
_FOLDABLE: list[re.Pattern] = []


def _prepare() -> None:
    """The fold table closed under itself, and the classes of characters it changes; built once a worker.

    One class for the basic plane, where a class is a bitmap, and one beyond it, where it would be searched linearly.
    """
    table = _fold_table()
    for cp, to in table.items():
        _FOLD[chr(cp)] = (to or "").translate(table)
    for plane in (lambda c: c <= "\uffff", lambda c: c > "\uffff"):
        _FOLDABLE.append(re.compile("[" + "".join(map(re.escape, sorted(filter(plane, _FOLD)))) + "]"))


def fold(text: str) -> str:
    """Step 1: kinds and widths folded, invisible characters gone, composed."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text.isascii():
        return _ASCII_IGNORABLE.sub("", text)
    if not _FOLDABLE:
        _prepare()
    text = _FOLDABLE[0].sub(lambda m: _FOLD[m[0]], text)
    if _ASTRAL.search(text):
        text = _FOLDABLE[1].sub(lambda m: _FOLD[m[0]], text)
    return unicodedata.normalize("NFC", text)


class Shapes:
    """The table of shapes in the form the speller reads; built once a worker."""

    def __init__(self, classes: list[tuple[str, dict[int, str]]]):
        self.of: dict[str, int] = {}  # letter -> its shape
        self.spelled: list[dict[int, str]] = []
        self.scripts: list[int] = []  # scripts that can spell the shape, as bits
        for letters, spelled in classes:
            for c in letters:
                self.of[c] = len(self.spelled)
            self.spelled.append(spelled)
            self.scripts.append(sum(1 << k for k in spelled))
        self._plain: dict[str, int] = {}
        self._weight: dict[str, int | None] = {}
        # what can change a text: letters of another script than Latin, and those that are not their shape's Latin spelling
        blocks = "\u0370-\u052f\u0531-\u0587\u13a0-\u13fd\u1c80-\u1c8f\u1f00-\u1fff\u2c80-\u2cff\u2de0-\u2dff\ua4d0-\ua4f7\ua640-\ua69f\uab70-\uabbf"
        other = "".join(re.escape(c) for c, k in self.of.items() if self.spelled[k].get(0) != c and c <= "\uffff")
        self.trigger = re.compile(f"[{blocks}{other}]")

    def plain(self, c: str) -> int:
        """Script extensions of a letter as bits; all bits for what is no letter or of no script here."""
        if c not in self._plain:
            self._plain[c] = (script_set(c) or ALL) if c.isalpha() else ALL
        return self._plain[c]

    def resolved(self, c: str) -> int:
        """Scripts that can spell what the letter looks like."""
        k = self.of.get(c)
        return self.plain(c) if k is None else self.scripts[k]

    def firm(self, c: str) -> int | None:
        """The script of a letter without look-alikes, if it has just one."""
        if c not in self._weight:
            bits = self.plain(c) if c.isalpha() and c not in self.of else ALL
            self._weight[c] = bits.bit_length() - 1 if bits & (bits - 1) == 0 else None
        return self._weight[c]

    def spell(self, c: str, script: int) -> str:
        k = self.of.get(c)
        if k is None:
            return c
        spelled = self.spelled[k]
        return spelled[script] if script in spelled else spelled[min(spelled)]


ALL = (1 << len(SCRIPTS)) - 1


@functools.lru_cache(maxsize=1)
def shapes() -> Shapes:
    return Shapes(classes())


def _in_token(c: str) -> bool:
    return c.isalnum() or unicodedata.category(c)[0] == "M"


def _respell_around(text: str, trigger: re.Pattern, spell: Callable[[str], str]) -> str:
    """``spell`` applied to the tokens that hold a character of ``trigger``."""
    out, at = [], 0
    for m in trigger.finditer(text):
        if m.start() < at:
            continue
        start, end = m.start(), m.end()
        while start > at and _in_token(text[start - 1]):
            start -= 1
        while end < len(text) and _in_token(text[end]):
            end += 1
        out += text[at:start], spell(text[start:end])
        at = end
    return "".join([*out, text[at:]])


def canonical(text: str, table: Shapes | None = None) -> tuple[str, int, int]:
    """(consistent form, mixed-script tokens, whole-script confusable tokens respelled)."""
    table = table or shapes()
    text = fold(text)
    if text.isascii() or not table.trigger.search(text):
        return text, 0, 0
    plain = unicodedata.normalize("NFD", text)
    weight: Counter[int] = Counter()
    for c, n in Counter(plain).items():
        if (script := table.firm(c)) is not None:
            weight[script] += n
    ranked = sorted(range(len(SCRIPTS)), key=lambda k: (-weight[k], k))
    main = ranked[0]
    mixed = whole = 0

    def spell(token: str) -> str:
        nonlocal mixed, whole
        if not any(c in table.of for c in token):
            return token
        own = resolved = ALL
        for c in token:
            own &= table.plain(c)
            resolved &= table.resolved(c)
        if resolved:
            script = next(k for k in ranked if resolved >> k & 1)
        else:
            firm = Counter(k for c in token if (k := table.firm(c)) is not None)
            script = max(firm, key=lambda k: (firm[k], k == main, -k), default=main)
        spelled = "".join(table.spell(c, script) for c in token)
        if not own:
            mixed += 1
        elif spelled != token:
            whole += 1
        return spelled

    if main == 0:  # there a token without letters of another script is already consistent
        spelled = _respell_around(plain, table.trigger, spell)
    else:
        spelled = _TOKEN.sub(lambda m: spell(m[0]), plain)
    return unicodedata.normalize("NFC", spelled), mixed, whole


FORM = T.StructType([T.StructField("form", T.StringType()), T.StructField("mixed_tokens", T.LongType()), T.StructField("whole_tokens", T.LongType())])
KEYS = T.StructType([T.StructField(c, T.LongType()) for c in ("f1", "f2", "r1", "r2")] + [T.StructField("visible", T.BooleanType())])


def consistent(text: Column) -> Column:
    """struct(form, mixed_tokens, whole_tokens) of a text column."""

    known = classes()  # read on the driver; workers need no jar

    @F.pandas_udf(FORM)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = Shapes(known)
        for texts in batches:
            yield pd.DataFrame([(None, 0, 0) if t is None else canonical(t, table) for t in texts], columns=FORM.names)

    return run(text)


def _name(text: str) -> tuple[int, int]:
    h = xxhash.xxh3_128_digest(text.encode())
    return int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True)


def form_keys(text: Column) -> Column:
    """128-bit names of the consistent form and of the text as stored: what grouping needs, without moving any text."""

    known = classes()

    @F.pandas_udf(KEYS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = Shapes(known)
        for texts in batches:
            rows = []
            for t in texts:
                form = canonical(t, table)[0] if t else ""
                rows.append((*_name(form), *_name(t or ""), bool(form)))
            yield pd.DataFrame(rows, columns=KEYS.names)

    return run(text)


def stored_forms(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, form, stored): names of each document's consistent form and of its text as stored."""
    keyed = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), form_keys(F.col(text_col)).alias("k"))
    return keyed.filter("k.visible").select("id", F.struct("k.f1", "k.f2").alias("form"), F.struct("k.r1", "k.r2").alias("stored"))


def same_look_pairs(members: DataFrame) -> DataFrame:
    """All pairs (a < b) of documents of one form that are stored differently.

    Forms are paired on their distinct stored texts and only then expanded to documents: a text copied a million times
    is one row in the pairing, and a form with one stored text, however many copies, yields nothing.
    """
    classes = members.select("form", "stored").distinct()
    pairs = classes.withColumnRenamed("stored", "sa").join(classes.withColumnRenamed("stored", "sb"), "form").filter("sa < sb")
    left = members.select("form", F.col("stored").alias("sa"), F.col("id").alias("x"))
    right = members.select("form", F.col("stored").alias("sb"), F.col("id").alias("y"))
    both = pairs.join(left, ["form", "sa"]).join(right, ["form", "sb"])
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def look_classes(members: DataFrame) -> DataFrame:
    """(id, class_id, n_stored): every document with the least id of its form and the number of texts the form is stored as.

    One row a document, whatever the size of a class.
    """
    texts = members.groupBy("form", "stored").agg(F.min("id").alias("least"))
    by_form = texts.groupBy("form").agg(F.min("least").alias("class_id"), F.count("*").alias("n_stored"))
    return members.select("id", "form").join(by_form, "form").select("id", "class_id", "n_stored")
