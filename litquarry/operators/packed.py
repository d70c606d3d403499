"""Several values packed into one field, split into one value per row with position and error flag.

The field is read by a small parsing expression grammar with ordered alternatives and backtracking::

    field     <- list / items
    list      <- '[' items ']' end                     (tried first; on failure the bracket is ordinary text)
    items     <- item? (separator item?)*
    item      <- missing / quoted / bracketed / bare   (in this order)
    missing   <- a text for "missing", up to a separator or the end
    quoted    <- '"' (not '"' / '""')* '"' &(separator / end)
    bracketed <- '[' (quotedtext / not ('[' / ']' / '"'))* ']' &(separator / end)
    bare      <- one or more characters up to a separator

A quote without its partner, or followed by more text, makes ``quoted`` fail; the parser goes back to the opening
quote, takes it as ordinary text (``bare``) and flags the value. ``bracketed`` fails and goes back in the same way. A value
in quotes or brackets may hold separators; quotes around the whole of a bracketed value go with the brackets. Commas, ``and`` and ``&`` are *weak* separators: with
``weak_separators="fallback"`` they separate only in a field that has no strong separator outside quotes.

Defined results: null, blank and all-missing fields give no values; positions count the non-empty values from 1;
repeated values stay; texts of any length are read whole, in one pass; extra columns pass through.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRONG = r"[;；|/+\t\n\r]+"
WEAK = r",|&|(?<=\s)and(?=\s)"
BLANK = r"(?<=\S)\s+(?=\S)"
#: Texts that say a value is missing.
MISSING_TEXTS = ("n/a", "na", "none", "null", "nil", "-", "--", "unknown", "unspecified", "not available", "not given",
                 "n.d.", "et al", "et al.")
ITEM = T.StructType([T.StructField("item_pos", T.LongType()), T.StructField("item", T.StringType()),
                     T.StructField("malformed", T.BooleanType())])
_SPACE = re.compile(r"\s*")
_TRAILING_ET_AL = re.compile(r"\s+et al\.?\Z", re.I)
_QUOTED = re.compile(r'"((?:[^"]|"")*)"')
_BRACKETED = re.compile(r'\[((?:[^\[\]"]|"(?:[^"]|"")*")*+)\]')


class Grammar:
    """The grammar for one kind of field."""

    def __init__(self, weak_separators: str = "fallback", blank_separates: bool = False, missing: tuple[str, ...] = MISSING_TEXTS):
        if weak_separators not in ("fallback", "always", "never"):
            raise ValueError(f"weak_separators: {weak_separators}")
        self.mode, self.missing = weak_separators, frozenset(m.lower() for m in missing)
        longest_first = sorted(map(re.escape, missing), key=len, reverse=True)
        all_seps = f"{STRONG}|{WEAK}" + (rf"|{BLANK}" if blank_separates else "")
        self.strong, self.full = re.compile(STRONG), re.compile(all_seps)
        self._missing = {s: re.compile(rf"(?:{'|'.join(longest_first)})(?=\s*(?:{s.pattern}|\Z|\]))", re.I) for s in (self.strong, self.full)}
        # missing texts that hold a separator themselves
        own = [re.escape(m) for m in missing if self.strong.search(m)]
        self._loose = re.compile("|".join(own) or r"(?!)", re.I)
        self.parse = functools.lru_cache(maxsize=65_536)(self._parse)

    def _parse(self, text: str | None) -> tuple[tuple[int, str, bool], ...]:
        """The values of a field as (position, value, malformed)."""
        if not text or not text.strip() or text.strip().lower() in self.missing:
            return ()
        seps = {"always": self.full, "never": self.strong}.get(self.mode) or (
            self.strong if self._has_strong(text) else self.full)
        values = self._list(text, seps)
        return tuple((k, v, bad) for k, (v, bad) in enumerate(((v, b) for v, b in values if v and v.lower() not in self.missing), 1))

    def _has_strong(self, text: str) -> bool:
        """Whether a strong separator that is not part of a missing text stands outside quotes."""
        if not self.strong.search(text):
            return False
        if '"' not in text and not self._loose.search(text):
            return True
        at, end = 0, len(text)
        while at < end:
            if text[at] == '"' and (m := self._closed(text, at, self.full)):
                at = m
                continue
            if (at == 0 or not text[at - 1].isalnum()) and (m := self._missing[self.full].match(text, at)):
                at = m.end()
                continue
            if m := self.strong.match(text, at):
                # a strong separator at the edge of the field separates nothing but is still the field's delimiter
                return True
            at += 1
        return False

    @staticmethod
    def _closed(text: str, at: int, seps: re.Pattern) -> int | None:
        """End of a well-formed quoted value starting at ``at``: a separator, a bracket or the end must follow."""
        m = _QUOTED.match(text, at)
        if not m:
            return None
        after = _SPACE.match(text, m.end()).end()
        edge = after == len(text) or text[after] == "]" or seps.match(text, after) or seps.match(text, m.end())
        return m.end() if edge else None

    @staticmethod
    def _bracketed(text: str, at: int, seps: re.Pattern) -> tuple[int, str] | None:
        """(end, value) of a well-formed bracketed value starting at ``at``: a separator, a bracket or the end must follow."""
        m = _BRACKETED.match(text, at)
        if not m:
            return None
        after = _SPACE.match(text, m.end()).end()
        if not (after == len(text) or text[after] == "]" or seps.match(text, after) or seps.match(text, m.end())):
            return None
        inner = m[1].strip()
        whole = _QUOTED.fullmatch(inner)
        return m.end(), (whole[1].replace('""', '"') if whole else inner).strip()

    def _list(self, text: str, seps: re.Pattern) -> list[tuple[str, bool]]:
        body = text.strip()
        if body.startswith("[") and body.endswith("]"):
            inner = self._items(body[1:-1], seps, nested=True)
            if inner is not None:
                return inner
        return self._items(text, seps) or []

    def _items(self, text: str, seps: re.Pattern, nested: bool = False) -> list[tuple[str, bool]] | None:
        """All values; None (so that the caller tries its next alternative) if ``nested`` text has a stray bracket."""
        out: list[tuple[str, bool]] = []
        at, end = 0, len(text)
        while at < end:
            if m := seps.match(text, at):
                at = m.end()
                continue
            start = _SPACE.match(text, at).end()
            if start > at and (m := seps.match(text, start)):
                at = m.end()
                continue
            if start == end:
                break
            at = start
            if (m := self._missing[seps].match(text, at)):
                at = m.end()
            elif text[at] == '"' and (stop := self._closed(text, at, seps)):
                out.append((text[at + 1:stop - 1].replace('""', '"').strip(), False))
                at = stop
            elif text[at] == "[" and (found := self._bracketed(text, at, seps)):
                at, value = found
                out.append((value, False))
            else:
                m = seps.search(text, at + 1)
                stop = m.start() if m else end
                value = _TRAILING_ET_AL.sub("", text[at:stop].strip())
                if nested and ("[" in value or "]" in value):
                    return None
                out.append((value, '"' in value or ("[" in value) != ("]" in value)))
                at = stop
        return out


def split_column(packed: Column, grammar: Grammar) -> Column:
    """``array<struct<item_pos, item, malformed>>`` of a packed text column."""

    mode, missing = grammar.mode, tuple(grammar.missing)
    blanks = BLANK in grammar.full.pattern

    @F.pandas_udf(T.ArrayType(ITEM))
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Grammar(mode, blanks, missing)
        for texts in batches:
            yield pd.Series([[{"item_pos": k, "item": v, "malformed": b} for k, v, b in own.parse(t)] for t in texts], dtype=object)

    return split(packed)


def unpack(df: DataFrame, fields: dict[str, Grammar], *, keep: tuple[str, ...], min_values: int = 1) -> DataFrame:
    """One row per value of every field: ``keep`` columns, field_name, item_pos, item, malformed.

    The fields are parsed in one pass over the table (one Python stage) and exploded in the JVM; nothing shuffles.
    ``keep`` names the columns to carry; a column of the table that clashes with an output name is not carried unless
    named there, in which case it is an error.
    """
    clash = {"field_name", "item_pos", "item", "malformed"} & set(keep)
    if clash:
        raise ValueError(f"columns {sorted(clash)} clash with the result's own")
    parsed = df.select(*keep, *(split_column(F.col(c), g).alias(f"__{c}") for c, g in fields.items()))
    per_field = F.array(*(F.struct(F.lit(c).alias("field_name"), F.col(f"__{c}").alias("values")) for c in fields))
    rows = parsed.select(*keep, F.explode(per_field).alias("__f")).filter(F.size("__f.values") >= min_values)
    return rows.select(*keep, F.col("__f.field_name").alias("field_name"), F.explode("__f.values").alias("__v")).select(
        *keep, "field_name", "__v.item_pos", "__v.item", "__v.malformed")
