"""Letters that look alike across scripts, from the Unicode confusables data that ships with the ICU library of Spark.

The data are read on the driver from ``com/ibm/icu/impl/data/icudata/confusables.cfu`` in Spark's own ``icu4j`` jar (77.1:
Unicode 16.0), whose layout is public: a header, a sorted table of code points with the length of their prototype, a
table of prototypes. What workers need goes to them with the function.

Only letters count, and only letters of the same case: digits, punctuation and case tell texts apart here, so a prototype
shared by ``I``, ``l`` and ``1`` makes three classes. A class has one *spelling* in each script that has the shape; other
letters of a script join it only from outside that script's usual alphabet, so two letters that a language tells apart
are never taken for one.
"""

from __future__ import annotations

import functools
import os
import struct
import unicodedata
import zipfile
from collections import defaultdict
from pathlib import Path

import regex

SCRIPTS = ("Latin", "Greek", "Cyrillic", "Armenian", "Cherokee", "Coptic", "Lisu")
DATA = "com/ibm/icu/impl/data/icudata/confusables.cfu"
#: Letters the data list that readers tell apart in running text.
TOLD_APART = "αγισυβгѡЛ"
#: The usual alphabet of each script.
ALPHABETS = {"Latin": "A-Za-zÀ-ÿ", "Greek": "Α-ω", "Cyrillic": "Ѐ-џ", "Armenian": "Ա-և",
             "Cherokee": "Ꭰ-Ᏽ", "Coptic": "Ⲁ-ⲱ", "Lisu": "ꓐ-ꓷ"}
#: Where a shape has no letter of the usual alphabet, one of these may spell it.
MORE_LETTERS = {"Latin": "", "Greek": "ͿϲϳϹ", "Cyrillic": "Ѡ-ԯ", "Armenian": "", "Cherokee": "ꭰ-ꮿ", "Coptic": "", "Lisu": ""}


def jar_path() -> Path:
    """The ICU jar of the Spark installation."""
    homes = [Path(os.environ["SPARK_HOME"])] if os.environ.get("SPARK_HOME") else []
    import pyspark

    for home in [*homes, Path(pyspark.__file__).parent]:
        found = sorted((home / "jars").glob("icu4j-*.jar"))
        if found:
            return found[-1]
    raise FileNotFoundError("no icu4j jar beside Spark")


@functools.lru_cache(maxsize=1)
def prototypes() -> dict[str, str]:
    """Character -> what the data say it may be taken for."""
    with zipfile.ZipFile(jar_path()) as z:
        raw = z.read(DATA)
    body = raw[int.from_bytes(raw[:2], "big"):]
    magic, _, _, keys_at, n_keys, values_at, n_values, strings_at, _ = struct.unpack(">9I", body[:36])
    if magic != 0x3845FDEF:
        raise ValueError(f"{DATA}: unknown layout")
    keys = struct.unpack(f">{n_keys}I", body[keys_at:keys_at + 4 * n_keys])
    values = struct.unpack(f">{n_values}H", body[values_at:values_at + 2 * n_values])
    out = {}
    for key, value in zip(keys, values, strict=True):
        length = (key >> 24) + 1  # in UTF-16 units; a single unit is the value itself
        at = strings_at + 2 * value
        out[chr(key & 0xFFFFFF)] = chr(value) if length == 1 else body[at:at + 2 * length].decode("utf-16-be")
    return out


@functools.lru_cache(maxsize=1)
def _script_patterns() -> list[regex.Pattern]:
    return [regex.compile(rf"\p{{Script_Extensions={s}}}") for s in SCRIPTS]


def script_set(c: str) -> int:
    """The scripts a letter is written in (its script extensions), one bit each; 0 for letters of no script here."""
    return sum(1 << k for k, p in enumerate(_script_patterns()) if p.match(c))


def _case(c: str) -> str | None:
    category = unicodedata.category(c)
    return category if category in ("Lu", "Ll") else "Lu" if "ꓐ" <= c <= "ꓷ" else None


@functools.lru_cache(maxsize=1)
def classes() -> list[tuple[str, dict[int, str]]]:
    """(letters of one shape, script number -> its spelling of the shape), shapes of at least two scripts or letters."""
    table = prototypes()
    groups: dict[tuple[str, str], set[str]] = defaultdict(set)
    for c, p in table.items():
        if len(p) == 1 and _case(c):
            groups[p, _case(c)].add(c)
    for p, case in list(groups):
        if p not in table and _case(p) == case:
            groups[p, case].add(p)
    out = []
    usual = [regex.compile(f"[{ALPHABETS[s]}]") for s in SCRIPTS]
    also = [regex.compile(f"[{MORE_LETTERS[s]}]") if MORE_LETTERS[s] else None for s in SCRIPTS]
    for _, letters in sorted(groups.items()):
        spelled: dict[int, str] = {}
        own = defaultdict(list)
        for c in sorted(letters - set(TOLD_APART)):
            if unicodedata.normalize("NFKD", c) == c and (scripts := script_set(c)):
                own[scripts.bit_length() - 1].append(c)
        for k, cs in own.items():
            first = next((c for c in cs if usual[k].match(c)), None) or next((c for c in cs if also[k] and also[k].match(c)), None)
            if first:
                spelled[k] = first
        members = [c for k, cs in own.items() for c in cs if c == spelled.get(k) or not usual[k].match(c)]
        if spelled and len(members) > 1:
            out.append(("".join(sorted(members)), spelled))
    return out
