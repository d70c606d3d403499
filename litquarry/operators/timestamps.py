"""Mixed timestamp formats and time zones, normalised to one unambiguous text.

Each text is reduced to a *shape mask*: every digit becomes ``9``, every run of letters ``A``, other characters stay.
The distinct masks of a batch are few; each is mapped to a parser once (and remembered by the worker), and all texts of
that mask are converted together with numpy, local times through the zone's transition table.

Result texts state the precision of the input: ``YYYY``, ``YYYY-MM``, ``YYYY-MM-DD`` or, for an instant,
``YYYY-MM-DDTHH:MM:SS.ffffffZ``.

Defined results for awkward input: null, blank, prose and impossible dates (month 13, 30 February, year 0, 25 o'clock)
give the four-digit year of the fallback column, or null; a local time whose row has no known zone cannot be an instant
and falls back likewise; an all-numeric date needs the row's ``day_order``; very long texts match no shape and fall
back. Extra columns pass through untouched; repeated rows give repeated results; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litquarry.functions.zones import ZoneTable, database_version, local_to_utc, zone_table

MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
LONG_MONTHS = {m: i for i, m in enumerate(
    "january february march april may june july august september october november december".split(), 1)}
MONTH_OF = MONTHS | LONG_MONTHS | {"sept": 9}
WEEKDAYS = {x for d in "monday tuesday wednesday thursday friday saturday sunday".split() for x in (d, d[:3])} | {
    "tues", "thur", "thurs", "wednes"}
ZERO_ZONES = {"z": 0, "utc": 0, "gmt": 0, "ut": 0}
MAX_LEN = 80  # no format is longer once outer and repeated blanks are gone; longer texts are prose and no date
MAX_ZONES = 700  # the public zone database has about 600 names

# Pieces of the shape grammar. A parser is one of the date shapes, or a date shape, a gap and a clock shape.
_D1, _Y4 = r"\d{1,2}", r"\d{4}"
_WORD = r"[^\W\d_]+"
DATE_SHAPES: tuple[tuple[str, str], ...] = (
    ("ymd", rf"(?P<y>{_Y4})-(?P<m>{_D1})-(?P<d>{_D1})"),
    ("ymd", rf"(?P<y>{_Y4})/(?P<m>{_D1})/(?P<d>{_D1})"),
    ("ymd", rf"(?P<y>{_Y4})\.(?P<m>{_D1})\.(?P<d>{_D1})"),
    ("ymd", r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})"),
    ("ymd", rf"(?P<y>{_Y4})[-/ .](?P<mon>{_WORD})\.?[-/ .](?P<d>{_D1})"),
    ("ymd", rf"(?:(?P<wd>{_WORD})\.?,? )?(?P<d>{_D1})(?P<ord>st|nd|rd|th)?(?: of)?[-/ .](?P<mon>{_WORD})\.?,?[-/ .](?P<y>{_Y4}|\d{{2}})"),
    ("ymd", rf"(?:(?P<wd>{_WORD})\.?,? )?(?P<mon>{_WORD})\.? (?P<d>{_D1})(?P<ord>st|nd|rd|th)?,? (?P<y>{_Y4})"),
    ("num", rf"(?P<a>{_D1})(?P<sep>[-/.])(?P<b>{_D1})(?P=sep)(?P<y>{_Y4}|\d{{2}})"),
    ("ym", rf"(?P<y>{_Y4})[-/ .](?P<mon>{_WORD})\.?"),
    ("ym", rf"(?P<mon>{_WORD})\.?,?[-/ .](?P<y>{_Y4})"),
    ("ym", rf"(?P<y>{_Y4})[-/.](?P<m>{_D1})"),
    ("ym", rf"(?P<m>{_D1})[-/.](?P<y>{_Y4})"),
    ("y", rf"(?P<y>{_Y4})"),
)
CLOCK = (
    r"(?:T|t|,? )(?P<H>\d{1,2}):(?P<M>\d{2})(?::(?P<S>\d{2})(?:[.,](?P<f>\d{1,9}))?)?"
    r"(?: ?(?P<ap>[AaPp])\.?[Mm]\.?)?"
    rf"(?: ?(?:\[(?P<region>[A-Za-z0-9_+\-/]+)\]|(?P<off>[+\-]\d{{2}}:?\d{{2}}|[+\-]\d{{2}})|\(?(?P<abbr>{_WORD})\)?))?"
)
BASIC_CLOCK = r"T(?P<H>\d{2})(?P<M>\d{2})(?P<S>\d{2})?(?:[.,](?P<f>\d{1,9}))?(?P<abbr>Z|z)?(?P<off>[+\-]\d{2}:?\d{2})?"
EPOCHS = (("epoch_s", r"(?P<n>\d{10})"), ("epoch_ms", r"(?P<n>\d{13})"))
_SHAPES = [
    *EPOCHS,
    *DATE_SHAPES,
    *((k, p + CLOCK) for k, p in DATE_SHAPES if k in ("ymd", "num")),
    ("ymd", DATE_SHAPES[3][1] + BASIC_CLOCK),
    ("ymd", DATE_SHAPES[0][1] + BASIC_CLOCK),
]


def _mask_pattern(shape: str) -> str:
    """The masks that texts of a shape have: its pattern with digits and letter runs closed up."""
    shape = re.sub(r"\(\?P<(?!sep>)\w+>", "(?:", shape)
    for opened, closed in (
        (_WORD, "A"), (r"st|nd|rd|th", "A"), (" of", " A"), ("T|t", "A"), ("[AaPp])\\.?[Mm]\\.?", "A)\\.?(?:A\\.?)?"),
        ("Z|z", "A"), ("A-Za-z0-9", "A9"), (r"\d", "9"), ("T", "A"),
    ):
        shape = shape.replace(opened, closed)
    return shape


_COMPILED = [(k, re.compile(_mask_pattern(p)), re.compile(rf"^(?:{p})\Z")) for k, p in _SHAPES]
_PARSERS: dict[str, list[tuple[str, re.Pattern]]] = {}
_LETTERS, _DIGITS, _GAP = re.compile(r"[^\W\d_]+"), re.compile(r"\d"), re.compile(r"\s+")


def shape_mask(text: str) -> str:
    """``16th August 2025`` -> ``99A A 9999``."""
    return _DIGITS.sub("9", _LETTERS.sub("A", text))


def parser_for(mask: str) -> list[tuple[str, re.Pattern]]:
    """The parsers a mask admits, in order of preference: looked up once per distinct mask and remembered."""
    found = _PARSERS.get(mask)
    if found is None:
        if len(_PARSERS) > 50_000:  # masks of prose are unbounded in number; forget and start again
            _PARSERS.clear()
        found = _PARSERS[mask] = [(k, text) for k, shape, text in _COMPILED if shape.fullmatch(mask)]
    return found


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970 and whether the date exists."""
    ok = (y > 0) & (m >= 1) & (m <= 12) & (d >= 1) & (d <= 31)
    months = (np.where(ok, y, 1970) - 1970) * 12 + np.where(ok, m, 1) - 1
    first = months.astype("datetime64[M]")
    length = ((first + 1).astype("datetime64[D]") - first.astype("datetime64[D]")).astype("int64")
    return first.astype("datetime64[D]").astype("int64") + np.where(ok, d, 1) - 1, ok & (d <= length)


def _instant_text(micros: np.ndarray) -> np.ndarray:
    return np.char.add(np.datetime_as_string(micros.astype("datetime64[us]"), unit="us"), "Z").astype(object)


def _ints(column: pd.Series, missing: int = 0) -> np.ndarray:
    return pd.to_numeric(column, errors="coerce").fillna(missing).to_numpy("int64")


def _convert(kind: str, parts: pd.DataFrame, tz: np.ndarray, order: np.ndarray, tables: dict[str, ZoneTable]) -> np.ndarray:
    """Texts for the rows of one parser; None where the text is no real date."""
    n = len(parts)
    out = np.full(n, None, object)
    if kind.startswith("epoch"):
        scale = 1_000_000 if kind == "epoch_s" else 1_000
        return _instant_text(_ints(parts["n"]) * scale)
    y = _ints(parts["y"])
    short = parts["y"].str.len().to_numpy() == 2
    y = np.where(short, y + 2000, y)
    if kind == "y":
        good = y > 0
        out[good] = parts["y"].to_numpy(object)[good]
        return out
    if kind == "num":
        dmy, mdy = order == "dmy", order == "mdy"
        a, b = _ints(parts["a"]), _ints(parts["b"])
        m, d = np.where(dmy, b, a), np.where(dmy, a, b)
        known = dmy | mdy
    else:
        m = parts["mon"].str.lower().map(MONTH_OF).fillna(0).to_numpy("int64") if "mon" in parts else _ints(parts["m"])
        d = _ints(parts["d"]) if kind == "ymd" else np.ones(n, "int64")
        known = np.ones(n, bool)
        if "wd" in parts:
            wd = parts["wd"].str.lower()
            known &= (wd.isna() | wd.isin(WEEKDAYS)).to_numpy()
    days, ok = _days(y, m, d)
    ok &= known
    if "H" not in parts:
        text = np.datetime_as_string(days.astype("datetime64[D]"), unit="D").astype(object)
        if kind == "ym":
            text = np.array([t[:-3] for t in text], object)
        out[ok] = text[ok]
        return out
    hour, minute, second = _ints(parts["H"], -1), _ints(parts["M"], -1), _ints(parts["S"])
    if "ap" in parts:
        ap = parts["ap"].str.lower().to_numpy(object)
        twelve = np.array([x in ("a", "p") for x in ap])
        ok &= ~twelve | ((hour >= 1) & (hour <= 12))
        hour = np.where(twelve, hour % 12 + 12 * (ap == "p"), hour)
    ok &= (hour >= 0) & (hour <= 23) & (minute >= 0) & (minute <= 59) & (second <= 59)
    micro = _ints(parts["f"].fillna("").str.pad(6, "right", "0").str[:6])
    local = days * 86_400 + hour * 3_600 + minute * 60 + second
    utc = np.zeros(n, "int64")
    off = parts["off"].to_numpy(object)
    abbr = parts["abbr"].str.lower().to_numpy(object)
    region = parts["region"].to_numpy(object) if "region" in parts else np.full(n, None, object)
    has = lambda a: np.array([isinstance(x, str) for x in a], bool)
    stated, named, placed = has(off), has(abbr), has(region)
    if stated.any():
        o = pd.Series(off[stated]).str.replace(":", "").str.pad(5, "right", "0")
        hours, minutes = _ints(o.str[1:3]), _ints(o.str[3:5])
        utc[stated] = local[stated] - np.where(o.str[0] == "-", -1, 1) * (hours * 3_600 + minutes * 60)
        ok[stated] &= (hours <= 18) & (minutes <= 59)
    zone = np.where(placed, region, tz)
    rest = ~stated
    for name in {z for z in zone[rest] if isinstance(z, str)} | {None}:
        here = rest & np.array([z == name if name else not isinstance(z, str) for z in zone])
        if not here.any():
            continue
        table = tables.get(name) or _late_table(name, tables)
        by_name = here & named
        for a in set(abbr[by_name]):
            at = by_name & (abbr == a)
            own = {k.lower(): v for k, v in table.abbreviations.items()} if table else {}
            shift = 0 if a == "z" else own.get(a, ZERO_ZONES.get(a))
            if shift is None:
                ok[at] = False
            else:
                utc[at] = local[at] - shift
        plain = here & ~named
        if table is None:
            ok[plain] = False
        else:
            utc[plain] = local_to_utc(local[plain], table)
    out[ok] = _instant_text((utc * 1_000_000 + micro)[ok])
    return out


def _late_table(name: str | None, tables: dict[str, ZoneTable]) -> ZoneTable | None:
    """A zone that only a bracketed text names: built here, from the same database version or not at all."""
    if name is None:
        return None
    table = zone_table(name)
    if table and tables and table.version != next(iter(tables.values())).version:
        raise RuntimeError(f"zone {name}: this executor has zone database {table.version}, the driver another")
    return table


def normalise_batch(date: pd.Series, tz: pd.Series, order: pd.Series, tables: dict[str, ZoneTable]) -> np.ndarray:
    """Texts for a batch, None where a text is no real date. All array work; the loop is over distinct masks."""
    raw = date.fillna("")
    text = raw.str.normalize("NFKC").str.strip().str.replace(_GAP, " ", regex=True)
    text = text.where((text.str.len() <= MAX_LEN) & text.str.contains(_DIGITS), "")
    masks = text.map(shape_mask)
    out = np.full(len(text), None, object)
    tzs, orders = tz.to_numpy(object), order.to_numpy(object)
    for mask, idx in masks.groupby(masks).indices.items():
        if not mask:
            continue
        todo = idx
        for kind, pattern in parser_for(mask):
            if not len(todo):
                break
            parts = text.iloc[todo].str.extract(pattern).reset_index(drop=True)
            lead = parts["n" if kind.startswith("epoch") else "y"]
            hit = lead.notna().to_numpy()
            if not hit.any():
                continue
            rows = todo[hit]
            out[rows] = _convert(kind, parts[hit].reset_index(drop=True), tzs[rows], orders[rows], tables)
            todo = todo[np.array([v is None for v in out[todo]])]
    return out


def zone_tables(feeds: DataFrame, tz_col: str = "tz_name") -> dict[str, ZoneTable]:
    """Tables of the zones a lookup table names. Its distinct zones are bounded by the zone database (checked)."""
    names = [r[0] for r in feeds.select(tz_col).distinct().limit(MAX_ZONES + 1).collect() if r[0]]
    if len(names) > MAX_ZONES:
        raise ValueError(f"{tz_col} has more than {MAX_ZONES} distinct values: not zone names")
    return {n: t for n in names if (t := zone_table(n))}


def normalised(date: Column, tz: Column, order: Column, tables: dict[str, ZoneTable]) -> Column:
    """Column with the unambiguous text of ``date``, null where it is no real date."""

    @F.pandas_udf(T.StringType())
    def convert(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for d, z, o in batches:
            yield pd.Series(normalise_batch(d, z, o, tables), dtype=object)

    # marked so that a filter on the result does not make the optimiser evaluate it twice
    return convert.asNondeterministic()(date, tz, order)


def year_of(text: Column) -> Column:
    """First stand-alone four-digit year of a text, full-width digits included; null for year 0."""
    ascii_digits = F.translate(text, "０１２３４５６７８９", "0123456789")
    year = F.regexp_extract(ascii_digits, r"(?<!\d)(\d{4})(?!\d)", 1)
    return F.when((year != "") & (year != "0000"), year)


def normalise_dates(
    papers: DataFrame,
    feeds: DataFrame,
    *,
    date_col: str = "pub_date",
    year_col: str = "pub_year",
    source_col: str = "source",
    out_col: str = "date_norm",
) -> DataFrame:
    """``papers`` with ``out_col`` added, nothing else changed.

    ``feeds`` is a small lookup (source, tz_name, day_order); its rows per source are made unique here, and it is
    broadcast only below the size checked in :func:`zone_tables`' bound on distinct zones and Spark's own threshold.
    """
    tables = zone_tables(feeds)
    key = F.lower(F.trim(F.col("source")))
    look = feeds.groupBy(key.alias("__k")).agg(F.min("tz_name").alias("__tz"), F.min("day_order").alias("__order"))
    joined = papers.join(look, F.lower(F.trim(papers[source_col])) == F.col("__k"), "left")
    text = normalised(F.col(date_col), F.col("__tz"), F.col("__order"), tables)
    return joined.withColumn("__text", text).withColumn(out_col, F.coalesce("__text", year_of(F.col(year_col)))).drop(
        "__k", "__tz", "__order", "__text")


__all__ = ["database_version", "normalise_batch", "normalise_dates", "normalised", "shape_mask", "year_of", "zone_tables"]
