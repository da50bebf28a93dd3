"""Text functions of record linkage and parsing, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def normalised(name: Column) -> Column:
    """Trimmed, lower case, without a leading "the", punctuation and repeated spaces."""
    s = F.regexp_replace(F.lower(F.trim(name)), "^the ", "")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"(?U)[^\w\s]", ""), r"\s+", " "))


def without_featured(title: Column) -> Column:
    """Without a trailing clause of featured artists."""
    return F.trim(F.regexp_replace(title, r"(?i)\s*[\(\[]?\b(?:feat|ft|featuring)\b\.?.*$", ""))


def artist_set(names: Column) -> Column:
    """The artists of a credit, sorted and joined by a pipe."""
    parts = F.transform(F.split(F.lower(names), r"\s*(?:,|;|&|/| and | feat\.? )\s*"), lambda x: F.trim(x))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != ""))), "|")


def artist_of_path(path: Column) -> Column:
    """The third last part of a path; null where there is none."""
    return F.try_element_at(F.split(path, "/"), F.lit(-3))


def format_of_path(path: Column) -> Column:
    return F.upper(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def track_key(path: Column) -> Column:
    """A stable id of a path: the first 16 hexadecimal digits of its digest."""
    return F.substring(F.sha2(path, 256), 1, 16)


def year(date: Column) -> Column:
    return F.nullif(F.regexp_extract(date, r"^(\d{4})", 1), F.lit("")).cast("int")


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def weakly_normalised(name: Column) -> Column:
    return F.lower(F.trim(name))


def spaced(name: Column) -> Column:
    """Lower case, with a space for each run of what is neither letter nor digit."""
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))


def canonical(name: Column) -> Column:
    """Lower case, each run of white space one space."""
    return F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))


def relative_path(path: Column, root: str) -> Column:
    """Lower case, with forward slashes, without root and leading slashes."""
    low = F.lower(F.regexp_replace(path, r"\\", "/"))
    return F.regexp_replace(F.when(F.startswith(low, F.lit(root)), F.substr(low, F.lit(len(root) + 1))).otherwise(low), "^/+", "")


def without_lyric_times(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"\[\d{1,2}:\d{2}(\.\d{1,3})?\]", ""))


def has_lyric_times(line: Column) -> Column:
    return line.rlike(r"\[\d{1,2}:\d{2}(\.\d{1,3})?\]")


def lyric_time(ms: Column) -> Column:
    """Milliseconds as minutes, seconds and hundredths."""
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(F.lit("["), two(F.floor(ms / 60000)), F.lit(":"), two(F.floor(ms / 1000) % 60), F.lit("."), two(F.floor(ms / 10) % 100), F.lit("]"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, where x is computed once however often f uses it, in lambdas too."""
    return F.transform(F.array(x), f)[0]


def unit(v: Column) -> Column:
    """v at length 1, null where it is zero; its length is computed once for all components."""
    return bound(v, lambda w: bound(F.sqrt(dot(w, w)), lambda n: F.when(n > 0, F.transform(w, lambda x: x / n))))


def or_default(value: Column, default: float) -> Column:
    """value, or default where it is null or zero."""
    return F.when(value.isNull() | (value == 0), F.lit(default)).otherwise(value)


#: Places on the wheel of keys, by pitch class from C, of major and minor keys.
WHEEL_MAJOR = (8, 3, 10, 5, 12, 7, 2, 9, 4, 11, 6, 1)
WHEEL_MINOR = (5, 12, 7, 2, 9, 4, 11, 6, 1, 8, 3, 10)
PITCHES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")


def wheel_place(key: Column, mode: Column) -> Column:
    """The number of a key on the wheel (1 to 12)."""
    at = F.array_position(F.array(*map(F.lit, PITCHES)), key).cast("int")
    of = lambda places: F.try_element_at(F.array(*map(F.lit, places)), F.nullif(at, F.lit(0)))
    return F.when(mode == "minor", of(WHEEL_MINOR)).otherwise(of(WHEEL_MAJOR))


def compatible(place: Column, mode: Column, other_place: Column, other_mode: Column) -> Column:
    """Neighbours on the wheel of one mode, or the same place of both."""
    step = F.pmod(place - other_place, F.lit(12))
    return F.when(mode == other_mode, step.isin(0, 1, 11)).otherwise(step == 0)
