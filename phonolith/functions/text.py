"""Names, paths and other text as column expressions (PRJ1 to PRJ5, SC1 to SC5, NFC keys)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as str.strip() sees it.
_WS = r"[\s\x1c-\x1f]"
AUDIO_EXTENSIONS = ("flac", "wav", "aiff", "aif", "mp3", "m4a", "alac")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{_WS}+|{_WS}+$", "")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def stem(path: Column) -> Column:
    """The file name without its last extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]+$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r".\.([^.]+)$", 1))


def is_audio(path: Column) -> Column:
    return extension(path).isin(*AUDIO_EXTENSIONS)


def _without_number(path: Column) -> Column:
    return strip(F.regexp_replace(stem(path), r"(?U)^\s*\d+\s*-\s*", ""))


def _parts(path: Column) -> Column:
    return F.filter(F.transform(F.split(_without_number(path), " - "), strip), lambda p: p != "")


def title_from_path(path: Column) -> Column:
    parts, bare = _parts(path), _without_number(path)
    joined = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), " - ")
    return F.when(F.size(parts) >= 2, joined).when(bare != "", bare).otherwise(stem(path))


def artist_from_path(path: Column) -> Column:
    parts = _parts(path)
    return F.when(F.size(parts) >= 2, parts[0])


def full(c: Column) -> Column:
    """Null for an empty string: both count as missing when merging."""
    return F.when(c != "", c)


def display_name(artist: Column, title: Column) -> Column:
    return F.concat_ws(" - ", full(artist), title)


def collection_path(dir_value: Column, file_value: Column) -> Column:
    """A collection's DIR and FILE as a path: ``/:`` is a slash, other colons go."""
    folder = F.replace(F.replace(dir_value, F.lit("/:"), F.lit("/")), F.lit(":"), F.lit(""))
    return F.when(file_value.startswith("/"), file_value).otherwise(F.concat(F.regexp_replace(folder, "/+$", ""), F.lit("/"), file_value))


@F.pandas_udf(T.StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


def nfc(c: Column) -> Column:
    """Canonical composition."""
    return _nfc(c)


def path_order(path: Column) -> Column:
    """Sorts paths component by component."""
    return F.split(path, "/")


def sanitise(c: Column, fallback: str = "untitled") -> Column:
    c = F.regexp_replace(strip(c), r"[/:\\]+", " - ")
    c = F.regexp_replace(c, r"[\x00\r\n\t]+", " ")
    c = F.regexp_replace(F.regexp_replace(c, rf"(?U){_WS}+", " "), r"^[ .]+|[ .]+$", "")
    return F.coalesce(full(c), F.lit(fallback))


def duration(seconds: Column) -> Column:
    whole = seconds.cast("bigint")
    long = F.format_string("%dm %02ds", F.floor(whole / 60).cast("bigint"), whole % 60)
    return F.when(seconds < 60, F.format_string("%.1fs", seconds)).otherwise(long)


def yes_no(c: Column) -> Column:
    return F.when(c, "yes").otherwise("no")


def version_key(path: Column, app: str) -> Column:
    """The numbers of the version that follows the application's name; [0] without one."""
    found = F.regexp_extract(path, rf"{app}\s+([0-9][0-9.]*)", 1)
    numbers = F.transform(F.filter(F.split(found, r"\."), lambda p: p.rlike("^[0-9]+$")), lambda p: p.cast("int"))
    return F.when(found == "", F.array(F.lit(0))).otherwise(numbers)


def fraction(c: Column) -> Column:
    """'39/5' or '7.8' as a number; null where it is neither."""
    over = F.split(c, "/")
    top = over[0].try_cast("double")
    bottom = F.when(F.size(over) == 1, F.lit(1.0)).when(F.size(over) == 2, F.try_element_at(over, F.lit(2)).try_cast("double"))
    return F.when(bottom != 0, top / bottom)


def shell_quote(c: Column) -> Column:
    """One word of a POSIX shell command."""
    quoted = F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("'\"'\"'")), F.lit("'"))
    return F.when(c.rlike(r"^[\w@%+=:,./-]+$"), c).otherwise(quoted)
