"""File and group names; Python UDFs, as Spark has no Unicode normal forms."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F

# Names that Windows reserves, and the longest name.
RESERVED = {"con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10))}
MAX_NAME = 120


def split_name(raw: str | None) -> tuple[str, str]:
    """(stem, extension in lower case) of the last part of a path, in composed form."""
    name = unicodedata.normalize("NFC", raw or "").replace("\\", "/").rsplit("/", 1)[-1].strip()
    stem, dot, ext = name.rpartition(".")
    return (stem, "." + ext.lower()) if dot and stem else (name, "")


def safe_filename(raw: str | None) -> str:
    """A name that is safe on every file system: forbidden characters and blanks become single hyphens; never longer than MAX_NAME."""
    stem, ext = split_name(raw)
    stem = "".join(c for c in stem if unicodedata.category(c)[0] != "C")
    stem = re.sub(r'[<>:"/\\|?*\s]+', "-", stem)
    stem = re.sub(r"-{2,}", "-", stem).strip("-. ")
    if not stem or stem.lower() in RESERVED:
        stem = f"{stem or 'document'}-file" if stem else "document"
    return stem[: MAX_NAME - len(ext)].rstrip("-. ") + ext


def stem_key(raw: str | None) -> str:
    """What two names that clash on any file system have in common."""
    return unicodedata.normalize("NFC", split_name(raw)[0]).casefold()


def slug(raw: str | None) -> str:
    """Lower-case ASCII words joined by hyphens; đ becomes d."""
    plain = unicodedata.normalize("NFD", (raw or "").lower().replace("đ", "d"))
    plain = "".join(c for c in plain if not unicodedata.combining(c))
    return re.sub(r"[^a-z0-9]+", "-", plain).strip("-")


def _udf(fn):
    @F.pandas_udf("string")
    def mapped(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else fn(v))

    return mapped


def safe_filename_col(column):
    return _udf(safe_filename)(column)


def stem_key_col(column):
    return _udf(stem_key)(column)


def slug_col(column):
    return _udf(slug)(column)
