"""Version numbers as comparable arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_VERSION = r"(?i)^v?(\d+(?:\.\d+)*)(?:[-_.]?(dev|alpha|a|beta|b|preview|pre|rc|c)[-_.]?(\d*))?$"


def is_plain(version: Column) -> Column:
    """Digits and dots, with at most a pre-release at the end; anything else (ranges) is out of scope."""
    return F.coalesce(F.regexp_like(version, F.lit(_VERSION)), F.lit(False))


def _number(digits: Column) -> Column:
    """Digits of any length as text that sorts as the number does."""
    bare = F.regexp_replace(digits, "^0+", "")
    return F.concat(F.lpad(F.length(bare).cast("string"), 6, "0"), bare)


def _parts(numbers: Column) -> Column:
    return F.transform(numbers, lambda part: F.concat(F.lit("2"), _number(part)))


def _release(version: Column) -> Column:
    return F.regexp_extract(version, _VERSION, 1)


def _without_end_zeros(release: Column) -> Column:
    return F.split(F.regexp_replace(release, r"(\.0+)+$", ""), "[.]")


def numbers(version: Column) -> Column:
    """The release's numbers as they are written, zeros at the end included."""
    return F.split(_release(version), "[.]")


def is_prerelease(version: Column) -> Column:
    return F.regexp_extract(version, _VERSION, 2) != ""


def version_key(version: Column) -> Column:
    """An array that sorts as the version does; NULL unless plain.

    Zeros at the end say nothing (1.0 equals 1.0.0), a pre-release comes before its release and
    after every lower one, numbers may have any length.
    """
    parts = _parts(_without_end_zeros(_release(version)))
    phase = F.lower(F.regexp_extract(version, _VERSION, 2))
    rank = F.when(phase == "dev", "0").when(phase.isin("a", "alpha"), "1").when(phase.isin("b", "beta"), "2").otherwise("3")
    end = F.when(phase == "", F.lit("1")).otherwise(F.concat(F.lit("0"), rank, _number(F.regexp_extract(version, _VERSION, 3))))
    return F.when(is_plain(version), F.concat(parts, F.array(end)))


def key_after(key: Column) -> Column:
    """The least bound above a key: no key lies between the two."""
    return F.concat(key, F.array(F.lit("")))


def floor_key(version: Column) -> Column:
    """Below the release and all its pre-releases, above every lower release."""
    return F.concat(_parts(_without_end_zeros(_release(version))), F.array(F.lit("0")))


def ceiling_key(prefix: Column) -> Column:
    """Above every version that begins with these numbers, below the pre-releases of the next."""
    return F.concat(_parts(prefix), F.array(F.lit("3")))
