"""String columns with the semantics that agent logs are written with (UTF-16 lengths, full trimming)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def utf16_length(text: Column) -> Column:
    """Number of UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def trim_all(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^[\s  -     　﻿]+|[\s  -     　﻿]+\z", "")


def squeeze(text: Column) -> Column:
    return F.regexp_replace(trim_all(text), r"\s+", " ")


def trim_name(name: Column) -> Column:
    """trim_all of a column; the regular expression runs only where an end is not visible ASCII."""
    visible = F.ascii(name).between(33, 126) & F.ascii(F.substring(name, -1, 1)).between(33, 126)
    return F.when(visible, name).otherwise(trim_all(name))


def squeeze_name(name: Column) -> Column:
    """squeeze of a column; the regular expression runs only where there is more than single spaces."""
    wide = reduce(lambda a, b: a | b, (name.contains(x) for x in ("  ", "\t", "\n", "\x0b", "\f", "\r")))
    return F.when(wide, squeeze(name)).otherwise(trim_name(name))


def words(text: Column) -> Column:
    """Lower-case words without accents, in order: letters and digits of any script."""
    low = F.lower(text)
    plain = F.when(F.octet_length(low) == F.length(low), low).otherwise(F.translate(low, _ACCENTED, _PLAIN))  # ASCII has no accents
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def iso_time(millis: Column) -> Column:
    return F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that is computed once a row, however often it is used: as a generated one it is not merged into its uses."""
    return rows.select("*", F.explode(F.array(value)).alias(name))
