"""Label dimension: aliases, display names, families, codes. All are column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# The seven call types, their display names and their coarse families.
CLASSES = ("bma", "bmb", "bmz", "bmd", "bp20", "bp20plus", "bpd")
DISPLAY = {"bma": "Bm-A", "bmb": "Bm-B", "bmz": "Bm-Z", "bmd": "Bm-D", "bp20": "Bp-20", "bp20plus": "Bp-20Plus", "bpd": "Bp-40Down"}
ALIASES = {**{c: c for c in CLASSES}, "bp40down": "bpd"}
FAMILIES = {"bma": "ABZ", "bmb": "ABZ", "bmz": "ABZ", "bmd": "DDswp", "bpd": "DDswp", "bp20": "20Hz20Plus", "bp20plus": "20Hz20Plus"}


def mapped(key: Column, mapping: dict) -> Column:
    """Look a key up in a small fixed mapping; null where it is absent."""
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())]), key)


def alias_key(raw: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(raw)), "[-_ ]", "")


def normalised(raw: Column, aliases: dict = ALIASES) -> Column:
    """Canonical label; null where the alias is unknown."""
    return mapped(alias_key(raw), aliases)


def display_name(raw: Column, aliases: dict = ALIASES, display: dict = DISPLAY) -> Column:
    return mapped(normalised(raw, aliases), display)


def aggregated(label: Column, mapping: dict) -> Column:
    """Coarser label; labels outside the mapping pass through. An empty mapping is an error."""
    if not mapping:
        raise ValueError("label aggregation is on, but its mapping is empty")
    return F.coalesce(mapped(label, mapping), label)


def code(label: Column, classes) -> Column:
    """0-based position among the declared classes; null if undeclared."""
    at = F.array_position(F.array(*[F.lit(c) for c in classes]), label)
    return F.when(at > 0, (at - 1).cast("int"))


def undeclared(df, label: str, classes) -> list[str]:
    """Sorted labels that are not declared; at most one row per distinct label is fetched."""
    found = df.where(~F.col(label).isin(*classes)).select(label).distinct().orderBy(label)
    return [r[0] for r in found.collect()]


def require_declared(df, label: str, classes) -> None:
    if unknown := undeclared(df, label, classes):
        raise ValueError(f"labels outside the declared classes: {', '.join(unknown)}")
