"""Unknown values: the spellings that mean "not known", and the predicates that deliberately differ from each other."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of "unknown" by language.
UNKNOWN = [
    "", "tbd", "tbc", "—", "-", "n/a", "na", "n.a", "poa", "to be confirmed", "?",
    "a consultar", "consultar", "a convenir", "segun proyecto", "según proyecto", "sc",
    "a consulter", "à consulter", "nous consulter", "sur demande", "nc", "n.c",
    "auf anfrage", "k.a", "keine angabe",
    "su richiesta", "da definire", "in trattativa",
    "op aanvraag", "n.v.t", "nvt",
    "sob consulta",
    "do uzgodnienia", "do negocjacji",
]


def clean_value(c: Column) -> Column:
    """White space of any kind collapsed to one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def looks_unknown(c: Column) -> Column:
    """Null, or one of the spellings after trimming, lower case and dropping final dots."""
    return F.coalesce(F.rtrim(F.lower(F.trim(c)), F.lit(".")).isin(UNKNOWN), F.lit(True))


def is_tbd(c: Column) -> Column:
    """looks_unknown, or the country placeholder ??."""
    return looks_unknown(c) | F.coalesce(F.trim(c) == "??", F.lit(False))


#: The placeholders that a sink writes.
PLACEHOLDERS = ["", "tbd", "—", "-", "n/a", "null", "??"]


def is_absent(c: Column) -> Column:
    """Null, blank or one of the placeholders that a sink writes."""
    return F.coalesce(F.lower(F.trim(c)).isin(PLACEHOLDERS), F.lit(True))


#: What counts as unset where an override says what it expects.
UNSET = ["", "tbd", "tbc", "—", "-", "n/a", "none", "??"]


def is_unset(c: Column) -> Column:
    """Null, or a placeholder; narrower than looks_unknown, as a price on request is a value that an override can expect."""
    return F.coalesce(F.lower(F.trim(c)).isin(UNSET), F.lit(True))


def sentinel(c: Column, field: str) -> Column:
    """The value as a sink shows it: cleaned, or the field's placeholder where it is unknown."""
    shown = {"landPrice": F.lit("—"), "reit": F.lit(None).cast("string")}.get(field, F.lit("tbd"))
    return F.when(looks_unknown(c), shown).otherwise(clean_value(c))
