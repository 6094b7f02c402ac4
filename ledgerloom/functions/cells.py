"""What cells of an export show of a listing, and two areas on one footing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import SQFT_PER_SQM, normalize_number


def _some(c: Column) -> Column:
    return F.when(c != "", c)


def rent_cell(value: Column, text: Column) -> Column:
    """The rent as a number if there is one, else its text, else that it is told on application."""
    return F.struct(value.alias("value"), F.when(value.isNull(), F.coalesce(_some(text), F.lit("On application"))).alias("text"))


def agent_cell(organisation: Column, agents: Column) -> Column:
    """The organisation and the first agent's name (agents: array of name, tel, mobile, email)."""
    return F.concat_ws(" – ", _some(organisation), _some(F.get(agents, F.lit(0))["name"]))


def contact_cell(agents: Column) -> Column:
    """The first agent's mobile, else telephone, and mail."""
    a = F.get(agents, F.lit(0))
    return F.concat_ws(" / ", F.coalesce(_some(a["mobile"]), _some(a["tel"])), _some(a["email"]))


def street_cell(line1: Column, line2: Column, town: Column) -> Column:
    return F.concat_ws(", ", _some(line1), _some(line2), _some(town))


def on_one_footing(a: Column, unit_a: Column, b: Column, unit_b: Column) -> Column:
    """Two areas (texts) as numbers on the first one's footing: a, b; both null where they can't be compared.

    Equal units, or none on both sides, are one footing; feet and metres are converted. A unit on one side only says
    nothing, and other pairs of units can't be compared.
    """
    x, y = normalize_number(a), normalize_number(b)
    u, v = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (unit_a, unit_b))
    other = F.when(u == v, y).when((u == "sq ft") & (v == "sq m"), y * SQFT_PER_SQM).when((u == "sq m") & (v == "sq ft"), y / SQFT_PER_SQM)
    good = x.isNotNull() & other.isNotNull()
    return F.struct(F.when(good, x).alias("a"), F.when(good, other).alias("b"))
