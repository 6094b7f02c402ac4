"""Numbers, areas, rents and units as they stand in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units and plausible bands.
SQFT_PER_SQM = 10.7639
SQFT_PER_ACRE = 43560.0
SQM_PER_HA = 10000.0
SQM_PER_SQFT = 0.09290304
SQM_PER_ACRE = 4046.8564224
IN_SQFT = {"sq ft": 1.0, "sq m": SQFT_PER_SQM, "acres": SQFT_PER_ACRE, "ha": SQM_PER_HA * SQFT_PER_SQM}
AREA_UNITS = {"sq ft": r"sq\.?\s*ft|sqft|\bft2\b|ft²|square\s+f[eo]+t|\bpsf\b", "sq m": r"sq\.?\s*m\b|sqm|\bm2\b|m²|square\s+met", "acres": r"\bacres?\b", "ha": r"\bha\b|hectare"}
CURRENCIES = {"£": r"£|\bgbp\b", "€": r"€|\beuros?\b|\beur\b"}
RENT_SQM, RENT_SQFT = (1.5, 500.0), (0.5, 60.0)
AREA_SQM, AREA_SQFT = (300.0, 600_000.0), (3_000.0, 6_500_000.0)
PLOT_MOST = {"sq m": 10_000_000.0, "sq ft": 110_000_000.0}
SUSPECT_SQM, SUSPECT_SQFT = 60_000, 4_000
RANGE = r"(?i)\d\s*(?:[-–—]|to)\s*\d"


def first_match(text: Column, patterns: dict[str, str]) -> Column:
    """The name of the first pattern that the text holds; null if none."""
    out = F.lit(None).cast("string")
    for name, p in reversed(patterns.items()):
        out = F.when(text.rlike(f"(?i){p}"), F.lit(name)).otherwise(out)
    return out


def area_unit_of(text: Column) -> Column:
    return first_match(text, AREA_UNITS)


def currency_of(text: Column) -> Column:
    return first_match(text, CURRENCIES)


def rent_unit_of_text(text: Column) -> Column:
    """currency/area/yr as the text states it; pounds where only square feet are stated; null if neither is."""
    money, per = currency_of(text), area_unit_of(text)
    money = F.coalesce(money, F.when(per == "sq ft", "£"), F.lit("€"))
    shown = F.when(per.isin("sq ft", "sq m"), per).otherwise("sq m")
    return F.when(currency_of(text).isNotNull() | per.isNotNull(), F.concat_ws("/", money, shown, F.lit("yr")))


def area_factor(src: Column, dst: Column) -> Column:
    """What a figure in src is multiplied by to be one in dst; null where either is no known unit."""
    known = F.create_map(*[F.lit(x) for kv in IN_SQFT.items() for x in kv])
    return F.try_element_at(known, F.lower(F.trim(src))) / F.try_element_at(known, F.lower(F.trim(dst)))


def is_range(text: Column) -> Column:
    return text.rlike(RANGE)


def normalize_number(raw: Column) -> Column:
    """A number in any European notation; null for ranges and text without a number.

    With points and commas the points group and the comma is decimal. A comma alone is decimal before one or two digits
    and groups otherwise; several points group; one point groups before exactly three digits that end a number of more.
    """
    t = F.regexp_replace(raw, r"[\s\u00a0\u2007\u2009\u202f']", "")
    n = F.regexp_extract(t, r"-?\d[\d.,]*", 0)
    n = F.regexp_replace(n, "[.,]+$", "")

    def read(n: Column) -> Column:
        points, commas = (F.char_length(n) - F.char_length(F.replace(n, F.lit(c), F.lit(""))) for c in ".,")
        bare = F.replace(n, F.lit("."), F.lit(""))
        text = (
            F.when((points > 0) & (commas > 0), F.replace(bare, F.lit(","), F.lit(".")))
            .when((commas == 1) & n.rlike(r",\d{1,2}$"), F.replace(n, F.lit(","), F.lit(".")))
            .when(commas > 0, F.replace(n, F.lit(","), F.lit("")))
            .when(points > 1, bare)
            .when((points == 1) & n.rlike(r"^-?\d{1,3}\.\d{3}$"), bare)
            .otherwise(n)
        )
        return F.when(n != "", text.try_cast("double"))

    # as a list of one, so that the number's text is found once and not again in each branch
    return F.when(~is_range(raw), F.get(F.transform(F.array(n), read), 0))


def parse_size(text: Column) -> Column:
    """(sqm, unit) of a stated size: the last number before the first known unit; bare numbers from 1000 are 'sqm?'."""
    t = F.lower(text)
    factor = {"sqft": (r"(?:sq\.?\s*ft|sqft|square\s+feet|ft²|ft2)", SQM_PER_SQFT), "ha": (r"(?:ha\b|hectares?)", 10_000.0), "acres": (r"acres?\b", SQM_PER_ACRE), "sqm": (r"(?:sq\.?\s*m\b|sqm|m²|m2\b|square\s+met)", 1.0)}
    out = F.struct(F.lit(None).cast("double").alias("sqm"), F.lit(None).cast("string").alias("unit"))
    bare = normalize_number(F.regexp_extract(t, r"(\d[\d.,\s]*)", 1))
    out = F.when(bare >= 1000, F.struct(F.bround(bare).alias("sqm"), F.lit("sqm?").alias("unit"))).otherwise(out)
    for unit, (p, f) in reversed(factor.items()):
        number = normalize_number(F.regexp_extract(t, rf"(\d[\d.,]*(?: \d{{3}})*)\s*{p}", 1))
        out = F.when(t.rlike(rf"\d\s*{p}") & number.isNotNull(), F.struct(F.bround(number * f).alias("sqm"), F.lit(unit).alias("unit"))).otherwise(out)
    return F.when(t.rlike("pallet"), F.struct(F.lit(None).cast("double").alias("sqm"), F.lit(None).cast("string").alias("unit"))).otherwise(out)


def rent_band(unit: Column) -> tuple[Column, Column]:
    """Lowest and highest plausible annual rent for a currency/area/yr unit."""
    foot = F.coalesce(F.split(unit, "/")[1].contains("ft"), F.lit(False))
    return F.when(foot, RENT_SQFT[0]).otherwise(RENT_SQM[0]), F.when(foot, RENT_SQFT[1]).otherwise(RENT_SQM[1])


def area_band(unit: Column, plot: bool = False) -> tuple[Column, Column]:
    foot = F.coalesce(unit.contains("ft"), F.lit(False))
    most = (PLOT_MOST["sq ft"], PLOT_MOST["sq m"]) if plot else (AREA_SQFT[1], AREA_SQM[1])
    return F.when(foot, AREA_SQFT[0]).otherwise(AREA_SQM[0]), F.when(foot, most[0]).otherwise(most[1])


def plausible(value: Column, band: tuple[Column, Column]) -> Column:
    """pass, fail or none (nothing to judge)."""
    return F.when(value.isNull(), "none").when(value.between(*band), "pass").otherwise("fail")


def magnitude_note(value: Column, unit: Column) -> Column:
    """A note where the size fits the other unit better; the value is never converted."""
    return F.when((unit == "sq m") & (value > SUSPECT_SQM), "in the sq-ft range").when((unit == "sq ft") & (value < SUSPECT_SQFT), "in the sq-m range")


def measured(text: Column) -> Column:
    """bare, measured (a magnitude and a unit that starts with a letter and has no digit) or other."""
    return F.when(text.rlike(r"^\s*-?\d[\d.,\s]*$"), "bare").when(text.rlike(r"^\s*-?\d[\d.,\s]*[^\W\d_][^\d]*$"), "measured").otherwise("other")


def forecast(units: Column, facilities: Column, low: Column, high: Column, growth_pct: Column, years: Column) -> Column:
    """Ratio now, whether it is in the band, projected units, facilities needed at the ratio clamped to the band, and more."""
    ratio = F.when(facilities > 0, units / facilities)
    target = F.least(F.greatest(ratio, low), high)
    projected = units * F.pow(1 + growth_pct / 100, years)
    needed = F.round(projected / target, 1)
    return F.struct(F.round(ratio, 6).alias("ratio"), ratio.between(low, high).alias("in_band"), F.bround(projected).alias("projected"), needed.alias("needed"), F.round(F.greatest(needed - facilities, F.lit(0.0)), 1).alias("additional"))


BANDS = ["Low", "Medium", "High"]


def confidence(tier: Column, published: Column, today: Column, volatile: Column, sources: Column) -> Column:
    """The lowest of three bands (source tier, recency in months of 30.44 days, corroboration) and the first that is it."""
    months = F.datediff(today, published) / 30.44
    by_tier = F.when(tier <= 2, 2).when(tier <= 4, 1).otherwise(0)
    fresh, stale = F.when(volatile, 12).otherwise(24), F.when(volatile, 24).otherwise(60)
    by_age = F.when(months.isNull(), 1).when(months <= fresh, 2).when(months <= stale, 1).otherwise(0)
    by_number = F.when(sources >= 2, 2).when(tier == 1, 2).otherwise(1)
    least = F.least(by_tier, by_age, by_number)
    name = F.element_at(F.array(*map(F.lit, BANDS)), least + 1)
    return F.struct(name.alias("band"), F.when(by_tier == least, "tier").when(by_age == least, "recency").otherwise("corroboration").alias("binding"))
