"""Normalisation of raw values to taxonomy keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import constants as C
from tessera.functions.cells import blank, clean, labels, lookup

NAMES = {name.lower(): iso for iso, name in C.COUNTRIES.items()}


def iso_country(name: Column, names: dict[str, str] = NAMES) -> Column:
    """ISO code of a country name, whatever its case and outer blanks; null if unknown."""
    return lookup(clean(name), names)


def level(text: Column, synonyms=C.LEVEL_SYNONYMS, valid=C.LEVELS) -> Column:
    key = clean(text)
    return F.coalesce(lookup(key, synonyms), F.when(key.isin(valid), key))


def modality(text: Column, synonyms=C.MODALITY_SYNONYMS, valid=C.MODALITIES) -> Column:
    key = clean(text)
    plain = F.translate(key, "- ", "__")
    return F.coalesce(lookup(key, synonyms), F.when(plain.isin(valid), plain))


def tags(values: Column, synonyms=C.MISSION_SYNONYMS, valid=C.MISSIONS) -> Column:
    """Canonical tags in the given order, repeats kept, unknown ones dropped; empty for null."""

    def one(x: Column) -> Column:
        key = F.replace(clean(x), F.lit("-"), F.lit("_"))
        return F.coalesce(lookup(clean(x), synonyms), lookup(key, synonyms), F.when(key.isin(valid), key))

    return F.coalesce(F.array_compact(F.transform(values, one)), F.array().cast("array<string>"))


def keys(values: Column, valid: list[str]) -> Column:
    """Benefits, policies and donors: blanks and hyphens become underscores, unknown ones are dropped."""

    def one(x: Column) -> Column:
        key = F.translate(clean(x), "- ", "__")
        return F.when(key.isin(valid), key)

    return F.coalesce(F.array_compact(F.transform(values, one)), F.array().cast("array<string>"))


def benefits(values: Column) -> Column:
    return keys(values, C.BENEFITS)


def policies(values: Column) -> Column:
    return keys(values, C.POLICIES)


def donors(values: Column) -> Column:
    return keys(values, C.DONORS)


def boolean(text: Column) -> Column:
    """true/yes/1/t/y, false/no/0/f/n, other numbers by being 0; else null."""
    key = clean(text.cast("string"))
    number = key.try_cast("double")
    return F.when(key.isin("true", "yes", "1", "t", "y"), True).when(key.isin("false", "no", "0", "f", "n"), False).when(number.isNotNull(), number != 0)


def contract_months(text: Column) -> Column:
    """Months of a duration: the first number before month/mo, else years times 12; of a range the part next to the unit."""
    key = F.lower(text)

    def number(pattern: str) -> Column:
        return F.regexp_extract(key, pattern, 1).try_cast("int")

    return F.coalesce(number(r"(\d+)\s*(?:month|mo)"), number(r"(\d+)\s*(?:year|yr)") * 12)


def compensation(text: Column, low: Column | None = None, high: Column | None = None, currency: Column | None = None, kind: Column | None = None) -> Column:
    """(visible, type, min_usd, max_usd, currency, confidence) from structured values if there are any, else from text.

    Text: the first two amounts, in either order; the unit by word; USD where no currency is named. A lone comma is no
    amount. Unknown currencies count at rate 1.
    """
    none = F.lit(None)
    structured = F.lit(False) if low is None and high is None else F.coalesce(low, high).isNotNull()
    given = F.coalesce(currency, F.lit("USD")) if currency is not None else F.lit("USD")
    symbols = [("\\$", "USD"), ("€", "EUR"), ("£", "GBP"), ("₹", "INR")]
    code = F.upper(F.regexp_extract(text, r"(?i)\b(USD|EUR|GBP|INR|CHF|KES|ZAR|CAD|AUD)\b", 1))
    found = F.coalesce(*[F.when(text.rlike(s), F.lit(c)) for s, c in symbols], F.when(code != "", code), F.lit("USD"))
    amounts = F.slice(F.regexp_extract_all(text, F.lit(r"([\d,]+(?:\.\d{2})?)"), 1), 1, 2)
    numbers = F.array_compact(F.transform(amounts, lambda a: F.replace(a, F.lit(","), F.lit("")).try_cast("double")))
    unit = F.when(text.rlike(r"(?i)\b(hour|hourly|hr)\b"), "hourly").when(text.rlike(r"(?i)\b(day|daily)\b"), "daily").when(text.rlike(r"(?i)\b(month|monthly)\b"), "monthly").otherwise("salary")
    rate = F.coalesce(lookup(found, C.RATES), F.lit(1.0))
    given_rate = F.coalesce(lookup(given, C.RATES), F.lit(1.0))
    in_text = F.coalesce(text.isNotNull() & (F.trim(text) != ""), F.lit(False))
    seen = in_text & (F.size(numbers) > 0)

    def part(from_fields: Column, from_text: Column, other: Column) -> Column:
        return F.when(structured, from_fields).when(seen, from_text).otherwise(other)

    low_usd = (low.try_cast("double") * given_rate) if low is not None else none.cast("double")
    high_usd = (high.try_cast("double") * given_rate) if high is not None else none.cast("double")
    return F.struct(
        (structured | seen).alias("visible"),
        part(F.coalesce(kind, F.lit("salary")) if kind is not None else F.lit("salary"), unit, none).alias("type"),
        part(low_usd, F.array_min(numbers) * rate, none).alias("min_usd"),
        part(high_usd, F.array_max(numbers) * rate, none).alias("max_usd"),
        F.when(structured, given).when(in_text, found).alias("currency"),
        part(F.lit(0.9), F.lit(0.7), F.lit(0.0)).alias("confidence"),
    )


def unknowns(fields: dict[str, tuple[Column, Column]]) -> Column:
    """What normalisation lost: (field, value) for each raw value of an array without a counterpart.

    ``fields`` maps a name to (raw array, normalised array).
    """

    def lost_of(field: str, raw: Column, done: Column) -> Column:
        return F.transform(F.array_except(F.transform(raw, clean), F.transform(done, clean)), lambda v: F.struct(F.lit(field).alias("field"), v.alias("value")))

    lost = [lost_of(f, raw, done) for f, (raw, done) in fields.items()]
    return F.concat(*[F.coalesce(x, F.array().cast("array<struct<field:string,value:string>>")) for x in lost])


def old_country(text: Column) -> Column:
    return lookup(clean(text), C.OLD_COUNTRIES)


def old_level(text: Column) -> Column:
    return lookup(clean(text), C.OLD_LEVELS)


def old_tags(values: Column) -> Column:
    """The older profile: hyphenated tags, each once, in the order given."""
    return F.coalesce(F.array_distinct(F.array_compact(F.transform(values, lambda x: lookup(clean(x), C.OLD_TAGS)))), F.array().cast("array<string>"))


def old_boolean(text: Column) -> Column:
    """As :func:`boolean`, but of numbers only 1 and 0 count."""
    key = clean(text.cast("string"))
    return F.when(key.isin("true", "yes", "y", "1", "t"), True).when(key.isin("false", "no", "n", "0", "f"), False)


def lookup_errors(scalars: dict[str, tuple[Column, list[str]]], arrays: dict[str, tuple[Column, list[str]]]) -> Column:
    """One message for each field whose value is in no lookup table; null passes."""
    one = [(c.isNotNull() & ~c.isin(valid), F.concat(F.lit(f"Invalid {name}: "), c)) for name, (c, valid) in scalars.items()]
    many = [(F.size(bad := F.array_except(c, F.lit(valid).cast("array<string>") if not valid else F.array(*[F.lit(v) for v in valid]))) > 0, F.concat(F.lit(f"Invalid {name}: "), F.array_join(bad, ", "))) for name, (c, valid) in arrays.items()]
    return labels([*one, *many])


def transform(value: Column, steps: list) -> Column:
    """A chain of named transforms over a string (or, for join and first, an array of strings).

    Steps: 'lower', 'upper', 'strip', 'first', ('join', sep), ('map_table', dict), ('default', value),
    ('date_parse', 'iso8601' | 'unix' | 'unix_ms').
    """
    for step in steps:
        name, arg = (step, None) if isinstance(step, str) else step
        if name == "lower":
            value = F.lower(value)
        elif name == "upper":
            value = F.upper(value)
        elif name == "strip":
            value = F.trim(value)
        elif name == "first":
            value = F.get(value, 0)
        elif name == "join":
            value = F.array_join(value, ", " if arg is None else arg)
        elif name == "map_table":
            value = F.coalesce(lookup(value, arg), value)
        elif name == "default":
            value = F.when(blank(value), F.lit(arg)).otherwise(value)
        elif name == "date_parse":
            value = F.try_to_timestamp(value) if arg in (None, "iso8601") else F.timestamp_millis(value.try_cast("long") * (1000 if arg == "unix" else 1))
        else:
            raise ValueError(f"unknown transform: {name}")
    return value
