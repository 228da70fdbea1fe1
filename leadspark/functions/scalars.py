"""Column expressions shared by the operators; all run inside whole-stage codegen."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.constants import FUNNEL_ORDER, HIGH_INTENT_EVENTS

MICROS_PER_DAY = 86_400_000_000.0


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def present(df: DataFrame, names) -> list[str]:
    """The names that ``df`` really has, in the order given."""
    return [n for n in names if n in df.columns]


def parse_ts(text: Column | str) -> Column:
    """Timestamp as written, without zone; text that is none becomes null."""
    return col(text).try_cast("timestamp_ntz")


def elapsed_days(start: Column | str, end: Column | str) -> Column:
    """Fractional days from ``start`` to ``end``; negative when reversed."""
    return F.timestamp_diff("MICROSECOND", col(start), col(end)) / F.lit(MICROS_PER_DAY)


def floor_zero(c: Column) -> Column:
    """Negative values become 0, null stays null."""
    return F.when(c < 0, 0.0).otherwise(c)


def lookup(mapping: dict, key: Column | str, default=None) -> Column:
    """Value of ``key`` in a small fixed mapping, or ``default``."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    found = F.try_element_at(table, col(key))
    return found if default is None else F.coalesce(found, F.lit(default))


def funnel_order(stage: Column | str, unknown: int | None) -> Column:
    """Depth of a funnel stage; ``unknown`` (1 in training, null in exploration) where it has none."""
    return lookup(FUNNEL_ORDER, stage, unknown)


def is_high_intent(event: Column | str = "event_name") -> Column:
    return F.coalesce(col(event).isin(HIGH_INTENT_EVENTS), F.lit(False))


def is_form_completion(form: Column | str = "form_completed") -> Column:
    return col(form).eqNullSafe(F.lit(True))


def safe_ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, where a zero denominator counts as 1."""
    b = col(b)
    return col(a) / F.when(b == 0, 1).otherwise(b)


def rate(part: Column | str, whole: Column | str) -> Column:
    """part / whole, 0 where that is undefined."""
    return F.coalesce(F.try_divide(col(part).cast("double"), col(whole).cast("double")), F.lit(0.0))


def flag_to_int(flag: Column | str) -> Column:
    """true/yes → 1; false, no and everything else, also '1' and null → 0."""
    return F.when(F.lower(col(flag).cast("string")).isin("true", "yes"), 1).otherwise(0)


def number_text(x: Column | str) -> Column:
    """Shortest decimal text of a double: 2400.0, 0.00012, 12345678.0, 1.2e-05."""
    x = col(x).cast("double")
    plain = x.cast("string")
    digits = F.rtrim(plain.try_cast("decimal(38,18)").cast("string"), F.lit("0"))
    positional = F.concat(digits, F.when(digits.endswith("."), "0").otherwise(""))
    mantissa = F.regexp_replace(F.substring_index(plain, "E", 1), r"\.0$", "")
    power = F.substring_index(plain, "E", -1).try_cast("int")
    scientific = F.concat(mantissa, F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    size = F.abs(x)
    return (
        F.when(~plain.contains("E"), plain)
        .when((size >= 1e-4) & (size < 1e16), positional)
        .otherwise(scientific)
    )


def percent_text(p: Column | str) -> Column:
    """0.825 → '82%': whole percent, halves to even."""
    return F.concat(F.format_number(col(p) * 100, 0), F.lit("%"))


def filled(text: str, *values: Column) -> Column:
    """``text`` with its braces replaced by the values in order."""
    parts = text.split("{}")
    return F.concat(F.lit(parts[0]), *[c for value, part in zip(values, parts[1:]) for c in (value, F.lit(part))])
