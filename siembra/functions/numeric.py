"""Numbers from text, guarded ratios, classes and rounding as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Normal quantiles of one-sided service levels.
Z_TABLE = {0.80: 0.8416, 0.85: 1.0364, 0.90: 1.2816, 0.95: 1.6449, 0.975: 1.96, 0.98: 2.0537, 0.99: 2.3263, 0.995: 2.5758}


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den where the denominator is positive, else 0."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def capped(c: Column, most: float) -> Column:
    return F.least(c, F.lit(most))


def finite(c: Column) -> Column:
    """Null for NaN and infinities: they never get into sums."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def bucket(c: Column, steps: Sequence[tuple[float, str]], rest: str, strict: bool = False) -> Column:
    """The label of the first threshold that ``c`` reaches (or exceeds, if strict), thresholds from high to low."""
    out: Column | None = None
    for least, label in steps:
        hit = c > least if strict else c >= least
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(rest)


def below(c: Column, steps: Sequence[tuple[float, str]], rest: str) -> Column:
    """The label of the first bound that ``c`` is under, bounds from low to high."""
    out: Column | None = None
    for most, label in steps:
        out = F.when(c < most, label) if out is None else out.when(c < most, label)
    return out.otherwise(rest)


def right_closed(c: Column, bounds: Sequence[float], labels: Sequence[str]) -> Column:
    """Bins (-inf, b1], (b1, b2], ..., (bn, inf)."""
    out: Column | None = None
    for b, label in zip(bounds, labels, strict=False):
        out = F.when(c <= b, label) if out is None else out.when(c <= b, label)
    return out.otherwise(labels[-1])


def lookup(c: Column, table: Mapping[str, object]) -> Column:
    """A fixed lookup; null for other values."""
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[c]


def parse_number(c: Column) -> Column:
    """Text with , or . decimals, dotted thousands and exponents; junk is null."""
    text = F.replace(F.replace(F.trim(c.cast("string")), F.lit(" "), F.lit("")), F.lit(","), F.lit("."))
    dots = F.length(text) - F.length(F.replace(text, F.lit("."), F.lit("")))
    joined = F.concat(F.replace(F.regexp_extract(text, r"^(.*)\.", 1), F.lit("."), F.lit("")), F.lit("."), F.substring_index(text, ".", -1))
    plain = F.when(F.upper(text).contains("E") | (dots <= 1), text).otherwise(joined)
    return F.when(~F.upper(text).isin("", "NULL", "NONE", "NAN"), _double(plain))


def _double(text: Column) -> Column:
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def parse_ledger_number(c: Column) -> Column:
    """Ledger text: (1.234,56) is negative, $ % and spaces go, the last of , and . is the decimal sign.

    With one kind of sign repeated, groups of three are thousands; else the last one is decimal.
    """
    raw = F.trim(c.cast("string"))
    sign = F.when(raw.startswith("(") & raw.endswith(")"), -1.0).otherwise(1.0)
    # a column is spelled out wherever it is referred to, and code above 64 KB isn't compiled: the text is bound to a name once
    plain = F.transform(F.array(F.translate(raw, "−()$%\t\n\x0b\f\r \xa0", "-")), _plain_ledger)[0]
    return F.regexp_extract(plain, r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\z", 1).try_cast("double") * sign


def _plain_ledger(text: Column) -> Column:
    """Ledger text without its thousands, with a decimal point."""
    count = lambda sign: F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))
    dots, commas = count("."), count(",")
    comma_last = F.locate(",", F.reverse(text)) < F.locate(".", F.reverse(text))
    drop = lambda t, sign: F.replace(t, F.lit(sign), F.lit(""))

    def grouped(sign: str, escaped: str) -> Column:
        thousands = text.rlike(rf"^[^{escaped}]*({escaped}[^{escaped}]{{3}})+$")
        last = F.concat(drop(F.regexp_extract(text, rf"^(.*){escaped}", 1), sign), F.lit("."), F.substring_index(text, sign, -1))
        return F.when(thousands, drop(text, sign)).otherwise(last)

    both = F.when(comma_last, F.replace(drop(text, "."), F.lit(","), F.lit("."))).otherwise(drop(text, ","))
    return (
        F.when(F.upper(text).contains("E"), F.replace(text, F.lit(","), F.lit(".")))
        .when((dots > 0) & (commas > 0), both)
        .when(commas > 1, grouped(",", ","))
        .when(commas == 1, F.replace(text, F.lit(","), F.lit(".")))
        .when(dots > 1, grouped(".", r"\."))
        .otherwise(text)
    )


def half_even(c: Column, digits: int = 0) -> Column:
    """Rounding to even halves."""
    return F.bround(c, digits)


def to_decimal(c: Column, precision: int, scale: int) -> Column:
    """A double clipped to what numeric(precision, scale) holds and rounded; NaN and infinities are null."""
    most = 10.0 ** (precision - scale) - 10.0**-scale
    kept = finite(c)
    return F.when(kept.isNotNull(), F.bround(F.greatest(F.least(kept, F.lit(most)), F.lit(-most)), scale)).try_cast(f"decimal({precision},{scale})")


def z_score_of(service: float) -> float:
    """The quantile of the nearest service level in the table."""
    return Z_TABLE[min(Z_TABLE, key=lambda k: (abs(k - service), k))]


def safety_stock(sigma: Column, lead_months: float, service: float = 0.95) -> Column:
    return F.lit(z_score_of(service)) * sigma * F.sqrt(F.lit(lead_months))


def to_lot(c: Column, lot: int = 5) -> Column:
    """Rounded up to whole lots."""
    return F.ceil(c / lot) * lot


def history_cap(prediction: Column, *history: Column, times: float = 3.0) -> Column:
    """At most ``times`` the largest of the history columns, and no cap without history."""
    most = F.greatest(F.lit(0.0), *(F.coalesce(h, F.lit(0.0)) for h in history)) * times
    value = F.coalesce(finite(prediction), F.lit(0.0))
    return F.greatest(F.when(most > 0, F.least(value, most)).otherwise(value), F.lit(0.0))
