"""Model file names, sizes and formatted units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks of model tiers in the order they are looked for, with our labels.
TIERS = [("35b", "large"), ("9b", "medium"), ("4b", "small")]


def guess_context(name: Column) -> Column:
    """Context size by the first number before a B: 8192 up to 9, else 4096; null without one."""
    size = F.nullif(F.regexp_extract(name, r"(?i)(\d+(?:\.\d+)?)B", 1), F.lit("")).cast("double")
    return F.when(size <= 9, F.lit(8192)).when(size > 9, F.lit(4096)).cast("long")


def model_tier(name: Column) -> Column:
    out = F.lit("other")
    for mark, label in reversed(TIERS):
        out = F.when(F.contains(F.lower(name), F.lit(mark)), label).otherwise(out)
    return out


def kv_gb(size_bytes: Column, context: Column) -> Column:
    """Estimated cache in GB: context/8192 of 0.35 of the model's size (4 GB if unknown), two decimals, half up."""
    gb = F.when(size_bytes > 0, size_bytes / float(1 << 30)).otherwise(F.lit(4.0))
    return F.floor(context / 8192.0 * gb * 0.35 * 100 + 0.5) / 100


def _nothing(n: Column) -> Column:
    """Null, zero and NaN: what the formats below have a text of its own for."""
    return n.isNull() | (n == 0) | F.isnan(n.cast("double"))


def _fixed(x: Column, digits: int) -> Column:
    """The nearest decimal of so many digits, half away from zero, of the double's own value: ``format_string`` rounds its
    shortest decimal form, which may be a tie where the value is not. Whole and rest are apart, so that no product rounds."""
    one, size = 10**digits, F.abs(x)
    whole = F.floor(size)
    near = (whole * one + F.floor((size - whole) * one + 0.5)) / one
    # Beyond that a double has no such digits, and an infinite one no whole part.
    return F.format_string(f"%.{digits}f", F.when(size < float(1 << 43), F.when(x < 0, -near).otherwise(near)).otherwise(x))


def format_bytes(n: Column) -> Column:
    """``N/A`` for null, NaN or 0; B whole, KB to GB with one decimal."""
    n = n.cast("double")
    out = F.concat(_fixed(n / float(1 << 30), 1), F.lit(" GB"))
    for bound, unit, size in ((1 << 30, " MB", 1 << 20), (1 << 20, " KB", 1 << 10)):
        out = F.when(n < bound, F.concat(_fixed(n / float(size), 1), F.lit(unit))).otherwise(out)
    return F.when(_nothing(n), F.lit("N/A")).when(n < 1024, F.concat(F.format_string("%.0f", n), F.lit(" B"))).otherwise(out)


def format_rate(n: Column) -> Column:
    """Bytes a second: ``0 B/s`` for null, NaN or 0; KB/s with one decimal below 1 MB/s, else MB/s with two."""
    mb = float(1 << 20)
    out = F.when(n < mb, F.concat(_fixed(n / 1024.0, 1), F.lit(" KB/s"))).otherwise(F.concat(_fixed(n / mb, 2), F.lit(" MB/s")))
    return F.when(_nothing(n), F.lit("0 B/s")).otherwise(out)


def format_uptime(seconds: Column) -> Column:
    """``2d 3h``, ``3h 4m`` or ``4m``; ``N/A`` for null, NaN or 0."""
    part = lambda size, mod: (F.floor(seconds / size) % mod if mod else F.floor(seconds / size)).cast("string")
    out = F.when(seconds >= 86400, F.concat(part(86400, 0), F.lit("d "), part(3600, 24), F.lit("h"))).when(seconds >= 3600, F.concat(part(3600, 0), F.lit("h "), part(60, 60), F.lit("m"))).otherwise(F.concat(part(60, 0), F.lit("m")))
    return F.when(_nothing(seconds), F.lit("N/A")).otherwise(out)


def format_eta(seconds: Column) -> Column:
    """``Xm Ys``, ``Ys`` below a minute, both whole (cut off); ``Estimating...`` for null, 0 and what is not finite."""
    seconds = seconds.cast("double")
    minutes, rest = F.floor(seconds / 60), F.floor(seconds % 60).cast("string")
    out = F.when(minutes <= 0, F.concat(rest, F.lit("s"))).otherwise(F.concat(minutes.cast("string"), F.lit("m "), rest, F.lit("s")))
    return F.when(_nothing(seconds) | (F.abs(seconds) == float("inf")), F.lit("Estimating...")).otherwise(out)
