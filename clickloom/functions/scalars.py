"""Scalar expressions of the clickstream model, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clickloom.policies import MISSING

# Upper edges of the price bands (right-closed) and of the session length bands.
PRICE_EDGES = ((25.0, "(-inf, 25]"), (50.0, "(25, 50]"), (100.0, "(50, 100]"), (250.0, "(100, 250]"), (500.0, "(250, 500]"), (1000.0, "(500, 1000]"))
PRICE_TOP = "(1000, inf)"
LENGTH_EDGES = ((1, "1"), (2, "2"), (5, "3-5"), (10, "6-10"), (20, "11-20"), (50, "21-50"), (100, "51-100"))
LENGTH_TOP = "101+"
PRICE_BANDS = tuple(name for _, name in PRICE_EDGES) + (PRICE_TOP, MISSING)
LENGTH_BANDS = tuple(name for _, name in LENGTH_EDGES) + (LENGTH_TOP,)


def parse_event_time(text: Column) -> Column:
    """`yyyy-MM-dd HH:mm:ss UTC` as a zone-free timestamp in UTC; anything else is null."""
    head = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) UTC$", 1)
    return F.when(head != "", head).try_cast("timestamp_ntz")


def parse_number(text: Column) -> Column:
    """A double, or null for text that isn't a number, for NaN, and for numbers with a type's letter (1d, 1f)."""
    number = text.try_cast("double")
    return F.when(~F.isnan(number) & ~text.cast("string").rlike(r"[0-9.]\s*[dDfF]\s*$"), number)


def or_missing(value: Column) -> Column:
    """The text of a value; the sentinel for null."""
    return F.coalesce(value.cast("string"), F.lit(MISSING))


def _banded(value: Column, edges, top: str) -> Column:
    band = F
    for edge, name in edges:
        band = band.when(value <= edge, name)
    return band.otherwise(top)


def price_band(price: Column) -> Column:
    """The right-closed band of a price; the sentinel for null."""
    return F.when(price.isNull(), MISSING).otherwise(_banded(price, PRICE_EDGES, PRICE_TOP))


def session_length_band(events: Column) -> Column:
    """The band of a number of events."""
    return _banded(events, LENGTH_EDGES, LENGTH_TOP)


def top_level_category(code: Column) -> Column:
    """The part of a category code before its first dot; the sentinel for null, empty and `nan`."""
    return F.when(code.isNull() | code.isin("", "nan"), MISSING).otherwise(F.coalesce(F.nullif(F.split_part(code, F.lit("."), F.lit(1)), F.lit("")), F.lit(MISSING)))


def micros_between(start: Column, end: Column) -> Column:
    """Microseconds from start to end as a long, for zone-free times in any session zone."""
    gap = end - start
    whole = [F.extract(F.lit(unit), gap).cast("long") * F.lit(size) for unit, size in (("DAY", 86_400_000_000), ("HOUR", 3_600_000_000), ("MINUTE", 60_000_000))]
    return sum(whole, (F.extract(F.lit("SECOND"), gap) * F.lit(1_000_000)).cast("long"))


def minutes_between(start: Column, end: Column) -> Column:
    """Minutes from start to end as a double; null if either is."""
    return micros_between(start, end) / F.lit(60000000.0)


def fixed6(value: Column) -> Column:
    """Six decimals as text; 0.000000 for null."""
    return F.format_string("%.6f", F.coalesce(value, F.lit(0.0)))


def sample_id(order: Column) -> Column:
    """The id of the sample at a position."""
    return F.format_string("sample_%012d", order)


def iso_time(time: Column) -> Column:
    """ISO text with a UTC offset."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def is_type(event_type: Column, name: str) -> Column:
    """1 for events of a type, else 0."""
    return F.when(event_type == name, 1).otherwise(0)


def split_sequence(text: Column) -> Column:
    """The tokens of a space-joined sequence; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda t: t != "")


def tail(tokens: Column, length: int) -> Column:
    """The last `length` elements."""
    return F.slice(tokens, F.greatest(F.size(tokens) - length + 1, F.lit(1)), F.lit(length))


def non_negative(token: Column) -> Column:
    """A number that isn't below 0; 0 for what isn't a number."""
    return F.greatest(F.coalesce(parse_number(token), F.lit(0.0)), F.lit(0.0))


def padded(values: Column, length: int, filler: Column) -> Column:
    """Exactly `length` elements, filled on the right."""
    return F.slice(F.concat(values, F.array_repeat(filler, length)), 1, length)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double, 0 if whole is 0 or null."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
