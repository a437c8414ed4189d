"""Version vectors as column functions. At rest a vector is canonical JSON text, inside expressions a map."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOMINATES, DOMINATED_BY, CONCURRENT, EQUAL = "DOMINATES", "DOMINATED_BY", "CONCURRENT", "EQUAL"
CLOCKS = "map<string,bigint>"


def empty() -> Column:
    return F.create_map().cast(CLOCKS)


def _read(text: Column) -> Column:
    return F.from_json(F.coalesce(text, F.lit("{}")), CLOCKS)


def _bad(clocks: Column) -> Column:
    return clocks.isNull() | F.exists(F.map_values(clocks), lambda x: x.isNull() | (x < 0))


def malformed(text: Column) -> Column:
    """Whether a vector's text is no JSON object of whole numbers from 0 to 2**63 - 1. Null is the empty vector."""
    return _bad(_read(text))


def parse(text: Column, strict: bool = True) -> Column:
    """JSON text to a map. Null is the empty vector. Malformed text is an error, so that no plan ever rests on it;
    without ``strict`` it is null (``malformed`` finds such rows)."""
    fail = lambda m: F.when(_bad(m), F.raise_error(F.concat(F.lit("malformed version vector: "), text)).cast(CLOCKS) if strict else F.lit(None).cast(CLOCKS)).otherwise(m)
    return F.transform(F.array(_read(text)), fail)[0]  # read once, looked at twice


def to_json(clocks: Column) -> Column:
    """Canonical text: keys in byte order, no blanks, only quote and backslash escaped."""
    entries = F.array_sort(F.map_entries(clocks))
    quoted = lambda k: F.concat(F.lit('"'), F.regexp_replace(k, r'(["\\])', r"\\$1"), F.lit('":'))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["key"]), e["value"].cast("string"))), ","), F.lit("}"))


def merge(a: Column, b: Column) -> Column:
    """The larger clock of each key."""
    return F.map_zip_with(a, b, lambda k, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def merge_all(vectors: Column) -> Column:
    return F.aggregate(vectors, empty(), merge)


def increment(clocks: Column, drive: Column) -> Column:
    return F.map_zip_with(clocks, F.create_map(drive, F.lit(1).cast("long")), lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def clock(clocks: Column, drive: Column) -> Column:
    return F.coalesce(F.try_element_at(clocks, drive), F.lit(0).cast("long"))


def _ahead(a: Column, b: Column) -> Column:
    """Whether some clock of a is greater than in b; a missing clock is 0."""
    return F.exists(F.map_entries(a), lambda e: e["value"] > F.coalesce(F.try_element_at(b, e["key"]), F.lit(0)))


def dominates(a: Column, b: Column) -> Column:
    return _ahead(a, b) & ~_ahead(b, a)


def concurrent(a: Column, b: Column) -> Column:
    return _ahead(a, b) & _ahead(b, a)


def covers(a: Column, b: Column) -> Column:
    """Dominates or equals."""
    return ~_ahead(b, a)


def compare(a: Column, b: Column) -> Column:
    over, under = _ahead(a, b), _ahead(b, a)
    return F.when(over & under, CONCURRENT).when(over, DOMINATES).when(under, DOMINATED_BY).otherwise(EQUAL)
