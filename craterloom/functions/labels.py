"""Values out of product labels (XML and key = value text), units and path rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metres per unit of resolution, and the usual resolution of each instrument.
UNITS = {
    "m": 1.0, "meter": 1.0, "meters": 1.0, "metre": 1.0, "metres": 1.0, "m/pixel": 1.0, "meters/pixel": 1.0, "km": 1000.0, "km/pixel": 1000.0, "cm": 0.01, "cm/pixel": 0.01, "mm": 0.001, "mm/pixel": 0.001,
}
DEFAULT_GSD = {"OHRC": 0.25, "TMC-2": 5.0, "IIRS": 80.0, "NAC": 0.5, "TC": 10.0}


def _map(names: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in names.items() for x in kv))


def metres(value: Column, unit: Column, instrument: Column) -> Column:
    """A resolution in metres: null unit means metres, an unknown one no value; then the instrument's usual one."""
    factor = F.when(unit.isNull(), F.lit(1.0)).otherwise(F.element_at(_map(UNITS), F.lower(F.trim(unit))))
    return F.coalesce(value * factor, F.element_at(_map(DEFAULT_GSD), F.upper(instrument)))


def allowed_path(path: Column, root: str) -> Column:
    """No NUL, no parent step, under root; file:// and %-escapes are undone first."""
    plain = F.try_url_decode(F.regexp_replace(F.regexp_replace(path, "^file://", ""), r"\+", "%2B"))
    return F.coalesce(~plain.contains("\0") & ~F.array_contains(F.split(plain, "/"), "..") & plain.startswith(root), F.lit(False))


def raw_value(xml: str, *tags: str) -> Column:
    """Text of the first element with one of the local names, in the order of the names; null where empty."""
    texts = (F.xpath(F.col(xml), F.lit(f"//*[local-name()='{t}']/text()")) for t in tags)
    values = [F.get(F.filter(x, lambda v: v != ""), F.lit(0)) for x in texts]
    return F.coalesce(*values)


def first_value(xml: str, *tags: str) -> Column:
    return F.nullif(F.trim(raw_value(xml, *tags)), F.lit(""))


def number(xml: str, *tags: str) -> Column:
    """The first number in a value, units and all."""
    return F.regexp_extract(first_value(xml, *tags), r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?", 0).try_cast("double")


def pds3_map(text: Column) -> Column:
    """KEY = value lines as a map: comments, quotes and <units> stripped; the first of repeated keys stands."""
    lines = F.transform(F.split(F.regexp_replace(text, r"/\*.*?\*/", ""), "\n"), lambda x: F.split(x, r"\s*=\s*", 2))
    pairs = F.transform(F.filter(lines, lambda p: F.size(p) == 2), lambda p: F.struct(F.upper(F.trim(F.get(p, F.lit(0)))).alias("k"), F.trim(F.regexp_replace(F.get(p, F.lit(1)), r"<[^>]*>|\"", "")).alias("v")))
    first = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, F.lit(1), i), lambda q: q.k == p.k))
    return F.map_from_entries(first)
