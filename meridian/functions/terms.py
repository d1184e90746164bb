"""Column functions over RDF terms and labels. All are native expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def lat(geo: Column) -> Column:
    """The latitude of ``<geo:LAT,LNG>``; null if the term has another form."""
    return F.regexp_extract(geo, r"^<geo:([^,>]+),([^>]+)>$", 1).try_cast("double")


def lng(geo: Column) -> Column:
    return F.regexp_extract(geo, r"^<geo:([^,>]+),([^>]+)>$", 2).try_cast("double")


def short_label(label: Column) -> Column:
    """``"text"@lang`` without quotes and language, cut at its last comma."""
    plain = F.regexp_replace(F.regexp_replace(label, r'^"', ""), r'"@.*$', "")
    return F.regexp_replace(plain, r",[^,]*$", "")


def short_label_lower(label: Column) -> Column:
    return F.lower(short_label(label))


def is_english(label: Column) -> Column:
    return F.substring(label, -3, 3) == "@en"


def name_in_label(name: Column, label: Column) -> Column:
    """Every space-separated word of the name occurs in the label, case kept."""
    return F.forall(F.split(name, " "), lambda w: F.contains(label, w))


def join_names(name: Column, varname: Column) -> Column:
    """``name|varname`` in lower case; a missing part adds nothing."""
    return F.lower(F.concat_ws("|", name, varname))


def strip_types(label: Column, types: list[str]) -> Column:
    """The label without each region type word, longer ones first."""
    return reduce(lambda c, t: F.replace(c, F.lit(t), F.lit("")), sorted({t.lower() for t in types}, key=lambda t: (-len(t), t)), label)


def same_type(label: Column, kind: Column) -> Column:
    return F.contains(F.lower(label), F.lower(kind))


def vp_key(predicate: Column) -> Column:
    """``host/local`` of a predicate's IRI: local is what follows ``#``, else the last ``/``."""
    host = F.regexp_extract(predicate, r"^<https?://([^/>]*)", 1)
    local = F.regexp_extract(predicate, r"[#/]([^#/>]*)>$", 1)
    return F.concat(host, F.lit("/"), local)


def ordered_key(a: Column, b: Column) -> Column:
    """The same text for a pair in either order."""
    return F.concat_ws("#", F.least(a, b), F.greatest(a, b))
