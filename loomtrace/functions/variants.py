"""Changing one path of a JSON document, in the JVM: the objects along the path are rebuilt, all else is carried over."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OBJECT = "map<string,variant>"


def _set(document: Column, steps: list[str], value: Column) -> Column:
    inner = F.try_variant_get(document, "$", _OBJECT)
    if not steps:
        return value
    step, rest = F.lit(steps[0]), steps[1:]
    members = F.coalesce(inner, F.create_map().cast(_OBJECT))
    below = F.try_element_at(members, step)
    # what isn't there yet is an object, as the path goes on
    new = _set(F.when(below.isNull(), F.parse_json(F.lit("{}"))).otherwise(below), rest, value) if rest else value
    changed = F.map_concat(F.map_filter(members, lambda k, _: k != step), F.create_map(step, new))
    # a path through what is no object leaves it as it is
    return F.when(inner.isNotNull(), F.parse_json(F.to_json(changed))).otherwise(document)


def json_set(document: Column, steps: list[str], value: Column) -> Column:
    """The document (JSON text) with ``value`` (JSON text) at a path of names, as canonical JSON: names in order, no spaces.

    Missing parents are made. A path that meets a list, a null or a plain value on its
    way changes nothing. A null or broken document stays null, a null value sets null.
    """
    new = F.coalesce(F.try_parse_json(value), F.parse_json(F.lit("null")))
    return F.to_json(_set(F.try_parse_json(document), list(steps), new))
