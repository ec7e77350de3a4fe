"""Ids of dual nodes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ABSTRACT_PREFIX, EXTENSION_PREFIX = "abstract:", "extension:"


def abstract_id(c: Column) -> Column:
    return F.concat(F.lit(ABSTRACT_PREFIX), c)


def extension_id(c: Column) -> Column:
    return F.concat(F.lit(EXTENSION_PREFIX), c)


def concept_of(id_: Column) -> Column:
    """The concept of a dual node's id; null for any other id."""
    return (
        F.when(id_.startswith(ABSTRACT_PREFIX), F.substring(id_, F.lit(len(ABSTRACT_PREFIX) + 1), F.length(id_)))
        .when(id_.startswith(EXTENSION_PREFIX), F.substring(id_, F.lit(len(EXTENSION_PREFIX) + 1), F.length(id_)))
    )


def name_of(id_: Column) -> Column:
    """The concept of a dual node's id, any other id itself."""
    return F.coalesce(concept_of(id_), id_)


def last_part(uri: Column) -> Column:
    """What follows the last slash."""
    return F.element_at(F.split(uri, "/"), -1)


def draw(*parts) -> Column:
    """A uniform draw in the form of a hex string, fixed by its parts: order by it to sample."""
    return F.md5(F.concat_ws("|", *(p if isinstance(p, Column) else F.lit(str(p)) for p in parts)))
