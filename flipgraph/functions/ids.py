"""Element ids: ``E::name`` for an entity, ``R::src->tgt`` for a relation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entity_id(name: Column) -> Column:
    return F.concat(F.lit("E::"), name)


def relation_id(src: Column, tgt: Column) -> Column:
    return F.concat(F.lit("R::"), src, F.lit("->"), tgt)


def undirected_id(src: Column, tgt: Column) -> Column:
    return relation_id(F.least(src, tgt), F.greatest(src, tgt))


def kind(element_id: Column) -> Column:
    return F.when(element_id.startswith("E::"), "entity").when(element_id.startswith("R::"), "relation")


def head(element_id: Column) -> Column:
    """The entity's name, or the relation's source, up to the first arrow."""
    return F.when(element_id.startswith("R::"), F.regexp_extract(element_id, r"(?s)^R::(.*?)->", 1)).otherwise(F.substring(element_id, 4, 1 << 30))


def tail(element_id: Column) -> Column:
    """The relation's target, after the first arrow; null for an entity."""
    return F.when(element_id.startswith("R::"), F.regexp_extract(element_id, r"(?s)^R::.*?->(.*)$", 1))
