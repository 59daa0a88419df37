"""Associations of records by key: those among others, ids by group, entities looked up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def among(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """Rows whose key is one of the wanted ones."""
    return rows.join(wanted.select(F.col(wanted_key).alias(key)), key, "left_semi")


def ids_by(rows: DataFrame, key: str, item: str, name: str) -> DataFrame:
    """(key, name): the items of each key as one sorted text."""
    return rows.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(F.col(item).cast("string"))), ",").alias(name))


def looked_up(nodes: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """Every node with its entity's columns, null where none was captured."""
    return nodes.join(entities, key, "left")
