"""Readable parts of URNs and ``table.column`` nodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHORT_MODEL = "urn:li:mlModel:"
_QUOTES = "\"`[] "


def last_component(name: Column) -> Column:
    """The final dotted part of a name, lower case and unquoted."""
    bare = F.translate(name, _QUOTES, "")
    return F.lower(F.element_at(F.split(bare, r"\."), -1))


def node_table(node: Column) -> Column:
    """Everything before the last dot; a node without a dot is a table."""
    return F.when(node.contains("."), F.regexp_extract(node, r"^(.*)\.[^.]*$", 1)).otherwise(node)


def node_column(node: Column) -> Column:
    return F.when(node.contains("."), F.element_at(F.split(node, r"\."), -1)).otherwise(F.lit(""))


def entity_type(urn: Column) -> Column:
    """The third URN part, e.g. ``mlModel``; NULL when the text is no URN."""
    return F.when(urn.startswith("urn:li:"), F.get(F.split(urn, ":"), F.lit(2)))


def canonical_model_urn(urn: Column, namespace: str, platform: str = "mlflow") -> Column:
    """Upgrade the short ``urn:li:mlModel:<namespace>.<name>`` form to the full key."""
    short = F.lit(f"{_SHORT_MODEL}{namespace}.")
    name = urn.substr(F.lit(len(_SHORT_MODEL) + 1), F.length(urn))
    full = F.concat(
        F.lit(f"{_SHORT_MODEL}(urn:li:dataPlatform:{platform},"), name, F.lit(",PROD)")
    )
    return F.when(urn.startswith(short), full).otherwise(urn)


def display_name(urn: Column) -> Column:
    """The last meaningful part of a model, field or plain URN."""
    model = F.regexp_extract(urn, r"^urn:li:mlModel:\((?:.*,)?([^,]*),[^,]*\)$", 1)
    model_parts = urn.rlike(r"^urn:li:mlModel:\(.*,.*,[^,]*\)$")
    field = F.regexp_replace(F.element_at(F.split(urn, ","), -1), r"\)+$", "")
    plain = F.element_at(F.split(F.element_at(F.split(urn, ":"), -1), r"\."), -1)
    return (
        F.when(urn.isNull() | (urn == ""), F.lit(""))
        .when(model_parts, F.element_at(F.split(model, r"\."), -1))
        .when(urn.endswith(")") & urn.contains(","), field)
        .otherwise(plain)
    )


def field_table(urn: Column) -> Column:
    """The table a field URN belongs to, without its namespace."""
    inner = F.regexp_extract(urn, r"(?s)^[^(]*\((.*),[^,]*$", 1)
    return F.when(
        urn.contains("(") & urn.contains(","), F.element_at(F.split(inner, r"\."), -1)
    ).otherwise(F.lit(""))
