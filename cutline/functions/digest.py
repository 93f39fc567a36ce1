"""Content hashes and the delivery key of a change event."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FIELD_MARK = "\u0001"


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def canonical_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 of a JSON object whose fields are sorted by name, NULLs kept as empty."""
    ordered = F.struct(*[fields[name].alias(name) for name in sorted(fields)])
    return F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256)


def event_key(urn: Column, body: Column, meta: Column | None = None) -> Column:
    """Identity of one delivery: the same asset with another body is another event."""
    absent = F.lit("")
    return F.sha2(
        F.concat_ws(_FIELD_MARK, urn, F.coalesce(body, absent), F.coalesce(meta, absent))
        if meta is not None
        else F.concat_ws(_FIELD_MARK, urn, F.coalesce(body, absent), absent),
        256,
    )
