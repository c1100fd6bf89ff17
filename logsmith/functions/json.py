"""Metadata expressions: E4 (store), E5 (display), E6 (field access).

``metadata`` is JSON kept as text. Reading an object into a STRING field with ``from_json``
keeps its compact JSON text, so ingest needs no serialiser.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def metadata_text(raw="metadata") -> Column:
    """Stored form — absent metadata is ``{}``."""
    return F.coalesce(_col(raw), F.lit("{}"))


def json_text(text: Column, value: Column) -> Column:
    """JSON text of a field: ``text`` as ``from_json`` gives it for a STRING field, but a JSON
    string (told by ``value``, the same field as VARIANT) with its quotes."""
    return F.when(F.schema_of_variant(value) == "STRING", F.to_json(value)).otherwise(text)


def metadata_display(raw="metadata") -> Column:
    """E5: normalised JSON when it parses, else the raw text."""
    m = _col(raw)
    return F.coalesce(F.to_json(F.try_parse_json(m)), m)


def metadata_field(key: str, raw="metadata") -> Column:
    """One documented key (``thread_id``, ``error_code``, ...) as text."""
    return F.get_json_object(_col(raw), f"$.{key}")
