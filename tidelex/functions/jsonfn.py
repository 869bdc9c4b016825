"""Typed reads from JSON payload text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def variant(payload: Column) -> Column:
    return F.try_parse_json(payload)


def has_key(payload_variant: Column, key: str) -> Column:
    """True when the key is present, also when its value is a JSON null."""
    return F.variant_get(payload_variant, f"$.{key}", "variant").isNotNull()


def text_of(payload_variant: Column, key: str) -> Column:
    """The value as text whatever its JSON type; null for absent or JSON null."""
    return F.try_variant_get(payload_variant, f"$.{key}", "string")


def string_only(payload_variant: Column, key: str) -> Column:
    """The value only when it is a JSON string."""
    value = F.try_variant_get(payload_variant, f"$.{key}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(
        payload_variant, f"$.{key}", "string"))


def is_object(payload_variant: Column) -> Column:
    return F.coalesce(F.schema_of_variant(payload_variant).startswith("OBJECT"), F.lit(False))
