"""Strict reading of JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_json(text: Column) -> Column:
    """The text as a VARIANT, NULL unless the whole text is exactly one JSON value.

    Spark's parser ignores whatever follows the first value. Inside an array the only
    things that may follow are a comma or a closing bracket, inside an object a comma
    or a closing brace; text that fits both, as a single element, has nothing after it.
    """
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    held = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    value = F.try_variant_get(held, "$.v", "variant")
    return F.when((F.size(listed) == 1) & held.isNotNull(), value)
