"""Functions for SQL: greek_decode(table_id, token), greek_letters(text), other_letters(text), is_greek(text)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import text as T


def register(spark: SparkSession) -> None:
    """Register the functions with a session; all but greek_decode are SQL expressions."""
    from ..operators.decode import _decode

    spark.udf.register("greek_decode", _decode)
    greek, other = rf"[^{T.GREEK}]|[^\p{{L}}]", rf"[{T.GREEK}]|[^\p{{L}}]"
    for name, body in (
        ("greek_letters", f"length(regexp_replace(t, r'{greek}', ''))"), ("other_letters", f"length(regexp_replace(t, r'{other}', ''))"), ("is_greek", f"t rlike r'[{T.GREEK}]'"),
    ):
        kind = "BOOLEAN" if name == "is_greek" else "INT"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {kind} RETURN {body}")
