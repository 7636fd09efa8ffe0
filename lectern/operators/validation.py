"""Rules of the record schemas as array columns of what is broken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import schemas


class WrongDimension(ValueError):
    """Vectors do not fit the collection."""


def violations(required: tuple[str, ...], constants: dict[str, str], enums: dict[str, tuple[str, ...]], least: dict[str, int]) -> Column:
    """Array of rule:field, in the order of the rules: a required field that is
    null, another value than the constant, one outside the list, one too small."""
    rows = [F.when(F.col(c).isNull(), f"required:{c}") for c in required]
    rows += [F.when(F.col(c) != v, f"const:{c}") for c, v in constants.items()]
    rows += [F.when(~F.col(c).isin(*v), f"enum:{c}") for c, v in enums.items()]
    rows += [F.when(F.col(c) < v, f"minimum:{c}") for c, v in least.items()]
    return F.array_compact(F.array(*rows))


def document_violations() -> Column:
    return violations(schemas.REQUIRED_DOCUMENT, {"schema_version": schemas.SCHEMA_VERSION}, {"language": schemas.LANGUAGES}, {})


def chunk_violations() -> Column:
    return violations(schemas.REQUIRED_CHUNK, {"schema_version": schemas.SCHEMA_VERSION}, {"content_type": schemas.CONTENT_TYPES}, {"start_char": 0, "end_char": 0})


def unexpected_columns(df: DataFrame, kind: str) -> list[str]:
    """Columns that a record of `kind` (document or chunk) may not have."""
    known = (schemas.DOCUMENT if kind == "document" else schemas.CHUNK).names
    return [c for c in df.columns if c not in known]


def checked_vectors(vectors: DataFrame, dim: int, value: str = "embedding") -> DataFrame:
    """`vectors`; reading a row of another dimension raises."""
    wrong = F.concat(F.lit("a vector has "), F.size(value).cast("string"), F.lit(f" values, the collection {dim}"))
    return vectors.withColumn(value, F.when(F.size(value) == dim, F.col(value)).otherwise(F.raise_error(wrong).cast(vectors.schema[value].dataType)))
