"""Semi-structured payloads as VARIANT: fields and types found in the data, and typed reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def with_payload(df: DataFrame, text: str, name: str = "payload") -> DataFrame:
    """Parse JSON text once into a VARIANT; text that is no JSON becomes null and stays in its column."""
    return df.withColumn(name, F.try_parse_json(F.col(text)))


def payload_fields(df: DataFrame, payload: str = "payload", by: list[str] | None = None) -> DataFrame:
    """(by..., field, type, n): the top-level fields of the payloads and the type that all their values fit.

    One aggregate over the fields, combined map-side: a field is one row per task and batch
    whatever the number of rows. Types of any batches merge, as numbers widen and objects unite; values
    that nothing but VARIANT holds have that type. Payloads that are no objects have no fields.
    """
    rows = df.where(F.col(payload).isNotNull() & F.schema_of_variant(payload).startswith("OBJECT"))
    cells = rows.lateralJoin(df.sparkSession.tvf.variant_explode(F.col(payload).outer()))
    return cells.groupBy(*(by or []), F.col("key").alias("field")).agg(
        F.schema_of_variant_agg("value").alias("type"), F.count(F.lit(1)).alias("n"))


def drifting_fields(fields: DataFrame, by: list[str]) -> DataFrame:
    """Fields whose type differs between batches, or that some batches lack: (field, types, batches, missing)."""
    every = fields.select(*by).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    found = fields.groupBy("field").agg(F.array_sort(F.collect_set("type")).alias("types"), F.count(F.lit(1)).alias("batches"))
    return found.withColumn("missing", every - F.col("batches")).where((F.size("types") > 1) | (F.col("missing") > 0)).select(
        "field", "types", "batches", "missing")


def payload_columns(df: DataFrame, columns: dict[str, tuple[str, str]], payload: str = "payload") -> DataFrame:
    """Add typed columns: name -> (path, type). A value of another kind, or none, reads as null."""
    return df.withColumns({name: F.try_variant_get(F.col(payload), path, kind) for name, (path, kind) in columns.items()})


def as_variant(df: DataFrame) -> Column:
    """A row as one VARIANT object with the types its columns have."""
    return F.to_variant_object(F.struct(*[_storable(f) for f in df.schema.fields]))


def _storable(field: T.StructField) -> Column:
    """The column as it is, or as text where a VARIANT has no such type."""
    column = F.col(f"`{field.name}`")
    return (column if _fits(field.dataType) else column.cast("string")).alias(field.name)


def _fits(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_fits(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _fits(kind.elementType)
    if isinstance(kind, T.MapType):
        return isinstance(kind.keyType, T.StringType) and _fits(kind.valueType)
    return not isinstance(kind, (T.DayTimeIntervalType, T.YearMonthIntervalType, T.CalendarIntervalType, T.NullType))
