"""Reading, ingesting and writing the tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wrenchline.schemas import ORIGINAL_NAMES, SCHEMAS
from wrenchline.sources.versions import next_version, version_path


def load_tables(spark: SparkSession, folder: str, schemas: Mapping[str, T.StructType] = SCHEMAS,
                fmt: str = "parquet", suffix: str = "", **options: str) -> dict[str, DataFrame]:
    """One DataFrame per table under ``folder``, read with its declared schema (never inferred)."""
    reader = spark.read.format(fmt).options(**options)
    return {name: reader.schema(schema).load(f"{folder}/{name}{suffix}") for name, schema in schemas.items()}


def from_original_names(df: DataFrame, table: str) -> DataFrame:
    """Rename the original column names of ``table`` to the names used here."""
    _, names = ORIGINAL_NAMES[table]
    return df.withColumnsRenamed(dict(zip(names, SCHEMAS[table].names)))


def to_original_names(df: DataFrame, table: str) -> DataFrame:
    _, names = ORIGINAL_NAMES[table]
    return df.withColumnsRenamed(dict(zip(SCHEMAS[table].names, names)))


def scan(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Full read of a table, or of some columns of it."""
    return df.select(*columns) if columns else df.select("*")


def _coerced(column: str, kind: T.DataType) -> Column:
    text = F.col(column).cast("string")
    if isinstance(kind, (T.ShortType, T.IntegerType, T.LongType)):
        # Numbers with decimals round half away from zero; out-of-range ones become NULL.
        return F.coalesce(text.try_cast(kind), F.round(text.try_cast("decimal(38,6)"), 0).try_cast(kind))
    if isinstance(kind, T.StringType):
        return F.rtrim(text)
    return text.try_cast(kind)


def ingest_rows(df: DataFrame, schema: T.StructType, positional: bool = False,
                defaults: Mapping[str, object] | None = None,
                on_error: str = "reject") -> tuple[DataFrame, DataFrame]:
    """Type raw rows by ``schema``; returns (good rows, rejected raw rows with a ``problem`` column).

    ``positional`` matches columns by place; otherwise by name, and columns left out take their default or
    NULL. A row is rejected when a value cannot be converted or a required column is NULL.
    With ``on_error='null'`` values that cannot be converted become NULL instead.
    """
    raw, typed, problem = _typed(df, schema, positional, defaults, on_error)
    good = raw.filter(problem == "").select(*typed)
    rejects = raw.withColumn("problem", problem).filter(F.col("problem") != "")
    return good, rejects


def marked_rows(df: DataFrame, schema: T.StructType, positional: bool = False,
                defaults: Mapping[str, object] | None = None, on_error: str = "reject") -> DataFrame:
    """All rows as (``raw``, ``typed``, ``problem``), in one pass: ``ingest_rows`` accepts those whose problem is empty."""
    raw, typed, problem = _typed(df, schema, positional, defaults, on_error)
    return raw.select(F.struct(*raw.columns).alias("raw"), F.struct(*typed).alias("typed"), problem.alias("problem"))


def _typed(df: DataFrame, schema: T.StructType, positional: bool, defaults: Mapping[str, object] | None,
           on_error: str) -> tuple[DataFrame, list[Column], Column]:
    """The raw rows by name, their typed columns, and what is wrong with a row (empty: nothing)."""
    raw = df.toDF(*schema.names[:len(df.columns)]) if positional else df
    defaults = defaults or {}
    given = set(raw.columns)
    typed, problems = [], []
    for field in schema:
        if field.name not in given:
            typed.append(F.lit(defaults.get(field.name)).cast(field.dataType).alias(field.name))
            if not field.nullable and field.name not in defaults:
                problems.append(F.lit(f"{field.name} missing"))
            continue
        value = _coerced(field.name, field.dataType)
        typed.append(value.alias(field.name))
        if on_error == "reject":
            bad = value.isNull() & F.col(field.name).isNotNull()
            problems.append(F.when(bad, F.lit(f"{field.name} not {field.dataType.simpleString()}")))
        if not field.nullable:
            problems.append(F.when(F.col(field.name).isNull(), F.lit(f"{field.name} is null")))
    return raw, typed, F.concat_ws("; ", *problems) if problems else F.lit("")


def apply_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Column defaults where a value was left out."""
    return df.withColumns({
        name: F.coalesce(F.col(name), F.lit(value).cast(df.schema[name].dataType))
        if name in df.columns else F.lit(value)
        for name, value in defaults.items()})


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Full replace: write a new version beside the old one and read it back.

    Readers of the old version are not disturbed, and a failed write leaves the old version current.
    """
    spark = df.sparkSession
    target = version_path(path, next_version(spark, path))
    df.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true") \
        .partitionBy(*partition_by).parquet(target)
    return spark.read.schema(df.schema).parquet(target)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Keep an intermediate result for several uses, also by SQL under ``name``.

    Blocks that do not fit in memory go to disk; lost ones are recomputed from the lineage.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    kept.createOrReplaceTempView(name)
    return kept


def append_query(target: DataFrame | str, query: DataFrame) -> DataFrame | None:
    """Append a query's rows to a table (a DataFrame) or to a parquet folder (a path)."""
    if isinstance(target, str):
        query.write.mode("append").parquet(target)
        return None
    typed = query.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in target.schema])
    return target.unionByName(typed)
