"""Exports of several tables that count once their manifest is written."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

MANIFEST = "_manifest"


class IncompleteExport(RuntimeError):
    """The export has no manifest, or a table is not the one the manifest describes."""


def _flat(df: DataFrame, fmt: str) -> DataFrame:
    """Nested values as JSON text where the format has none."""
    if fmt != "csv":
        return df
    nested = (ArrayType, MapType, StructType)
    return df.select(*[F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema.fields])


def _read(spark: SparkSession, path: str, fmt: str, schema: StructType) -> DataFrame:
    # Null and the empty text stay apart in CSV too.
    options = {"header": "true", "nullValue": "\\N", "escape": '"', "multiLine": "true"} if fmt == "csv" else {}
    return spark.read.schema(schema).options(**options).format(fmt).load(path).select(*[f"`{f.name}`" for f in schema.fields])


def _figures(df: DataFrame) -> tuple[int, str]:
    """Rows, and a sum over their hashes that does not depend on their order."""
    hashed = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`").alias("v"))) for c in df.columns])
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(hashed.cast("decimal(38,0)")).alias("s")).first()
    return row.n, str(row.s or 0)


def write_tables(tables: dict[str, DataFrame], folder: str, *, fmt: str = "parquet", partition: str | None = "site_id", export: str | None = None) -> str:
    """Write every table below ``folder/export`` and then the manifest; returns the name of the export.

    The manifest has each table's rows, a checksum and the schema, taken from what was written. Tables are partitioned by the
    ``partition`` column where they have it. An export that breaks off has no manifest and is not read; writing it again
    replaces it.
    """
    export = export or uuid.uuid4().hex
    entries = []
    for name, df in tables.items():
        flat, path = _flat(df, fmt), f"{folder}/{export}/{name}"
        spark = df.sparkSession
        writer = flat.write.mode("overwrite").format(fmt).option("partitionOverwriteMode", "static")
        if fmt == "csv":
            writer = writer.options(header="true", nullValue="\\N", escape='"')
        (writer.partitionBy(partition) if partition in flat.columns and len(flat.columns) > 1 else writer).save(path)
        rows, checksum = _figures(_read(spark, path, fmt, flat.schema))
        entries.append((name, fmt, rows, checksum, flat.schema.json()))
    manifest = spark.createDataFrame(entries, "name string, format string, rows long, checksum string, schema string")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{export}/{MANIFEST}")
    return export


def read_tables(spark: SparkSession, folder: str, export: str, *, verify: bool = True) -> dict[str, DataFrame]:
    """The tables of a complete export; raises :class:`IncompleteExport` for one without manifest or with other content."""
    try:
        entries = spark.read.parquet(f"{folder}/{export}/{MANIFEST}").collect()  # one row per table
    except AnalysisException as exc:
        raise IncompleteExport(f"{folder}/{export} has no manifest") from exc
    out = {}
    for e in entries:
        df = _read(spark, f"{folder}/{export}/{e.name}", e.format, StructType.fromJson(json.loads(e.schema)))
        if verify and _figures(df) != (e.rows, e.checksum):
            raise IncompleteExport(f"{e.name} of {folder}/{export} is not what the manifest says")
        out[e.name] = df
    return out
