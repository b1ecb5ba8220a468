"""Catalog tables in and out: parquet snapshots with explicit schemas, or a JDBC source.

Layout on write: every table sorted by its parent key (endpoints by environment_id and
version), so parquet row-group min/max statistics skip most of a file for a lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schemas
from ..session import scratch_path

PARENT = {"tenants": ["id"], "services": ["tenant_id", "id"], "environments": ["service_id", "id"],
          "endpoints": ["environment_id", "version"]}


def write_catalog(spark: SparkSession, tables: dict, path: str | None = None) -> str:
    """Write the four tables as one snapshot folder (a new folder per snapshot)."""
    path = path or scratch_path(spark, "catalog")
    for name, df in tables.items():
        cols = [f.name for f in schemas.CATALOG[name].fields]
        (df.select(*cols).repartitionByRange(*PARENT[name]).sortWithinPartitions(*PARENT[name])
         .write.parquet(f"{path}/{name}"))
    return path


def read_catalog(spark: SparkSession, path: str | None = None, jdbc_url: str | None = None,
                 jdbc_properties: dict | None = None, slices: int = 16, slice_ids: int = 1_000_000) -> dict:
    """The four tables, parquet by default; from a database when ``jdbc_url`` is given: each
    table is read in ``slices`` parallel ranges of ``slice_ids`` ids (rows beyond the last range
    belong to it, so no row is left out; choose slices * slice_ids near the largest id)."""
    out = {}
    for name, schema in schemas.CATALOG.items():
        if jdbc_url:
            df = spark.read.jdbc(jdbc_url, name, column="id", lowerBound=0, upperBound=slices * slice_ids, numPartitions=slices,
                                 properties=jdbc_properties or {})
            out[name] = df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])
        else:
            out[name] = spark.read.schema(schema).parquet(f"{path}/{name}")
    return out
