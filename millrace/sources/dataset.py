"""Named datasets with immutable versions: Parquet folders and a manifest each."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.prefix import ordered_index
from millrace.sources.catalog import JsonCatalog
from millrace.sources.connector import cast_for_dataset


@dataclass
class DatasetVersion:
    spark: SparkSession
    name: str
    version: str
    path: str
    manifest: dict

    def read(self, only_feature_cols: bool = False) -> DataFrame:
        """The rows; only_feature_cols leaves out excluded and label columns."""
        df = self.spark.read.parquet(self.path)
        return df.drop(*self.manifest["exclude_cols"], *self.manifest["label_cols"]) if only_feature_cols else df

    def files(self) -> list[str]:
        return sorted(self.spark.read.parquet(self.path).inputFiles())


class Dataset:
    """Versions below one root folder: <root>/<name>/<version>."""

    def __init__(self, spark: SparkSession, root: str, name: str) -> None:
        self.spark, self.root, self.name = spark, root.rstrip("/"), name
        self.catalog = JsonCatalog(spark, f"{self.root}/{name}")

    def create_version(self, version: str, df: DataFrame, shuffle: bool = False, exclude_cols: Sequence[str] = (), label_cols: Sequence[str] = (), properties: dict | None = None, partition_by: Sequence[str] = (), comment: str = "", seed: int | None = None) -> DatasetVersion:
        """Write a version; a version that exists raises. The manifest comes last, so a broken write leaves no version."""
        if self.catalog.get("_versions", version) is not None:
            raise ValueError(f"{self.name} {version} exists")
        if unknown := [c for c in (*exclude_cols, *label_cols) if c not in df.columns]:
            raise ValueError(f"no such columns: {unknown}")
        df = cast_for_dataset(df)
        if shuffle:
            df = df.orderBy(F.rand(seed))
        path = f"{self.root}/{self.name}/{version}"
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
        manifest = {"exclude_cols": list(exclude_cols), "label_cols": list(label_cols), "properties": properties or {}, "partition_by": list(partition_by), "comment": comment, "schema": df.schema.json()}
        self.catalog.put("_versions", version, manifest, expected=0)
        return DatasetVersion(self.spark, self.name, version, path, manifest)

    def version(self, version: str) -> DatasetVersion:
        manifest = self.catalog.get("_versions", version)
        if manifest is None:
            raise ValueError(f"{self.name} has no version {version}")
        return DatasetVersion(self.spark, self.name, version, f"{self.root}/{self.name}/{version}", manifest)

    def versions(self) -> list[str]:
        return self.catalog.names("_versions")

    def delete_version(self, version: str) -> None:
        self.catalog.delete("_versions", version)
        self.catalog.remove_tree(version)

    def delete(self) -> None:
        self.catalog.remove_tree()


def read_versions(versions: Sequence[DatasetVersion], only_feature_cols: bool = False) -> DataFrame:
    """Rows of several versions, matched by column name."""
    return reduce(lambda a, b: a.unionByName(b), [v.read(only_feature_cols) for v in versions])


def _row_bytes(df: DataFrame) -> Column:
    """Bytes of a row's values, about: text and binary by their length, others nested in text form, all else 8."""
    size = F.lit(0)
    for c, kind in df.dtypes:
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        else:
            size = size + 8
    return size


class FileSet:
    """Files of a limited size below a folder, written once."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def make(cls, df: DataFrame, path: str, shuffle: bool = False, rows_per_file: int | None = None, bytes_per_file: int = 32 << 20, seed: int | None = None) -> "FileSet":
        """Write the rows; files end after rows_per_file rows, or by default after about bytes_per_file bytes of values."""
        df = cast_for_dataset(df)
        if rows_per_file is None:
            rows_per_file = max(1, int(bytes_per_file / (df.agg(F.avg(_row_bytes(df))).first()[0] or 1)))
        df = df.orderBy(F.rand(seed)) if shuffle else df
        df.write.mode("errorifexists").option("maxRecordsPerFile", rows_per_file).parquet(path)
        return cls(df.sparkSession, path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def files(self) -> list[str]:
        return sorted(self.read().inputFiles())

    def delete(self) -> None:
        JsonCatalog(self.spark, self.path).remove_tree()


def synthetic_rows(df: DataFrame, rows: int, seed: int = 0, now: str | None = None) -> DataFrame:
    """Rows uniform in the observed range of each numeric column, of the observed values of strings, at the time ``now`` for timestamps.

    Each distinct string is as likely as any other; the distinct values are
    numbered as a table and joined to random numbers. Other types, and columns
    without values, are null.
    """
    kinds = dict(df.dtypes)
    numeric = [c for c, k in kinds.items() if k in ("int", "bigint", "smallint", "double", "float") or k.startswith("decimal")]
    r = df.agg(*[F.min(c).cast("double").alias(f"a{i}") for i, c in enumerate(numeric)], *[F.max(c).cast("double").alias(f"b{i}") for i, c in enumerate(numeric)]).first() if numeric else {}
    out = df.sparkSession.range(rows).select(F.col("id").alias("_id"))
    for k, (c, kind) in enumerate(kinds.items()):
        if c in numeric:
            low, high = r[f"a{numeric.index(c)}"], r[f"b{numeric.index(c)}"]
            value = F.lit(None) if low is None else F.lit(low) + F.rand(seed + k) * F.lit(high - low)
            out = out.withColumn(c, (F.round(value) if "int" in kind and low is not None else value).cast(kind))
        elif kind == "string":
            values = ordered_index(df, c, "_at")
            n = values.count()
            out = out.withColumn("_at", F.floor(F.rand(seed + k) * n).cast("long")).join(values, "_at", "left").drop("_at")
        elif kind.startswith("timestamp") or kind == "date":
            out = out.withColumn(c, (F.lit(now) if now else F.current_timestamp()).cast(kind))
        else:
            out = out.withColumn(c, F.lit(None).cast(kind))
    return out.select(*kinds)


def extend_schema(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows with the new trailing columns as nulls; dropped, reordered or retyped columns raise."""
    a, b = old.dtypes, new.dtypes
    if [(n.lower(), t) for n, t in b[: len(a)]] != [(n.lower(), t) for n, t in a]:
        raise ValueError("columns can only be added at the end")
    return old.select(*old.columns, *[F.lit(None).cast(t).alias(n) for n, t in b[len(a) :]])
