"""Sources declared in a file: name, format, place and types of tables that examples and tests start from."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def load_sources(spark: SparkSession, declaration: str, names: list[str] | None = None, views: bool = False) -> dict[str, DataFrame]:
    """The declared tables by name; with ``views`` also as temporary views of those names.

    The declaration is a JSON file with a list of objects: name, path (from the
    declaration's folder, unless it is absolute), format ("csv" or "parquet"),
    and for csv optionally schema (DDL), header and delimiter. Names that are
    asked for but not declared raise.
    """
    text = "\n".join(r[0] for r in spark.read.text(declaration, wholetext=True).collect())  # one small file
    declared = {d["name"]: d for d in json.loads(text)}
    if missing := [n for n in names or [] if n not in declared]:
        raise ValueError(f"not declared: {missing}")
    folder, out = declaration.rpartition("/")[0], {}
    for name in names or declared:
        d = declared[name]
        path = d["path"] if "://" in d["path"] or d["path"].startswith(("/", "file:")) else f"{folder}/{d['path']}"
        if d["format"] == "csv":
            reader = spark.read.option("header", d.get("header", True)).option("sep", d.get("delimiter", ","))
            reader = reader.schema(d["schema"]) if "schema" in d else reader.option("inferSchema", True)
            out[name] = reader.csv(path)
        elif d["format"] == "parquet":
            out[name] = spark.read.parquet(path)
        else:
            raise ValueError(f"{name}: format {d['format']!r}")
        if views:
            out[name].createOrReplaceTempView(name)
    return out
