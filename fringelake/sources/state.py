"""Reconstruction state as a folder of Parquet tables and one row of metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Table -> columns that it must have, with their types.
TABLES = {
    "object": {"z": "bigint", "y": "bigint", "x": "bigint", "re": "double", "im": "double"}, "probe": {"mode": "bigint", "y": "bigint", "x": "bigint", "re": "double", "im": "double"},
    "scan": {"pos_id": "bigint", "y": "double", "x": "double"}, "tilt": {"pos_id": "bigint", "ty": "double", "tx": "double"}, "progress": {"iter": "bigint", "error": "double"},
}
FORMAT, VERSION = "fringelake_state", "0.1"


def write_state(spark: SparkSession, folder: str, tables: dict[str, DataFrame], wavelength: float | None = None) -> None:
    """Writes the tables that there are; the metadata comes last and marks the state as whole."""
    for name, df in tables.items():
        checked(name, df).write.mode("overwrite").parquet(f"{folder}/{name}")
    meta = spark.createDataFrame([(FORMAT, VERSION, wavelength, sorted(tables))], "type string, version string, wavelength double, tables array<string>")
    meta.coalesce(1).write.mode("overwrite").json(f"{folder}/meta")


def checked(name: str, df: DataFrame) -> DataFrame:
    """`df` with its columns cast to the table's types; a missing one is an error."""
    if name not in TABLES:
        raise ValueError(f"no table of a state is called {name}")
    absent = [c for c in TABLES[name] if c not in df.columns]
    if absent:
        raise ValueError(f"{name} lacks {', '.join(absent)}")
    return df.select(*[df[c].cast(t) for c, t in TABLES[name].items()])


def read_state(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], float | None]:
    """The state's tables, all of them optional, and the wavelength."""
    meta = spark.read.schema("type string, version string, wavelength double, tables array<string>").json(f"{folder}/meta").first()
    if meta is None or meta["type"] != FORMAT:
        raise ValueError(f"{folder} holds no state")
    if tuple(map(int, meta["version"].split("."))) > tuple(map(int, VERSION.split("."))):
        raise ValueError(f"state version {meta['version']} is newer than {VERSION}")
    return {n: checked(n, spark.read.parquet(f"{folder}/{n}")) for n in meta["tables"]}, meta["wavelength"]


def complete(tables: dict[str, DataFrame], *needed: str) -> dict[str, DataFrame]:
    absent = [n for n in needed or ("object", "probe", "scan") if n not in tables]
    if absent:
        raise ValueError(f"incomplete state: {', '.join(absent)}")
    return tables
