"""Dataset contracts, the catalog of contracts, and contract-driven reads."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators.schema import rename_columns, require_columns

STORAGES = ("parquet", "csv", "parquet_by_entity")
_MUST_HAVE = ("dataset_id", "storage", "path", "entity_col", "time_col")


@dataclass(frozen=True)
class DatasetContract:
    """``columns`` maps canonical names to source names; ``required_columns`` are source names."""

    dataset_id: str
    storage: str
    path: str
    entity_col: str
    time_col: str
    available_time_col: str | None = None
    columns: dict[str, str] = field(default_factory=dict)
    required_columns: tuple[str, ...] = ()

    @classmethod
    def from_dict(cls, values: dict[str, Any]) -> "DatasetContract":
        absent = [k for k in _MUST_HAVE if not values.get(k)]
        if absent:
            raise ValueError(f"contract lacks fields: {absent}")
        if values["storage"] not in STORAGES:
            raise ValueError(f"unknown storage {values['storage']!r}; known: {STORAGES}")
        available = values.get("available_time_col")
        return cls(
            *[str(values[k]) for k in _MUST_HAVE],
            available_time_col=None if available is None else str(available),
            columns={str(k): str(v) for k, v in (values.get("columns") or {}).items()},
            required_columns=tuple(str(c) for c in values.get("required_columns") or ()),
        )

    @classmethod
    def from_yaml(cls, path: str | Path) -> "DatasetContract":
        import yaml

        values = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
        if not isinstance(values, dict):
            raise ValueError(f"contract file must hold a mapping: {path}")
        return cls.from_dict(values)


class ContractCatalog:
    """Contracts by id; an id may appear once."""

    def __init__(self, contracts: list[DatasetContract]) -> None:
        self._by_id: dict[str, DatasetContract] = {}
        for c in contracts:
            if c.dataset_id in self._by_id:
                raise ValueError(f"duplicate dataset id: {c.dataset_id}")
            self._by_id[c.dataset_id] = c

    @classmethod
    def from_folder(cls, folder: str | Path) -> "ContractCatalog":
        return cls([DatasetContract.from_yaml(p) for p in sorted(Path(folder).rglob("*.yaml"))])

    def get(self, dataset_id: str) -> DatasetContract:
        if dataset_id not in self._by_id:
            raise KeyError(f"unknown dataset id: {dataset_id}")
        return self._by_id[dataset_id]

    def ids(self) -> list[str]:
        return sorted(self._by_id)

    def register_views(self, spark: SparkSession, **load_args) -> None:
        for dataset_id in self.ids():
            load_contract(spark, self.get(dataset_id), **load_args).createOrReplaceTempView(dataset_id)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """Header CSV; give a schema for large inputs, since inference reads the data twice."""
    reader = spark.read.option("header", True).options(**options)
    return reader.csv(path, schema=schema) if schema else reader.option("inferSchema", True).csv(path)


def list_entity_files(spark: SparkSession, folder: str) -> list[str]:
    """Parquet files of a folder in name order, through the Hadoop file system of the path."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        raise FileNotFoundError(folder)
    return sorted(s.getPath().toString() for s in fs.listStatus(root) if s.getPath().getName().endswith(".parquet"))


def read_by_entity(
    spark: SparkSession,
    folder: str,
    max_files: int | None = None,
    columns: list[str] | None = None,
    *,
    allow_full_scan: bool = False,
) -> DataFrame:
    """One file per entity; an unbounded read must be allowed explicitly.

    ``entity_file`` holds the file stem.  A missing entity code can be taken from it (``normalize.infer_code``).
    """
    if max_files is not None and max_files < 0:
        raise ValueError("max_files must not be negative")
    if max_files is None and not allow_full_scan:
        raise ValueError("refusing a full scan; pass max_files or allow_full_scan=True")
    if max_files is None:
        df = spark.read.option("mergeSchema", True).parquet(folder)
    else:
        files = list_entity_files(spark, folder)[:max_files]
        if not files:
            return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns or []]))
        df = spark.read.option("mergeSchema", True).parquet(*files)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.parquet$", "")
    df = df.withColumn("entity_file", stem)
    return df.select(*columns) if columns else df


def load_contract(
    spark: SparkSession,
    contract: DatasetContract,
    *,
    max_files: int | None = None,
    max_rows: int | None = None,
    normalize_entity_time: bool = False,
    allow_full_scan: bool = False,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """Read a dataset by contract: check source columns, rename, optionally use the common key names."""
    if max_rows is not None and max_rows < 0:
        raise ValueError("max_rows must not be negative")
    if contract.storage == "parquet":
        df = read_parquet(spark, contract.path)
    elif contract.storage == "csv":
        df = read_csv(spark, contract.path, schema)
    else:
        df = read_by_entity(spark, contract.path, max_files, allow_full_scan=allow_full_scan)
    require_columns(df, contract.required_columns)
    to_canonical = {src: name for name, src in contract.columns.items()}
    df = rename_columns(df, to_canonical)
    if normalize_entity_time:
        keys = {contract.entity_col: "entity_id", contract.time_col: "time"}
        if contract.available_time_col:
            keys[contract.available_time_col] = "available_time"
        df = rename_columns(df, {to_canonical.get(c, c): new for c, new in keys.items()})
    return df if max_rows is None else df.limit(max_rows)
