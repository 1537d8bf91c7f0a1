"""Typed readers and writers: Parquet, JSON lines, CSV, policies."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

GOLD = "case_id string, text string, decision string, entities array<struct<type: string, start: int, end: int, text: string>>, uncertain boolean, traffic_weight int"
POLICY = "system string, enabled boolean, api_key_hash string, types array<string>, mode string, allow_unmask boolean, min_types int, required_types array<string>, allowed_modes array<string>, rps int, masking_enabled boolean"
REQUEST = "seq long, ts timestamp, system string, api_key string, operation string, payload string, payload_id string, mode string"


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a file's part that Spark reads in one task by default.
_PART = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if it is read from fewer files and is too small to be split for all of them.

    A small table in one file has one row group, so one task would do all the work of a kernel. Larger tables stay as read.
    """
    cores, files = df.sparkSession.sparkContext.defaultParallelism, len(df.inputFiles())
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if 0 < files < cores and size < cores * _PART else df


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("multiLine", True).csv(path)


@dataclass(frozen=True)
class Settings:
    """Limits of a service: characters of a payload, seconds a record lives, records of a vault, rules of a tenant."""

    most_characters: int = 2_000_000
    ttl_seconds: int = 900
    most_records: int = 100_000
    most_rules: int = 32

    def __post_init__(self):
        if min(self.most_characters, self.ttl_seconds, self.most_records) < 1 or not 0 <= self.most_rules <= 32:
            raise ValueError("limits must be positive, rules at most 32")


_POLICY_DEFAULTS = {"enabled": True, "types": [], "mode": "mask", "allow_unmask": True, "min_types": 1, "required_types": [], "allowed_modes": [], "rps": 1000, "masking_enabled": True, "extra_rules": []}
_POLICY_RULES = "extra_rules array<struct<type: string, pattern: string>>"


def policies(spark: SparkSession, path: str, known_types: list[str], modes: tuple[str, ...] = ("mask", "token", "synthetic")) -> DataFrame:
    """Policies by system from one JSON (or, where a parser is there, YAML) file read by Spark, so any store will do; anything unknown or of a wrong kind is refused. Keys come as hashes."""
    text = spark.read.text(path, wholetext=True).first()["value"]
    if path.endswith((".yaml", ".yml")):
        import yaml

        raw = yaml.safe_load(text)
    else:
        raw = json.loads(text)
    rows = []
    for system, given in raw["systems"].items():
        row = _POLICY_DEFAULTS | given
        kinds = {k: type(v) for k, v in _POLICY_DEFAULTS.items()} | {"api_key_hash": str}
        if set(row) - set(kinds) or any(type(row[k]) is not kind for k, kind in kinds.items() if k in row):
            raise ValueError(f"policy of {system}")
        sound = set(row["types"] + row["required_types"]) <= set(known_types) and row["mode"] in (row["allowed_modes"] or modes) and set(row["allowed_modes"]) <= set(modes) and row["min_types"] >= 1 and row["rps"] >= 1
        if not sound or len(row["extra_rules"]) > 32 or (row["enabled"] and not row.get("api_key_hash")):
            raise ValueError(f"policy of {system}")
        rows.append({"system": system, "api_key_hash": "", **row})
    return spark.createDataFrame(rows, f"{POLICY}, {_POLICY_RULES}")


def stream(spark: SparkSession, path: str, schema: str, form: str = "json", files: int = 100) -> DataFrame:
    """New files of a folder as a stream, so many of them at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(form).load(path)


def metrics_text(metrics: DataFrame) -> DataFrame:
    """value: a line of the text format of metrics for each row (name, labels map, value), to be written as text."""
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), F.regexp_replace(e["value"], r'(["\\\\])', r"\\$1"), F.lit('"')))
    inside = F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise(F.lit(""))
    return metrics.select(F.concat(F.col("name"), inside, F.lit(" "), F.col("value").cast("string")).alias("value"))


def write(df: DataFrame, path: str, form: str = "parquet") -> None:
    """df as files of a form; CSV has a header line, as csv() expects."""
    writer = df.write.format(form)
    (writer.option("header", True) if form == "csv" else writer).save(path)
