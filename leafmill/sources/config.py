"""Configuration and manifests as tables."""

from __future__ import annotations

import json
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SOURCES = "name string, git string, rev string, paths array<string>, license string, roles array<string>, links boolean"


def sources(spark: SparkSession, path: str) -> DataFrame:
    """The [[source]] tables of a TOML file."""
    found = tomllib.loads(Path(path).read_text()).get("source", [])
    rows = [(s["name"], s.get("git"), s.get("rev"), s.get("paths", []), s.get("license"), s.get("roles", []), bool(s.get("links", False))) for s in found]
    return spark.createDataFrame(rows, SOURCES)


def subsets(spark: SparkSession, path: str) -> DataFrame:
    """subset, file: the lists of the [subsets] table of a TOML file."""
    found = tomllib.loads(Path(path).read_text()).get("subsets", {})
    return spark.createDataFrame([(name, f) for name, files in found.items() for f in files], "subset string, file string")


def expectations(spark: SparkSession, path: str) -> DataFrame:
    """file, preset (null: any), reason: the [[expect]] tables of a TOML file."""
    found = tomllib.loads(Path(path).read_text()).get("expect", [])
    return spark.createDataFrame([(e["file"], e.get("preset"), e.get("reason")) for e in found], "file string, preset string, reason string")


def load_manifest(path: str) -> dict:
    """A JSON manifest; one that is missing or can't be read is empty."""
    try:
        return json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return {}


def save_manifest(path: str, manifest: dict) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(manifest, indent=2, sort_keys=True) + "\n")
