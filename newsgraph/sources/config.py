"""Mapping configs: which source column feeds which column of the standard article table."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgraph.schema import MANDATORY_COLUMNS, SUPPLEMENTARY_COLUMNS

CONFIG_KEYS = {"source", "mandatory_columns", "supplementary_columns", "custom_columns"}


@dataclass(frozen=True)
class MappingConfig:
    """Standard column -> source column; '' means the dataset has no such column."""

    mandatory: dict[str, str]
    supplementary: dict[str, str] = field(default_factory=dict)
    custom: tuple[str, ...] = ()
    source: str = ""

    def __post_init__(self) -> None:
        missing = [c for c in MANDATORY_COLUMNS if not self.mandatory.get(c)]
        unknown = [c for c in self.mandatory if c not in MANDATORY_COLUMNS]
        unknown += [c for c in self.supplementary if c not in SUPPLEMENTARY_COLUMNS]
        if missing or unknown:
            raise ValueError(f"mapping config: missing {missing}, unknown {unknown}")

    @classmethod
    def from_dict(cls, raw: dict) -> MappingConfig:
        """Build from the parsed YAML layout and check it against the template's keys."""
        unknown = set(raw) - CONFIG_KEYS
        if unknown or not raw.get("mandatory_columns"):
            raise ValueError(f"mapping config: unknown keys {sorted(unknown)} or no mandatory_columns")

        def names(section: str) -> dict[str, str]:
            entries = raw.get(section) or {}
            return {k: (v or {}).get("column_name") or "" for k, v in entries.items()}

        return cls(
            mandatory=names("mandatory_columns"),
            supplementary=names("supplementary_columns"),
            custom=tuple(raw.get("custom_columns") or ()),
            source=raw.get("source") or "",
        )

    @classmethod
    def from_text(cls, text: str) -> MappingConfig:
        try:
            import yaml
        except ImportError:  # a JSON config needs no YAML library
            return cls.from_dict(json.loads(text))
        return cls.from_dict(yaml.safe_load(text))

    def to_text(self) -> str:
        """The config in the layout that ``from_text`` reads."""
        raw = {
            "source": self.source,
            "mandatory_columns": {k: {"column_name": v} for k, v in self.mandatory.items()},
            "supplementary_columns": {k: {"column_name": v} for k, v in self.supplementary.items()},
            "custom_columns": list(self.custom),
        }
        return json.dumps(raw, indent=2)  # JSON is YAML

    def column_for(self, standard: str) -> str:
        return self.mandatory.get(standard) or self.supplementary.get(standard) or ""


def load_configs(spark: SparkSession, path: str) -> dict[str, MappingConfig]:
    """All configs of a folder, keyed by dataset file name: ``a.parquet.yml`` belongs to ``a.parquet``.

    A config is a small text and there is one per dataset, not per file or row.
    """
    found = (
        spark.read.option("pathGlobFilter", "*.yml")
        .text(path, wholetext=True)
        .select("value", F.col("_metadata.file_name").alias("name"))
        .collect()
    )
    if not found:
        raise FileNotFoundError(f"no mapping config under {path}")
    return {os.path.splitext(row["name"])[0]: MappingConfig.from_text(row["value"]) for row in found}


def schema_contract(df: DataFrame, config: MappingConfig) -> DataFrame:
    """One row per standard column: where it comes from, whether it is there, and how many values are missing.

    The missing counts are one partial aggregation over the mapped columns only.
    """
    types = dict(df.dtypes)
    missing, rows = [], []
    for standard in [*MANDATORY_COLUMNS, *SUPPLEMENTARY_COLUMNS]:
        source = config.column_for(standard)
        if source not in types:
            status = "absent"
        elif types[source] == "string" or standard in ("publication_date", "classification_date"):
            status = "present"
        else:
            status = "wrong type"
        if status == "absent":
            count = F.count(F.lit(1))
        else:
            text = F.col(f"`{source}`").cast("string")
            count = F.count_if(text.isNull() | (text == ""))
        missing.append(count.alias(standard))
        rows.append((standard, source, standard in MANDATORY_COLUMNS, types.get(source), status))
    counts = df.agg(F.count(F.lit(1)).alias("n_rows"), *missing)
    entries = F.array(
        *[
            F.struct(
                F.lit(standard).alias("standard_column"),
                F.lit(source).alias("source_column"),
                F.lit(required).alias("required"),
                F.lit(data_type).cast("string").alias("data_type"),
                F.lit(status).alias("status"),
                F.col(standard).alias("n_missing"),
            )
            for standard, source, required, data_type, status in rows
        ]
    )
    return counts.select("n_rows", F.inline(entries))
