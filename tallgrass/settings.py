"""Paths and catalog settings, each from an environment variable or a default under the project root."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


@dataclass(frozen=True)
class Settings:
    data_raw: str
    warehouse: str
    reports: str
    tables: str
    spark_tmp: str | None
    catalog: str = "local"


def load(env: dict[str, str] | None = None) -> Settings:
    env = os.environ if env is None else env
    at = lambda key, default: env.get(f"TALLGRASS_{key}", str(default))
    return Settings(at("DATA_RAW", ROOT / "data" / "raw"), at("WAREHOUSE", ROOT / "warehouse"), at("REPORTS", ROOT / "reports"), at("TABLES", ROOT / "tables"), env.get("TALLGRASS_SPARK_TMP"))
