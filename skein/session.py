"""Settings and the Spark session that the engine is meant to run under."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """Engine settings; names are case-sensitive and each can be overridden by an environment variable ``SKEIN_<NAME>``.

    Nothing secret has a default: a signing key, if one is ever needed, comes from the environment only.
    """

    project_name: str = "skein"
    data_dir: str = "data"
    mock_ledger: bool = True
    master: str = "local[*]"
    shuffle_partitions: int = 8
    extra: dict = field(default_factory=dict)

    @classmethod
    def from_env(cls, env: dict | None = None) -> "Settings":
        env = os.environ if env is None else env
        base, found = cls(), {}
        for name in ("project_name", "data_dir", "master"):
            found[name] = env.get(f"SKEIN_{name.upper()}", getattr(base, name))
        found["mock_ledger"] = env.get("SKEIN_MOCK_LEDGER", str(base.mock_ledger)).lower() in ("1", "true", "yes")
        found["shuffle_partitions"] = int(env.get("SKEIN_SHUFFLE_PARTITIONS", base.shuffle_partitions))
        return cls(**found)


def session(settings: Settings | None = None) -> SparkSession:
    """A session with adaptive execution on and the zone fixed to UTC; a cluster sets its own master and partitions."""
    s = settings or Settings.from_env()
    b = (
        SparkSession.builder.appName(s.project_name)
        .master(s.master)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(s.shuffle_partitions))
        .config("spark.ui.enabled", "false")
    )
    for k, v in s.extra.items():
        b = b.config(k, v)
    return b.getOrCreate()
