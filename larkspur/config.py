"""Settings from the environment, with defaults."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field


def env_or_default(name: str, default: str, env: Mapping[str, str] | None = None) -> str:
    """The variable's value; an unset or empty variable gives the default."""
    return (os.environ if env is None else env).get(name, "") or default


def split_and_trim(text: str) -> list[str]:
    """Comma-separated parts without surrounding blanks; empty parts are dropped."""
    return [p for p in (x.strip() for x in text.split(",")) if p]


#: Units of a duration in seconds.
_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def parse_duration(text: str, default: float) -> float:
    """Seconds of a duration such as 1m30s or 250ms; the default if it is malformed."""
    whole = re.fullmatch(r"([+-]?)((?:\d+(?:\.\d*)?|\.\d+)(?:ns|us|µs|ms|s|m|h))+", text.strip())
    if text.strip() in ("0", "+0", "-0"):
        return 0.0
    if not whole:
        return default
    total = sum(float(n) * _UNITS[u] for n, u in re.findall(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|ms|s|m|h)", text))
    return -total if whole.group(1) == "-" else total


@dataclass(frozen=True)
class RankParams:
    """Parameters of ranking."""

    k1: float = 1.5
    b: float = 0.75
    lexical_weight: float = 1.0
    semantic_weight: float = 0.65
    semantic_floor: int = 10


@dataclass(frozen=True)
class SemanticParams:
    """Parameters of the hashed embedding and its signatures; zero means the default."""

    dimension: int = 128
    planes: int = 24
    seed: int = 42

    def __post_init__(self) -> None:
        object.__setattr__(self, "dimension", self.dimension or 128)
        object.__setattr__(self, "planes", self.planes or 24)
        object.__setattr__(self, "seed", self.seed or 42)


@dataclass(frozen=True)
class CrawlParams:
    """Parameters of a crawl; zero or less means the default, None for max_pages no budget."""

    workers: int = 4
    politeness: float = 0.05
    max_pages: int | None = 100

    def __post_init__(self) -> None:
        for name, default in (("workers", 4), ("politeness", 0.05), ("max_pages", 100)):
            if (value := getattr(self, name)) is not None and value <= 0:
                object.__setattr__(self, name, default)


ORCHESTRATED = CrawlParams(workers=6, max_pages=1000)


@dataclass(frozen=True)
class ServiceConfig:
    """Settings of the services."""

    brokers: list[str] = field(default_factory=list)
    topic: str = "documents"
    indexer_group: str = "indexer-service"
    search_group: str = "search-api"
    snapshot_path: str = "index.snapshot.json"
    snapshot_interval: float = 60.0
    metrics_addr: str = ":9101"
    search_addr: str = ":8080"
    seed_dir: str = "pages"
    seed_files: list[str] = field(default_factory=list)

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> ServiceConfig:
        get = lambda name, default: env_or_default(name, default, env)
        return cls(
            brokers=split_and_trim(get("KAFKA_BROKERS", "localhost:9092")),
            topic=get("KAFKA_DOCUMENT_TOPIC", "documents"),
            indexer_group=get("INDEXER_GROUP", "indexer-service"),
            search_group=get("SEARCH_GROUP", "search-api"),
            snapshot_path=get("SNAPSHOT_PATH", "index.snapshot.json"),
            snapshot_interval=parse_duration(get("SNAPSHOT_INTERVAL", "1m"), 60.0),
            metrics_addr=get("METRICS_ADDR", ":9101"),
            search_addr=get("SEARCH_HTTP_ADDR", ":8080"),
            seed_dir=get("SEED_DIR", "pages"),
            seed_files=split_and_trim(get("SEED_FILES", "")),  # none: every page of the folder
        )
