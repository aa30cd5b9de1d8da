"""Settings of an engine, from arguments, the environment and defaults, in this order."""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass, field, fields

PREFIX = "QUARRYLINE_"


@dataclass
class CacheConfig:
    """entries: 0 turns the read cache off."""

    entries: int = 256
    ttl_ms: int = 5000
    memory_mb: int = 64


@dataclass
class BatchConfig:
    max_wait_ms: int = 200
    max_ops: int = 50
    max_rows: int = 5000


#: Which commits of others a transaction sees, and which it conflicts with (sources/store.py).
ISOLATION = ("read_committed", "repeatable_read", "serializable")


@dataclass
class EngineConfig:
    """transaction_timeout_ms: 0 sets no limit."""

    dialect: str = "ansi"
    isolation: str = "serializable"
    transaction_timeout_ms: int = 0
    page_size: int = 500
    strict_chain: bool = False
    log_level: str = "INFO"
    cache: CacheConfig = field(default_factory=CacheConfig)
    batch: BatchConfig = field(default_factory=BatchConfig)


def load_config(environ: dict[str, str] | None = None, **overrides) -> EngineConfig:
    """Reads QUARRYLINE_<NAME> and QUARRYLINE_<CACHE|BATCH>_<NAME>; bad values are errors."""
    environ = os.environ if environ is None else environ
    out = EngineConfig()
    for where, prefix in ((out, ""), (out.cache, "CACHE_"), (out.batch, "BATCH_")):
        for f in fields(where):
            if (said := environ.get(f"{PREFIX}{prefix}{f.name.upper()}")) is not None:
                old = getattr(where, f.name)
                setattr(where, f.name, said.lower() in ("1", "true", "yes") if isinstance(old, bool) else type(old)(said) if isinstance(old, int) else said)
    for k, v in overrides.items():
        if not hasattr(out, k):
            raise ValueError(f"no setting {k}")
        setattr(out, k, v)
    if out.page_size < 1 or out.batch.max_ops < 1:
        raise ValueError("sizes must be positive")
    if out.isolation not in ISOLATION or out.transaction_timeout_ms < 0:
        raise ValueError("unknown isolation or negative timeout")
    logging.getLogger("quarryline").setLevel(out.log_level)
    return out
