"""Settings that change what the engine does, with their defaults and checks."""

from __future__ import annotations

from dataclasses import dataclass

from . import schema


@dataclass(frozen=True)
class Config:
    folder: str = "./data"
    memtable_bytes: int = schema.MEMTABLE_BYTES
    block_bytes: int = schema.BLOCK_BYTES
    output_bytes: int = schema.OUTPUT_BYTES
    l0_trigger: int = schema.L0_TRIGGER
    base_level_bytes: int = schema.BASE_LEVEL_BYTES
    level_factor: int = schema.LEVEL_FACTOR
    max_levels: int = schema.MAX_LEVELS
    virtual_nodes: int = schema.VIRTUAL_NODES
    replication_factor: int = schema.REPLICATION_FACTOR
    snapshot_entries: int = schema.SNAPSHOT_ENTRIES
    log_level: str = "INFO"

    def validated(self) -> Config:
        """This, or ValueError naming the first setting that cannot be."""
        if not self.folder:
            raise ValueError("folder cannot be empty")
        for name in ("memtable_bytes", "block_bytes", "output_bytes", "l0_trigger", "base_level_bytes", "virtual_nodes", "replication_factor", "snapshot_entries"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if self.level_factor < 2 or self.max_levels < 2:
            raise ValueError("there must be two levels at least, each larger than the one before")
        if self.log_level not in ("DEBUG", "INFO", "WARN", "ERROR"):
            raise ValueError(f"unknown log level {self.log_level}")
        return self
