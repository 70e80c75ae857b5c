"""Settings of a store."""

from __future__ import annotations

from dataclasses import dataclass

from tidemark.errors import InvalidOption

#: A value log file may not be smaller or larger.
LEAST_LOG, MOST_LOG = 1 << 20, 1 << 31


@dataclass(frozen=True)
class Options:
    """Sizes are bytes, times epoch seconds. The defaults."""

    dir: str
    num_versions_to_keep: int = 1
    mem_table_size: int = 64 << 20
    base_table_size: int = 2 << 20
    base_level_size: int = 10 << 20
    level_size_multiplier: int = 10
    max_levels: int = 7
    value_threshold: int = 1 << 20
    num_memtables: int = 5
    block_size: int = 4096
    bloom_false_positive: float = 0.01
    num_level_zero_tables: int = 5
    num_level_zero_tables_stall: int = 15
    value_log_file_size: int = 1 << 29
    value_log_max_entries: int = 1_000_000
    detect_conflicts: bool = True
    namespace_offset: int = -1
    banned_namespaces: tuple[int, ...] = ()
    reserved_prefix: bytes = b"!internal!"
    read_only: bool = False
    write_batch_rows: int = 3000

    @property
    def max_batch_size(self) -> int:
        """Bytes at which a transaction is too big."""
        return self.mem_table_size * 15 // 100

    def level_size(self, level: int) -> int:
        """Bytes that a level from 1 on may have before it is merged into the next."""
        return self.base_level_size * self.level_size_multiplier ** (level - 1)

    def checked(self) -> Options:
        """These options, or an error that says what is wrong."""
        if not LEAST_LOG <= self.value_log_file_size < MOST_LOG:
            raise InvalidOption("value_log_file_size must be at least 1 MB and below 2 GB")
        if self.num_level_zero_tables_stall <= self.num_level_zero_tables:
            raise InvalidOption("num_level_zero_tables_stall must be above num_level_zero_tables")
        if self.value_threshold <= 0 or self.num_versions_to_keep < 1 or not 0 <= self.bloom_false_positive < 1 or self.max_levels < 2 or self.num_memtables < 1:
            raise InvalidOption("value_threshold, num_versions_to_keep, num_memtables, max_levels and bloom_false_positive must be positive, max_levels above 1, bloom_false_positive below 1")
        return self
