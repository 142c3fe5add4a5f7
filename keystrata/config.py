"""Settings of a sort, with the defaults that its output depends on."""

from __future__ import annotations

from dataclasses import dataclass

MIB = 1 << 20


@dataclass(frozen=True)
class SortConfig:
    """Record layout, output file size and sampling budgets.

    record_length, key_length: bytes of a record and of its leading key.
    chunk_bytes: upper bound of one output file.
    memory_bytes, memory_ratio: what a driver may use, and the share of it that samples may.
    bytes_per_worker: sample bytes for each output partition.
    head_records: whole records that head sampling takes from each source.
    simple_sampling: whether sorts of files sample heads unless told otherwise; skewed on sorted input.
    """

    record_length: int = 100
    key_length: int = 10
    chunk_bytes: int = 32 * MIB
    memory_bytes: int = 24 << 30
    memory_ratio: float = 0.3
    bytes_per_worker: int = MIB // 2
    head_records: int = 10_000
    simple_sampling: bool = True
    file_prefix: str = "partition."
    first_file: int = 1

    def __post_init__(self):
        if self.record_length <= 0:
            raise ValueError("record_length must be positive")
        if not 0 < self.key_length <= self.record_length:
            raise ValueError("key_length must lie between 1 and record_length")

    @property
    def records_per_file(self) -> int:
        n = self.chunk_bytes // self.record_length
        if n < 1:
            raise ValueError("chunk_bytes holds no whole record")
        return n
