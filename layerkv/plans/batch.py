"""Ordered batches of puts and deletes that are applied as one."""

from __future__ import annotations

from collections.abc import Callable

from layerkv.functions.codec import Entry, batch_entries, read_batch_entries
from layerkv.schema import DELETION, VALUE


def as_bytes(x: bytes | str) -> bytes:
    return x.encode() if isinstance(x, str) else bytes(x)


class WriteBatch:
    def __init__(self):
        self.entries: list[Entry] = []

    def put(self, key: bytes | str, value: bytes | str) -> WriteBatch:
        self.entries.append((VALUE, as_bytes(key), as_bytes(value)))
        return self

    def delete(self, key: bytes | str) -> WriteBatch:
        self.entries.append((DELETION, as_bytes(key), b""))
        return self

    def append(self, other: WriteBatch) -> WriteBatch:
        self.entries += other.entries
        return self

    def clear(self) -> None:
        self.entries.clear()

    def for_each(self, handler: Callable[[int, bytes, bytes], None]) -> None:
        for entry in self.entries:
            handler(*entry)

    def __len__(self) -> int:
        return len(self.entries)

    @property
    def approximate_size(self) -> int:
        return len(self.encode())

    @property
    def user_bytes(self) -> int:
        return sum(len(k) + len(v) for _, k, v in self.entries)

    def encode(self) -> bytes:
        return batch_entries(self.entries)

    @classmethod
    def decode(cls, data: bytes, count: int) -> WriteBatch:
        out = cls()
        out.entries = read_batch_entries(data, count)
        return out
