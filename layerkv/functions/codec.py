"""Binary formats of batches, log records, blocks, tables and filters.

Integers are little-endian. Decoders check every length against what is there and raise
``Corruption``; encoders and decoders are exact inverses. These are for reading and writing the
formats at the edges of a job; queries work on columns (``layerkv.functions.columns``).
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

from layerkv.schema import DELETION, MAX_SEQUENCE, VALUE, Corruption, InvalidArgument

#: Fixed values of the formats.
LOG_MAGIC, LOG_VERSION = b"LSMWAL\0", 2
LOG_HEADER_BYTES, RECORD_HEADER_BYTES, BATCH_HEADER_BYTES = 8, 8, 12
TABLE_MAGIC, FOOTER_BYTES, BLOCK_TRAILER_BYTES = 0x4C534D5442AA5502, 40, 4
CRC32C_POLYNOMIAL = 0x82F63B78
HASH_MULTIPLIER, HASH_SEED, LN2, MOST_PROBES, LEAST_FILTER_BITS = 0xC6A4A793, 0xBC9F1D34, 0.69314718056, 30, 64
M32 = 0xFFFFFFFF

Entry = tuple[int, bytes, bytes]  # type, key, value


# Integers and strings


def varint(n: int) -> bytes:
    if not 0 <= n <= M32:
        raise InvalidArgument(f"{n} isn't an unsigned 32-bit number")
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    """(number, place after it)."""
    n = 0
    for k in range(5):
        if at + k >= len(data):
            raise Corruption("a number ends early")
        n |= (data[at + k] & 127) << 7 * k
        if data[at + k] < 128:
            if n > M32:
                raise Corruption("a number is over 32 bits")
            return n, at + k + 1
    raise Corruption("a number is over five bytes")


def prefixed(data: bytes) -> bytes:
    return struct.pack("<I", len(data)) + data


def read_prefixed(data: bytes, at: int) -> tuple[bytes, int]:
    if at + 4 > len(data):
        raise Corruption("a length ends early")
    end = at + 4 + struct.unpack_from("<I", data, at)[0]
    if end > len(data):
        raise Corruption("a string ends early")
    return data[at + 4 : end], end


# Checksums


@lru_cache(1)
def _crc_tables() -> tuple[tuple[int, ...], ...]:
    """Eight tables, so that eight bytes are taken at a time; all from the polynomial."""
    first = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (CRC32C_POLYNOMIAL if n & 1 else 0)
        first.append(n)
    tables = [first]
    for _ in range(7):
        tables.append([first[n & 255] ^ n >> 8 for n in tables[-1]])
    return tuple(map(tuple, tables))


def crc32c(data: bytes, before: int = 0) -> int:
    """CRC-32C of ``data``, continuing that of the bytes ``before`` it."""
    a, b, c, d, e, f, g, h = _crc_tables()
    crc, whole = before ^ M32, len(data) // 8 * 8
    for low, high in struct.iter_unpack("<II", data[:whole]):
        low ^= crc
        crc = h[low & 255] ^ g[low >> 8 & 255] ^ f[low >> 16 & 255] ^ e[low >> 24] ^ d[high & 255] ^ c[high >> 8 & 255] ^ b[high >> 16 & 255] ^ a[high >> 24]
    for x in data[whole:]:
        crc = a[(crc ^ x) & 255] ^ crc >> 8
    return crc ^ M32


# Internal keys


def internal_key(key: bytes, seq: int, vtype: int) -> bytes:
    if not 0 <= seq <= MAX_SEQUENCE:
        raise InvalidArgument(f"sequence {seq} is out of range")
    return key + struct.pack("<Q", seq << 8 | vtype)


def split_internal_key(data: bytes) -> tuple[bytes, int, int]:
    if len(data) < 8:
        raise Corruption("a key has no tag")
    tag = struct.unpack_from("<Q", data, len(data) - 8)[0]
    return data[:-8], tag >> 8, tag & 255


def sort_key(key: bytes, seq: int, vtype: int) -> tuple[bytes, int, int]:
    return key, -seq, -vtype


# Batches and log records


def batch_entries(entries: Iterable[Entry]) -> bytes:
    out = bytearray()
    for vtype, key, value in entries:
        out.append(vtype)
        out += varint(len(key)) + key
        body = value if vtype == VALUE else b""
        out += varint(len(body)) + body
    return bytes(out)


def read_batch_entries(data: bytes, count: int) -> list[Entry]:
    """Exactly ``count`` entries that fill ``data``."""
    out, at = [], 0
    for _ in range(count):
        if at >= len(data):
            raise Corruption("a batch ends early")
        vtype = data[at]
        if vtype not in (DELETION, VALUE):
            raise Corruption(f"an entry of type {vtype}")
        parts, at = [], at + 1
        for _ in range(2):
            n, at = read_varint(data, at)
            if at + n > len(data):
                raise Corruption("an entry ends early")
            parts.append(data[at : at + n])
            at += n
        out.append((vtype, *parts))
    if at != len(data):
        raise Corruption("a batch is followed by more bytes")
    return out


def log_header() -> bytes:
    return LOG_MAGIC + bytes([LOG_VERSION])


def log_record(seq: int, entries: list[Entry]) -> bytes:
    """One record for a whole batch, under one checksum; nothing for an empty batch."""
    if not entries:
        return b""
    payload = struct.pack("<QI", seq, len(entries)) + batch_entries(entries)
    return struct.pack("<II", crc32c(payload), len(payload)) + payload


def read_log(data: bytes) -> tuple[list[tuple[int, int, int, bytes, bytes]], bool]:
    """((base sequence, place in batch, type, key, value) of every entry, whether the tail was torn).

    Reading ends at the first record that is short or fails its checksum.
    """
    if len(data) < LOG_HEADER_BYTES:
        return [], len(data) > 0
    if not data.startswith(LOG_MAGIC):
        raise Corruption("not a log")
    if data[len(LOG_MAGIC)] != LOG_VERSION:
        raise Corruption("a log of another version")
    out, at = [], LOG_HEADER_BYTES
    while at < len(data):
        if at + RECORD_HEADER_BYTES > len(data):
            return out, True
        crc, size = struct.unpack_from("<II", data, at)
        payload = data[at + RECORD_HEADER_BYTES : at + RECORD_HEADER_BYTES + size]
        if len(payload) < size or crc32c(payload) != crc:
            return out, True
        if size < BATCH_HEADER_BYTES:
            raise Corruption("a record is too short")
        base, count = struct.unpack_from("<QI", payload)
        out += [(base, k, *e) for k, e in enumerate(read_batch_entries(payload[BATCH_HEADER_BYTES:], count))]
        at += RECORD_HEADER_BYTES + size
    return out, False


# Blocks


def block(entries: list[tuple[bytes, bytes]], restart_interval: int = 16) -> bytes:
    """Sorted keys without the prefix each shares with the one before; every ``restart_interval``-th key is whole."""
    out, restarts, before = bytearray(), [0], b""
    for k, (key, value) in enumerate(entries):
        shared = 0
        if k % restart_interval:
            limit = min(len(before), len(key))
            while shared < limit and before[shared] == key[shared]:
                shared += 1
        elif k:
            restarts.append(len(out))
        out += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        before = key
    return bytes(out) + struct.pack(f"<{len(restarts) + 1}I", *restarts, len(restarts))


class Block:
    """A reader of one block."""

    def __init__(self, data: bytes):
        if len(data) < 4:
            raise Corruption("a block is too short")
        n = struct.unpack_from("<I", data, len(data) - 4)[0]
        self.end = len(data) - 4 * (n + 1)
        if n < 1 or self.end < 0:
            raise Corruption("a block's restarts don't fit")
        self.data, self.restarts = data, struct.unpack_from(f"<{n}I", data, self.end)
        if any(r > self.end for r in self.restarts):
            raise Corruption("a restart is out of the block")

    def _entry(self, at: int, before: bytes) -> tuple[bytes, bytes, int]:
        shared, at = read_varint(self.data, at)
        rest, at = read_varint(self.data, at)
        size, at = read_varint(self.data, at)
        if shared > len(before) or at + rest + size > self.end:
            raise Corruption("a block entry doesn't fit")
        return before[:shared] + self.data[at : at + rest], self.data[at + rest : at + rest + size], at + rest + size

    def entries(self, at: int = 0) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < self.end:
            key, value, at = self._entry(at, key)
            yield key, value

    def seek(self, target: bytes, rank=lambda key: key) -> Iterator[tuple[bytes, bytes]]:
        """Entries from the first whose rank is the target's or more: by bisection of the whole keys, then forward."""
        if not self.end:
            return
        low, high = 0, len(self.restarts) - 1
        while low < high:
            mid = (low + high + 1) // 2
            if rank(self._entry(self.restarts[mid], b"")[0]) < rank(target):
                low = mid
            else:
                high = mid - 1
        for key, value in self.entries(self.restarts[low]):
            if rank(key) >= rank(target):
                yield key, value


# Filters


def filter_hash(key: bytes) -> int:
    h = HASH_SEED ^ len(key) * HASH_MULTIPLIER & M32
    whole = len(key) // 4 * 4
    for (word,) in struct.iter_unpack("<I", key[:whole]):
        h = (h + word) * HASH_MULTIPLIER & M32
        h ^= h >> 16
    if rest := key[whole:]:
        h = (h + int.from_bytes(rest, "little")) * HASH_MULTIPLIER & M32
        h ^= h >> 24
    return h


def filter_probes(bits_per_key: int) -> int:
    return max(1, min(MOST_PROBES, int(bits_per_key * LN2)))


def bloom(keys: Iterable[bytes], bits_per_key: int = 10) -> bytes:
    """A filter's bits and, in its last byte, the probes of each key."""
    hashes = np.array([filter_hash(k) for k in keys], np.uint64)
    n_bytes = (max(len(hashes) * bits_per_key, LEAST_FILTER_BITS) + 7) // 8
    n_probes = filter_probes(bits_per_key)
    bits = np.zeros(n_bytes * 8, np.uint8)
    for k in range(n_probes):
        bits[((hashes + np.uint64(k) * _turned(hashes)) & np.uint64(M32)) % np.uint64(n_bytes * 8)] = 1
    return np.packbits(bits, bitorder="little").tobytes() + bytes([n_probes])


def _turned(h):
    return (h >> np.uint64(17) | h << np.uint64(15)) & np.uint64(M32)


def may_contain(data: bytes, key: bytes) -> bool:
    """False only if the key isn't there; filters that can't be read say maybe."""
    if len(data) < 2 or data[-1] > MOST_PROBES:
        return True
    bits, h = (len(data) - 1) * 8, filter_hash(key)
    step = int(_turned(np.uint64(h)))
    return all(data[at // 8] >> at % 8 & 1 for at in ((h + k * step & M32) % bits for k in range(data[-1])))


# Tables


def table(entries: Iterable[tuple[bytes, int, int, bytes]], block_bytes: int = 4096, restart_interval: int = 16, bits_per_key: int = 10) -> bytes:
    """A sorted table of (key, sequence, type, value): blocks, filter, sparse index, footer; each with its checksum."""
    out, index, pending, keys = bytearray(), bytearray(), [], []
    size, last = 0, None

    def put(contents: bytes) -> tuple[int, int]:
        at = len(out)
        out.extend(contents + struct.pack("<I", crc32c(contents)))
        return at, len(contents)

    def cut() -> None:
        nonlocal size
        if pending:
            at, n = put(block(pending, restart_interval))
            index.extend(prefixed(pending[-1][0]) + struct.pack("<QQ", at, n))
            pending.clear()
            size = 0

    for key, seq, vtype, value in entries:
        if last is not None and sort_key(key, seq, vtype) <= last:
            raise InvalidArgument("keys must ascend")
        last = sort_key(key, seq, vtype)
        if not keys or keys[-1] != key:
            keys.append(key)
        name = internal_key(key, seq, vtype)
        before = pending[-1][0] if len(pending) % restart_interval else b""
        shared = next((k for k, (x, y) in enumerate(zip(before, name)) if x != y), min(len(before), len(name)))  # noqa: B905
        size += len(varint(shared)) + len(varint(len(name) - shared)) + len(varint(len(value))) + len(name) - shared + len(value)
        pending.append((name, value))
        if size + 4 * (-(-len(pending) // restart_interval) + 1) >= block_bytes:
            cut()
    cut()
    filter_at = put(bloom(keys, bits_per_key))
    index_at = put(bytes(index))
    out += struct.pack("<5Q", *index_at, *filter_at, TABLE_MAGIC)
    return bytes(out)


class Table:
    """A reader of one table: footer, filter and sparse index at once, blocks as they are asked for."""

    def __init__(self, data: bytes):
        if len(data) < FOOTER_BYTES:
            raise Corruption("a table is too short")
        index_at, index_size, filter_at, filter_size, magic = struct.unpack_from("<5Q", data, len(data) - FOOTER_BYTES)
        if magic != TABLE_MAGIC:
            raise Corruption("not a table")
        self.data, self.blocks_read, self.rejections = data, 0, 0
        self.filter = self._checked(filter_at, filter_size)
        raw, at, self.index = self._checked(index_at, index_size), 0, []
        while at < len(raw):
            last, at = read_prefixed(raw, at)
            if at + 16 > len(raw):
                raise Corruption("an index entry ends early")
            self.index.append((last, *struct.unpack_from("<QQ", raw, at)))
            at += 16

    def _checked(self, at: int, size: int) -> bytes:
        body = self.data[at : at + size]
        if at + size + BLOCK_TRAILER_BYTES > len(self.data) or struct.unpack_from("<I", self.data, at + size)[0] != crc32c(body):
            raise Corruption("a block fails its checksum")
        return body

    def _block(self, k: int) -> Block:
        self.blocks_read += 1
        return Block(self._checked(*self.index[k][1:]))

    @staticmethod
    def _rank(name: bytes):
        return sort_key(*split_internal_key(name))

    def get(self, key: bytes, seq: int) -> tuple[int, bytes] | None:
        """(type, value) of the newest version up to ``seq``; none if this table has no such version."""
        if not may_contain(self.filter, key):
            self.rejections += 1
            return None
        target = internal_key(key, seq, VALUE)
        low, high = 0, len(self.index)
        while low < high:
            mid = (low + high) // 2
            if self._rank(self.index[mid][0]) < self._rank(target):
                low = mid + 1
            else:
                high = mid
        if low == len(self.index):
            return None
        for name, value in self._block(low).seek(target, self._rank):
            found, _, vtype = split_internal_key(name)
            return (vtype, value) if found == key else None
        return None

    def entries(self) -> Iterator[tuple[bytes, int, int, bytes]]:
        for k in range(len(self.index)):
            for name, value in self._block(k).entries():
                yield (*split_internal_key(name), value)
