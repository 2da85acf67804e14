"""Codec arithmetic as column expressions, inside generated code: no Python per row.

Products of 32-bit numbers overflow signed arithmetic under ANSI rules, so they are taken in halves.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the filter's hash.
HASH_MULTIPLIER, HASH_SEED = 0xC6A4A793, 0xBC9F1D34
LN2, MOST_PROBES = 0.69314718056, 30
WORD = 1 << 32
CRC32C_POLYNOMIAL = 0x82F63B78


def varint_length(value: Column) -> Column:
    """Bytes of a 32-bit number in 7-bit groups."""
    return F.lit(1) + sum((value >= (1 << k)).cast("int") for k in (7, 14, 21, 28))


def shared_prefix_length(a: Column, b: Column) -> Column:
    """Leading characters (or bytes) that two keys share."""
    n = F.least(F.length(a), F.length(b))
    same = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))))
    place = F.array_position(same, False)
    return F.when(place == 0, n).otherwise((place - 1).cast("int"))


def probes(bits_per_key: Column) -> Column:
    """Hash probes of a filter with so many bits for each key."""
    return F.greatest(F.lit(1), F.least(F.lit(MOST_PROBES), F.floor(bits_per_key * F.lit(LN2)).cast("int")))


def once(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often ``then`` uses it."""
    return F.transform(F.array(value), then)[0]


def times32(a: Column, b: int) -> Column:
    """Product of two unsigned 32-bit numbers modulo 2^32."""
    return once(a, lambda x: ((x % 65536) * b % WORD + F.shiftright(x, 16) * b % 65536 * 65536) % WORD)


def filter_hash(key: Column) -> Column:
    """The filter's 32-bit hash of a binary key, four bytes at a time and then the rest."""
    size = F.length(key)
    byte = lambda i: F.conv(F.hex(F.substring(key, i + 1, F.lit(1))), 16, 10).cast("long")
    words = F.floor(size / 4).cast("int")
    start = F.lit(HASH_SEED).bitwiseXOR(times32(size.cast("long"), HASH_MULTIPLIER))

    def step(h: Column, i: Column) -> Column:
        word = byte(i * 4) + byte(i * 4 + 1) * 256 + byte(i * 4 + 2) * 65536 + byte(i * 4 + 3) * 16777216
        return once(times32((h + word) % WORD, HASH_MULTIPLIER), lambda x: x.bitwiseXOR(F.shiftright(x, 16)))

    whole = F.when(words > 0, F.aggregate(F.sequence(F.lit(0), words - 1), start, step)).otherwise(start)
    rest = size % 4
    at = words * 4
    add = F.when(rest > 0, byte(at)).otherwise(0) + F.when(rest > 1, byte(at + 1) * 256).otherwise(0) + F.when(rest > 2, byte(at + 2) * 65536).otherwise(0)
    turned = lambda h: once(times32((h + add) % WORD, HASH_MULTIPLIER), lambda x: x.bitwiseXOR(F.shiftright(x, 24)))
    return once(whole, lambda h: F.when(rest == 0, h).otherwise(turned(h)))


def probe_positions(h: Column, bits: Column, n_probes: Column) -> Column:
    """Bit numbers of a key in a filter: steps of the hash turned right by 17."""
    delta = F.shiftright(h, 17) + F.shiftleft(h % 131072, 15)
    return F.transform(F.sequence(F.lit(0), n_probes - 1), lambda i: (h + i * delta) % WORD % bits)


def crc32c(data: Column) -> Column:
    """CRC-32C of a binary column, a byte at a time by a table made from the polynomial."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (CRC32C_POLYNOMIAL if n & 1 else 0)
        table.append(n)
    lookup = F.array(*[F.lit(n).cast("long") for n in table])
    text = F.hex(data)
    byte = lambda i: F.conv(F.substring(text, 2 * i + 1, F.lit(2)), 16, 10).cast("long")
    step = lambda c, i: F.shiftright(c, 8).bitwiseXOR(lookup[c.bitwiseXOR(byte(i)).bitwiseAND(255).cast("int")])
    places = F.when(F.length(data) > 0, F.sequence(F.lit(0), F.length(data) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(WORD - 1).cast("long"), step).bitwiseXOR(F.lit(WORD - 1).cast("long"))


def internal_key(key: Column, seq: Column, vtype: Column) -> Column:
    """Key and its 8-byte tag: the type's byte, then the sequence's seven from the lowest on. The tag is never a signed number."""
    digits = F.concat(F.lpad(F.hex(seq), 14, "0"), F.lpad(F.hex(vtype), 2, "0"))
    return F.concat(key.cast("binary"), F.unhex(F.concat(*[F.substring(digits, k, 2) for k in range(15, 0, -2)])))


def split_internal_key(name: Column) -> tuple[Column, Column, Column]:
    """(key, sequence, type) of an internal key: its last eight bytes are the tag, lowest first."""
    tag = F.hex(F.substring(name, F.length(name) - 7, F.lit(8)))
    high_first = F.concat(*[F.substring(tag, k, 2) for k in range(15, 0, -2)])
    number = lambda digits: F.conv(digits, 16, 10).cast("long")
    return F.substring(name, F.lit(1), F.length(name) - 8), number(F.substring(high_first, 1, 14)), number(F.substring(high_first, 15, 2)).cast("int")
