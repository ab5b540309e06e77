"""Binary addresses as columns of 64-bit limbs; limb j holds bits 64j to 64j + 63, bit 0 the lowest."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limbs of the base address of 256 bits.
LIMBS = 4
#: Seeds put before a word; each gives a hash of its own.
SEEDS = ("h1", "h2", "h3", "h4")


def limb_names(bits: int = 256) -> list[str]:
    return [f"l{j}" for j in range(-(-bits // 64))]


def limbs_of(prefix: str = "", bits: int = 256) -> list[Column]:
    return [F.col(f"{prefix}{n}") for n in limb_names(bits)]


def hex_limb(digest: Column, j: int) -> Column:
    """Limb j of 64 hex digits, read as one big-endian number."""
    return F.conv(F.substring(digest, 49 - 16 * j, 16), 16, -10).cast("long")


def digest_limb(text: Column, j: int) -> Column:
    """Limb j of the SHA-256 of a text."""
    return hex_limb(F.sha2(text, 256), j)


def digest_address(text: Column) -> list[Column]:
    """The text's SHA-256 as an address: the baseline that knows no likeness."""
    return [digest_limb(text, j).alias(f"l{j}") for j in range(LIMBS)]


def hamming(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Number of bits in which two addresses differ."""
    return reduce(add, [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)]).cast("int")


def bind(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    """Bitwise exclusive or of two addresses; binding again with one of them gives the other."""
    return [x.bitwiseXOR(y).alias(f"l{j}") for j, (x, y) in enumerate(zip(a, b, strict=True))]


unbind = bind


def resized(address: Sequence[Column], bits: int) -> list[Column]:
    """The address of another width: bit b is bit b mod 256 of the base address."""
    out = []
    for j in range(-(-bits // 64)):
        limb, left = address[j % LIMBS], bits - 64 * j
        out.append((limb if left >= 64 else limb.bitwiseAND(F.lit((1 << left) - 1))).alias(f"l{j}"))
    return out


def to_hex(address: Sequence[Column]) -> Column:
    """Lower-case hex, highest limb first."""
    return F.lower(F.concat(*[F.lpad(F.hex(x), 16, "0") for x in reversed(address)]))


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def address_of(text: str | None, bits: int = 256) -> list[int]:
    """The signed limbs of one text's address, for literals in a query."""
    words = Counter((text or "").lower().split())
    total, ones = sum(words.values()) * len(SEEDS), [0] * 256
    for word, n in words.items():
        for seed in SEEDS:
            value = int.from_bytes(hashlib.sha256((seed + word).encode()).digest(), "big")
            for b in range(256):
                ones[b] += n * (value >> b & 1)
    base = sum(1 << b for b in range(256) if 2 * ones[b] > total)
    whole = sum((base >> (b % 256) & 1) << b for b in range(bits))
    return [signed(whole >> (64 * j) & (1 << 64) - 1) for j in range(-(-bits // 64))]


def literal(address: Sequence[int]) -> list[Column]:
    return [F.lit(x).cast("long") for x in address]
