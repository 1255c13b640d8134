"""Hashes that Spark lacks, over Arrow batches: the 64-bit fingerprint of warehouses and BLAKE2b."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_M = 2**64 - 1
#: The primes of the published 64-bit fingerprint.
K0, K1, K2 = 0xC3A5C85C97CB3127, 0xB492B66FBE98F273, 0x9AE16A3B2F90404F


def _word(s: bytes, at: int, size: int = 8) -> int:
    return int.from_bytes(s[at : at + size], "little")


def _turn(x: int, by: int) -> int:
    return (x >> by | x << (64 - by)) & _M


def _fold(x: int) -> int:
    return x ^ x >> 47


def _pair(a: int, b: int, by: int) -> int:
    """Two words as one."""
    first = _fold((a ^ b) * by & _M)
    return _fold((b ^ first) * by & _M) * by & _M


def _weak(s: bytes, at: int, a: int, b: int) -> tuple[int, int]:
    w, x, y, z = (_word(s, at + 8 * k) for k in range(4))
    a = (a + w) & _M
    b = _turn((b + a + z) & _M, 21)
    start = a
    a = (a + x + y) & _M
    return (a + z) & _M, (b + _turn(a, 44) + start) & _M


def fingerprint(text: str) -> int:
    """The 64-bit fingerprint of a text's UTF-8 bytes, signed, as warehouses compute FARM_FINGERPRINT."""
    s = text.encode()
    n = len(s)
    made = _short(s, n) if n <= 64 else _long(s, n)
    return made - 2**64 if made >= 2**63 else made


def _short(s: bytes, n: int) -> int:
    by = (K2 + n * 2) & _M
    if n == 0:
        return K2
    if n < 4:
        y, z = s[0] + (s[n >> 1] << 8), n + (s[n - 1] << 2)
        return _fold(y * K2 & _M ^ z * K0 & _M) * K2 & _M
    if n < 8:
        return _pair((n + (_word(s, 0, 4) << 3)) & _M, _word(s, n - 4, 4), by)
    if n <= 16:
        a, b = (_word(s, 0) + K2) & _M, _word(s, n - 8)
        return _pair((_turn(b, 37) * by + a) & _M, (_turn(a, 25) + b) * by & _M, by)
    if n <= 32:
        a, b, c, d = _word(s, 0) * K1 & _M, _word(s, 8), _word(s, n - 8) * by & _M, _word(s, n - 16) * K2 & _M
        return _pair((_turn((a + b) & _M, 43) + _turn(c, 30) + d) & _M, (a + _turn((b + K2) & _M, 18) + c) & _M, by)
    a, b, c, d = _word(s, 0) * K2 & _M, _word(s, 8), _word(s, n - 8) * by & _M, _word(s, n - 16) * K2 & _M
    y = (_turn((a + b) & _M, 43) + _turn(c, 30) + d) & _M
    z = _pair(y, (a + _turn((b + K2) & _M, 18) + c) & _M, by)
    e, f = _word(s, 16) * by & _M, _word(s, 24)
    g, h = (y + _word(s, n - 32)) * by & _M, (z + _word(s, n - 24)) * by & _M
    return _pair((_turn((e + f) & _M, 43) + _turn(g, 30) + h) & _M, (e + _turn((f + a) & _M, 18) + g) & _M, by)


def _long(s: bytes, n: int) -> int:
    x, y = 81, (81 * K1 + 113) & _M
    z = _fold((y * K2 + 113) & _M) * K2 & _M
    v = w = (0, 0)
    x = (x * K2 + _word(s, 0)) & _M
    end = (n - 1) // 64 * 64
    for at in range(0, end, 64):
        x = _turn((x + y + v[0] + _word(s, at + 8)) & _M, 37) * K1 & _M
        y = _turn((y + v[1] + _word(s, at + 48)) & _M, 42) * K1 & _M
        x ^= w[1]
        y = (y + v[0] + _word(s, at + 40)) & _M
        z = _turn((z + w[0]) & _M, 33) * K1 & _M
        v = _weak(s, at, v[1] * K1 & _M, (x + w[0]) & _M)
        w = _weak(s, at + 32, (z + w[1]) & _M, (y + _word(s, at + 16)) & _M)
        z, x = x, z
    by, at = (K1 + ((z & 0xFF) << 1)) & _M, n - 64
    w = ((w[0] + ((n - 1) & 63)) & _M, w[1])
    v = ((v[0] + w[0]) & _M, v[1])
    w = ((w[0] + v[0]) & _M, w[1])
    x = _turn((x + y + v[0] + _word(s, at + 8)) & _M, 37) * by & _M
    y = _turn((y + v[1] + _word(s, at + 48)) & _M, 42) * by & _M
    x ^= w[1] * 9 & _M
    y = (y + v[0] * 9 + _word(s, at + 40)) & _M
    z = _turn((z + w[0]) & _M, 33) * by & _M
    v = _weak(s, at, v[1] * by & _M, (x + w[0]) & _M)
    w = _weak(s, at + 32, (z + w[1]) & _M, (y + _word(s, at + 16)) & _M)
    z, x = x, z
    return _pair((_pair(v[0], w[0], by) + _fold(y) * K0 + z) & _M, (_pair(v[1], w[1], by) + x) & _M, by)


def farm_fingerprint(text: Column) -> Column:
    """fingerprint() of a column; null for null."""

    @F.pandas_udf("long")
    def each(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else fingerprint(t) for t in texts], dtype="Int64")

    return each(text)


def blake2b_number(raw: Column) -> Column:
    """The first 8 bytes of the BLAKE2b hash of bytes, as made for that size, as a number from 0 on; null for null."""

    @F.pandas_udf("decimal(20,0)")
    def each(values: pd.Series) -> pd.Series:
        from decimal import Decimal

        return values.map(lambda b: Decimal(int.from_bytes(hashlib.blake2b(bytes(b), digest_size=8).digest(), "big")), na_action="ignore")

    return each(raw)
