"""BLAKE3 and CBOR, which Spark has no expression for."""

from __future__ import annotations

import json
import struct
from typing import Any

# Fixed values of the BLAKE3 specification.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
MASK = 0xFFFFFFFF


def _mix(s: list[int], a: int, b: int, c: int, d: int, x: int, y: int) -> None:
    for m, r1, r2 in ((x, 16, 12), (y, 8, 7)):
        s[a] = (s[a] + s[b] + m) & MASK
        s[d] ^= s[a]
        s[d] = (s[d] >> r1 | s[d] << 32 - r1) & MASK
        s[c] = (s[c] + s[d]) & MASK
        s[b] ^= s[c]
        s[b] = (s[b] >> r2 | s[b] << 32 - r2) & MASK


def _compress(cv: tuple[int, ...], block: bytes, counter: int, flags: int) -> tuple[int, ...]:
    m = list(struct.unpack("<16I", block.ljust(64, b"\0")))
    s = [*cv, *IV[:4], counter & MASK, counter >> 32, len(block), flags]
    for _ in range(7):
        for k in range(4):
            _mix(s, k, 4 + k, 8 + k, 12 + k, m[2 * k], m[2 * k + 1])
        for k in range(4):
            _mix(s, k, 4 + (k + 1) % 4, 8 + (k + 2) % 4, 12 + (k + 3) % 4, m[8 + 2 * k], m[9 + 2 * k])
        m = [m[i] for i in PERMUTATION]
    return tuple(s[k] ^ s[k + 8] for k in range(8))


def blake3(text: str) -> str:
    """The 256-bit digest in hex."""
    data = text.encode()

    def chunk(k: int, root: int) -> tuple[int, ...]:
        part = data[k * 1024 : (k + 1) * 1024]
        blocks = [part[i : i + 64] for i in range(0, len(part), 64)] or [b""]
        cv = IV
        for i, b in enumerate(blocks):
            last = i == len(blocks) - 1
            cv = _compress(cv, b, k, (CHUNK_START if i == 0 else 0) | ((CHUNK_END | root) if last else 0))
        return cv

    def node(lo: int, n: int, root: int) -> tuple[int, ...]:
        if n == 1:
            return chunk(lo, root)
        left = 1 << (n - 1).bit_length() - 1
        both = node(lo, left, 0) + node(lo + left, n - left, 0)
        return _compress(IV, struct.pack("<16I", *both), 0, PARENT | root)

    return struct.pack("<8I", *node(0, max(1, -(-len(data) // 1024)), ROOT)).hex()


def _head(major: int, n: int) -> bytes:
    if n < 24:
        return bytes([major << 5 | n])
    for code, fmt, top in ((24, ">B", 1 << 8), (25, ">H", 1 << 16), (26, ">I", 1 << 32), (27, ">Q", 1 << 64)):
        if n < top:
            return bytes([major << 5 | code]) + struct.pack(fmt, n)
    raise ValueError("number too large")


def cbor(v: Any) -> bytes:
    if v is None or isinstance(v, bool):
        return {None: b"\xf6", True: b"\xf5", False: b"\xf4"}[v]
    if isinstance(v, int):
        return _head(0, v) if v >= 0 else _head(1, -1 - v)
    if isinstance(v, float):
        return b"\xfb" + struct.pack(">d", v)
    if isinstance(v, str):
        return _head(3, len(v.encode())) + v.encode()
    if isinstance(v, list):
        return _head(4, len(v)) + b"".join(map(cbor, v))
    return _head(5, len(v)) + b"".join(cbor(k) + cbor(x) for k, x in v.items())


def parsed(raw: bytes) -> Any:
    def read(at: int) -> tuple[Any, int]:
        major, n, at = raw[at] >> 5, raw[at] & 31, at + 1
        if major == 7:
            simple = {20: False, 21: True, 22: None, 23: None}
            if n in simple:
                return simple[n], at
            fmt = {25: ">e", 26: ">f", 27: ">d"}[n]
            return struct.unpack_from(fmt, raw, at)[0], at + struct.calcsize(fmt)
        if n >= 24:
            fmt = {24: ">B", 25: ">H", 26: ">I", 27: ">Q"}[n]
            n, at = struct.unpack_from(fmt, raw, at)[0], at + struct.calcsize(fmt)
        if major == 0:
            return n, at
        if major == 1:
            return -1 - n, at
        if major in (2, 3):
            part = raw[at : at + n]
            return (part.decode() if major == 3 else part.hex()), at + n
        if major == 4:
            items = []
            for _ in range(n):
                x, at = read(at)
                items.append(x)
            return items, at
        if major == 5:
            pairs = {}
            for _ in range(n):
                k, at = read(at)
                pairs[k], at = read(at)
            return pairs, at
        return read(at)  # a tag: its content

    return read(0)[0]


def cbor_of_json(text: str) -> bytes:
    return cbor(json.loads(text))


def json_of_cbor(raw: bytes) -> str:
    return json.dumps(parsed(bytes(raw)), separators=(",", ":"), ensure_ascii=False)


UDFS = {"blake3": (blake3, "string"), "cbor_of_json": (cbor_of_json, "binary"), "json_of_cbor": (json_of_cbor, "string")}
