"""Arrow-batched pandas UDFs for what Spark has no expression for."""

from __future__ import annotations

import hashlib
import html
import os
import re
import unicodedata
from collections import Counter
from collections.abc import Callable
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from omniframe.plans.values import Val

if TYPE_CHECKING:
    from omniframe.plans.compiler import Scope


def osa(a: str, b: str) -> int:
    """Optimal string alignment: edits and swaps of neighbours, no part edited twice."""
    prev2, prev = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, prev2[j - 2] + 1)
            row.append(d)
        prev2, prev = prev, row
    return prev[-1]


def damerau(a: str, b: str) -> int:
    """Edits and swaps of neighbours without restriction."""
    last: dict[str, int] = {}
    big = len(a) + len(b)
    d = [[big] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        here = 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), here
            cost = x != y
            if not cost:
                here = j
            d[i + 1][j + 1] = min(d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[x] = i
    return d[-1][-1]


def normalized_damerau(a: str, b: str) -> float:
    n = max(len(a), len(b))
    return 1 - damerau(a, b) / n if n else 1.0


def jaro(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free, hits = [True] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == x:
                free[j] = False
                hits.append(x)
                break
    m = len(hits)
    if not m:
        return 0.0
    other = [y for y, f in zip(b, free) if not f]
    swaps = sum(x != y for x, y in zip(hits, other)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    s = jaro(a, b)
    n = len(os.path.commonprefix([a[:4], b[:4]]))
    return s + n * 0.1 * (1 - s) if s > 0.7 else s


def sorensen_dice(a: str, b: str) -> float:
    a, b = re.sub(r"\s", "", a), re.sub(r"\s", "", b)
    if a == b:
        return 1.0
    if len(a) < 2 or len(b) < 2:
        return 0.0
    x, y = (Counter(s[i : i + 2] for i in range(len(s) - 1)) for s in (a, b))
    return 2 * sum((x & y).values()) / (len(a) + len(b) - 2)


def smith_waterman(text: str, pattern: str) -> int:
    """Score of the pattern as a subsequence of the text: matches, runs and word starts add, gaps take off; 0 if it is none."""
    if not pattern:
        return 0
    low, pat = text.lower(), pattern.lower()
    best = {-1: (0, False)}
    for k, c in enumerate(pat):
        now: dict[int, tuple[int, bool]] = {}
        run = None
        for i, y in enumerate(low):
            before = best.get(i - 1) if k else (0, False)
            if run is not None:
                run = (run[0] - 1, False)
            if k and i - 1 in best and (run is None or best[i - 1][0] > run[0]):
                run = best[i - 1]
            if y != c or (k and run is None):
                continue
            base = (run if k else before)[0]
            bonus = 16 + (8 if i == 0 or not low[i - 1].isalnum() else 0) + (4 if k and best.get(i - 1) else 0) + (1 if text[i] == pattern[k] else 0)
            if i not in now or base + bonus > now[i][0]:
                now[i] = (base + bonus, True)
        if not now:
            return 0
        best = now
    return max(v for v, _ in best.values())


def joaat(s: str) -> int:
    h = 0
    for c in s.encode():
        h = (h + c) & 0xFFFFFFFF
        h = (h + (h << 10)) & 0xFFFFFFFF
        h ^= h >> 6
    h = (h + (h << 3)) & 0xFFFFFFFF
    h ^= h >> 11
    return (h + (h << 15)) & 0xFFFFFFFF


def slug(s: str) -> str:
    plain = unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().lower()
    return re.sub(r"[^a-z0-9]+", "-", plain).strip("-")


def sanitize(s: str) -> str:
    """Markup without scripts, styles, handlers and script links."""
    s = re.sub(r"(?is)<(script|style|iframe|object|embed)\b.*?(</\1\s*>|\Z)", "", s)
    s = re.sub(r"(?is)<!--.*?-->", "", s)
    return re.sub(r"(?is)\s(on\w+|style)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)|\shref\s*=\s*[\"']?\s*javascript:[^\"'>]*[\"']?", "", s)


def html_encode(s: str) -> str:
    return html.escape(s, quote=True).replace("&#x27;", "&#39;").replace("/", "&#47;")


BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def geohash_of(x: float, y: float, n: int = 12) -> str:
    out, lon, lat, bit, value, even = "", [-180.0, 180.0], [-90.0, 90.0], 0, 0, True
    while len(out) < n:
        span, v = (lon, x) if even else (lat, y)
        mid = (span[0] + span[1]) / 2
        value = value * 2 + (v >= mid)
        span[0 if v >= mid else 1] = mid
        even, bit = not even, bit + 1
        if bit == 5:
            out, bit, value = out + BASE32[value], 0, 0
    return out


def geohash_centre(s: str) -> tuple[float, float]:
    lon, lat, even = [-180.0, 180.0], [-90.0, 90.0], True
    for c in s.lower():
        v = BASE32.index(c)
        for k in range(4, -1, -1):
            span = lon if even else lat
            span[0 if v >> k & 1 else 1] = (span[0] + span[1]) / 2
            even = not even
    return sum(lon) / 2, sum(lat) / 2


CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def ulid(ms: int) -> str:
    v = int(ms) << 80 | int.from_bytes(os.urandom(10), "big")
    return "".join(CROCKFORD[v >> 5 * k & 31] for k in range(25, -1, -1))


def ulid_micros(s: str) -> int:
    v = 0
    for c in s.upper()[:10]:
        v = v * 32 + CROCKFORD.index(c)
    return v * 1000


def _kdf(kind: str, s: str, salt: bytes) -> bytes:
    if kind == "scrypt":
        return hashlib.scrypt(s.encode(), salt=salt, n=1 << 14, r=8, p=1)
    return hashlib.pbkdf2_hmac("sha256", s.encode(), salt, 100_000)


def derive(kind: str) -> Callable[[str], str]:
    def make(s: str) -> str:
        salt = os.urandom(16)
        return f"${kind}${salt.hex()}${_kdf(kind, s, salt).hex()}"

    return make


def verify(kind: str) -> Callable[[str, str], bool]:
    def same(stored: str, s: str) -> bool:
        parts = stored.split("$")
        return len(parts) == 4 and parts[1] == kind and _kdf(kind, s, bytes.fromhex(parts[2])).hex() == parts[3]

    return same


#: Query functions to UDFs.
NAMES = {
    "string::distance::damerau_levenshtein": "damerau", "string::distance::normalized_damerau_levenshtein": "normalized_damerau",
    "string::distance::osa": "osa", "string::distance::osa_distance": "osa", "string::similarity::jaro": "jaro",
    "string::similarity::jaro_winkler": "jaro_winkler", "string::similarity::sorensen_dice": "sorensen_dice",
    "string::similarity::smithwaterman": "smith_waterman", "string::similarity::fuzzy": "smith_waterman",
    "string::slug": "slug", "string::html::encode": "html_encode", "string::html::sanitize": "sanitize", "crypto::joaat": "joaat", "crypto::blake3": "blake3", "encoding::cbor::encode": "cbor_encode", "encoding::cbor::decode": "json_of_cbor",
    "geo::hash::encode": "geohash", "geo::hash::decode": "geohash_point", "time::from_ulid": "ulid_time",
    "crypto::pbkdf2::generate": "pbkdf2", "crypto::pbkdf2::compare": "pbkdf2_same", "crypto::scrypt::generate": "scrypt", "crypto::scrypt::compare": "scrypt_same",
    "value::diff": "value_diff", "value::patch": "value_patch", "geo::area": "geo_area", "geo::centroid": "geo_centroid", "geo::is_valid": "geo_is_valid",
}
PLAIN: dict[str, tuple[Callable, str]] = {
    "damerau": (damerau, "bigint"), "normalized_damerau": (normalized_damerau, "double"), "osa": (osa, "bigint"), "jaro": (jaro, "double"),
    "jaro_winkler": (jaro_winkler, "double"), "sorensen_dice": (sorensen_dice, "double"), "smith_waterman": (smith_waterman, "bigint"),
    "slug": (slug, "string"), "html_encode": (html_encode, "string"), "sanitize": (sanitize, "string"), "joaat": (joaat, "bigint"),
    "ulid": (ulid, "string"), "pbkdf2": (derive("pbkdf2"), "string"), "pbkdf2_same": (verify("pbkdf2"), "boolean"),
    "scrypt": (derive("scrypt"), "string"), "scrypt_same": (verify("scrypt"), "boolean"), "geohash_xy": (geohash_of, "string"), "ulid_micros": (ulid_micros, "bigint"),
    "geohash_text": (lambda s: "{} {}".format(*geohash_centre(s)), "string"),
}


def vectorised(f: Callable) -> Callable:
    """Row function to a series function; a NULL argument gives NULL."""

    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(x is None or x != x for x in row) else f(*row) for row in zip(*columns)], dtype=object)

    return run


def once_each(f: Callable) -> Callable:
    """Like vectorised, for a function of texts that depends on them alone: equal texts of a batch are worked out once."""

    def run(*columns: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for row in zip(*columns):
            if row not in known:
                known[row] = None if any(x is None or x != x for x in row) else f(*row)
            out.append(known[row])
        return pd.Series(out, dtype=object)

    return run


def geohashes(x: pd.Series, y: pd.Series, n: pd.Series) -> pd.Series:
    """geohash_of over whole columns: every halving is one step for all rows."""
    import numpy as np

    missing = (x.isna() | y.isna() | n.isna()).to_numpy()
    sizes = np.where(missing, 0, n.fillna(0)).astype(np.int64)
    at = [x.fillna(0).to_numpy(np.float64), y.fillna(0).to_numpy(np.float64)]
    low, high = [np.full(len(x), -180.0), np.full(len(x), -90.0)], [np.full(len(x), 180.0), np.full(len(x), 90.0)]
    letters, digits = np.array(list(BASE32)), []
    for k in range(int(sizes.max(initial=0)) * 5):
        if k % 5 == 0:
            digits.append(np.zeros(len(x), np.int64))
        mid = (low[k % 2] + high[k % 2]) / 2
        up = at[k % 2] >= mid
        low[k % 2], high[k % 2] = np.where(up, mid, low[k % 2]), np.where(up, high[k % 2], mid)
        digits[-1] = digits[-1] * 2 + up
    rows = np.ascontiguousarray(letters[np.stack(digits, axis=1)]).view(f"<U{len(digits)}").ravel().tolist() if digits else [""] * len(x)
    return pd.Series([None if gone else r[: max(size, 0)] for r, size, gone in zip(rows, sizes.tolist(), missing.tolist())], dtype=object)


#: Functions of whole columns, and those whose equal texts are worked out once a batch.
COLUMNS: dict[str, Callable] = {"geohash_xy": geohashes}
ONCE_EACH = frozenset(["geohash_text", "geo_area", "geo_centroid", "geo_is_valid"])


def register(scope: Scope, name: str) -> str:
    full = f"omni_{name}"
    if full not in scope.catalog.udfs:
        from omniframe.functions import codecs, documents, geometry

        f, kind = (PLAIN | documents.UDFS | geometry.UDFS | codecs.UDFS)[name]
        run = COLUMNS.get(name) or (once_each if name in ONCE_EACH else vectorised)(f)
        count = f.__code__.co_argcount
        args = ", ".join(f"a{i}: pd.Series" for i in range(count))
        space = {"pd": pd, "run": run}
        exec(f"def series({args}) -> pd.Series:\n    return run({', '.join(f'a{i}' for i in range(count))})", space)  # noqa: S102  a signature with type hints, as Spark wants
        scope.spark.udf.register(full, F.pandas_udf(space["series"], kind))
        scope.catalog.udfs[full] = kind
    return full


def call(name: str, scope: Scope, args: list[Val]) -> Val:
    from omniframe.functions import documents, geometry
    from omniframe.plans.compiler import typed

    if name == "geohash":
        n = args[1].sql if len(args) > 1 else "12"
        return Val(f"{register(scope, 'geohash_xy')}({args[0].sql}.x, {args[0].sql}.y, int({n}))", T.StringType())
    if name == "geohash_point":
        s = f"{register(scope, 'geohash_text')}({args[0].sql})"
        return typed(scope, f"named_struct('x', double(split_part({s}, ' ', 1)), 'y', double(split_part({s}, ' ', 2)))")
    if name == "ulid_time":
        return Val(f"timestamp_micros({register(scope, 'ulid_micros')}({args[0].sql}))", T.TimestampType())
    if name == "cbor_encode":
        return Val(f"{register(scope, 'cbor_of_json')}({documents.json_sql(args[0])})", T.BinaryType())
    if name in ("blake3", "json_of_cbor"):
        return Val(f"{register(scope, name)}({args[0].sql})", T.StringType())
    if name in ("value_diff", "value_patch"):
        return documents.build(name, scope, args)
    if name.startswith("geo_"):
        return geometry.build(name, scope, args)
    kind = PLAIN[name][1]
    full = register(scope, name)
    return Val(f"{full}({', '.join(a.sql for a in args)})", T._parse_datatype_string(kind))
