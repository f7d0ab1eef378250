"""Binary codecs that Spark has no function for, as Arrow batches: attribute blobs, zlib keys, signed tokens."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import struct
import zlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pack_attributes(attrs: dict[str, bytes] | None) -> bytes | None:
    """Little-endian: u32 entries, then u16 key length, u32 value length, key, value by key. None if there are none."""
    if not attrs:
        return None
    out = [struct.pack("<I", len(attrs))]
    for key in sorted(attrs):
        name, value = key.encode(), bytes(attrs[key] or b"")
        if len(name) > 0xFFFF:
            raise ValueError("attribute name too long")
        out.append(struct.pack("<HI", len(name), len(value)) + name + value)
    return b"".join(out)


def unpack_attributes(blob: bytes | None) -> dict[str, bytes] | None:
    """The inverse; a blob that is cut short or has bytes left over is an error."""
    if not blob:
        return None
    try:
        (n,), at, out = struct.unpack_from("<I", blob), 4, {}
        for _ in range(n):
            name, value = struct.unpack_from("<HI", blob, at)
            at += 6
            if at + name + value > len(blob):
                raise ValueError("attribute blob is cut short")
            out[blob[at : at + name].decode()] = blob[at + name : at + name + value]
            at += name + value
    except struct.error as e:
        raise ValueError("attribute blob is cut short") from e
    if at != len(blob):
        raise ValueError("attribute blob has bytes left over")
    return out


def sign_token(claims: dict, key: bytes) -> str:
    part = lambda raw: base64.urlsafe_b64encode(raw).rstrip(b"=").decode()
    payload = part(json.dumps(claims, separators=(",", ":"), sort_keys=True).encode())
    return f"{payload}.{part(hmac.new(key, payload.encode(), hashlib.sha256).digest())}"


def check_token(token: str, key: bytes, now: float, scope: str, leeway: float = 30) -> dict | None:
    """The claims of a token with a right signature that hasn't expired and has the scope, else None; an empty scope
    asks for none. Nothing is read of a payload whose signature is wrong."""
    payload, _, mac = (token or "").partition(".")
    pad = lambda s: base64.urlsafe_b64decode(s + "=" * (-len(s) % 4))
    try:
        if not payload or not hmac.compare_digest(pad(mac), hmac.new(key, payload.encode(), hashlib.sha256).digest()):
            return None
        claims = json.loads(pad(payload))
        live = claims.get("exp", 0) + leeway >= now
    except (ValueError, TypeError, AttributeError):
        return None
    return claims if live and (not scope or claims.get("scope") == scope) else None


@F.pandas_udf(T.BinaryType())
def attributes_blob(names: pd.Series, values: pd.Series) -> pd.Series:
    """Blob of parallel arrays of names and values."""
    return pd.Series([pack_attributes(dict(zip(n, v))) if n is not None and len(n) else None for n, v in zip(names, values)])


@F.pandas_udf(T.StringType())
def zlib_sha1(data: pd.Series) -> pd.Series:
    """SHA-1 of the zlib stream (level 6) of the bytes: the faithful object key. Equal bytes have equal keys."""
    return data.map(lambda b: hashlib.sha1(zlib.compress(bytes(b), 6)).hexdigest() if b is not None else None)


@F.pandas_udf(T.BinaryType())
def inflated(data: pd.Series) -> pd.Series:
    return data.map(lambda b: zlib.decompress(bytes(b)) if b is not None else None)
