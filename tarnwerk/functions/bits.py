"""Keys, hashes and packed integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of a catalog entry's flags, and where hash and compression algorithms are packed.
DIR, NESTED_MOUNT, FILE, LINK, SPECIAL, NESTED_ROOT, CHUNKED, EXTERNAL, HIDDEN, XATTR = 1, 2, 4, 8, 16, 32, 64, 128, 1 << 15, 1 << 17
HASH_SHIFT, COMPRESSION_SHIFT = 8, 11
#: Type bits of a Unix mode.
MODE_DIR, MODE_LINK, MODE_FILE = 0o040000, 0o120000, 0o100000


def _little_endian(hex16: Column) -> Column:
    """16 hex digits, read as a signed little-endian long."""
    swapped = F.concat(*[F.substring(hex16, i, 2) for i in range(15, 0, -2)])
    high = F.conv(F.substring(swapped, 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(swapped, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def md5_path(p: Column) -> tuple[Column, Column]:
    """A path's key: the halves of its MD5 as signed little-endian longs."""
    h = F.md5(p.cast("binary"))
    return _little_endian(F.substring(h, 1, 16)), _little_endian(F.substring(h, 17, 16))


def safe_id(p: Column) -> Column:
    """A name for temporary files: the path with `_`, then the first key half in hex."""
    bare = F.replace(F.regexp_replace(p, "^/", ""), F.lit("/"), F.lit("_"))
    key = F.lower(F.hex(md5_path(p)[0]))
    return F.concat(F.when(bare == "", "root").otherwise(bare), F.lit("_"), F.when(F.length(key) < 8, F.lpad(key, 8, "0")).otherwise(key))


def unix_mode(kind: Column, perm: Column, setuid: Column | None = None, setgid: Column | None = None, sticky: Column | None = None) -> Column:
    """Type and permission bits of a Unix mode; kind: 'dir', 'symlink', anything else a file."""
    bits = F.when(kind == "dir", MODE_DIR).when(kind == "symlink", MODE_LINK).otherwise(MODE_FILE).bitwiseOR(perm.bitwiseAND(0o777))
    for flag, bit in ((setuid, 0o4000), (setgid, 0o2000), (sticky, 0o1000)):
        if flag is not None:
            bits = bits.bitwiseOR(F.when(flag, bit).otherwise(0))
    return bits


def entry_flags(kind: Column, chunks: Column, hash_algo: Column, compression: Column, nested_root: Column, hidden: Column, xattrs: Column) -> Column:
    """kind: 'dir', 'symlink', 'reg', anything else special. chunks, xattrs: how many."""
    f = F.when(kind == "dir", F.lit(DIR).bitwiseOR(F.when(nested_root, NESTED_ROOT).otherwise(0))).when(kind == "symlink", LINK).when(kind == "reg", F.lit(FILE).bitwiseOR(F.when(chunks > 0, CHUNKED).otherwise(0))).otherwise(FILE | SPECIAL)
    f = f.bitwiseOR(F.when(hash_algo >= 1, F.shiftleft(hash_algo - 1, HASH_SHIFT)).otherwise(0)).bitwiseOR(F.shiftleft(compression, COMPRESSION_SHIFT))
    return f.bitwiseOR(F.when(hidden, HIDDEN).otherwise(0)).bitwiseOR(F.when(xattrs > 0, XATTR).otherwise(0))


def hash_algo(flags: Column) -> Column:
    return F.shiftright(flags, HASH_SHIFT).bitwiseAND(7) + 1


def pack_hardlinks(group: Column, count: Column) -> Column:
    return F.shiftleft(group.cast("long"), 32).bitwiseOR(F.when(count == 0, 1).otherwise(count).cast("long"))


def hash_suffix(algo: Column) -> Column:
    return F.when(algo == 2, "-").when(algo == 3, "~").otherwise("")


def crc_line(payload: Column) -> Column:
    """A log line: CRC-32 of the payload in hex, a space, the payload."""
    return F.concat(F.lpad(F.lower(F.hex(F.crc32(payload.cast("binary")))), 8, "0"), F.lit(" "), payload)
