"""Tar archives as entries, one Arrow batch at a time: gzip or plain, links resolved, unsafe entries refused."""

from __future__ import annotations

import gzip
import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwerk.schemas import ENTRY

#: Largest file of an archive, and the name prefix of extended attributes in its headers (fixed by the tar dialect).
MOST, ATTRIBUTES = 1 << 30, "SCHILY.xattr."


class ArchiveError(ValueError):
    pass


def check_path(name: str) -> None:
    if name.startswith("/") or ".." in name.split("/"):
        raise ArchiveError(f"unsafe path {name!r}")


def check_link(name: str, target: str) -> None:
    if not target or target.startswith("/"):
        raise ArchiveError(f"unsafe link {name!r} -> {target!r}")
    depth = 0
    for step in [*name.split("/")[:-1], *target.split("/")]:
        depth += {"": 0, ".": 0, "..": -1}.get(step, 1)
        if depth < 0:
            raise ArchiveError(f"unsafe link {name!r} -> {target!r}")


def entries(raw: bytes, most: int = MOST) -> Iterator[dict]:
    """The regular files, hard links (with the content of the earlier entry they name), directories and symbolic links
    of an archive, in order; all other kinds are skipped."""
    plain = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    seen: dict[str, bytes] = {}
    with tarfile.open(fileobj=io.BytesIO(plain), mode="r:") as tar:
        for seq, m in enumerate(tar):
            kind = "reg" if m.isreg() else "link" if m.islnk() else "dir" if m.isdir() else "symlink" if m.issym() else None
            if kind is None:
                continue
            check_path(m.name)
            data = None
            if kind == "reg":
                if not 0 <= m.size <= most:
                    raise ArchiveError(f"{m.name!r} has {m.size} bytes")
                data = seen[m.name] = tar.extractfile(m).read()
            elif kind == "link":
                if m.linkname not in seen:
                    raise ArchiveError(f"{m.name!r} links to {m.linkname!r}, which isn't there yet")
                data = seen[m.name] = seen[m.linkname]
            elif kind == "symlink":
                check_link(m.name, m.linkname)
            attrs = [(k[len(ATTRIBUTES) :], v.encode("utf-8", "surrogateescape")) for k, v in m.pax_headers.items() if k.startswith(ATTRIBUTES) and k != ATTRIBUTES]
            yield {"seq": seq, "path": m.name, "type": "reg" if kind == "link" else kind, "mode": m.mode, "mtime": int(m.mtime * 1_000_000), "size": len(data) if data is not None else 0, "data": data, "link_target": m.linkname or None, "uid": max(0, m.uid), "gid": max(0, m.gid), "xattrs": attrs}


def read_archives(spark: SparkSession, path: str, most: int = MOST) -> DataFrame:
    """All entries of all archives under ``path`` (a file, folder or glob), a row an entry."""
    kind = pa.schema([("archive", pa.string()), ("seq", pa.int64()), ("path", pa.string()), ("type", pa.string()), ("mode", pa.int32()), ("mtime", pa.timestamp("us", tz="UTC")), ("size", pa.int64()), ("data", pa.binary()), ("link_target", pa.string()), ("uid", pa.int64()), ("gid", pa.int64()), ("xattrs", pa.map_(pa.string(), pa.binary()))])

    def run(batches):
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1)):
                for e in entries(raw.as_py(), most):
                    yield pa.RecordBatch.from_pylist([e | {"archive": name}], kind)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, ENTRY)


def duplicate_paths(rows: DataFrame) -> DataFrame:
    """Paths that occur more than once over all archives: a run with any must fail."""
    return rows.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
