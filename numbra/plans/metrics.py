"""Row counts and value checks that a query reports while it runs."""

from __future__ import annotations

import platform
import uuid
import zlib
from pathlib import Path

import pyspark
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def observed(frame: DataFrame, what: str, **more: Column) -> tuple[DataFrame, Observation]:
    """The same rows, and an observation that has their number (and further aggregates) once an action has run.

    Nothing is computed twice: the counts are taken as the rows pass.
    """
    watch = Observation(f"{what}-{uuid.uuid4().hex[:8]}")
    return frame.observe(watch, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in more.items())), watch


def dataset_crc(folder: str) -> str:
    """CRC-32 (8 hex digits) over the names and bytes of a local folder's files, in order of their paths; zero without files."""
    crc = 0
    for path in sorted(x for x in Path(folder).rglob("*") if x.is_file()):
        crc = zlib.crc32(str(path.relative_to(folder)).encode(), crc)
        with path.open("rb") as f:
            while part := f.read(1 << 20):
                crc = zlib.crc32(part, crc)
    return f"{crc:08x}"


def environment() -> dict[str, str]:
    """What a timing depends on besides the query."""
    return {"python": platform.python_version(), "spark": pyspark.__version__, "machine": platform.machine(), "system": platform.system()}
