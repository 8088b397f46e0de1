"""Which strategy serves a dense shape, why, and how to see it."""

from __future__ import annotations

import contextlib
import io
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from numbra.session import setting


@dataclass(frozen=True)
class Recognition:
    """Whether a shape is taken, with the reason either way."""

    ok: bool
    reason: str


#: Shape and the key of the least width from which blocks pay.
_WIDTH = {f: f"numbra.{f}.min-width" for f in ("gram", "neighbour", "kmeans", "logistic")}
#: Functions whose last digit may differ between the JVM and NumPy (fixed list).
DRIFTING = ("EXP", "LN", "LOG2", "POWER", "SIN", "COS", "TAN", "ASIN", "ACOS", "ATAN", "ATAN2", "TANH")


def drifting(predicate: str) -> list[str]:
    """The functions of a predicate (SQL text, quoted parts aside) that must not decide rows outside of the JVM."""
    bare = re.sub(r"'(?:[^']|'')*'|`[^`]*`|\"[^\"]*\"", " ", predicate)
    called = {x.upper() for x in re.findall(r"([A-Za-z_][A-Za-z0-9_]*)\s*\(", bare)}
    return sorted(called & {*DRIFTING, "POW", "LOG"})


def recognise(spark: SparkSession, shape: str, width: int, predicate: str | None = None) -> Recognition:
    """Whether the block strategy takes a shape of this width under the session's settings. A predicate on
    functions that drift stays with the JVM, so that both strategies see the same rows."""
    if shape not in _WIDTH:
        return Recognition(False, f"no block form of {shape}")
    if predicate and (found := drifting(predicate)):
        return Recognition(False, f"the predicate depends on {', '.join(found)}")
    if setting(spark, "numbra.enabled") != "true":
        return Recognition(False, "numbra.enabled is false")
    if (asked := setting(spark, "numbra.strategy")) != "auto":
        return Recognition(asked == "blas", f"numbra.strategy is {asked}")
    least = int(setting(spark, _WIDTH[shape]))
    if width < least:
        return Recognition(False, f"width {width} is below {least}")
    return Recognition(True, f"width {width} is {least} or more")


def choose(spark: SparkSession, shape: str, width: int, asked: str | None = None) -> str:
    """catalyst or blas; `asked` has the last say."""
    if asked not in (None, "catalyst", "blas"):
        raise ValueError(f"unknown strategy {asked}")
    return asked or ("blas" if recognise(spark, shape, width).ok else "catalyst")


def explain(frame: DataFrame, shape: str | None = None, width: int = 0) -> str:
    """The formatted physical plan, and a section on the strategy of a dense shape."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        frame.explain("formatted")
    text = out.getvalue()
    if shape:
        found = recognise(frame.sparkSession, shape, width)
        text += f"== Strategy ==\n{shape}: {'blas' if found.ok else 'catalyst'} ({found.reason})\n"
    return text
