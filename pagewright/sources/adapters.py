"""Places for what needs libraries of its own: decoders of PDF spans, recognition, codes, page images.

An adapter is a function of bytes; it is registered by name and runs inside
mapInPandas on the executors. Nothing here imports such a library.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.legacy import PREETI, transliterated

SCHEMAS = {
    "spans": "doc_id string, page int, block int, line int, span int, font string, text string, x0 double, y0 double, x1 double, y1 double, size double, flags int",
    "words": "doc_id string, page int, text string, conf double, x0 double, y0 double, x1 double, y1 double",
    "codes": "doc_id string, page int, kind string, value string, x0 double, y0 double, x1 double, y1 double",
    "images": "doc_id string, page int, dpi int, content binary",
    "metrics": "doc_id string, page int, skew double, noise double, bleed double, shadows double, adequate boolean",
}

_ADAPTERS: dict[tuple[str, str], Callable[[bytes], Iterator[tuple]]] = {}


def register(kind: str, name: str, function: Callable[[bytes], Iterator[tuple]]) -> None:
    """function yields rows of SCHEMAS[kind] without their doc_id."""
    if kind not in SCHEMAS:
        raise ValueError(f"kind {kind!r} is none of {', '.join(SCHEMAS)}")
    _ADAPTERS[kind, name] = function


def rows(files: DataFrame, kind: str, name: str) -> DataFrame:
    """The adapter's rows for files (path, content); a KeyError says that none is registered."""
    function = _ADAPTERS[kind, name]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SCHEMAS[kind].split(", ")]
        for frame in frames:
            yield pd.DataFrame([(path, *row) for path, content in zip(frame.path, frame.content, strict=True) for row in function(bytes(content))], columns=columns)

    return files.select("path", "content").mapInPandas(run, SCHEMAS[kind])


def health(spark: SparkSession, languages: tuple[str, ...] = (), present: Iterable[tuple[str, str]] | None = None) -> DataFrame:
    """One row: status, reasons, converter_test, adapters. The built-in converter is tried on a word; languages are those that recognition has, present the adapters' (kind, name), else those registered in this process."""
    present = sorted(_ADAPTERS if present is None else present)
    made = transliterated(F.lit("g]kfn"), PREETI)
    reasons = F.array_compact(F.array(F.lit(None if "nep" in languages else "nep_missing"), F.lit(None if any(kind == "words" for kind, _ in present) else "recognition_missing"), F.when(~made.contains("नेपाल"), "converter_failed")))
    known = F.lit(",".join(sorted(f"{kind}:{name}" for kind, name in present)))
    return spark.range(1).select(F.when(F.size(reasons) > 0, "degraded").otherwise("ok").alias("status"), F.array_join(reasons, ",").alias("reasons"), made.alias("converter_test"), known.alias("adapters"))
