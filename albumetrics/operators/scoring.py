"""Running a caller's model over the rows that still need it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumetrics.functions.quality import blend_quality
from albumetrics.schema import awaiting_vector
from albumetrics.sources.snapshots import patch_columns


def score_batches(
    pending: DataFrame, fn: Callable[[pd.DataFrame], list], key: str, result_type: str = "array<double>"
) -> DataFrame:
    """``(key, result, error)`` of ``fn`` over batches of pending rows.

    ``fn`` takes a frame and returns one result per row, in order. Where a batch
    raises, its rows are tried one by one, so one bad row fails alone. A null
    result is a failure too. Batches stream through each task; none is held.
    """
    key_type = pending.schema[key].dataType.simpleString()

    def attempt(frame: pd.DataFrame) -> tuple[list, list]:
        try:
            results = list(fn(frame))
            return results, [None if r is not None else "no result" for r in results]
        except Exception as error:  # noqa: BLE001 - a model may raise anything
            if len(frame) == 1:
                return [None], [f"{type(error).__name__}: {error}"]
        results, errors = [], []
        for at in range(len(frame)):
            one, why = attempt(frame.iloc[at : at + 1])
            results += one
            errors += why
        return results, errors

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                results, errors = attempt(frame)
                yield pd.DataFrame({key: frame[key], "result": results, "error": errors})

    return pending.mapInPandas(run, f"{key} {key_type}, result {result_type}, error string")


def store_vectors(faces: DataFrame, scored: DataFrame, refined: DataFrame | None = None) -> DataFrame:
    """Faces with new vectors, failures marked, and optionally a refined quality blended in.

    ``scored``: face_id, result, error. ``refined``: face_id, refined.
    """
    patch = scored.select(
        "face_id", F.when(F.col("error").isNull(), F.col("result")).alias("embedding"),
        F.col("error").isNotNull().alias("embedding_failed"),
    )
    out = patch_columns(faces, patch, "face_id", ["embedding", "embedding_failed"])
    if refined is None:
        return out
    joined = out.join(refined.select("face_id", "refined"), "face_id", "left")
    blended = F.when(F.col("refined").isNotNull(), blend_quality(F.col("quality_score"), F.col("refined"))).otherwise(
        F.col("quality_score")
    )
    return joined.select(*[blended.alias(c) if c == "quality_score" else F.col(c) for c in faces.columns])


def embed_pending(faces: DataFrame, fn: Callable[[pd.DataFrame], list]) -> DataFrame:
    """Faces awaiting a vector get one from ``fn``, or the failure mark."""
    pending = faces.filter(awaiting_vector()).select("face_id", "photo_id", "region")
    return store_vectors(faces, score_batches(pending, fn, "face_id"))
