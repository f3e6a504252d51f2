"""Two-dimensional export of the vectors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import PCA, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinefold import schemas as S


def export_rows(catalogue: DataFrame) -> DataFrame:
    """The exported columns of the rows with a vector, by identifier."""
    return (
        catalogue.filter(F.col("embedding").isNotNull())
        .select(*S.EXPORT_COLUMNS, F.col("augmented_text").alias("text"), "embedding")
        .orderBy("id")
    )


def seeded_sample(frame: DataFrame, rows: int, seed: int, id: str = "id") -> DataFrame:
    """At most ``rows`` rows, the same ones for the same seed; 0 keeps all.

    Only identifiers take part in the draw; the rows are fetched by them.
    """
    if rows == 0:
        return frame
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id).cast("string")))
    drawn = frame.select(id).orderBy(draw, F.col(id)).limit(rows)
    return frame.join(drawn, id, "left_semi")


def planar(frame: DataFrame, vector: str = "embedding") -> DataFrame:
    """``x, y``: the first two principal components of the unit-length vectors.

    The components are found by a distributed pass over the covariance; only the
    width x width matrix reaches the driver. A component's sign is arbitrary, so the one
    that makes its largest entry positive is used.
    """
    unit = Normalizer(inputCol="__v", outputCol="__u").transform(
        frame.withColumn("__v", array_to_vector(vector))
    )
    model = PCA(k=2, inputCol="__u", outputCol="__p").fit(unit)
    axes = model.pc.toArray()
    signs = np.sign(axes[np.abs(axes).argmax(axis=0), [0, 1]])
    plane = vector_to_array("__p")
    return (
        model.transform(unit)
        .withColumn("x", (plane[0] * float(signs[0])).cast("float"))
        .withColumn("y", (plane[1] * float(signs[1])).cast("float"))
        .drop("__v", "__u", "__p")
    )


def export_table(
    catalogue: DataFrame, rows: int = 0, seed: int = 42, columns: Sequence[str] = tuple(S.EXPORT_COLUMNS)
) -> DataFrame:
    """The export table: metadata, text and coordinates."""
    drawn = seeded_sample(export_rows(catalogue), rows, seed)
    return planar(drawn).select(*columns, "text", "x", "y")
