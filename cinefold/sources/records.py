"""Raw records: JSON readers, column names and the column contract."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinefold import schemas as S


def normalise_names(frame: DataFrame) -> DataFrame:
    """One spelling of the column names: underscores become spaces."""
    return frame.toDF(*[name.replace("_", " ") for name in frame.columns])


def require_columns(
    frame: DataFrame, required: Iterable[str] = tuple(S.SOURCE_COLUMNS), keep: Iterable[str] = ()
) -> DataFrame:
    """Project to the contract; a missing column is an error that names it."""
    required = list(required)
    missing = [name for name in required if name not in frame.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {sorted(frame.columns)}")
    return frame.select(*keep, *[F.col(f"`{name}`") for name in required])


def to_catalogue_names(frame: DataFrame) -> DataFrame:
    return frame.withColumnsRenamed(S.SOURCE_COLUMNS)


def _spellings(name: str) -> list[str]:
    return list(dict.fromkeys([name, name.replace(" ", "_")]))


def _require_fields(records: DataFrame, column: str) -> None:
    """Hold records, read as maps, to the contract: a field counts when any record has it."""
    present = records.agg(*[
        F.bool_or(reduce(or_, [F.map_contains_key(column, s) for s in _spellings(name)])).alias(name)
        for name in S.SOURCE_COLUMNS
    ]).first()
    missing = [name for name in S.SOURCE_COLUMNS if not present[name]]
    if missing:
        raise ValueError(f"missing columns {missing}")


def _either_spelling(of) -> list:
    """The contract's columns; a file uses one of the two spellings, the other is NULL."""
    return [F.coalesce(*[of(s) for s in _spellings(name)]).alias(name) for name in S.SOURCE_COLUMNS]


def read_lines(spark: SparkSession, path: str, order: str = "ord", check: bool = True) -> DataFrame:
    """JSON lines with a numeric order field: the splittable form for large inputs.

    ``check`` costs one more pass, which reads which fields the records have.
    """
    if check:
        maps = spark.read.text(path).select(F.from_json("value", "map<string,string>").alias("fields"))
        _require_fields(maps, "fields")
    names = [s for name in S.SOURCE_COLUMNS for s in _spellings(name)]
    schema = f"`{order}` bigint, " + ", ".join(f"`{name}` string" for name in names)
    records = spark.read.schema(schema).json(path)
    return records.select(order, *_either_spelling(lambda s: F.col(f"`{s}`")))


def read_array(spark: SparkSession, path: str) -> DataFrame:
    """Files that each hold one JSON array of flat objects.

    Such a file cannot be split, so one file is one task; give many files, or use
    ``read_lines``. ``ord`` orders records by file name and position in the file.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    records = files.select("file", F.posexplode(F.from_json("value", "array<map<string,string>>")))
    _require_fields(records, "col")
    return records.select(
        F.struct("file", "pos").alias("ord"),
        *_either_spelling(lambda s: F.try_element_at("col", F.lit(s))),
    )


def load(frame: DataFrame, order: str = "ord") -> DataFrame:
    """Raw records under catalogue names, held to the contract, with their order column."""
    return to_catalogue_names(require_columns(normalise_names(frame), keep=[order]))
