"""The catalogue that the registered queries share within one session."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinefold.operators import cleaning, imputation, merge
from cinefold.operators.embedding import offline_embedder
from cinefold.plans import enrichment
from cinefold.session import step_table
from cinefold.sources import records, testbed

RUN_TIME = "2024-01-01 00:00:00"
VERSION = "1.0.0"
# The JVM interprets methods of more bytes for ever (HotSpot's HugeMethodLimit).
JIT_BYTES = 8000


class Shared:
    """Each step of the enrichment of the driver's tables, written when first asked for."""

    _known: dict[tuple[str, str], Shared] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Shared:
        # The tables hold times without a zone; they are taken as UTC.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        # The wide projections of the enrichment make methods that the JVM never compiles; above its limit Spark splits them.
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", JIT_BYTES)
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in cls._known:
            cls._known[key] = cls(spark, sf_dir)
        return cls._known[key]

    def table(self, name: str) -> DataFrame:
        return testbed.table(self.spark, self.sf_dir, name)

    @cached_property
    def landed(self) -> DataFrame:
        """Raw records as they arrive, under source names."""
        return step_table(testbed.raw_records(self.spark, self.sf_dir), "landed")

    @property
    def raw(self) -> DataFrame:
        return records.load(self.landed)

    @cached_property
    def variants(self) -> DataFrame:
        return enrichment.spelling_variants(self.raw)

    @property
    def normal(self) -> DataFrame:
        return cleaning.titled_text(self.raw)

    @cached_property
    def done(self) -> enrichment.Enriched:
        out = enrichment.enrich(self.raw, variants=self.variants)
        out.rows = step_table(out.rows, "enriched")
        return out

    @property
    def cleaned(self) -> DataFrame:
        return self.done.cleaned

    @property
    def statistics(self) -> imputation.FillStatistics:
        return self.done.statistics

    @property
    def enriched(self) -> DataFrame:
        return self.done.rows

    @cached_property
    def merged(self) -> merge.Merge:
        """The first run: everything enriched, into an empty catalogue."""
        empty = merge.empty_snapshot(self.spark)
        return merge.merge(empty, self.enriched.drop("ord"), offline_embedder(), VERSION, run_time())

    @cached_property
    def snapshot(self) -> DataFrame:
        return step_table(self.merged.snapshot, "snapshot")

    @property
    def report(self) -> DataFrame:
        """The run report of all five stages, but for the number of batches, which follows from the partitions."""
        return enrichment.whole_report(self.done, self.merged).filter("issue <> 'batches'")


def run_time():
    return F.lit(RUN_TIME).cast("timestamp")


def plain(frame: DataFrame) -> DataFrame:
    """Decimals as doubles, arrays as joined text, times as text: types both engines print alike."""
    out = []
    for name, kind in frame.dtypes:
        value = F.col(name)
        if kind.startswith("decimal"):
            value = value.cast("double")
        elif kind == "array<string>":
            value = F.array_join(value, ",")
        elif kind.startswith("timestamp"):
            value = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
        elif kind == "date":
            value = value.cast("string")
        out.append(value.alias(name))
    return frame.select(*out)


def plain_sql(columns: dict[str, str], prefix: str = "") -> str:
    """The same conversions in SQL for ``{column: Spark type}``."""
    out = []
    for name, kind in columns.items():
        value = prefix + name
        if kind.startswith("decimal"):
            value = f"CAST({value} AS DOUBLE)"
        elif kind == "array<string>":
            value = f"array_to_string({value}, ',')"
        elif kind.startswith("timestamp"):
            value = f"strftime({value}, '%Y-%m-%d %H:%M:%S')"
        elif kind == "date":
            value = f"CAST({value} AS VARCHAR)"
        out.append(f"{value} AS {name}")
    return ", ".join(out)
