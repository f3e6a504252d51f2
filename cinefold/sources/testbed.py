"""The driver's tables as raw catalogue records.

No film data comes with the driver, so every part becomes one raw record: money and
dates come from its sales, people from its suppliers, and faults (padding, case
variants, missing and impossible values, rollover years, copies) from arithmetic on its
key. The text is one SQL query that Spark and DuckDB read alike; the tables are named
by the placeholders ``{part}``, ``{lineitem}``, ``{supplier}`` and ``{nation}``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RAW_SQL = """
WITH sales AS (
  SELECT l_partkey AS pk,
         CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents,
         CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS units,
         MIN(l_shipdate) AS shipped, MIN(l_suppkey) AS sk
  FROM {lineitem} GROUP BY l_partkey),
facts AS (
  SELECT p_partkey AS k, p_name, p_brand, p_type, p_size, cents, units, s_name, n_name,
         CAST(EXTRACT(MONTH FROM shipped) AS INT) AS mon,
         CAST(EXTRACT(DAY FROM shipped) AS INT) AS dy,
         CAST(EXTRACT(YEAR FROM shipped) AS INT) - CAST(p_partkey % 60 AS INT)
           + CASE WHEN p_partkey % 50 = 0 THEN 100 ELSE 0 END AS yr,
         10 + (p_partkey * 13) % 86 AS tenths
  FROM {part}
  JOIN sales ON pk = p_partkey
  JOIN {supplier} ON s_suppkey = sk
  JOIN {nation} ON n_nationkey = s_nationkey),
records AS (
  SELECT k AS ord,
    CASE WHEN k % 101 = 0 THEN CASE WHEN k % 2 = 0 THEN '   ' END
         WHEN k % 97 = 0 THEN CAST(k AS STRING)
         WHEN k % 53 = 0 THEN TRANSLATE(CAST(k AS STRING), '0123456789', 'бвгджзклмн')
         WHEN k % 89 = 0 THEN 'Éa ' || p_name || ' ñ' || CAST(p_size AS STRING)
         WHEN k % 5 = 0 THEN '  ' || p_name || '    ' || CAST(p_size AS STRING) || ' '
         ELSE p_name || ' ' || CAST(p_size AS STRING) END AS `Title`,
    CASE WHEN k % 4 <> 1 THEN CAST(cents AS STRING) END AS `US_Gross`,
    CASE WHEN k % 10 <> 3 THEN CAST(cents * (k % 4) AS STRING) END AS `Worldwide_Gross`,
    CASE WHEN k % 6 = 0 THEN CAST(units * 1000 AS STRING) END AS `US_DVD_Sales`,
    CASE WHEN k % 7 = 2 THEN NULL WHEN k % 83 = 0 THEN 'n/a'
         ELSE CAST(units * p_size * 2000 AS STRING) END AS `Production_Budget`,
    CASE WHEN k % 79 = 0 THEN 'not a date' WHEN k % 31 = 0 THEN NULL
         WHEN k % 43 = 0 THEN CAST(yr AS STRING) || '-' || LPAD(CAST(mon AS STRING), 2, '0')
              || '-' || LPAD(CAST(dy AS STRING), 2, '0')
         ELSE SUBSTR('JanFebMarAprMayJunJulAugSepOctNovDec', mon * 3 - 2, 3) || ' '
              || LPAD(CAST(dy AS STRING), 2, '0') || ' ' || CAST(yr AS STRING) END AS `Release_Date`,
    CASE k % 9 WHEN 0 THEN 'R' WHEN 1 THEN 'pg' WHEN 2 THEN 'PG-13' WHEN 3 THEN 'Open'
         WHEN 4 THEN 'unrated' WHEN 5 THEN 'G' WHEN 6 THEN ' R ' WHEN 7 THEN 'Festival'
         END AS `MPAA_Rating`,
    CASE WHEN k % 11 = 0 THEN NULL WHEN k % 13 = 0 THEN '-5' WHEN k % 73 = 0 THEN 'long'
         ELSE CAST(80 + p_size AS STRING) END AS `Running_Time_min`,
    CASE WHEN k % 17 = 0 THEN '' WHEN k % 12 = 5 THEN LOWER(n_name) ELSE n_name END AS `Distributor`,
    CASE WHEN k % 14 = 0 THEN NULL WHEN k % 15 = 4 THEN UPPER(p_brand) ELSE p_brand END AS `Source`,
    CASE WHEN k % 19 = 0 THEN NULL WHEN k % 8 = 3 THEN LOWER(p_type) || ' ' ELSE p_type END
      AS `Major_Genre`,
    CASE WHEN k % 16 = 0 THEN NULL ELSE 'Segment ' || CAST(p_size % 5 AS STRING) END AS `Creative_Type`,
    CASE WHEN k % 3 = 1 THEN NULL WHEN k % 18 = 5 THEN UPPER(s_name) ELSE s_name END AS `Director`,
    CASE WHEN k % 5 = 1 THEN NULL WHEN k % 71 = 0 THEN '140'
         ELSE CAST((tenths * 9 + (k * 7) % 41 * 2) % 101 AS STRING) END AS `Rotten_Tomatoes_Rating`,
    CASE WHEN k % 6 = 1 THEN NULL WHEN k % 67 = 0 THEN '12.5'
         ELSE CAST(CAST(FLOOR(tenths / 10.0) AS INT) AS STRING) || '.' || CAST(tenths % 10 AS STRING)
         END AS `IMDB_Rating`,
    CASE WHEN k % 8 = 0 THEN NULL ELSE CAST(units * 100 AS STRING) END AS `IMDB_Votes`
  FROM facts)
SELECT * FROM records
UNION ALL
SELECT ord + 1000000000, `Title`, `US_Gross`, `Worldwide_Gross`, `US_DVD_Sales`, `Production_Budget`,
  `Release_Date`, `MPAA_Rating`, `Running_Time_min`, `Distributor`, `Source`, `Major_Genre`,
  `Creative_Type`, `Director`, `Rotten_Tomatoes_Rating`, `IMDB_Rating`, `IMDB_Votes`
FROM records WHERE ord % 23 = 0
UNION ALL
SELECT ord + 2000000000, `Title`, `US_Gross`, `Worldwide_Gross`, `US_DVD_Sales`, '777',
  `Release_Date`, `MPAA_Rating`, `Running_Time_min`, `Distributor`, `Source`, `Major_Genre`,
  `Creative_Type`, `Director`, `Rotten_Tomatoes_Rating`, `IMDB_Rating`, `IMDB_Votes`
FROM records WHERE ord % 47 = 0
"""

TABLES = ("part", "lineitem", "supplier", "nation")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RAW_SQL, **{name: table(spark, sf_dir, name) for name in TABLES})


def raw_records_sql() -> str:
    """The same records for DuckDB."""
    return RAW_SQL.format(**{name: name for name in TABLES}).replace("`", '"')
