"""A deterministic business data set derived from ``customer``, as SQL both engines run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

A = "Acme Bluebird Cobalt Delta Evergreen Falcon Granite Harbor Ivory Juniper Keystone".split()
B = "River Mountain Valley Ocean Prairie Canyon Meadow Forest Island Desert Lagoon Summit Tundra".split()
C = "Trading Foods Systems Textiles Motors Hotels Research".split()
LEGAL = ["Ltd", "Pvt Ltd", "Inc", "SARL"]
STREETS = "Oak Pine Maple Cedar Elm Walnut Birch Ash Spruce Willow Poplar Cherry Hazel Linden Alder Laurel Rowan".split()
CITIES = "Springfield Riverton Lakewood Fairview Kingston Ashford Milton Dayton Newport".split()


def _pick(values: list[str], index: str) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_BASE = f"""
SELECT k, CASE c_nationkey % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'IN' ELSE 'FR' END AS country,
  {_pick(A, "k % 11")} AS a, {_pick(B, "CAST(floor(k / 11.0) AS BIGINT) % 13")} AS b, {_pick(C, "CAST(floor(k / 143.0) AS BIGINT) % 7")} AS c,
  {_pick(LEGAL, "k % 4")} AS lg,
  concat(CAST(100 + k AS VARCHAR(20)), ' ', {_pick(STREETS, "(7 * k) % 17")}, ' Street, ', {_pick(CITIES, "k % 9")}) AS street,
  CAST(10000 + (37 * k) % 90000 AS VARCHAR(20)) AS zip
FROM (SELECT c_custkey AS k, c_nationkey FROM customer) x
"""

#: entity_id, src, business_name, business_address, country
RAW = f"""
SELECT concat('S1-', CAST(k AS VARCHAR(20))) AS entity_id, 'S1' AS src, concat(a, ' ', b, ' ', c, ' ', lg) AS business_name, concat(street, ' ', zip) AS business_address, country FROM ({_BASE}) t
UNION ALL
SELECT concat('S2-', CAST(k AS VARCHAR(20))), 'S2',
  CASE k % 5
    WHEN 0 THEN concat(a, ' ', b, ' ', c, ' ', replace(lg, 'Ltd', 'Limited'))
    WHEN 1 THEN concat(replace(a, 'a', 'á'), ' ', b, ' ', c, ' ', lg)
    WHEN 2 THEN concat(substr(a, 1, 2), substr(a, 4), ' ', b, ' ', c, ' ', lg)
    WHEN 3 THEN concat(b, ' ', a, ' ', c, ' ', lg)
    ELSE concat(a, ' ', b, ' ', c, ' ', lg) END,
  CASE WHEN k % 5 = 4 THEN street ELSE concat(street, ' ', zip) END, country
FROM ({_BASE}) t WHERE k % 3 <> 0
UNION ALL
SELECT concat('S3-', CAST(k AS VARCHAR(20))), 'S3', concat('M/s ', upper(concat(a, ' ', b, ' & ', c, ' ', lg))), concat('Near ', street, ' ', zip), country
FROM ({_BASE}) t WHERE k % 4 = 1
"""

#: s1, cand
GOLD = """
SELECT concat('S1-', CAST(c_custkey AS VARCHAR(20))) AS s1, concat('S2-', CAST(c_custkey AS VARCHAR(20))) AS cand FROM customer WHERE c_custkey % 3 <> 0
UNION ALL
SELECT concat('S1-', CAST(c_custkey AS VARCHAR(20))), concat('S3-', CAST(c_custkey AS VARCHAR(20))) FROM customer WHERE c_custkey % 4 = 1
"""

S1 = """
SELECT concat('S1-', CAST(c_custkey AS VARCHAR(20))) AS s1, CASE c_nationkey % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'IN' ELSE 'FR' END AS country FROM customer
"""

#: Made-up probabilities, equal in any engine: s1, cand, p. Every seventh S1 record has no pair.
SCORED = """
SELECT concat('S1-', CAST(k AS VARCHAR(20))) AS s1, concat('S2-', CAST(CASE WHEN j = 0 THEN k ELSE (k * 7 + j * 13) % 997 + 1 END AS VARCHAR(20))) AS cand,
  CASE WHEN j = 0 THEN 0.4 + (CAST((31 * k) % 600 AS DOUBLE)) / 1000 ELSE CAST((31 * k + 17 * j + 7 * j * j) % 800 AS DOUBLE) / 1000 END AS p
FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 7 <> 0) a CROSS JOIN (VALUES (0), (1), (2), (3)) AS g(j)
"""


class Biz:
    """The derived tables as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.customer = spark.read.parquet(f"{sf_dir}/customer.parquet")

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text.replace("FROM customer", "FROM {customer}"), customer=self.customer)

    def raw(self) -> DataFrame:
        return self.sql(RAW)

    def records(self) -> DataFrame:
        from ..functions.normalize import normalize_records

        return normalize_records(self.raw())

    def gold(self) -> DataFrame:
        return self.sql(GOLD)

    def s1(self) -> DataFrame:
        return self.sql(S1)

    def scored(self) -> DataFrame:
        return self.sql(SCORED)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
