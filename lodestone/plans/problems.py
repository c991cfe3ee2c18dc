"""Queries of the general training-data problems (core)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.operators.multivalue import split_values
from lodestone.operators.nearby import neighbourhood
from lodestone.runtime import read


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbourhood(read(spark, sf_dir, "obs"), read(spark, sf_dir, "regions"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_values(read(spark, sf_dir, "hom_allorganism"), "rec_id", "synonyms", "synonym")


QUERIES = {"p3_found": p3_found, "p4_found": p4_found}

#: A ray to the right crosses the ring an odd number of times: the point lies inside.
SQL = {
    "p3_found": """
WITH cur AS (
  SELECT obs, sample, section, x, y FROM (
    SELECT *, row_number() OVER (PARTITION BY obs ORDER BY loaded_at DESC NULLS LAST) AS rn FROM obs) t
  WHERE rn = 1 AND sample IS NOT NULL AND section IS NOT NULL AND isfinite(x) AND isfinite(y)),
edges AS (
  SELECT region_id, xs[i] AS x1, ys[i] AS y1, xs[i % len(xs) + 1] AS x2, ys[i % len(ys) + 1] AS y2
  FROM (SELECT region_id, xs, ys, unnest(range(1, len(xs) + 1)) AS i FROM regions) r),
cells AS (SELECT *, CAST(floor(x / 12.5) AS BIGINT) AS cx, CAST(floor(y / 12.5) AS BIGINT) AS cy FROM cur),
around AS (SELECT c.*, cx + dx AS nx, cy + dy AS ny FROM cells c, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy))
SELECT DISTINCT 'near' AS relation, a.obs AS key_a, b.obs AS key_b
FROM around a JOIN cells b ON a.sample = b.sample AND a.section = b.section AND a.nx = b.cx AND a.ny = b.cy
WHERE a.obs < b.obs AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 156.25
UNION ALL
SELECT 'inside' AS relation, obs AS key_a, region_id AS key_b FROM (
  SELECT c.obs, e.region_id, sum(CASE WHEN c.x < (e.x2 - e.x1) * (c.y - e.y1) / (e.y2 - e.y1) + e.x1 THEN 1 ELSE 0 END) AS n
  FROM cur c JOIN edges e ON (e.y1 > c.y) <> (e.y2 > c.y) GROUP BY 1, 2) h
WHERE n % 2 = 1
"""
}
