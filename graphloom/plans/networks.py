"""Street networks drawn from the driver's tables; the SQL runs unchanged in Spark and in the oracle.

``streets``: every supplier and part with a line item between them are joined by one street. Its cost
forward is the least quantity of items that were not returned with flag A, and backward, without flag
R, that of quantity plus line number; a direction without such items is closed.

``trade``: suppliers and customers' nations, one street a pair, with integer costs from the sums of
all line items between them; a third of the streets is open forward only and a third backward only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PART_BASE, NATION_BASE = 100_000_001, 1_000_001

STREETS = f"""
SELECT (l_suppkey + 1) * 1000000000 + l_partkey AS gid, l_suppkey + 1 AS source, {PART_BASE} + l_partkey AS target,
       coalesce(min(CASE WHEN l_returnflag <> 'A' THEN l_quantity END), CAST(-1 AS DOUBLE)) AS cost,
       coalesce(min(CASE WHEN l_returnflag <> 'R' THEN l_quantity + l_linenumber END), CAST(-1 AS DOUBLE)) AS reverse_cost
FROM lineitem GROUP BY l_suppkey, l_partkey
"""

TRADE = f"""
SELECT supplier_id * 1000 + nation_id AS gid, supplier_id AS source, {NATION_BASE} + nation_id AS target,
       CAST(CASE WHEN k % 3 = 0 THEN -1 ELSE 10 + q % 25 END AS DOUBLE) AS cost,
       CAST(CASE WHEN k % 3 = 1 THEN -1 ELSE 10 + (q + k) % 25 END AS DOUBLE) AS reverse_cost
FROM (
  SELECT l_suppkey + 1 AS supplier_id, CAST(c_nationkey AS BIGINT) AS nation_id,
         CAST(sum(l_quantity) AS BIGINT) AS q, CAST(sum(l_linenumber) AS BIGINT) AS k
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  GROUP BY l_suppkey, c_nationkey) pairs
"""

_ITEMS = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"
#: The same joins for Spark, orders with customers first, so that line items are shuffled once before they are summed up.
_NATIONS_FIRST = "lineitem JOIN (SELECT o_orderkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey) homes ON l_orderkey = o_orderkey"

#: Pairs of vertices of ``trade``: each supplier with its own nation, and back.
HOME = f"""
SELECT s_suppkey + 1 AS source, {NATION_BASE} + CAST(s_nationkey AS BIGINT) AS target FROM supplier
UNION ALL SELECT {NATION_BASE} + CAST(s_nationkey AS BIGINT), s_suppkey + 1 FROM supplier
"""

TABLES = ("lineitem", "orders", "customer", "supplier")


def network(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    for name in TABLES:
        if f" {name} " in sql.replace("\n", " "):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(sql)


def streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network(spark, sf_dir, STREETS)


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network(spark, sf_dir, TRADE.replace(_ITEMS, _NATIONS_FIRST))
