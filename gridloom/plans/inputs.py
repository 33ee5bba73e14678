"""The driver tables read as matrices, graphs, points and samples, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..matrix import CliqueMatrix, CoordMatrix


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_group(spark: SparkSession, sf_dir: str) -> CoordMatrix:
    """Customers and suppliers that share an order line of at least 46 pieces: memberships, value 1."""
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity >= 46").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cells = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("row"), F.col("l_suppkey").alias("col")).distinct().withColumn("value", F.lit(1.0))
    rows = table(spark, sf_dir, "customer").agg(F.max("c_custkey")).first()[0]
    cols = table(spark, sf_dir, "supplier").agg(F.max("s_suppkey")).first()[0]
    return CoordMatrix(cells, (rows or 0) + 1, (cols or 0) + 1)


USER_GROUP = "ug AS (SELECT DISTINCT o_custkey AS row, l_suppkey AS col, 1.0::DOUBLE AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 46)"


def user_user(spark: SparkSession, sf_dir: str) -> CliqueMatrix:
    """Customers of one nation and market segment: friendships in both directions, factored by nation and segment."""
    c = table(spark, sf_dir, "customer")
    n = (c.agg(F.max("c_custkey")).first()[0] or 0) + 1
    return CliqueMatrix.of_groups(c.select(F.col("c_custkey").alias("id"), F.struct("c_nationkey", "c_mktsegment").alias("group")), n)


USER_USER = "uu AS (SELECT a.c_custkey AS row, b.c_custkey AS col, 1.0::DOUBLE AS value FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment WHERE a.c_custkey <> b.c_custkey)"


def nation_net(spark: SparkSession, sf_dir: str, sparse: bool = False) -> CoordMatrix:
    """Lines between customers' and suppliers' nations, counted; ``sparse``: only returned lines of 50 pieces, both directions, value 1."""
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity >= 50 AND l_returnflag = 'R'" if sparse else "true").select("l_orderkey", "l_suppkey")
    pairs = lines.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey")
    pairs = pairs.join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("row")), "c_custkey")
    pairs = pairs.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("bigint").alias("col")), "l_suppkey")
    m = CoordMatrix(pairs.groupBy("row", "col").agg(F.count("*").cast("double").alias("value")), 25, 25)
    return m.symmetrised() if sparse else m


_NATIONS = "SELECT c_nationkey::BIGINT AS row, s_nationkey::BIGINT AS col, count(*)::DOUBLE AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey {where} GROUP BY 1, 2"
NATION_NET = f"nn AS ({_NATIONS.format(where='')})"
_RETURNED = "WHERE l_quantity >= 50 AND l_returnflag = 'R'"
NATION_SPARSE = f"n0 AS ({_NATIONS.format(where=_RETURNED)}), ns AS (SELECT DISTINCT row, col, 1.0::DOUBLE AS value FROM (SELECT row, col FROM n0 UNION ALL SELECT col, row FROM n0))"


def user_part(spark: SparkSession, sf_dir: str) -> CoordMatrix:
    """Mean quantity of part type sizes by customer nation: a small dense-ish ratings matrix (nation, part size)."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    j = lines.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey")
    j = j.join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("row")), "c_custkey")
    j = j.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("bigint").alias("col")), "l_partkey")
    return CoordMatrix(j.groupBy("row", "col").agg(F.avg("l_quantity").alias("value")), 25, 51)


USER_PART = "up AS (SELECT c_nationkey::BIGINT AS row, p_size::BIGINT AS col, avg(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, vec (embeddings turned into distributions by softmax) and label."""
    e = F.transform("embedding", lambda x: F.exp(x.cast("double")))
    total = F.aggregate("e", F.lit(0.0), lambda s, x: s + x)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), e.alias("e"), "label").select("id", F.transform("e", lambda x: x / total).alias("vec"), "label")


POINTS = "pe AS (SELECT vec_id AS id, list_transform(embedding, lambda x: exp(x::DOUBLE)) AS e, label FROM embeddings), points AS (SELECT id, list_transform(e, lambda x: x / list_sum(e)) AS vec, label FROM pe)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, score (length of a document) and target (its quality label)."""
    d, lab = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id").select(F.col("doc_id").alias("item"), (F.floor(F.col("n_chars") / 100)).cast("double").alias("score"), F.col("quality").cast("int").alias("target"))


SCORED = "scored AS (SELECT doc_id AS item, floor(n_chars / 100)::DOUBLE AS score, quality::INT AS target FROM documents JOIN labels USING (doc_id))"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as observations of four variables: x, their states from 0. One row a line, repeated lines too."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_suppkey", "l_quantity")
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    status = F.when(F.col("l_linestatus") == "O", 1).otherwise(0)
    return li.select(F.array(flag, status, (F.col("l_suppkey") % 3).cast("int"), F.when(F.col("l_quantity") > 25, 1).otherwise(0)).alias("x"))


SAMPLES = """s0 AS MATERIALIZED (SELECT row_number() OVER () AS sample, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS a, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS b, (l_suppkey % 3)::INT AS c, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS d FROM lineitem),
samples AS (SELECT sample, 0 AS node, a AS state FROM s0 UNION ALL SELECT sample, 1, b FROM s0 UNION ALL SELECT sample, 2, c FROM s0 UNION ALL SELECT sample, 3, d FROM s0)"""


def three_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as observations of four variables of three states each: key (names a line, repeated lines alike) and x."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    third = F.least(F.floor((F.col("l_quantity") - 1) / 17), F.lit(2)).cast("int")
    x = F.array(flag, (F.col("l_suppkey") % 3).cast("int"), third, (F.col("l_partkey") % 3).cast("int"))
    return li.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("key"), x.alias("x"))


THREE_STATES = "s3 AS MATERIALIZED (SELECT row_number() OVER () AS r, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS key, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS a, (l_suppkey % 3)::INT AS b, least(floor((l_quantity - 1) / 17), 2)::INT AS c, (l_partkey % 3)::INT AS d FROM lineitem)"
