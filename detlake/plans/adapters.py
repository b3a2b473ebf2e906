"""Detection-shaped relations derived from the general test tables.

Each relation is SQL that both Spark and DuckDB read alike; ``relation`` runs it on Spark, the SQL twins include it as a
common table expression. Only whole-number and exactly rounded arithmetic is used, so both engines agree to the bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from detlake.session import table

#: relation -> (tables or relations it reads, SQL)
RELATIONS: dict[str, tuple[tuple[str, ...], str]] = {
    "boxes": (
        ("lineitem",),
        """SELECT CAST(l_orderkey AS BIGINT) AS image_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) AS INT) AS idx,
  CAST(l_suppkey % 4 AS INT) AS class_id, CAST(round(l_discount * 100) AS INT) / CAST(10 AS DOUBLE) AS confidence,
  CAST(l_partkey % 12 AS DOUBLE) AS x1, CAST(l_suppkey % 10 AS DOUBLE) AS y1,
  CAST(l_partkey % 12 + 20 AS DOUBLE) + CAST(l_quantity AS DOUBLE) / CAST(5 AS DOUBLE) AS x2, CAST(l_suppkey % 10 + 20 + l_linenumber % 7 AS DOUBLE) AS y2 FROM lineitem""",
    ),
    "gt": (("boxes",), "SELECT image_id, idx AS gi, class_id, x1, y1, x2, y2 FROM boxes WHERE idx % 2 = 0"),
    "pred": (("boxes",), "SELECT image_id, idx AS pi, class_id, confidence, x1, y1, x2, y2 FROM boxes WHERE idx % 2 = 1"),
    "sites": (
        ("orders",),
        """SELECT CAST(o_orderkey AS BIGINT) AS image_id, CASE WHEN min(o_custkey) % 2 = 0 THEN 'India' ELSE 'Japan' END AS site, 100 AS width, 100 AS height FROM orders GROUP BY o_orderkey""",
    ),
    "pred_b": (("boxes",), "SELECT image_id, idx AS pi, class_id, CAST((idx * 3 + class_id) % 11 AS DOUBLE) / CAST(10 AS DOUBLE) AS confidence, x1 + 1 AS x1, y1, x2 + 1 AS x2, y2 FROM boxes WHERE idx % 2 = 1"),
}


def relation(spark: SparkSession, directory: str, name: str) -> DataFrame:
    if name not in RELATIONS:
        return table(spark, directory, name)
    inputs, sql = RELATIONS[name]
    text = sql
    frames = {}
    for i in inputs:
        frames[i] = relation(spark, directory, i)
        text = text.replace(f"FROM {i}", f"FROM {{{i}}}")
    return spark.sql(text, **frames)


def derived(boxes: DataFrame, name: str) -> DataFrame:
    """A relation that reads only ``boxes``, from a given one."""
    return boxes.sparkSession.sql(RELATIONS[name][1].replace("FROM boxes", "FROM {boxes}"), boxes=boxes)


def with_clause(*names: str) -> str:
    """Common table expressions for the SQL twins, dependencies first, without the WITH."""
    out: dict[str, str] = {}

    def add(name: str):
        if name in RELATIONS and name not in out:
            for i in RELATIONS[name][0]:
                add(i)
            out[name] = f"{name} AS ({RELATIONS[name][1]})"

    for n in names:
        add(n)
    return ",\n".join(out.values())
