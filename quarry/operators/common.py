"""Ranking and broadcasting helpers of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows up to which a table of queries is sent to all tasks.
MOST_BROADCAST = 10_000


def broadcast_if_small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """df, marked for broadcast only if it has `most` rows or fewer."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Queries in a block and rows in a slice of them, where there are too many queries to send to all tasks.
QUERIES_A_BLOCK, ROWS_A_SLICE = 1_000, 50_000


def met(rows: DataFrame, queries: DataFrame, key: str = "id") -> DataFrame:
    """Every row of rows beside every query. Few queries are sent to all tasks; of more, blocks meet slices
    of the rows in an equi-join on their numbers, so a row is sent once a block and a query once a slice.
    key: the column of rows that deals them."""
    if queries.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        return rows.crossJoin(F.broadcast(queries))
    names = [*rows.columns, *queries.columns]
    blocks, slices = (max(1, -(-df.count() // n)) for df, n in ((queries, QUERIES_A_BLOCK), (rows, ROWS_A_SLICE)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("_slice", dealt(key, slices)).withColumn("_block", each(blocks))
    right = queries.withColumn("_block", dealt("query_id", blocks)).withColumn("_slice", each(slices))
    return left.join(right, ["_block", "_slice"]).select(*names)


def ranked(df: DataFrame, by: list[str], score: str, k: int | None, name: str = "rank", ties: str = "id") -> DataFrame:
    """Position within groups by falling score (to 9 places), ties to the smaller id; k at most."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.round(score, 9).desc(), ties))
    out = df.withColumn(name, place)
    return out if k is None else out.filter(F.col(name) <= k)


def score6(x: Column) -> Column:
    """Rounded to six places, as results are shown and compared."""
    return F.round(x, 6)
