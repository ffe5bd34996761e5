"""Which cells surveys cover, and reading only those from a table that is stored by cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crossings, vector
from .labels import saved

#: Rows of the table of cells up to which it is broadcast, and so prunes what is read.
FEW = 100_000


def hull_cells(hulls: DataFrame, key: str, size: float, across: int) -> DataFrame:
    """key, cell: the cells of `size` that each of `hulls` (key, seq, x, y; of vector.hull()) meets, borders included. Cells are
    numbered row by row, `across` to a row; cells beside the map are left out. A hull that is a line covers the cells that it meets.
    """
    edges = vector.edges(hulls.withColumnRenamed(key, "id"))
    met = crossings.polygon_cells(edges, size).where(F.col("row") >= 0).where(F.col("col").between(0, across - 1))
    return met.select(F.col("id").alias(key), (F.col("row") * across + F.col("col")).cast("int").alias("cell"))


def write_by_cell(df: DataFrame, path: str) -> None:
    """`df` as Parquet, a folder a cell: mostly one file, several of a cell with very many rows, which Spark deals to several tasks."""
    df.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(path)


def of_cells(spark: SparkSession, path: str, cells: DataFrame) -> DataFrame:
    """The rows of write_by_cell()'s table that are in `cells` (cell and other columns), joined to them.

    While the table of cells is small, it is broadcast, and the scan skips the folders of all other cells before it opens a file:
    Spark prunes partitions by what the join will find. A larger one takes a shuffled join.
    """
    cells = saved(cells)
    few = cells.count() <= FEW
    cells = cells.where(F.col("cell") >= 0)  # told to be selective, so that Spark prunes by it
    return spark.read.parquet(path).join(F.broadcast(cells) if few else cells, "cell")
