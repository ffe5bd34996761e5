"""Tables stored by cell are read where surveys lie only."""

import numpy as np
from pyspark.sql import functions as F

from tidegrid.operators import coverage, vector


def scanned(df):
    """Rows and folders that the table's scan read, by Spark's own metrics."""
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    text, todo = plan.toString(), [plan]
    files = None
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        elif node.nodeName().startswith("Scan parquet"):
            files = node.metrics().apply("numPartitions").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return rows, text, files


def test_other_cells_are_not_read(spark, tmp_path):
    rng = np.random.default_rng(1)
    points = spark.createDataFrame([(int(i % 5), float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 100, (500, 2)))], "survey long, x double, y double")
    stored = points.withColumn("cell", (F.floor(F.col("y") / 10) * 10 + F.floor(F.col("x") / 10)).cast("int"))
    coverage.write_by_cell(stored, str(tmp_path / "t"))
    small = points.where("x < 28 AND y > 75")
    cells = coverage.hull_cells(vector.hull(small.withColumn("survey", F.lit(1)), "survey"), "survey", 10.0, 10)
    wanted = {r.cell for r in cells.collect()}
    rows, plan, folders = scanned(coverage.of_cells(spark, str(tmp_path / "t"), cells.select("cell")))
    assert "dynamicpruning" in plan and folders == len(wanted & {r.cell for r in stored.collect()}) < 20
    assert sorted((r.x, r.y) for r in rows) == sorted((r.x, r.y) for r in stored.collect() if r.cell in wanted)


def test_cells_of_hulls(spark):
    triangle = [(1, 5.0, 5.0), (1, 38.0, 6.0), (1, 6.0, 27.0), (1, 9.0, 9.0)]
    line, point, out = [(2, 5.0, 5.0), (2, 25.0, 5.0)], [(3, 12.0, 12.0)], [(4, -25.0, 5.0), (4, 3.0, 5.0), (4, 3.0, -15.0)]
    df = spark.createDataFrame(triangle + line + point + out, "survey long, x double, y double")
    got = {(r.survey, r.cell) for r in coverage.hull_cells(vector.hull(df, "survey"), "survey", 10.0, 5).collect()}
    assert {c for s, c in got if s == 1} == {0, 1, 2, 3, 5, 6, 7, 8, 10, 11}
    assert {c for s, c in got if s == 2} == {0, 1, 2} and {c for s, c in got if s == 3} == {6} and {c for s, c in got if s == 4} == {0}
