"""Reading files of all kinds at once, and only those that are asked for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.sources import readers


def scanned(df):
    """Rows that the plan's scans read, by Spark's own metrics: a tile's file is a row, a line of text is."""
    df.collect()
    todo, found = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        elif node.nodeName().startswith("Scan "):
            found.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


@pytest.fixture(scope="module")
def tiles(tmp_path_factory):
    folder = tmp_path_factory.mktemp("tiles")
    for cell in range(6):
        for cdi in (20, 21):
            a = np.arange(6.0).reshape(2, 3) + 10 * cell + cdi
            a[0, 1] = np.nan
            np.save(folder / f"cell_{cell}_CDI_{cdi}{'_destriped' if cdi == 21 else ''}.npy", a)
    return str(folder)


def test_other_tiles_are_not_opened(spark, tiles):
    every = readers.npy_tiles(spark, tiles)
    assert every.count() == 12 and scanned(every) == [12]
    some = readers.npy_tiles(spark, tiles, F.col("cell").isin(1, 4) & (F.col("cdi") > 20))
    assert {(r.cell, r.cdi, r["data"][2]) for r in some.collect()} == {(1, 21, 33.0), (4, 21, 63.0)} and scanned(some) == [2]
    assert readers.npy_tiles(spark, tiles, F.col("cell") > 99).count() == 0


@pytest.fixture(scope="module")
def xyz(tmp_path_factory):
    folder = tmp_path_factory.mktemp("xyz")
    (folder / "000574_XYZ_a_V1.txt").write_text("Lat (DMS)\tLong (DMS)\tMean (m)\n52-30-15.5N\t3-0-0.0E\t-20.5\n52-30-15.5N\t3-0-0.0E\t-21.5\n")
    (folder / "000574_XYZ_b_V1.txt").write_text('"Mean" "Long (DMS)" "Lat (DMS)"\n-7.25 3-0-0.0E 52-30-15.5N\n\n')
    (folder / "000574_XYZ_c_V2.txt").write_text("Northing Easting Mean\n5817000.5 500000.0 -3\n5817000.5  500010.0 -4\n")
    (folder / "000574_XYZ_d_V2.txt").write_text("Northing\tEasting\tMean (m)\n5817000.5\t500000.0\t-3\n5817000.5\t500000.0\n")
    (folder / "000574_XYZ_e_V2.txt").write_text("")
    return str(folder)


def test_every_dialect_at_once(spark, xyz):
    surveys = spark.createDataFrame([(f"{x}/v{n}", "UTM 31N (32631)") for x, n in ("a1", "b1", "c2", "d2", "e2")], "local_id string, datum string")
    got = {}
    for r in readers.any_soundings(spark, xyz, surveys).orderBy("seq").collect():
        got.setdefault(r.file[11], []).append((round(r.e, 2), r.depth))
    assert got == {"a": [(500000.0, -20.5), (500000.0, -21.5)], "b": [(500000.0, -7.25)], "c": [(500000.0, -3.0), (500010.0, -4.0)], "d": [(500000.0, -3.0), (500000.0, None)]}
    alone = readers.any_soundings(spark, xyz)  # without surveys northing and easting can't be placed
    assert {r.file[11] for r in alone.collect()} == {"a", "b"}
    one = readers.soundings(spark, xyz + "/*_a_*", True).select("file", "lat", "lon", "e", "n", "depth").collect()
    assert sorted(one) == sorted(alone.where("file LIKE '%a_V1.txt'").select("file", "lat", "lon", "e", "n", "depth").collect())


def test_other_files_are_not_opened(spark, xyz):
    some = readers.any_soundings(spark, xyz, files=F.col("file").isin("000574_XYZ_b_V1.txt", "000574_XYZ_z_V1.txt"))
    assert [r.depth for r in some.collect()] == [-7.25] and set(scanned(some)) == {3}
