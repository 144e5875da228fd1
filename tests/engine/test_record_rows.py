"""Records: each is parsed once for its rows, and coordinates are written as %10.4f has them."""

import pytest
from pyspark.sql import functions as F

from siftstone.operators import molecules


@pytest.mark.parametrize("rows", [molecules.atom_rows, molecules.bond_rows])
def test_rows_parse_a_record_once(spark, tmp_path, rows):
    spark.createDataFrame([("k\n\n\n  0  0\nM  END",)], "value string").write.mode("overwrite").text(str(tmp_path))
    parsed = molecules.parse_records(spark.read.text(str(tmp_path), wholetext=True))
    found = rows(parsed, "name")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert found.collect() == []


def test_coordinates_as_formatted(spark):
    odd = "nan inf -inf -0.0 0.0 1e300 9998.99996 9999 -9999.99999 -9998.99999 -12345.6789 0.00005 -0.00004 0.00099999 0.001 -0.00125 2.00005 1e-320".split()
    rows = spark.createDataFrame([(float(v),) for v in odd] + [(i * 0.00005 - 3,) for i in range(2000)] + [(None,)], "x double")
    got = rows.select(molecules._place("x").alias("p"), F.format_string("%10.4f", F.coalesce("x", F.lit(0.0))).alias("f"))
    assert got.filter("p IS NULL OR p <> f").collect() == []


def test_repeated_and_missing_molecules(spark):
    atoms = spark.createDataFrame([(1, 2, "N", 1.0), (1, 1, "C", None), (9, 1, "C", 0.0)], "mol long, atom int, element string, x double").withColumns({"y": F.col("x"), "z": F.col("x")})
    bonds = spark.createDataFrame([(1, 1, 2, 3), (2, 1, 2, 1)], "mol long, a int, b int, kind int")
    texts = molecules.format_records(spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "mol long"), atoms, bonds, "mol").collect()
    counts = sorted((str(r.mol), r.value.split("\n")[3][:6]) for r in texts)
    assert counts == [("1", "  2  1"), ("1", "  2  1"), ("2", "  0  1"), ("3", "  0  0"), ("None", "  0  0")]
    assert [line[31] for line in texts[[r.mol for r in texts].index(1)].value.split("\n")[4:6]] == ["C", "N"]
