"""Upserts and deletes of a table of key ranges, against a dictionary."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import keyed_table

SCHEMA = "id long, v string"


def test_upserts_equal_a_dictionary(spark, tmp_path):
    rng, folder = random.Random(1), f"file://{tmp_path}/t"
    held = {i * 3: f"a{i}" for i in range(2000)}
    keyed_table.create(spark.createDataFrame([*held.items(), (None, "x"), (3, "a0")], SCHEMA).repartition(3), folder, "id", file_rows=100)
    got = lambda: dict(map(tuple, keyed_table.read(spark, folder).collect()))
    assert got() == held
    files = keyed_table._files(spark, folder)[2].count()
    assert files >= 15
    few = [(i, f"b{i}") for i in (300, 301, 303, 306)]
    assert keyed_table.upsert(spark.createDataFrame(few, SCHEMA), folder, 100) <= 2
    held |= dict(few)
    assert got() == held
    assert keyed_table.upsert(spark.createDataFrame([(10**6 + i, "new") for i in range(5)], SCHEMA), folder, 100) == 0
    held |= {10**6 + i: "new" for i in range(5)}
    many = [(rng.randrange(-50, 7000), f"c{i}") for i in range(60)]
    keyed_table.upsert(spark.createDataFrame(many, SCHEMA).repartition(7), folder, 100)
    for k, v in sorted(many):  # of a repeated key the greatest stays
        held[k] = v
    assert got() == held
    gone = [(k,) for k in list(held)[100:140]] + [(-10**9,), (None,)]
    assert 0 < keyed_table.delete(spark.createDataFrame(gone, "id long"), folder, 100) < 12
    assert got() == {k: v for k, v in held.items() if (k,) not in gone}


def test_nothing_and_rivals(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        keyed_table.read(spark, folder)
    keyed_table.create(spark.createDataFrame([], SCHEMA), folder, "id")
    assert keyed_table.read(spark, folder).count() == 0
    assert keyed_table.upsert(spark.range(3).select("id", F.lit("x").alias("v")), folder) == 0
    assert keyed_table.read(spark, folder).count() == 3
    with pytest.raises(RuntimeError, match="another writer"):
        keyed_table._commit(spark, folder, "id", 2, keyed_table._files(spark, folder)[2])
