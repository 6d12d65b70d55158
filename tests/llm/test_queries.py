"""Every query of this subpackage that SQL can express against its SQL in DuckDB, and what all operators share."""

import glob
import os
import types

import duckdb
import pytest

from finstmt.llm import queries, shared

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    mine = sorted((tuple(map(str, (r[c] for c in sorted(df.columns)))) for r in df.collect()))
    out = duck.execute(queries.ORACLES[name])
    names = [c[0] for c in out.description]
    theirs = sorted(tuple(str(r[names.index(c)]) for c in sorted(names)) for r in out.fetchall())
    assert sorted(names) == sorted(df.columns) and mine == theirs and mine


def test_no_machine_local_folder_on_a_cluster():
    conf = types.SimpleNamespace(get=lambda *_: None)
    for master, fine in (("spark://host:7077", False), ("local-cluster[3,2,1024]", False), ("yarn", False), ("local[4]", True), ("local", True)):
        spark = types.SimpleNamespace(sparkContext=types.SimpleNamespace(getConf=lambda: conf, master=master), conf=conf)
        if fine:
            assert shared.shared_dir(spark).startswith("file:")
        else:
            with pytest.raises(RuntimeError):
                shared.shared_dir(spark)


def test_settled_tables_can_be_discarded(spark):
    df = shared.settle(spark.range(5), "t")
    folder = df.inputFiles()[0].rpartition("/")[0].removeprefix("file://")
    assert os.path.isdir(folder)
    shared.discard(df)
    assert not os.path.exists(folder)
