"""Every registered statement query against its SQL in DuckDB, and the entry point without the optional parts."""

import decimal
import glob
import math
import os
import subprocess
import sys

import duckdb
import pytest

from finstmt.functions import catalog
from finstmt.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool):
        return x
    return round(float(x), 4) if isinstance(x, int | float | decimal.Decimal) else str(x)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    mine = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    out = duck.execute(queries.ORACLES[name])
    names = [c[0] for c in out.description]
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in out.fetchall()), key=repr)
    assert sorted(names) == sorted(df.columns) and mine == theirs and mine


@pytest.mark.parametrize(("words", "at", "name"), [("SCOPE_TITLES", 3, "word_scopes"), ("EXACT_DEPR", 1, "word_signals"), ("PARTIAL_TITLES", 5, "word_candidates"), ("STATEMENT_ROOTS", 9, "word_cash_flow"), ("BS_WORDS", 4, "word_sections")])
def test_a_wrong_word_shows(spark, duck, monkeypatch, words, at, name):
    """The SQL has words of its own."""
    wrong = list(getattr(catalog, words))
    wrong[at] += "가"
    monkeypatch.setattr(catalog, words, wrong)
    with pytest.raises(AssertionError):
        test_query_equals_its_sql(spark, duck, name)


def test_entry_works_without_the_optional_parts(tmp_path):
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    os.makedirs(tmp_path / "finstmt")
    os.symlink(f"{here}/__spark_entry__.py", tmp_path / "e.py")
    for p in os.listdir(f"{here}/finstmt"):
        if p not in ("llm", "__pycache__"):
            os.symlink(f"{here}/finstmt/{p}", tmp_path / "finstmt" / p)
    code = "import sys; sys.path.insert(0, '.'); exec(open('e.py').read().replace('os.path.abspath(__file__)', 'os.path.abspath(\"e.py\")')); q = queries(); assert 'ebitda' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; assert oracle_sql().keys() <= q.keys()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})
