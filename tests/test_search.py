"""Names within names, by substring index, against looking at every pair."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from finstmt.operators import resolve

REG = "corp_code string, corp_name string, pos int"


def brute(names, registry):
    out = {}
    for name in names:
        exact = [r for r in registry if name is not None and r[1] == name]
        near = sorted((r[2], r[1]) for r in registry if name is not None and r[1] is not None and name in r[1])
        status = "ok" if len(exact) == 1 else "ambiguous_corp" if exact else "no_corp"
        hints = [r[1] for r in exact][:3] if exact else [n for _, n in near][:3]
        out[name] = (exact[0][0] if len(exact) == 1 else None, status, None if status == "ok" or not hints else hints)
    return out


def found(spark, names, registry):
    got = resolve.resolve(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(registry, REG))
    return {r["name"]: (r["corp_code"], r["status"], r["hints"]) for r in got.collect()}


def test_against_every_pair(spark):
    r = random.Random(4)
    word = lambda n: "".join(r.choice("가나다ab한😀 ") for _ in range(n))
    registry = [(f"c{i}", word(r.randrange(0, 24)), i) for i in range(400)] + [("n", None, 900), ("long", "ab" * 3000, 901)]
    names = {registry[i][1][a : a + n] for i, a, n in ((r.randrange(400), r.randrange(8), r.randrange(20)) for _ in range(150))}
    names |= {word(r.randrange(1, 9)) for _ in range(60)} | {"", "a", "ab" * 9, "ab" * 2047, "zz", None, "한" * 9000}
    assert found(spark, names, registry) == brute(names, registry)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("xyz", max_size=6), max_size=12), st.sets(st.text("xyz", max_size=5), max_size=6))
def test_any_names(spark, registered, names):
    registry = [(f"c{i}", n, i) for i, n in enumerate(registered)]
    assert found(spark, names, registry) == brute(names, registry)


def test_a_name_in_all_of_the_registry_keeps_three(spark):
    registry = [(f"c{i}", f"S{i:05}", i) for i in range(3000)]
    assert found(spark, ["S", "0", "S0299"], registry) == brute(["S", "0", "S0299"], registry)


@pytest.mark.parametrize("broadcast", ["10485760", "-1"])
def test_no_loop_over_pairs(spark, broadcast):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        df = resolve.resolve(spark.createDataFrame([("a",)], "name string"), spark.createDataFrame([("c", "b", 1)], REG))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "WindowGroupLimit" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
