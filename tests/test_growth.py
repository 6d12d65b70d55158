"""What a task holds follows neither the input nor the number of cores; documents are gone through once."""

import re

from finstmt.operators import analysis, depreciation, documents
from finstmt.plans import adapter, queries

SF = "/root/testdata/sf0.001"
NODE = "corp string, year int, pos int, kind string, title_text string, rows array<array<string>>, prev_texts array<string>"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_partitions_follow_the_number_of_filings(spark, monkeypatch):
    monkeypatch.setattr(adapter, "FILINGS_A_TASK", 5)
    facts = adapter.facts(spark, SF)
    n = facts.count()
    assert facts.rdd.getNumPartitions() == -(-n // 5)
    assert adapter.nodes(spark, SF, facts).rdd.getNumPartitions() == -(-n // 5)
    words = adapter.word_facts(spark, SF).count()
    assert adapter.word_accounts(spark, SF).rdd.getNumPartitions() == -(-words // 5) and adapter.word_nodes(spark, SF).rdd.getNumPartitions() == -(-words // 5)


def test_nodes_are_gone_through_once(spark):
    nodes = spark.createDataFrame([
        ("a", 1, 0, "title", "재무상태표", None, None), ("a", 1, 1, "table", None, [["매출액", "1"]], None), ("b", 1, 0, "title", "현금흐름표", None, None),
        ("b", 1, 1, "table", None, [["매출액", "1"]], None), ("b", 1, 2, "table", None, [["x", "1"]], None), ("c", 1, 0, "table", None, [["자산총계", "1"]], None), ("c", 1, 1, "table", None, [], None),
    ], NODE)
    t = documents.statement_tables(nodes)
    assert "Join" not in plan_of(t) and "Union" not in plan_of(t)
    assert sorted((r.corp, r.pos, r.section) for r in t.collect()) == [("a", 1, "BS"), ("b", 1, "CF"), ("b", 1, "IS"), ("b", 2, "CF"), ("c", 0, "BS")]
    assert set(t.columns) == {*nodes.columns, "section"}


def test_no_table_of_companies_is_broadcast(spark, monkeypatch):
    """However small files or shuffles look: here all of them are below the limit for broadcasts."""
    plans, settle = [], analysis.settle
    monkeypatch.setattr(depreciation, "notes_candidates", None)  # nothing asks for the notes

    def settled(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settle(df, name)

    monkeypatch.setattr(analysis, "settle", settled)
    out = queries.analysis_run(spark, SF)
    assert out.count() and len(plans) == 5
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    joins = [k for p in plans for k in re.findall(r"(\w+Join) \[([^]]*)\]", p)]
    sent = {keys for kind, keys in joins if kind.startswith("Broadcast")}
    assert sent and not [k for k in sent if re.search("corp|name|year", k)]
    assert [k for kind, k in joins if kind == "SortMergeJoin" and "corp" in k]


def test_archives_are_spread_over_folders(spark, tmp_path, monkeypatch):
    """No folder that the driver lists follows the input; what is read of them is all that was written."""
    monkeypatch.setattr(adapter, "ARCHIVES_A_FOLDER", 5)
    n = adapter.facts(spark, SF).count()
    nodes = adapter.archived(spark, SF, f"file://{tmp_path}")
    assert len(list(tmp_path.glob("*/*.zip"))) == n and not list(tmp_path.glob("*.zip"))
    assert {p.name for p in tmp_path.iterdir()} <= {f"{i:05d}" for i in range(-(-n // 5))} and len(list(tmp_path.iterdir())) > 1
    assert nodes.select("corp", "year").distinct().count() == n and nodes.count() == adapter.nodes(spark, SF).count()
