"""Quality figures of the operators: python -m finstmt.llm.measure SF_DIR [CORES]

Held-out accuracy, precision and recall of ops 2 and 10 on labelled rows of their folds, and the recall of op 9's links
against its SQL, which compares all sets that share a shingle (one thread for each core, in DuckDB).
"""

from __future__ import annotations

import sys

import duckdb
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import near_dup, quality_vote, shared, toxicity


def held_out(scored: DataFrame, labels: DataFrame, label: str) -> dict[str, float]:
    """Of labelled rows of the fold; ids that labels or documents repeat are left out."""
    known = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"), F.count("*").alias("n")).where("n = 1")
    both = scored.where("held_out").join(known, "doc_id").agg(*(F.count_if((F.col("predicted") == p) & (F.col("y") == y)).alias(k) for k, p, y in (("tp", 1, 1), ("fp", 1, 0), ("fn", 0, 1), ("tn", 0, 0)))).first()
    tp, fp, fn, tn = both
    n = tp + fp + fn + tn
    return {"rows": n, "accuracy": round((tp + tn) / max(n, 1), 3), "precision": round(tp / max(tp + fp, 1), 3), "recall": round(tp / max(tp + fn, 1), 3)}


def classes_recall(spark: SparkSession, sf_dir: str, cores: int) -> dict[str, int]:
    """Documents, and how many of them have the set size, component and kept of the exact comparison."""
    con = duckdb.connect(config={"threads": cores})
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir.rstrip('/')}/documents.parquet')")
    want = {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, n_shingles, component_id, kept FROM ({near_dup.OP9_SQL})").fetchall()}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.op9_odd_sketch_near_dup(spark, sf_dir).collect()}
    linked = [i for i, w in want.items() if w[1] != i]
    return {"documents": len(want), "equal": sum(got.get(i) == w for i, w in want.items()), "linked to a smaller id": len(linked), "of these equal": sum(got.get(i) == want[i] for i in linked)}


def main(sf_dir: str, cores: int = 4) -> None:
    spark = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", cores).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    labels = shared.table(spark, sf_dir, "labels")
    print("op2", held_out(toxicity.op2_pu_toxicity(spark, sf_dir), labels, "toxic"), flush=True)
    print("op10", held_out(quality_vote.op10_neighbour_vote(spark, sf_dir), labels, "quality"), flush=True)
    print("op9", classes_recall(spark, sf_dir, cores), flush=True)


if __name__ == "__main__":
    main(sys.argv[1], *map(int, sys.argv[2:]))
