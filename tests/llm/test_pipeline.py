"""The pipeline's stages on planted documents, each on its predecessor's rows."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from finstmt.llm import shared, tokens

from .conftest import frame, prose
from .test_operators import base_by_regex, brute_components, check_pieces

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """(docs, every stage's rows) at the smallest scale."""
    docs = shared.table(spark, SF, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(shared.settle(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]


def test_all_but_the_last_return_documents(kept):
    for df in kept[1:-1]:
        assert df.schema == kept[0].schema


def test_toxic_documents_go_and_others_stay(kept, spark):
    labels = shared.table(spark, SF, "labels")
    left = {r.doc_id for r in kept[1].collect()}
    marked = {r.doc_id: r.toxic for r in labels.collect()}
    clean = [i for i, t in marked.items() if not t]
    assert sum(i in left for i in clean) >= 0.95 * len(clean)
    assert kept[1].join(kept[0], ["doc_id", "text"]).count() == kept[1].count()


def test_one_document_of_each_group_stays(kept):
    rows = [(r.doc_id, r.text, r.source) for r in kept[1].collect()]
    want = {i for i, _, c in brute_components(rows, 5, 80) if i == c}
    assert sorted(r.doc_id for r in kept[2].collect()) == sorted(want)


def test_benchmark_passages_are_gone_and_clean_texts_untouched(kept, spark):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[i : i + 10]) for r in shared.table(spark, SF, "benchmark").collect() for w in [words(r.text)] for i in range(max(1, len(w) - 9)) if w}
    hit = lambda t: any(tuple(w[i : i + n]) in windows for w in [words(t)] for n in {len(x) for x in windows} for i in range(len(w) - n + 1))
    before, after = ({r.doc_id: r.text for r in df.collect()} for df in kept[2:4])
    assert before.keys() == after.keys() and not any(map(hit, after.values()))
    assert all((before[i] == after[i]) != hit(before[i]) for i in before)


def test_personal_data_is_masked(kept):
    before, after = ({r.doc_id: r for r in df.collect()} for df in kept[3:5])
    assert before.keys() == after.keys()
    for i, r in after.items():
        spans = base_by_regex(before[i].text or "")
        assert (r.text == before[i].text) or r.text.count("<") >= 1
        assert not base_by_regex(r.text or "") and (spans or r.text == before[i].text or "<" in r.text)
        assert r.n_chars == len(r.text or "")


def test_every_token_is_packed_once(kept):
    check_pieces([r.asDict() for r in kept[5].collect()], [(r.doc_id, r.text) for r in kept[4].collect()])


def test_run_equals_the_stages(kept, spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.agg(F.sum("length"), F.count("*")).first() == kept[5].agg(F.sum("length"), F.count("*")).first()


def test_stages_take_odd_and_empty_documents(spark, odd, none, tmp_path):
    from .conftest import odd_rows

    sf = f"file://{tmp_path}"
    spark.createDataFrame([(6, 1, 0), (4, 0, 1), (20, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, " ".join(prose(9, 60_000).split()[100:130])), (2, None)], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    for docs, least in ((odd, 1), (none, 0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns and least * 10 <= out.count() <= len(odd_rows())
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= least
    assert tokens.ids(None) == [] and frame(spark, []).count() == 0
