"""Each operator against brute force, an exact round trip or held-out accuracy, and on odd rows."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from finstmt.llm import decontaminate, labelled, license_scan, line_quality, near_dup, packing, pii, quality_vote, shared, token_rollup, tokens, toxicity, warc_store

from .conftest import frame, odd_rows, prose

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# 1 token rollups


def test_rollup_is_additive_and_idempotent(spark, odd):
    root = shared.new_path(spark, "t")
    found = token_rollup.counts(odd)
    rows = found.select("source", "lang", F.lit("v1").alias("tokenizer"), F.col("bpe").alias("n_tokens"))
    token_rollup.commit(spark, root, "a", token_rollup.signed(rows, 1))
    token_rollup.commit(spark, root, "a", token_rollup.signed(rows, 1))
    want, docs = Counter(), Counter()
    for _, text, source in odd_rows():
        want[source] += len(tokens.ids(text))
        docs[source] += 1
    total = {r["source"]: (r["n_docs"], r["n_tokens"]) for r in rows_of(token_rollup.totals(spark, root))}
    assert total == {s: (docs[s], want[s]) for s in docs}
    b = rows.where("source = 'b'")
    token_rollup.commit(spark, root, "revise", token_rollup.revised(b, b.withColumn("n_tokens", F.lit(7).cast("bigint"))))
    token_rollup.commit(spark, root, "drop", token_rollup.signed(rows.where("source = 'a'"), -1))
    token_rollup.commit(spark, root, "nothing", token_rollup.signed(rows.limit(0), 1))
    total = {r["source"]: (r["n_docs"], r["n_tokens"]) for r in rows_of(token_rollup.totals(spark, root))}
    assert total == {None: (docs[None], want[None]), "b": (docs["b"], 7 * docs["b"]), "c": (docs["c"], want["c"])}


def test_attempts_without_manifest_do_not_count(spark):
    root = shared.new_path(spark, "t")
    one = spark.createDataFrame([("s", "en", "v", 1, 5)], token_rollup.DELTA)
    token_rollup.commit(spark, root, "x", one)
    one.select("*", F.lit("y").alias("batch"), F.lit("lost").alias("attempt")).write.mode("append").parquet(f"{root}/deltas")
    assert [r["n_tokens"] for r in rows_of(token_rollup.totals(spark, root))] == [5]


def test_changes_by_document(spark):
    schema = "doc_id bigint, source string, lang string, tokenizer string, n_tokens bigint"
    old = [(1, "a", "en", "t", 5), (2, "a", "en", "t", 7), (3, "b", "en", "t", 9), (3, "b", "en", "t", 9), (None, "a", None, "t", 4), (5, "a", "en", "t", 1)]
    new = [(1, "a", "en", "t", 5), (2, "a", "en", "t", 8), (3, "b", "en", "t", 9), (4, "c", "de", "t", 0), (None, "a", None, "t", 4), (5, "b", "en", "t", 1)]
    got = sorted((r["source"], r["n_docs"], r["n_tokens"]) for r in rows_of(token_rollup.changes(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema))))
    assert got == sorted([("a", -1, -7), ("a", 1, 8), ("b", -1, -9), ("c", 1, 0), ("a", -1, -1), ("b", 1, 1)])


def test_compaction_keeps_totals_and_what_was_sent(spark):
    root = shared.new_path(spark, "t")
    token_rollup.create(spark, root)
    rows = lambda n: token_rollup.signed(spark.createDataFrame([("a", "en", "v", n)], "source string, lang string, tokenizer string, n_tokens bigint"), 1)
    read = lambda: [(r["n_docs"], r["n_tokens"]) for r in rows_of(token_rollup.totals(spark, root))]
    for i in range(4):
        token_rollup.commit(spark, root, f"b{i}", rows(10**i))
    token_rollup.commit(spark, root, "b1", rows(5))
    assert read() == [(4, 1111)]
    for n in (1, 1):  # a second compaction finds one batch
        token_rollup.compact(spark, root)
        assert read() == [(4, 1111)] and token_rollup.live(spark, root).count() == n
    assert token_rollup.vacuum(spark, root) == 6 and token_rollup.vacuum(spark, root) == 0 and read() == [(4, 1111)]
    token_rollup.commit(spark, root, "b2", rows(7))  # sent once more after it was covered
    token_rollup.commit(spark, root, "b9", rows(20000))
    assert read() == [(5, 21111)]
    spark.createDataFrame([("x", "y")], token_rollup.COVERED).write.mode("append").parquet(f"{root}/covered")  # a compaction that was cut off
    attempts = [r["attempt"] for r in rows_of(token_rollup.live(spark, root))]
    spark.createDataFrame([(a, "cut-off") for a in attempts], token_rollup.COVERED).write.mode("append").parquet(f"{root}/covered")
    assert read() == [(5, 21111)]


def test_rollup_without_batches_and_without_documents(spark, none):
    root = shared.new_path(spark, "t")
    token_rollup.create(spark, root)
    assert token_rollup.totals(spark, root).count() == 0
    found = token_rollup.counts(none).select("source", "lang", F.lit("v").alias("tokenizer"), F.col("words").alias("n_tokens"))
    token_rollup.commit(spark, root, "none", token_rollup.signed(found, 1))
    assert token_rollup.totals(spark, root).count() == 0


def test_rollup_query_against_brute_force(spark):
    n_docs, n_tokens = Counter(), Counter()
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        for version, n in (("byte_bpe_50k", len(tokens.ids(r.text))), ("white_space", len(SPACED.findall(r.text or "")))):
            n_docs[r.source, r.lang, version] += 1
            n_tokens[r.source, r.lang, version] += n
    out = {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in rows_of(token_rollup.op1_token_rollup(spark, SMALL))}
    assert out == {k: (n_docs[k], n_tokens[k]) for k in n_docs}


def test_rank_file_gives_the_ids_of_the_json_file():
    import public_tokenizers

    t = tokens._json(public_tokenizers.path(tokens.BPE_JSON))
    for text in [prose(1, 300), "Ünïcode  \n\n x<|endoftext|>y 12345 don't", " " * 5000 + "x", "日本語テキスト" * 50]:
        assert tokens.ids(text) == t.encode(text, add_special_tokens=False).ids


# 2 toxicity


def test_toxicity_held_out(spark):
    from __spark_entry__ import queries

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = queries()["op2_pu_toxicity"](spark, SF).join(labels, "doc_id").toPandas()
    test = out[out.held_out]
    assert ((test.predicted == test.toxic).mean()) > 0.92
    assert test.score.between(0, 1).all()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in out.doc_id]).all()


def test_toxicity_never_sees_labels_of_the_fold(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    lied = labels.withColumn("toxic", F.when(labelled.held_out("doc_id", 3, 1), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.learn(docs, labels).weights == toxicity.learn(docs, lied).weights


def test_toxicity_reads_no_label_but_toxic_ones(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    one, two = toxicity.learn(docs, labels), toxicity.learn(docs, labels.where("toxic = 1"))
    assert one.weights and one.weights == two.weights and (one.slope, one.shift) == (two.slope, two.shift)


def test_gradient_is_that_of_the_risk():
    r, prior = np.random.default_rng(3), 0.3
    soft = lambda x: np.log1p(np.exp(x))
    negative = lambda zp, zu: sum(soft(x) for x in zu) / len(zu) - prior * sum(soft(x) for x in zp) / len(zp)
    positive = lambda zp: prior * sum(soft(-x) for x in zp) / len(zp)
    for shift in (-3.0, 3.0):  # with low scores of unlabelled text the risk of negatives falls below zero
        zp, zu = r.normal(2, 1, 5), r.normal(shift, 1, 7)
        whole = negative(zp, zu) >= 0
        assert whole == (shift > 0)
        risk = lambda p, u: positive(p) + negative(p, u) if whole else -negative(p, u)  # noqa: B023, E731
        for got, z in zip(toxicity.gradient(zp, zu, prior), (zp, zu), strict=True):
            for i in range(len(z)):
                z[i] += 1e-5
                high = risk(zp, zu)
                z[i] -= 2e-5
                low = risk(zp, zu)
                z[i] += 1e-5
                assert got[i] == pytest.approx((high - low) / 2e-5, abs=1e-6)


def test_prior_and_scale_come_from_positives_and_unlabelled_text():
    r = np.random.default_rng(7)
    for prior in (0.05, 0.2, 0.5):
        zp = r.normal(3, 1, 4000)
        zu = np.concatenate([r.normal(3, 1, round(20_000 * prior)), r.normal(-1, 1, round(20_000 * (1 - prior)))])
        assert toxicity.prior_of(zp, zu) == pytest.approx(prior, abs=0.03)
        a, b = toxicity.scale(zp, zu, prior)
        assert toxicity._sigmoid(a * zu + b).mean() == pytest.approx(prior, abs=1e-3)
        assert (a * zp + b > 0).mean() > 0.8 and (a * zu[-1000:] + b > 0).mean() < 0.05


def test_samples_are_bounded_however_many_rows_share_an_id(spark):
    rows = [(i % 40, f"text {i}", "s") for i in range(4000)] + [(41, "same", "s")] * 4000
    docs, labels = frame(spark, rows), spark.createDataFrame([(i, 1) for i in range(42)], "doc_id bigint, toxic int")
    found = rows_of(labelled.sample(docs, labels, "toxic", 3, 1, 10**6))
    want = [i for i in [*range(40), 41] if zlib.crc32(str(i).encode()) % 3 != 1]
    assert sorted(x["doc_id"] for x in found) == want
    assert labelled.sample(docs, labels, "toxic", 3, 1, 10).count() < 30
    free = labelled.unlabelled(docs, 3, 1, 500)
    assert 0 < free.count() < 600 and not free.where(labelled.held_out("doc_id", 3, 1)).count()


def test_nnpu_risk_learns_from_positives_and_unlabelled_only():
    r = np.random.default_rng(0)
    pos = [np.unique(np.append(r.integers(2, 40, 10), 0)) for _ in range(60)]
    unl = [np.unique(r.integers(2, 40, 10)) for _ in range(270)] + pos[:30]
    w, b = toxicity.train(pos, unl, 0.1, 40)
    assert w[0] > 1 and np.abs(w[2:]).max() < w[0] / 2


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (4, None), (None, 1), (6, 0), (99, 1)], "doc_id bigint, toxic int")
    model = toxicity.learn(odd, labels)
    assert len(toxicity.scored(shared.pick(odd, doc_id="bigint", text="string"), model, ["doc_id"]).collect()) == len(odd_rows())
    assert toxicity.learn(odd, labels.limit(0)) is not None and toxicity.learn(none, labels).weights == {}
    assert toxicity.without_toxic(none, labels).columns == none.columns


# 3 personal data

FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _valid(kind, text):
    d = re.sub("[^0-9]", "", text)
    luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in text.split(".")), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]


def base_by_regex(text):
    return [(k, *m.span()) for k, p in FORMS.items() for m in re.finditer(p, text) if _valid(k, m[0])]


def test_base_spans_equal_the_plain_patterns():
    r = random.Random(3)
    texts = ["a@b@c.de_x@y.zz", "x@.com@a-b.c..d@e.f", "1.2.3.4.5.6.7.8", "4111 1111-1111 1111", "+1 (555) 123-4567 +12", "@a.b", "a@b", "999.1.1.1 01.002.3.4", "%@a.b.c@d.e"]
    texts += ["".join(r.choice("aB@..-+1 9%_(é") for _ in range(r.randint(0, 60))) for _ in range(20_000)]
    for t in texts:
        assert pii.base_spans(t) == base_by_regex(t), t


def test_base_spans_take_linear_time():
    for t in ["a" * 300_000, "1" * 300_000, "1." * 150_000, "@" * 300_000, "+1" * 150_000, "a@" * 150_000, "1-" * 150_000]:
        assert len(pii.base_spans(t)) < 80_000


def test_patterns_discover_unseen_identifiers(spark):
    texts = [f"Call us by phone +1 (555) 100-2{i:03d} now" for i in range(20)] + ["by phone 555-0199-77 today", "order 5550-199-77 today", "room 12345678"]
    out = {r["doc_id"]: r for r in rows_of(pii.extract(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])))}
    assert out[20]["spans"] == "phone:9:20" and out[20]["base"] == ""
    assert out[21]["spans"] == out[22]["spans"] == ""
    assert all(out[i]["spans"] == out[i]["base"] for i in range(20))


def test_slots_are_whole_identifiers():
    found = lambda t: [t[x["first"] : x["last"]] for x in pii.slots(t, pii.base_spans(t))]
    key = "k" * 100 + "7"
    for one in ["020 7946 0958", "(212) 555-0147", "4111 1111 1111 1112", "2001:db8::1", "fe80::dead:beef", "jane.doe@localhost", key]:
        assert found(f"see phone {one}, and (at last: {one}) go") == [one, one], one
    assert found("std::vector of a: b, room 12, 3 men, @name1234 and see 555-0199-77 today") == ["555-0199-77"]
    for t in ["a" * 300_000, "1" * 300_000, "1." * 150_000, "1:" * 150_000, "a:" * 150_000, "1 " * 150_000, "(1" * 150_000, "a@" * 150_000, "a." * 150_000 + "1"]:
        assert len(found("x " + t)) <= 150_000


def test_patterns_discover_local_and_spaced_identifiers(spark):
    r = random.Random(1)
    cards = [c for c in ("".join(r.choice("0123456789") for _ in range(16)) for _ in range(400)) if pii._luhn(c)][:8]
    texts = [f"our phone +44 20 7946 1{i:03d} now" for i in range(8)] + [f"paid with card {c} now" for c in cards]
    texts += [f"from host 10.0.0.{i} now" for i in range(8)] + [f"write mail user{i}@example.com now" for i in range(8)]
    texts += [f"until +44 20 7946 2{i:03d} now" for i in range(8)] + [f"until 2024-01-{i:02d} now" for i in range(10, 30)]
    n = len(texts)
    new = [("phone", "020 7946 0958"), ("phone", "(212) 555-0147"), ("card", "4111 1111 1111 1112"), ("ip", "2001:db8::1"), ("email", "jane.doe@localhost")]
    before = {"phone": "phone", "card": "card", "ip": "host", "email": "mail"}
    texts += [f"{before[k]} {one} end" for k, one in new] + [f"phone 020 7946 1{i:03d} end" for i in range(12)]
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    out = {x["doc_id"]: x for x in rows_of(pii.extract(docs))}
    for i, (k, one) in enumerate(new, n):
        at = texts[i].index(one)
        assert out[i]["spans"] == f"{k}:{at}:{at + len(one)}" and out[i]["base"] == "", texts[i]
    assert all(out[i]["spans"] == "phone:6:19" for i in range(n + len(new), len(texts)))
    assert all(out[i]["spans"] == out[i]["base"] for i in range(n))
    masked = {x["doc_id"]: x["text"] for x in rows_of(pii.redact(docs))}
    assert [masked[n + i] for i in range(len(new))] == [f"{before[k]} <{k}> end" for k, _ in new]


def brute_patterns(edges, seeds, min_support=5, min_score=0.8, decay=0.9):
    """edges: (pattern, instance) -> form bits; seeds: (instance, kind)."""
    accepted = {}
    while True:
        sure = {(i, k): 1.0 for i, k in seeds}
        for (p, i), _ in edges.items():
            for k in pii.KINDS:
                if (p, k) in accepted:
                    sure[i, k] = max(sure.get((i, k), 0), accepted[p, k] * decay)
        known = {i for i, _ in sure}
        new = dict(accepted)
        for p in {p for p, _ in edges}:
            mine = {i: f for (q, i), f in edges.items() if q == p}
            for n, k in enumerate(pii.KINDS):
                total = sum(sure.get((i, k), 0) for i in mine)
                of = sum(1 for i, f in mine.items() if not f >> n & 1 or i in known)
                if len(mine) >= min_support and total >= min_support * min_score - 1e-12 and total / of >= min_score:
                    new[p, k] = max(new.get((p, k), 0), total / of)
        if new.keys() == accepted.keys():
            return new
        accepted = new


def test_pattern_scores_against_brute_force(spark, monkeypatch):
    for seed, heavy in ((1, 1000), (2, 3), (3, 3)):
        monkeypatch.setattr(shared, "HEAVY", heavy)
        monkeypatch.setattr(shared, "MOST_HEAVY", 2 if heavy == 3 else 100_000)
        r = random.Random(seed)
        form = {i: r.choice([8, 8, 8, 12, 15, 2, 0]) for i in range(60)}
        edges = {(f"p{min(r.randint(0, 9), r.randint(0, 9))}", i): form[i] for i in form for _ in range(4)}
        edges |= {("hot", i): form[i] | 8 for i in range(40, 60)} | {(f"late{i % 2}", i): 8 for i in range(60, 72)} | {("hot", i): 8 for i in range(60, 69)}
        seeds = {(i, "phone") for i in range(40, 58)} | {(i, r.choice(pii.KINDS)) for i in range(25)}
        got = pii.score_patterns(
            shared.settle(spark.createDataFrame([(*k, f) for k, f in edges.items()], "pattern string, instance bigint, form bigint"), "edges"), spark.createDataFrame(list(seeds), "instance bigint, kind string")
        )
        want = brute_patterns(edges, seeds)
        assert {(x["pattern"], x["kind"]): round(x["score"], 9) for x in rows_of(got)} == {k: round(v, 9) for k, v in want.items()} and want


def test_contexts_are_whole_words_however_far():
    far, long = "phone number" + " " * 500 + "5550199", "a" * 200 + " id 5550199"
    assert pii.Contexts(far).before(far.index("5550199")) == ["number", "phone number"]
    assert pii.Contexts(long).before(long.index("5550199")) == ["id", "a" * 200 + " id"]
    assert pii.Contexts("5550199").before(0) == []
    many = "12345678  " * 30_000
    assert len(pii.slots(many, [])) == 0


def test_pii_odd_rows(spark, odd, none):
    out = rows_of(pii.extract(odd))
    assert len(out) == len(odd_rows()) and pii.extract(none).count() == 0
    rows = [(1, "mail a.b@c.de, ip 10.0.0.1!", "s"), (2, None, "s"), (3, "none", "s")]
    masked = {r["doc_id"]: r for r in rows_of(pii.redact(frame(spark, rows)))}
    assert masked[1]["text"] == "mail <email>, ip <ip>!" and masked[1]["n_chars"] == len(masked[1]["text"])
    assert masked[2]["text"] is None and masked[3]["text"] == "none" and masked[3]["kept"] == "x"


# 4 packing


def test_hilbert_curve_visits_every_cell_by_single_steps():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.stack([g.ravel() for g in np.meshgrid(*[np.arange(1 << bits)] * dims)], axis=1)
        key = packing.hilbert_key(cells, bits)
        path = cells[np.argsort(key)]
        assert sorted(key) == list(range(len(cells))) and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def check_pieces(pieces, texts):
    """texts: (doc_id, text) with unique ids."""
    want = {i: np.array([*tokens.ids(t), 0], "<u4") for i, t in texts}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
        ids = want[p["doc_id"]]
        assert p["doc_tokens"] == len(ids) and zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"]
    assert by_doc.keys() == want.keys()
    for i, ps in by_doc.items():
        assert sum(p["length"] for p in ps) == len(want[i]) and len({p["start"] for p in ps}) == len(ps)
    full = [sum(p["length"] for p in ps) for ps in by_sequence.values()]
    assert all(n == 1024 for n in full) or sorted(full)[1:] == [1024] * (len(full) - 1)
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]


def test_pieces(spark, odd, none):
    unique = [(i, t, s) for k, (i, t, s) in enumerate(odd_rows()) if i is not None and i not in [x[0] for x in odd_rows()[:k]]]
    check_pieces(rows_of(packing.pack(frame(spark, unique))), [(i, t) for i, t, _ in unique])
    assert packing.pack(none).count() == 0
    assert packing.pack(odd).agg(F.sum("length")).first()[0] == sum(len(tokens.ids(t)) + 1 for _, t, _ in odd_rows())


@pytest.mark.parametrize("parts", [4, 7, 200])
@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_pieces_under_any_number_of_partitions(spark, parts, adaptive):
    texts = [(i, prose(i % 50, 5 + 37 * i % 400)) for i in range(400)]
    texts[7] = (7, prose(7, 9_000))
    docs = frame(spark, [(i, t, "s") for i, t in texts]).repartition(6)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        check_pieces(rows_of(packing.pack(docs)), texts)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_running_sums_begin_anew_with_each_range():
    rng = np.random.default_rng(1)
    part, n = np.repeat([2, 3, 7, 8], [5, 1, 0, 9]), rng.integers(1, 50, 15)
    want = np.concatenate([np.cumsum(n[part == p]) - n[part == p] for p in (2, 3, 8)])
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(15)), pa.array(part.astype("int32")), pa.array(n)], ["rid", "part", "n"])
    for cuts in ([0, 15], [0, 3, 3, 5, 6, 9, 15], list(range(16))):
        out = packing._running(batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False))
        assert np.concatenate([b.column("start").to_numpy() for b in out]).tolist() == want.tolist()


def test_sequences_follow_the_curve(spark):
    docs = shared.pick(frame(spark, [(i, prose(i % 40, 20 + i % 7), "s") for i in range(300)]), doc_id="bigint", text="string")
    docs = shared.settle(packing.encoded(docs).withColumn("rid", F.monotonically_increasing_id()), "t")
    keyed = packing.with_key(docs)
    both = sorted(rows_of(packing.places(keyed).join(keyed, "rid")), key=lambda x: x["place"])
    assert [(x["key"], x["rid"]) for x in both] == sorted((x["key"], x["rid"]) for x in both)
    at = 0
    for x in both:
        assert x["place"] == at
        at += x["n"]


# 5 decontamination


def brute_hits(ws, windows):
    hit, items = set(), set()
    for w, item in windows:
        for i in range(len(ws) - len(w) + 1):
            if ws[i : i + len(w)] == w:
                hit.update(range(i, i + len(w)))
                items.add(item)
    return hit, items


def test_fm_index_against_brute_force(spark):
    r = random.Random(5)
    say = lambda n: " ".join(r.choice("abc") for _ in range(n))
    items = [(1, say(12)), (2, say(10)), (3, "a b a"), (3, "a b a"), (4, "q"), (5, ""), (6, None), (None, "c c c c c c"), (7, "B-b,b " + say(9))]
    docs = [(i, say(r.randint(0, 400)), "s") for i in range(30)] + [(31, None, "s"), (32, "", "s"), (33, "q", "s"), (34, "x q y Q.q", "s")]
    windows = []
    for i, t in items:
        ws = ALNUM.findall((t or "").translate(LOWER))
        name = "" if i is None else str(i)
        windows += [(ws[k : k + 10], name) for k in range(len(ws) - 9)] if len(ws) >= 10 else [(ws, name)] * bool(ws)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for block_bytes in (1 << 20, 400):
        out = {x["doc_id"]: x for x in rows_of(decontaminate.scan(frame(spark, docs), bench, ["doc_id"], block_bytes=block_bytes))}
        for i, t, _ in docs:
            ws = ALNUM.findall((t or "").translate(LOWER))
            hit, names = brute_hits(ws, windows)
            got = {k for s in out[i]["spans"] for k in range(s["first"], s["last"] + 1)}
            assert (out[i]["n_words"], got, set(out[i]["items"])) == (len(ws), hit, names)


def test_shards_meet_without_loss(monkeypatch):
    r = random.Random(6)
    say = lambda n: " ".join(r.choice("abcd") for _ in range(n))
    windows = decontaminate.Windows([(w, [w]) for w in {say(4) for _ in range(30)} | {"a", "b c"}])
    import pyarrow as pa

    a, n = windows.numbered(pa.array([say(57), None, "x " + say(90), "", "a b b q"]))
    assert n.tolist() == [57, 0, 91, 0, 4]
    found = []
    for size in (1 << 18, 7, 16):
        monkeypatch.setattr(decontaminate, "SHARD", size)
        found.append({(int(w), int(p)) for w, p in zip(*windows.find(a), strict=True)})
    brute = {(k, p) for k, (pattern, m) in enumerate(zip(windows.patterns, windows.lengths, strict=True)) for p in range(len(a) - m + 1) if (a[p : p + m] == pattern[-m:]).all()}
    assert found == [brute] * 3 and brute


def test_index_locates_every_occurrence():
    r = np.random.default_rng(1)
    s = np.append(r.integers(1, 5, 3000), 0)
    ix = decontaminate.FMIndex(s, 5)
    patterns = np.array([s[i : i + 4] for i in range(0, 2000, 7)])
    which, lo, hi = ix.search(patterns, np.full(len(patterns), 4))
    k, at = ix.locate(lo, hi)
    assert len(which) == len(patterns)
    for p in range(0, len(patterns), 25):
        want = [i for i in range(len(s) - 3) if (s[i : i + 4] == patterns[p]).all()]
        assert sorted(at[which[k] == p]) == want


def test_spans_are_cut_and_nothing_else(spark, odd, none):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa"
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    docs = frame(spark, [(1, f"Before. {item.upper()}! After.", "s"), (2, "clean  text\n", "s"), (3, None, "s"), (4, "Alpha beta gamma " + item + " delta epsilon zeta eta theta iota kappa end", "s")])
    out = {r["doc_id"]: r for r in rows_of(decontaminate.remove_spans(docs, bench))}
    assert out[1]["text"] == "Before.  ! After." and out[1]["n_chars"] == len(out[1]["text"])
    assert out[2]["text"] == "clean  text\n" and out[3]["text"] is None and out[4]["text"].strip() == "end"
    assert decontaminate.remove_spans(none, bench).count() == 0
    assert decontaminate.remove_spans(odd, bench.limit(0)).count() == len(odd_rows())


def test_windows_that_arise_by_cutting_are_cut(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(10)) for x in "abc")
    items = [(1, a), (2, b), (3, c), (4, "uno dos")]
    within = lambda inner, outer: " ".join([*outer.split()[:5], inner, *outer.split()[5:]])
    texts = [f"x {within(a, b)} y", f"x {within(within(a, b), c)} y", f"x uno {a} dos y", f"x {a} y", "x uno y dos"]
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    out = {r["doc_id"]: r["text"].split() for r in rows_of(decontaminate.remove_spans(docs, bench))}
    assert out == {0: ["x", "y"], 1: ["x", "y"], 2: ["x", "y"], 3: ["x", "y"], 4: ["x", "uno", "y", "dos"]}


# 6 line frequency


def brute_quality(rows, limit):
    norm = lambda x: re.sub("[0-9]+", "0", re.sub(r"[\x20\x09-\x0D]+", " ", x.lower())).strip(" ")
    lines = [[x for x in (t or "").split("\n") if SPACED.search(x)] for _, t, _ in rows]
    seen = {}
    for k, ((i, _, s), ls) in enumerate(zip(rows, lines, strict=True)):
        for x in ls:
            seen.setdefault((s or "", norm(x)), set()).add(k if i is None else (i,))
    out = []
    for (i, t, s), ls in zip(rows, lines, strict=True):
        ws = SPACED.findall(t or "")
        grams = [tuple(ws[k : k + 3]) for k in range(len(ws) - 2)]
        n = Counter(grams)
        rep = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(3)}
        gone = sum(len(x) for x in ls if len(seen[s or "", norm(x)]) > limit)
        failed = len(ws) < 50 or 100 * len(rep) > 50 * len(ws)
        kept = not failed and 2 * gone <= sum(map(len, ls))
        out.append((i, len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t or "")), len(ls) - len(set(ls)), len(rep), failed, kept))
    return Counter(out)


@pytest.mark.parametrize("most", [100_000, 1])
def test_line_rules(spark, none, monkeypatch, most):
    monkeypatch.setattr(shared, "HEAVY", 7)
    monkeypatch.setattr(shared, "MOST_HEAVY", most)
    same = "the SAME  line 17 with many words in it so that it weighs a lot in every text that has it at all"
    rows = odd_rows() + [(100 + i, prose(500 + i, 60) + f"\n{same.replace('17', str(i))}" * 5, "h") for i in range(6)] + [(200, "w #1 & x\n" * 40, "h")]
    rows += [(300 + i, prose(77, 60), "copies") for i in range(5)] + [(400, prose(78, 60), "rows")] * 5 + [(None, prose(79, 60), "none")] * 5
    out = line_quality.score(frame(spark, rows), max_docs=3)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert Counter(tuple(r[k] for k in names) for r in rows_of(out)) == brute_quality(rows, 3)
    assert not any(r["kept"] for r in rows_of(out) if r["doc_id"] in [*range(100, 106), *range(300, 305)])
    assert all(r["kept"] for r in rows_of(out) if r["doc_id"] == 400)
    assert line_quality.score(none).count() == 0


def test_line_rules_run_in_the_jvm(spark, odd):
    plan = line_quality.score(odd)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# 7 licences


def test_licenses(spark, odd, none):
    mit = next(t for label, t, _ in license_scan.TEMPLATES if label == "mit" and t.endswith("Software without restriction"))
    rows = [(1, f"x y {mit} z", "s"), (2, "Under the MIT-License and the mit license. Apache\nlicense", "s"), (3, "permission is granted to copy", "s"), (4, None, "s"), (5, mit.replace("free of charge", "for a fee"), "s"), (6, "Licensed under CC BY-NC 4.0.", "s")]
    out = {r["doc_id"]: r for r in rows_of(license_scan.scan(frame(spark, rows)))}
    assert (out[1]["labels"], out[1]["base_labels"], out[1]["n_base"]) == ("mit", "", 0) and out[1]["score"] > 0.99
    assert (out[2]["base_labels"], out[2]["n_base"], out[2]["first_word"], out[2]["last_word"]) == ("apache,mit", 3, 2, 8)
    assert [out[k]["labels"] for k in (3, 4, 5, 6)] == ["", "", "", "cc-by-nc"] and out[4]["score"] == 0
    assert license_scan.scan(odd).count() == len(odd_rows()) and license_scan.scan(none).count() == 0


def test_every_licence_of_a_file_is_found(spark):
    text = {}
    for label, t, _ in license_scan.TEMPLATES:
        text.setdefault(label, t)
    text["apache"] = license_scan.TEMPLATES[1][1]
    five = ["apache", "bsd", "isc", "mpl", "unlicense"]
    files = [" and then ".join(text[k] for k in five), "\n\n".join(text.values())]
    notice = text["isc"]
    files.append(notice.replace("without fee", "without cost") + " as well as " + notice.replace("copyright", "usual").replace("use", "run"))
    files += [notice.replace("without fee", "without cost"), text["gpl"] + " filler" * 20_000 + " " + text["bsd"]]
    out = {r["doc_id"]: r for r in rows_of(license_scan.scan(frame(spark, [(i, t, "s") for i, t in enumerate(files)])))}
    assert out[0]["labels"] == ",".join(five) and out[1]["labels"] == ",".join(sorted(text))
    assert [out[k]["labels"] for k in (2, 3, 4)] == ["isc", "", "bsd,gpl"]


def brute_labels(ix, ws):
    """Every template laid at every offset; the best score of places that earn a label."""
    labels, best = set(), 0.0
    for (label, template, phrases), total in zip(ix.templates, ix.total, strict=True):
        for offset in range(1 - len(template), len(ws)):
            agreed = sum(ix.weights[t] for i, t in enumerate(template) if 0 <= offset + i < len(ws) and ws[offset + i] == t) / total
            around = b" ".join([b"", *ws[max(offset - 2, 0) : offset + len(template) + 2], b""])
            if agreed >= license_scan.MIN_AGREED and all(b" " + b" ".join(p) + b" " in around for p in phrases):
                labels.add(label)
                best = max(best, agreed)
    return labels, best


def test_licences_against_brute_force():
    r = random.Random(9)
    vocabulary = sorted(license_scan._vocabulary(license_scan.TEMPLATES))
    ix = license_scan.Index(license_scan.TEMPLATES, {w: r.expovariate(1) + 1e-3 for w in vocabulary})
    seen = Counter()
    for k in range(150):
        ws = []
        for _ in range(r.randint(1, 4)):
            _, t, _ = r.choice(license_scan.TEMPLATES)
            part = [w if r.random() < 0.93 else b"changed" for w in shared.alnum_words(t)]
            ws += [r.choice(vocabulary) for _ in range(r.randint(0, 9))] + part[: len(part) if k % 3 else r.randint(1, len(part))]
        labels, best = brute_labels(ix, ws)
        found = ix.matches(ws)
        assert {label for label, _ in found if label} == labels
        assert max([a for label, a in found if label], default=0.0) == pytest.approx(best)
        seen.update(labels)
    assert len(seen) >= 8


def test_whole_licences_are_cut_into_templates(spark):
    shared_part = "this paragraph of thirteen words or more stands in both of these licences"
    text = lambda who: "\n\n".join([f"The {who} Licence", prose(len(who), 60).replace("\n", " "), shared_part, f"you may {who} do this {prose(len(who) + 7, 40)}".replace("\n", " "), f"{who} ends"])
    texts = [("one", text("one")), ("three", text("three")), ("one", text("one"))]
    made = license_scan.of_texts(texts)
    assert Counter(label for label, _, _ in made) == {"one": 2, "three": 2} and not any("thirteen" in t for _, t, _ in made)
    assert all(f" {k} " in f" {t} " and len(k.split()) == license_scan.KEY for _, t, (k,) in made)
    files = [text("one"), f"{prose(50, 300)}\n{text('three').upper()}\n{prose(51, 300)}", text("one") + text("three"), shared_part * 3, prose(52, 400), text("one").split("\n\n")[1]]
    out = {r["doc_id"]: r["labels"] for r in rows_of(license_scan.scan(frame(spark, [(i, t, "s") for i, t in enumerate(files)]), license_scan.TEMPLATES + made))}
    assert out == {0: "one", 1: "three", 2: "one,three", 3: "", 4: "", 5: "one"}
    assert license_scan.of_texts([]) == [] and license_scan.of_texts([("x", ""), ("y", "short")]) == []


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence texts on this machine")
def test_bodies_of_known_licences(spark):
    texts = {}
    for label, name in (("apache", "Apache-2.0"), ("gpl", "GPL-3"), ("gpl", "GPL-2"), ("lgpl", "LGPL-3"), ("lgpl", "LGPL-2.1"), ("mpl", "MPL-2.0"), ("gfdl", "GFDL-1.3")):
        with open(f"/usr/share/common-licenses/{name}", encoding="utf-8") as f:
            texts[name] = (label, f.read())
    made = license_scan.of_texts(list(texts.values()))
    names = sorted(texts)
    halves = [(i, prose(i, 200) + texts[n][1][len(texts[n][1]) // 3 :], "s") for i, n in enumerate(names)]
    out = {r["doc_id"]: r["labels"].split(",") for r in rows_of(license_scan.scan(frame(spark, [*halves, (99, prose(3, 500), "s")]), made))}
    assert all(texts[n][0] in out[i] for i, n in enumerate(names)) and out[99] == [""]


def test_no_licence_place_lacks_votes():
    r = random.Random(5)
    vocabulary = sorted(license_scan._vocabulary(license_scan.TEMPLATES))
    for weights in ({w: 1.0 for w in vocabulary}, {w: r.expovariate(1) + 1e-3 for w in vocabulary}):
        ix = license_scan.Index(license_scan.TEMPLATES, weights)
        for k, (label, ws, phrases) in enumerate(ix.templates):
            for _ in range(30):
                changed = [w if r.random() < 0.7 or any(w in p for p in phrases) else b"x" for w in ws]
                if sum(weights[a] for a, b in zip(ws, changed, strict=True) if a == b) >= license_scan.MIN_AGREED * ix.total[k]:
                    assert label in [found for found, _ in ix.matches([b"y"] * 3 + changed)], (k, changed)


# 8 archive


@pytest.mark.parametrize("most", [100_000, 1])
def test_archive_round_trip(spark, monkeypatch, most):
    monkeypatch.setattr(shared, "HEAVY", 2)
    monkeypatch.setattr(shared, "MOST_HEAVY", most)
    big, small = "<html>" + "é" * 200, "tiny"
    rows = [(5, "u5", big), (3, "u3", big), (3, "u3", big), (9, None, small), (10, "a\r\nX: y", small), (11, "u", None), (None, "n", big), (12, "u", "p" * 100), (13, "u", "p\r\n\r\n" + "p" * 100_000)]
    rows += [(13, "u", "p" * 100)] + [(20 + i, f"u{i}", "") for i in range(9)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, digest string")
    root = shared.new_path(spark, "t")
    warc_store.write_archive(pages, root)
    assert spark.read.parquet(f"{root}/payloads").count() == 5
    back = warc_store.read_archive(spark, root)
    assert Counter((r["page_id"], bytes(r["payload"])) for r in rows_of(back)) == Counter((i, (h or "").encode()) for i, _, h in rows)
    for r in rows_of(back):
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        n = int(fields[b"Content-Length"])
        assert rest[n:] == b"\r\n\r\n" and (fields[b"WARC-Type"] == b"revisit" or rest[:n] == bytes(r["payload"]))
        assert fields[b"WARC-Payload-Digest"].decode() == "sha256:" + hashlib.sha256(bytes(r["payload"])).hexdigest()
    got = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in rows_of(warc_store.parse(back)))
    assert got == Counter([(3, "response", None)] * 2 + [(5, "revisit", 3), (None, "revisit", 3), (9, "response", None), (10, "response", None), (11, "response", None), (12, "response", None), (13, "revisit", 12), (13, "response", None)] + [(20 + i, "response", None) for i in range(9)])


def test_archive_of_nothing(spark):
    root = shared.new_path(spark, "t")
    warc_store.write_archive(spark.createDataFrame([], "page_id bigint, url string, html string"), root)
    assert warc_store.read_archive(spark, root).count() == 0


# 9 near-duplicates


def brute_components(rows, words=3, limit=85):
    sets = []
    for _, t, _ in rows:
        ws = SPACED.findall((t or "").translate(LOWER))
        sets.append({tuple(ws[i : i + words]) for i in range(len(ws) - words + 1)} if len(ws) >= words else {tuple(ws)} - {()})
    label = list(range(len(rows)))
    find = lambda x: x if label[x] == x else find(label[x])
    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= limit * len(sets[a] | sets[b]):
                label[find(a)] = find(b)
    lowest = {}
    for x, (i, _, _) in enumerate(rows):
        if i is not None:
            lowest[find(x)] = min(i, lowest.get(find(x), i))
    return Counter((i, len(sets[x]), lowest.get(find(x), i)) for x, (i, _, _) in enumerate(rows))


def edited(text, k, seed):
    r, ws = random.Random(seed), text.split()
    for at in r.sample(range(len(ws)), k):
        ws[at] = f"w{seed}x{at}"
    return " ".join(ws)


def group_rows():
    base, other = prose(7, 150), prose(8, 150)
    rows = [(1000 + i, edited(base, i % 8, i), "a") for i in range(40)] + [(2000 + i, edited(other, 2, i), "a") for i in range(15)]
    chain = other
    for i in range(12):
        chain = edited(chain, 2, 900 + i)
        rows.append((1500 - i, chain, "b"))
    return odd_rows()[:9] + odd_rows()[10:] + rows


@pytest.mark.parametrize(("rule", "words", "limit"), [(near_dup.CONTRACT, 3, 85), (near_dup.USUAL, 5, 80)])
def test_components_against_brute_force(spark, none, rule, words, limit):
    rows = group_rows()
    out = rows_of(near_dup.find(frame(spark, rows), rule))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == brute_components(rows, words, limit)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)
    assert near_dup.find(none).count() == 0


def test_small_blocks_find_the_same_pairs(spark):
    rows = group_rows()
    docs = shared.pick(frame(spark, rows), doc_id="bigint", text="string").withColumn("fp", F.xxhash64("text"))
    classes = shared.settle(near_dup.sketched(docs, near_dup.CONTRACT).where("n > 0").dropDuplicates(["digest"]).withColumn("c", F.xxhash64("digest")), "t")
    labels = classes.select("c", F.col("c").alias("label"))
    buckets = shared.settle(near_dup.shared_bands(classes), "t")
    whole, dealt = ({(r.a, r.b) for r in near_dup.cross_pairs(classes, near_dup.dealt_blocks(buckets, labels, n), near_dup.CONTRACT).collect()} for n in (1024, 5))
    assert whole and whole == dealt


def test_one_large_component_and_a_stranger_meet_once(spark):
    n = 5000
    buckets = shared.settle(spark.range(n + 1).select(F.col("id").alias("c"), F.lit(7).cast("bigint").alias("band"), F.lit(n + 1).cast("bigint").alias("size")), "t")
    labels = spark.range(n + 1).select(F.col("id").alias("c"), F.when(F.col("id") < n, 0).otherwise(n).cast("bigint").alias("label"))
    dealt = near_dup.dealt_blocks(buckets, labels, 100).collect()
    assert len(dealt) == n + 50 + 1 and len({r.c for r in dealt}) == n + 1
    met = {}
    for r in dealt:
        met.setdefault((r.i, r.j), set()).add(r.c)
    assert {c for cs in met.values() if n in cs for c in cs} == set(range(n + 1))


def test_unlinked_members_of_one_band_are_dealt_out_in_few_rows(spark):
    n = 5000
    buckets = shared.settle(spark.range(n).select(F.col("id").alias("c"), F.lit(7).cast("bigint").alias("band"), F.lit(n).cast("bigint").alias("size")), "t")
    dealt = near_dup.dealt_blocks(buckets, spark.range(n).select(F.col("id").alias("c"), F.col("id").alias("label")))
    assert dealt.count() <= 3 * n and dealt.select("c").distinct().count() == n


@pytest.mark.parametrize(("members", "most_bytes"), [(7, 1 << 20), (1000, 4000), (1000, 1 << 30)])
def test_smaller_blocks_hold_every_pair_once(spark, members, most_bytes):
    rows = [(9, i, j, b, 100 * b + k, 0, 50 * (k % 3)) for i, j in ((0, 0), (0, 1), (1, 1)) for b in {i, j} for k in range(30)]
    rest = spark.createDataFrame(rows, "band bigint, i int, j int, block int, c bigint, label bigint, n bigint")
    met, sizes = Counter(), Counter()
    groups = {}
    for r in near_dup.redealt(rest, members, most_bytes).collect():
        groups.setdefault((tuple(r.of), r.i, r.j), []).append(r)
        sizes[tuple(r.of), r.i, r.j, r.block] += 1
    for (of, i, j), rs in groups.items():
        left, right = ([r.c for r in rs if r.block == x] for x in (i, j))
        met.update((of, frozenset((a, b))) for a in left for b in right if a < b or (i != j and a != b))
    want = {((9, i, j), frozenset((a, b))) for i, j in ((0, 0), (0, 1), (1, 1)) for a in range(100 * i, 100 * i + 30) for b in range(100 * j, 100 * j + 30) if a != b}
    assert met == Counter(dict.fromkeys(want, 1)) and max(sizes.values()) <= 30


def test_components_where_every_key_is_heavy_and_without_the_screen(spark, monkeypatch):
    monkeypatch.setattr(shared, "HEAVY", 3)
    monkeypatch.setattr(shared, "MOST_HEAVY", 5)
    rows = group_rows()
    rule = near_dup.Rule(words=3, num=85, bands=32, rows=6, margin=1.0)
    out = rows_of(near_dup.find(frame(spark, rows), rule))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == brute_components(rows, 3, 85)


def test_no_link_is_lost_where_pairs_are_left_out(spark, monkeypatch):
    """Without any star, and with a single pair of each block pair confirmed, the rest is found on full sets, in blocks of few bytes."""
    whole = near_dup.redealt
    monkeypatch.setattr(near_dup, "redealt", lambda rest: whole(rest, 10, 8000))
    monkeypatch.setattr(near_dup, "star_pairs", lambda classes, *_: classes.select(F.col("c").alias("a"), F.col("c").alias("b")).limit(0))
    rows = group_rows()
    out = rows_of(near_dup.find(frame(spark, rows), near_dup.Rule(words=3, num=85, bands=32, rows=6, nearest=1, most_pairs=1)))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == brute_components(rows, 3, 85)


def test_chains_become_stars(spark):
    links = [(i, i + 1) for i in range(0, 20)] + [(30, 35), (35, 31), (40, 41), (42, 40)] + [(50, k) for k in range(51, 90)]
    got = {r.c: r.label for r in near_dup.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(21)} | {30: 30, 35: 30, 31: 30, 40: 40, 41: 40, 42: 40} | {k: 50 for k in range(50, 90)}


def test_one_row_of_near_duplicates_without_ids_is_kept(spark):
    a = prose(71, 120)
    rows = [(None, edited(a, k % 2, k), "s") for k in range(4)] + [(None, a, "s"), (None, "", "s"), (None, "", "s")]
    out = rows_of(near_dup.find(frame(spark, rows)))
    assert sum(r["kept"] for r in out if r["n_shingles"]) == 1 and all(r["kept"] for r in out if not r["n_shingles"])
    assert {r["component_id"] for r in out} == {None}


def test_one_of_each_group_stays(spark, odd, none):
    rows = group_rows() + [(8, odd_rows()[8][1], "b")]
    left = rows_of(near_dup.one_of_each(frame(spark, rows)))
    want = {i for i, _, c in brute_components(rows, 5, 80) if i == c and i is not None}
    assert sorted(r["doc_id"] for r in left if r["doc_id"] is not None) == sorted(want)
    assert near_dup.one_of_each(none).count() == 0 and near_dup.one_of_each(odd).columns == odd.columns


def test_one_row_of_a_group_without_own_ids_stays(spark, none):
    a, b, c = (prose(seed, 120) for seed in (71, 72, 73))
    rows = [(None, a, "s"), (None, edited(a, 1, 1), "s"), (None, edited(a, 1, 2), "s"), (5, b, "s"), (5, edited(b, 1, 3), "s"), (9, b, "s"), (None, edited(b, 1, 4), "s"), (None, c, "s"), (3, edited(c, 1, 5), "s")]
    rows += [(None, "", "s"), (None, "", "s"), (7, " ", "s"), (8, "", "s")]
    left = rows_of(near_dup.one_of_each(frame(spark, rows)))
    assert Counter(r["doc_id"] for r in left) == {None: 2, 5: 1, 3: 1, 7: 1, 8: 1}
    assert sum(r["text"] == "" and r["doc_id"] is None for r in left) == 1


def test_estimates_are_close():
    r = np.random.default_rng(0)
    for n in (10, 100, 1000, 10_000):
        for j in (0.7, 0.85, 0.95):
            same = round(2 * n * j / (1 + j))
            a = r.integers(0, 2**64, n, dtype=np.uint64)
            b = np.concatenate([a[:same], r.integers(0, 2**64, n - same, dtype=np.uint64)])
            x, y = (near_dup.sketches([near_dup.odd_sketch(np.unique(v))]) for v in (a, b))
            e, off = near_dup.estimate(x, y)
            assert abs(e[0] - same / (2 * n - same)) <= off[0]


# 10 quality


def test_quality_held_out(spark):
    from __spark_entry__ import queries

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = queries()["op10_neighbour_vote"](spark, SF).join(labels, "doc_id").toPandas()
    test = out[out.held_out]
    assert (test.predicted == test.quality).mean() > 0.95 and out.score.between(0, 1).all()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()


def test_quality_never_sees_labels_of_the_fold(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    lied = labels.withColumn("quality", F.when(labelled.held_out("doc_id", 5, 0), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = quality_vote.learn(docs, labels), quality_vote.learn(docs, lied)
    assert (one.y == two.y).all() and np.allclose(one.vectors, two.vectors, atol=1e-4)


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(6, 1), (4, 0), (9, 1), (None, 0), (20, None)], "doc_id bigint, quality int")
    docs = shared.pick(odd, doc_id="bigint", text="string")
    out = rows_of(quality_vote.scored(docs, quality_vote.learn(odd, labels)))
    assert len(out) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in out)
    assert {r["score"] for r in rows_of(quality_vote.scored(docs, quality_vote.learn(odd, labels.limit(0))))} == {0.5}
    assert quality_vote.scored(shared.pick(none, doc_id="bigint", text="string"), quality_vote.learn(none, labels)).count() == 0


def test_quality_query_against_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_vote.learn(docs, labels)
    out = {r["doc_id"]: r["score"] for r in rows_of(quality_vote.op10_neighbour_vote(spark, SMALL))}
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    terms = quality_vote._Terms()

    def count(t):
        ws = t.encode().split()
        n = Counter(x for w in ws for x in terms[w])
        n[quality_vote.AGAIN] = sum(a == b for a, b in zip(ws, ws[1:], strict=False))
        if ws:
            n[quality_vote.VARIETY + 10 * len(set(ws)) // len(ws)] = len(ws)
        return n

    df = Counter(x for t in text.values() for x, n in count(t).items() if n)
    by = np.array([np.log((1 + len(text)) / (1 + df[x])) + 0.1 for x in range(quality_vote.TERMS)])
    assert np.allclose(by, model.by, atol=1e-5)

    def vector(t):
        x = np.zeros(quality_vote.TERMS)
        for k, n in count(t).items():
            x[k] = np.log1p(n) * by[k]
        return x / max(np.linalg.norm(x), 1e-12)

    learnt = sorted((r.doc_id, r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 and r.doc_id in text)
    x = np.stack([vector(text[i]) for i, _ in learnt])
    basis = model.basis.astype(float)
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-3)
    exact = np.linalg.svd(x, compute_uv=False)[: basis.shape[1]]
    assert np.linalg.norm(x @ basis) ** 2 >= 0.99 * (exact**2).sum()
    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    near = np.stack([unit(v) for v in x @ basis])
    y = np.array([q for _, q in learnt], float)
    for i, t in text.items():
        sim = near @ unit(vector(t) @ basis)
        top = np.argsort(-sim)[: quality_vote.NEAREST]
        weight = np.maximum(sim[top], 0) ** quality_vote.SHARPNESS
        assert out[i] == pytest.approx((weight * y[top]).sum() / weight.sum() if weight.sum() > 1e-9 else y.mean(), abs=5e-3), i


def test_shapes_are_those_of_each_token():
    r, terms = random.Random(2), quality_vote._Terms()
    for _ in range(20_000):
        token = "".join(r.choice("abZÉéß9x-Xñ.日ÖA0ā") for _ in range(r.randrange(1, 9))).encode()
        half = quality_vote.TERMS // 2
        assert terms[token][1] == half + xxhash.xxh32_intdigest(quality_vote.shape(token)) % half
    assert len(terms.shapes) < 20_000


def test_present_terms_are_those_with_a_count():
    terms = quality_vote._Terms()
    for text in [None, "", " \n", "one", "a a", "A b A c, 12 12 x9-é", prose(3, 400), prose(4, 30) + " end end"]:
        assert sorted(quality_vote.present(text, terms)) == np.flatnonzero(quality_vote.counted([text], terms)[0]).tolist()


def test_votes_are_exact():
    r = np.random.default_rng(2)
    m = quality_vote.Neighbours(np.ones(quality_vote.TERMS, np.float32), np.eye(quality_vote.TERMS, 8, dtype=np.float32), quality_vote._unit(r.random((60, 8))).astype(np.float32), r.integers(0, 2, 60).astype(float))
    x = np.zeros((5, quality_vote.TERMS), np.float32)
    x[:4, :8] = r.integers(0, 9, (4, 8))
    got = m.scores(x)
    for row, s in zip(np.log1p(x[:4, :8]), got, strict=False):
        sim = m.vectors @ (row / np.linalg.norm(row))
        near = np.argsort(-sim)[: quality_vote.NEAREST]
        assert s == pytest.approx((sim[near] ** 4 * m.y[near]).sum() / (sim[near] ** 4).sum(), abs=1e-4)
    assert got[4] == pytest.approx(m.y.mean())


@pytest.mark.parametrize("how", ["inner", "left"])
def test_few_rows_are_joined_by_one_broadcast(spark, monkeypatch, how):
    """Rounds of components on few links cost the driver one exchange a join, and give what the join in parts gives."""
    rows = spark.createDataFrame([(i % 7, i) for i in range(40)], "k int, v int")
    keyed = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("m")).where("k < 5")
    few = shared.join_counted(rows, keyed, ["k"], how=how, total=40)
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Union" not in plan
    want = sorted(map(tuple, few.collect()), key=repr)
    monkeypatch.setattr(shared, "MOST_HEAVY", 10)
    parts = shared.join_counted(rows, keyed, ["k"], how=how, total=40)
    assert "Union" in parts._jdf.queryExecution().optimizedPlan().toString() and sorted(map(tuple, parts.collect()), key=repr) == want
