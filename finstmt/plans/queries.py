"""Queries by name; each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import amounts, catalog, text, units
from ..operators import accounts, analysis, calls, compare, depreciation, details, documents, report, resolve, results, trace
from ..sources import html, landed, registry
from ..sources.settled import large, new_folder, settle
from ..streaming import snapshot
from . import adapter, oracle, oracle_analysis, oracle_docs

KEYS = ["corp", "year"]


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    return adapter._over(spark, sf, "SELECT * FROM facts")


def _items(spark: SparkSession, sf: str, facts: DataFrame | None = None) -> DataFrame:
    return accounts.extract(adapter.accounts(spark, sf, facts), catalog.items(spark))


def account_extract(spark: SparkSession, sf: str) -> DataFrame:
    return _items(spark, sf)


def _merged(spark: SparkSession, sf: str, facts: DataFrame | None = None) -> DataFrame:
    """Items of every company and year with depreciation laid over them and costs positive."""
    facts = adapter.facts(spark, sf) if facts is None else facts
    wide = results.wide(_items(spark, sf, facts), KEYS)
    d = facts.where("k < 4").selectExpr("corp", "year", "double(qty + 1) AS depr", "double(CASE WHEN k < 3 THEN -tax END) AS rou", "double(tax + 2) AS amort", "k = 1 AS combined")
    return results.positive_costs(results.overlay(wide, d, KEYS)).withColumn("ebitda", results.ebitda())


def ebitda(spark: SparkSession, sf: str) -> DataFrame:
    return _merged(spark, sf).select(*KEYS, "op_income", "depr", "rou", "amort", "ebitda")


def depreciation_merge(spark: SparkSession, sf: str) -> DataFrame:
    return _merged(spark, sf).select(*KEYS, "cogs", "depr", "rou", "amort", "remarks")


def identity_checks(spark: SparkSession, sf: str) -> DataFrame:
    out, c = results.validated(_merged(spark, sf)), lambda i: F.col("checks")[i]
    return out.select(*KEYS, c(0)["passed"].alias("balance_passed"), c(1)["passed"].alias("gross_passed"), c(2)["passed"].alias("operating_passed"), c(0)["diff"].alias("balance_diff"), c(1)["diff"].alias("gross_diff"), "is_valid", F.array_join("flags", " / ").alias("flags"))


def summary_report(spark: SparkSession, sf: str) -> DataFrame:
    return report.summary(results.validated(_merged(spark, sf)), KEYS)


def summary_states(spark: SparkSession, sf: str) -> DataFrame:
    """The summary of a run in which some companies were not found, not unique, without a report or failed."""
    facts = adapter.facts(spark, sf)
    state = F.element_at(F.array(*map(F.lit, ("ok", "no_corp", "ambiguous_corp", "no_report", "error", "ok"))), (F.col("k") + F.col("year")) % 6 + 1)
    asked = facts.select(*KEYS, state.alias("state"), F.when(state == "ok", "").otherwise(F.concat(F.lit("이유: "), state)).alias("message"))
    done = results.validated(_merged(spark, sf, facts)).join(asked.where("state = 'ok'").select(*KEYS), KEYS, "left_semi")
    return report.summary(asked.join(done, KEYS, "left"), KEYS)


def run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return report.metrics(results.validated(_merged(spark, sf)))


def company_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """A column for each year that the data have."""
    years = [r.year for r in adapter.table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("year")).distinct().collect()]
    return report.pivot_years(account_extract(spark, sf), sorted(years))


def fs_div_infer(spark: SparkSession, sf: str) -> DataFrame:
    return accounts.infer_division(adapter.accounts(spark, sf))


def ai_text_bundle(spark: SparkSession, sf: str) -> DataFrame:
    return accounts.text_bundle(adapter.accounts(spark, sf))


def _opinion(facts: DataFrame, items: DataFrame) -> DataFrame:
    n, v = F.length("item") % 3, F.col("value")
    said = items.where("item <> 'gross'").select(*KEYS, "item", F.when(n == 0, v + 0.5).when((n == 1) & (F.col("year") % 2 == 0), v * 1.01).otherwise(v).alias("value"))
    return said.union(facts.where("k = 0").select(*KEYS, F.lit("rou"), F.lit(7.0)))


def _compared(spark: SparkSession, sf: str, facts: DataFrame | None = None) -> DataFrame:
    facts = adapter.facts(spark, sf) if facts is None else facts
    items = _items(spark, sf, facts)
    return compare.compare(items, _opinion(facts, items), KEYS)


def _adjudicated(spark: SparkSession, sf: str, facts: DataFrame | None = None) -> DataFrame:
    both = _compared(spark, sf, facts)
    answer = F.when(F.col("item") == "revenue", "unclear").when(F.col("item") == "gross", None).otherwise((F.col("theirs") * 2).cast("string"))
    verdict = both.where("disagree").select(*KEYS, "item", answer.alias("answer"))
    return compare.adjudicate(both, verdict, KEYS)


def ai_compare(spark: SparkSession, sf: str) -> DataFrame:
    return _adjudicated(spark, sf)


def ai_outcome(spark: SparkSession, sf: str) -> DataFrame:
    facts = adapter.facts(spark, sf)
    asked = facts.select(*KEYS, (F.col("k") != 3).alias("first_ok"), (F.col("k") != 2).alias("second_ok"))
    return compare.outcome(_compared(spark, sf, facts), asked, KEYS)


def golden_diff(spark: SparkSession, sf: str) -> DataFrame:
    facts = adapter.facts(spark, sf)
    items = _items(spark, sf, facts)
    return compare.golden_diff(items, _opinion(facts, items), [*KEYS, "item"])


def amount_parse(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity").cast("bigint")
    n = F.col("l_linenumber") % 7
    x = F.when(n == 0, F.concat(F.lit("("), F.format_number(q * 12345, 0), F.lit(")"))).when(n == 1, F.concat(F.lit(" "), F.format_number(q * 1234, 0), F.lit(" "))).when(n == 2, "-").when(n == 3, "").when(n == 4, "N/A").when(n == 5, F.concat(F.lit("1 "), q.cast("string"))).otherwise("—")
    s = adapter.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x"))
    return s.select("l_orderkey", "l_linenumber", amounts.account_amount(F.col("x")).alias("account"), amounts.cell_amount(F.col("x")).alias("cell"), amounts.note_amount(F.col("x")).alias("note"))


def label_normalize(spark: SparkSession, sf: str) -> DataFrame:
    n, size = F.col("p_partkey") % 8, F.col("p_size").cast("string")
    x = F.when(n == 0, F.concat(F.lit("III. 영 업 이 익<주석"), size, F.lit(">"))).when(n == 1, F.concat(F.lit("(2)"), "p_name", F.lit("(주"), size, F.lit(",31)"))).when(n == 2, F.concat(F.lit("가. "), "p_brand")).when(n == 3, "Ⅳ.　자\t산 총계.").when(n == 4, F.concat(size, F.lit(". "), "p_name")).when(n == 5, "  ").when(n == 6, "매출원가(주석15, 16 ,21)").otherwise(F.concat("p_type", F.lit("..")))
    s = adapter.table(spark, sf, "part").select("p_partkey", x.alias("x"))
    return s.select("p_partkey", text.label(F.col("x")).alias("label"), text.title_core(F.col("x")).alias("core"))


def row_label_normalize(spark: SparkSession, sf: str) -> DataFrame:
    n, size = F.col("p_partkey") % 8, F.col("p_size").cast("string")
    x = F.when(n == 0, "1.가.감가상각비").when(n == 1, F.concat(F.lit("("), size, F.lit(") 무형자산 상각비"))).when(n == 2, F.concat(F.lit("나) "), "p_name")).when(n == 3, "①감가상각비").when(n == 4, size).when(n == 5, "( 가 ) 사용권자산상각비").when(n == 6, "").otherwise(F.concat(F.lit("1)2)3)"), "p_brand"))
    s = adapter.table(spark, sf, "part").select("p_partkey", x.alias("x"))
    return s.select("p_partkey", text.row_label(F.col("x")).alias("label"))


def text_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Short amounts, parts of file names, lines of an input field, and whether two numbers are the same."""
    n, size = F.col("p_partkey") % 6, F.col("p_size").cast("double")
    price = F.col("p_retailprice").cast("double")
    amount = F.when(n == 0, None).when(n == 1, F.round(price) * 1e6).when(n == 2, -F.round(price) * 1e6).when(n == 3, F.round(price)).otherwise(size)
    near = F.when(n == 4, size * (1 + 1e-13)).when(n == 5, size + 0.01).otherwise(amount)
    name = F.concat(F.lit("._"), "p_name", F.lit(' /: *?"<>|'), "p_brand", F.lit("\t.."))
    field = F.concat(F.lit(" "), "p_name", F.lit("\r\n\n  "), "p_brand", F.lit("　\r"), F.col("p_size").cast("string"), F.lit("\n "))
    s = adapter.table(spark, sf, "part").select("p_partkey", amount.alias("a"), near.alias("b"), F.when(n == 0, "..").otherwise(name).alias("name"), field.alias("field"))
    return s.select("p_partkey", amounts.short(F.col("a")).alias("short"), amounts.same(F.col("a"), F.col("b")).alias("same"), text.filename_part(F.col("name")).alias("file_part"), F.array_join(text.name_lines(F.col("field")), "|").alias("lines"))


def division_choice(spark: SparkSession, sf: str) -> DataFrame:
    """Of the answers to each customer and year's requests, the later of a division, and the consolidated one before the other."""
    o = adapter.table(spark, sf, "orders")
    answer = o.select(F.col("o_custkey").alias("corp"), F.year("o_orderdate").alias("year"), F.col("o_orderkey").alias("request_no"), F.when(F.col("o_orderkey") % 3 == 0, "CFS").otherwise("OFS").alias("fs_div"), F.col("o_orderpriority").alias("answer"))
    return accounts.choose_division(answer)


def candidate_info(spark: SparkSession, sf: str) -> DataFrame:
    """Namesakes with their company details, where there are any, and the code that the name alone gives."""
    c = adapter.table(spark, sf, "customer")
    reg = c.select(F.concat(F.lit("N"), F.col("c_nationkey") % 7, F.lit("-"), F.col("c_custkey") % 50).alias("corp_name"), F.concat(F.lit("C"), "c_custkey").alias("corp_code"), F.col("c_custkey").alias("pos"))
    info = c.where("c_custkey % 3 = 0").select(F.concat(F.lit("C"), "c_custkey").alias("corp_code"), F.col("c_mktsegment").alias("induty_code"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("ceo_nm"))
    told = resolve.with_company_info(reg, info)
    code = resolve.first_code(reg.select(F.col("corp_name").alias("name")).distinct(), reg).withColumnsRenamed({"name": "corp_name", "corp_code": "first_code"})
    return told.join(code, "corp_name").select("corp_name", "corp_code", "induty_code", "ceo_nm", "first_code")


def landed_accounts(spark: SparkSession, sf: str) -> DataFrame:
    """account_extract of responses that were landed as JSON; those of one variant failed and have no rows."""
    root = new_folder(spark, "landed-accounts")
    facts = adapter.facts(spark, sf)
    rows = adapter.accounts(spark, sf, facts).groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("pos", "account_id", "account_nm", "sj_div", "fs_div", "thstrm_amount", "currency"))).alias("list"))
    status = F.when(F.col("k") == 2, "013").otherwise("000")
    rows.join(facts.select(*KEYS, status.alias("status")), KEYS).select("status", *KEYS, "list").write.json(root)
    return accounts.extract(landed.account_rows(spark, root, lines=True), catalog.items(spark))


def landed_registry(spark: SparkSession, sf: str) -> DataFrame:
    """A registry landed as XML, with details of some companies landed as JSON."""
    root = new_folder(spark, "landed-registry")
    s = adapter.table(spark, sf, "supplier")
    code = F.lpad(F.col("s_suppkey").cast("string"), 8, "0")
    row = s.select(code.alias("corp_code"), F.concat(F.lit(" "), "s_name", F.lit(" & <x> ")).alias("corp_name"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey").cast("string")).alias("stock_code"), F.lit("20240101").alias("modify_date"))
    row.write.format("xml").option("rowTag", "list").option("rootTag", "result").save(f"{root}/registry")
    status = F.when(F.col("s_suppkey") % 5 == 0, "013").otherwise("000")
    s.where("s_suppkey % 3 = 0").select(status.alias("status"), code.alias("corp_code"), F.lit("Y").alias("corp_cls"), F.col("s_name").alias("ceo_nm")).write.json(f"{root}/info")
    found = landed.registry(spark, f"{root}/registry").select("corp_code", "corp_name", "stock_code", "modify_date")
    return resolve.with_company_info(found, landed.company_info(spark, f"{root}/info").select("corp_code", "corp_cls", "ceo_nm"))


def landed_filings(spark: SparkSession, sf: str) -> DataFrame:
    """Filings landed as JSON lists, and of each customer's the newest by place in its list."""
    root = new_folder(spark, "landed-filings")
    o = adapter.table(spark, sf, "orders")
    listed = F.sort_array(F.collect_list(F.struct((-F.col("o_orderkey")).alias("n"), F.concat(F.lit("R"), "o_orderkey").alias("rcept_no"), F.col("o_orderstatus").alias("report_nm"), F.date_format("o_orderdate", "yyyyMMdd").alias("rcept_dt"))))
    o.groupBy(F.concat(F.lit("C"), "o_custkey").alias("corp"), F.col("o_orderpriority").alias("kind")).agg(listed.alias("list")).select(F.lit("000").alias("status"), "corp", "kind", "list").write.json(root)
    return landed.filings(spark, root, lines=True).where("pos < 2").select("corp", "kind", "pos", "rcept_no", "report_nm", "rcept_dt")


def unit_detect(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id") % 8
    x = F.when(n == 0, "(단위: 백만원)").when(n == 1, "금액 단위 ： [천 원]").when(n == 2, "단위는 미화 기준 억원").when(n == 3, "(단위:krw)").when(n == 4, "단위 원").when(n == 5, F.col("text")).when(n == 6, "단위: 달러").otherwise("백만원")
    x = F.when(n == 5, x).otherwise(F.concat(x, F.lit(" "), F.coalesce("text", F.lit(""))))
    return adapter.table(spark, sf, "documents").select("doc_id", units.in_text(x).cast("bigint").alias("unit"))


def registry_search(spark: SparkSession, sf: str) -> DataFrame:
    s = adapter.table(spark, sf, "supplier")
    some = spark.createDataFrame([("nobody",), ("S",), ("",), ("#00",), ("upplier#000",)], "name string")
    names = s.select(F.col("s_name").alias("name")).union(s.select(F.left("s_name", F.lit(17)))).union(s.select(F.right("s_name", F.lit(3)))).union(some).distinct()
    key = F.col("s_suppkey")
    reg = s.select(key.alias("pos"), F.concat(F.lit("C"), key).alias("corp_code"), F.col("s_name").alias("corp_name"))
    reg = reg.union(s.where("s_suppkey % 10 = 3").select(key + 100000, F.concat(F.lit("D"), key), "s_name"))
    return resolve.resolve(names, reg).withColumn("hints", F.array_join("hints", "|"))


def corp_year_grid(spark: SparkSession, sf: str) -> DataFrame:
    """At most 100 companies by name, each with every year; an override of the code wins."""
    corps = adapter.table(spark, sf, "nation").orderBy("n_name").limit(100)
    years = adapter.table(spark, sf, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    override = adapter.table(spark, sf, "nation").where("n_nationkey % 5 = 0").select("n_nationkey", F.concat(F.lit("X"), "n_nationkey").alias("chosen"))
    grid = corps.join(override, "n_nationkey", "left").crossJoin(F.broadcast(years))
    return grid.select(F.col("n_name").alias("corp"), "year", F.coalesce("chosen", F.concat(F.lit("N"), "n_nationkey")).alias("corp_code"))


def report_choice(spark: SparkSession, sf: str) -> DataFrame:
    o = adapter.table(spark, sf, "orders")
    first = F.substring("o_orderpriority", 1, 1)
    kind = F.when(first == "1", "A001").when(first == "2", "F002").when(first == "3", "F001").otherwise("B001")
    y = F.year("o_orderdate")
    nm = F.when(F.col("o_orderkey") % 3 == 0, "사업보고서").otherwise(F.concat(F.lit("사업보고서 ("), (y - F.col("o_orderkey") % 2).cast("string"), F.lit(".12)")))
    filings = o.select(F.col("o_custkey").alias("corp"), kind.alias("kind"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("R"), "o_orderkey").alias("rcept_no"), nm.alias("report_nm"), F.date_format("o_orderdate", "yyyyMMdd").alias("rcept_dt"))
    return resolve.choose_report(filings, o.select(F.col("o_custkey").alias("corp"), y.alias("year")).distinct())


def semi_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Customers without a pending order, and whether they have any."""
    c, o = adapter.table(spark, sf, "customer"), adapter.table(spark, sf, "orders")
    left = c.join(o.where("o_orderstatus = 'P'"), c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")
    some = o.select("o_custkey").distinct()
    return left.join(some, left.c_custkey == some.o_custkey, "left").select("c_custkey", F.col("o_custkey").isNotNull().alias("has_info"))


def ordered_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's order priorities once, in order of first occurrence."""
    firsts = adapter.table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("first"))
    listed = firsts.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("first", "o_orderpriority"))).alias("l"))
    return listed.select("o_custkey", F.array_join(F.col("l.o_orderpriority"), ",").alias("priorities"))


def rate_window(spark: SparkSession, sf: str) -> DataFrame:
    """Calls in each minute, and whether they exceed the limit of 15."""
    e = adapter.table(spark, sf, "events").groupBy(F.window("ts", "60 seconds").alias("w")).agg(F.count("*").alias("n_calls"))
    return e.select(F.col("w.start").alias("window_start"), "n_calls", (F.col("n_calls") > 15).alias("over_limit"))


def call_waits(spark: SparkSession, sf: str) -> DataFrame:
    """How long every call waits under the exact rule. Callers are event types, so each holds a share of all calls; their time runs 600 times as fast."""
    e = adapter.table(spark, sf, "events")
    fast = F.timestamp_micros(F.expr("unix_micros(CAST(ts AS TIMESTAMP)) DIV 600"))
    return calls.waits(e.select(F.col("event_type").alias("caller"), fast.alias("ts"), F.col("event_id").alias("call_id")))


def newest_corrections(spark: SparkSession, sf: str) -> DataFrame:
    """The newest filing of each customer, year and type, out of a snapshot that four batches were merged into, one of them twice."""
    o = adapter.table(spark, sf, "orders")
    filed = F.date_format("o_orderdate", "yyyyMMdd")
    all_of = o.select(F.concat(F.lit("C"), "o_custkey").alias("corp"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("kind"), F.concat(F.lit("R"), "o_orderkey").alias("rcept_no"), F.col("o_orderstatus").alias("report_nm"), filed.alias("rcept_dt"), "o_orderkey")
    kept = snapshot.corrections(spark, new_folder(spark, "corrections"), 8)
    for batch in (0, 1, 1, 2, 3):
        kept.merge(all_of.where(F.col("o_orderkey") % 4 == batch), batch)
    kept.vacuum()
    return kept.read()


def registry_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """For every event, what the registry said of a supplier at that time; three versions, each fresh for a day."""
    s, root = adapter.table(spark, sf, "supplier"), new_folder(spark, "registry")
    row = lambda code: s.select(F.concat(F.lit(code), "s_suppkey").alias("corp_code"), F.col("s_name").alias("corp_name"), F.col("s_suppkey").alias("pos"))
    registry.take(row("A").where("pos % 3 <> 0"), "2024-01-05 00:00:00", root)
    registry.take(row("B").unionByName(row("X").where("pos % 5 = 0").withColumn("pos", F.col("pos") + 100000)), "2024-01-05 12:00:00", root)
    registry.take(row("C"), "2024-01-12 06:00:00", root)
    e = adapter.table(spark, sf, "events").where("ts < '2024-01-20'")
    name = F.concat(F.lit("Supplier#"), F.lpad((F.col("user_id") + 1).cast("string"), 9, "0"))
    out = registry.as_of(e.select("event_id", name.alias("name"), F.col("ts").alias("at")), root)
    return out.select("event_id", "name", F.date_format("taken_at", "yyyy-MM-dd HH:mm").alias("taken_at"), "n_exact", "corp_code")


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    """For what goes through a document several times."""
    return adapter.nodes(spark, sf, adapter.facts(spark, sf))


def _sections(nodes: DataFrame) -> DataFrame:
    return documents.sections(nodes).select(*KEYS, "pos", "section", documents.classify(F.col("rows")).alias("by_labels"))


def section_assign(spark: SparkSession, sf: str) -> DataFrame:
    return _sections(_nodes(spark, sf))


def scope_infer(spark: SparkSession, sf: str) -> DataFrame:
    return documents.division(_nodes(spark, sf))


def current_column(spark: SparkSession, sf: str) -> DataFrame:
    t = documents.with_current_column(adapter.nodes(spark, sf).where("kind = 'table'"), True)
    return t.select(*KEYS, "pos", "cur", documents.column_label(F.col("rows"), F.col("cur")).alias("column_label"))


def doc_extract(spark: SparkSession, sf: str) -> DataFrame:
    t = documents.with_units(documents.statement_tables(_nodes(spark, sf)))
    return documents.extract(t, catalog.items(spark)).select(*KEYS, "item", "value", "confidence", "unit")


def _archived(spark: SparkSession, sf: str) -> DataFrame:
    return settle(adapter.archived(spark, sf, new_folder(spark, "archives")), "archived-nodes")


def archived_extract(spark: SparkSession, sf: str) -> DataFrame:
    """doc_extract of documents that come out of archives and the shredder."""
    t = documents.with_units(documents.statement_tables(_archived(spark, sf)))
    return documents.extract(t, catalog.items(spark)).select(*KEYS, "item", "value", "confidence", "unit")


def archived_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """cf_buckets of documents that come out of archives and the shredder."""
    n = _archived(spark, sf)
    return depreciation.cash_flow_buckets(documents.with_units(depreciation.cash_flow_tables(n, documents.division(n), strict=True)))


def html_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The tables of pages in two encodings, row by row, with every cell in each place that it spans."""
    t = html.tables(adapter.pages(spark, sf)).select("doc_id", "table_no", F.posexplode("rows").alias("row_no", "row"))
    return t.select("doc_id", "table_no", "row_no", F.array_join("row", "|").alias("cells"))


def html_items(spark: SparkSession, sf: str) -> DataFrame:
    return html.items(html.tables(adapter.pages(spark, sf)), catalog.items(spark))


def _cash_flow(n: DataFrame) -> DataFrame:
    return depreciation.cash_flow_tables(n, documents.division(n), strict=True).select(*KEYS, "pos", "matched")


def cf_tables(spark: SparkSession, sf: str) -> DataFrame:
    return _cash_flow(_nodes(spark, sf))


def cf_buckets(spark: SparkSession, sf: str) -> DataFrame:
    n = _nodes(spark, sf)
    return depreciation.cash_flow_buckets(documents.with_units(depreciation.cash_flow_tables(n, documents.division(n), strict=True)))


def _candidates(spark: SparkSession, sf: str, facts: DataFrame | None = None) -> DataFrame:
    n = _nodes(spark, sf) if facts is None else adapter.nodes(spark, sf, facts)
    return depreciation.notes_candidates(n, documents.division(n), strict=True)


def notes_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _candidates(spark, sf).select(*KEYS, "pos", "table_no")


def position_verify(spark: SparkSession, sf: str) -> DataFrame:
    facts = adapter.facts(spark, sf)
    return depreciation.verify_selection(documents.with_units(_candidates(spark, sf, facts)), _choice(spark, facts))


def _choice(spark: SparkSession, facts: DataFrame) -> DataFrame:
    """What a model would choose: rows of the first candidate."""
    slots = spark.createDataFrame([("depr", 3), ("rou", 5), ("amort", 6)], "slot string, row_no int")
    row = F.when((F.col("slot") == "depr") & (F.col("year") % 3 == 0), 99).otherwise(F.col("row_no"))
    return facts.crossJoin(F.broadcast(slots)).select(*KEYS, "slot", F.lit(1).alias("table_no"), row.alias("row_no"), (F.col("year") % 4 == 0).alias("combined"))


def _stages(spark: SparkSession, sf: str, facts: DataFrame) -> analysis.Stages:
    all_nodes = adapter.members(spark, sf, facts)
    first = all_nodes.where("member = 0").drop("member")
    divisions = adapter.divisions(spark, sf, facts).join(large(documents.division(first).drop("fs_div")), KEYS)
    return analysis.stages(first, settle(divisions, "divisions"), True, documents.merged_members(all_nodes))


def depreciation_analysis(spark: SparkSession, sf: str) -> DataFrame:
    """Depreciation of every filing, from its first document or else all members of its archive, and how it was found."""
    facts = adapter.facts(spark, sf)
    found = _stages(spark, sf, facts)
    result = analysis.result_of(found, _choice(spark, facts))
    n = found.accepted()[1].groupBy(*KEYS).agg(F.count("*").alias("n"))
    done = F.coalesce(F.col("depr").isNotNull() & (F.col("amort").isNotNull() | F.col("combined")) & (F.col("source") == "cf"), F.lit(False))
    out = found.documents.select(*KEYS).join(large(result), KEYS, "left").join(large(n), KEYS, "left").join(large(found.again.select(*KEYS, F.lit(True).alias("again"))), KEYS, "left")
    return out.select(*KEYS, *analysis.AMOUNTS, F.coalesce("combined", F.lit(False)).alias("combined"), F.coalesce("source", F.lit("error")).alias("source"), F.when(done, 0).otherwise(F.coalesce("n", F.lit(0))).alias("n_candidates"), F.coalesce("again", F.lit(False)).alias("again"))


def analysis_run(spark: SparkSession, sf: str) -> DataFrame:
    """Everything in one run: names to companies, years to reports, rows or documents to items, depreciation, checks. Of the
    companies some have a namesake, some filings are missing, those of one variant have no account rows, and those of
    two are audit reports."""
    facts = adapter.facts(spark, sf)
    s = adapter.table(spark, sf, "supplier").select(F.col("s_name").alias("corp_name"), F.col("s_suppkey").alias("pos"))
    registry = s.select(F.col("corp_name").alias("corp_code"), "corp_name", "pos").unionByName(s.where("pos % 10 = 3").select(F.concat(F.lit("D"), "pos").alias("corp_code"), "corp_name", (F.col("pos") + 100000000).alias("pos")))
    names = s.select(F.col("corp_name").alias("name")).unionByName(spark.createDataFrame([("nobody",)], "name string"))
    kind = F.when(F.col("k") == 3, "F002").when(F.col("k") == 4, "F001").otherwise("A001")
    title = F.concat(F.lit("보고서 ("), "year", F.lit(".12)"))
    filed = facts.where("(qty DIV 10000 + year) % 11 <> 0").select("corp", kind.alias("kind"), F.concat("corp", F.lit("-"), "year").alias("rcept_no"), title.alias("report_nm"), F.concat(F.col("year") + 1, F.lit("0331")).alias("rcept_dt"), F.col("year").alias("pos"))
    with_rows = adapter.accounts(spark, sf, facts.where("k <> 2"))
    out = analysis.analyze(names, facts.select("year").distinct(), registry, filed, with_rows, adapter.nodes(spark, sf, facts), catalog.items(spark))
    return out.select("name", "year", "status", "path", "fs_div", "revenue", "op_income", *analysis.AMOUNTS, "ebitda", "is_valid", F.array_join("flags", " / ").alias("flags"), "remarks", "depr_source")


def trace_lines(spark: SparkSession, sf: str) -> DataFrame:
    """What the evaluation of every filing's depreciation did, line by line."""
    facts = adapter.facts(spark, sf)
    return trace.lines(trace.events(_stages(spark, sf, facts), True, _choice(spark, facts)))


def _account_details(spark: SparkSession, sf: str, facts: DataFrame) -> DataFrame:
    found = details.of_accounts(accounts.extract(adapter.accounts(spark, sf, facts), catalog.items(spark), origin=True))
    return details.every_item(found, facts, KEYS, "dart_api")


def _shown(found: DataFrame, *keys: str) -> DataFrame:
    """Details as columns."""
    d = F.col("detail")
    fields = [d[c].alias(c) for c in ("value", "raw_value", "unit_multiplier", "confidence", "value_state")]
    return found.select(*keys, "item", *fields, F.array_join(d["flags"], ",").alias("flags"), *(d["source"][c].alias(c) for c in details.SOURCE))


def item_details(spark: SparkSession, sf: str) -> DataFrame:
    """All twelve items of every filing with the cells they come from: of its account rows, and of its document."""
    facts = adapter.facts(spark, sf)
    tables = documents.with_units(documents.statement_tables(adapter.nodes(spark, sf, facts)))
    of_doc = details.of_documents(documents.extract(tables, catalog.items(spark), origin=True))
    both = _account_details(spark, sf, facts).unionByName(details.every_item(of_doc, facts, KEYS, "document_xml").withColumn("origin", F.lit("document")), allowMissingColumns=True)
    shown = _shown(both.withColumn("origin", F.coalesce("origin", F.lit("accounts"))), *KEYS, "origin")
    return shown.drop("depreciation_source", "ai_source", "disagreement", "previous_source", "rcept_no", "report_nm", "path", "report_type")


def final_details(spark: SparkSession, sf: str) -> DataFrame:
    """Details of account rows after the comparison with a second opinion, with their report."""
    facts = adapter.facts(spark, sf)
    both = _adjudicated(spark, sf, facts).withColumn("value", F.when(F.col("disagree") & (F.col("item") == "assets") & (F.col("year") % 3 == 0), None).otherwise(F.col("final")))
    joined = _account_details(spark, sf, facts).join(both.select(*KEYS, "item", "value", "ours", "theirs", F.lit(True).alias("compared")), [*KEYS, "item"], "left")
    told = details.final(F.col("detail"), F.col("value"), F.lit("adjudicated"), compare.disagreement(F.col("ours"), F.col("theirs")))
    chosen = F.when(F.col("compared"), told).otherwise(F.col("detail"))
    report_of = {"rcept_no": F.concat("corp", F.lit("-"), "year"), "report_nm": F.lit("사업보고서"), "path": F.lit("A"), "report_type": F.lit("annual")}
    return _shown(joined.withColumn("detail", details.annotate(chosen, **report_of)), *KEYS).drop("ord", "table_id", "row_id", "row_label", "normalized_row_label", "unit_confidence", "depreciation_source", "column_label", "previous_source")


def doc_text_bundle(spark: SparkSession, sf: str) -> DataFrame:
    return documents.text_bundle(_nodes(spark, sf))


def notes_text_bundle(spark: SparkSession, sf: str) -> DataFrame:
    return depreciation.selection_text(documents.with_units(_candidates(spark, sf)))


def _signals(nodes: DataFrame) -> DataFrame:
    s = depreciation.signals(F.col("rows"))
    return nodes.where("kind = 'table'").select(*KEYS, "pos", *(s[c].alias(c) for c in ("exact", "amort", "combined", "pair")))


def depreciation_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Of every table what it says of depreciation."""
    return _signals(adapter.nodes(spark, sf))


def word_items(spark: SparkSession, sf: str) -> DataFrame:
    """The item rules over every account id, keyword and excluding word; as the next ones, so that each word of each list is met."""
    return accounts.extract(adapter.word_accounts(spark, sf), catalog.items(spark))


def word_sections(spark: SparkSession, sf: str) -> DataFrame:
    return _sections(adapter.word_nodes(spark, sf))


def word_scopes(spark: SparkSession, sf: str) -> DataFrame:
    return documents.division(adapter.word_nodes(spark, sf))


def word_cash_flow(spark: SparkSession, sf: str) -> DataFrame:
    return _cash_flow(adapter.word_nodes(spark, sf))


def word_candidates(spark: SparkSession, sf: str) -> DataFrame:
    n = adapter.word_nodes(spark, sf)
    return depreciation.notes_candidates(n, documents.division(n), strict=True).select(*KEYS, "pos", "table_no")


def word_signals(spark: SparkSession, sf: str) -> DataFrame:
    return _signals(adapter.word_nodes(spark, sf))


def word_doc_items(spark: SparkSession, sf: str) -> DataFrame:
    t = documents.with_units(documents.statement_tables(adapter.word_nodes(spark, sf)))
    return documents.extract(t, catalog.items(spark)).select(*KEYS, "item", "value", "confidence", "unit")


def separate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return depreciation.separate_pairs(_candidates(spark, sf))


def disagreement_texts(spark: SparkSession, sf: str) -> DataFrame:
    return _compared(spark, sf).where("disagree").select(*KEYS, "item", compare.disagreement(F.col("ours"), F.col("theirs")).alias("text"))


REPLY = "CASE k WHEN 0 THEN concat('{\"depr\": ', qty, ', \"amort\": null}') WHEN 1 THEN concat('Here: ```json\n{\"depr\": ', tax, ', \"amort\": 1}\n``` done') WHEN 2 THEN concat('```\n{\"amort\": ', rev, '}```') WHEN 3 THEN concat('{\"depr\": ', qty) ELSE 'no reply' END"


def reply_values(spark: SparkSession, sf: str) -> DataFrame:
    """Values out of replies of all kinds: bare, fenced, cut off and plain talk."""
    said = _facts(spark, sf).select(*KEYS, text.reply(F.expr(REPLY)).alias("r"))
    return said.select(*KEYS, F.col("r").isNotNull().alias("parsed"), F.col("r")["depr"].try_cast("double").alias("depr"), F.col("r")["amort"].try_cast("double").alias("amort"))


def status_texts(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("year") % 4
    state = F.element_at(F.array(*map(F.lit, ("ok", "no_corp", "ambiguous_corp", "no_report", "error"))), F.col("k") + 1)
    message = F.when(n == 0, "").when(n == 1, "유사: A").when(n == 2, "보고서 탐색 오류: x").otherwise("재무데이터 추출 오류: y")
    f = _facts(spark, sf).withColumns({"state": state, "message": message, "path": F.when(n < 2, "A").otherwise("B"), "nm": F.when(n != 1, "사업보고서")})
    division = report.division_name(F.col("path"), F.when(n == 0, "CFS").otherwise("OFS"), F.when(n == 2, "audit_consol").otherwise("audit_separate"))
    text_of = report.processing(F.col("state"), F.col("message"), F.col("nm"), F.col("path"), division, F.col("year"))
    return f.select(*KEYS, "state", text_of.alias("text"), report.status(F.col("state"), F.col("message"), F.when(n == 0, True).when(n == 1, False)).alias("status"))


QUERIES = {f.__name__: f for f in (
    ebitda, account_extract, depreciation_merge, identity_checks, summary_report, summary_states, run_metrics, company_pivot, fs_div_infer, ai_text_bundle, ai_compare, ai_outcome, golden_diff,
    amount_parse, label_normalize, row_label_normalize, unit_detect, text_functions, division_choice, candidate_info, landed_accounts, landed_registry, landed_filings, registry_search, corp_year_grid, report_choice, semi_anti, ordered_distinct, rate_window, call_waits, newest_corrections, registry_as_of,
    section_assign, scope_infer, current_column, doc_extract, archived_extract, html_tables, html_items, cf_tables, cf_buckets, archived_buckets, notes_candidates, position_verify, doc_text_bundle, notes_text_bundle,
    depreciation_signals, word_items, word_sections, word_scopes, word_cash_flow, word_candidates, word_signals, word_doc_items, separate_pairs, disagreement_texts, reply_values, status_texts, depreciation_analysis, analysis_run, trace_lines, item_details, final_details,
)}
ORACLES = oracle.SQL | oracle_docs.SQL | oracle_analysis.SQL
ORACLES |= {"archived_extract": ORACLES["doc_extract"], "archived_buckets": ORACLES["cf_buckets"]}
