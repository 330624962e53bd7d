"""Files to entities, page layouts, sinks and streams."""

import datetime as dt
import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from ledgermatch.operators import keys as K
from ledgermatch.plans import catalog, ledger_queries, registry
from ledgermatch.sources import documents as D
from ledgermatch.sources import ocr as O
from ledgermatch.sources import sinks
from ledgermatch.sources import structured as S
from ledgermatch.streaming import jobs as J

c = F.col

QUICKBOOKS = ('Transaction Date,Num,Name,Memo,Account,Debit,Credit\r\n'
              '01/15/2024,J1,"Acme, Corp",memo,2000,1500.00,0.00\r\n'
              '01/15/2024,J1,"Acme, Corp",memo,2000,0.00,1500.00\r\n'
              '02/01/2024,,Global,"two\nlines",2000,,250.00\r\n'
              '02/03/2024,J9\r\n')
MAP = {"date": "Transaction Date", "amount": "Debit", "counterparty": "Name", "description": "Memo", "account_code": "Account"}


def documents(spark, content, doc_type="gl_export", columns=MAP):
    df = spark.createDataFrame([("d1", "b1", doc_type, content)], "document_id string, client_book_id string, doc_type string, content string")
    return df.withColumn("column_map", F.create_map(*(F.lit(x) for kv in columns.items() for x in kv)))


def test_csv(spark):
    rows = S.scan_csv_entities(documents(spark, QUICKBOOKS)).orderBy("row_no").collect()
    assert [(r["amount_cents"], r["transaction_date"], r["counterparty"], r["transaction_ref"]) for r in rows] == [
        (150000, dt.date(2024, 1, 15), "Acme, Corp", "J1"), (25000, dt.date(2024, 2, 1), "Global", None),
        (0, dt.date(2024, 2, 3), None, "J9")]
    assert rows[1]["description"] == "two\nlines"


def test_pairs_without_reference_fold_by_day_name_and_amount(spark):
    text = "posting_date,debit_amount,credit_amount\n2026-07-05,471.25,\n2026-07-05,,471.25\n2026-07-05,215.00,\n2026-07-05,,215.00\n"
    found = S.scan_csv_entities(documents(spark, text, columns={"date": "posting_date", "amount": "debit_amount"}))
    assert sorted(r["amount_cents"] for r in found.collect()) == [21500, 47125]


def test_files_on_disk(spark, tmp_path):
    (tmp_path / "gl.csv").write_text(QUICKBOOKS)
    (tmp_path / "bank.OFX").write_text("OFXHEADER:100\n<STMTTRN><DTPOSTED>20240115120000<TRNAMT>-12.50<FITID>F1<NAME>ACME<MEMO> </STMTTRN>")
    (tmp_path / "scan.pdf").write_text("a,b")
    files = D.register_documents(S.read_documents(spark, str(tmp_path)))
    kinds = files.select("doc_type", D.route_format(c("path"), c("content").cast("string")).alias("format")).collect()
    assert sorted(map(tuple, kinds)) == [("bank_statement", "ofx"), ("gl_export", "csv"), ("invoice", "ocr")]
    bank = files.filter("doc_type = 'bank_statement'").select(c("path").alias("document_id"), F.lit("b").alias("client_book_id"), "content")
    row, = S.scan_ofx_transactions(bank).collect()
    assert (row["amount_cents"], row["transaction_date"], row["description"]) == (-1250, dt.date(2024, 1, 15), "ACME")


def page(lines):
    def box(y):
        return [[0.0, y], [10.0, y], [10.0, y + 1], [0.0, y + 1]]
    return json.dumps({"document_id": "p", "doc_type": "invoice", "page_number": 1, "width": 100.0, "height": 100.0, "blocks": [
        {"geometry": box(0.0), "confidence": 0.9, "lines": [{"geometry": box(y), "confidence": 0.9, "words": [
            {"value": w, "confidence": 0.9, "geometry": box(y)} for w in t.split(" ")]} for y, t in lines]}]})


def entities_of(spark, tmp_path, lines):
    (tmp_path / "p.json").write_text(page(lines))
    return O.scan_ocr_layout(O.read_pages(spark, str(tmp_path / "p.json"))).collect()


def test_layout_context(spark, tmp_path):
    rows = entities_of(spark, tmp_path, [(5.0, "INVOICE"), (10.0, "SUNRISE LANDSCAPE MAINTENANCE"), (25.0, "2026-07-01"), (30.0, "Total $150.00"), (60.0, "2026-07-09")])
    assert [(r["amount_cents"], r["transaction_date"], r["counterparty"]) for r in rows] == [
        (15000, dt.date(2026, 7, 1), "SUNRISE LANDSCAPE MAINTENANCE")]
    labelled = entities_of(spark, tmp_path, [(29.0, "2026-07-01"), (30.0, "Total $150.00"), (90.0, "Date: 07/09/2026")])
    assert labelled[0]["transaction_date"] == dt.date(2026, 7, 9)


def test_citations(spark):
    lines = ["$128.75", "$128.75", "$128.75", "$5.15", "Net 15"]
    rows = spark.createDataFrame([("d", i, t) for i, t in enumerate(lines)], "document_id string, line_no int, text string")
    cited = spark.createDataFrame([("d", 12875, [4])], "document_id string, total_cents long, indices array<int>")
    assert O.ground_citations(cited, rows).collect()[0]["indices"] == [0, 1, 2]
    kept = spark.createDataFrame([("d", 515, [3, 4])], cited.schema)
    assert O.ground_citations(kept, rows).collect()[0]["indices"] == [3]
    none = spark.createDataFrame([("d", 1, [4])], cited.schema)
    assert O.ground_citations(none, rows).collect()[0]["indices"] == [4]


def test_findings_are_stored_once(spark, tmp_path):
    path = str(tmp_path / "findings")
    rows = spark.createDataFrame([("g1", "low"), ("g2", "high")], "reconciliation_group_id string, severity string")
    for _ in range(2):
        sinks.persist_findings(rows, path)
    assert spark.read.parquet(path).count() == 2


def test_linking_a_batch_again_changes_nothing(spark, tmp_path):
    schema = ("client_book_id string, id string, entity_type string, entity_subtype string, amount_cents long, "
              "transaction_date date, counterparty string")
    day = dt.date(2026, 7, 6)
    rows = [("b", i, k, "standard", 10000, day, "Acme") for i, k in (
        ("i1", "invoice_line_item"), ("b1", "bank_transaction"), ("g1", "gl_entry"))]
    more = [("b", i, k, "standard", 777, day, "Globex") for i, k in (
        ("i2", "invoice_line_item"), ("b2", "bank_transaction"), ("g2", "gl_entry"))]
    books = spark.createDataFrame([("b", 1, 0.85, 0.5)], "id string, tolerance_cents long, auto_link_threshold double, review_floor double")
    base = str(tmp_path / "store")
    for number, batch in ((0, rows), (0, rows), (1, more), (1, more)):
        J.link_and_verify(spark.createDataFrame(batch, schema), number, base, books, "{}")
    assert [spark.read.parquet(f"{base}/{t}").count() for t in ("entities", "groups", "members", "findings")] == [6, 2, 6, 2]


def test_relinking_reads_only_what_is_pending_in_touched_books(spark, tmp_path, monkeypatch):
    schema = ("client_book_id string, id string, entity_type string, entity_subtype string, amount_cents long, transaction_date date, counterparty string")
    books = spark.createDataFrame([(b, 1, 0.85, 0.5) for b in "abc"], "id string, tolerance_cents long, auto_link_threshold double, review_floor double")

    def legs(book, amount, kinds="ibg"):
        names = {"i": "invoice_line_item", "b": "bank_transaction", "g": "gl_entry"}
        return [(book, f"{book}{k}{amount}", names[k], "standard", amount, dt.date(2026, 3, 1), "Acme") for k in kinds]

    batches = [legs("a", 500) + legs("b", 700, "ib"), legs("a", 90000) + legs("b", 700, "g")]
    read, pending = [], J._pending

    def watched(spark, base, number, touched, shape):
        found = pending(spark, base, number, touched, shape)
        read.append((number, sorted(r["id"] for r in found.collect())))
        return found

    monkeypatch.setattr(J, "_pending", watched)
    base = str(tmp_path / "store")
    for number in (0, 1, 1):  # the last batch is replayed
        J.link_and_verify(spark.createDataFrame(batches[number], schema), number, base, books, "{}")
    assert read == [(0, []), (1, ["bb700", "bi700"]), (1, ["bb700", "bi700"])]
    together = str(tmp_path / "together")
    J.link_and_verify(spark.createDataFrame(sum(batches, []), schema), 0, together, books, "{}")
    for table, key in (("groups", "id"), ("members", "extracted_entity_id"), ("findings", "reconciliation_group_id")):
        one, many = (sorted(r[0] for r in spark.read.parquet(f"{x}/{table}").select(key).collect()) for x in (together, base))
        assert one == many and one


def test_repeats_get_the_stored_answer_for_a_day(spark, tmp_path):
    hour = lambda h: dt.datetime(2026, 1, 1) + dt.timedelta(hours=h)
    schema = "request_id long, user_id long, key string, ts timestamp, response string"
    batches = [[(1, 7, "k", hour(0), "one"), (2, 7, "k", hour(3), "two"), (3, 8, "k", hour(1), "three")],
               [(4, 7, "k", hour(23), "four"), (5, 7, "k", hour(24), "five"), (6, 7, "k", hour(25), "six")],
               [(7, 9, "z", hour(200), "seven")], [(8, 9, "z", hour(201), "eight")], [(9, 7, "k", hour(202), "nine")]]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        J.start(J.answered_requests(spark.readStream.schema(schema).parquet(source)).writeStream.format("parquet").option("path", out),
                str(tmp_path / "cp"), once=True).awaitTermination()
    got = {r["request_id"]: (r["response"], r["replayed"]) for r in spark.read.parquet(out).collect()}
    assert got == {1: ("one", False), 2: ("one", True), 3: ("three", False), 4: ("one", True), 5: ("five", False), 6: ("five", True),
                   7: ("seven", False), 8: ("seven", True), 9: ("nine", False)}


@pytest.mark.parametrize("buckets", [1, 16_384])
def test_keys_of_one_bucket_are_answered_each_for_itself(spark, tmp_path, monkeypatch, buckets):
    """Missing times come last, a key that is forgotten leaves the others of its bucket alone."""
    monkeypatch.setattr(J, "KEY_BUCKETS", buckets)
    hour = lambda h: dt.datetime(2026, 1, 1) + dt.timedelta(hours=h)
    schema = "request_id long, user_id long, key string, ts timestamp, response string"
    batches = [[(3, 2, "k", hour(5), None), (1, 1, "k", hour(2), "b"), (2, 1, "k", hour(2), "c"), (4, 1, "k", hour(1), "a"), (5, 3, "k", hour(40), "d")],
               [(6, 2, "k", hour(28), "e"), (7, 1, "k", hour(26), "f"), (8, 4, "k", hour(90), "g")],
               [(9, 3, "k", hour(63), "h"), (10, 4, "k", hour(91), "i")], [(11, 1, "k", hour(92), "j"), (12, 4, "k", hour(113), "k")]]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        J.start(J.answered_requests(spark.readStream.schema(schema).parquet(source)).writeStream.format("parquet").option("path", out),
                str(tmp_path / "cp"), once=True).awaitTermination()
    got = {r["request_id"]: (r["response"], r["replayed"]) for r in spark.read.parquet(out).collect()}
    late = got.pop(9, None)  # behind the watermark by then: dropped
    assert late is None and got == {4: ("a", False), 1: ("a", True), 2: ("a", True), 3: (None, False), 5: ("d", False), 6: (None, True), 7: ("f", False),
                                    8: ("g", False), 10: ("g", True), 11: ("j", False), 12: ("g", True)}


def test_a_subscription_is_switched_off_once(spark, tmp_path):
    at = dt.datetime(2026, 1, 1)
    schema = "subscription_id string, at timestamp, delivery_id long, failed boolean"
    batches = [[("s", at, 1, True), ("s", at, 2, False), ("t", at, 3, True)], [("s", at, 9, True), ("s", at, 5, True), ("s", at, 4, True)],
               [("s", at, 10, True), ("t", at, 11, True), ("u", at, 12, True)], [("t", at, 13, True), ("t", at, 14, True)]]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        J.start(J.disabled_subscriptions(spark.readStream.schema(schema).parquet(source)).writeStream.format("parquet").option("path", out),
                str(tmp_path / "cp"), once=True).awaitTermination()
    assert sorted((r["subscription_id"], r["disabled_by"]) for r in spark.read.parquet(out).collect()) == [("s", 5), ("t", 13)]


def test_document_stream_drops_repeated_content(spark, tmp_path):
    schema = "document_id string, client_book_id string, doc_type string, content string"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("d1", "b1", "gl_export", QUICKBOOKS), ("d2", "b1", "gl_export", QUICKBOOKS), ("d3", "b2", "gl_export", QUICKBOOKS)]
    mapping = F.create_map(*(F.lit(x) for kv in MAP.items() for x in kv))
    for part in (rows[:1], rows[1:]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(source)
        J.stream_documents(spark.readStream.schema(schema).parquet(source), out, str(tmp_path / "cp"),
                           lambda b: S.scan_csv_entities(b.withColumn("column_map", mapping)), once=True).awaitTermination()
    assert {(r["client_book_id"], r["count"]) for r in spark.read.parquet(out).groupBy("client_book_id").count().collect()} == {("b1", 3), ("b2", 3)}


@pytest.mark.parametrize("files", [1, 3])
def test_streamed_tables_may_be_a_file_or_a_folder(spark, tmp_path, files):
    rows = spark.createDataFrame([(i, f"text {i % 5}", "s") for i in range(12)], "doc_id long, text string, source string")
    rows.repartition(files).write.parquet(str(tmp_path / "written"))
    (tmp_path / "t").mkdir()
    if files > 1:
        (tmp_path / "written").rename(tmp_path / "t" / "documents.parquet")
    else:
        next((tmp_path / "written").glob("part-*")).rename(tmp_path / "t" / "documents.parquet")
    found = catalog.queries()["stream_documents"](spark, str(tmp_path / "t")).collect()
    assert len(found) == 5 and {r["copies"] for r in found} == {1}


def test_groups_are_built_once_for_all_writes(spark, monkeypatch):
    members = [(f"g{k}", f"{role[0]}{k}", role) for k in range(4) for role in ("invoice", "bank", "gl") if (k, role) != (3, "gl")]
    model = SimpleNamespace(
        spark=spark, members=spark.createDataFrame(members, "reconciliation_group_id string, extracted_entity_id string, role string"),
        groups=spark.createDataFrame([(f"g{k}", "b", 0.9, "confirmed") for k in range(4)], "id string, client_book_id string, link_confidence double, status string"))
    written, store = [], ledger_queries.persist_groups
    monkeypatch.setattr(ledger_queries, "persist_groups", lambda groups, *paths: (written.append(groups.inputFiles()), store(groups, *paths)))
    got = registry._QUERIES["persist_groups"](model).collect()
    assert sorted(tuple(r) for r in got) == sorted(m for m in members if m[0] != "g3")
    assert len(written) == 3 and all(written)  # all three read the written groups


def test_reports_and_citations_share_the_findings(spark, monkeypatch):
    calls, found = [], spark.createDataFrame([("g1",)], "reconciliation_group_id string")
    monkeypatch.setattr(ledger_queries, "_findings", lambda m: calls.append(m) or found)
    monkeypatch.setattr(ledger_queries.R, "monthly_reports", lambda findings, *_: findings.withColumn("period_start", F.lit("1999-02-01").cast("date")))
    monkeypatch.setattr(ledger_queries.R, "finding_citation", lambda findings, *_: findings.withColumn("source_document_id", F.lit("d")))
    model = SimpleNamespace(members=None, entities=None, periods=None)
    assert [tuple(r) for r in registry._QUERIES["report_citations"](model).collect()] == [("g1", "d")] and len(calls) == 1


def test_date_keys_cover_every_pair_once(spark):
    days = [None] + [dt.date(2026, 1, 1) + dt.timedelta(i) for i in range(0, 40, 3)]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "n int, d date")
    a = df.select(c("n").alias("a"), c("d").alias("da"), F.explode(K.earlier_date_keys(c("d"))).alias("k"))
    b = df.select(c("n").alias("b"), c("d").alias("db"), F.explode(K.later_date_keys(c("d"))).alias("k"))
    got = sorted((r["a"], r["b"]) for r in a.join(b, "k").filter(K.dates_match(c("da"), c("db"))).collect())
    want = sorted((i, j) for i, x in enumerate(days) for j, y in enumerate(days)
                  if x is None or y is None or 0 <= (y - x).days <= 14)
    assert got == want


def _random_boxes(rng, n, largest):
    rows = []
    for i in range(n):
        w, h = (rng.choice([0.0, rng.random() * largest, rng.random() * largest]) for _ in range(2))
        x, y = (0.0, 0.0) if rng.random() < 0.1 else (rng.random() * 0.3, rng.random() * 0.9)
        rows.append((f"d{i % 2}", 1, f"r{i:04d}", (x, y, w, h)))
    return rows


@pytest.mark.parametrize("crowded,largest", [(4, 0.05), (4, 0.6), (1000, 0.1)])
def test_overlapping_regions_equal_brute_force(spark, monkeypatch, crowded, largest):
    import random

    from ledgermatch.operators import regions as RG
    monkeypatch.setattr(RG, "CROWDED", crowded)
    rows = _random_boxes(random.Random(crowded), 220, largest)
    frame = spark.createDataFrame(rows, "source_document_id string, page_number int, id string, bbox struct<x: double, y: double, width: double, height: double>")
    want = set()
    for i, (d, _, a, p) in enumerate(rows):
        for e, _, b, q in rows[i + 1:]:
            if d == e and p[0] < q[0] + q[2] and p[0] + p[2] > q[0] and p[1] < q[1] + q[3] and p[1] + p[3] > q[1]:
                inside = lambda u, v: v[0] >= u[0] and v[1] >= u[1] and v[0] + v[2] <= u[0] + u[2] and v[1] + v[3] <= u[1] + u[3]
                o = max(0.0, min(p[0] + p[2], q[0] + q[2]) - max(p[0], q[0])) * max(0.0, min(p[1] + p[3], q[1] + q[3]) - max(p[1], q[1]))
                want.add((a, b, inside(p, q), inside(q, p), round(o, 12), round(p[0] + p[2] / 2, 12)))
    got = [(r["id_a"], r["id_b"], r["a_contains_b"], r["b_contains_a"], round(r["area"], 12), round(r["center_a"]["x"], 12)) for r in RG.overlapping_regions(frame).collect()]
    assert set(got) == want and len(got) == len(want) and want


def test_a_page_of_a_hundred_thousand_boxes(spark):
    from ledgermatch.operators.regions import overlapping_regions
    side = 320  # small boxes on a lattice, each over the next one's edge, all in a hundredth of the page
    step = 0.1 / side
    boxes = spark.range(side * side).select(
        F.lit("d").alias("source_document_id"), F.lit(1).alias("page_number"), F.format_string("r%06d", "id").alias("id"),
        F.struct(((c("id") % side) * step).alias("x"), (F.floor(c("id") / side) * step).alias("y"), F.lit(step * 1.25).alias("width"), F.lit(step * 0.75).alias("height")).alias("bbox"))
    assert overlapping_regions(boxes).count() == side * (side - 1)


def test_header_words_multiply_after_the_documents_are_dealt(spark):
    """Else a task sorts whatever the files that it reads hold, thirty rows a header."""
    headers = spark.range(20).select(c("id").cast("string").alias("document_id"), F.lit(0).alias("position"), F.lit("Payee").alias("name"))
    plan = D.suggest_column_map(headers)._jdf.queryExecution().sparkPlan().toString()
    assert plan.rindex("RepartitionByExpression" if "RepartitionByExpression" in plan else "Exchange hashpartitioning(document_id") > plan.rindex("Generate explode")


def test_column_places_are_found_once_a_document(spark):
    """The header is not searched again for a record; the date's text is cleaned once."""
    plan = S.csv_entities(documents(spark, QUICKBOOKS))._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Generate "):]
    assert below.count("array_position") == plan.count("array_position") > 0
    assert plan.count('^"+|"+$, ') <= 1


def test_uploads_are_read_once(spark, tmp_path):
    path = str(tmp_path / "files")
    (spark.createDataFrame([("d1", "b", "x.csv", QUICKBOOKS)], "document_id string, client_book_id string, path string, content string")
     .withColumns({"length": F.length("content"), "uploaded_at": F.lit(1), "deleted": F.lit(False)}).write.parquet(path))
    maps = spark.createDataFrame([(1, "b", MAP, 1)], "map_id int, client_book_id string, column_map map<string,string>, created_at int")
    from ledgermatch.plans.ingest import ingest_documents
    rows = ingest_documents(spark.read.parquet(path), maps)
    assert not [f for f in rows.inputFiles() if path in f]
    assert sorted(r["amount_cents"] for r in rows.collect()) == [0, 25000, 150000]
