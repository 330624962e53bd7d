"""Golden values of expressions: variance, severity, amounts, dates, texts, boxes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgermatch.functions import dates, geometry, money, text
from ledgermatch.operators import reports as R
from ledgermatch.operators import verify as V
from ledgermatch.sources.ocr import model_rows_to_entities
from ledgermatch.sources.structured import csv_rows

c = F.col


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"n int, v {kind}")
    return [r[0] for r in df.orderBy("n").select(expression(c("v"))).collect()]


@pytest.mark.parametrize("legs,want", [
    ((15000, 15000, 15000), (0, 0, 0)), ((10000, 9950, 10000), (50, 0, 50)), ((10000, 9000, 8000), (1000, 2000, 1000)),
    ((-5000, 5000, 0), (0, 5000, 5000)), ((None, None, None), (None, None, None)), ((None, 620000, 620000), (None, None, 0)),
    ((15000, -14500, 15000), (500, 0, 500))])
def test_three_way_variance(spark, legs, want):
    row = [x for v in legs for x in (v or 0, v is not None)]
    df = spark.createDataFrame([row], "invoice_total long, has_invoice boolean, bank_total long, has_bank boolean, gl_total long, has_gl boolean")
    got = V.three_way_variance(df).collect()[0]
    assert (got["variance_invoice_bank"], got["variance_invoice_gl"], got["variance_bank_gl"]) == want
    assert got["variance_cents"] == max([w for w in want if w is not None], default=0)


def test_severity(spark):
    cases = [(1, 1, "info"), (2, 1, "low"), (10, 1, "low"), (11, 1, "medium"), (100, 1, "medium"), (101, 1, "high"),
             (0, 0, "info"), (1, 0, "high"), (-50, 10, "low"), (500, 100, "low")]
    df = spark.createDataFrame(cases, "variance_cents long, tolerance_cents long, want string")
    assert df.filter(V.severity(c("variance_cents"), c("tolerance_cents")) != c("want")).count() == 0
    bands = spark.createDataFrame(list(V.SEVERITY_BANDS), "severity string, upto long")
    assert V.severity_from_table(df, bands).filter("severity <> want").count() == 0


def test_tolerance_greater_of(spark):
    df = spark.createDataFrame([(1, "10.00", 5), (1, "10000.00", 5000), (10, "1.00", 10)], "f long, t string, want long")
    got = V.tolerance_greater_of(c("f"), F.lit("0.005").cast("decimal(5,4)"), c("t").cast("decimal(18,2)"))
    assert df.filter(got != c("want")).count() == 0


def test_amounts(spark):
    assert column(spark, ["150.00", "-150.00", "100", "$1,500.00", "€89.99", "", "-", "2024-01-15", None], money.amount_structured) == [
        15000, -15000, 10000, 150000, 8999, None, None, None, None]
    assert column(spark, ["$12.50", "1250", "(500)", "N/A", "1,500.00", "-3.10"], money.amount_verbatim) == [1250, 1250, -500, 0, 150000, -310]
    assert column(spark, ["(500)", "-3.10", None, " "], money.amount_citation) == [500, 310, 0, 0]
    assert column(spark, ["850.00 line plus 900.00 total", "OR 97401", "$150", "$-5.00", "150.00.", "-7.00 and 7.00"], money.line_amount) == [
        90000, None, None, 500, None, 700]
    assert column(spark, [123456, -5], money.format_cents, "long") == ["$1,234.56", "-$0.05"]


def test_dates(spark):
    d = dt.date
    assert column(spark, ["2024-01-15", "01/15/2024", "20240115", "20260606120000", "'15/01/2024'", "01/15/24", "02-03-95", "x"],
                  dates.date_structured) == [d(2024, 1, 15)] * 3 + [d(2026, 6, 6), d(2024, 1, 15), d(2024, 1, 15), None, None]
    assert column(spark, ["15/01/2024", "20240115"], dates.date_verbatim) == [d(2024, 1, 15), None]
    assert column(spark, ["Invoice #: SLG-771 Date: 07/03/2026", "ref 12024-01-15", "due 2024-01-15.", "on 31.12.2025 paid"], dates.line_date) == [
        d(2026, 7, 3), None, None, d(2025, 12, 31)]


def test_due_days(spark):
    df = spark.createDataFrame([("high", 2), ("medium", 9), ("low", 38), ("info", 0)], "s string, n int")
    monday = F.lit("2026-01-05").cast("date")
    assert df.filter(F.datediff(R.due_on(monday, c("s")), monday) != c("n")).count() == 0


def test_subtypes_and_json(spark):
    df = spark.createDataFrame([("standard", "Credit memo 7", "credit_note"), ("standard", "refund", "refund"), ("standard", "Reversed", "void"),
                                ("refund", "VOID", "refund"), ("standard", None, "standard")], "s string, d string, want string")
    assert df.filter(text.subtype(c("s"), c("d")) != c("want")).count() == 0
    assert column(spark, ['```json\n[{"a": 1}]\n```', 'so: [1, 2] ok', "none", "[broken", '{"a": [1]}'], text.salvage_json_array) == [
        '[{"a": 1}]', "[1, 2]", "[]", "[]", "[1]"]


def test_boxes(spark):
    b = geometry.from_pixels(*(F.lit(float(x)) for x in (100, 200, 50, 30, 1000, 2000)))
    row = spark.range(1).select(b.alias("b"), geometry.iou(b, b).alias("iou"), geometry.contains(b, b).alias("in")).collect()[0]
    assert [round(x, 4) for x in row["b"]] == [0.1, 0.1, 0.05, 0.015] and round(row["iou"], 6) == 1.0 and row["in"]


def test_texts_that_fit_nowhere_are_unreadable(spark):
    texts = ["Acct 1234567890123456 ref 98765432101234", "9" * 24, "9" * 30 + ".5", "12345678901234567890.12", "\t-5.00"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(
        "i", money.amount_structured(F.col("t")).alias("s"), money.amount_verbatim(F.col("t")).alias("v"),
        money.amount_citation(F.col("t")).alias("c"), money.line_amount(F.col("t")).alias("l")).orderBy("i").collect()
    assert [r["v"] for r in rows] == [0, 0, 0, 0, -500] and [r["c"] for r in rows] == [0, 0, 0, 0, 500]
    assert [r["l"] for r in rows] == [None, None, None, None, -500] and rows[1]["s"] is None


def test_a_quote_inside_a_field_is_a_character(spark):
    content = 'Name,Debit\n5" pipe,1.00\n"a ""b"", c",2.00\n6" pipe,3.00\n'
    rows = csv_rows(spark.createDataFrame([("d", content)], "document_id string, content string")).orderBy("row_no").collect()
    assert [r["values"] for r in rows] == [['5" pipe', "1.00"], ['a "b", c', "2.00"], ['6" pipe', "3.00"]]


def test_answers_keep_their_objects_next_to_other_items(spark):
    answer = '[{"amount_raw":"$1.00"},5,"x",null,{"amount_raw":"$2.00"}]'
    rows = model_rows_to_entities(spark.createDataFrame([("d", answer)], "document_id string, answer string")).collect()
    assert sorted(r["amount_cents"] for r in rows) == [100, 200]


def test_first_of_equal_template_codes_wins(spark):
    from ledgermatch.operators.review import apply_coa_template
    accounts = '[{"account_code":"10","account_name":"Zeta","account_type":"asset"},{"account_code":"10","account_name":"Alpha","account_type":"asset"},' \
        '{"account_code":"","account_name":"No code","account_type":"asset"},{"account_code":"20","account_name":"Odd","account_type":"other"},{"account_code":"30","account_name":"Had","account_type":"equity"}]'
    got = apply_coa_template(spark.createDataFrame([("b", "30")], "client_book_id string, account_code string"),
                             spark.createDataFrame([("t", accounts)], "template_id string, accounts string"),
                             spark.createDataFrame([("b", "t")], "client_book_id string, template_id string")).collect()
    assert [(r["account_code"], r["account_name"]) for r in got] == [("10", "Zeta")]


def test_resolution_time_is_exact_to_the_second(spark):
    rows = [("b", dt.datetime(2024, 5, 1, 8, 0, 0), dt.datetime(2024, 5, 1, 8, 0, 30)), ("b", dt.datetime(2024, 5, 1), dt.datetime(2024, 5, 2))]
    got = R.avg_resolution_seconds(spark.createDataFrame(rows, "client_book_id string, created_on timestamp, reviewed_on timestamp"),
                                   spark.createDataFrame([("b", "f")], "id string, firm_id string"), "2024-05-10").collect()
    assert [tuple(r) for r in got] == [("f", 43215.0)]


def test_codes_outside_the_lists_are_found_in_every_table(spark):
    from ledgermatch.operators import lists as L
    tables = {name: spark.createDataFrame([("good", *(v[0] for v in rules.values())), ("bad", *("?" for _ in rules)), ("none", *(None for _ in rules))],
                                          "id string, " + ", ".join(f"{col} string" for col in rules)) for name, rules in L.STORED_ENUMS.items()}
    got = {tuple(r) for r in L.stored_violations(tables).collect()}
    assert got == {(name, "bad", col, "?") for name, rules in L.STORED_ENUMS.items() for col in rules}


def test_scope_of_a_user_is_a_partition_filter(spark, tmp_path):
    from ledgermatch.operators import lists as L
    rows = spark.range(4000).select("id", F.concat(F.lit("b"), (F.col("id") % 200).cast("string")).alias("client_book_id"))
    stored = L.store_by_book(rows, str(tmp_path / "stored"))
    visible = spark.createDataFrame([("u1", "b7"), ("u1", "b8"), ("u2", "b9")], "user_id string, client_book_id string")
    visible.write.parquet(str(tmp_path / "visible"))
    scope = L.tenant_scope(stored, spark.read.parquet(str(tmp_path / "visible")), ["u1"])
    assert {r["client_book_id"] for r in scope.collect()} == {"b7", "b8"} and scope.count() == 40
    assert "dynamicpruning" in scope._jdf.queryExecution().executedPlan().toString()
    plain = L.tenant_scope(rows, visible, ["u2"])
    assert plain.count() == 20 and "dynamicpruning" not in plain._jdf.queryExecution().executedPlan().toString()
