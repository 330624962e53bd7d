"""The reconciliation data model, derived from the order/event tables the queries are tested on.

Each entry is plain SQL in the subset Spark and DuckDB share; ``{name}`` refers to a raw table or to
another entry. Spark resolves the references to DataFrames (nothing is registered in the catalog),
the correctness check turns the same entries into common table expressions.

The derivation is data preparation only. The operators under test are DataFrame code elsewhere in
the package and have separately written SQL counterparts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

MODEL: dict[str, str] = {
    # ---- tenancy -------------------------------------------------------------------------------
    "books": """
        SELECT DISTINCT concat_ws('-', CAST(c_nationkey AS STRING), c_mktsegment) AS id,
               r_name AS firm_id,
               concat_ws(' ', n_name, c_mktsegment) AS client_name,
               CAST(1 + 99 * (c_nationkey % 4) AS BIGINT) AS tolerance_cents,
               CAST(0.85 AS DOUBLE) AS auto_link_threshold,
               CAST(0.50 AS DOUBLE) AS review_floor,
               CASE c_nationkey % 3 WHEN 0 THEN 'fixed' WHEN 1 THEN 'percentage'
                    ELSE 'greater_of' END AS tolerance_mode,
               CAST(c_nationkey % 5 AS INT) AS tolerance_permille
        FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey
        JOIN {region} ON r_regionkey = n_regionkey""",
    "users": """
        SELECT concat('u', CAST(c_custkey AS STRING)) AS id, r_name AS firm_id,
               CASE WHEN c_custkey % 50 = 0 THEN 'firm_admin' ELSE 'staff' END AS role,
               concat_ws('-', CAST(c_nationkey AS STRING), c_mktsegment) AS home_book,
               c_custkey AS seq
        FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey
        JOIN {region} ON r_regionkey = n_regionkey""",
    "assignments": """
        SELECT id AS user_id, home_book AS client_book_id FROM {users}
        WHERE role = 'staff' AND seq % 7 <> 0""",
    # ---- transactions --------------------------------------------------------------------------
    "sales": """
        SELECT o_orderkey AS k, o_custkey AS custkey,
               concat_ws('-', CAST(c_nationkey AS STRING), c_mktsegment) AS book,
               CAST(1 + 99 * (c_nationkey % 4) AS BIGINT) AS tol,
               CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
               CAST(o_orderdate AS DATE) AS d,
               concat_ws(' ', p_name, p_type) AS vendor
        FROM {orders} JOIN {customer} ON c_custkey = o_custkey
        JOIN {part} ON p_partkey = o_custkey % (SELECT count(*) FROM {part})""",
    "invoices": """
        SELECT concat('i', CAST(k AS STRING)) AS id, book AS client_book_id, k AS seq,
               'invoice_line_item' AS entity_type,
               CASE WHEN k % 29 = 0 THEN 'credit_note' WHEN k % 31 = 0 THEN 'void'
                    ELSE 'standard' END AS entity_subtype,
               CASE WHEN k % 29 = 0 THEN -cents ELSE cents END AS amount_cents,
               CASE WHEN k % 211 = 3 THEN NULL ELSE d END AS transaction_date,
               CASE WHEN k % 97 = 5 AND k % 211 <> 3 THEN NULL ELSE vendor END AS counterparty,
               CASE k % 9 WHEN 0 THEN concat('Credit memo ', vendor)
                          WHEN 1 THEN concat('refund of ', vendor)
                          WHEN 2 THEN concat('Reversed entry ', vendor)
                          ELSE concat('Order of ', vendor) END AS description,
               CAST(NULL AS STRING) AS debit_or_credit,
               CAST(NULL AS STRING) AS gl_account_code,
               concat('INV-', CAST(k AS STRING)) AS transaction_ref
        FROM {sales}""",
    "weekly_payments": """
        SELECT custkey, book, CAST(date_trunc('week', d) AS DATE) AS wk,
               CAST(sum(CASE WHEN k % 29 = 0 THEN -cents ELSE cents END) AS BIGINT) AS total,
               max(d) AS paid, min(vendor) AS vendor, min(k) AS seq
        FROM {sales}
        WHERE k % 31 <> 0 AND k % 97 <> 5 AND k % 211 <> 3
        GROUP BY custkey, book, CAST(date_trunc('week', d) AS DATE)
        HAVING count(*) BETWEEN 2 AND 5""",
    "bank_rows": """
        SELECT concat('b', CAST(k AS STRING)) AS id, k AS seq, book, vendor, k % 3 AS style,
               CASE WHEN k % 29 = 0 THEN cents
                    WHEN k % 10 = 7 THEN -(cents + 5 * tol) ELSE -cents END AS amount_cents,
               CASE WHEN k % 223 = 3 THEN NULL ELSE d + CAST(k % 17 AS INT) END AS dt
        FROM {sales} WHERE k % 11 <> 0 AND k % 10 <> 3
        UNION ALL
        SELECT concat('b', CAST(k AS STRING), 'x'), k, book, vendor, k % 3,
               -CAST(floor(cents / 2.0) AS BIGINT), d + CAST(k % 17 AS INT)
        FROM {sales} WHERE k % 11 <> 0 AND k % 10 = 3
        UNION ALL
        SELECT concat('b', CAST(k AS STRING), 'y'), k, book, vendor, k % 3,
               -(cents - CAST(floor(cents / 2.0) AS BIGINT)), d + CAST(k % 17 + 2 AS INT)
        FROM {sales} WHERE k % 11 <> 0 AND k % 10 = 3
        UNION ALL
        SELECT concat('bm', CAST(seq AS STRING)), seq, book, vendor, 1, -total, paid
        FROM {weekly_payments}""",
    "banks": """
        SELECT id, book AS client_book_id, seq, 'bank_transaction' AS entity_type,
               'standard' AS entity_subtype, CAST(amount_cents AS BIGINT) AS amount_cents,
               dt AS transaction_date,
               CASE WHEN seq % 89 = 5 AND seq % 223 <> 3 THEN NULL
                    WHEN style = 0 THEN concat(upper(vendor), '.')
                    ELSE upper(vendor) END AS counterparty,
               concat('PAYMENT ', upper(vendor)) AS description,
               CAST(NULL AS STRING) AS debit_or_credit,
               CAST(NULL AS STRING) AS gl_account_code,
               concat('TXN', id) AS transaction_ref
        FROM {bank_rows}""",
    "gls": """
        SELECT concat('g', CAST(k AS STRING)) AS id, book AS client_book_id, k AS seq,
               'gl_entry' AS entity_type,
               CASE WHEN k % 23 = 0 THEN 'void' ELSE 'standard' END AS entity_subtype,
               CAST(CASE WHEN k % 29 = 0 THEN -cents
                    WHEN k % 30 = 9 THEN cents + 5 * tol
                    WHEN k % 30 = 19 THEN cents + 50 * tol
                    WHEN k % 30 = 29 THEN cents + 5000 * tol ELSE cents END AS BIGINT) AS amount_cents,
               d + CAST(k % 19 AS INT) AS transaction_date,
               CASE WHEN k % 101 = 7 THEN NULL ELSE vendor END AS counterparty,
               concat('JE ', vendor) AS description,
               CASE WHEN k % 2 = 0 THEN 'debit' ELSE 'credit' END AS debit_or_credit,
               CASE k % 8 WHEN 0 THEN '1000' WHEN 1 THEN '1100' WHEN 2 THEN '2000' WHEN 3 THEN '4000'
                    WHEN 4 THEN '5000' WHEN 5 THEN 'Main Checking' WHEN 6 THEN 'Accounts Payable'
                    ELSE '9999' END AS gl_account_code,
               concat('JE-', CAST(k AS STRING)) AS transaction_ref
        FROM {sales} WHERE k % 13 <> 0
        UNION ALL
        SELECT concat('gm', CAST(seq AS STRING)), book, seq, 'gl_entry', 'standard', total, paid,
               vendor, concat('JE ', vendor), 'debit', '2000', concat('JEM-', CAST(seq AS STRING))
        FROM {weekly_payments}""",
    "entities": """
        SELECT id, client_book_id, seq,
               concat(client_book_id, '/', substr(entity_type, 1, 1), CAST(seq % 50 AS STRING))
                   AS source_document_id,
               entity_type, entity_subtype, amount_cents, 'USD' AS currency, debit_or_credit,
               transaction_date, counterparty, description, gl_account_code, transaction_ref,
               CAST(1 + seq % 3 AS INT) AS page_number,
               (seq % 90) / 100.0e0 AS box_x, (seq % 80) / 100.0e0 AS box_y,
               CAST(0.1 AS DOUBLE) AS box_w, CAST(0.05 AS DOUBLE) AS box_h,
               CASE WHEN seq % 4 = 0 THEN 'ocr' ELSE 'structured' END AS source_format,
               (90 + seq % 11) / 100.0e0 AS extraction_confidence,
               seq * 7919 % 1000003 AS arrival
        FROM (SELECT * FROM {invoices} UNION ALL SELECT * FROM {banks}
              UNION ALL SELECT * FROM {gls}) u""",
    # ---- stored groups (what earlier link runs and reviewers left behind) ------------------------
    "groups": """
        SELECT concat('grp', CAST(k AS STRING)) AS id, book AS client_book_id, k AS seq,
               (50 + k % 51) / 100.0e0 AS link_confidence,
               CASE WHEN k % 17 = 0 THEN 'rejected' WHEN k % 19 = 0 THEN 'superseded'
                    WHEN k % 5 = 0 THEN 'needs_review' WHEN k % 7 = 0 THEN 'confirmed'
                    ELSE 'auto_linked' END AS status,
               DATE '2024-01-01' + CAST(k % 31 AS INT) AS created_on
        FROM {sales} WHERE k % 4 <> 3 AND (k % 11 <> 0 OR k % 13 <> 0)""",
    "members": """
        SELECT concat('grp', CAST(e.seq AS STRING)) AS reconciliation_group_id,
               e.id AS extracted_entity_id,
               CASE e.entity_type WHEN 'invoice_line_item' THEN 'invoice'
                    WHEN 'bank_transaction' THEN 'bank' ELSE 'gl' END AS role
        FROM {entities} e
        WHERE e.seq % 4 <> 3 AND (e.seq % 11 <> 0 OR e.seq % 13 <> 0)
          AND substr(e.id, 2, 1) <> 'm'
          AND NOT (e.entity_type = 'invoice_line_item' AND e.seq % 6 = 1)""",
    "finding_lifecycle": """
        SELECT id AS reconciliation_group_id,
               CASE seq % 4 WHEN 0 THEN 'resolved' WHEN 1 THEN 'acknowledged' ELSE 'open' END AS status,
               created_on,
               CASE WHEN seq % 4 = 0 THEN created_on + CAST(seq % 9 AS INT) END AS reviewed_on
        FROM {groups}""",
    # ---- periods and requests --------------------------------------------------------------------
    "periods": """
        SELECT concat(book, ':', CAST(CAST(date_trunc('month', d) AS DATE) AS STRING)) AS id,
               book AS client_book_id,
               CAST(date_trunc('month', min(d)) AS DATE) AS period_start,
               CAST(last_day(min(d)) AS DATE) AS period_end,
               CASE WHEN min(k) % 3 = 0 THEN 'pending_close' WHEN min(k) % 3 = 1 THEN 'closed'
                    ELSE 'open' END AS status
        FROM {sales}
        GROUP BY book, CAST(date_trunc('month', d) AS DATE)""",
    "requests": """
        SELECT concat('r', CAST(event_id AS STRING)) AS id,
               concat_ws('-', CAST(c_nationkey AS STRING), c_mktsegment) AS client_book_id,
               concat(concat_ws('-', CAST(c_nationkey AS STRING), c_mktsegment), ':',
                      CAST(CAST(date_trunc('month', DATE '1996-01-15' + CAST(event_id % 1500 AS INT)) AS DATE)
                           AS STRING)) AS reconciliation_period_id,
               CASE WHEN event_type = 'purchase' THEN 'invoice' WHEN event_type = 'error' THEN 'gl_export'
                    ELSE 'bank_statement' END AS requested_doc_type,
               CASE event_id % 5 WHEN 0 THEN 'fulfilled' WHEN 1 THEN 'waived' ELSE 'pending' END AS status,
               CAST(ts AS DATE) AS requested_on,
               CAST(event_id % 5 AS INT) AS reminder_sent_count
        FROM {events} JOIN {customer} ON c_custkey = user_id""",
    # ---- dimensions ------------------------------------------------------------------------------
    "accounts": """
        SELECT b.id AS client_book_id, a.account_code, a.account_name, a.account_type,
               a.account_type <> 'equity' AS is_reconcilable
        FROM {books} b JOIN (
          SELECT DISTINCT CASE p_size % 6 WHEN 0 THEN '1000' WHEN 1 THEN '1100' WHEN 2 THEN '2000'
                   WHEN 3 THEN '4000' WHEN 4 THEN '3000' ELSE '5000' END AS account_code,
                 CASE p_size % 6 WHEN 0 THEN 'Cash' WHEN 1 THEN 'Accounts Receivable'
                   WHEN 2 THEN 'Accounts Payable' WHEN 3 THEN 'Sales' WHEN 4 THEN 'Equity'
                   ELSE 'Supplies' END AS account_name,
                 CASE p_size % 6 WHEN 0 THEN 'asset' WHEN 1 THEN 'asset' WHEN 2 THEN 'liability'
                   WHEN 3 THEN 'revenue' WHEN 4 THEN 'equity' ELSE 'expense' END AS account_type,
                 p_size % 6 AS n
          FROM {part}) a ON (length(b.id) + a.n) % 5 <> 0""",
    "aliases": """
        SELECT DISTINCT book AS client_book_id, concat(upper(vendor), '.') AS alias,
               vendor AS canonical_name
        FROM {sales} WHERE custkey % 2 = 0""",
    "devices": """
        SELECT concat('ExponentPushToken', CAST(s_suppkey AS STRING),
                      CASE WHEN s_suppkey % 9 = 0 THEN ' x' ELSE '[abcdef]' END) AS token,
               r_name AS firm_id,
               DATE '2023-10-01' + CAST(s_suppkey % 120 AS INT) AS last_seen_on
        FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey
        JOIN {region} ON r_regionkey = n_regionkey""",
    "subscriptions": """
        SELECT concat('s', CAST(s_suppkey AS STRING)) AS id, r_name AS firm_id,
               CASE s_suppkey % 3 WHEN 0 THEN 'click,view' WHEN 1 THEN 'purchase' ELSE 'error,purchase'
                    END AS event_types_csv,
               s_suppkey % 8 <> 0 AS enabled, s_suppkey AS seq
        FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey
        JOIN {region} ON r_regionkey = n_regionkey""",
    "deliveries": """
        SELECT event_id AS delivery_id, concat('s', CAST(user_id % 100 AS STRING)) AS subscription_id,
               event_type, event_type = 'error' AND event_id % 40 = 0 AS failed, ts AS delivered_at
        FROM {events}""",
}

_REF = re.compile(r"\{([a-z]\w*)\}")


def references(sql: str) -> list[str]:
    return list(dict.fromkeys(_REF.findall(sql)))


class Model:
    """Lazily resolved DataFrames of the model for one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._seen = spark, folder.rstrip("/"), {}

    def __getattr__(self, name: str) -> DataFrame:
        return self.table(name)

    def table(self, name: str) -> DataFrame:
        if name not in self._seen:
            if name in TABLES:
                df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                sql = MODEL[name]
                df = self.spark.sql(sql, **{dep: self.table(dep) for dep in references(sql)})
            self._seen[name] = df
        return self._seen[name]


def with_model(query: str, extra: dict[str, str] | None = None) -> str:
    """A self-contained DuckDB statement: ``{name}`` references become common table expressions."""
    pool, order = {**MODEL, **(extra or {})}, []

    def visit(sql: str) -> None:
        for dep in references(sql):
            if dep in pool and dep not in order:
                visit(pool[dep])
                if dep not in order:
                    order.append(dep)

    visit(query)
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({_REF.sub(r'\1', pool[n])})" for n in order)
    body = _REF.sub(r"\1", query)
    return f"WITH {ctes}\n{body}" if ctes else body
