"""Verification, list, period, report and dashboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgermatch.operators import lists as L
from ledgermatch.operators import periods as PD
from ledgermatch.operators import reports as R
from ledgermatch.operators import verify as V
from ledgermatch.operators.candidates import unmatched_entities
from ledgermatch.operators.candidates import member_rows
from ledgermatch.plans.close import close_periods
from ledgermatch.plans.link import link_book
from ledgermatch.plans.registry import SHARED_SQL, query
from ledgermatch.session import materialise, scratch_path
from ledgermatch.sources.sinks import persist_findings, persist_groups

c = F.col
AS_OF = "2024-02-10"
RULE = '{"rule":"gl_reconciliation","bands":[1,10,100]}'
START, END = "1998-03-01", "1998-05-31"

_SEVERITY_SQL = """CASE WHEN {v} <= {t} THEN 'info' WHEN {v} <= {t} * 10 THEN 'low'
    WHEN {v} <= {t} * 100 THEN 'medium' ELSE 'high' END"""


def _verdict(totals: str, label: str) -> str:
    shown = ", ".join(f"CASE WHEN has_{x} THEN {x}_total ELSE 0 END" for x in ("invoice", "bank", "gl"))
    return f"""SELECT client_book_id, reconciliation_group_id, 'gl_reconciliation' AS rule_id,
        substr(sha256('{RULE}'), 1, 16) AS rule_version, variance_cents AS calculated_variance_cents, tolerance_cents,
        variance_cents > tolerance_cents AS exceeds_tolerance,
        printf('%s: invoice=%d.00, bank=%d.00, gl=%d.00, variance=%d.00, tolerance=%d', {label}, {shown},
               variance_cents, tolerance_cents) AS calculation_formula,
        {_SEVERITY_SQL.format(v='variance_cents', t='tolerance_cents')} AS severity
        FROM ({totals}) verdicts"""


_VARIANCE = """SELECT *, coalesce(greatest(variance_invoice_bank, variance_invoice_gl, variance_bank_gl), 0) AS variance_cents
    FROM (SELECT *, CASE WHEN has_invoice AND has_bank THEN abs(abs(invoice_total) - abs(bank_total)) END AS variance_invoice_bank,
        CASE WHEN has_invoice AND has_gl THEN abs(abs(invoice_total) - abs(gl_total)) END AS variance_invoice_gl,
        CASE WHEN has_bank AND has_gl THEN abs(abs(bank_total) - abs(gl_total)) END AS variance_bank_gl
        FROM {%s}) gaps"""


def _totals(rows: str) -> str:
    sums = ", ".join(
        f"CAST(coalesce(sum(amount_cents) FILTER (WHERE role = '{r}'), 0) AS BIGINT) AS {r}_total, "
        f"coalesce(bool_or(role = '{r}'), false) AS has_{r}" for r in ("invoice", "bank", "gl"))
    return f"""SELECT client_book_id, reconciliation_group_id, tolerance_cents, {sums}
        FROM {{{rows}}} GROUP BY client_book_id, reconciliation_group_id, tolerance_cents"""


SHARED_SQL.update({
    "group_rows": """SELECT g.client_book_id, g.id AS reconciliation_group_id, e.id AS extracted_entity_id, m.role,
        e.amount_cents, b.tolerance_cents FROM {groups} g JOIN {members} m ON m.reconciliation_group_id = g.id
        JOIN {entities} e ON e.id = m.extracted_entity_id JOIN {books} b ON b.id = g.client_book_id""",
    "leg_totals": _totals("group_rows"),
    "variances": _VARIANCE % "leg_totals",
    "findings": f"""SELECT f.*, l.status, l.created_on, l.reviewed_on
        FROM ({_verdict('SELECT * FROM {variances}', "'Group ' || reconciliation_group_id")}) f
        JOIN {{finding_lifecycle}} l USING (reconciliation_group_id)""",
    "linked_rows": """SELECT l.client_book_id, l.id AS reconciliation_group_id, e.amount_cents, b.tolerance_cents,
        CASE e.entity_type WHEN 'invoice_line_item' THEN 'invoice' WHEN 'bank_transaction' THEN 'bank' ELSE 'gl' END AS role
        FROM {linked} l JOIN {cand_members} m USING (id) JOIN {entities} e ON e.id = m.eid
        JOIN {books} b ON b.id = l.client_book_id WHERE l.status IS NOT NULL""",
    "linked_totals": _totals("linked_rows"),
    "open_findings": "SELECT f.*, b.firm_id FROM {findings} f JOIN {books} b ON b.id = f.client_book_id WHERE f.status = 'open'",
    "due": f"""SELECT *, created_on + CAST(d + (2 * d) // 7 AS INT) < TIMESTAMP '{AS_OF} 00:00:00' AS late
        FROM (SELECT *, CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 7 WHEN 'low' THEN 30 ELSE 0 END AS d
              FROM {{open_findings}}) o""",
    "severities": "SELECT unnest(['info', 'low', 'medium', 'high']) AS severity",
    "firms": "SELECT DISTINCT firm_id FROM {books}",
    "baseline_periods": f"""SELECT * FROM {{periods}} WHERE period_end <= DATE '{END}'
        QUALIFY row_number() OVER (PARTITION BY client_book_id ORDER BY period_end DESC, id) <= 6""",
    "citations": """SELECT f.reconciliation_group_id, f.rule_id, f.rule_version, m.extracted_entity_id, e.source_document_id,
        e.page_number, e.box_x, e.box_y, e.box_w, e.box_h
        FROM {findings} f JOIN {members} m USING (reconciliation_group_id) JOIN {entities} e ON e.id = m.extracted_entity_id
        QUALIFY row_number() OVER (PARTITION BY f.reconciliation_group_id
            ORDER BY CASE m.role WHEN 'invoice' THEN 0 WHEN 'bank' THEN 1 ELSE 2 END, m.extracted_entity_id) = 1""",
    "period_findings": f"""SELECT * FROM {{findings}} WHERE reconciliation_group_id IN (
        SELECT reconciliation_group_id FROM {{members}} m JOIN {{entities}} e ON e.id = m.extracted_entity_id
        WHERE e.transaction_date >= DATE '{START}' AND e.transaction_date < DATE '{END}' + 1)""",
    "reports": """SELECT 'report:' || period_id AS id, client_book_id, period_id, period_start, period_end,
        list(gid ORDER BY created_on DESC, gid) AS finding_ids
        FROM (SELECT DISTINCT f.client_book_id, f.reconciliation_group_id AS gid, f.created_on, p.id AS period_id,
                     p.period_start, p.period_end
              FROM {findings} f JOIN {members} m USING (reconciliation_group_id)
              JOIN {entities} e ON e.id = m.extracted_entity_id
              JOIN {periods} p ON p.client_book_id = e.client_book_id
               AND e.transaction_date BETWEEN p.period_start AND p.period_end) d
        GROUP BY client_book_id, period_id, period_start, period_end""",
})


def _rows(m):
    return V.group_members(m.groups, m.members, m.entities, m.books)


def _findings(m):
    return V.evaluate_groups(V.group_leg_totals(_rows(m)), rule=RULE).join(m.finding_lifecycle, "reconciliation_group_id")


def _reports(m, findings=None):
    return R.monthly_reports(_findings(m) if findings is None else findings, m.members, m.entities, m.periods)


# ---- the whole chain ----------------------------------------------------------------------------
@query("reconcile_books", f"""SELECT client_book_id, severity, count(*) AS findings,
    CAST(sum(calculated_variance_cents) AS BIGINT) AS variance_cents
    FROM ({_verdict(_VARIANCE % 'linked_totals', "reconciliation_group_id")}) f GROUP BY client_book_id, severity""")
def _(m):
    members = member_rows(link_book(m.entities, m.books), "id").join(
        m.entities.select(c("id").alias("extracted_entity_id"), "amount_cents"), "extracted_entity_id")
    rows = (members.withColumnRenamed("id", "reconciliation_group_id")
            .join(m.books.select(c("id").alias("client_book_id"), "tolerance_cents"), "client_book_id"))
    return V.evaluate_groups(V.group_leg_totals(rows), rule=RULE).groupBy("client_book_id", "severity").agg(
        F.count("*").alias("findings"), F.sum("calculated_variance_cents").alias("variance_cents"))


# ---- verification -------------------------------------------------------------------------------
@query("group_members", "SELECT * FROM {group_rows}")
def _(m):
    return _rows(m)


@query("group_leg_totals", "SELECT * FROM {leg_totals}")
def _(m):
    return V.group_leg_totals(_rows(m))


@query("three_way_variance", "SELECT * FROM {variances}")
def _(m):
    return V.three_way_variance(V.group_leg_totals(_rows(m)))


@query("two_set_variance", """SELECT reconciliation_group_id, CAST(abs(coalesce(sum(amount_cents) FILTER (WHERE role = 'bank'), 0)
    - coalesce(sum(amount_cents) FILTER (WHERE role <> 'bank'), 0)) AS BIGINT) AS variance_cents
    FROM {group_rows} GROUP BY reconciliation_group_id""")
def _(m):
    return V.two_set_variance(_rows(m), "reconciliation_group_id", c("role") == "bank", c("amount_cents"))


@query("tolerance_greater_of", """SELECT e.id, CAST(round_even(greatest(CAST(tolerance_cents AS DECIMAL(30, 4)),
    CAST(tolerance_permille * abs(amount_cents) AS DECIMAL(30, 4)) / 1000), 0) AS BIGINT) AS tolerance_cents
    FROM {entities} e JOIN {books} b ON b.id = e.client_book_id""")
def _(m):
    b = m.books.select(c("id").alias("client_book_id"), "tolerance_cents", "tolerance_permille")
    share = c("tolerance_permille").cast("decimal(10,0)") / F.lit(1000).cast("decimal(10,0)")
    units = F.abs("amount_cents").cast("decimal(18,0)") / F.lit(100).cast("decimal(10,0)")
    return m.entities.join(b, "client_book_id").select(
        "id", V.tolerance_greater_of(c("tolerance_cents"), share, units).alias("tolerance_cents"))


@query("tolerance_check", """SELECT reconciliation_group_id, variance_cents > tolerance_cents AS exceeds FROM {variances}""")
def _(m):
    return V.three_way_variance(V.group_leg_totals(_rows(m))).select(
        "reconciliation_group_id", V.tolerance_check(c("variance_cents"), c("tolerance_cents")).alias("exceeds"))


@query("severity", f"""SELECT reconciliation_group_id, {_SEVERITY_SQL.format(v='variance_cents', t='tolerance_cents')} AS severity
    FROM {{variances}}""")
def _(m):
    spark = m.spark
    bands = spark.createDataFrame([(s, u) for s, u in V.SEVERITY_BANDS], "severity string, upto long")
    return V.severity_from_table(V.three_way_variance(V.group_leg_totals(_rows(m))), bands).select(
        "reconciliation_group_id", "severity")


@query("evaluate_groups", "SELECT * EXCLUDE (status, created_on, reviewed_on) FROM {findings}")
def _(m):
    return V.evaluate_groups(V.group_leg_totals(_rows(m)), rule=RULE)


@query("evaluate_single", _verdict("SELECT * FROM {variances}", "'GL Reconciliation'"))
def _(m):
    return V.evaluate_single(V.group_leg_totals(_rows(m)), rule=RULE)


@query("variance_formula_text", "SELECT reconciliation_group_id, calculation_formula FROM {findings}")
def _(m):
    return _findings(m).select("reconciliation_group_id", "calculation_formula")


@query("rule_version", "SELECT doc_id, substr(sha256(text), 1, 16) AS rule_version FROM documents")
def _(m):
    return m.documents.select("doc_id", V.rule_version(c("text")).alias("rule_version"))


@query("persist_findings", """SELECT reconciliation_group_id, severity FROM {findings}""")
def _(m):
    path, found = scratch_path(m.spark), _findings(m).select("reconciliation_group_id", "severity")
    first = found.filter(F.pmod(F.substring("reconciliation_group_id", 4, 20).cast("long"), F.lit(3)) == 0)
    persist_findings(first, path)
    persist_findings(found, path)  # adds the rest
    persist_findings(found, path)  # a replay adds nothing
    return m.spark.read.schema(found.schema).parquet(path)


@query("persist_groups", """SELECT reconciliation_group_id, extracted_entity_id, role FROM {members}
    WHERE reconciliation_group_id IN (SELECT reconciliation_group_id FROM {leg_totals} WHERE has_bank AND has_gl)""")
def _(m):
    ids = [F.collect_list(F.when(c("role") == r, c("extracted_entity_id"))).alias(f"{r}_ids") for r in ("invoice", "bank", "gl")]
    groups = materialise(m.members.groupBy(c("reconciliation_group_id").alias("id")).agg(*ids)
                         .join(m.groups.select("id", "client_book_id", "link_confidence", "status"), "id"))
    heads, rows = scratch_path(m.spark), scratch_path(m.spark)
    half = groups.filter(F.pmod(F.xxhash64("id"), F.lit(2)) == 0)
    persist_groups(half, heads, rows)
    persist_groups(groups, heads, rows)  # adds the rest
    persist_groups(groups, heads, rows)  # a replay adds nothing
    return m.spark.read.schema("reconciliation_group_id string, extracted_entity_id string, role string").parquet(rows)


# ---- lists --------------------------------------------------------------------------------------
@query("list_entities", """SELECT id, client_book_id, entity_type, amount_cents,
    coalesce(transaction_date, DATE '1970-01-01') AS transaction_date FROM {entities}
    WHERE entity_type = 'bank_transaction' AND transaction_date >= DATE '1996-01-01' AND source_format = 'structured'
    QUALIFY row_number() OVER (PARTITION BY client_book_id ORDER BY transaction_date DESC NULLS LAST, id) <= 100""")
def _(m):
    return L.list_entities(m.entities, "bank_transaction", "1996-01-01", None, "structured").select(
        "id", "client_book_id", "entity_type", "amount_cents", "transaction_date")


@query("list_findings", """SELECT client_book_id, reconciliation_group_id, severity, status FROM {findings}
    WHERE status = 'open' QUALIFY row_number() OVER (PARTITION BY client_book_id
        ORDER BY created_on DESC, reconciliation_group_id) <= 25""")
def _(m):
    return L.list_findings(_findings(m), status="open").select(
        "client_book_id", "reconciliation_group_id", "severity", "status")


@query("pending_entities", """SELECT e.id, e.client_book_id, e.entity_type, e.amount_cents FROM {entities} e
    LEFT JOIN (SELECT DISTINCT extracted_entity_id FROM {members}) m ON m.extracted_entity_id = e.id WHERE m.extracted_entity_id IS NULL""")
def _(m):
    return L.pending_entities(m.entities, m.members).select("id", "client_book_id", "entity_type", "amount_cents")


@query("unmatched_entities", """SELECT e.id, e.client_book_id FROM {entities} e LEFT JOIN (
        SELECT DISTINCT m.extracted_entity_id FROM {members} m JOIN {groups} g ON g.id = m.reconciliation_group_id
        WHERE g.status IN ('auto_linked', 'needs_review')) x ON x.extracted_entity_id = e.id WHERE x.extracted_entity_id IS NULL""")
def _(m):
    live = m.groups.filter(c("status").isin("auto_linked", "needs_review")).select(
        c("id").alias("reconciliation_group_id"), "client_book_id")
    return unmatched_entities(m.entities.select("id", "client_book_id"), m.members.join(live, "reconciliation_group_id"))


@query("tenant_scope", """SELECT u.id AS user_id, e.client_book_id, count(*) AS entities
    FROM (SELECT u.id, b.id AS book FROM {users} u JOIN {books} b ON b.firm_id = u.firm_id WHERE u.role = 'firm_admin'
          UNION ALL SELECT u.id, a.client_book_id FROM {users} u JOIN {assignments} a ON a.user_id = u.id
          JOIN {books} b ON b.id = a.client_book_id AND b.firm_id = u.firm_id WHERE u.role <> 'firm_admin') u
    JOIN {entities} e ON e.client_book_id = u.book GROUP BY ALL""")
def _(m):
    visible = L.visible_books(m.users, m.books, m.assignments)
    per_book = m.entities.groupBy("client_book_id").agg(F.count("*").alias("entities"))
    return visible.join(per_book, "client_book_id").select("user_id", "client_book_id", "entities")


@query("tenant_scope_rows", """SELECT e.id, e.client_book_id FROM {entities} e WHERE e.client_book_id IN (
    SELECT b.id FROM {users} u JOIN {books} b ON b.firm_id = u.firm_id
    LEFT JOIN {assignments} a ON a.user_id = u.id AND a.client_book_id = b.id
    WHERE u.id IN ('u2', 'u3', 'u9') AND (u.role = 'firm_admin' OR a.user_id IS NOT NULL))""")
def _(m):
    stored = L.store_by_book(m.entities.select("id", "client_book_id"), scratch_path(m.spark))
    visible = materialise(L.visible_books(m.users, m.books, m.assignments))
    return L.tenant_scope(stored, visible, ["u2", "u3", "u9"]).select("id", "client_book_id")


@query("exclude_void", "SELECT id FROM {entities} WHERE entity_subtype IS DISTINCT FROM 'void'")
def _(m):
    from ledgermatch.operators.passes import exclude_void
    return exclude_void(m.entities).select("id")


@query("portal_reports", """SELECT id, client_book_id, period_start, period_end, CAST(len(finding_ids) AS BIGINT) AS findings
    FROM {reports} QUALIFY row_number() OVER (PARTITION BY client_book_id ORDER BY period_end DESC, id) <= 50""")
def _(m):
    return R.portal_reports(_reports(m)).withColumn("findings", c("findings").cast("long"))


@query("portal_findings", """SELECT client_book_id, reconciliation_group_id, severity, status, rule_id, calculation_formula
    FROM {findings} QUALIFY row_number() OVER (PARTITION BY client_book_id
        ORDER BY created_on DESC, reconciliation_group_id) <= 100""")
def _(m):
    return R.portal_findings(_findings(m))


SHARED_SQL["due_reminders"] = f"""SELECT r.id, r.client_book_id, r.reconciliation_period_id, p.period_start, p.period_end,
    r.requested_doc_type, r.reminder_sent_count
    FROM {{requests}} r JOIN {{periods}} p ON p.id = r.reconciliation_period_id
    WHERE r.status = 'pending' AND r.reminder_sent_count < 3 AND p.status = 'pending_close'
      AND r.requested_on <= DATE '2024-01-25' - 5"""


@query("reminders_due", "SELECT * FROM {due_reminders}")
def _(m):
    return L.reminders_due(m.requests, m.periods, "2024-01-25").select(
        "id", "client_book_id", "reconciliation_period_id", "period_start", "period_end", "requested_doc_type",
        "reminder_sent_count")


@query("increment_reminders", """SELECT id, CAST(reminder_sent_count + CASE WHEN id IN (SELECT id FROM {due_reminders})
    THEN 1 ELSE 0 END AS INT) AS reminder_sent_count FROM {requests}""")
def _(m):
    due = L.reminders_due(m.requests, m.periods, "2024-01-25")
    return L.increment_reminders(m.requests, due).select("id", "reminder_sent_count")


@query("alertable_findings", f"""SELECT f.reconciliation_group_id, b.firm_id, d.token FROM {{findings}} f
    JOIN {{books}} b ON b.id = f.client_book_id JOIN {{devices}} d ON d.firm_id = b.firm_id
    WHERE f.severity = 'high' AND d.last_seen_on > DATE '{AS_OF}' - 90 AND length(d.token) BETWEEN 22 AND 150
      AND NOT regexp_matches(d.token, '[ \\t\\r\\n]')""")
def _(m):
    return L.alertable_findings(_findings(m), m.books, m.devices, AS_OF).select("reconciliation_group_id", "firm_id", "token")


@query("matching_subscriptions", """SELECT e.event_id, s.firm_id, s.id AS subscription_id
    FROM events e JOIN {users} u ON u.seq = e.user_id JOIN {subscriptions} s ON s.firm_id = u.firm_id AND s.enabled
     AND list_contains(string_split(s.event_types_csv, ','), e.event_type)""")
def _(m):
    ev = m.events.join(m.users.select(c("seq").alias("user_id"), "firm_id"), "user_id").select("event_id", "event_type", "firm_id")
    subs = m.subscriptions.withColumn("event_types", F.split("event_types_csv", ","))
    return L.matching_subscriptions(ev, subs).select("event_id", "firm_id", "subscription_id")


@query("enum_violations", """SELECT id, column_name, value FROM (
    SELECT id, 'entity_type' AS column_name, entity_type AS value FROM {entities}
    UNION ALL SELECT id, 'entity_subtype', CASE WHEN seq % 40 = 0 THEN 'cancelled' ELSE entity_subtype END FROM {entities}
    UNION ALL SELECT id, 'debit_or_credit', CASE WHEN seq % 41 = 0 THEN 'dr' ELSE debit_or_credit END FROM {entities}
    UNION ALL SELECT id, 'source_format', source_format FROM {entities}) v
    WHERE value IS NOT NULL AND NOT CASE column_name
      WHEN 'entity_type' THEN value IN ('invoice_line_item', 'bank_transaction', 'gl_entry')
      WHEN 'entity_subtype' THEN value IN ('standard', 'credit_note', 'refund', 'void')
      WHEN 'debit_or_credit' THEN value IN ('debit', 'credit')
      ELSE value IN ('ocr', 'structured', 'manual') END""")
def _(m):
    dirty = m.entities.withColumn("entity_subtype", F.when(c("seq") % 40 == 0, "cancelled").otherwise(c("entity_subtype"))) \
        .withColumn("debit_or_credit", F.when(c("seq") % 41 == 0, "dr").otherwise(c("debit_or_credit")))
    return L.enum_violations(dirty, L.ENUMS)


@query("stored_enum_violations", """SELECT * FROM (
    SELECT 'books' AS table_name, id, 'tolerance_mode' AS column_name, CASE WHEN tolerance_cents > 200 THEN 'none' ELSE tolerance_mode END AS value FROM {books}
    UNION ALL SELECT 'users', id, 'role', CASE WHEN right(id, 1) = '9' THEN 'guest' ELSE role END FROM {users}
    UNION ALL SELECT 'groups', id, 'status', status FROM {groups}
    UNION ALL SELECT 'members', reconciliation_group_id || ':' || extracted_entity_id, 'role', CASE WHEN right(extracted_entity_id, 1) = '7' THEN 'ledger' ELSE role END FROM {members}
    UNION ALL SELECT 'findings', reconciliation_group_id, 'status', status FROM {finding_lifecycle}
    UNION ALL SELECT 'periods', id, 'status', CASE WHEN right(id, 5) = '06-01' THEN 'locked' ELSE status END FROM {periods}
    UNION ALL SELECT 'accounts', client_book_id || ':' || account_code, 'account_type', CASE WHEN account_code = '5000' THEN 'cost' ELSE account_type END FROM {accounts}
    UNION ALL SELECT 'requests', id, 'status', CASE WHEN right(id, 1) = '3' THEN 'lost' ELSE status END FROM {requests}) v
    WHERE value IS NOT NULL AND value NOT IN ('fixed', 'percentage', 'greater_of', 'firm_admin', 'staff', 'auto_linked', 'needs_review', 'confirmed', 'rejected',
      'invoice', 'bank', 'gl', 'open', 'acknowledged', 'resolved', 'pending_close', 'closed', 'reopened', 'asset', 'liability', 'equity', 'revenue', 'expense',
      'pending', 'fulfilled', 'waived')""")
def _(m):
    def spoilt(rows, key, col, when, value):
        return rows.select(key.alias("id"), F.when(when, F.lit(value)).otherwise(c(col)).alias(col))

    own = c("id")
    return L.stored_violations({
        "books": spoilt(m.books, own, "tolerance_mode", c("tolerance_cents") > 200, "none"),
        "users": spoilt(m.users, own, "role", own.endswith("9"), "guest"),
        "groups": m.groups.select("id", "status"),
        "members": spoilt(m.members, F.concat_ws(":", "reconciliation_group_id", "extracted_entity_id"), "role", c("extracted_entity_id").endswith("7"), "ledger"),
        "findings": m.finding_lifecycle.select(c("reconciliation_group_id").alias("id"), "status"),
        "periods": spoilt(m.periods, own, "status", own.endswith("06-01"), "locked"),
        "accounts": spoilt(m.accounts, F.concat_ws(":", "client_book_id", "account_code"), "account_type", c("account_code") == "5000", "cost"),
        "requests": spoilt(m.requests, own, "status", own.endswith("3"), "lost"),
    })


@query("list_periods", "SELECT id, client_book_id, period_start, period_end, status FROM {periods}")
def _(m):
    return L.ordered(m.periods, "client_book_id", F.desc("period_start")).select(
        "id", "client_book_id", "period_start", "period_end", "status")


@query("list_document_requests", "SELECT id, client_book_id, requested_doc_type, requested_on FROM {requests} WHERE status = 'pending'")
def _(m):
    return L.ordered(m.requests.filter("status = 'pending'"), "client_book_id", F.desc("requested_on"), "id").select(
        "id", "client_book_id", "requested_doc_type", "requested_on")


@query("list_dimensions", """SELECT client_book_id, 'account' AS kind, account_code AS a, account_name AS b FROM {accounts}
    UNION ALL SELECT client_book_id, 'alias', canonical_name, alias FROM {aliases}""")
def _(m):
    a = L.ordered(m.accounts, "client_book_id", "account_code").select(
        "client_book_id", F.lit("account").alias("kind"), c("account_code").alias("a"), c("account_name").alias("b"))
    b = L.ordered(m.aliases, "client_book_id", "canonical_name", "alias").select(
        "client_book_id", F.lit("alias").alias("kind"), c("canonical_name").alias("a"), c("alias").alias("b"))
    return a.unionByName(b)


@query("report_rows", """SELECT id, client_book_id, period_start, period_end, unnest(finding_ids) AS reconciliation_group_id,
    unnest(range(len(finding_ids))) AS position, CAST(len(finding_ids) AS BIGINT) AS findings FROM {reports}""")
def _(m):
    return _reports(m)


@query("get_report", """SELECT id, client_book_id, strftime(period_start, '%Y-%m-%d') AS period_start,
    strftime(period_end, '%Y-%m-%d') AS period_end, array_to_string(finding_ids, ',') AS finding_ids FROM {reports}""")
def _(m):
    return R.get_report(_reports(m)).withColumn("finding_ids", F.concat_ws(",", "finding_ids"))


@query("bulk_confirm_candidates", "SELECT id, link_confidence FROM {groups} WHERE status = 'needs_review' AND link_confidence > 0.95")
def _(m):
    return L.bulk_confirm_candidates(m.groups).select("id", "link_confidence")


@query("review_queue", """SELECT g.id, g.client_book_id,
    coalesce(min(m.extracted_entity_id) FILTER (WHERE role = 'invoice'), '') AS invoice_entity_id,
    coalesce(min(m.extracted_entity_id) FILTER (WHERE role = 'bank'), '') AS bank_entity_id,
    coalesce(min(m.extracted_entity_id) FILTER (WHERE role = 'gl'), '') AS gl_entity_id
    FROM (SELECT * FROM {groups} WHERE status = 'needs_review'
          QUALIFY row_number() OVER (PARTITION BY client_book_id ORDER BY created_on DESC, id) <= 100) g
    LEFT JOIN {members} m ON m.reconciliation_group_id = g.id GROUP BY g.id, g.client_book_id""")
def _(m):
    return L.review_queue(m.groups, m.members).select(
        "id", "client_book_id", "invoice_entity_id", "bank_entity_id", "gl_entity_id")


SHARED_SQL["receivable_keys"] = """SELECT client_book_id, account_code AS account_key FROM {accounts} WHERE account_type IN ('asset', 'revenue')
    UNION SELECT client_book_id, account_name FROM {accounts} WHERE account_type IN ('asset', 'revenue')"""


@query("group_scope", """SELECT reconciliation_group_id, CASE WHEN count(account_key) + count_if(spoken) > 0 THEN 'ar' ELSE 'ap' END AS group_scope
    FROM (SELECT m.reconciliation_group_id, k.account_key, regexp_matches(lower(e.gl_account_code), 'checking|cash|receivable') AS spoken
          FROM {members} m JOIN {entities} e ON e.id = m.extracted_entity_id
          LEFT JOIN {receivable_keys} k ON k.client_book_id = e.client_book_id AND k.account_key = e.gl_account_code
          WHERE m.role = 'gl') t GROUP BY reconciliation_group_id""")
def _(m):
    return L.group_scope(m.members, m.entities, m.accounts)


@query("canonical_counterparty", """SELECT e.id, coalesce(a.canonical_name, e.counterparty) AS canonical FROM {entities} e
    LEFT JOIN {aliases} a ON a.client_book_id = e.client_book_id AND lower(a.alias) = lower(e.counterparty)""")
def _(m):
    return L.canonical_counterparty(m.entities, m.aliases).select("id", "canonical")


@query("superseded_entities", """SELECT id, CASE WHEN seq % 43 = 0 AND entity_type = 'bank_transaction'
    THEN 'superseded_by_manual' ELSE 'active' END AS status FROM {entities}""")
def _(m):
    fixes = m.banks.filter("seq % 43 = 0").select(F.concat(F.lit("fix-"), "id").alias("id"), c("id").alias("corrects_entity_id"))
    return L.superseded_entities(m.entities, fixes).select("id", "status")


# ---- citations and reports ----------------------------------------------------------------------
@query("finding_citation", "SELECT * FROM {citations}")
def _(m):
    return R.finding_citation(_findings(m), m.members, m.entities)


@query("report_citations", """SELECT reconciliation_group_id, source_document_id FROM {citations} WHERE reconciliation_group_id IN (
    SELECT unnest(finding_ids) FROM {reports} WHERE period_start >= DATE '1999-01-01')""")
def _(m):
    findings = materialise(_findings(m))
    reports = _reports(m, findings).filter("period_start >= date '1999-01-01'")
    return R.report_members(reports, R.finding_citation(findings, m.members, m.entities)).select(
        "reconciliation_group_id", "source_document_id")


@query("findings_in_period", "SELECT reconciliation_group_id, severity FROM {period_findings}")
def _(m):
    return R.findings_in_period(_findings(m), m.members, m.entities, START, END).select("reconciliation_group_id", "severity")


@query("period_report", f"""SELECT client_book_id, DATE '{START}' AS period_start, DATE '{END}' AS period_end,
    string_agg(reconciliation_group_id, ',' ORDER BY created_on DESC, reconciliation_group_id) AS finding_ids
    FROM {{period_findings}} GROUP BY client_book_id""")
def _(m):
    found = R.findings_in_period(_findings(m), m.members, m.entities, START, END)
    return R.period_report(found, START, END).withColumn("finding_ids", F.concat_ws(",", "finding_ids"))


@query("severity_tally", """SELECT b.client_book_id, s.severity, count(f.reconciliation_group_id) AS n
    FROM (SELECT DISTINCT client_book_id FROM {findings}) b CROSS JOIN {severities} s
    LEFT JOIN {findings} f ON f.client_book_id = b.client_book_id AND f.severity = s.severity GROUP BY ALL""")
def _(m):
    return R.severity_tally(_findings(m))


# ---- periods ------------------------------------------------------------------------------------
@query("entity_periods", """SELECT e.id, p.id AS period_id FROM {entities} e JOIN {periods} p
    ON p.client_book_id = e.client_book_id AND e.transaction_date BETWEEN p.period_start AND p.period_end""")
def _(m):
    return PD.entity_periods(m.entities, m.periods).select("id", "period_id")


SHARED_SQL["mixed_periods"] = """SELECT id, client_book_id, period_start, period_end FROM {periods}
    UNION ALL SELECT concat(client_book_id, ':q', CAST(min(period_start) AS STRING)), client_book_id,
        min(period_start), max(period_end) FROM {periods}
        GROUP BY client_book_id, year(period_start), quarter(period_start)"""


@query("overlapping_periods", """SELECT a.client_book_id, a.id AS period_a, b.id AS period_b FROM {mixed_periods} a
    JOIN {mixed_periods} b ON a.client_book_id = b.client_book_id AND a.id < b.id
     AND a.period_start <= b.period_end AND b.period_start <= a.period_end""")
def _(m):
    quarters = m.periods.groupBy("client_book_id", F.year("period_start"), F.quarter("period_start")).agg(
        F.min("period_start").alias("s"), F.max("period_end").alias("e")).select(
        F.concat("client_book_id", F.lit(":q"), c("s").cast("string")).alias("id"), "client_book_id",
        c("s").alias("period_start"), c("e").alias("period_end"))
    cols = ["id", "client_book_id", "period_start", "period_end"]
    return PD.overlapping_periods(m.periods.select(cols).unionByName(quarters.select(cols)))


SHARED_SQL["sides"] = """SELECT p.id AS period_id, e.debit_or_credit AS side, e.amount_cents AS cents
    FROM {entities} e JOIN {periods} p ON p.client_book_id = e.client_book_id AND e.transaction_date BETWEEN p.period_start AND p.period_end
    WHERE e.entity_type = 'gl_entry' AND coalesce(e.entity_subtype, '') <> 'void'"""
SHARED_SQL["balances"] = """SELECT client_book_id, id AS period_id, debits_cents, credits_cents,
      CASE WHEN coalesce(debits_cents, credits_cents) IS NOT NULL THEN debits_cents IS NOT DISTINCT FROM credits_cents END AS is_balanced
    FROM {periods} LEFT JOIN (
      SELECT period_id, nullif(CAST(debit AS BIGINT), 0) AS debits_cents, nullif(CAST(credit AS BIGINT), 0) AS credits_cents
      FROM (PIVOT {sides} ON side IN ('debit', 'credit') USING sum(cents) GROUP BY period_id)) t ON period_id = id"""


@query("trial_balance", "SELECT * FROM {balances}")
def _(m):
    return PD.trial_balance(m.entities, m.periods)


# Whole numbers all the way: means and deviations that end on half a cent must not depend on the order of addition.
SHARED_SQL["baselines"] = """SELECT client_book_id, counterparty,
        CAST(sign(s) * ((2 * abs(s) + n) // (2 * n)) AS BIGINT) AS trailing_avg_cents,
        CAST(round(sqrt(CAST(n * q - s * s AS DOUBLE)) / n) AS BIGINT) AS trailing_stddev_cents
    FROM (SELECT e.client_book_id, e.counterparty, count(*) AS n, sum(CAST(e.amount_cents AS HUGEINT)) AS s,
                 sum(CAST(e.amount_cents AS HUGEINT) * e.amount_cents) AS q
          FROM {baseline_periods} p JOIN {entities} e ON e.client_book_id = p.client_book_id
          WHERE e.transaction_date >= p.period_start AND e.transaction_date <= p.period_end
            AND e.counterparty IS NOT NULL AND coalesce(e.entity_subtype, '') <> 'void' GROUP BY ALL) t"""


@query("vendor_baselines", "SELECT * FROM {baselines}")
def _(m):
    through = m.books.select(c("id").alias("client_book_id"), F.lit(END).cast("date").alias("period_end"))
    return PD.vendor_baselines(m.entities, m.periods, through).drop("n")


SHARED_SQL["blockers"] = """SELECT p.client_book_id, p.id AS period_id, count(*) AS pending FROM {periods} p
    JOIN {requests} r ON r.reconciliation_period_id = p.id AND r.status = 'pending' GROUP BY ALL"""


@query("pending_request_blockers", "SELECT * FROM {blockers}")
def _(m):
    return PD.pending_request_blockers(m.requests, m.periods)


SHARED_SQL["period_actions"] = """SELECT reconciliation_period_id AS period_id,
        CASE WHEN CAST(substr(id, 2) AS BIGINT) % 2 = 0 THEN 'close' ELSE 'reopen' END AS action,
        CASE WHEN CAST(substr(id, 2) AS BIGINT) % 7 = 0 THEN ' ' ELSE 'late entry' END AS reason,
        CAST(substr(id, 2) AS BIGINT) AS n FROM {requests}"""


# Every period's actions as one word in order of time; the four start states rotate over the months.
SHARED_SQL["started"] = """SELECT id, client_book_id, period_start, period_end,
        CASE month(period_start) % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'pending_close' WHEN 2 THEN 'closed' ELSE 'reopened' END AS status
    FROM {periods}"""
SHARED_SQL["action_words"] = """SELECT period_id, string_agg(CASE action WHEN 'close' THEN 'C' ELSE 'R' END, '' ORDER BY n, action) AS word
    FROM {period_actions} a LEFT JOIN (SELECT period_id AS held FROM {blockers}) b ON b.held = a.period_id
    WHERE CASE action WHEN 'close' THEN b.held IS NULL ELSE trim(reason) <> '' END GROUP BY period_id"""
SHARED_SQL["states"] = """SELECT p.*, coalesce(CASE p.status
            WHEN 'open' THEN CASE WHEN regexp_matches(word, 'C.*R') THEN 'reopened' WHEN contains(word, 'C') THEN 'pending_close' END
            WHEN 'pending_close' THEN CASE WHEN contains(word, 'R') THEN 'reopened' END
            WHEN 'closed' THEN CASE WHEN contains(word, 'R') THEN 'reopened' END END, p.status) AS final,
        p.status IN ('open', 'pending_close') AND coalesce(contains(word, 'C'), false) AS touched
    FROM {started} p LEFT JOIN {action_words} w ON w.period_id = p.id"""


@query("period_state", """SELECT s.id AS period_id, s.client_book_id, s.period_start, s.period_end, final AS status,
    CASE WHEN touched AND final = 'pending_close' THEN b.debits_cents END AS debits_cents,
    CASE WHEN touched AND final = 'pending_close' THEN b.credits_cents END AS credits_cents,
    CASE WHEN touched AND final = 'pending_close' THEN b.is_balanced END AS is_balanced
    FROM {states} s LEFT JOIN {balances} b ON b.period_id = s.id""")
def _(m):
    return PD.period_state(_started(m), _period_actions(m), PD.trial_balance(m.entities, m.periods),
                           PD.pending_request_blockers(m.requests, m.periods))


def _started(m):
    states = F.array(*(F.lit(x) for x in ("open", "pending_close", "closed", "reopened")))
    return m.periods.withColumn("status", F.element_at(states, F.month("period_start") % 4 + 1))


def _period_actions(m):
    n = F.substring("id", 2, 20).cast("long")
    return m.requests.select(
        c("reconciliation_period_id").alias("period_id"), F.when(n % 2 == 0, "close").otherwise("reopen").alias("action"),
        F.when(n % 7 == 0, " ").otherwise("late entry").alias("reason"), n.alias("at"))


@query("close_period", """SELECT e.client_book_id, e.counterparty, count(*) AS n, max_by(t.through, t.period_end) AS computed_through_period_id
    FROM (SELECT client_book_id, arg_max(id, period_end) AS through, max(period_end) AS period_end FROM {states}
          WHERE touched AND final = 'pending_close' GROUP BY client_book_id) t
    JOIN (SELECT t2.client_book_id, p.period_start, p.period_end FROM {periods} p JOIN (
            SELECT client_book_id, max(period_end) AS closing FROM {states} WHERE touched AND final = 'pending_close' GROUP BY client_book_id) t2
          ON t2.client_book_id = p.client_book_id AND p.period_end <= t2.closing
          QUALIFY row_number() OVER (PARTITION BY t2.client_book_id ORDER BY p.period_end DESC, p.id) <= 6) p ON p.client_book_id = t.client_book_id
    JOIN {entities} e ON e.client_book_id = t.client_book_id AND e.transaction_date BETWEEN p.period_start AND p.period_end
    WHERE e.counterparty IS NOT NULL AND e.entity_subtype IS DISTINCT FROM 'void' GROUP BY e.client_book_id, e.counterparty
    UNION ALL SELECT b.id, 'stored only', 0, 'earlier' FROM {books} b""")
def _(m):
    stored = m.books.select(c("id").alias("client_book_id"), F.lit("stored only").alias("counterparty"), F.lit(0).cast("long").alias("n"),
                            F.lit(0).cast("long").alias("trailing_avg_cents"), F.lit(0).cast("long").alias("trailing_stddev_cents"),
                            F.lit("earlier").alias("computed_through_period_id"))
    closed = close_periods(m.entities, _started(m), _period_actions(m), m.requests, stored)
    return closed.baselines.select("client_book_id", "counterparty", "n", "computed_through_period_id")


@query("period_reopen_log", """SELECT period_id, n AS at, reason FROM (
        SELECT a.period_id, a.n, a.reason, s.status,
               (SELECT min(x.n) FROM {period_actions} x WHERE x.period_id = a.period_id AND x.action = 'close'
                AND x.period_id NOT IN (SELECT period_id FROM {blockers})) AS first_close
        FROM {period_actions} a JOIN {started} s ON s.id = a.period_id WHERE a.action = 'reopen' AND trim(a.reason) <> '') t
    WHERE status IN ('pending_close', 'closed') OR (status = 'open' AND n > first_close)
    QUALIFY row_number() OVER (PARTITION BY period_id ORDER BY n) = 1""")
def _(m):
    return PD.reopen_log(_started(m), _period_actions(m), PD.pending_request_blockers(m.requests, m.periods))


# ---- rates and dashboards -----------------------------------------------------------------------
@query("automation_rate", """SELECT b.id AS client_book_id, count(g.id) FILTER (WHERE status = 'auto_linked') AS auto_linked,
    count(g.id) FILTER (WHERE status = 'needs_review') AS needs_review, count(g.id) FILTER (WHERE status = 'confirmed') AS confirmed,
    count(g.id) AS total, coalesce(count(g.id) FILTER (WHERE status = 'auto_linked') / nullif(count(g.id), 0), 0.0e0) AS automation_rate
    FROM {books} b LEFT JOIN {groups} g ON g.client_book_id = b.id GROUP BY b.id""")
def _(m):
    return R.automation_rate(m.groups, m.books)


@query("open_findings_by_severity", """SELECT f.firm_id, s.severity, count(o.reconciliation_group_id) AS n
    FROM {firms} f CROSS JOIN {severities} s LEFT JOIN {open_findings} o ON o.firm_id = f.firm_id AND o.severity = s.severity
    GROUP BY ALL""")
def _(m):
    return R.open_findings_by_severity(_findings(m), m.books)


@query("past_due_findings", """SELECT f.firm_id, count(d.reconciliation_group_id) FILTER (WHERE late) AS past_due
    FROM {firms} f LEFT JOIN {due} d USING (firm_id) GROUP BY f.firm_id""")
def _(m):
    return R.past_due_findings(_findings(m), m.books, AS_OF)


SHARED_SQL["resolution"] = f"""SELECT b.firm_id, avg((reviewed_on - created_on) * 86400.0e0) AS avg_resolution_seconds
    FROM {{findings}} f JOIN {{books}} b ON b.id = f.client_book_id WHERE reviewed_on >= DATE '{AS_OF}' - 30 GROUP BY b.firm_id"""


@query("avg_resolution_seconds", "SELECT firm_id, round(avg_resolution_seconds, 3) AS avg_resolution_seconds FROM {resolution}")
def _(m):
    return R.avg_resolution_seconds(_findings(m), m.books, AS_OF).withColumn(
        "avg_resolution_seconds", F.round("avg_resolution_seconds", 3))


@query("book_breakdown", """SELECT b.firm_id, b.id AS client_book_id, b.client_name, count(d.reconciliation_group_id) AS open_findings,
    count(*) FILTER (WHERE late) AS past_due FROM {books} b LEFT JOIN {due} d ON d.client_book_id = b.id GROUP BY ALL""")
def _(m):
    return R.book_breakdown(_findings(m), m.books, AS_OF)


SHARED_SQL["stale"] = """SELECT f.firm_id, count(r.id) AS stale_requests FROM {firms} f LEFT JOIN {books} b ON b.firm_id = f.firm_id
    LEFT JOIN {requests} r ON r.client_book_id = b.id AND r.status = 'pending' AND reminder_sent_count >= 3 GROUP BY f.firm_id"""


@query("stale_requests", "SELECT * FROM {stale}")
def _(m):
    return R.stale_requests(m.requests, m.books)


@query("firm_dashboard", """SELECT s.firm_id, s.stale_requests, count(d.reconciliation_group_id) AS total_open,
    count(*) FILTER (WHERE severity = 'info') AS open_info, count(*) FILTER (WHERE severity = 'low') AS open_low,
    count(*) FILTER (WHERE severity = 'medium') AS open_medium, count(*) FILTER (WHERE severity = 'high') AS open_high,
    count(*) FILTER (WHERE late) AS past_due, round(any_value(r.avg_resolution_seconds), 3) AS avg_resolution_seconds
    FROM {stale} s LEFT JOIN {due} d USING (firm_id) LEFT JOIN {resolution} r USING (firm_id) GROUP BY s.firm_id, s.stale_requests""")
def _(m):
    return R.firm_dashboard(_findings(m), m.requests, m.books, AS_OF).withColumn(
        "avg_resolution_seconds", F.round("avg_resolution_seconds", 3))
