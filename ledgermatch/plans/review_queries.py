"""Reviewers' actions (M1-M11). Action tables are derived from the stored groups and the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgermatch.operators import review as V
from ledgermatch.plans.registry import SHARED_SQL, query

c = F.col
_HEAD = ["id", "client_book_id", "link_confidence", "status"]


def _groups(m):
    return m.groups.select(*_HEAD)


# every ninth group is split by leg; every eighth has one partition only, which is refused
SHARED_SQL.update({
    "splits": """SELECT m.reconciliation_group_id AS group_id, CASE WHEN g.seq % 8 = 0 THEN 1 WHEN m.role = 'gl' THEN 2 ELSE 1 END AS part,
        m.extracted_entity_id, m.role, g.client_book_id FROM {members} m JOIN {groups} g ON g.id = m.reconciliation_group_id
        WHERE g.seq % 9 = 0 OR g.seq % 8 = 0""",
    "real_splits": """SELECT *, sha256('split|' || group_id || '|' || part) AS new_id FROM {splits} WHERE group_id IN (
        SELECT group_id FROM {splits} GROUP BY group_id HAVING count(DISTINCT part) >= 2)""",
    # groups of one book and day merge when there are several of them
    "merges": """SELECT client_book_id || ':' || CAST(created_on AS VARCHAR) AS merge_id, seq AS position, id AS group_id, client_book_id
        FROM {groups} WHERE seq % 5 = 0""",
    "real_merges": """SELECT *, sha256('merge|' || merge_id) AS new_id FROM {merges} WHERE merge_id IN (
        SELECT merge_id FROM {merges} GROUP BY merge_id HAVING count(DISTINCT group_id) >= 2)""",
})


def _splits(m):
    part = F.when(c("seq") % 8 == 0, 1).when(c("role") == "gl", 2).otherwise(1)
    hit = m.groups.filter("seq % 9 = 0 or seq % 8 = 0").select(c("id").alias("reconciliation_group_id"), "seq")
    return m.members.join(hit, "reconciliation_group_id").select(
        c("reconciliation_group_id").alias("group_id"), part.alias("partition_no"), "extracted_entity_id")


def _merges(m):
    return m.groups.filter("seq % 5 = 0").select(
        F.concat("client_book_id", F.lit(":"), c("created_on").cast("string")).alias("merge_id"), c("seq").alias("position"), c("id").alias("group_id"))


@query("apply_group_splits", """SELECT id, client_book_id, link_confidence,
        CASE WHEN id IN (SELECT group_id FROM {real_splits}) THEN 'superseded' ELSE status END AS status FROM {groups}
    UNION ALL SELECT DISTINCT new_id, client_book_id, 1.0e0, 'needs_review' FROM {real_splits}""")
def _(m):
    return V.apply_group_splits(_groups(m), m.members, _splits(m))[0]


@query("split_group_members", """SELECT reconciliation_group_id, extracted_entity_id, role FROM {members}
    UNION ALL SELECT new_id, extracted_entity_id, role FROM {real_splits}""")
def _(m):
    return V.apply_group_splits(_groups(m), m.members, _splits(m))[1]


@query("apply_group_merges", """SELECT id, client_book_id, link_confidence,
        CASE WHEN id IN (SELECT group_id FROM {real_merges}) THEN 'superseded' ELSE status END AS status FROM {groups}
    UNION ALL SELECT DISTINCT new_id, client_book_id, 1.0e0, 'needs_review' FROM {real_merges}""")
def _(m):
    return V.apply_group_merges(_groups(m), m.members, _merges(m))[0]


@query("merged_group_members", """SELECT reconciliation_group_id, extracted_entity_id, role FROM {members}
    UNION ALL SELECT new_id, extracted_entity_id, arg_min(role, position) FROM {real_merges} r
      JOIN {members} m ON m.reconciliation_group_id = r.group_id GROUP BY new_id, extracted_entity_id""")
def _(m):
    return V.apply_group_merges(_groups(m), m.members, _merges(m))[1]


# one decision per event and group number; bulk ones are sometimes sent for another book
SHARED_SQL["decisions"] = """SELECT 'grp' || e.event_id % (SELECT count(*) FROM orders) AS group_id, event_id AS at_no,
        CASE event_id % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'rejected' WHEN 2 THEN 'needs_review' ELSE 'confirmed' END AS decided,
        event_id % 4 = 3 AND event_id % 3 = 0 AS foreign_book FROM events e"""


@query("apply_review_decisions", """SELECT g.id, coalesce(d.decided, g.status) AS status FROM {groups} g LEFT JOIN (
    SELECT group_id, arg_max(decided, at_no) AS decided FROM {decisions} WHERE NOT foreign_book GROUP BY group_id) d ON d.group_id = g.id""")
def _(m):
    n = c("event_id")
    action = F.when(n % 4 == 0, "confirm").when(n % 4 == 1, "reject").when(n % 4 == 2, "flag").otherwise("bulk_confirm")
    sent = m.events.select(F.concat(F.lit("grp"), (n % m.orders.count()).cast("string")).alias("group_id"), action.alias("action"), n.alias("at"),
                           ((n % 4 == 3) & (n % 3 == 0)).alias("foreign"))
    decisions = sent.join(m.groups.select(c("id").alias("group_id"), "client_book_id"), "group_id").withColumn(
        "client_book_id", F.when(c("foreign"), "elsewhere").otherwise(c("client_book_id"))).drop("foreign")
    return V.apply_review_decisions(m.groups.select("id", "client_book_id", "status"), decisions).select("id", "status")


@query("finding_status_history", """SELECT finding_id, arg_max(status, event_id) AS status,
    arg_min(user_id, event_id) FILTER (WHERE status = 'resolved') AS reviewed_by, min(event_id) FILTER (WHERE status = 'resolved') AS reviewed_at
    FROM (SELECT event_id % ((SELECT count(*) FROM orders) // 10 + 1) AS finding_id, event_id, user_id, CASE event_type WHEN 'purchase' THEN 'resolved'
          WHEN 'click' THEN 'acknowledged' WHEN 'error' THEN 'broken' ELSE 'open' END AS status FROM events) e
    WHERE status <> 'broken' GROUP BY finding_id""")
def _(m):
    t = c("event_type")
    status = F.when(t == "purchase", "resolved").when(t == "click", "acknowledged").when(t == "error", "broken").otherwise("open")
    log = m.events.select((c("event_id") % (m.orders.count() // 10 + 1)).alias("finding_id"), status.alias("status"), "user_id", c("event_id").alias("at"))
    return V.finding_status_history(log)


SHARED_SQL["template_rows"] = """SELECT p_brand AS template_id, CAST(p_size AS VARCHAR) AS code, min(p_name) AS name,
        CASE p_size % 6 WHEN 0 THEN 'asset' WHEN 1 THEN 'liability' WHEN 2 THEN 'equity' WHEN 3 THEN 'revenue' WHEN 4 THEN 'expense' ELSE 'other' END AS kind
        FROM part GROUP BY p_brand, p_size"""


@query("apply_coa_template", """SELECT b.id AS client_book_id, t.code AS account_code, t.name AS account_name, t.kind AS account_type, t.kind <> 'equity' AS is_reconcilable
    FROM {books} b JOIN {template_rows} t ON t.template_id = 'Brand#' || (1 + length(b.id) % 5) WHERE t.kind <> 'other'
      AND NOT (length(b.id) % 2 = 0 AND CAST(t.code AS INT) < 10)""")
def _(m):
    kind = F.element_at(F.array(*(F.lit(x) for x in ("asset", "liability", "equity", "revenue", "expense", "other"))), c("p_size") % 6 + 1)
    rows = m.part.groupBy("p_brand", "p_size").agg(F.min("p_name").alias("account_name")).select(
        c("p_brand").alias("template_id"), F.struct(c("p_size").cast("string").alias("account_code"), "account_name", kind.alias("account_type"),
                                                    (kind != "equity").alias("is_reconcilable")).alias("a"))
    templates = rows.groupBy("template_id").agg(F.to_json(F.collect_list("a")).alias("accounts"))
    requests = m.books.select(c("id").alias("client_book_id"), F.concat(F.lit("Brand#"), (1 + F.length("id") % 5).cast("string")).alias("template_id"))
    have = m.books.filter("length(id) % 2 = 0").select(c("id").alias("client_book_id"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("account_code")).withColumn(
        "account_code", c("account_code").cast("string"))
    return V.apply_coa_template(have, templates, requests)


@query("config_history", """SELECT client_book_id, changed_by, at, field_name, new_value,
        lag(new_value) OVER (PARTITION BY client_book_id, field_name ORDER BY at, changed_by) AS old_value
    FROM (SELECT 'book' || user_id % 40 AS client_book_id, user_id AS changed_by, event_id AS at, f.field_name,
            CASE f.field_name WHEN 'tolerance' THEN CAST(event_id % 90 AS VARCHAR) ELSE event_type END AS new_value
          FROM events, (VALUES ('tolerance', 2), ('mode', 3)) f(field_name, every) WHERE event_id % f.every = 0) t""".replace(" at,", " \"at\",").replace("AS at,", "AS \"at\",").replace("BY at,", "BY \"at\","))
def _(m):
    settings = F.map_filter(F.create_map(F.lit("tolerance"), F.when(c("event_id") % 2 == 0, (c("event_id") % 90).cast("string")),
                                         F.lit("mode"), F.when(c("event_id") % 3 == 0, c("event_type"))), lambda k, v: v.isNotNull())
    return V.config_history(m.events.select(F.concat(F.lit("book"), (c("user_id") % 40).cast("string")).alias("client_book_id"),
                                            c("user_id").alias("changed_by"), c("event_id").alias("at"), settings.alias("settings")))


@query("entity_tags", """SELECT firm, label, arg_max(color, event_id) AS color, count(DISTINCT entity) AS entities
    FROM (SELECT user_id % 5 AS firm, event_type AS label, 'c' || event_id % 7 AS color, user_id % 300 AS entity, event_id FROM events) t GROUP BY firm, label""")
def _(m):
    tags, links = V.entity_tags(m.events.select(
        (c("user_id") % 5).alias("firm_id"), c("event_type").alias("label"), F.concat(F.lit("c"), (c("event_id") % 7).cast("string")).alias("color"),
        (c("user_id") % 300).alias("extracted_entity_id"), c("event_id").alias("at")))
    return tags.join(links.groupBy("firm_id", "label").agg(F.count("*").alias("entities")), ["firm_id", "label"]).withColumnRenamed("firm_id", "firm")


SHARED_SQL["health"] = """SELECT s.id, coalesce(f.n, 0) AS consecutive_failures, s.enabled AND coalesce(f.n, 0) < 3 AS enabled FROM {subscriptions} s
    LEFT JOIN (SELECT subscription_id, count(*) AS n FROM {deliveries} WHERE failed GROUP BY subscription_id) f ON f.subscription_id = s.id"""


@query("webhook_health", "SELECT * FROM {health}")
def _(m):
    return V.webhook_health(m.subscriptions, m.deliveries).select("id", "consecutive_failures", "enabled")


@query("access_log_rollup", """SELECT user_id, 'book' || user_id % 40 AS client_book_id, event_type AS action, count(*) AS actions,
    count(DISTINCT event_id % 50) AS resources FROM events GROUP BY user_id, event_type""")
def _(m):
    return V.access_log_rollup(m.events.select("user_id", F.concat(F.lit("book"), (c("user_id") % 40).cast("string")).alias("client_book_id"),
                                               c("event_type").alias("action"), (c("event_id") % 50).alias("resource_id")))


@query("planted_severity_plan", """SELECT book AS client_book_id, kind, count(*) AS n, CAST(sum(gap) AS BIGINT) AS gap_cents FROM (
    SELECT book, CASE WHEN k % 7 < 3 THEN 'exact' WHEN k % 7 < 5 THEN 'within' ELSE 'high' END AS kind,
           CASE WHEN k % 7 < 3 THEN 0 WHEN k % 7 < 5 THEN tol ELSE tol * 101 END AS gap FROM {sales}) t GROUP BY book, kind""")
def _(m):
    from ledgermatch.plans.planted import plant_discrepancies
    planted = plant_discrepancies(m.sales.select(c("book").alias("client_book_id"), "k", "tol", "cents"))
    return planted.groupBy("client_book_id", "kind").agg(F.count("*").alias("n"), F.sum(F.abs(F.abs("bank_cents") - c("gl_cents"))).alias("gap_cents"))


@query("planted_severities_found", """SELECT book AS client_book_id, kind, CASE WHEN gap <= tol THEN 'info' WHEN gap <= 10 * tol THEN 'low' WHEN gap <= 100 * tol THEN 'medium' ELSE 'high' END AS severity,
    count(*) AS groups FROM (SELECT book, tol, CASE WHEN k % 7 < 3 THEN 'exact' WHEN k % 7 < 5 THEN 'within' ELSE 'high' END AS kind,
      CASE WHEN k % 7 < 3 THEN 0 WHEN k % 7 < 5 THEN tol ELSE 101 * tol END AS gap FROM {sales}) t GROUP BY ALL""")
def _(m):
    """R12 through the verifier: every planted pair as a group of two legs, judged like any other."""
    from ledgermatch.operators import verify
    from ledgermatch.plans.planted import plant_discrepancies
    planted = plant_discrepancies(m.sales.select(c("book").alias("client_book_id"), "k", "tol", "cents"))
    legs = F.explode(F.array(F.struct(F.lit("bank").alias("role"), c("bank_cents").alias("amount_cents")), F.struct(F.lit("gl").alias("role"), c("gl_cents").alias("amount_cents"))))
    rows = planted.select("client_book_id", F.concat_ws(":", "kind", "k").alias("reconciliation_group_id"), c("tol").alias("tolerance_cents"), legs.alias("leg"))
    found = verify.evaluate_groups(verify.group_leg_totals(rows.select("client_book_id", "reconciliation_group_id", "tolerance_cents", "leg.*")))
    return found.groupBy("client_book_id", F.substring_index("reconciliation_group_id", ":", 1).alias("kind"), "severity").agg(F.count("*").alias("groups"))
