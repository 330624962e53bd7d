"""Matching queries (J1-J6, R1-R8, F6-F9) over all books of the model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgermatch.functions.names import keep_same_vendor
from ledgermatch.operators import candidates as C
from ledgermatch.operators import keys as K
from ledgermatch.operators import passes as P
from ledgermatch.operators import verify as V
from ledgermatch.operators.vendors import similar_name_pairs
from ledgermatch.plans.link import candidate_groups, link_book
from ledgermatch.plans.registry import SHARED_SQL, query
from ledgermatch.session import materialise

_JW = "jaro_winkler_similarity(lower({a}), lower({b}))"


def _vendors(m):
    return materialise(similar_name_pairs(P.exclude_void(m.entities)))


def _same(a: str, b: str) -> str:
    return f"({a} IS NULL OR {b} IS NULL OR {_JW.format(a=a, b=b)} >= 0.9)"


def _days(a: str, b: str) -> str:
    return f"({a} IS NULL OR {b} IS NULL OR ({b} - {a}) BETWEEN 0 AND 14)"


def _equal(a: str, b: str, tol: str = "tol") -> str:
    return f"abs(abs({a}) - abs({b})) <= {tol}"


def _leg(kind: str, p: str) -> str:
    return f"""SELECT client_book_id, tolerance_cents AS tol, e.id AS {p}_id, amount_cents AS {p}_amount,
        transaction_date AS {p}_date, counterparty AS {p}_name
        FROM {{entities}} e JOIN {{books}} b ON b.id = e.client_book_id
        WHERE entity_type = '{kind}' AND entity_subtype IS DISTINCT FROM 'void'"""


def _pairs(a: str, ta: str, b: str, tb: str, equal: bool = True) -> str:
    return f"""SELECT x.client_book_id, x.tol, x.{a}_id, x.{a}_amount, x.{a}_date, x.{a}_name,
        y.{b}_id, y.{b}_amount, y.{b}_date, y.{b}_name
        FROM {{{ta}}} x JOIN {{{tb}}} y USING (client_book_id)
        WHERE {'' if equal else 'NOT '}{_equal(f'x.{a}_amount', f'y.{b}_amount', 'x.tol')}
          AND {_days(f'x.{a}_date', f'y.{b}_date')} AND {_same(f'x.{a}_name', f'y.{b}_name')}"""


def _growing(level: int, span: bool) -> str:
    """Combinations of the given size from the next smaller ones."""
    near = """ AND (greatest(s.d1, r.m_date) IS NULL
               OR greatest(s.d1, r.m_date) - least(s.d0, r.m_date) <= 3)""" if span else ""
    src = "pay_members" if span else "inv_members"
    prev = f"{'pay' if span else 'inv'}_combo{level - 1}"
    return f"""SELECT s.anchor, s.ids || ',' || r.m_id AS ids, r.m_id AS last, s.total + r.m_amount AS total,
        least(s.d0, r.m_date) AS d0, greatest(s.d1, r.m_date) AS d1
        FROM {{{prev}}} s JOIN {{{src}}} r ON r.anchor = s.anchor AND r.m_id > s.last{near}"""


SHARED_SQL.update({
    "lower_names": """SELECT DISTINCT client_book_id, lower(counterparty) AS name FROM {entities}
        WHERE length(counterparty) > 0""",
    "leg_inv": _leg("invoice_line_item", "inv"),
    "leg_bank": _leg("bank_transaction", "bank"),
    "leg_gl": _leg("gl_entry", "gl"),
    "pair_inv_bank": _pairs("inv", "leg_inv", "bank", "leg_bank"),
    "pair_inv_gl": _pairs("inv", "leg_inv", "gl", "leg_gl"),
    "pair_bank_gl": _pairs("bank", "leg_bank", "gl", "leg_gl"),
    "inv_members": f"""SELECT bank_id AS anchor, inv_id AS m_id, inv_amount AS m_amount, inv_date AS m_date
        FROM {{leg_bank}} k JOIN {{leg_inv}} i USING (client_book_id)
        WHERE {_days('inv_date', 'bank_date')} AND {_same('inv_name', 'bank_name')}""",
    "inv_combo1": """SELECT anchor, m_id AS ids, m_id AS last, m_amount AS total, m_date AS d0, m_date AS d1
        FROM {inv_members}""",
    **{f"inv_combo{n}": _growing(n, False) for n in (2, 3, 4, 5)},
    "pay_members": f"""SELECT inv_id AS anchor, bank_id AS m_id, bank_amount AS m_amount, bank_date AS m_date
        FROM {{leg_inv}} i JOIN {{leg_bank}} k USING (client_book_id)
        WHERE {_same('inv_name', 'bank_name')}""",
    "pay_combo1": """SELECT anchor, m_id AS ids, m_id AS last, m_amount AS total, m_date AS d0, m_date AS d1
        FROM {pay_members}""",
    **{f"pay_combo{n}": _growing(n, True) for n in (2, 3, 4, 5)},
    "cand1": """SELECT p.client_book_id, p.tol, 1 AS pass, p.inv_id AS invoice_ids, p.bank_id AS bank_ids, g.gl_id AS gl_ids,
        p.inv_amount AS invoice_total, p.bank_amount AS bank_total, g.gl_amount AS gl_total, 1 AS n_inv, false AS mismatch
        FROM {pair_inv_bank} p JOIN {pair_inv_gl} g USING (inv_id)""",
    "cand2": f"""SELECT k.client_book_id, k.tol, 2 AS pass, s.ids AS invoice_ids, k.bank_id AS bank_ids, gl_id AS gl_ids,
        s.total AS invoice_total, k.bank_amount AS bank_total, gl_amount AS gl_total,
        1 + length(s.ids) - length(replace(s.ids, ',', '')) AS n_inv, false AS mismatch
        FROM (SELECT * FROM {{inv_combo2}} UNION ALL SELECT * FROM {{inv_combo3}}
              UNION ALL SELECT * FROM {{inv_combo4}} UNION ALL SELECT * FROM {{inv_combo5}}) s
        JOIN {{leg_bank}} k ON k.bank_id = s.anchor AND {_equal('s.total', 'k.bank_amount', 'k.tol')}
        JOIN {{leg_gl}} g ON g.client_book_id = k.client_book_id AND {_equal('s.total', 'gl_amount', 'k.tol')}""",
    "cand3": f"""SELECT i.client_book_id, i.tol, 3 AS pass, i.inv_id AS invoice_ids, s.ids AS bank_ids, gl_id AS gl_ids,
        i.inv_amount AS invoice_total, s.total AS bank_total, gl_amount AS gl_total, 1 AS n_inv, false AS mismatch
        FROM (SELECT * FROM {{pay_combo2}} UNION ALL SELECT * FROM {{pay_combo3}}
              UNION ALL SELECT * FROM {{pay_combo4}} UNION ALL SELECT * FROM {{pay_combo5}}) s
        JOIN {{leg_inv}} i ON i.inv_id = s.anchor AND {_equal('s.total', 'i.inv_amount', 'i.tol')}
        JOIN {{leg_gl}} g ON g.client_book_id = i.client_book_id AND {_equal('s.total', 'gl_amount', 'i.tol')}""",
    "cand4": """SELECT client_book_id, tol, 4 AS pass, '' AS invoice_ids, bank_id AS bank_ids, gl_id AS gl_ids,
        0 AS invoice_total, bank_amount AS bank_total, gl_amount AS gl_total, 0 AS n_inv, false AS mismatch
        FROM {pair_bank_gl}""",
    "unequal": f"""SELECT * FROM ({_pairs("bank", "leg_bank", "gl", "leg_gl", equal=False)}) u
        WHERE least(abs(bank_amount), abs(gl_amount)) > 0
          AND 2 * (greatest(abs(bank_amount), abs(gl_amount)) - least(abs(bank_amount), abs(gl_amount)))
              <= greatest(abs(bank_amount), abs(gl_amount))""",
    "attached": """SELECT bank_id, string_agg(inv_id, ',' ORDER BY inv_id) AS ids, CAST(sum(inv_amount) AS BIGINT) AS total,
        count(*) AS n FROM {pair_inv_bank} GROUP BY bank_id""",
    "cand5": """SELECT u.client_book_id, u.tol, 5 AS pass, coalesce(a.ids, '') AS invoice_ids, u.bank_id AS bank_ids,
        u.gl_id AS gl_ids, coalesce(a.total, 0) AS invoice_total, u.bank_amount AS bank_total,
        u.gl_amount AS gl_total, coalesce(a.n, 0) AS n_inv, true AS mismatch
        FROM {unequal} u LEFT JOIN {attached} a USING (bank_id)""",
    "cand_all": " UNION ALL ".join(f"SELECT * FROM {{cand{n}}}" for n in (1, 2, 3, 4, 5)),
    "cand_best": """SELECT * FROM {cand_all} QUALIFY row_number() OVER (
        PARTITION BY client_book_id, bank_ids, gl_ids
        ORDER BY n_inv DESC, pass, string_split(invoice_ids, ',')) = 1""",
    "cand_exact": f"""SELECT *, sha256(client_book_id || '|' || bank_ids || '|' || gl_ids) AS id,
        coalesce(first_total <> 0 AND n_legs >= 2
          AND (invoice_total = 0 OR {_equal('first_total', 'invoice_total')})
          AND (bank_total = 0 OR {_equal('first_total', 'bank_total')})
          AND (gl_total = 0 OR {_equal('first_total', 'gl_total')}), false) AS exact
        FROM (SELECT *, CASE WHEN invoice_total <> 0 THEN invoice_total WHEN bank_total <> 0 THEN bank_total
                     ELSE gl_total END AS first_total,
              CAST(invoice_total <> 0 AS INT) + CAST(bank_total <> 0 AS INT) + CAST(gl_total <> 0 AS INT) AS n_legs
              FROM {{cand_best}}) t""",
    "cand_members": """SELECT id, unnest(string_split(concat_ws(',', nullif(invoice_ids, ''), bank_ids, gl_ids), ',')) AS eid
        FROM {cand_exact}""",
    "cand_dates": """SELECT c.id, count(transaction_date) AS n, max(transaction_date) - min(transaction_date) AS gap
        FROM {cand_members} c JOIN {entities} e ON e.id = c.eid GROUP BY c.id""",
    "cand_names": """SELECT c.id, c.eid, lower(counterparty) AS name
        FROM {cand_members} c JOIN {entities} e ON e.id = c.eid WHERE length(counterparty) > 0""",
    "cand_cp": """SELECT x.id, avg(jaro_winkler_similarity(x.name, y.name)) AS cp
        FROM {cand_names} x JOIN {cand_names} y ON x.id = y.id AND x.eid < y.eid GROUP BY x.id""",
    "cand_parts": """SELECT c.*,
        greatest(0.0e0, 1.0e0 - coalesce(list_avg(list_filter([
            CASE WHEN invoice_total <> 0 AND bank_total <> 0 THEN abs(invoice_total - bank_total) END,
            CASE WHEN invoice_total <> 0 AND gl_total <> 0 THEN abs(invoice_total - gl_total) END,
            CASE WHEN bank_total <> 0 AND gl_total <> 0 THEN abs(bank_total - gl_total) END],
            lambda v: v IS NOT NULL)), 0.0e0)
          / greatest(abs(invoice_total), abs(bank_total), abs(gl_total), 1)) AS amount_score,
        CASE WHEN coalesce(d.n, 0) < 2 THEN 0.0e0 WHEN d.gap = 0 THEN 1.0e0
             ELSE greatest(0.0e0, 1.0e0 - d.gap / 3.0e0) END AS date_score,
        coalesce(n.cp, 0.0e0) AS cp_score
        FROM {cand_exact} c LEFT JOIN {cand_dates} d USING (id) LEFT JOIN {cand_cp} n USING (id)""",
    "cand_scored": """SELECT *, CASE WHEN exact THEN 1.0e0
        ELSE 0.5e0 * amount_score + 0.2e0 * date_score + 0.3e0 * cp_score END AS score FROM {cand_parts}""",
    "linked": """SELECT s.*, CAST(printf('%.4f', score) AS DOUBLE) AS link_confidence,
        CASE WHEN mismatch THEN 'needs_review' WHEN score >= auto_link_threshold THEN 'auto_linked'
             WHEN score >= review_floor THEN 'needs_review' END AS status
        FROM {cand_scored} s JOIN {books} b ON b.id = s.client_book_id""",
})


def _legs(m):
    return P.split_legs(m.entities, m.books)


@query("similar_name_pairs", """
    SELECT x.client_book_id, x.name AS name_a, y.name AS name_b,
           round(jaro_winkler_similarity(x.name, y.name), 6) AS similarity
    FROM {lower_names} x JOIN {lower_names} y USING (client_book_id) WHERE jaro_winkler_similarity(x.name, y.name) >= 0.9""")
def _(m):
    return similar_name_pairs(m.entities).withColumn("similarity", F.round("similarity", 6))


def _pair_query(name, a, b, legs):
    @query(name, f"SELECT client_book_id, {a}_id, {b}_id FROM {{pair_{a}_{b}}}")
    def _(m):
        x = _legs(m)
        return P.equal_amount_pairs(getattr(x, legs[0]), getattr(x, legs[1]), a, b).select(
            "client_book_id", f"{a}_id", f"{b}_id")


# F6 + F7 + F8 as one pair join for each side
_pair_query("matching_invoice_bank_pairs", "inv", "bank", ("invoices", "banks"))
_pair_query("matching_invoice_gl_pairs", "inv", "gl", ("invoices", "gls"))


def _flat(df):
    return df.select("client_book_id", F.concat_ws(",", "invoice_ids").alias("invoice_ids"),
                     F.concat_ws(",", "bank_ids").alias("bank_ids"), F.concat_ws(",", "gl_ids").alias("gl_ids"),
                     *(F.col(c).cast("long") for c in ("invoice_total", "bank_total", "gl_total")))


_FLAT_SQL = """SELECT client_book_id, invoice_ids, bank_ids, gl_ids, CAST(invoice_total AS BIGINT) AS invoice_total,
    CAST(bank_total AS BIGINT) AS bank_total, CAST(gl_total AS BIGINT) AS gl_total FROM {%s}"""


@query("match_exact_1_1_1", _FLAT_SQL % "cand1")
def _(m):
    x = _legs(m)
    return _flat(P.match_exact(P.equal_amount_pairs(x.invoices, x.banks, "inv", "bank"),
                               P.equal_amount_pairs(x.invoices, x.gls, "inv", "gl")))


@query("match_many_invoices_to_bank", _FLAT_SQL % "cand2")
def _(m):
    x = _legs(m)
    return _flat(P.match_many_invoices(x, _vendors(m)))


@query("match_installments", _FLAT_SQL % "cand3")
def _(m):
    x = _legs(m)
    return _flat(P.match_installments(x, _vendors(m)))


@query("match_bank_gl", _FLAT_SQL % "cand4")
def _(m):
    x = _legs(m)
    return _flat(P.match_bank_gl(P.equal_amount_pairs(x.banks, x.gls, "bank", "gl")))


@query("match_bank_gl_discrepancy", _FLAT_SQL % "cand5")
def _(m):
    x = _legs(m)
    pairs = _vendors(m)
    return _flat(P.match_bank_gl_discrepancy(x, pairs, P.equal_amount_pairs(x.invoices, x.banks, "inv", "bank", pairs)))


@query("dedupe_candidates", _FLAT_SQL % "cand_best")
def _(m):
    return _flat(C.dedupe_candidates(candidate_groups(m.entities, m.books)))


@query("link_confidence", """SELECT id, exact, CAST(printf('%.4f', score) AS DOUBLE) AS link_confidence FROM {cand_scored}""")
def _(m):
    best = C.dedupe_candidates(candidate_groups(m.entities, m.books))
    return C.score_groups(best, m.entities).select("id", "exact", "link_confidence")


@query("link_book", """SELECT id, client_book_id, invoice_ids, bank_ids, gl_ids, status, mismatch, link_confidence
    FROM {linked} WHERE status IS NOT NULL""")
def _(m):
    ids = [F.concat_ws(",", c).alias(c) for c in ("invoice_ids", "bank_ids", "gl_ids")]
    return link_book(m.entities, m.books).select("id", "client_book_id", *ids, "status", "mismatch", "link_confidence")


@query("route_groups", """SELECT client_book_id, status, mismatch, count(*) AS groups
    FROM {linked} WHERE status IS NOT NULL GROUP BY ALL""")
def _(m):
    return link_book(m.entities, m.books).groupBy("client_book_id", "status", "mismatch").agg(F.count("*").alias("groups"))


@query("unmatched_after_linking", """SELECT e.id, e.client_book_id, e.entity_type FROM {entities} e
    LEFT JOIN (SELECT DISTINCT c.eid FROM {cand_members} c JOIN {linked} l USING (id) WHERE l.status IS NOT NULL) x ON x.eid = e.id
    WHERE x.eid IS NULL""")
def _(m):
    g = link_book(m.entities, m.books)
    return C.unmatched_entities(m.entities.select("id", "client_book_id", "entity_type"), C.member_rows(g, "id"))


# ---- the single conditions and scores, on the stored groups -------------------------------------
SHARED_SQL.update({
    "stored_pairs": """SELECT m.reconciliation_group_id AS gid, b.id AS bank_id, g.id AS gl_id, b.amount_cents AS a, g.amount_cents AS b,
        b.transaction_date AS da, g.transaction_date AS db, b.counterparty AS na, g.counterparty AS nb, k.tolerance_cents AS tol
        FROM {members} m JOIN {entities} b ON b.id = m.extracted_entity_id AND m.role = 'bank'
        JOIN {members} n ON n.reconciliation_group_id = m.reconciliation_group_id AND n.role = 'gl'
        JOIN {entities} g ON g.id = n.extracted_entity_id JOIN {books} k ON k.id = b.client_book_id""",
    "stored_members": """SELECT m.reconciliation_group_id AS gid, m.role, e.id, e.transaction_date, e.counterparty, e.amount_cents
        FROM {members} m JOIN {entities} e ON e.id = m.extracted_entity_id""",
})


def _stored_pairs(m):
    e = m.entities.select(F.col("id").alias("extracted_entity_id"), "client_book_id", "amount_cents", "transaction_date", "counterparty")
    rows = m.members.join(e, "extracted_entity_id")

    def side(role, names):
        return rows.filter(F.col("role") == role).select(
            F.col("reconciliation_group_id").alias("gid"), *(F.col(a).alias(b) for a, b in names.items()))

    bank = side("bank", {"extracted_entity_id": "bank_id", "amount_cents": "a", "transaction_date": "da", "counterparty": "na",
                         "client_book_id": "client_book_id"})
    gl = side("gl", {"extracted_entity_id": "gl_id", "amount_cents": "b", "transaction_date": "db", "counterparty": "nb"})
    tol = m.books.select(F.col("id").alias("client_book_id"), F.col("tolerance_cents").alias("tol"))
    return bank.join(gl, "gid").join(tol, "client_book_id")


@query("amounts_match", "SELECT bank_id, gl_id, abs(abs(a) - abs(b)) <= tol AS ok FROM {stored_pairs}")
def _(m):
    return _stored_pairs(m).select("bank_id", "gl_id", K.amounts_match(F.col("a"), F.col("b"), F.col("tol")).alias("ok"))


@query("dates_match", f"SELECT bank_id, gl_id, {_days('da', 'db')} AS ok FROM {{stored_pairs}}")
def _(m):
    return _stored_pairs(m).select("bank_id", "gl_id", K.dates_match(F.col("da"), F.col("db")).alias("ok"))


@query("counterparties_match", f"SELECT bank_id, gl_id FROM {{stored_pairs}} WHERE {_same('na', 'nb')}")
def _(m):
    return keep_same_vendor(_stored_pairs(m), "na", "nb").select("bank_id", "gl_id")


@query("combo_dates_within_window", """SELECT gid, coalesce(max(transaction_date) - min(transaction_date) <= 3, true) AS ok
    FROM {stored_members} WHERE role = 'bank' GROUP BY gid""")
def _(m):
    e = m.entities.select(F.col("id").alias("extracted_entity_id"), "transaction_date")
    return (m.members.filter("role = 'bank'").join(e, "extracted_entity_id").groupBy(F.col("reconciliation_group_id").alias("gid"))
            .agg(K.dates_within(F.min("transaction_date"), F.max("transaction_date")).alias("ok")))


def _stored_totals(m):
    totals = V.group_leg_totals(V.group_members(m.groups, m.members, m.entities, m.books))
    return totals.withColumn("tol", F.col("tolerance_cents"))


SHARED_SQL["stored_totals"] = """SELECT *, CASE WHEN invoice_total <> 0 THEN invoice_total WHEN bank_total <> 0 THEN bank_total ELSE gl_total END AS first_total,
    CAST(invoice_total <> 0 AS INT) + CAST(bank_total <> 0 AS INT) + CAST(gl_total <> 0 AS INT) AS n_legs FROM {leg_totals}"""


@query("is_exact", f"""SELECT reconciliation_group_id AS gid, n_legs >= 2
    AND (invoice_total = 0 OR {_equal('first_total', 'invoice_total', 'tolerance_cents')})
    AND (bank_total = 0 OR {_equal('first_total', 'bank_total', 'tolerance_cents')})
    AND (gl_total = 0 OR {_equal('first_total', 'gl_total', 'tolerance_cents')}) AS exact FROM {{stored_totals}}""")
def _(m):
    return _stored_totals(m).select(F.col("reconciliation_group_id").alias("gid"), C.is_exact().alias("exact"))


@query("amount_score", """SELECT reconciliation_group_id AS gid, round(greatest(0.0e0, 1.0e0 - coalesce(list_avg(list_filter([
        CASE WHEN invoice_total <> 0 AND bank_total <> 0 THEN abs(invoice_total - bank_total) END,
        CASE WHEN invoice_total <> 0 AND gl_total <> 0 THEN abs(invoice_total - gl_total) END,
        CASE WHEN bank_total <> 0 AND gl_total <> 0 THEN abs(bank_total - gl_total) END], lambda v: v IS NOT NULL)), 0.0e0)
      / greatest(abs(invoice_total), abs(bank_total), abs(gl_total), 1)), 6) AS score FROM {leg_totals}""")
def _(m):
    return _stored_totals(m).select(F.col("reconciliation_group_id").alias("gid"), F.round(C.amount_score(), 6).alias("score"))


@query("date_score", """SELECT gid, round(CASE WHEN count(transaction_date) < 2 THEN 0.0e0 WHEN max(transaction_date) = min(transaction_date) THEN 1.0e0
    ELSE greatest(0.0e0, 1.0e0 - (max(transaction_date) - min(transaction_date)) / 3.0e0) END, 6) AS score FROM {stored_members} GROUP BY gid""")
def _(m):
    e = m.entities.select(F.col("id").alias("extracted_entity_id"), "transaction_date")
    return m.members.join(e, "extracted_entity_id").groupBy(F.col("reconciliation_group_id").alias("gid")).agg(
        F.round(C.date_score(F.min("transaction_date"), F.max("transaction_date"), F.count("transaction_date")), 6).alias("score"))


@query("counterparty_score", """SELECT gid, round(CASE WHEN count(*) > 0 THEN avg(s) END, 6) AS score FROM (
    SELECT x.gid, jaro_winkler_similarity(lower(x.counterparty), lower(y.counterparty)) AS s FROM {stored_members} x JOIN {stored_members} y
      ON x.gid = y.gid AND x.id < y.id WHERE length(x.counterparty) > 0 AND length(y.counterparty) > 0) t GROUP BY gid""")
def _(m):
    e = m.entities.select(F.col("id").alias("extracted_entity_id"), F.col("counterparty").alias("name"))
    names = m.members.join(e, "extracted_entity_id").select(F.col("reconciliation_group_id").alias("gid"), "name")
    scored = C.counterparty_score(names, "gid").filter("pairs > 0")
    return scored.select("gid", F.round("cp_score", 6).alias("score"))
