"""The five candidate passes over the invoice, bank and ledger legs of all books at once.

A leg is ``entities`` filtered by type; a candidate is one row with the sorted member ids and the
signed total per leg. Void entities never take part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermatch.functions.names import keep_same_vendor
from ledgermatch.operators import keys as K
from ledgermatch.operators.subset import combinations_near_dates, combinations_to_target
from ledgermatch.operators.vendors import found_names, searching_names
from ledgermatch.session import materialise

_BOOK = "client_book_id"


@dataclass
class Legs:
    invoices: DataFrame
    banks: DataFrame
    gls: DataFrame


def exclude_void(entities: DataFrame) -> DataFrame:
    """A missing subtype counts as standard."""
    return entities.filter(~F.col("entity_subtype").eqNullSafe("void"))


def split_legs(entities: DataFrame, books: DataFrame) -> Legs:
    """Slim legs with the book's tolerance; anything wider is joined back by id when needed."""
    tolerance = books.select(F.col("id").alias(_BOOK), F.col("tolerance_cents").alias("tol"))
    rows = materialise(
        exclude_void(entities).select(_BOOK, "id", "entity_type", F.col("amount_cents").alias("amount"),
                    F.col("transaction_date").alias("date"), F.col("counterparty").alias("name"))
        .join(tolerance, _BOOK))

    def leg(kind: str) -> DataFrame:
        return rows.filter(F.col("entity_type") == kind).drop("entity_type")

    return Legs(leg("invoice_line_item"), leg("bank_transaction"), leg("gl_entry"))


def _named(leg: DataFrame, prefix: str) -> DataFrame:
    return leg.select(_BOOK, "tol", *(F.col(c).alias(f"{prefix}_{c}") for c in ("id", "amount", "date", "name")))


def _same_vendor(rows: DataFrame, pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Rows whose names are a pair of ``pairs`` or of which one is missing; a join, nothing is compared anew."""
    known = pairs.select(_BOOK, "name_a", "name_b", F.lit(True).alias("same"))
    return (rows.withColumn("name_a", F.lower(a)).withColumn("name_b", F.lower(b))
            .join(known, [_BOOK, "name_a", "name_b"], "left")
            .filter(F.col("same") | F.col(a).isNull() | F.col(b).isNull()).drop("name_a", "name_b", "same"))


def _occurring_vendors(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Rows whose names denote one vendor or of which one is missing; each pair of different names is scored once."""
    c = F.col
    named = materialise(rows.withColumn("name_a", F.lower(a)).withColumn("name_b", F.lower(b)))
    differ = (c("name_a") != c("name_b")) & (F.length("name_a") > 0) & (F.length("name_b") > 0)
    scored = keep_same_vendor(named.filter(differ).select("name_a", "name_b").distinct(), "name_a", "name_b").withColumn("same", F.lit(True))
    alike = c(a).isNull() | c(b).isNull() | ((c("name_a") == c("name_b")) & (F.length("name_a") > 0))
    return named.join(scored, ["name_a", "name_b"], "left").filter(alike | c("same")).drop("name_a", "name_b", "same")


def equal_amount_pairs(earlier: DataFrame, later: DataFrame, a: str, b: str, pairs: DataFrame | None = None) -> DataFrame:
    """Pairs of equal amount, 0-14 days apart, same vendor. Keys: book, amount band, date band.

    With ``pairs`` (J1 of the same books) the names are joined; without, the names that occur together are compared.
    """
    left = (_named(earlier, a)
            .withColumn("band", F.explode(K.amount_bands(F.col(f"{a}_amount"), F.col("tol"))))
            .withColumn("when", F.explode(K.earlier_date_keys(F.col(f"{a}_date")))))
    right = (_named(later, b)
             .withColumn("band", K.amount_band(F.col(f"{b}_amount"), F.col("tol")))
             .withColumn("when", F.explode(K.later_date_keys(F.col(f"{b}_date")))).drop("tol"))
    near = (left.join(right, [_BOOK, "band", "when"])
            .filter(K.amounts_match(F.col(f"{a}_amount"), F.col(f"{b}_amount"), F.col("tol"))
                    & K.dates_match(F.col(f"{a}_date"), F.col(f"{b}_date")))
            .drop("band", "when"))
    if pairs is None:
        return _occurring_vendors(near, f"{a}_name", f"{b}_name")
    return _same_vendor(near, pairs, f"{a}_name", f"{b}_name")


def _candidate(df: DataFrame, number: int, invoices, banks, gl, invoice_total, bank_total, gl_total,
               mismatch: bool = False) -> DataFrame:
    return df.select(
        _BOOK, "tol", F.lit(number).alias("pass"), invoices.alias("invoice_ids"), banks.alias("bank_ids"),
        F.array(gl).alias("gl_ids"), invoice_total.cast("long").alias("invoice_total"),
        bank_total.cast("long").alias("bank_total"), gl_total.cast("long").alias("gl_total"),
        F.lit(mismatch).alias("mismatch"))


def _none():
    return F.array().cast("array<string>")


def match_exact(invoice_bank: DataFrame, invoice_gl: DataFrame) -> DataFrame:
    """Pass 1: an invoice with a payment and a ledger entry of the same amount."""
    c = F.col
    three = invoice_bank.join(invoice_gl.select("inv_id", "gl_id", "gl_amount"), "inv_id")
    return _candidate(three, 1, F.array("inv_id"), F.array("bank_id"), c("gl_id"),
                      c("inv_amount"), c("bank_amount"), c("gl_amount"))


def _with_gl(totals: DataFrame, gls: DataFrame) -> DataFrame:
    """Every ledger entry of the book whose amount equals the total (no date or name condition)."""
    left = totals.withColumn("band", F.explode(K.amount_bands(F.col("total"), F.col("tol"))))
    right = _named(gls, "gl").withColumn("band", K.amount_band(F.col("gl_amount"), F.col("tol"))).drop("tol")
    return (left.join(right, [_BOOK, "band"])
            .filter(K.amounts_match(F.col("total"), F.col("gl_amount"), F.col("tol"))).drop("band"))


def match_many_invoices(legs: Legs, pairs: DataFrame) -> DataFrame:
    """Pass 2: one payment covering two to five invoices of the vendor issued before it."""
    bank = (searching_names(_named(legs.banks, "bank"), pairs, "bank_name", "vendor")
            .withColumn("when", F.explode(K.later_date_keys(F.col("bank_date")))))
    invoice = (found_names(_named(legs.invoices, "inv").drop("tol"), "inv_name", "vendor")
               .withColumn("when", F.explode(K.earlier_date_keys(F.col("inv_date")))))
    relevant = (bank.join(invoice, [_BOOK, "vendor", "when"])
                .filter(K.dates_match(F.col("inv_date"), F.col("bank_date")))
                .select(_BOOK, "tol", F.col("bank_id").alias("anchor"),
                        F.col("bank_amount").alias("anchor_amount"),
                        F.col("inv_id").alias("id"), F.col("inv_amount").alias("amount")))
    sums = combinations_to_target(relevant)
    c = F.col
    return _candidate(_with_gl(sums, legs.gls), 2, c("ids"), F.array("anchor"), c("gl_id"),
                      c("total"), c("anchor_amount"), c("gl_amount"))


def match_installments(legs: Legs, pairs: DataFrame) -> DataFrame:
    """Pass 3: one invoice paid by two to five payments that lie within three days.

    Payments of a vendor are searched window by window, once for all invoices of that name, by the
    amounts that the invoices ask for. Nameless payments go with every name; sets of nothing else are
    searched once per book. Nameless invoices are one more name of their book, whose own payments are all.
    """
    c = F.col
    anyone, nobody = F.lit("\u0002"), F.lit("\u0003")  # nameless invoices; invoices paid by nameless payments only
    invoice = _named(legs.invoices, "inv").withColumn("wanted", F.coalesce(F.lower("inv_name"), anyone))
    wanted = (invoice.filter(c("inv_name").isNotNull()).groupBy(_BOOK, "wanted")
              .agg(F.max("tol").alias("tol"), F.max("inv_name").alias("inv_name")))
    bank = _named(legs.banks, "bank")
    row = [_BOOK, "wanted", c("tol").cast("long").alias("tol"), c("bank_id").alias("id"),
           c("bank_amount").cast("long").alias("amount"), c("bank_date").alias("date")]
    named = found_names(bank.filter(c("bank_name").isNotNull()).drop("tol"), "bank_name", "vendor")
    nameless = bank.filter(c("bank_name").isNull())
    members = materialise(
        searching_names(wanted, pairs, "inv_name", "vendor").join(named, [_BOOK, "vendor"]).select(*row)
        .unionByName(bank.withColumn("wanted", anyone).select(*row)).unionByName(nameless.withColumn("wanted", nobody).select(*row)))
    with_names = materialise(nameless.withColumn("wanted", anyone).select(*row).drop("wanted"))
    asked = invoice.select(_BOOK, "wanted", "inv_id", c("inv_amount").cast("long").alias("inv_amount"))
    targets = asked.unionByName(asked.filter(c("wanted") != anyone).withColumn("wanted", nobody))
    by_name = combinations_near_dates(members.filter(~c("wanted").isin("\u0002", "\u0003")), with_names, targets)
    alone = combinations_near_dates(members.filter(c("wanted").isin("\u0002", "\u0003")), with_names.limit(0), targets)
    paid = materialise(by_name.unionByName(alone))
    return _candidate(_with_gl(paid, legs.gls), 3, F.array("inv_id"), c("ids"), c("gl_id"),
                      c("inv_amount"), c("total"), c("gl_amount"))


def match_bank_gl(bank_gl: DataFrame) -> DataFrame:
    """Pass 4: payment and ledger entry of the same amount without any invoice."""
    c = F.col
    return _candidate(bank_gl, 4, _none(), F.array("bank_id"), c("gl_id"),
                      F.lit(0), c("bank_amount"), c("gl_amount"))


def unequal_pairs(legs: Legs, pairs: DataFrame) -> DataFrame:
    """Same vendor and date window, amounts differ, the gap at most half of the larger amount.

    The smaller amount is then at least half the larger, so their powers of two are neighbours: a further key.
    A payment already is a row per similar name, so it gets one band of dates and of amounts, and only names that
    ledger entries have; the entries are those that expand to the bands they can touch.
    """
    c = F.col
    gls = _named(legs.gls, "gl").filter("gl_amount <> 0").drop("tol")
    posted = gls.select(_BOOK, F.lower("gl_name").alias("name_b")).filter(c("name_b").isNotNull()).distinct()
    undated = gls.filter(c("gl_date").isNull()).select(_BOOK, F.lit(True).alias("undated")).distinct()  # a row per book
    days = K.later_date_keys(c("bank_date"))
    bank = (searching_names(_named(legs.banks, "bank").filter("bank_amount <> 0").join(undated, _BOOK, "left"),
                            pairs.join(posted, [_BOOK, "name_b"], "left_semi"), "bank_name", "vendor")
            .withColumn("when", F.explode(F.when(c("undated"), days).otherwise(F.slice(days, 1, 1)))).drop("undated")
            .withColumn("power", K.power_band(c("bank_amount"))))
    gl = (found_names(gls, "gl_name", "vendor")
          .withColumn("when", F.explode(K.preceding_date_keys(c("gl_date"))))
          .withColumn("power", F.explode(K.neighbouring_power_bands(c("gl_amount")))))
    larger = F.greatest(F.abs("bank_amount"), F.abs("gl_amount"))
    smaller = F.least(F.abs("bank_amount"), F.abs("gl_amount"))
    return (bank.join(gl, [_BOOK, "vendor", "when", "power"]).drop("power")
            .filter(K.dates_match(c("bank_date"), c("gl_date"))
                    & ~K.amounts_match(c("bank_amount"), c("gl_amount"), c("tol"))
                    & (2 * (larger - smaller) <= larger)))


def match_bank_gl_discrepancy(legs: Legs, pairs: DataFrame, invoice_bank: DataFrame) -> DataFrame:
    """Pass 5: a probable posting error, with the invoices that match the payment attached."""
    c = F.col
    attached = invoice_bank.groupBy("bank_id").agg(
        F.sort_array(F.collect_list("inv_id")).alias("inv_ids"), F.sum("inv_amount").alias("inv_total"))
    found = unequal_pairs(legs, pairs).join(attached, "bank_id", "left")
    return _candidate(found, 5, F.coalesce(c("inv_ids"), _none()), F.array("bank_id"), c("gl_id"),
                      F.coalesce(c("inv_total"), F.lit(0)), c("bank_amount"), c("gl_amount"), mismatch=True)
