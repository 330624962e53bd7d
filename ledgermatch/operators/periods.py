"""Period logic: overlaps, membership, trial balance, baselines, closing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgermatch.operators.passes import exclude_void

c = F.col


def _months(start: str, end: str):
    """First days of the months a date range touches: the equi-key of the range joins."""
    return F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month"))


def entity_periods(entities: DataFrame, periods: DataFrame) -> DataFrame:
    """Entities with every period of the book that contains their date."""
    slices = periods.select("client_book_id", c("id").alias("period_id"), "period_start", "period_end",
                            F.explode(_months("period_start", "period_end")).alias("month"))
    return (entities.withColumn("month", F.trunc("transaction_date", "month"))
            .join(slices, ["client_book_id", "month"])
            .filter(c("transaction_date").between(c("period_start"), c("period_end"))).drop("month"))


def overlapping_periods(periods: DataFrame) -> DataFrame:
    """Pairs of periods of one book that share a day, both ends inclusive.

    Keyed by month; the pair is kept only in the first month both touch, so no duplicates arise.
    """
    a = periods.select("client_book_id", c("id").alias("period_a"), c("period_start").alias("a_start"),
                       c("period_end").alias("a_end"), F.explode(_months("period_start", "period_end")).alias("month"))
    b = periods.select("client_book_id", c("id").alias("period_b"), c("period_start").alias("b_start"),
                       c("period_end").alias("b_end"), F.explode(_months("period_start", "period_end")).alias("month"))
    return (a.join(b, ["client_book_id", "month"])
            .filter((c("period_a") < c("period_b")) & (c("a_start") <= c("b_end")) & (c("b_start") <= c("a_end"))
                    & (c("month") == F.greatest(F.trunc("a_start", "month"), F.trunc("b_start", "month"))))
            .select("client_book_id", "period_a", "period_b"))


def trial_balance(entities: DataFrame, periods: DataFrame) -> DataFrame:
    """Debits and credits of the ledger per period, 0 shown as null, and whether they agree (A3)."""
    ledger = exclude_void(entities).filter(c("entity_type") == "gl_entry").select(
        "client_book_id", "transaction_date", "debit_or_credit", "amount_cents")

    def side(name: str):
        return F.nullif(F.sum(F.when(c("debit_or_credit") == name, c("amount_cents"))), F.lit(0))

    sums = entity_periods(ledger, periods).groupBy("period_id").agg(
        side("debit").alias("debits_cents"), side("credit").alias("credits_cents"))
    d, k = c("debits_cents"), c("credits_cents")
    balanced = F.when(d.isNull() & k.isNull(), F.lit(None).cast("boolean")).otherwise(
        F.coalesce(d == k, F.lit(False)))
    return periods.select("client_book_id", c("id").alias("period_id")).join(sums, "period_id", "left").withColumn(
        "is_balanced", balanced)


def vendor_baselines(entities: DataFrame, periods: DataFrame, through: DataFrame, count: int = 6) -> DataFrame:
    """Mean and population deviation per vendor over the last six periods up to a closing one (A4).

    ``through`` holds (client_book_id, period_end) of the period being closed in each book.
    """
    last = (periods.join(through.withColumnRenamed("period_end", "closing"), "client_book_id")
            .filter(c("period_end") <= c("closing"))
            .withColumn("_r", F.row_number().over(Window.partitionBy("client_book_id").orderBy(F.desc("period_end"), "id")))
            .filter(c("_r") <= count).drop("_r", "closing"))
    rows = exclude_void(entities).filter(c("counterparty").isNotNull()).select(
        "client_book_id", "transaction_date", "counterparty", "amount_cents")
    # exact sums: a deviation that ends in half a cent must round up, not where a double drifts to
    x = c("amount_cents").cast("decimal(19,0)")
    # around the mean, so that the squares of a very large vendor still fit
    off = c("total") - c("n") * c("trailing_avg_cents")
    centred = (c("squares") - 2 * c("trailing_avg_cents") * c("total") + c("n") * c("trailing_avg_cents") * c("trailing_avg_cents")).cast("decimal(30,0)")
    spread = F.sqrt((c("n") * centred - off * off).cast("double")) / c("n")
    return (entity_periods(rows, last).groupBy("client_book_id", "counterparty")
            .agg(F.count("*").cast("decimal(8,0)").alias("n"), F.sum(x).cast("decimal(19,0)").alias("total"),
                 F.sum((x * x).cast("decimal(28,0)")).cast("decimal(37,0)").alias("squares"))
            .withColumn("trailing_avg_cents", F.round(c("total") / c("n")).cast("decimal(15,0)"))
            .select("client_book_id", "counterparty", c("n").cast("long").alias("n"),
                    c("trailing_avg_cents").cast("long").alias("trailing_avg_cents"),
                    F.round(spread).cast("long").alias("trailing_stddev_cents")))


def pending_request_blockers(requests: DataFrame, periods: DataFrame) -> DataFrame:
    """Periods that cannot close, with the number of requests in the way."""
    open_ = (requests.filter(c("status") == "pending").groupBy(c("reconciliation_period_id").alias("period_id"))
             .agg(F.count("*").alias("pending")))
    return periods.select("client_book_id", c("id").alias("period_id")).join(open_, "period_id")


def _accepted(periods: DataFrame, actions: DataFrame, blockers: DataFrame) -> DataFrame:
    """Actions that are in order by themselves, with the period's first close: a close needs a period
    without pending requests, a reopen a reason."""
    blocked = blockers.select("period_id", F.lit(True).alias("_blocked"))
    close, reason = c("action") == "close", F.length(F.trim(F.coalesce("reason", F.lit("")))) > 0
    return (actions.join(blocked, "period_id", "left")
            .filter((close & c("_blocked").isNull()) | ((c("action") == "reopen") & reason)).drop("_blocked"))


def period_state(periods: DataFrame, actions: DataFrame, balances: DataFrame, blockers: DataFrame) -> DataFrame:
    """Status after a batch of close and reopen actions (M6).

    A close takes an open period to pending_close and a pending one there again with new balances; closed
    and reopened periods refuse it. A reopen takes pending and closed periods to reopened, without
    balances, and that is final here. So the first close and the last reopen decide; of actions at one
    time a close comes first. Other actions change nothing.
    """
    close, reopen = c("action") == "close", c("action") == "reopen"
    history = _accepted(periods, actions, blockers).groupBy("period_id").agg(
        F.min(F.when(close, c("at"))).alias("first_close"), F.max(F.when(reopen, c("at"))).alias("last_reopen"))
    before, closes, reopens = c("status"), c("first_close").isNotNull(), c("last_reopen").isNotNull()
    reopened = (before.isin("pending_close", "closed") & reopens) | ((before == "open") & closes & (c("last_reopen") >= c("first_close")))
    state = (periods.withColumnRenamed("id", "period_id").join(history, "period_id", "left")
             .join(balances.select("period_id", "debits_cents", "credits_cents", "is_balanced"), "period_id", "left")
             .withColumn("_reopened", F.coalesce(reopened, F.lit(False)))
             .withColumn("_closing", ~c("_reopened") & closes & before.isin("open", "pending_close"))
             .withColumn("status", F.when(c("_reopened"), "reopened").when(c("_closing"), "pending_close").otherwise(before)))
    for name in ("debits_cents", "credits_cents", "is_balanced"):
        state = state.withColumn(name, F.when(c("_closing"), c(name)))
    return state.drop("first_close", "last_reopen", "_reopened", "_closing")


def reopen_log(periods: DataFrame, actions: DataFrame, blockers: DataFrame) -> DataFrame:
    """period_id, at, reason of every reopen that changed a period; at most one per period and batch."""
    accepted = _accepted(periods, actions, blockers)
    first = accepted.filter("action = 'close'").groupBy("period_id").agg(F.min("at").alias("first_close"))
    start = periods.select(c("id").alias("period_id"), "status")
    return (accepted.filter("action = 'reopen'").join(start, "period_id").join(first, "period_id", "left")
            .filter("status in ('pending_close', 'closed') or (status = 'open' and at >= first_close)")
            .groupBy("period_id").agg(F.min_by(F.struct("at", "reason"), "at").alias("r")).select("period_id", "r.*"))
