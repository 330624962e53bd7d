"""Closing periods as one job: blockers, trial balance, status, baselines, reopen log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermatch.operators import periods as PD
from ledgermatch.session import materialise

c = F.col


@dataclass
class Closed:
    periods: DataFrame     # every period with its status and balances after the batch
    baselines: DataFrame   # stored baselines with those of the closed books replaced or added
    reopen_log: DataFrame  # rows to append


def close_periods(entities: DataFrame, periods: DataFrame, actions: DataFrame, requests: DataFrame, baselines: DataFrame) -> Closed:
    """A batch of close and reopen actions over all books.

    Baselines are computed once per book, up to the latest period that the batch closed, and replace the
    stored ones by book and vendor; they carry the period they were computed through. Nothing is lost if
    the job runs again: all three results follow from the inputs alone.
    """
    blockers = materialise(PD.pending_request_blockers(requests, periods))
    state = materialise(PD.period_state(periods, actions, PD.trial_balance(entities, periods), blockers))
    log = PD.reopen_log(periods, actions, blockers)
    touched = actions.filter("action = 'close'").select("period_id").distinct()
    closed = (state.filter("status = 'pending_close'").join(touched, "period_id", "left_semi")
              .join(blockers.select("period_id"), "period_id", "left_anti"))
    through = closed.groupBy("client_book_id").agg(
        F.max_by("period_id", "period_end").alias("computed_through_period_id"), F.max("period_end").alias("period_end"))
    through = materialise(through)
    fresh = (PD.vendor_baselines(entities, periods, through.select("client_book_id", "period_end"))
             .join(through.select("client_book_id", "computed_through_period_id"), "client_book_id"))
    kept = baselines.join(fresh.select("client_book_id", "counterparty"), ["client_book_id", "counterparty"], "left_anti")
    return Closed(state, kept.select(fresh.columns).unionByName(fresh), log)
