"""Metric queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgrid.operators import metrics as mt
from reelgrid.plans import standins as si
from reelgrid.plans.catalog import feedback
from reelgrid.plans.registry import query
from reelgrid.plans.standins import with_sql

AG14 = """ SELECT kind, count(*) AS count, count(*) FILTER (NOT ok) AS errors, round_even(count(*) FILTER (NOT ok) / count(*), 4) AS error_rate, count(*) FILTER (zero_hit) AS zero_hits,
  round_even(count(*) FILTER (zero_hit) / count(*), 4) AS zero_hit_rate, round_even(list_sort(list(duration_ms))[cast(round_even((count(*) - 1) * 0.5, 0) AS int) + 1], 2) AS ms_p50,
  round_even(list_sort(list(duration_ms))[cast(round_even((count(*) - 1) * 0.95, 0) AS int) + 1], 2) AS ms_p95, round_even(max(duration_ms), 2) AS ms_max FROM {src} GROUP BY kind"""


@query("ag14_request_metrics", with_sql("rq", body=AG14.format(src="rq")))
def _(spark, sf):
    return mt.request_metrics(si.requests(spark, sf))


@query("wn25_recent_metrics", with_sql("rq", body=", re AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY ts DESC, event_id DESC) AS r FROM rq) WHERE r <= 300)" + AG14.format(src="re")))
def _(spark, sf):
    return mt.recent_metrics(si.requests(spark, sf))


@query("ag15_call_stats", with_sql("rq", body="SELECT count(*) AS calls, round_even(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 4) AS ok_rate, round_even(avg(duration_ms), 2) AS avg_ms, max(duration_ms) AS max_ms FROM rq"))
def _(spark, sf):
    return mt.call_stats(si.requests(spark, sf))


@query("ag16_acceptance", """SELECT event_type AS action, count(*) FILTER (value > 20) AS accepted, count(*) FILTER (NOT value > 20) AS overrides, count(*) AS total, round_even(count(*) FILTER (value > 20) / count(*), 3) AS rate FROM events GROUP BY 1""")
def _(spark, sf):
    return mt.acceptance(feedback(spark, sf))
