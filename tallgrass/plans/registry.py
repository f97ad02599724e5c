"""Named queries over the driver's tables and their SQL.

Days leave both engines as text, so that no client's date type comes between them.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F

from tallgrass.plans import candidate_queries, feature_queries, model_queries, policy_queries, retrieval_queries, table_queries

_MODULES = (feature_queries, model_queries, retrieval_queries, policy_queries, table_queries, candidate_queries)
DAYS = {
    "daily_customer_agg": ["feature_date"], "daily_article_agg": ["feature_date"], "daily_cross_agg": ["feature_date"], "split_slices": ["first_day", "last_day"],
    "fact_grain": ["t_dat"], "fact_grain_events": ["t_dat"], "date_bounds_scan": ["t_dat"], "units_anomaly": ["t_dat"], "daily_rowcount_anomaly": ["t_dat"],
    "freshness": ["latest"], "partition_overwrite": ["t_dat"], "late_arrival_state": ["t_dat"], "replay_guard": ["t_dat"], "repurchase": ["last_day"], "article_week_panel": ["week"],
    "snapshot_time_travel": ["t_dat"], "snapshot_day_overwrite": ["t_dat"], "snapshot_partition_bounds": ["t_dat"], "late_batch_fact": ["t_dat"], "reload_with_corrections": ["t_dat"],
    "stream_sink_replay": ["t_dat"], "stream_daily_totals": ["t_dat"], "mart_fact": ["t_dat"], "row_set_diff": ["t_dat"], "relative_price": ["t_dat"],
}


def _with_text_days(name, query):
    @wraps(query)
    def run(spark, sf_dir):
        return query(spark, sf_dir).withColumns({c: F.col(c).cast("string") for c in DAYS[name]})

    return run


def queries() -> dict:
    found = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
    return {k: _with_text_days(k, v) if k in DAYS else v for k, v in found.items()}


def oracle_sql() -> dict:
    found = {k: v for m in _MODULES for k, v in m.SQL.items()}
    cast = lambda k: ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in DAYS[k])
    return {k: f"SELECT * REPLACE ({cast(k)}) FROM ({v})" if k in DAYS else v for k, v in found.items()}
