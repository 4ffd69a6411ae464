"""Queries with unions, joins and as-of windows under plans that small tables don't bring about by themselves: no broadcast
joins, several files a table, and shuffle partitions unlike the scans'."""

import pytest

import marlstone.plans  # noqa: F401
from marlstone.registry import REGISTRY
from tests.test_oracle import compare, con  # noqa: F401

NAMES = ["ag_bm25", "ag_token_overlap", "tk_rerank", "pl_hybrid_retrieve", "ag_ir_run", "tx_knowledge_sparse", "set_union", "st_process", "st_symbol_features", "jn_pit_asof", "jn_price_at", "jn_membership_asof", "jn_ffill_calendar", "jn_recall_merge", "fd_memory_expire"]


@pytest.fixture(scope="module")
def scattered(spark, sf, tmp_path_factory):
    """The tables in seven files each, and a session without broadcast joins."""
    root = tmp_path_factory.mktemp("scattered")
    for name in ("documents", "benchmark", "labels", "events", "lineitem", "orders", "customer", "supplier", "part", "nation", "region", "embeddings"):
        spark.read.parquet(f"{sf}/{name}.parquet").repartition(7).write.parquet(f"{root}/{name}.parquet")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "11", "spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "1k"}
    own = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield str(root)
    for k, v in own.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("name", [n for n in NAMES if n in REGISTRY and REGISTRY[n].sql])
def test_query_equals_sql_without_broadcasts(spark, scattered, con, name):  # noqa: F811
    compare(spark, scattered, con, name)
