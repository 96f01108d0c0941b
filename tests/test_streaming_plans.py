"""Streaming ingest, the facts sink, and plan checks."""

from __future__ import annotations

import pytest

from pyspark.sql import functions as F

from conftest import SF_SMALL, raw_rows
from quotaflow.operators import aggregate_by, apply_filters, prepare, revenue_by_region
from quotaflow.plans.bundle import rollup_by_dimensions
from quotaflow.plans.catalog import QUERIES, facts
from quotaflow.plans.inspect import has_python_udf, pushed_filters, single_partition_exchanges
from quotaflow.schema import REQUIRED_COLUMNS
from quotaflow.streaming.ingest import read_facts, stream_revenue_files, write_facts, write_facts_stream


def _csv(rows, path):
    df_rows = [",".join("" if r[c] is None else str(r[c]) for c in REQUIRED_COLUMNS) for r in rows]
    path.write_text(",".join(REQUIRED_COLUMNS) + "\n" + "\n".join(df_rows) + "\n")


def test_stream_ingest_matches_batch(spark, tmp_path):
    drops = tmp_path / "drops"
    drops.mkdir()
    batch = raw_rows(spark, [
        {"record_id": "a", "region": " EMEA", "monthly_recurring_revenue_eur": "10", "reporting_month": "2025-01"},
        {"record_id": "b", "region": "APAC", "monthly_recurring_revenue_eur": "n/a", "reporting_month": "2025-02"},
        {"record_id": "c", "region": "APAC", "monthly_recurring_revenue_eur": "5", "reporting_month": "2025-13"},
    ])
    rows = [r.asDict() for r in batch.collect()]
    _csv(rows[:2], drops / "one.csv")
    _csv(rows[2:], drops / "two.csv")
    out = str(tmp_path / "facts")
    q = write_facts_stream(stream_revenue_files(spark, str(drops)), out,
                           checkpoint_location=str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    streamed = read_facts(spark, out)
    expected = prepare(batch)
    assert streamed.count() == 2
    got = sorted((r["record_id"], r["region"], r["total_revenue_eur"]) for r in streamed.collect())
    want = sorted((r["record_id"], r["region"], r["total_revenue_eur"]) for r in expected.collect())
    assert got == want


def test_written_facts_get_pushed_filters(spark, tmp_path):
    df = facts(spark, SF_SMALL)
    path = str(tmp_path / "facts")
    write_facts(df, path)
    sliced = apply_filters(read_facts(spark, path), regions=["ASIA"], plans=["1-URGENT"])
    pushed = " ".join(pushed_filters(revenue_by_region(sliced)))
    assert "In(region" in pushed or "EqualTo(region" in pushed
    assert "subscription_plan" in pushed
    assert revenue_by_region(sliced).count() == 1


def test_no_python_udf_and_no_single_partition_exchange_over_facts(spark):
    for name in ["enrich_facts", "aggregate_by_team", "revenue_risk_customers", "ml_risk_accounts",
                 "forecast_confidence", "aggregate_by_dimensions", "filter_options"]:
        df = QUERIES[name](spark, SF_SMALL)
        assert not has_python_udf(df), name
    # grouped rollups shuffle by key, never into one partition
    assert single_partition_exchanges(aggregate_by(facts(spark, SF_SMALL), "region")) == 0


def test_same_result_for_1_and_16_partitions(spark):
    df = facts(spark, SF_SMALL)
    a = aggregate_by(df.repartition(1), "sales_team").select("sales_team", "records", "total_revenue_eur")
    b = aggregate_by(df.repartition(16), "sales_team").select("sales_team", "records", "total_revenue_eur")
    ra = sorted((r[0], r[1], round(r[2], 2)) for r in a.collect())
    rb = sorted((r[0], r[1], round(r[2], 2)) for r in b.collect())
    assert ra == rb


def test_one_pass_rollup_equals_separate_rollups(spark):
    df = facts(spark, SF_SMALL)
    long = {(r["dimension"], r["value"]): r["records"]
            for r in rollup_by_dimensions(df, ["region", "subscription_plan"]).collect()}
    for dim in ["region", "subscription_plan"]:
        for r in aggregate_by(df, dim).collect():
            assert long[(dim, r[dim])] == r["records"]


def test_slices_add_up(spark):
    df = facts(spark, SF_SMALL)
    regions = [r[0] for r in df.select("region").distinct().collect()]
    cents = F.col("total_revenue_eur").cast("decimal(24,2)")  # plain sums of doubles differ with the order of the rows
    total = df.agg(F.sum(cents)).first()[0]
    assert total == sum(apply_filters(df, regions=[x]).agg(F.sum(cents)).first()[0] for x in regions)


def test_entry_runs(spark):
    import __spark_entry__ as entry_mod

    out = entry_mod.entry(spark)
    assert out.count() > 0
    assert set(entry_mod.oracle_sql()) <= set(entry_mod.queries())


def test_fact_join_is_never_a_broadcast_of_lineitem(spark):
    from quotaflow.plans.inspect import plan_text
    from quotaflow.sources.star import star_join

    import re

    text = plan_text(star_join(spark, SF_SMALL), "simple")
    # lineitem meets orders in a sort-merge join on the order key: neither side broadcast
    assert re.search(r"SortMergeJoin \[l_orderkey#\d+L\], \[o_orderkey#\d+L\]", text), text


def test_facts_table_is_written_once_and_pruned(spark):
    from quotaflow.plans.catalog import facts_plan
    from quotaflow.plans.inspect import plan_text

    table = facts(spark, SF_SMALL)
    assert facts(spark, SF_SMALL) is table  # one table per session and folder
    assert table.inputFiles()
    assert all("quotaflow-facts" in f for f in table.inputFiles())
    view = revenue_by_region(apply_filters(table, regions=["ASIA"]))
    text = plan_text(view, "formatted")
    assert "Join" not in text  # the views no longer re-run the fact mapping
    assert "ReadSchema: struct<region:string,churned_revenue_eur" in text  # pruned columns
    assert "In(region" in " ".join(pushed_filters(view)) or "EqualTo(region" in " ".join(pushed_filters(view))

    planned = facts_plan(spark, SF_SMALL)
    assert planned.schema.simpleString() == table.schema.simpleString()
    assert planned.exceptAll(table).isEmpty() and table.exceptAll(planned).isEmpty()


def test_a_failed_write_raises_and_old_readers_survive_a_reset(spark, monkeypatch):
    import quotaflow.plans.catalog as catalog

    old = catalog.facts(spark, SF_SMALL)
    rows = old.count()
    catalog.reset_plans()
    new = catalog.facts(spark, SF_SMALL)
    assert new is not old and new.count() == rows == old.count()

    def fail(df, *args):
        raise OSError("read-only folder")

    catalog.drop_facts_tables(spark)
    monkeypatch.setattr("quotaflow.sources.store.clustered", fail)
    with pytest.raises(OSError, match="read-only"):
        catalog.facts(spark, SF_SMALL)
    monkeypatch.undo()
    catalog.reset_plans()


def test_changed_sources_give_new_facts(spark, tmp_path):
    import shutil

    import quotaflow.plans.catalog as catalog

    (tmp_path / "sf").mkdir()
    for name in catalog.STAR_TABLES:  # contents only: the test data's own modes may be read-only
        spark.read.parquet(f"{SF_SMALL}/{name}.parquet").write.parquet(str(tmp_path / "sf" / f"{name}.parquet"))
    before = catalog.facts(spark, str(tmp_path / "sf")).count()
    shutil.rmtree(tmp_path / "sf" / "lineitem.parquet")
    half = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").where("l_orderkey % 2 = 0")
    half.write.parquet(str(tmp_path / "sf" / "lineitem.parquet"))
    assert 0 < catalog.facts(spark, str(tmp_path / "sf")).count() < before


def test_views_scan_and_copy_the_facts_once(spark):
    from quotaflow.operators import filter_options, pipeline_share, quality_report, revenue_risk_customers
    from quotaflow.plans.inspect import plan_text

    df = facts(spark, SF_SMALL)
    for view in (quality_report(df), filter_options(df), pipeline_share(df)):
        text = plan_text(view, "simple")
        facts_side = text[text.rindex("HashAggregate"):]
        assert "Expand" not in facts_side and "Generate" not in facts_side and "Sort" not in facts_side
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan_text(revenue_risk_customers(df), "simple")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert text.count("FileScan") == 1 and "ReusedExchange" in text


def test_drop_facts_tables_removes_the_opened_stores(spark):
    import os

    from quotaflow.plans.catalog import drop_facts_tables, store

    first = store(spark, SF_SMALL)
    local = f"{first.root}/{first.manifest['folder']}".removeprefix("file:")
    assert os.path.isdir(local)
    assert drop_facts_tables(spark) and not drop_facts_tables(spark)
    assert not os.path.exists(local)
    again = facts(spark, SF_SMALL)  # written afresh for later users of the session
    assert again is not first.facts and again.count() > 0
