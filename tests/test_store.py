"""The facts store: states instead of facts, clustering, the manifest, exact sums."""

from __future__ import annotations

import glob
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, typed_facts
from quotaflow import operators as op
from quotaflow.functions.states import mean, total
from quotaflow.plans import catalog
from quotaflow.plans.bundle import rollup_by_dimensions
from quotaflow.plans.inspect import plan_text
from quotaflow.sources import store as st
from quotaflow.sources.store import DIMENSIONS, MARGINS, SKETCH_ERROR, clustered, margins_of, open_store, sources_state, summarize

SLICE = {"regions": ["ASIA", "EUROPE"], "plans": ["1-URGENT", "2-HIGH"]}


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: [(x is not None, x) for x in r])


VIEWS = {
    "top_metrics": op.top_metrics, "quality_report": op.quality_report, "revenue_by_region": op.revenue_by_region,
    "revenue_by_product": op.revenue_by_product, "forecast_vs_actual": op.forecast_vs_actual, "pipeline_distribution": op.pipeline_distribution,
    "pipeline_share": op.pipeline_share, "quota_matrix": op.quota_matrix, "quota_heatmap": op.quota_heatmap,
    "growth": op.revenue_growth_trend, "churn_impact": op.churn_impact, "forecast_confidence": op.forecast_confidence,
    "filter_options": op.filter_options, "quota_trend": op.quota_trend,
    **{f"aggregate_by_{c}": (lambda df, c=c: op.aggregate_by(df, c)) for c in ("region", "sales_stage", "month_label")},
    "dimensions": lambda df: rollup_by_dimensions(df, ["region", "subscription_plan"]),
}


@pytest.fixture(scope="module")
def predictions(spark):
    return catalog.with_standin_predictions(catalog.facts(spark, SF_SMALL)).persist()


@pytest.mark.parametrize("name", VIEWS)
def test_views_of_states_equal_views_of_facts(spark, predictions, name):
    """Unrounded, for the whole and for a slice."""
    cells = catalog.store(spark, SF_SMALL).table("cells")
    for part in ({}, SLICE):
        assert rows(VIEWS[name](op.apply_filters(cells, **part))) == rows(VIEWS[name](op.apply_filters(predictions, **part)))


@pytest.mark.parametrize("at", range(len(MARGINS)))
def test_margins_equal_their_own_sums(spark, predictions, at):
    store = catalog.store(spark, SF_SMALL)
    dims = MARGINS[at]
    found = store.states(*dims)
    assert set(found.columns) & set(DIMENSIONS) == set(dims)
    columns = sorted(found.columns)
    assert rows(found.select(columns)) == rows(summarize(predictions, dims, ["quota_attainment_probability"]).select(columns))
    assert found.count() <= store.table("cells").count() <= predictions.count()


def test_dimensions_with_nulls_are_not_taken_for_other_margins(spark):
    facts = typed_facts(spark, [{"record_id": f"R{i}", "region": None if i % 2 else "EMEA", "reporting_month": "2025-01"} for i in range(6)])
    cells = summarize(facts.withColumn("region", F.when(F.col("region") != "nan", F.col("region"))))
    margins = margins_of(cells)
    for at, dims in enumerate(MARGINS):
        one = margins.where(F.col("margin") == at)
        assert one.agg(F.sum("n_rows")).first()[0] == 6 and one.count() == (2 if "region" in dims else 1)


def test_no_view_of_the_registered_ones_reads_the_facts(spark):
    for name in ("top_metrics", "quality_report", "aggregate_by_team", "forecast_vs_actual", "forecast_confidence", "quota_trend", "filter_options"):
        text = plan_text(catalog.QUERIES[name](spark, SF_SMALL), "formatted")
        assert "/margins" in text and "/facts]" not in text, name


@pytest.mark.parametrize("view", ["aggregate_by_region", "growth", "risk", "accounts", "teams", "forecast_confidence"])
def test_sums_do_not_depend_on_the_partitions(spark, view):
    """Amounts whose floating-point sums differ with the order, no rounding outside."""
    views = {**VIEWS, "risk": op.revenue_risk_customers, "accounts": op.high_revenue_accounts, "teams": lambda df: op.underperforming_teams(df, 500)}
    x = (F.pmod(F.xxhash64("id"), F.lit(10**9)) / 100) * F.when(F.col("id") % 7 == 0, 1e6).otherwise(1.0)
    facts = typed_facts(spark, [{"record_id": "R", "reporting_month": "2025-01"}]).drop("record_id")
    amounts = {c: F.round(x, 2) for c in facts.columns if c.endswith("_eur")} | {"quota_attainment_pct": F.round(x % 300, 2), "forecast_confidence_score": F.round(x % 1, 4)}
    many = spark.range(20000).crossJoin(facts).withColumns(amounts).withColumns({
        "record_id": F.col("id").cast("string"), "region": (F.col("id") % 3).cast("string"), "customer_name": (F.col("id") % 50).cast("string")}).drop("id").persist()
    seen = {tuple(rows(views[view](many.repartition(n, F.rand(n))))) for n in (4, 16, 64)}
    many.unpersist()
    assert len(seen) == 1


def test_amounts_that_are_not_finite_or_very_large(spark):
    df = spark.createDataFrame([("a", 0.1), ("a", 0.2), ("b", float("inf")), ("b", 1.0), ("c", 1e300), ("c", 1.0), ("d", None), ("e", float("nan"))], "k string, x double")
    got = {r["k"]: (r["t"], r["m"]) for r in df.groupBy("k").agg(total(df, "x").alias("t"), mean(df, "x").alias("m")).collect()}
    assert got["a"] == (0.3, 0.15) and got["b"][0] == float("inf") and got["c"] == (1e300, 5e299) and got["d"] == (None, None)
    assert got["e"][0] != got["e"][0]
    assert df.where("false").agg(total(df, "x").alias("t")).first()[0] is None


def test_representatives_from_sketches(spark):
    store = catalog.store(spark, SF_SMALL)
    exact = {r["sales_team"]: r for r in op.underperforming_teams(store.facts, 500).collect()}
    near = op.underperforming_teams(store.states("region", "sales_team"), 500, store.teams).collect()
    assert len(near) == len(exact) > 1
    for r in near:
        want = exact[r["sales_team"]]
        assert abs(r["reps"] - want["reps"]) <= 4 * SKETCH_ERROR * want["reps"] + 1
        assert {k: v for k, v in r.asDict().items() if k != "reps"} == {k: v for k, v in want.asDict().items() if k != "reps"}


def groups(path, column):
    for f in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        at = meta.schema.names.index(column)
        for g in range(meta.num_row_groups):
            s = meta.row_group(g).column(at).statistics
            yield s.min, s.max


def test_a_slice_reads_few_row_groups(spark, tmp_path):
    """Two of five regions: about two fifths of the row groups, all of them in the order of the records."""
    facts = catalog.facts_plan(spark, SF_SMALL)
    share = {}
    for name, df in (("clustered", clustered(facts.repartition(4))), ("plain", facts.repartition(4, "record_id"))):
        path = str(tmp_path / name)
        df.write.option("parquet.block.size", 32 * 1024).option("parquet.page.size", 4096).option("parquet.block.size.row.check.min", 10).parquet(path)
        spans = list(groups(path, "region"))
        share[name] = sum(any(a <= r <= b for r in SLICE["regions"]) for a, b in spans) / len(spans)
    assert share["plain"] > 0.9 and share["clustered"] <= 0.5, share
    assert rows(spark.read.parquet(str(tmp_path / "clustered")).select("record_id")) == rows(facts.select("record_id"))


def test_a_cell_with_most_rows_is_split(spark):
    df = spark.range(40000).select(F.lit("EMEA").alias("region"), F.lit("2025-01").cast("string").alias("reporting_month"), F.col("id").cast("string").alias("record_id"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in clustered(df).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) == 4 and max(sizes) < 20000


def test_another_application_opens_the_store_and_writes_nothing(spark, monkeypatch):
    first = catalog.store(spark, SF_SMALL)
    catalog.reset_plans()  # as a new application starts

    def never(*args):
        raise AssertionError("written again")

    monkeypatch.setattr(st, "_write", never)
    again = catalog.store(spark, SF_SMALL)
    assert again is not first and again.manifest == first.manifest
    assert rows(op.top_metrics(again.states())) == rows(op.top_metrics(first.facts))
    monkeypatch.setattr(catalog, "sources_state", never)  # nor are files listed for a view
    assert catalog.store(spark, SF_SMALL) is again and catalog.QUERIES["kpi_status"](spark, SF_SMALL).count() == 1


def small_store(spark, root, state, fill=1):
    facts = lambda: typed_facts(spark, [{"record_id": "R", "reporting_month": "2025-01", "churned_revenue_eur": str(fill)}])
    return open_store(spark, str(root), state, facts)


def test_the_first_of_two_writers_wins(spark, tmp_path, monkeypatch):
    write = st._write

    def overtaken(spark_, root, *args):
        manifest = write(spark_, root, *args)
        monkeypatch.setattr(st, "_write", write)
        small_store(spark, tmp_path, "s", 5)  # another application commits meanwhile
        return manifest

    monkeypatch.setattr(st, "_write", overtaken)
    mine = small_store(spark, tmp_path, "s", 7)
    assert mine.facts.first()["churned_revenue_eur"] == 5.0
    assert os.listdir(tmp_path / "tables") == [mine.manifest["folder"].split("/")[1]]
    assert sorted(f for f in os.listdir(tmp_path) if not f.endswith(".crc")) == [f"manifest-{st.LAYOUT}-s.json", "tables"]


def test_a_writer_that_fails_leaves_no_manifest(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(st, "margins_of", lambda *args: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        small_store(spark, tmp_path, "s")
    monkeypatch.undo()
    assert not glob.glob(str(tmp_path / "manifest*"))
    assert small_store(spark, tmp_path, "s").facts.count() == 1


def test_states_of_sources_and_dropped_states(spark, tmp_path):
    (tmp_path / "a b%41").mkdir()
    paths = [str(tmp_path / "a b%41"), SF_SMALL + "/region.parquet"]
    spark.range(3).write.parquet(paths[0] + "/part")
    before = sources_state(spark, paths)
    assert sources_state(spark, paths) == before
    spark.range(4).write.mode("append").parquet(paths[0] + "/part")
    assert sources_state(spark, paths) != before
    small_store(spark, tmp_path / "st", "x")
    kept = small_store(spark, tmp_path / "st", "y")
    assert st.drop_store(spark, str(tmp_path / "st"), "x") and not st.drop_store(spark, str(tmp_path / "st"), "x")
    assert kept.facts.count() == 1 and st.drop_store(spark, str(tmp_path / "st"))


def test_content_fingerprint_sees_every_edit_and_no_order(spark):
    from quotaflow.sources import content_fingerprint, dataset_fingerprint

    one = lambda df: content_fingerprint(df).first()["content"]
    facts = catalog.facts(spark, SF_SMALL)
    whole = one(facts)
    assert one(facts.repartition(7).select(sorted(facts.columns))) == whole
    swapped = facts.withColumn("customer_growth_score", F.when(F.col("record_id") == facts.first()["record_id"], -1.0).otherwise(F.col("customer_growth_score")))
    assert dataset_fingerprint(swapped).first() == dataset_fingerprint(facts).first() and one(swapped) != whole
    small = lambda rows: one(spark.createDataFrame(rows, "a string, b string"))
    sets = [[("x", None)], [(None, "x")], [("x", "")], [("x", None)] * 2, [("x", None)] * 3, [], [("xy", "z")], [("x", "yz")]]
    assert len({small(s) for s in sets}) == len(sets)


def test_cells_are_written_when_first_asked_for_and_once(spark, tmp_path, monkeypatch):
    store = small_store(spark, tmp_path, "s")
    folder = tmp_path / store.manifest["folder"]
    assert store.states().first()["n_rows"] == 1 and not list(folder.glob("cells*"))
    assert store.states("month_label", "sales_team").first()["n_rows"] == 1
    monkeypatch.setattr(st, "summarize", lambda *args, **more: pytest.fail("written again"))
    again = small_store(spark, tmp_path, "s")
    assert rows(again.table("cells")) == rows(store.table("cells")) and len(list(folder.glob("cells-*"))) == 1
    assert st.drop_store(spark, str(tmp_path), "s") and not folder.exists()


def test_margins_of_facts_equal_those_of_cells(spark, predictions):
    extra = ["quota_attainment_probability"]
    facts = predictions.withColumn("region", F.when(F.col("region") != "ASIA", F.col("region")))
    direct = margins_of(facts, extra)
    assert rows(direct) == rows(margins_of(summarize(facts, extra=extra), extra).select(direct.columns))


def test_facts_of_large_sources_are_written_slice_by_slice(spark, tmp_path, monkeypatch):
    """Half the bytes at a time, and then the shuffle files are gone; every fact is there once."""
    whole = catalog.facts_plan(spark, SF_SMALL)
    monkeypatch.setattr(st, "SLICE_BYTES", 60_000)
    slices = catalog.fact_slices(spark, SF_SMALL)
    sizes = [s.count() for s in slices]
    assert len(slices) > 2 and min(sizes) > 0 and sum(sizes) == whole.count()
    spark.conf.set(st.CLEANUP, "false")
    seen, write = [], st.clustered
    monkeypatch.setattr(st, "clustered", lambda df: (seen.append(spark.conf.get(st.CLEANUP)), write(df))[1])
    try:
        store = open_store(spark, str(tmp_path), "s", lambda: slices)
        assert set(seen) == {"true"} and len(seen) == len(slices) and spark.conf.get(st.CLEANUP) == "false"
    finally:
        spark.conf.unset(st.CLEANUP)
    assert rows(store.facts) == rows(whole)
    assert rows(op.top_metrics(store.states())) == rows(op.top_metrics(whole))


def test_a_written_slice_leaves_no_shuffle_files(spark, tmp_path):
    shuffles = lambda: spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
        spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks())
    of = lambda: {str(b) for b in shuffles() if str(b).startswith("shuffle_")}
    before = of()
    with st.shuffles_removed(spark):
        clustered(catalog.facts_plan(spark, SF_SMALL)).write.parquet(str(tmp_path / "f"))
    import time
    until = time.time() + 20  # they go beside the caller
    while of() - before and time.time() < until:
        time.sleep(0.2)
    assert not of() - before
