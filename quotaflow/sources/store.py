"""The cleaned facts kept for many views and many applications.

A store is a folder on shared storage with, for each state of the source files,

- ``facts``: the facts, range-clustered by (region, month) on sampled boundaries, so that a
  slice skips row groups and pages by their statistics. Large sources are joined and clustered slice by
  slice of the order keys; a slice's shuffle files go before the next one starts. A cell that holds a large part of
  all rows is split further by a hash of the record id;
- ``margins``: mergeable states (exact sums, counts) for a few dimensions, some thousand rows for whole-table
  views, added up from the facts in one pass;
- ``cells``: the same states by month, region, product, team, plan, stage and confidence bucket. They are bounded
  by the dimensions, but up to many millions of facts nearly as many as these and wider; no margin needs
  them, so they are written when a view of other dimensions first asks for them;
- ``teams``: a distinct-count sketch of the representatives of each team;
- a manifest that names them. It is written beside and renamed into place, named after the
  state: a reader sees all of it or nothing, the first of several writers wins, and the next
  application opens the tables without writing or listing the sources' files again.

Nothing is replaced under its readers: another state of the sources has tables of its own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotaflow.functions import confidence_bucket_id
from quotaflow.functions.states import are_states, states
from quotaflow.schema import FILTER_DIMENSIONS

#: Raise when the tables or the facts mapping change: older manifests are then not found.
LAYOUT = 2
CLUSTER_BY = ("region", "reporting_month")
DIMENSIONS = ("month_label", "region", "product_line", "sales_team", "subscription_plan", "sales_stage", "bucket_id")
AMOUNTS = ("total_revenue_eur", "monthly_recurring_revenue_eur", "expansion_revenue_eur", "renewal_revenue_eur",
           "churned_revenue_eur", "pipeline_value_eur", "closed_won_value_eur", "closed_lost_value_eur",
           "forecasted_revenue_next_quarter", "quota_attainment_pct", "forecast_confidence_score")
#: Dimensions of the margins, those with the fewest rows first.
MARGINS = (("sales_stage",), ("bucket_id",), ("month_label", "region"), tuple(FILTER_DIMENSIONS.values()), ("month_label", "product_line"))
#: Dimensions by which facts are added up on the way to the margins; each margin's are within one of them. The
#: facts are clustered by region and month, so a task has few of either.
PARTS = ((*FILTER_DIMENSIONS.values(), "sales_stage"), ("month_label", "region", "product_line", "bucket_id"))
#: Source bytes whose facts are joined and clustered at a time; what shuffles take of the disk is bounded by them.
SLICE_BYTES = 256 << 20
#: Whether the shuffle files of a finished write go at once, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Names the cells' table, in the folder of the other tables.
CELLS = "cells.json"
#: Checks that quality_report needs, by how they merge.
CHECKS = {"revenue_diff_eur": F.max, "negative_revenue_rows": F.sum, "missing_targets": F.sum}
#: log2 of a sketch's slots; its relative standard error is about 1.04 / sqrt(slots).
SKETCH_BITS = 12
SKETCH_ERROR = 1.04 / (1 << SKETCH_BITS) ** 0.5


def _checks(df: DataFrame) -> list:
    if are_states(df):
        return [merge(c).alias(c) for c, merge in CHECKS.items()]
    expected = (F.col("monthly_recurring_revenue_eur") + F.col("expansion_revenue_eur") + F.col("renewal_revenue_eur") - F.col("churned_revenue_eur"))
    return [F.max(F.abs(F.col("total_revenue_eur") - expected)).alias("revenue_diff_eur"),
            F.count_if(F.col("total_revenue_eur") < 0).alias("negative_revenue_rows"),
            F.count_if(F.col("sales_target_eur") <= 0).alias("missing_targets")]


def summarize(df: DataFrame, by: Sequence[str] = DIMENSIONS, extra: Sequence[str] = ()) -> DataFrame:
    """The states of facts, or of finer states, by some dimensions. ``extra`` names further
    amounts, such as a model's probability."""
    amounts = [*AMOUNTS, *extra]
    if not are_states(df) and "bucket_id" in by:
        df = df.withColumn("bucket_id", confidence_bucket_id("forecast_confidence_score"))
    return df.groupBy(*by).agg(*states(df, amounts), *_checks(df))


def _by_sets(df: DataFrame, sets: Sequence[Sequence[str]], place: str, extra: Sequence[str]) -> DataFrame:
    """The states of facts or finer states by several sets of dimensions in one pass: ``place`` is the place of the
    set a row belongs to, its other dimensions are null."""
    dims = sorted({d for m in sets for d in m})
    grouped = df.groupingSets([list(m) for m in sets], *dims).agg(
        *states(df, [*AMOUNTS, *extra]), *_checks(df), F.grouping_id(*dims).alias("gid"))
    # In a grouping id the first column is the highest bit, set where the column is left out.
    ids = [sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in m) for m in sets]
    which = F.array_position(F.array(*[F.lit(i) for i in ids]), F.col("gid").cast("int")) - 1
    return grouped.withColumn(place, which.cast("int")).drop("gid")


def margins_of(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """All MARGINS of facts, or of finer states, in one pass: ``margin`` is the place of the set a row
    belongs to, its other dimensions are null. Facts are added up by the PARTS first, inside the tasks that
    read them, so what leaves a task is bounded by the parts, and only their rows meet the five sets."""
    if are_states(df):
        return _by_sets(df, MARGINS, "margin", extra)
    parts = _by_sets(df.withColumn("bucket_id", confidence_bucket_id("forecast_confidence_score")), PARTS, "part", extra)
    source = [next(at for at, p in enumerate(PARTS) if set(m) <= set(p)) for m in MARGINS]
    found = _by_sets(parts, [(*m, "part") for m in MARGINS], "margin", extra)
    return found.where(F.col("part") == F.element_at(F.array(*map(F.lit, source)), F.col("margin") + 1)).drop("part")


def clustered(df: DataFrame, by: Sequence[str] = CLUSTER_BY, split_by: str = "record_id") -> DataFrame:
    """``df`` in key ranges with boundaries from a sample, sorted inside; equal keys that would fill
    more than a range are split by a hash of ``split_by``."""
    salt = F.xxhash64(split_by)
    return df.repartitionByRange(*by, salt).sortWithinPartitions(*by, salt)


def sources_state(spark: SparkSession, paths: Sequence[str]) -> str:
    """A digest of the files below ``paths``: number, names, lengths and times of change, added up
    where Spark lists them; neither names nor contents come to the driver."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    r = files.agg(F.count("*").alias("n"), F.sum("length").alias("bytes"),
                  F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("h")).first()
    return f"{r['n']}-{r['bytes'] or 0}-{int(r['h'] or 0) % (1 << 64):016x}"


class Folder:
    """A folder of the session's Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf, self.path = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path.rstrip("/")
        self.fs = self._path("").getFileSystem(self.conf)
        self.no_options = spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def read(self, name: str) -> str | None:
        try:
            stream = self.fs.open(self._path(name))
        except Exception as e:
            if "FileNotFoundException" in str(e):
                return None
            raise
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def commit(self, name: str, text: str) -> bool:
        """Make ``name`` with all of ``text`` at once; False if there is one already."""
        beside = self._path(f".{name}.{uuid.uuid4().hex}")
        stream = self.fs.create(beside, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:  # unlike a file system's own rename, this one never replaces
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(
                beside, self._path(name), self.no_options)
            return True
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            return False
        finally:
            self.fs.delete(beside, False)

    def delete(self, name: str = "") -> bool:
        path = self._path(name)
        return bool(self.fs.exists(path) and self.fs.delete(path, True))

    def bytes(self, paths: Sequence[str]) -> int:
        """What the files below the paths hold."""
        at = [self.jvm.org.apache.hadoop.fs.Path(p) for p in paths]
        return sum(p.getFileSystem(self.conf).getContentSummary(p).getLength() for p in at)

    def changed_at(self, paths: Sequence[str]) -> tuple:
        """Times of change and lengths of the paths themselves, one look-up each and no listing."""
        out = []
        for p in paths:
            path = self.jvm.org.apache.hadoop.fs.Path(p)
            status = path.getFileSystem(self.conf).getFileStatus(path)
            out.append((status.getModificationTime(), status.getLen()))
        return tuple(out)


@dataclass
class Store:
    """The tables of one state of the sources, opened from a manifest. ``derived`` and ``extra`` are those
    of ``open_store``."""

    spark: SparkSession
    root: str
    manifest: dict
    derived: Callable[[DataFrame], DataFrame] | None = None
    extra: Sequence[str] = ()
    _opened: dict[str, DataFrame] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        if name not in self._opened:
            entry = self.manifest["tables"].get(name) or self._cells()
            schema = T.StructType.fromJson(entry["schema"])
            self._opened[name] = self.spark.read.schema(schema).parquet(f"{self.root}/{entry['path']}")
        return self._opened[name]

    def _cells(self) -> dict:
        """The entry of the cells, written beside the other tables when they are first asked for; of several
        writers the first wins."""
        folder = Folder(self.spark, f"{self.root}/{self.manifest['folder']}")
        if (text := folder.read(CELLS)) is None:
            facts = self.derived(self.facts) if self.derived else self.facts
            cells, name = summarize(facts, extra=self.extra), f"cells-{uuid.uuid4().hex}"
            cells.write.parquet(f"{folder.path}/{name}")
            entry = {"path": f"{self.manifest['folder']}/{name}", "schema": cells.schema.jsonValue()}
            if folder.commit(CELLS, json.dumps(entry)):
                return entry
            folder.delete(name)
            text = folder.read(CELLS)
        return json.loads(text)

    @property
    def facts(self) -> DataFrame:
        return self.table("facts")

    @property
    def teams(self) -> DataFrame:
        return self.table("teams")

    def states(self, *columns: str) -> DataFrame:
        """The smallest table of states that has these dimensions; filters may use them all."""
        for at, dims in enumerate(MARGINS):
            if set(columns) <= set(dims):
                return self.table("margins").where(F.col("margin") == at).drop("margin", *(set(DIMENSIONS) - set(dims)))
        return self.table("cells")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written here leaves no shuffle files behind; the session's own setting is put back."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def _write(spark: SparkSession, root: str, facts: DataFrame | Sequence[DataFrame], derived: Callable[[DataFrame], DataFrame] | None,
           extra: Sequence[str]) -> dict:
    folder, tables = f"tables/{uuid.uuid4().hex}", {}

    def keep(name: str, *parts: DataFrame, **partition) -> DataFrame:
        for df in parts:
            writer = df.write.mode("append")
            (writer.partitionBy(*partition["by"]) if partition else writer).parquet(f"{root}/{folder}/{name}")
        tables[name] = {"path": f"{folder}/{name}", "schema": df.schema.jsonValue()}
        return spark.read.schema(df.schema).parquet(f"{root}/{folder}/{name}")

    with shuffles_removed(spark):
        kept = keep("facts", *map(clustered, [facts] if isinstance(facts, DataFrame) else facts))
    keep("margins", margins_of(derived(kept) if derived else kept, extra), by=["margin"])
    keep("teams", kept.groupBy("region", "sales_team").agg(F.hll_sketch_agg("account_executive", SKETCH_BITS).alias("reps_sketch")))
    return {"layout": LAYOUT, "folder": folder, "tables": tables}


def open_store(spark: SparkSession, root: str, state: str, facts: Callable[[], DataFrame | Sequence[DataFrame]],
               derived: Callable[[DataFrame], DataFrame] | None = None, extra: Sequence[str] = ()) -> Store:
    """The store of a source ``state`` below ``root``: opened if its manifest is there, else written
    from ``facts()``, one DataFrame or slices that are written one after the other, and committed. ``derived`` adds the ``extra`` amounts to facts before they are added up.
    A writer that another one has overtaken deletes its own tables and opens the other's."""
    folder = Folder(spark, root)
    name = f"manifest-{LAYOUT}-{state}.json"
    if (text := folder.read(name)) is None:
        manifest = {"state": state, **_write(spark, root, facts(), derived, extra)}
        if folder.commit(name, json.dumps(manifest)):
            return Store(spark, root, manifest, derived, extra)
        folder.delete(manifest["folder"])
        text = folder.read(name)
    return Store(spark, root, json.loads(text), derived, extra)


def drop_store(spark: SparkSession, root: str, state: str | None = None) -> bool:
    """Delete the tables of one state, manifest first, or the whole folder."""
    folder = Folder(spark, root)
    if state is None:
        return folder.delete()
    name = f"manifest-{LAYOUT}-{state}.json"
    if (text := folder.read(name)) is None:
        return False
    folder.delete(name)
    return folder.delete(json.loads(text)["folder"])
