"""Incremental runs with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from sitecontacts.functions import urls as ur
from sitecontacts.operators import attribution as at
from sitecontacts.operators import evidence as ev
from sitecontacts.operators import progress as pg
from sitecontacts.operators import scoring as sc
from sitecontacts.options import Options
from sitecontacts.plans import enrich as en
from sitecontacts.plans.lineage import large
from sitecontacts.sources import sinks
from sitecontacts.sources.captures import newest_pages, usable_pages
from sitecontacts.sources.leads import quoted, to_targets
from sitecontacts.sources.robots import allowed_urls

def read_page_stream(
    spark: SparkSession, path: str, name: str = "*", schema: str | None = None
) -> DataFrame:
    """Captured pages arriving as parquet files named like `name` in a folder.

    Without a schema that of the files already there is used, with their status where they have one.
    """
    if schema is None:
        schema = spark.read.option("pathGlobFilter", name).parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(path)


def stream_evidence(
    pages: DataFrame, out: str, checkpoint: str, options: Options = Options(), rules: DataFrame | None = None
) -> StreamingQuery:
    """Stateless evidence extraction; appends rows as pages arrive and stops when caught up.

    With `rules`, a table, pages a robots file denies give no rows; they are taken out after
    extraction, where rows no longer carry the page text.
    """
    rows = ev.extract_evidence(usable_pages(pages), options)
    if rules is not None and options.respect_robots:
        rows = allowed_urls(rows, rules)
    return (
        rows.writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def _batch_parts(pages: DataFrame, options: Options, rules: DataFrame | None = None) -> DataFrame:
    """Every usable page with its addresses; a page without any keeps a row, as it may replace an older capture."""
    usable = usable_pages(pages)
    page_emails = ev.dedupe_page_emails(ev.explode_evidence(ev.with_evidence(usable, options)))
    rows = usable.select("page_id", "url").join(large(page_emails.drop("url")), "page_id", "left")
    return allowed_urls(rows, rules) if rules is not None and options.respect_robots else rows


def stream_running_best(
    pages: DataFrame, state: str, checkpoint: str, options: Options = Options(), rules: DataFrame | None = None,
    compact_every: int = 8,
) -> StreamingQuery:
    """Keep the addresses of pages up to date as pages arrive; every page is read and extracted once.

    A page is whole within one batch, so each batch writes its own pages to `state`/delta=N. A
    batch that is run again replaces its own folder, so nothing is counted twice. Every
    `compact_every` batches the newest captures so far, and their candidates counted per host, are
    written as a new base, so a read meets one base and a bounded number of deltas, however
    long the stream has run.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        _batch_parts(batch, options, rules).write.mode("overwrite").parquet(f"{state}/delta={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            compact(batch.sparkSession, state, batch_id)

    return (
        pages.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def compact(spark: SparkSession, state: str, upto: int) -> None:
    """Write the state after batch `upto` as a base; the counts come last and make it valid."""
    _captured(spark, state, upto, upto - 1).write.mode("overwrite").parquet(f"{state}/base={upto}")
    counted = at.count_hosts(spark.read.parquet(f"{state}/base={upto}").where("email is not null"))
    counted.write.mode("overwrite").parquet(f"{state}/hosts={upto}")


def _versions(spark: SparkSession, state: str, kind: str) -> list[int]:
    """Numbers of the finished folders of one kind."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{state}/{kind}=*/_SUCCESS")
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])


def _read(spark: SparkSession, state: str, base: int | None, deltas: list[int]) -> DataFrame:
    paths = [f"{state}/delta={n}" for n in deltas] + ([] if base is None else [f"{state}/base={base}"])
    return spark.read.option("mergeSchema", True).parquet(*paths)


def _parts(spark: SparkSession, state: str, upto: int | None = None, before: int | None = None) -> tuple[int | None, list[int]]:
    """The newest base, not after batch `before`, and the later deltas up to batch `upto`."""
    bases = [v for v in _versions(spark, state, "hosts") if before is None or v <= before]
    base = max(bases, default=None)
    deltas = _versions(spark, state, "delta")
    return base, [n for n in deltas if (base is None or n > base) and (upto is None or n <= upto)]


def _captured(spark: SparkSession, state: str, upto: int | None = None, before: int | None = None) -> DataFrame:
    """Rows of the newest capture of every URL."""
    rows = _read(spark, state, *_parts(spark, state, upto, before))
    return rows.join(large(newest_pages(rows).select("page_id")), "page_id", "left_semi")


def running_hosts(spark: SparkSession, state: str) -> DataFrame:
    """Candidates counted per host as of the last batch.

    Counts of the base stay for hosts without a newer page. The hosts of the deltas are counted
    anew, so what an older capture had added is taken back.
    """
    base, deltas = _parts(spark, state)
    if not deltas:
        return spark.read.parquet(f"{state}/hosts={base}")
    host = ur.url_host(F.col("url"))
    touched = _read(spark, state, None, deltas).select(host.alias("host")).distinct()
    rows = _read(spark, state, base, deltas).withColumn("host", host).join(large(touched), "host", "left_semi").drop("host")
    rows = rows.join(large(newest_pages(rows).select("page_id")), "page_id", "left_semi")
    fresh = at.count_hosts(rows.where("email is not null"))
    if base is None:
        return fresh
    return spark.read.parquet(f"{state}/hosts={base}").join(large(touched), "host", "left_anti").unionByName(fresh)


def running_best(spark: SparkSession, state: str) -> DataFrame:
    """Current winner per site."""
    counted = running_hosts(spark, state).withColumnRenamed("site", "domain")
    return sc.best_per_site(sc.score_candidates(sc.merge_candidates(counted, ["domain"])), ["domain"])


def enrich_remaining(
    leads: DataFrame, pages: DataFrame | None, out: str, progress: str, batch: str,
    domain_dns: DataFrame | None = None, options: Options = Options(), rules: DataFrame | None = None,
    state: str | None = None,
) -> None:
    """One resumable step: enrich the leads that are not done yet and note them as done.

    With `state`, the folder of `stream_running_best`, candidates are those counted there, and no
    page is read; robots rules have been applied there. Else all pages are extracted.
    leads(row_index, ...). Results and progress of a step go to folders named by
    `batch`; a step run again under the same name replaces them, so no lead is
    written twice. The progress table is written last.
    """
    spark = leads.sparkSession
    done = done_rows(spark, progress, other_than=batch)
    todo = pg.remaining(leads, done)
    if state is not None:
        enriched = en.enrich_counted(todo, running_hosts(spark, state), domain_dns, options)
    else:
        enriched = en.enrich_captured(todo, pages, domain_dns, options, rules)
    sinks.write_enriched(enriched, leads.columns, f"{out}/batch={batch}", mode="overwrite")
    website = to_targets(todo).select("row_index", F.col("target.website").alias("website"))
    noted = todo.select("row_index").join(large(website), "row_index", "left")
    noted.select(
        "row_index", F.coalesce("website", F.lit("skipped-missing-url")).alias("website"),
        F.current_timestamp().alias("done_at"),
    ).write.mode("overwrite").parquet(f"{progress}/batch={batch}")


def done_rows(spark: SparkSession, progress: str, other_than: str | None = None) -> DataFrame:
    """Progress rows of all steps but one; empty before the first step."""
    schema = "row_index bigint, website string, done_at timestamp, batch string"
    if not is_folder(spark, progress):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(progress)
    return rows if other_than is None else rows.where(F.col("batch") != other_than)


def is_folder(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.exists(hadoop) and files.getFileStatus(hadoop).isDirectory()


def stream_enrichment(
    leads: DataFrame, pages: DataFrame | None, lead_columns: list[str], out: str, progress: str,
    checkpoint: str, domain_dns: DataFrame | None = None, options: Options = Options(), rules: DataFrame | None = None,
    state: str | None = None,
) -> StreamingQuery:
    """Enrich leads as lead files arrive; a restart goes on after the last finished batch.

    leads is a stream with row_index and the lead columns; pages is a table, or candidates come from `state`.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        enrich_remaining(
            batch.select("row_index", *[F.col(quoted(c)) for c in lead_columns]), pages, out, progress, str(batch_id),
            domain_dns, options, rules, state,
        )

    return (
        leads.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
