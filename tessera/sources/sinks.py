"""Where results go: an event log and settlements that a replayed batch doesn't write twice, CSV and JSON reports; and dimensions and file listings to read."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What a report's export says of itself, the rows it may have, and what a cell may not begin with in a spreadsheet.
DEFINITIONS, MOST_ROWS = "1.0.0", 10_000
_FORMULA = r"^[\s]*[=+\-@]|^[\t\r\n]"

EVENT_LOG = ("event_type", "account_id", "job_id", "feature_id", "channel", "locale", "plan_at_event", "environment", "properties")


def recorded(requests: DataFrame, accounts: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """Events as the log keeps them. requests: account_id, event_type, job_id, feature_id, channel, properties; null channel is web, null properties are {}.

    Locale, plan and whether an account is a test are the account's at that moment; the feature is the job's where there is a job.
    """
    a = accounts.select(F.col("id").alias("_a"), "locale", F.col("plan").alias("plan_at_event"), "is_test")
    r = requests.join(a, F.col("account_id") == F.col("_a"))
    feature = F.coalesce("feature_id", F.lit(""))
    if jobs is not None:
        r = r.join(jobs.select(F.col("id").alias("_j"), F.col("feature_id").alias("_feature")), F.col("job_id") == F.col("_j"), "left")
        feature = F.when(F.col("_j").isNotNull(), F.col("_feature")).otherwise(feature)
    channel, properties = F.coalesce("channel", F.lit("web")), F.coalesce("properties", F.lit("{}"))
    environment = F.when(F.col("is_test"), "development").otherwise("production")
    return r.select("event_type", "account_id", "job_id", feature.alias("feature_id"), channel.alias("channel"), "locale", "plan_at_event", environment.alias("environment"), properties.alias("properties"))


class Ledger:
    """Which batches of a stream a table has. A mark is made after a batch's files are there, so that a batch cut off in between is written over."""

    def __init__(self, spark: SparkSession, path: str, name: str):
        self.path, self.name, self._jvm = path.rstrip("/"), name, spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _mark(self, batch_id: int):
        where = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_ledger/{self.name}/{batch_id}")
        return where, where.getFileSystem(self._conf)

    def has(self, batch_id: int) -> bool:
        where, files = self._mark(batch_id)
        return files.exists(where)

    def mark(self, batch_id: int) -> None:
        where, files = self._mark(batch_id)
        files.create(where, True).close()


def once(path: str, name: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """A writer for foreachBatch: what `prepare` makes of a batch goes to a folder of its own, once, however often the batch is replayed."""

    def write(batch: DataFrame, batch_id: int) -> None:
        ledger = Ledger(batch.sparkSession, path, name)
        if not ledger.has(batch_id):
            prepare(batch).write.mode("overwrite").parquet(f"{path.rstrip('/')}/stream={name}/batch={batch_id}")
            ledger.mark(batch_id)

    return write


def log_events(requests: DataFrame, accounts: DataFrame, jobs: DataFrame | None, path: str, checkpoint: str, name: str = "events"):
    """S4 as a stream: requests are recorded as they come."""
    return requests.writeStream.option("checkpointLocation", checkpoint).foreachBatch(once(path, name, lambda df: recorded(df, accounts, jobs)))


def settle(results: DataFrame, path: str, checkpoint: str, terminal: tuple[str, ...], late: str = "1 hour", name: str = "settled"):
    """Q12 as a stream: of a job's results (job_id, status, completed_at) the first that ends it is written, once; what comes later within the watermark is ignored."""
    ends = results.filter(F.col("status").isin(*terminal)).withWatermark("completed_at", late)
    return ends.dropDuplicatesWithinWatermark(["job_id"]).writeStream.option("checkpointLocation", checkpoint).foreachBatch(once(path, name))


def csv_cell(value: Column) -> Column:
    """A cell as text: null is empty, what a spreadsheet would run gets an apostrophe, what holds a separator gets quotes."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    text = F.when(text.rlike(_FORMULA), F.concat(F.lit("'"), text)).otherwise(text)
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def local(ts: Column, zone: str) -> Column:
    """A time in a zone with its offset, as exports write it."""
    there = F.from_utc_timestamp(ts, zone)
    minutes = (F.unix_timestamp(there) - F.unix_timestamp(ts)) / 60
    sign = F.when(minutes < 0, "-").otherwise("+")
    offset = F.format_string("%s%02d:%02d", sign, F.floor(F.abs(minutes) / 60), (F.abs(minutes) % 60).cast("int"))
    fraction = F.when(F.date_format(there, "SSSSSS") == "000000", "").otherwise(F.concat(F.lit("."), F.date_format(there, "SSSSSS")))
    return F.concat(F.date_format(there, "yyyy-MM-dd HH:mm:ss"), fraction, offset)


def exported(rows: DataFrame, filters, order: list[Column], generated_at: str, most: int | None = MOST_ROWS, first: str | None = None) -> DataFrame:
    """(no, line) of a CSV export: what it is, its filters, the columns' names, the rows in order. More than `most` rows raise ValueError before any is written.

    Without `most` every row goes out. `first` names the column that `order` begins with: then rows are numbered within each of its values, after a count of those before.
    """
    spark = rows.sparkSession
    if most is not None and rows.limit(most + 1).count() > most:
        raise ValueError(f"Narrow filters to at most {most} rows")
    about = [("definitions_version", DEFINITIONS), ("generated_at", generated_at), ("times_timezone", filters.timezone), *dataclasses.asdict(filters).items()]
    head = spark.createDataFrame([(i - len(about) - 1, k, str(x)) for i, (k, x) in enumerate(about)], "no long, k string, x string").select("no", F.concat(F.col("k"), F.lit(","), csv_cell(F.col("x"))).alias("line"))
    names = spark.createDataFrame([(-1, ",".join(rows.columns))], "no long, line string")
    line = F.concat_ws(",", *[csv_cell(F.col(c)) for c in rows.columns]).alias("line")
    if first is None:
        no = F.row_number().over(Window.orderBy(*order))  # at most `most` rows
    else:
        upto = F.sum("_n").over(Window.orderBy(order[0]).rowsBetween(Window.unboundedPreceding, -1))  # a row a value of `first`
        counts = rows.groupBy(first).agg(F.count("*").alias("_n")).select(F.col(first).alias("_first"), F.coalesce(upto, F.lit(0)).alias("_before"))
        rows = rows.join(F.broadcast(counts), F.col(first).eqNullSafe(F.col("_first")))
        no = F.col("_before") + F.row_number().over(Window.partitionBy(first).orderBy(*order[1:]))
    body = rows.select((no.cast("long") - 1).alias("no"), line)
    lines = head.unionByName(names).unionByName(body)
    first = -len(about) - 1
    return lines.select((F.col("no") - first).alias("no"), F.when(F.col("no") == first, F.concat(F.lit("﻿"), "line")).otherwise(F.col("line")).alias("line"))


def write_csv(lines: DataFrame, path: str) -> None:
    """Lines of an export as one file of a folder, ended as spreadsheets end them."""
    lines.repartition(1).sortWithinPartitions("no").select("line").write.option("lineSep", "\r\n").mode("overwrite").text(path)


def report_json(parts: dict[str, DataFrame]) -> DataFrame:
    """One document of a report: each part an array of its rows, in the order of their columns, nulls kept."""
    spark = next(iter(parts.values())).sparkSession
    whole = spark.range(1).select()
    for name, df in parts.items():
        rows = df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))  # a report's rows: few
        whole = whole.crossJoin(rows)
    return whole.select(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("report"))


def json_dimension(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """The records of one field of a JSON document."""
    whole = spark.read.option("wholetext", "true").text(path)
    return whole.select(F.inline(F.from_json(F.get_json_object("value", f"$.{field}"), f"array<struct<{schema}>>")))


def csv_dimension(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header and maybe a byte-order mark; every column is text."""
    df = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def listing(spark: SparkSession, path: str) -> DataFrame:
    """The files under a path; their contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")


def unclaimed(files: DataFrame, claimed: DataFrame, now: Column, grace: str = "1 day") -> DataFrame:
    """Files older than the grace that no row claims. files: key, modified_at; claimed: key."""
    return files.filter(F.col("modified_at") < now - F.expr(f"INTERVAL {grace}")).join(claimed.select("key").distinct(), "key", "left_anti")


def stored(uploads: DataFrame, most_bytes: int) -> DataFrame:
    """Path, hash and size of uploaded files, and why one is refused: empty, too large, or not what its name says."""
    head = F.hex(F.substring("content", 1, 4))
    size, name = F.length("content"), F.lower("path")
    wrong = (name.endswith(".pdf") & (head != "25504446")) | (name.endswith(".png") & (head != "89504E47")) | ((name.endswith(".jpg") | name.endswith(".jpeg")) & ~head.startswith("FFD8FF")) | ((name.endswith(".docx") | name.endswith(".xlsx") | name.endswith(".pptx") | name.endswith(".zip")) & (head != "504B0304"))
    code = F.when(F.coalesce(size, F.lit(0)) == 0, "empty_file").when(size > most_bytes, "file_too_large").when(wrong, "file_type_mismatch")
    return uploads.select("path", F.sha2("content", 256).alias("sha256"), size.cast("long").alias("size_bytes"), code.alias("refused"))
