"""Sources and sinks: tables, idempotent ingest of payloads, documents, blobs, event logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.functions import payload
from ledgerfold.sources.ranges import numbered
from ledgerfold.sources.scratch import file_system, hadoop_path, written

STATUSES = ("received", "processing", "needs_review", "approved", "rejected")
ONBOARDINGS = "id long, status string, idempotency_key string, document_paths map<string,string>, inserted_at timestamp, updated_at timestamp"
RUNS = "id long, onboarding_id long, status string, thread_id string, company_name string, w9_company_name string, tax_id binary, payment_terms string, liability_clauses string, explanation string, inserted_at timestamp, updated_at timestamp"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    """Point lookup: no row means not found. The filter reaches the Parquet scan."""
    return df.filter(F.col(key) == F.lit(value))


def looked_up(asked: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """Many point lookups: the rows of df for the asked keys, with result ok or not_found."""
    found = df.withColumnRenamed(key, "__key").withColumn("__there", F.lit(True))
    return asked.select(key).join(found, F.col(key) == F.col("__key"), "left").withColumn("result", F.when(F.col("__there"), "ok").otherwise("not_found")).drop("__key", "__there")


#: The two fields of a payload.
PARTS = ("contract", "w9")


def _decoded(payloads: DataFrame) -> DataFrame:
    """seq, raw, and each field's bytes: null where it isn't there as a string of strict base64. The body is parsed once."""
    parsed = payloads.select("seq", "raw", F.try_parse_json(F.col("raw").cast("string")).alias("__body"))
    texts = parsed.select("seq", "raw", *(payload.variant_text(F.col("__body"), k).alias(f"__{k}") for k in PARTS))
    return texts.select("seq", "raw", *(payload.strict_base64(F.col(f"__{k}")).alias(k) for k in PARTS))


def facts(payloads: DataFrame) -> DataFrame:
    """seq, idempotency_key and valid (both fields are there) of payloads (seq, raw): all that an outcome depends on."""
    return _decoded(payloads).select("seq", payload.content_hash(F.col("raw")).alias("idempotency_key"), (F.col("contract").isNotNull() & F.col("w9").isNotNull()).alias("valid"))


def decided(facts: DataFrame, ledger: DataFrame) -> DataFrame:
    """seq, idempotency_key, result and document_paths (of created ones) for facts(), against a ledger of keys."""
    first = facts.filter("valid").groupBy("idempotency_key").agg(F.min("seq").alias("__first"))
    new = first.join(ledger.select("idempotency_key"), "idempotency_key", "left_anti")
    result = F.when(~F.col("valid"), "invalid_payload").when(F.col("seq") == F.col("__first"), "created").otherwise("duplicate")
    paths = F.create_map(*(x for k in PARTS for x in (F.lit(k), F.concat("idempotency_key", F.lit(f"/{k}.pdf")))))
    out = facts.join(new, "idempotency_key", "left").withColumn("result", result)
    return out.select("seq", "idempotency_key", "result", F.when(F.col("result") == "created", paths).alias("document_paths"))


def ingest(payloads: DataFrame, ledger: DataFrame) -> DataFrame:
    """Payloads (raw binary, seq) with their outcome: created, duplicate or invalid_payload.

    A payload without both fields as strict base64 is invalid, however often it comes: nothing of it is stored.
    A valid one whose hash is in the ledger (idempotency_key) or came earlier in the batch is a duplicate; of
    equal payloads the least seq counts. Columns: seq, idempotency_key, result, and for those that are created
    contract and w9 (bytes) and document_paths. Outcomes come from hashes alone, which are written once; no content
    of a duplicate moves.
    """
    return with_contents(decided(written(facts(payloads), "facts"), ledger), payloads)


def with_contents(outcomes: DataFrame, payloads: DataFrame) -> DataFrame:
    """outcomes with contract and w9 of the created payloads."""
    made = outcomes.filter("result = 'created'").select(F.col("seq").alias("__seq"))
    contents = _decoded(payloads).drop("raw").join(made, F.col("seq") == F.col("__seq"), "left_semi").withColumnRenamed("seq", "__seq")
    return outcomes.join(contents, F.col("seq") == F.col("__seq"), "left").select("seq", "idempotency_key", "result", *PARTS, "document_paths")


def new_onboardings(outcomes: DataFrame, last_id: int, now) -> DataFrame:
    """Rows to append to the onboardings: ids follow last_id in the order of seq."""
    created = numbered(outcomes.filter("result = 'created'").select("seq", "idempotency_key", "document_paths"), "seq", last_id + 1)
    return created.select("id", F.lit("received").alias("status"), "idempotency_key", "document_paths", F.lit(now).cast("timestamp").alias("inserted_at"), F.lit(now).cast("timestamp").alias("updated_at"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path and text of every file below a folder; malformed UTF-8 is replaced, an empty file is an empty text.

    Spark's file source passes over empty files: their names come from the listing of the folder.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    found = files.select("path", payload.utf8(F.col("content")).alias("text"))
    listing = file_system(spark, path).listFiles(hadoop_path(spark, path), True)
    empty = []
    while listing.hasNext():
        f = listing.next()
        name = f.getPath().getName()
        if not f.getLen() and not name.startswith(("_", ".")):
            empty.append((f.getPath().toString(), ""))
    return found.union(spark.createDataFrame(empty, "path string, text string")) if empty else found


def store_blobs(blobs: DataFrame, root: str) -> None:
    """Appends (path, content) to the blob table at root, a folder of any file system that Spark writes."""
    blobs.select("path", "content", F.current_timestamp().alias("stored_at"), F.expr("uuid()").alias("stored_as")).write.mode("append").parquet(root)


def load_blobs(spark: SparkSession, root: str) -> DataFrame:
    """path and content of the blobs at root: of a path that was stored again, the last content."""
    return spark.read.parquet(root).groupBy("path").agg(F.max_by("content", F.struct("stored_at", "stored_as")).alias("content"))


def texts(blobs: DataFrame) -> DataFrame:
    """path and text of blobs; malformed UTF-8 is replaced, an empty blob is an empty text."""
    return blobs.select("path", payload.utf8(F.col("content")).alias("text"))


def append(df: DataFrame, path: str) -> None:
    """Appends to an event log or a table."""
    df.write.mode("append").parquet(path)


def pending_work(onboardings: DataFrame, runs: DataFrame, attempts: int = 1, width: int | None = None) -> DataFrame:
    """The work list: received onboardings with fewer runs than attempts, oldest first; width of them at most, if given.

    With one attempt that is every one without a run. Each failed attempt leaves a run, so five attempts are five runs.
    """
    tried = runs.groupBy(F.col("onboarding_id").alias("id")).agg(F.count("*").alias("__tried"))
    left = onboardings.filter("status = 'received'").join(tried, "id", "left").withColumn("attempt", F.coalesce("__tried", F.lit(0)) + 1).filter(F.col("attempt") <= attempts).drop("__tried")
    return left if width is None else left.orderBy("inserted_at", "id").limit(width)


#: Seconds before an attempt is repeated: DELAY and two to the power of the attempt, up to the greatest power.
DELAY, GREATEST_POWER = 15, 20


def due_work(onboardings: DataFrame, runs: DataFrame, now: Column, attempts: int = 5, width: int | None = None) -> DataFrame:
    """The work list at a time: rows of pending_work() that were never tried, or whose last run (inserted_at) is longer
    ago than the delay of that attempt. due_at is null for the former."""
    tried = runs.groupBy(F.col("onboarding_id").alias("id")).agg(F.count("*").alias("__tried"), F.max("inserted_at").alias("__last"))
    left = onboardings.filter("status = 'received'").join(tried, "id", "left").withColumn("attempt", F.coalesce("__tried", F.lit(0)) + 1).filter(F.col("attempt") <= attempts)
    wait = F.lit(DELAY) + F.pow(F.lit(2), F.least(F.col("attempt") - 1, F.lit(GREATEST_POWER)))
    due = left.withColumn("due_at", F.col("__last") + F.make_dt_interval(secs=wait)).filter(F.col("due_at").isNull() | (F.col("due_at") <= now)).drop("__tried", "__last")
    return due if width is None else due.orderBy("inserted_at", "id").limit(width)


def outcome(status: Column, error: Column) -> Column:
    """ok for an answer of 200 to 299; unexpected_status: N for another; error: text where there was none."""
    return F.when(error.isNotNull(), F.concat(F.lit("error: "), error)).when(status.between(200, 299), "ok").otherwise(F.concat(F.lit("unexpected_status: "), F.coalesce(status.cast("string"), F.lit("none"))))


def delivered(requests: DataFrame, send: Callable[[dict], int], key: str) -> DataFrame:
    """key, http_status, error and outcome of sending each request (a row as a dict): an external call is the one
    thing here that no expression can do. A repeated task sends again, so the receiver must accept repeats."""

    def run(frames: Iterator) -> Iterator:
        for frame in frames:
            codes, errors = [], []
            for row in frame.to_dict("records"):
                try:
                    codes.append(send(row))
                    errors.append(None)
                except Exception as e:  # the row says what went wrong, and the others go on
                    codes.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield frame[[key]].assign(http_status=codes, error=errors).astype({"http_status": "Int32"})

    kind = requests.schema[key].dataType.simpleString()
    return requests.mapInPandas(run, f"{key} {kind}, http_status int, error string").withColumn("outcome", outcome(F.col("http_status"), F.col("error")))


def create_schema(spark: SparkSession, name: str, location: str | None = None) -> None:
    """A schema, if there is none of the name; its tables are kept at the location, if one is given, else in the warehouse."""
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name}{where}")


def rename_table(spark: SparkSession, old: str, new: str) -> None:
    """Renames a table; the other way round undoes it."""
    spark.sql(f"ALTER TABLE {old} RENAME TO {new}")


def orphans(children: DataFrame, parents: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Rows that break the foreign key."""
    return children.join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")


def cascade(children: DataFrame, parents: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Children that remain once parents are deleted."""
    return children.join(parents.select(F.col(parent_key).alias(key)), key, "left_semi")
