"""Limits and feeds over events: as batch jobs, and as streams of the same file."""

from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from leadflow.catalog.base import mod, query, table, text, view
from leadflow.functions.workspace import workspace
from leadflow.streaming import feeds, limits

DAY_LIMIT, DAY_SECONDS = 3, 86_400
SLIDE_LIMIT, SLIDE_SECONDS = 2, 43_200

# requests of each user in time order, walked one by one
view("steps", "SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events")
view(
    "daily_walk",
    f"""SELECT event_id, user_id, n, us AS start, 1 AS used, true AS allowed FROM steps WHERE n = 1
        UNION ALL SELECT s.event_id, s.user_id, s.n, CASE WHEN s.us - w.start > {DAY_SECONDS}000000 THEN s.us ELSE w.start END,
          CASE WHEN s.us - w.start > {DAY_SECONDS}000000 THEN 1 WHEN w.used >= {DAY_LIMIT} THEN w.used ELSE w.used + 1 END,
          s.us - w.start > {DAY_SECONDS}000000 OR w.used < {DAY_LIMIT}
        FROM daily_walk w JOIN steps s ON s.user_id = w.user_id AND s.n = w.n + 1""",
    ("steps",),
)
view(
    "sliding_walk",
    f"""SELECT event_id, user_id, n, [us] AS kept, true AS allowed FROM steps WHERE n = 1
        UNION ALL SELECT s.event_id, s.user_id, s.n,
          CASE WHEN len(list_filter(w.kept, lambda t: s.us - t < {SLIDE_SECONDS}000000)) < {SLIDE_LIMIT}
               THEN list_append(list_filter(w.kept, lambda t: s.us - t < {SLIDE_SECONDS}000000), s.us)
               ELSE list_filter(w.kept, lambda t: s.us - t < {SLIDE_SECONDS}000000) END,
          len(list_filter(w.kept, lambda t: s.us - t < {SLIDE_SECONDS}000000)) < {SLIDE_LIMIT}
        FROM sliding_walk w JOIN steps s ON s.user_id = w.user_id AND s.n = w.n + 1""",
    ("steps",),
)


@query("daily_limits", "SELECT event_id, user_id, allowed FROM daily_walk", ("daily_walk",))
def daily_limits(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    return limits.daily_limits(e, DAY_LIMIT, ["user_id"], seconds=DAY_SECONDS).drop("ts")


@query("sliding_limits", "SELECT event_id, user_id, allowed FROM sliding_walk", ("sliding_walk",))
def sliding_limits(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    return limits.sliding_limits(e, SLIDE_LIMIT, SLIDE_SECONDS, ["user_id"]).drop("ts")


def event_stream(spark, d):
    schema = table(spark, d, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1)
    return source.parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


def drained(spark, label: str, writer: DataStreamWriter):
    """Run a stream over what is there, into a written table, and read that."""
    folder = workspace(spark, label)
    run = writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    run.format("parquet").option("path", f"{folder}/out").start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query("daily_limit_stream", "SELECT event_id, user_id, allowed FROM daily_walk", ("daily_walk",))
def daily_limit_stream(spark, d):
    out = limits.daily_limit_stream(event_stream(spark, d), "user_id", DAY_LIMIT, seconds=DAY_SECONDS)
    return drained(spark, "daily", out.writeStream.outputMode("append"))


@query("sliding_limit_stream", "SELECT event_id, user_id, allowed FROM sliding_walk", ("sliding_walk",))
def sliding_limit_stream(spark, d):
    out = limits.sliding_limit_stream(event_stream(spark, d), "user_id", SLIDE_LIMIT, seconds=SLIDE_SECONDS)
    return drained(spark, "sliding", out.writeStream.outputMode("append"))


# requests by address, kind of address and action; pages views have no limit
view(
    "asked",
    """SELECT event_id, 'u' || (user_id % 20) AS identifier, CASE WHEN user_id % 3 = 0 THEN 'ip' ELSE 'email' END AS identifier_type,
       event_type AS action, epoch_us(ts) AS us FROM events""",
)
LIMITS_SQL = "(VALUES ('email', 'purchase', 2), ('ip', 'purchase', 4), ('email', 'signup', 1))"
view(
    "asked_steps",
    f"""SELECT a.*, l.n_max, row_number() OVER (PARTITION BY identifier, a.identifier_type, a.action ORDER BY us, event_id) AS n
        FROM asked a JOIN {LIMITS_SQL} AS l(identifier_type, action, n_max) ON l.identifier_type = a.identifier_type AND l.action = a.action""",
    ("asked",),
)
view(
    "asked_walk",
    f"""SELECT event_id, identifier, identifier_type, action, n, us AS start, 1 AS used, true AS allowed FROM asked_steps WHERE n = 1
        UNION ALL SELECT s.event_id, s.identifier, s.identifier_type, s.action, s.n, CASE WHEN s.us - w.start > {DAY_SECONDS}000000 THEN s.us ELSE w.start END,
          CASE WHEN s.us - w.start > {DAY_SECONDS}000000 THEN 1 WHEN w.used >= s.n_max THEN w.used ELSE w.used + 1 END,
          s.us - w.start > {DAY_SECONDS}000000 OR w.used < s.n_max
        FROM asked_walk w JOIN asked_steps s ON s.identifier = w.identifier AND s.identifier_type = w.identifier_type AND s.action = w.action AND s.n = w.n + 1""",
    ("asked_steps",),
)


def as_requests(events):
    return events.select(
        "event_id", text("u", mod("user_id", 20)).alias("identifier"), F.when(mod("user_id", 3) == 0, "ip").otherwise("email").alias("identifier_type"),
        F.col("event_type").alias("action"), "ts",
    )


@query(
    "daily_limit_stream_by_kind",
    """SELECT event_id, identifier, identifier_type, action, allowed FROM asked_walk
       UNION ALL SELECT event_id, identifier, identifier_type, action, true FROM asked WHERE event_id NOT IN (SELECT event_id FROM asked_walk)""",
    ("asked", "asked_walk"),
)
def daily_limit_stream_by_kind(spark, d):
    kinds = [("email", "purchase", 2), ("ip", "purchase", 4), ("email", "signup", 1)]
    table_ = spark.createDataFrame(kinds, "identifier_type string, action string, `limit` int")
    out = limits.daily_limit_stream(as_requests(event_stream(spark, d)), limits=table_, seconds=DAY_SECONDS)
    return drained(spark, "daily-kinds", out.writeStream.outputMode("append"))


def as_results(events):
    t = F.col("event_type")
    return events.select(
        text("job", mod("user_id", 40)).alias("job_id"), F.when(t != "error", "d.example.com").alias("normalized_domain"),
        F.when(t.isin("purchase", "signup"), F.array(F.lit(1))).alias("contacts"),
        F.when((t == "signup") & (mod("user_id", 40) < 20), "completed").otherwise("enriching").alias("job_status"),
    )


PROGRESS = """SELECT 'job' || (user_id % 40) AS job_id, count(*) AS processed_rows, count(*) FILTER (WHERE event_type <> 'error') AS found_count,
    count(*) FILTER (WHERE event_type IN ('purchase', 'signup')) AS enriched_count, bool_or(event_type = 'signup' AND user_id % 40 < 20) AS terminal FROM events GROUP BY 1"""


@query("progress_stream", PROGRESS)
def progress_stream(spark, d):
    """Counts after each micro-batch, written per batch; the last one per job is the state."""
    folder = workspace(spark, "progress")

    def save(batch, batch_id):
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/out/part={batch_id}")

    run = feeds.progress_stream(as_results(event_stream(spark, d))).writeStream.outputMode("update").foreachBatch(save)
    run.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{folder}/out").drop("part")
    rest = [c for c in out.columns if c not in ("job_id", "batch_id")]
    last = out.groupBy("job_id").agg(F.max_by(F.struct(*rest), "batch_id").alias("s"))
    return last.select("job_id", "s.*")


# a job ends with its first signup; an hour later its counts go out, once the newest event is an hour further
@query(
    "finished_jobs",
    """SELECT job_id, count(*) AS processed_rows, count(*) FILTER (WHERE event_type <> 'error') AS found_count,
       count(*) FILTER (WHERE event_type IN ('purchase', 'signup')) AS enriched_count, true AS terminal, 'completed' AS job_status
       FROM (SELECT 'job' || (user_id % 400) AS job_id, event_type, ts, min(CASE WHEN event_type = 'signup' THEN ts END) OVER (PARTITION BY user_id % 400) AS ended FROM events)
       WHERE ts <= ended + INTERVAL 1 HOUR AND ended + INTERVAL 1 HOUR < (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY job_id""",
)
def finished_jobs(spark, d):
    t = F.col("event_type")
    fed = event_stream(spark, d).select(
        text("job", mod("user_id", 400)).alias("job_id"), "ts", F.when(t != "error", "d.example.com").alias("normalized_domain"),
        F.when(t.isin("purchase", "signup"), F.array(F.lit(1))).alias("contacts"), F.when(t == "signup", "completed").otherwise("enriching").alias("job_status"),
    )
    return drained(spark, "finished", feeds.finished_jobs(fed, idle="365 days").writeStream.outputMode("append"))


@query(
    "status_changes",
    """SELECT event_id, row_index, status, previous_status FROM (SELECT event_id, user_id AS row_index, event_type AS status,
       lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_status FROM events) WHERE previous_status <> status""",
)
def status_changes(spark, d):
    seen = table(spark, d, "events").select("event_id", "ts", F.col("user_id").alias("row_index"), F.col("event_type").alias("status"))
    return feeds.status_changes(seen).drop("ts")


@query("streaming_first_seen", "SELECT DISTINCT user_id, event_type FROM events")
def streaming_first_seen(spark, d):
    out = feeds.streaming_first_seen(event_stream(spark, d), ["user_id", "event_type"], horizon="60 days")
    return drained(spark, "first-seen", out.select("user_id", "event_type").writeStream.outputMode("append"))
