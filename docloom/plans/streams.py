"""Streams over files of the supplied tables, stopped and started again in the middle."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.plans.files import _scratch
from docloom.plans.grouping import ORACLES as BATCH
from docloom.plans.grouping import _log_lines
from docloom.sources.tables import read_table
from docloom.streaming import jobs

COLUMNS = ["event_id", "user_id", "ts", "event_type"]


def _arriving(spark, sf, run):
    """Events as a stream of files: purchases and sign-ups arrive, the stream runs and stops, all others arrive, it goes on."""
    events = read_table(spark, sf, "events").select(*COLUMNS)
    to = _scratch(spark, "arriving")
    early = F.col("event_type").isin("purchase", "signup")
    for rows in (events.where(early), events.where(~early | early.isNull())):
        rows.repartition(3).write.mode("append").parquet(to)
        run(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(to)).awaitTermination()


def stream_levels(spark, sf):
    """Levels of log lines that arrive as text files."""
    to, out, at = (_scratch(spark, n) for n in ("logs", "levels", "offsets"))
    _log_lines(spark, sf).select(F.concat_ws(" #", "line", "line_no").alias("value")).write.text(to)
    jobs.write_available(jobs.log_stream(spark, to, files_per_trigger=2), out, at).awaitTermination()
    cut = lambda c: F.regexp_replace(c, r" #\d+$", "")
    number = F.substring_index("line", "#", -1).cast("bigint")
    return spark.read.parquet(out).select(number.alias("line_no"), "level", cut("message").alias("message"))


def stream_newest(spark, sf):
    """The newest 1,000 events per type, kept over batches and a restart."""
    out, at = _scratch(spark, "newest"), _scratch(spark, "offsets")
    _arriving(spark, sf, lambda s: jobs.keep_newest(s, out, at, ["event_type"], ["ts", "event_id"], 1000))
    return jobs.folded(spark, out).select("event_id", "event_type")


def stream_firsts(spark, sf):
    """The first event of each user, though earlier events may arrive in later batches."""
    out, at = _scratch(spark, "firsts"), _scratch(spark, "offsets")
    _arriving(spark, sf, lambda s: jobs.keep_firsts(s, out, at, ["user_id"], ["ts", "event_id"]))
    return jobs.folded(spark, out).select("user_id", "event_id", "event_type")


QUERIES = {f.__name__: f for f in (stream_levels, stream_newest, stream_firsts)}

ORACLES = {
    "stream_levels": BATCH["log_levels"],
    "stream_newest": BATCH["latest_n"],
    "stream_firsts": """
        SELECT user_id, f.event_id, f.event_type FROM (
            SELECT user_id, min(struct_pack(ts := ts, event_id := event_id, event_type := event_type)) AS f FROM events GROUP BY user_id)""",
}
