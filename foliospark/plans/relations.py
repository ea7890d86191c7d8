"""Relations over the given tables that stand for pages, blocks, jobs and calls; each with the same relation as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.functions.geometry import box


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TYPES = ("heading", "paragraph", "list-item", "footnote", "page-number", "caption", "unknown")
_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]

BOX_SQL = f"""b AS (
  SELECT l_orderkey AS doc_id, 0 AS page, (row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)}) - 1)::INT AS ord,
    l_returnflag AS text, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, l_quantity AS qty,
    (l_partkey % 60)::DOUBLE AS x0, (l_suppkey * 7 % 90)::DOUBLE AS y0, (l_partkey % 60) + l_quantity * 4 AS x1, (l_suppkey * 7 % 90) + 10 + l_linenumber * 6.0::DOUBLE AS y1
  FROM lineitem)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page for each order, one box for each of its lines."""
    x0, y0 = F.col("l_partkey") % 60, F.col("l_suppkey") * 7 % 90
    ord_ = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER)) - 1
    rows = read(spark, sf_dir, "lineitem").select("*", ord_.alias("ord"))
    bbox = box(x0, y0, x0 + F.col("l_quantity") * 4, y0 + 10 + F.col("l_linenumber") * 6)
    return rows.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page"), "ord", F.col("l_returnflag").alias("text"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").alias("qty"), bbox.alias("bbox"))


LAYOUT_SQL = "layout AS (SELECT *, [" + ", ".join(f"'{t}'" for t in TYPES) + "][(part + line) % 7 + 1] AS block_type FROM b WHERE (part + line) % 5 < 3)"
LINKS_SQL = "links AS (SELECT *, 'u' || supp AS url FROM b WHERE part % 3 = 0)"


def layout(b: DataFrame) -> DataFrame:
    n = (F.col("part") + F.col("line")).cast("long")
    return b.filter(n % 5 < 3).withColumn("block_type", F.get(F.array(*map(F.lit, TYPES)), (n % 7).cast("int")))


def links(b: DataFrame) -> DataFrame:
    return b.filter("part % 3 = 0").withColumn("url", F.concat(F.lit("u"), F.col("supp").cast("string")))


TEXTS = ("12", "１２３", "12345", "• a", "1. a", "3)x", "１. b", "plain words", "", "　 ", "臺灣文", "这个", "カナ漢", "한漢", "abc", "漢", "书学们 臺", "7")
TEXTS_SQL = "texts AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(TEXTS)) + ") v(i, t))"


def literal_text(i) -> F.col:
    return F.get(F.array(*map(F.lit, TEXTS)), i.cast("int"))


COMMANDS_SQL = """commands AS (
  SELECT user_id || '-' || (dayofyear(ts) // 7) AS job_id, epoch_us(ts) AS seq,
    CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'tick' WHEN 'click' THEN 'pause' WHEN 'error' THEN 'stop'
      ELSE CASE WHEN event_id % 2 = 0 THEN 'finish_ok' ELSE 'finish_fail' END END AS command
  FROM events)"""


def commands(events: DataFrame) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    command = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "view", "tick").when(F.col("event_type") == "click", "pause").when(F.col("event_type") == "error", "stop").otherwise(F.when(F.col("event_id") % 2 == 0, "finish_ok").otherwise("finish_fail"))
    job = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.floor(F.dayofyear("ts") / 7).cast("string"))
    return events.select(job.alias("job_id"), micros.alias("seq"), command.alias("command"))


STATUSES = ("pending", "queued", "processing", "done", "failed", "stopped", "paused")
JOBS_SQL = "jobs AS (SELECT event_id::VARCHAR AS job_id, event_id AS seq, [" + ", ".join(f"'{s}'" for s in STATUSES) + "][user_id % 7 + 1] AS status FROM events)"


def jobs(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), F.get(F.array(*map(F.lit, STATUSES)), (F.col("user_id") % 7).cast("int")).alias("status"))
