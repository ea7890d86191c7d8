"""Queries of ingest, page cache, page loop, job requests and sinks, each with its SQL; importing this registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import geometry as G
from foliospark.functions import text as T
from foliospark.operators import jobs as Q
from foliospark.operators import limits as L
from foliospark.operators import overlay as O
from foliospark.operators import pages as P
from foliospark.plans.catalogue import _strip, query
from foliospark.plans.relations import BOX_SQL, JOBS_SQL, TEXTS, TEXTS_SQL, boxes, jobs, literal_text, read

_TEXT_AT = f"documents d JOIN texts ON d.doc_id % {len(TEXTS)} = i"


# Ingest


@query(f"""WITH {BOX_SQL} SELECT doc_id, page, ord, x0 + 1 AS x0, y1 AS y1 FROM b WHERE line % 3 <> 0 AND part % 7 <> 0""")
def ingest_images(spark, sf_dir):
    """Each line an image: a third have no place, others one or two; every seventh part can't be extracted."""
    b, box = boxes(spark, sf_dir), F.col("bbox")
    first = G.box(box["x0"] + 1, box["y0"], box["x1"], box["y1"])
    rects = F.when(F.col("line") % 3 == 0, F.filter(F.array(box), lambda x: F.lit(False))).when(F.col("line") % 3 == 1, F.array(first)).otherwise(F.array(first, box))
    found = b.select("doc_id", "page", "ord", rects.alias("rects"), F.when(F.col("part") % 7 == 0, "no stream").alias("error"))
    return P.embedded_images(found).select("doc_id", "page", "ord", "bbox.x0", "bbox.y1")


@query(f"""WITH {BOX_SQL} SELECT doc_id, page, ord, 'u' || supp AS uri FROM b WHERE line % 2 = 0 AND supp % 5 > 1 AND part % 9 <> 0""")
def ingest_links(spark, sf_dir):
    """Annotations of two kinds; some name no address, some have no place."""
    uri = F.when(F.col("supp") % 5 == 0, F.lit(None)).when(F.col("supp") % 5 == 1, "").otherwise(F.concat(F.lit("u"), F.col("supp").cast("string")))
    found = boxes(spark, sf_dir).select("doc_id", "page", "ord", F.when(F.col("line") % 2 == 0, "uri").otherwise("goto").alias("kind"), uri.alias("uri"), F.when(F.col("part") % 9 != 0, F.col("bbox")).alias("bbox"))
    return P.hyperlinks(found).select("doc_id", "page", "ord", "uri")


@query(f"""WITH {BOX_SQL} SELECT doc_id, ord, round(x0 * (300 / 72.0::DOUBLE), 6) AS x0, round(y1 * (300 / 72.0::DOUBLE), 6) AS y1, (part % 5000 + 1) * 72 / 300.0::DOUBLE AS page_width FROM b""")
def image_page_points(spark, sf_dir):
    """Boxes in pixels, and the width in points of the page that an image of so many pixels makes."""
    px, points = G.to_pixels(F.col("bbox")), F.col("part") % 5000 + 1
    return boxes(spark, sf_dir).select("doc_id", "ord", F.round(px["x0"], 6).alias("x0"), F.round(px["y1"], 6).alias("y1"), (points * 72 / F.lit(300.0)).alias("page_width"))


@query(rf"""WITH {TEXTS_SQL}, e AS (SELECT doc_id, {_strip("(coalesce(text, '') || t)")} AS x, doc_id % 3 AS filled, CASE WHEN doc_id % 2 = 0 THEN 40.0::DOUBLE ELSE 90.0 END AS across FROM {_TEXT_AT}),
c AS (SELECT *, CASE WHEN filled > 0 THEN filled ELSE len(string_split(x, chr(10))) END AS n FROM e WHERE x <> '')
SELECT doc_id, md5(x) AS text_md5, n AS line_count, round(across / n, 9) AS font_size, CASE WHEN regexp_matches(x, '{T.HANGUL}') THEN 'korean' WHEN regexp_matches(x, '{T.KANA}') THEN 'japan'
 WHEN regexp_matches(x, '{T.CJK}') THEN CASE WHEN regexp_matches(x, '[{T.BLOCK_TRADITIONAL}]') THEN 'ch_tra' ELSE 'ch_sim' END ELSE 'en' END AS language, 1.0::DOUBLE AS confidence FROM c""")
def recognized_blocks(spark, sf_dir):
    d = F.col("doc_id")
    lines = F.concat(F.array_repeat(F.lit("a line"), (d % 3).cast("int")), F.array(F.lit(" "), F.lit("")))
    text = F.concat(F.coalesce("text", F.lit("")), literal_text(d % len(TEXTS)))
    blocks = read(spark, sf_dir, "documents").select("doc_id", text.alias("text"), lines.alias("lines"), F.when(d % 2 == 0, "vertical").otherwise("horizontal").alias("direction"), G.box(F.lit(0.0), F.lit(0.0), F.lit(40.0), F.lit(90.0)).alias("bbox"))
    return P.recognized(blocks).select("doc_id", F.md5("text").alias("text_md5"), F.col("line_count").cast("long").alias("line_count"), F.round("font_size", 9).alias("font_size"), "language", "confidence")


# Cache: every document is a page of its source; writes of two runs, some corrupt

_CACHE_SQL = """writes AS (SELECT source AS job_id, doc_id AS page, 0 AS seq, CASE doc_id % 4 WHEN 0 THEN '{"blocks":[]}' WHEN 1 THEN '[1]' WHEN 2 THEN '{broken' ELSE NULL END AS result FROM documents
 UNION ALL SELECT source, doc_id, 1, '{"direction":"Vertical","blocks":[{"text":"t' || doc_id || '","bbox":[1,2,3,4]},7]}' FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
cache AS (SELECT job_id, page, arg_max(result, CASE WHEN result IS NOT NULL THEN seq END) AS result FROM writes GROUP BY job_id, page)"""


def _cache(spark, sf_dir):
    docs, k = read(spark, sf_dir, "documents"), F.col("doc_id") % 4
    first = F.when(k == 0, '{"blocks":[]}').when(k == 1, "[1]").when(k == 2, "{broken")
    key = [F.col("source").alias("job_id"), F.col("doc_id").alias("page")]
    old = docs.select(*key, F.lit(0).alias("seq"), first.alias("result"))
    whole = F.concat(F.lit('{"direction":"Vertical","blocks":[{"text":"t'), F.col("doc_id").cast("string"), F.lit('","bbox":[1,2,3,4]},7]}'))
    new = docs.join(read(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select(*key, F.lit(1).alias("seq"), whole.alias("result"))
    return P.newest(old.unionByName(new))


@query(f"""WITH {_CACHE_SQL} SELECT job_id, count(*) AS pages, count(*) FILTER (result LIKE '{{"%' AND result <> '{{broken') AS hits FROM cache GROUP BY job_id""")
def cache_replay(spark, sf_dir):
    """A later write replaces an earlier one; null, corrupt and other entries are misses."""
    docs = read(spark, sf_dir, "documents").select(F.col("source").alias("job_id"), F.col("doc_id").alias("page"))
    return P.replayed(docs, _cache(spark, sf_dir)).groupBy("job_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if("hit").alias("hits"))


@query(f"""WITH {_CACHE_SQL} SELECT job_id, page, CASE WHEN result LIKE '%Vertical%' THEN '{{"direction":"Vertical","blocks":[{{"text":"t' || page || '","type":"","bbox":[1.0,2.0,3.0,4.0],"lines":[]}}]}}'
 ELSE '{{"direction":"horizontal","blocks":[]}}' END AS json FROM cache""")
def cache_export(spark, sf_dir):
    return P.exported(_cache(spark, sf_dir))


@query(f"""WITH {_CACHE_SQL}, done AS (SELECT source AS job_id FROM documents GROUP BY 1 HAVING bool_and(doc_id % 50 < 49) OR max(doc_id) % 2 = 0) SELECT job_id, count(*) AS deleted FROM cache WHERE job_id IN (SELECT job_id FROM done) GROUP BY job_id""")
def cache_clear(spark, sf_dir):
    """How many entries go with each job that ended in full success."""
    ends = read(spark, sf_dir, "documents").groupBy(F.col("source").alias("job_id")).agg((~(F.bool_and(F.col("doc_id") % 50 < 49) | (F.max("doc_id") % 2 == 0))).alias("keep_cache"))
    return P.to_clear(_cache(spark, sf_dir), ends).groupBy("job_id").agg(F.count(F.lit(1)).alias("deleted"))


# Loop


@query(f"""WITH {BOX_SQL}, f AS (SELECT doc_id AS job_id, min(greatest(line - 2, 0)) FILTER (part % 13 = 0) AS s, min(greatest(line - 2, 0)) FILTER (supp % 11 = 0) AS p FROM b GROUP BY 1),
e AS (SELECT *, least(coalesce(s, 1000000), coalesce(p, 1000000)) AS stop_page FROM f),
r AS (SELECT doc_id AS job_id, count(*) FILTER (ord < stop_page) AS tried, count(*) FILTER (ord < stop_page AND part % 3 <> 0) AS ok_pages, count(*) AS pages_total, any_value(s) AS s, any_value(p) AS p FROM b JOIN e ON doc_id = job_id GROUP BY 1)
SELECT job_id, tried, ok_pages, pages_total, CASE WHEN tried < pages_total THEN CASE WHEN s IS NOT NULL AND s <= coalesce(p, s) THEN 'stopped' ELSE 'paused' END WHEN ok_pages = 0 THEN 'failed' ELSE 'done' END AS status, ok_pages < pages_total AS keep_cache FROM r""")
def page_loop(spark, sf_dir):
    """An order is a job, its lines the pages; requests to stop and to pause come at some of them."""
    b = boxes(spark, sf_dir).withColumnRenamed("doc_id", "job_id")
    at = (F.col("line") - 2).cast("int").alias("at_page")
    flags = b.filter("part % 13 = 0").select("job_id", F.lit("stop").alias("flag"), at).unionByName(b.filter("supp % 11 = 0").select("job_id", F.lit("pause").alias("flag"), at))
    return P.run_pages(b.select("job_id", F.col("ord").alias("page"), (F.col("part") % 3 != 0).alias("ok")), flags)


# Job requests


@query("""WITH p AS (SELECT user_id AS job_id, event_id AS seq, CASE WHEN event_type <> 'view' THEN event_type END AS status, CASE WHEN event_id % 3 = 0 THEN value END AS progress, CASE WHEN event_id % 1000 = 999 THEN 'note' END AS note FROM events)
SELECT job_id, arg_max(status, CASE WHEN status IS NOT NULL THEN seq END) AS status, arg_max(progress, CASE WHEN progress IS NOT NULL THEN seq END) AS progress, max(note) AS note FROM p GROUP BY job_id""")
def job_merge(spark, sf_dir):
    n = F.col("event_id")
    patches = read(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), n.alias("seq"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("status"), F.when(n % 3 == 0, F.col("value")).alias("progress"), F.when(n % 1000 == 999, "note").alias("note"))
    return Q.merged(patches, ["status", "progress", "note"])


@query(f"WITH {JOBS_SQL}, asked AS (SELECT job_id FROM jobs UNION ALL SELECT 'x' || job_id FROM jobs) SELECT a.job_id, status, CASE WHEN status IS NULL THEN 404 ELSE 200 END AS code FROM asked a LEFT JOIN jobs j ON a.job_id = j.job_id")
def job_lookup(spark, sf_dir):
    j = jobs(read(spark, sf_dir, "events"))
    asked = j.select("job_id")
    return Q.lookup(asked.unionByName(asked.select(F.concat(F.lit("x"), "job_id").alias("job_id"))), j)


@query(f"WITH {JOBS_SQL} SELECT seq AS position, job_id, status FROM jobs WHERE seq % 4 IN (0, 1)")
def job_history_records(spark, sf_dir):
    """Of four ids of the history one has no record, one a corrupt one."""
    j = jobs(read(spark, sf_dir, "events"))
    body = F.when(F.col("seq") % 4 == 2, "{corrupt").otherwise(F.concat(F.lit('{"status":"'), "status", F.lit('"}')))
    return Q.history_records(j.select(F.col("seq").alias("position"), "job_id"), j.filter("seq % 4 <> 3").select("job_id", body.alias("body")))


@query(f"WITH {JOBS_SQL} SELECT job_id, seq FROM jobs WHERE status = 'done'")
def library_done(spark, sf_dir):
    return jobs(read(spark, sf_dir, "events")).filter("status = 'done'").select("job_id", "seq")


_ASKED_SQL = "asked AS (SELECT CASE WHEN user_id % 5 = 0 THEN 'x' || event_id ELSE event_id::VARCHAR END AS job_id FROM events WHERE user_id % 3 = 0)"


def _asked(spark, sf_dir):
    name = F.col("event_id").cast("string")
    return read(spark, sf_dir, "events").filter("user_id % 3 = 0").select(F.when(F.col("user_id") % 5 == 0, F.concat(F.lit("x"), name)).otherwise(name).alias("job_id"))


@query(f"""WITH {JOBS_SQL}, {_ASKED_SQL}, c AS (SELECT CASE WHEN status IS NULL THEN 404 WHEN status = 'processing' THEN 400 ELSE 200 END AS code, coalesce(status = 'queued', false) AS queued FROM asked a LEFT JOIN jobs j ON a.job_id = j.job_id)
SELECT count(*) AS selected, count(*) FILTER (code = 200) AS deleted, count(*) FILTER (code <> 200) AS refused, count(*) FILTER (code = 404) AS missing, count(*) FILTER (queued) AS dequeued FROM c""")
def delete_counts(spark, sf_dir):
    d, code = Q.deletions(_asked(spark, sf_dir), jobs(read(spark, sf_dir, "events"))), F.col("code")
    return d.agg(F.count(F.lit(1)).alias("selected"), F.count_if(code == 200).alias("deleted"), F.count_if(code != 200).alias("refused"), F.count_if(code == 404).alias("missing"), F.count_if("dequeued").alias("dequeued"))


@query(f"""WITH {JOBS_SQL}, {_ASKED_SQL}, gone AS (SELECT job_id FROM jobs WHERE status <> 'processing' AND job_id IN (SELECT job_id FROM asked)),
t AS (SELECT 'cache' AS kind, doc_id::VARCHAR AS job_id FROM documents UNION ALL SELECT 'files', o_orderkey::VARCHAR FROM orders UNION ALL SELECT 'records', job_id FROM jobs UNION ALL SELECT 'queue', job_id FROM jobs WHERE status = 'queued')
SELECT kind, count(*) AS n_left FROM t WHERE job_id NOT IN (SELECT job_id FROM gone) GROUP BY kind""")
def delete_cascade(spark, sf_dir):
    """What is left of the tables that know a job once the accepted deletions went through all of them."""
    j = jobs(read(spark, sf_dir, "events"))
    tables = {
        "cache": read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("job_id")),
        "files": read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("job_id")),
        "records": j.select("job_id"),
        "queue": j.filter("status = 'queued'").select("job_id"),
    }
    left = Q.cascade(tables, Q.deletions(_asked(spark, sf_dir), j))
    counted = [t.groupBy(F.lit(name).alias("kind")).agg(F.count(F.lit(1)).alias("n_left")) for name, t in left.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2]).unionByName(counted[3])


@query("SELECT event_id, user_id FROM events s WHERE event_type = 'signup' AND NOT EXISTS (SELECT 1 FROM events l WHERE l.event_type = 'error' AND l.value > 100 AND l.user_id = s.user_id)")
def sessions_after_logout(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("token", F.col("user_id").cast("string"))
    return Q.logged_out(e.filter("event_type = 'signup'"), e.filter("event_type = 'error' and value > 100")).select("event_id", "user_id")


@query("SELECT user_id, CASE WHEN bool_and(event_type <> 'error') THEN 'ok' ELSE 'degraded' END AS status FROM events GROUP BY user_id")
def health(spark, sf_dir):
    checks = read(spark, sf_dir, "events").select("user_id", (F.col("event_type") != "error").alias("ok"))
    return checks.groupBy("user_id").agg(Q.health_status(F.col("ok")).alias("status"))


@query(f"WITH {JOBS_SQL} SELECT j.job_id, CASE WHEN j.status IN ('done', 'failed', 'stopped') THEN greatest(1, ceil(e.value / 5))::BIGINT END AS polls FROM jobs j JOIN events e ON e.event_id = j.seq")
def status_polls(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    j = jobs(e).join(e.select(F.col("event_id").alias("seq"), "value"), "seq")
    return j.select("job_id", Q.polls(F.col("value"), F.col("status")).alias("polls"))


@query(f"""WITH g AS (SELECT c_custkey, c_name, CASE c_custkey % 4 WHEN 0 THEN ' ' || upper(c_name) || chr(9) WHEN 1 THEN lower(c_name) WHEN 2 THEN c_name || '0' ELSE NULL END AS given FROM customer)
SELECT c_custkey, coalesce(lower({_strip('given')}) = lower({_strip('c_name')}), false) AS allowed, CASE WHEN lower({_strip('given')}) = lower({_strip('c_name')}) THEN 200 ELSE 403 END AS code FROM g""")
def email_allowlist(spark, sf_dir):
    """Each customer's name is allowed; given are such names in other cases and with blanks around them, others, and none."""
    k = F.col("c_custkey") % 4
    given = F.when(k == 0, F.concat(F.lit(" "), F.upper("c_name"), F.lit("\t"))).when(k == 1, F.lower("c_name")).when(k == 2, F.concat("c_name", F.lit("0")))
    ok = F.coalesce(T.email_allowed(given, F.col("c_name")), F.lit(False))
    return read(spark, sf_dir, "customer").select("c_custkey", ok.alias("allowed"), F.when(ok, 200).otherwise(403).alias("code"))


@query("""SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS html_md5, 'f' || page_id AS stem, md5(left(html, 100)) AS title_md5, md5(left(html, 200)) AS line_md5, md5(left(html, 500)) AS message_md5 FROM pages""")
def display_text(spark, sf_dir):
    name = F.concat(F.lit("f"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, ".PDF").otherwise(""))
    short = [F.md5(T.shortened(F.col("html"), n)).alias(f"{k}_md5") for k, n in (("title", T.TITLE_CHARS), ("line", T.LINE_CHARS), ("message", T.MESSAGE_CHARS))]
    return read(spark, sf_dir, "pages").select("page_id", F.md5(T.escape_html(F.col("html"))).alias("html_md5"), T.display_stem(name).alias("stem"), *short)


# Limits


@query("""WITH w AS (SELECT event_id, count(*) OVER k AS n, epoch_us(ts) - epoch_us(min(ts) OVER k) AS age FROM events WINDOW k AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW))
SELECT event_id, CASE WHEN n >= 1 THEN round(greatest(0.0, 60 - age / 1000000.0::DOUBLE + 0.1), 6) ELSE 0.0 END AS wait FROM w""")
def rate_limit_waits(spark, sf_dir):
    """How long the call after each one waits if one call a minute is allowed."""
    e = L.sliding_counts(read(spark, sf_dir, "events"), "user_id", "ts", oldest=True)
    return e.select("event_id", F.round(L.wait_seconds(F.col("oldest_age"), F.col("in_window"), 1), 6).alias("wait"))


_HINTED = "CASE WHEN event_type = 'error' THEN value WHEN event_type = 'signup' THEN value / 1000 END"


@query(f"""WITH e AS (SELECT event_id, event_type <> 'view' AS api, event_id % 40 + 1 AS n, {_HINTED} AS hint FROM events)
SELECT event_id, round(CASE WHEN NOT api THEN least(120.0, 4.0 * n) WHEN hint IS NOT NULL THEN least(120.0, greatest(0.5, hint)) END, 6)::DOUBLE AS fixed,
 CASE WHEN api AND hint IS NULL THEN greatest(4.0, least(120.0, 4.0 * pow(2.0, n - 1))) END::DOUBLE AS at_most, CASE WHEN api AND hint IS NULL THEN 4.0::DOUBLE END AS at_least FROM e""")
def backoff_waits(spark, sf_dir):
    """What each call waits after a failure: a multiple of the base for errors that aren't the service's, the service's hint within its bounds,
    or a number that is drawn, of which the bounds are given (what was drawn outside them would change them)."""
    api, n = F.col("event_type") != "view", F.col("event_id") % 40 + 1
    hint = F.when(F.col("event_type") == "error", F.col("value")).when(F.col("event_type") == "signup", F.col("value") / 1000)
    rows = read(spark, sf_dir, "events").select("event_id", (api & hint.isNull()).alias("drawn"), L.backoff(n, hint, api).alias("wait"), L.backoff_ceiling(n).alias("ceiling"))
    most, least = F.greatest("wait", "ceiling"), F.least("wait", F.lit(4.0))
    return rows.select("event_id", F.when(~F.col("drawn"), F.round("wait", 6)).alias("fixed"), F.when(F.col("drawn"), most).alias("at_most"), F.when(F.col("drawn"), least).alias("at_least"))


# Sinks


@query(f"""WITH {BOX_SQL}, s AS (SELECT DISTINCT doc_id // 4 AS d, (doc_id % 4)::INT AS page FROM b), o AS (SELECT *, (d + page) % 3 <> 0 AS scan FROM s WHERE (d + page) % 5 <> 0),
r AS (SELECT d, page, 0 AS nth, 'scan' AS kind FROM o WHERE scan UNION ALL SELECT d, page, 1, 'text' FROM o UNION ALL SELECT DISTINCT d, -1, 0, 'title' FROM s)
SELECT d AS doc_id, (row_number() OVER (PARTITION BY d ORDER BY page, nth) - 1)::INT AS position, kind, page FROM r""")
def clean_sheets(spark, sf_dir):
    """Four orders are a document; the source lacks every fifth page, and a third of the others can't be rasterized."""
    pages = boxes(spark, sf_dir).select(F.floor(F.col("doc_id") / 4).alias("doc_id"), (F.col("doc_id") % 4).cast("int").alias("page")).distinct()
    n = F.col("doc_id") + F.col("page")
    return P.sheets(pages, pages.filter(n % 5 != 0).withColumn("scan", n % 3 != 0))


def _most(size: str, width: str) -> str:
    """The characters that fit into a width, by the running comparison that wrapping makes."""
    estimate = f"greatest(1, floor({width} / ({size} * 0.6::DOUBLE)))"
    fits = lambda n: f"({n}) * {size} * 0.6::DOUBLE <= {width}"
    return f"(CASE WHEN {fits(estimate + ' + 1')} THEN {estimate} + 1 WHEN {fits(estimate)} THEN {estimate} ELSE greatest(1, {estimate} - 1) END)::INT"


@query(f"""WITH {BOX_SQL}, t AS (SELECT doc_id, ord, repeat(text, (5 + line * 3)::INT) AS x, CASE part % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS gap, x0, y0, greatest(x1 - x0, 1.0)::DOUBLE AS w, y1 - y0 AS h FROM b),
n AS (SELECT *, greatest(3.0, least(h / ((ceil(length(x) / {_most('12.0::DOUBLE', 'w')}) + gap + CASE WHEN gap > 0 THEN 1 ELSE 0 END) * 1.2::DOUBLE), 48.0))::DOUBLE AS size FROM t),
c AS (SELECT *, {_most('size', 'w')} AS most FROM n), l AS (SELECT doc_id, ord, x, gap, x0, y0, size, most, ceil(length(x) / most)::INT AS k, unnest(range(ceil(length(x) / most)::INT + CASE WHEN gap > 0 THEN gap + 1 ELSE 0 END))::INT AS i FROM c),
p AS (SELECT doc_id, ord, i, CASE WHEN i < k THEN x[i * most + 1 : (i + 1) * most] WHEN i = k + gap THEN 'e' ELSE '' END AS line, x0 AS x, y0 + size * (1.0 + 1.2::DOUBLE * i) AS y FROM l)
SELECT doc_id, ord, i, line, x, round(y, 6) AS y FROM p WHERE y <= 120 AND line <> ''""")
def block_overlay_lines(spark, sf_dir):
    """Where each line of a block's overlay stands on a page of 120 points; texts of one line, and such with one or two blank lines before a last one."""
    gap = F.when(F.col("part") % 3 == 1, "\n \ne").when(F.col("part") % 3 == 2, "\n\n\t\ne").otherwise("")
    placed = O.block_lines(F.col("bbox"), F.concat(F.repeat("text", (5 + F.col("line") * 3).cast("int")), gap), 120.0, uniform=True)
    return boxes(spark, sf_dir).select("doc_id", "ord", F.explode(placed).alias("p")).select("doc_id", "ord", "p.i", "p.line", "p.x", F.round("p.y", 6).alias("y"))
