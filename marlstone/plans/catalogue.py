"""Every query of the engine's own operators by name, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import markdown as M
from marlstone.functions import text as T
from marlstone.operators import jobs as J
from marlstone.operators import quality as Q
from marlstone.operators import reports as R
from marlstone.operators import transcript as S
from marlstone.plans import classical, pages_sql
from marlstone.runtime import spread, table

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict:
    from marlstone.plans import nested

    return {**_QUERIES, **classical.queries(), **pages_sql.queries(), **nested.queries()}


def oracle_sql() -> dict[str, str]:
    from marlstone.plans import nested

    return {**_SQL, **classical.oracle_sql(), **pages_sql.oracle_sql(), **nested.oracle_sql()}


# ---- documents -----------------------------------------------------------------------------------------------------

_PLAIN = r"regexp_replace(regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(65279), ''), '[ \t]+(\n|$)', '\1', 'g'), '\n{4,}', E'\n\n\n', 'g'), '^\s+|\s+$', '', 'g')"
_VISIBLE = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(BODY, '(?s)```.*?```', ' ', 'g'), '!\[[^\]]*\]\([^)]+\)', ' ', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '[$#>*_`|\\-]+', ' ', 'g'), '\s+', ' ', 'g'))"
_TITLE = r"list_filter(list_transform(string_split(body, chr(10)), lambda x: regexp_replace(x, '^[#\s]+|[#\s]+$', '', 'g')), lambda x: x <> '')[1]"


def _visible(body: str) -> str:
    return _VISIBLE.replace("BODY", body)


_COUNTS = rf"""
plain AS (SELECT doc_id, lang, source, {_PLAIN} AS body FROM documents),
titled AS (SELECT *, CASE WHEN length({_TITLE}) <= 90 THEN {_TITLE} ELSE 'document' END AS title FROM plain),
counted AS (SELECT *, length({_visible('body')})::BIGINT AS text_length,
  len(list_filter(regexp_split_to_array(body, '\n\s*\n'), lambda x: {_visible('x')} <> ''))::BIGINT AS paragraph_count,
  len(regexp_extract_all(body, '(?m)^#{{1,6}}\s+\S'))::BIGINT AS heading_count,
  len(regexp_extract_all(body, '(?m)^\|.+\|\n\|(?:\s*:?-{{3,}}:?\s*\|)+'))::BIGINT AS table_count,
  len(regexp_extract_all(body, '!\[[^\]]*\]\([^)]+\)'))::BIGINT AS image_count,
  len(regexp_extract_all(body, '(?s)\$\$\n.+?\n\$\$'))::BIGINT AS formula_count,
  (len(regexp_extract_all(body, '```')) // 2)::BIGINT AS code_block_count,
  lower(regexp_replace(title, '[^\p{{L}}\p{{N}}]+', '', 'g')) AS key FROM titled),
warned AS (SELECT *, length(key) >= 6 AND key NOT IN ('untitled', 'document', 'source', 'upload') AS informative,
  CASE WHEN text_length < 80 AND image_count = 0 AND table_count = 0 THEN 1 ELSE 0 END AS w_none,
  CASE WHEN NOT (text_length < 80 AND image_count = 0 AND table_count = 0) AND text_length < 300 THEN 1 ELSE 0 END AS w_low,
  CASE WHEN text_length >= 1000 AND heading_count = 0 AND table_count = 0 THEN 1 ELSE 0 END AS w_struct,
  CASE WHEN paragraph_count > 200 AND heading_count = 0 THEN 1 ELSE 0 END AS w_long FROM counted),
scored AS (SELECT *, w_none + w_low + w_struct + w_long AS nw,
  least(text_length / 160, 30.0::DOUBLE) + least(paragraph_count * 1.2::DOUBLE, 18.0::DOUBLE) + least(heading_count * 2.2::DOUBLE, 14.0::DOUBLE)
  + least(table_count * 4.0::DOUBLE, 12.0::DOUBLE) + least(image_count * 2.0::DOUBLE, 10.0::DOUBLE) + least(formula_count * 1.8::DOUBLE, 8.0::DOUBLE)
  + least(code_block_count * 2.5::DOUBLE, 8.0::DOUBLE) + CASE WHEN informative THEN 6.0::DOUBLE ELSE 0.0::DOUBLE END AS raw FROM warned),
final AS (SELECT *, greatest(0.0::DOUBLE, least(100.0::DOUBLE, round(round(raw - CASE WHEN nw > 0 THEN least(35, 10 + nw * 8) ELSE 0 END, 6), 1))) AS quality_score FROM scored),
rated AS (SELECT *, CASE WHEN quality_score < 25 THEN CASE WHEN w_none = 1 THEN 'failed' ELSE 'weak' END
  WHEN quality_score >= 80 AND nw = 0 THEN 'strong' WHEN quality_score >= 55 THEN 'usable' ELSE 'weak' END AS quality_status FROM final)"""


def scored_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents")).withColumn("body", T.plain_text(F.col("text")))
    return Q.score_conversions(docs.withColumn("title", T.inferred_title(F.col("body"), F.lit("document"))))


@query(rf"WITH {_COUNTS} SELECT doc_id, text_length, paragraph_count, heading_count, table_count, image_count, formula_count, code_block_count, quality_score, quality_status FROM rated")
def doc_quality_score(spark: SparkSession, sf: str) -> DataFrame:
    s = scored_documents(spark, sf)
    return s.select(
        "doc_id", "text_length", "paragraph_count", "heading_count", F.col("table_count_final").alias("table_count"), F.col("image_count_final").alias("image_count"),
        F.col("formula_count_final").alias("formula_count"), "code_block_count", "quality_score", "quality_status",
    )


@query(rf"WITH {_COUNTS} SELECT lang, quality_status, count(*) AS n, round(avg(quality_score), 4) AS mean_score, sum(text_length)::BIGINT AS chars FROM rated GROUP BY ALL")
def doc_quality_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    return scored_documents(spark, sf).groupBy("lang", "quality_status").agg(F.count("*").alias("n"), F.round(F.avg("quality_score"), 4).alias("mean_score"), F.sum("text_length").alias("chars"))


@query(rf"""WITH {_COUNTS} SELECT doc_id, array_to_string(list_filter([
  CASE WHEN w_none = 1 THEN 'no_extractable_content' WHEN w_low = 1 THEN 'low_text_volume' END,
  CASE WHEN w_struct = 1 THEN 'low_structure_detected' END, CASE WHEN w_long = 1 THEN 'long_text_without_headings' END], lambda x: x IS NOT NULL), ',') AS warnings,
  array_to_string(list_filter([CASE WHEN text_length >= 1200 THEN 'sufficient_text_volume' END, CASE WHEN paragraph_count >= 8 THEN 'paragraph_structure_detected' END,
  CASE WHEN heading_count >= 3 THEN 'heading_hierarchy_detected' END, CASE WHEN table_count > 0 THEN 'tables_detected' END, CASE WHEN image_count > 0 THEN 'images_detected' END,
  CASE WHEN formula_count > 0 THEN 'formula_blocks_detected' END, CASE WHEN code_block_count > 0 THEN 'code_blocks_detected' END,
  CASE WHEN informative THEN 'informative_title_detected' END], lambda x: x IS NOT NULL), ',') AS reasons FROM rated""")
def doc_quality_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return scored_documents(spark, sf).select("doc_id", F.array_join("quality_warnings", ",").alias("warnings"), F.array_join("quality_reasons", ",").alias("reasons"))


@query(rf"WITH {_COUNTS} SELECT quality, quality_status, count(*) AS n, round(avg(quality_score), 4) AS mean_score FROM rated JOIN labels USING (doc_id) GROUP BY ALL")
def doc_quality_vs_label(spark: SparkSession, sf: str) -> DataFrame:
    return scored_documents(spark, sf).join(table(spark, sf, "labels"), "doc_id").groupBy("quality", "quality_status").agg(F.count("*").alias("n"), F.round(F.avg("quality_score"), 4).alias("mean_score"))


@query(rf"SELECT doc_id, md5({_PLAIN}) AS plain_md5, md5(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS flat_md5 FROM documents")
def doc_normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents")).select("doc_id", F.md5(T.plain_text(F.col("text"))).alias("plain_md5"), F.md5(T.normalized(F.col("text"))).alias("flat_md5"))


@query(rf"WITH plain AS (SELECT doc_id, {_PLAIN} AS body FROM documents) SELECT doc_id, CASE WHEN length({_TITLE}) <= 90 THEN {_TITLE} ELSE 'doc-' || doc_id END AS title FROM plain")
def doc_infer_title(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents")).select("doc_id", T.inferred_title(T.plain_text(F.col("text")), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).alias("title"))


@query(r"""WITH w AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, '#')), ' ') AS j FROM documents)
SELECT doc_id, CASE WHEN j = '' THEN 'No summary.' WHEN length(j) > 480 THEN j[1:480] || '...' ELSE j END AS summary FROM w""")
def doc_summary_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents")).select("doc_id", T.summary(F.col("text")).alias("summary"))


_PRINT = r"lower(regexp_replace(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))[1:500], '[^\p{L}\p{N}_]+', '', 'g'))"


@query(rf"WITH f AS (SELECT doc_id, md5({_PRINT}) AS print FROM documents) SELECT print, min(doc_id) AS first_doc, count(*) AS n FROM f GROUP BY print")
def doc_fingerprint_dedup(spark: SparkSession, sf: str) -> DataFrame:
    prints = spread(table(spark, sf, "documents")).select("doc_id", F.md5(T.fingerprint(F.col("text"))).alias("print"))
    return prints.groupBy("print").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))


@query(r"""WITH p AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(lower(t), '[\p{L}\p{N}_]+') AS u FROM p),
g AS (SELECT doc_id, t, u, list_transform(range(1, greatest(len(u) - 3, 1)), lambda i: array_to_string(u[i:i + 4], chr(1))) AS g FROM w)
SELECT doc_id, round(CASE WHEN length(t) < 60 OR len(u) < 8 OR len(u) - 4 < 5 THEN 1.0::DOUBLE ELSE len(list_distinct(g))::DOUBLE / len(g) END, 6) AS ratio FROM g""")
def doc_unique_ngram(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents")).select("doc_id", F.round(T.unique_ngram_ratio(F.col("text")), 6).alias("ratio"))


@query(r"""WITH l AS (SELECT doc_id, trim(regexp_replace(unnest(string_split(coalesce(text, ''), chr(10))), '\s+', ' ', 'g')) AS line FROM documents),
c AS (SELECT doc_id, line, count(*) AS n FROM l WHERE length(line) >= 20 GROUP BY ALL),
r AS (SELECT doc_id, sum(n) AS total, coalesce(sum(n) FILTER (n > 1), 0) AS again FROM c GROUP BY doc_id)
SELECT d.doc_id, round(CASE WHEN coalesce(total, 0) < 4 THEN 0.0::DOUBLE ELSE (again::DOUBLE) / (total::DOUBLE) END, 6) AS ratio FROM documents d LEFT JOIN r USING (doc_id)""")
def doc_repeated_lines(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents")).select("doc_id", F.round(T.repeated_line_ratio(F.col("text")), 6).alias("ratio"))


@query()
def doc_clean_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return Q.convert_text(spread(table(spark, sf, "documents"))).select("doc_id", "title", F.md5("body").alias("body_md5"), F.length("body").alias("n"))


@query(r"""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '(?m)^#{1,6} '))::BIGINT AS marks, len(regexp_extract_all(coalesce(text, ''), '(?m)^[-*]\s+'))::BIGINT AS items,
  len(regexp_extract_all(coalesce(text, ''), '(?m)^\|.+\|\n\|(?:\s*:?-{1,}:?\s*\|)+'))::BIGINT AS tables, len(regexp_extract_all(coalesce(text, ''), '\[([^\]]+)\]\([^)]+\)'))::BIGINT AS links FROM documents""")
def doc_markdown_counts(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("text")
    return spread(table(spark, sf, "documents")).select("doc_id", T.heading_marks(c).alias("marks"), T.list_items(c).alias("items"), T.tables(c, 1).alias("tables"), T.links(c).alias("links"))


# ---- tables --------------------------------------------------------------------------------------------------------


@query(r"""WITH l AS (SELECT r_regionkey, '| ' || n_nationkey || ' | ' || replace(replace(n_name, '\', '\\'), '|', '\|') || ' |' AS line, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT r_regionkey, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg(line, chr(10) ORDER BY n_nationkey) AS md FROM l GROUP BY r_regionkey""")
def table_markdown_nation(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    cells = F.transform(rows, lambda r: F.array(r["n_nationkey"].cast("string"), r["n_name"]))
    return n.groupBy("r_regionkey").agg(T.markdown_table(F.concat(F.array(F.array(F.lit("key"), F.lit("name"))), cells)).alias("md"))


@query(r"SELECT o_orderkey, replace(replace(trim(regexp_replace(o_orderpriority || ' | \ ' || chr(10) || o_orderstatus, '\s+', ' ', 'g')), '\', '\\'), '|', '\|') AS cell FROM orders")
def csv_escape(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat("o_orderpriority", F.lit(" | \\ \n"), "o_orderstatus")
    return table(spark, sf, "orders").select("o_orderkey", T.table_cell(raw).alias("cell"))


@query(r"SELECT l_orderkey, l_linenumber, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN format('{:.1f} KB', round(b / 1024, 1)) ELSE format('{:.1f} MB', round(b / 1048576, 1)) END AS size FROM (SELECT *, (l_quantity * l_quantity * l_quantity * 32)::BIGINT AS b FROM lineitem)")
def byte_sizes(spark: SparkSession, sf: str) -> DataFrame:
    b = (F.col("l_quantity") * F.col("l_quantity") * F.col("l_quantity") * 32).cast("long")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", T.byte_size(b).alias("size"))


# ---- transcripts ---------------------------------------------------------------------------------------------------

_TURNS = r"""RECURSIVE seg AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i, trim(text) AS text FROM conversations WHERE trim(coalesce(text, '')) <> ''),
pos AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS p FROM conversations),
timed AS (SELECT s.conv_id, s.i, s.text, (q.p * 5)::DOUBLE AS a, ((q.p + 1) * 5)::DOUBLE AS b FROM seg s JOIN
  (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY p) AS i FROM pos WHERE trim(coalesce(text, '')) <> '') q ON s.conv_id = q.conv_id AND s.i = q.i),
fold AS (SELECT conv_id, i, 1 AS k, a, b, text FROM timed WHERE i = 1
  UNION ALL SELECT t.conv_id, t.i, CASE WHEN length(f.text) < 700 THEN f.k ELSE f.k + 1 END, CASE WHEN length(f.text) < 700 THEN f.a ELSE t.a END, t.b,
  CASE WHEN length(f.text) < 700 THEN trim(regexp_replace(f.text || ' ' || t.text, '\s+', ' ', 'g')) ELSE t.text END FROM fold f JOIN timed t ON t.conv_id = f.conv_id AND t.i = f.i + 1),
done AS (SELECT *, row_number() OVER (PARTITION BY conv_id, k ORDER BY i DESC) AS r FROM fold)"""
_CLOCK = "lpad((X::BIGINT // 60)::VARCHAR, 2, '0') || ':' || lpad((X::BIGINT % 60)::VARCHAR, 2, '0')"


@query(rf"WITH {_TURNS} SELECT conv_id, k::INTEGER AS k, {_CLOCK.replace('X', 'a')} AS since, {_CLOCK.replace('X', 'b')} AS until, md5(text) AS text_md5 FROM done WHERE r = 1")
def transcript_timeline(spark: SparkSession, sf: str) -> DataFrame:
    lines = S.timeline(S.conversations_as_recordings(table(spark, sf, "conversations")))
    return lines.select("conv_id", F.posexplode("timeline").alias("p", "e")).select("conv_id", (F.col("p") + 1).alias("k"), F.col("e.start").alias("since"), F.col("e.end").alias("until"), F.md5("e.text").alias("text_md5"))


@query(r"SELECT conv_id, turn, role, CASE WHEN length(f) BETWEEN 4 AND 28 THEN f ELSE 'segment ' || turn END AS title FROM (SELECT *, trim(split_part(split_part(trim(text), '。', 1), '.', 1)) AS f FROM conversations)")
def transcript_titles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", T.segment_title(F.col("turn"), F.col("text")).alias("title"))


@query(r"""WITH s AS (SELECT event_id, (abs(value) * 37)::BIGINT AS s FROM (SELECT event_id, floor(value) AS value FROM events))
SELECT event_id, CASE WHEN s >= 3600 THEN CASE WHEN s // 3600 < 10 THEN '0' ELSE '' END || (s // 3600)::VARCHAR || ':' ELSE '' END || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS at FROM s""")
def turn_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", T.timestamp(F.abs(F.floor("value")) * 37).alias("at"))


# ---- jobs ----------------------------------------------------------------------------------------------------------


def jobs_of(spark: SparkSession, sf: str) -> DataFrame:
    """Orders in the role of jobs."""
    o = table(spark, sf, "orders")
    made = F.col("o_orderdate").cast("timestamp")
    kinds = F.array(*[F.lit(x) for x in J.SOURCE_TYPES])
    return o.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey")).alias("owner_user_id"),
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("guest"), (F.col("o_custkey") % 50).cast("string"))).alias("requester_hash"),
        F.element_at(kinds, (F.col("o_orderkey") % 9 + 1).cast("int")).alias("source_type"),
        F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "processing").when(F.col("o_orderkey") % 5 == 0, "failed").otherwise("succeeded").alias("status"),
        F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("https://x.example/"), F.col("o_orderkey").cast("string"))).alias("source_url"),
        F.lit(None).cast("string").alias("input_filename"), made.alias("created_at"), (made + F.expr("make_interval(0,0,0,0,0,o_orderkey % 120)")).alias("updated_at"),
        J.expiry(made, F.col("o_orderkey") % 4 != 0).alias("expires_at"), F.when(F.col("o_orderkey") % 10 == 0, made).alias("deleted_at"),
    )


_JOBS = """jobs AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS owner_user_id, CASE WHEN o_orderkey % 4 = 0 THEN 'guest' || (o_custkey % 50) END AS requester_hash,
  ['webpage','text','html','csv','pdf','docx','audio','video','video_url'][o_orderkey % 9 + 1] AS source_type,
  CASE WHEN o_orderstatus = 'O' THEN 'pending' WHEN o_orderstatus = 'P' THEN 'processing' WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'succeeded' END AS status,
  o_orderpriority AS title, CASE WHEN o_orderkey % 3 = 0 THEN 'https://x.example/' || o_orderkey END AS source_url, o_orderdate AS created_at, o_orderdate + to_minutes(o_orderkey % 120) AS updated_at,
  CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate + INTERVAL 7 DAYS ELSE o_orderdate + INTERVAL 24 HOURS END AS expires_at, CASE WHEN o_orderkey % 10 = 0 THEN o_orderdate END AS deleted_at FROM orders)"""
_JOBS = _JOBS.replace("to_minutes(o_orderkey % 120)", "to_minutes((o_orderkey % 120)::BIGINT)").replace("make_interval", "")


@query(f"WITH {_JOBS} SELECT id, title, status, strftime(created_at, '%Y-%m-%d') AS day FROM jobs WHERE owner_user_id = 7 AND deleted_at IS NULL AND (title ILIKE '%u%' OR source_url ILIKE '%u%') ORDER BY created_at DESC, id DESC LIMIT 100")
def jobs_history(spark: SparkSession, sf: str) -> DataFrame:
    return J.history(jobs_of(spark, sf), 7, search="u").select("id", "title", "status", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


@query(f"WITH {_JOBS} SELECT (SELECT count(*) FROM customer) AS users, count(*) FILTER (deleted_at IS NULL) AS jobs, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'failed') AS failed, 0::BIGINT AS storage_bytes FROM jobs")
def jobs_admin_stats(spark: SparkSession, sf: str) -> DataFrame:
    return J.admin_stats(table(spark, sf, "customer"), jobs_of(spark, sf))


@query("SELECT event_id, user_id, event_type, props FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def jobs_admin_logs(spark: SparkSession, sf: str) -> DataFrame:
    return J.newest(table(spark, sf, "events"), 200, "ts", "event_id").select("event_id", "user_id", "event_type", "props")


@query(f"WITH {_JOBS} SELECT id, status, source_type FROM jobs WHERE deleted_at IS NULL ORDER BY created_at DESC, id DESC LIMIT 200")
def jobs_admin_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return J.newest(jobs_of(spark, sf).where("deleted_at is null")).select("id", "status", "source_type")


@query(f"""WITH {_JOBS}, c AS (SELECT coalesce(owner_user_id::VARCHAR, requester_hash) AS requester, owner_user_id IS NOT NULL AS is_user, count(*) FILTER (status IN ('pending', 'processing') AND deleted_at IS NULL) AS active FROM jobs GROUP BY ALL)
SELECT *, active < CASE WHEN is_user THEN 3 ELSE 1 END AS allowed FROM c""")
def jobs_concurrency(spark: SparkSession, sf: str) -> DataFrame:
    return J.concurrency(jobs_of(spark, sf))


@query(f"""WITH {_JOBS}, s AS (SELECT *, deleted_at IS NULL AND expires_at < TIMESTAMP '1996-06-01' AS over_, status IN ('pending','processing') AND updated_at < TIMESTAMP '1996-06-01' - INTERVAL 60 MINUTES AS stuck FROM jobs)
SELECT id, CASE WHEN over_ THEN 'expired' WHEN stuck THEN 'failed' END AS swept, CASE WHEN over_ THEN 'expired' WHEN stuck THEN 'failed' ELSE status END AS status, deleted_at IS NOT NULL OR over_ AS gone FROM s""")
def jobs_retention(spark: SparkSession, sf: str) -> DataFrame:
    swept = J.retention(jobs_of(spark, sf), F.lit("1996-06-01").cast("timestamp"))
    return swept.select("id", "swept", "status", F.col("deleted_at").isNotNull().alias("gone"))


@query(f"WITH {_JOBS} SELECT id, CASE WHEN deleted_at IS NOT NULL THEN 'missing' WHEN c_nationkey = 3 OR owner_user_id = c_custkey OR requester_hash = 'guest7' THEN 'ok' ELSE 'denied' END AS access FROM jobs JOIN customer ON c_custkey = id % 100 + 1")
def jobs_access(spark: SparkSession, sf: str) -> DataFrame:
    both = jobs_of(spark, sf).join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("id") % 100 + 1)
    return both.select("id", J.access(F.col("deleted_at"), F.col("owner_user_id"), F.col("requester_hash"), F.col("c_custkey"), F.col("c_nationkey") == 3, F.lit("guest7")).alias("access"))


_EXT = "CASE %s END" % " ".join(f"WHEN e = '{k}' THEN '{v}'" for k, v in J.EXTENSIONS.items())


@query(f"""WITH f AS (SELECT doc_id, ['txt','md','html','htm','csv','pdf','docx','mp3','wav','mp4','exe','MKV'][doc_id % 12 + 1] AS x FROM documents),
t AS (SELECT doc_id, x, lower(x) AS e FROM f), d AS (SELECT doc_id, x, {_EXT} AS source_type FROM t)
SELECT doc_id, source_type, CASE WHEN source_type = 'webpage' THEN 'web' WHEN source_type = 'audio' THEN 'audio' WHEN source_type IN ('video', 'video_url') THEN 'video' ELSE 'file' END AS queue,
  source_type IS NOT NULL AND doc_id % 3 <> 1 AS allowed, sha256('s:' || doc_id) AS hashed FROM d""")
def jobs_queue_routing(spark: SparkSession, sf: str) -> DataFrame:
    ends = F.array(*[F.lit(x) for x in ("txt", "md", "html", "htm", "csv", "pdf", "docx", "mp3", "wav", "mp4", "exe", "MKV")])
    named = spread(table(spark, sf, "documents")).withColumn("name", F.concat("source", F.lit("."), F.element_at(ends, (F.col("doc_id") % 12 + 1).cast("int"))))
    none = F.lit(None).cast("string")
    kind = J.detect_source_type(F.col("name"), none, none, none, none)
    mime = F.when(F.col("doc_id") % 3 == 0, "text/plain").when(F.col("doc_id") % 3 == 1, "application/x-sh").otherwise(none)
    return named.select("doc_id", kind.alias("source_type"), J.queue_for_source(kind).alias("queue"), J.allowed_upload(F.col("name"), mime).alias("allowed"), J.secret_hash(F.lit("s"), F.col("doc_id").cast("string")).alias("hashed"))


# ---- reports -------------------------------------------------------------------------------------------------------

_COMPAT = r"""compat AS (SELECT doc_id, source, lang, round(greatest(
  least(length(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))), 3000) / 30 + least(len(regexp_extract_all(text, '(?m)^#{1,6}\s+')), 12) * 4.0::DOUBLE + least(len(regexp_extract_all(text, '\[([^\]]+)\]\([^)]+\)')), 20) * 1.5::DOUBLE
  + least(len(regexp_extract_all(text, '(?m)^[-*]\s+')), 30) * 1.0::DOUBLE + least(len(regexp_extract_all(text, '```')) // 2, 5) * 6.0::DOUBLE + least(len(regexp_extract_all(text, '(?m)^\|.+\|$')), 10) * 3.0::DOUBLE
  + CASE WHEN source <> 'src3' THEN 15.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN length(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) < 120 THEN -50.0::DOUBLE ELSE 0.0::DOUBLE END, 0.0::DOUBLE), 2) AS score FROM documents),
results AS (SELECT *, CASE WHEN score >= 85 THEN 'strong' WHEN score >= 55 THEN 'usable' WHEN score >= 25 THEN 'weak' ELSE 'failed' END AS status FROM compat)"""


def results_of(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in the role of conversion results."""
    extractor = F.when(F.col("source") == "src3", "body-fallback").otherwise(F.col("source"))
    scored = spread(table(spark, sf, "documents")).select("doc_id", "source", "lang", R.compat_score(F.col("text"), extractor).alias("score"))
    rated = scored.withColumn("status", R.status_from_score(F.col("score")))
    return rated.select("*", (F.col("status") != "failed").alias("ok"), F.col("source").alias("category"), (F.col("doc_id") % 7 == 0).alias("rendered"), F.lit(1).alias("attempt"))


@query(f"WITH {_COMPAT} SELECT doc_id, score, status FROM results")
def bench_compat_score(spark: SparkSession, sf: str) -> DataFrame:
    return results_of(spark, sf).select("doc_id", "score", "status")


@query(f"""WITH {_COMPAT}, o AS (SELECT *, status <> 'failed' AS ok FROM results) SELECT dimension, value, count(*) AS n, count(*) FILTER (ok) AS n_ok FROM
  (SELECT 'status' AS dimension, status AS value, ok FROM o UNION ALL SELECT 'lang', coalesce(lang, 'unknown'), ok FROM o UNION ALL SELECT 'source', coalesce(source, 'unknown'), ok FROM o) GROUP BY ALL""")
def bench_summary_sets(spark: SparkSession, sf: str) -> DataFrame:
    return R.summary_sets(results_of(spark, sf), ["status", "lang", "source"])


@query(f"""WITH {_COMPAT} SELECT count(*) AS total, count(*) FILTER (status <> 'failed') AS ok, round(count(*) FILTER (status <> 'failed') / count(*), 4) AS success_rate,
  round(avg(score), 2) AS average_score, count(*) FILTER (doc_id % 7 = 0) AS rendered_count, 0::BIGINT AS retry_successes FROM results""")
def bench_summary(spark: SparkSession, sf: str) -> DataFrame:
    return R.summarize(results_of(spark, sf))


@query(f"WITH {_COMPAT} SELECT source AS category, count(*) AS total, count(*) FILTER (status <> 'failed') AS ok, round(count(*) FILTER (status <> 'failed') / count(*), 4) AS success_rate FROM results GROUP BY source")
def bench_category_success(spark: SparkSession, sf: str) -> DataFrame:
    return R.category_success(results_of(spark, sf))


@query(f"""WITH {_COMPAT}, retry AS (SELECT * FROM results WHERE status = 'failed' AND doc_id % 2 = 0)
SELECT 'd' || r.doc_id AS url, CASE WHEN t.doc_id IS NOT NULL THEN 'usable' ELSE r.status END AS status, CASE WHEN t.doc_id IS NOT NULL THEN r.score + 55 ELSE r.score END AS score,
  CASE WHEN t.doc_id IS NOT NULL THEN 2 ELSE 1 END AS attempt, CASE WHEN t.doc_id IS NOT NULL THEN r.status END AS first_attempt_status FROM results r LEFT JOIN retry t USING (doc_id)""")
def bench_retry_merge(spark: SparkSession, sf: str) -> DataFrame:
    first = results_of(spark, sf).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("url"), "doc_id", "ok", "status", "score", "attempt")
    retries = first.where("not ok").withColumns({"ok": F.col("doc_id") % 2 == 0, "status": F.lit("usable"), "score": F.col("score") + 55, "attempt": F.lit(2)})
    return R.merge_retries(first, retries).select("url", "status", "score", "attempt", "first_attempt_status")


@query(r"""WITH t AS (SELECT page_id, lower(regexp_replace(url || ' ' || html, '\s+', ' ', 'g')) AS t FROM pages)
SELECT page_id, CASE WHEN contains(t, 'checking your browser') OR contains(t, '正在检查您的浏览器') OR contains(t, 'client challenge') OR contains(t, 'just a moment') OR contains(t, 'enable javascript') OR contains(t, 'javascript is disabled') THEN 'challenge_or_js_required'
  WHEN contains(t, '登录或注册') OR contains(t, 'sign in') OR contains(t, 'log in') OR contains(t, 'login') OR contains(t, 'your request has been blocked') OR contains(t, 'access denied') OR contains(t, 'forbidden') THEN 'login_or_blocked' END AS failure FROM t""")
def bench_failure_class(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", R.failure_class(F.col("html"), F.col("url")).alias("failure"))


@query(rf"WITH {_COUNTS} SELECT doc_id, array_to_string(list_filter([CASE WHEN paragraph_count < 3 THEN 'paragraphs<3' END, CASE WHEN heading_count < 1 THEN 'headings<1' END, CASE WHEN NOT contains(lower(title), 'e') THEN 'title_missing:e' END], lambda x: x IS NOT NULL), ',') AS failures FROM rated")
def bench_expectations(spark: SparkSession, sf: str) -> DataFrame:
    s = scored_documents(spark, sf)
    found = {"paragraphs": F.col("paragraph_count"), "headings": F.col("heading_count")}
    return s.select("doc_id", F.array_join(R.unmet(found, {"paragraphs": F.lit(3), "headings": F.lit(1)}, F.col("title"), F.lit("e")), ",").alias("failures"))


# ---- lines as laid-out blocks --------------------------------------------------------------------------------------


@query(r"""WITH l AS (SELECT source AS doc, doc_id AS page, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
k AS (SELECT doc, page, lower(regexp_replace(line, '[^\p{L}\p{N}]+', '', 'g')) AS key FROM l), n AS (SELECT source AS doc, count(DISTINCT doc_id) AS pages FROM documents GROUP BY source)
SELECT k.doc, key, count(DISTINCT page) AS pages FROM k JOIN n ON k.doc = n.doc WHERE key <> '' AND length(key) <= 140 GROUP BY k.doc, key, n.pages HAVING count(DISTINCT page) >= greatest(3, floor(0.05 * n.pages))""")
def pdf_recurring_lines(spark: SparkSession, sf: str) -> DataFrame:
    from marlstone.operators import layout as L

    d = spread(table(spark, sf, "documents"))
    lines = d.select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.explode(F.split(T.text0(F.col("text")), "\n")).alias("text"))
    return L.recurring_keys(lines, share=0.05)


@query("SELECT l_suppkey AS doc, median(l_quantity) AS body_size, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def pdf_body_font_median(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("doc")).agg(F.median("l_quantity").alias("body_size"), F.count("*").alias("n"))


# ---- guards and rows of cells --------------------------------------------------------------------------------------

_V4 = "(c_custkey * 2654435761 % 4294967296)::BIGINT"
_V4_TEXT = "((v >> 24) & 255) || '.' || ((v >> 16) & 255) || '.' || ((v >> 8) & 255) || '.' || (v & 255)"
_NETS = ((0, 8), (10 << 24, 8), ((100 << 24) + (64 << 16), 10), (127 << 24, 8), ((169 << 24) + (254 << 16), 16), ((172 << 24) + (16 << 16), 12), (192 << 24, 24), ((192 << 24) + (168 << 16), 16), ((198 << 24) + (18 << 16), 15), (224 << 24, 4), (240 << 24, 4))


@query(f"""WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN [10::BIGINT, 127, 172, 192, 169, 100, 198, 8][c_custkey % 8 + 1] * 16777216 + ({_V4} % 16777216) ELSE {_V4} END AS v FROM customer),
b AS (SELECT *, {_V4_TEXT} AS host, {" OR ".join(f"v BETWEEN {n} AND {n + (1 << (32 - k)) - 1}" for n, k in _NETS)} AS private FROM a),
u AS (SELECT c_custkey, private, CASE c_custkey % 5 WHEN 0 THEN 'http://' || host || '/x' WHEN 1 THEN 'https://user@' || host || ':8443' WHEN 2 THEN 'http://[::ffff:' || host || ']/' WHEN 3 THEN 'HTTP://' || v || '/' ELSE CASE WHEN c_custkey % 2 = 0 THEN 'ftp://' || host ELSE 'http://localhost.localdomain/' END END AS url FROM b)
SELECT c_custkey, url, CASE WHEN c_custkey % 5 = 4 THEN CASE WHEN c_custkey % 2 = 0 THEN 'scheme' ELSE 'host' END WHEN private THEN 'address' ELSE 'ok' END AS verdict FROM u""")
def url_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses of customers' numbers in the forms that URLs give them."""
    from marlstone.operators import urls as U

    key = F.col("c_custkey")
    v = key * F.lit(2654435761) % F.lit(4294967296)
    first = F.element_at(F.array(*[F.lit(x).cast("long") for x in (10, 127, 172, 192, 169, 100, 198, 8)]), (key % 8 + 1).cast("int"))
    numbered = table(spark, sf, "customer").select("c_custkey", F.when(key % 3 == 0, first * 16777216 + v % 16777216).otherwise(v).cast("long").alias("v"))
    host = F.concat_ws(".", *[F.floor(F.col("v") / (1 << k)) % 256 for k in (24, 16, 8, 0)])
    form = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    url = (
        F.when(key % 5 == 0, form("http://", host, "/x")).when(key % 5 == 1, form("https://user@", host, ":8443")).when(key % 5 == 2, form("http://[::ffff:", host, "]/"))
        .when(key % 5 == 3, form("HTTP://", F.col("v").cast("string"), "/")).when(key % 2 == 0, form("ftp://", host)).otherwise(F.lit("http://localhost.localdomain/"))
    )
    return numbered.withColumn("url", url).select("c_custkey", "url", U.url_verdict(F.col("url")).alias("verdict"))


_CELLS = "[[n_name, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey::VARCHAR ELSE '' END, ''], ['', '', ''], [n_name, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey::VARCHAR ELSE '' END, ''], ['x', '', 'y1']]"


@query(f"""WITH r AS (SELECT n_nationkey, flatten({_CELLS}) AS c FROM nation), f AS (SELECT n_nationkey, list_filter(c, lambda x: x <> '') AS said, len(c) AS n FROM r)
SELECT n_nationkey, round(len(said) / n, 6) AS fill, round(len(list_filter(said, lambda x: regexp_matches(x, '[0-9]'))) / len(said), 6) AS numeric, len(said) >= 4 AS useful FROM f""")
def table_fill_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of filled cells and of cells with figures, of small tables of nations."""
    from marlstone.operators import layout as L

    key, even = F.col("n_nationkey"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey").cast("string")).otherwise("")
    row = lambda *cells: F.array(*[F.lit(c) if isinstance(c, str) else c for c in cells])
    rows = F.array(row(F.col("n_name"), even, ""), row("", "", ""), row(F.col("n_name"), even, ""), row("x", "", "y1"))
    t = table(spark, sf, "nation").select(key, rows.alias("rows"))
    return t.select("n_nationkey", F.round(L.filled(F.col("rows")) / (F.size("rows") * L.width(F.col("rows"))), 6).alias("fill"), F.round(L.numeric_ratio(F.col("rows")), 6).alias("numeric"), L.is_useful_table(F.col("rows")).alias("useful"))


@query("""WITH j AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS user_id, ['a.PDF','b.exe','x/c.txt',NULL,'d.docx'][o_orderkey % 5 + 1] AS filename, ['application/pdf',NULL,'text/plain','x/y'][o_orderkey % 4 + 1] AS mime FROM orders),
k AS (SELECT *, lower(regexp_extract(filename, '\\.([^.]+)$', 1)) AS e FROM j), t AS (SELECT *, CASE e WHEN 'pdf' THEN 'pdf' WHEN 'txt' THEN 'text' WHEN 'docx' THEN 'docx' END AS named FROM k),
d AS (SELECT *, CASE WHEN filename IS NULL THEN 'text' ELSE named END AS source_type FROM t)
SELECT id, source_type, CASE WHEN source_type IS NULL THEN 'source_type' WHEN filename IS NOT NULL AND NOT (coalesce(mime, 'application/octet-stream') IN ('application/pdf', 'application/octet-stream') OR mime = 'text/plain') THEN 'upload' END AS refusal,
  CASE WHEN filename IS NULL THEN 'input.txt' ELSE regexp_extract(filename, '([^/]+)$', 1) END AS input_filename, 'file' AS queue_name, CASE WHEN user_id IS NULL THEN '2024-01-02' ELSE '2024-01-08' END AS until FROM d""")
def jobs_created(spark: SparkSession, sf: str) -> DataFrame:
    """Orders in the role of requests for jobs."""
    key = F.col("o_orderkey")
    pick = lambda n, *xs: F.element_at(F.array(*[F.lit(x) if x else F.lit(None).cast("string") for x in xs]), (key % n + 1).cast("int"))
    none = F.lit(None).cast("string")
    asked = table(spark, sf, "orders").select(key.alias("id"), F.when(key % 3 != 0, F.col("o_custkey")).alias("user_id"), pick(5, "a.PDF", "b.exe", "x/c.txt", None, "d.docx").alias("filename"), pick(4, "application/pdf", None, "text/plain", "x/y").alias("mime"), none.alias("requested"), none.alias("url"), F.lit("t").alias("text"), none.alias("html"), none.alias("address"), none.alias("agent"))
    made = J.created(asked, F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("s"))
    return made.select("id", "source_type", "refusal", "input_filename", "queue_name", F.date_format("expires_at", "yyyy-MM-dd").alias("until"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, i, CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(trim(line), '^#{1,6}\s+.+$') THEN 'heading' WHEN starts_with(trim(line), '>') THEN 'quote' ELSE 'paragraph' END AS kind FROM l
  WHERE doc_id IN (SELECT doc_id FROM documents WHERE NOT contains(coalesce(text, ''), '```') AND NOT contains(coalesce(text, ''), '$$') AND NOT contains(coalesce(text, ''), '|') AND NOT contains(coalesce(text, ''), '!['))),
g AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM k)
SELECT doc_id, kind, count(*) AS n FROM g WHERE kind IN ('heading', 'quote') OR kind = 'paragraph' AND coalesce(before, '') <> 'paragraph' GROUP BY ALL""")
def viewer_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks by kind of the documents that have neither fences nor formulas, tables and images."""
    from marlstone.operators import viewer as V

    docs = spread(table(spark, sf, "documents")).withColumn("text", T.text0(F.col("text")))
    plain = docs.where(~F.col("text").contains("```") & ~F.col("text").contains("$$") & ~F.col("text").contains("|") & ~F.col("text").contains("!["))
    return V.with_blocks(plain, "text", "doc_id").select("doc_id", F.explode("blocks.kind").alias("kind")).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT o_orderkey, ['succeeded', 'pending', 'failed', 'succeeded'][o_orderkey % 4 + 1] AS s, ['md', 'zip', 'pdf'][o_orderkey % 3 + 1] AS f, CASE WHEN o_orderkey % 7 <> 0 THEN 'p' END AS p FROM orders)
SELECT o_orderkey, CASE WHEN s <> 'succeeded' THEN 409 WHEN f = 'pdf' THEN 400 WHEN p IS NULL THEN 404 ELSE 200 END AS code, CASE WHEN s = 'succeeded' AND f <> 'pdf' AND p IS NOT NULL THEN o_orderkey || '.' || f END AS name FROM r""")
def jobs_download(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    pick = lambda n, *xs: F.element_at(F.array(*map(F.lit, xs)), (key % n + 1).cast("int"))
    path = F.when(key % 7 != 0, F.lit("p"))
    d = J.download(pick(4, "succeeded", "pending", "failed", "succeeded"), pick(3, "md", "zip", "pdf"), F.lit(None).cast("string"), key, path, path)
    return table(spark, sf, "orders").select("o_orderkey", d["code"].alias("code"), d["name"].alias("name"))
