"""The job store: routing, access, limits, history, administration and retention over a jobs table.

Jobs have id, owner_user_id, guest_token_hash, requester_hash, source_type, source_url, input_filename, title, status,
progress, created_at, updated_at, expires_at and deleted_at, as far as an operator needs them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# File extensions and what they hold.
EXTENSIONS = {
    "txt": "text", "md": "text", "html": "html", "htm": "html", "csv": "csv", "pdf": "pdf", "docx": "docx",
    "mp3": "audio", "wav": "audio", "m4a": "audio", "aac": "audio", "ogg": "audio", "flac": "audio",
    "mp4": "video", "mov": "video", "mkv": "video", "webm": "video",
}
SOURCE_TYPES = ("webpage", "text", "html", "csv", "pdf", "docx", "audio", "video", "video_url")
MIME_TYPES = (
    "application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/msword",
    "application/csv", "application/octet-stream",
)
ACTIVE = ("pending", "processing")
RENDERABLE_STATUS = (401, 402, 403, 406, 408, 409, 425, 429, 500, 502, 503, 504)
USER_LIMIT, GUEST_LIMIT = 3, 1
USER_DAYS, GUEST_HOURS, STUCK_MINUTES = 7, 24, 60


def extension(filename: Column) -> Column:
    """Lower case, without the dot; empty where there is none or the name only begins with a dot."""
    return F.lower(F.regexp_extract(F.coalesce(filename, F.lit("")), r"[^/.][^/]*?\.([^./]+)$", 1))


def detect_source_type(filename: Column, requested: Column, url: Column, text: Column, html: Column) -> Column:
    """A requested type, else by extension, else html, text, url in this order. Null is what would be refused: an unknown
    type, an unknown extension, or nothing given."""
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    return (
        F.when(given(requested), F.when(requested.isin(*SOURCE_TYPES), requested))
        .when(given(filename), F.try_element_at(known, extension(filename)))
        .when(given(html), F.lit("html")).when(given(text), F.lit("text")).when(given(url), F.lit("webpage"))
    )


def queue_for_source(source_type: Column) -> Column:
    return F.when(source_type == "webpage", "web").when(source_type == "audio", "audio").when(source_type.isin("video", "video_url"), "video").otherwise("file")


def allowed_upload(filename: Column, mime: Column) -> Column:
    kind = F.coalesce(F.nullif(mime, F.lit("")), F.lit("application/octet-stream"))
    return extension(filename).isin(*EXTENSIONS) & (kind.isin(*MIME_TYPES) | kind.rlike(r"^(text|audio|video)/"))


def secret_hash(secret: Column, value: Column) -> Column:
    return F.sha2(F.concat_ws(":", secret, value), 256)


def requester_hash(secret: Column, address: Column, agent: Column) -> Column:
    return secret_hash(secret, F.concat_ws(":", F.coalesce(address, F.lit("unknown")), F.coalesce(agent, F.lit(""))))


def should_render(status: Column) -> Column:
    """Whether an HTTP error may go away in a browser."""
    return F.coalesce(status.isin(*RENDERABLE_STATUS), F.lit(False))


def renderable_error(error: Column) -> Column:
    return F.coalesce(error.isin("ConnectError", "ConnectTimeout", "ReadError", "ReadTimeout", "RemoteProtocolError", "WriteError", "WriteTimeout", "PoolTimeout"), F.lit(False))


def history(jobs: DataFrame, user: str | int, source_type: str | None = None, status: str | None = None, search: str | None = None, limit: int = 100) -> DataFrame:
    """The newest `limit` jobs of a user that are not deleted, by type, status and text if given. Wildcards in `search`
    work as such; ties in time go to the greater id."""
    found = jobs.where((F.col("owner_user_id") == F.lit(user)) & F.col("deleted_at").isNull())
    for name, value in (("source_type", source_type), ("status", status)):
        found = found if value is None else found.where(F.col(name) == value)
    if search:
        like = f"%{search}%"
        found = found.where(F.col("title").ilike(like) | F.col("source_url").ilike(like) | F.col("input_filename").ilike(like))
    return newest(found, limit)


def newest(df: DataFrame, limit: int = 200, by: str = "created_at", tie: str = "id") -> DataFrame:
    """Top rows by time: a bounded heap in each task, not a sort of the table."""
    return df.orderBy(F.desc(by), F.desc(tie)).limit(limit)


def concurrency(jobs: DataFrame, user_limit: int = USER_LIMIT, guest_limit: int = GUEST_LIMIT) -> DataFrame:
    """(requester, is_user, active, allowed): active jobs by owner, or by requester where there is none."""
    live = F.col("status").isin(*ACTIVE) & F.col("deleted_at").isNull()
    who = jobs.withColumn("is_user", F.col("owner_user_id").isNotNull()).withColumn("requester", F.coalesce(F.col("owner_user_id").cast("string"), "requester_hash"))
    counted = who.groupBy("requester", "is_user").agg(F.count_if(live).alias("active"))
    return counted.withColumn("allowed", F.col("active") < F.when(F.col("is_user"), user_limit).otherwise(guest_limit))


def access(deleted_at: Column, owner: Column, token_hash: Column, user: Column, is_admin: Column, guest_hash: Column) -> Column:
    """`missing`, `ok` or `denied`, in this order of checks."""
    may = F.coalesce(is_admin, F.lit(False)) | F.coalesce(owner == user, F.lit(False)) | F.coalesce(token_hash == guest_hash, F.lit(False))
    return F.when(deleted_at.isNotNull(), "missing").when(may, "ok").otherwise("denied")


def admin_stats(users: DataFrame, jobs: DataFrame, storage_bytes: int = 0) -> DataFrame:
    """One row. `jobs` leaves deleted ones out, the counts by status do not."""
    status = lambda s: F.count_if(F.col("status") == s).alias(s)
    counted = jobs.agg(F.count_if(F.col("deleted_at").isNull()).alias("jobs"), status("pending"), status("processing"), status("failed"))
    return counted.crossJoin(F.broadcast(users.agg(F.count("*").alias("users")))).withColumn("storage_bytes", F.lit(storage_bytes).cast("long"))


def expiry(created_at: Column, is_user: Column) -> Column:
    return F.when(is_user, created_at + F.expr(f"INTERVAL {USER_DAYS} DAYS")).otherwise(created_at + F.expr(f"INTERVAL {GUEST_HOURS} HOURS"))


def retention(jobs: DataFrame, now: Column, stuck_minutes: int = STUCK_MINUTES) -> DataFrame:
    """`jobs` after a sweep at `now`, with swept (`failed`, `expired` or null). A stuck active job fails; what is past
    its expiry and not deleted then expires, a job that just failed included."""
    stuck = F.col("status").isin(*ACTIVE) & (F.col("updated_at") < now - F.expr(f"INTERVAL {stuck_minutes} MINUTES"))
    over = F.col("deleted_at").isNull() & (F.col("expires_at") < now)
    return jobs.withColumns({
        "swept": F.when(over, "expired").when(stuck, "failed"),
        "status": F.when(over, "expired").when(stuck, "failed").otherwise(F.col("status")),
        "deleted_at": F.when(over, now).otherwise(F.col("deleted_at")),
    })


def retried(jobs: DataFrame, now: Column) -> DataFrame:
    """Finished, not deleted jobs, set back to the start; title, language and duration stay."""
    done = jobs.where(F.col("status").isin("succeeded", "failed", "expired") & F.col("deleted_at").isNull())
    reset = {"status": F.lit("pending"), "progress": F.lit(0), "expires_at": expiry(now, F.col("owner_user_id").isNotNull())}
    gone = [c for c in ("error_message", "started_at", "completed_at", "markdown_path", "zip_path", "metadata_json") if c in jobs.columns]
    return done.withColumns(reset | {c: F.lit(None).cast(jobs.schema[c].dataType) for c in gone})


def registered(requests: DataFrame, users: DataFrame) -> DataFrame:
    """New accounts (email, role) of sign-up `requests` (email, at): one an address in lower case, none that exists; the
    first of all, where there are no users yet, is the administrator."""
    wanted = requests.select(F.lower("email").alias("email"), "at").where("email is not null").groupBy("email").agg(F.min("at").alias("at"))
    fresh = wanted.join(users.select(F.lower("email").alias("email")), "email", "left_anti")
    first = fresh.agg(F.min(F.struct("at", "email")).alias("f")).crossJoin(users.limit(1).agg(F.count("*").alias("n")))
    return fresh.crossJoin(F.broadcast(first)).select("email", F.when((F.col("n") == 0) & (F.col("email") == F.col("f.email")), "admin").otherwise("user").alias("role"))


def safe_asset(path: Column) -> Column:
    """Whether a relative asset path stays below its folder."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), lambda s, p: _step(s, p))
    return F.coalesce((path != "") & ~path.startswith("/") & (depth["low"] >= 0), F.lit(False))


def _step(s: Column, p: Column) -> Column:
    d = s["d"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)
    return F.struct(d.alias("d"), F.least(s["low"], d).alias("low"))


def unique_filenames(df: DataFrame, name: str, group: str, order: str) -> DataFrame:
    """`df` with unique_name: the second file of a name in its group gets -2 before the extension, and so on."""
    nth = F.row_number().over(Window.partitionBy(group, name).orderBy(order))
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    return df.withColumn("unique_name", F.when(nth == 1, F.col(name)).otherwise(F.concat(stem, F.lit("-"), nth.cast("string"), ext)))


def created(requests: DataFrame, now: Column, secret: Column) -> DataFrame:
    """New jobs of `requests` (id, user_id, filename, mime, requested, url, text, html, address, agent), with refusal, the
    reason why there is none, and null in it where there is one.

    The input is the file, else the text, else the HTML, though the type of the latter two is told the other way round.
    Guests get a token hash of their own. A job expires after the days of users or the hours of guests.
    """
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    kind = detect_source_type(F.col("filename"), F.col("requested"), F.col("url"), F.col("text"), F.col("html"))
    user = F.col("user_id").isNotNull()
    refusal = F.when(kind.isNull(), "source_type").when(given("filename") & ~F.coalesce(allowed_upload(F.col("filename"), F.col("mime")), F.lit(False)), "upload")
    name = F.when(given("filename"), F.element_at(F.split(F.replace("filename", F.lit("\\"), F.lit("/")), "/"), -1)).when(F.col("text").isNotNull(), "input.txt").when(F.col("html").isNotNull(), "input.html")
    size = F.when(~given("filename"), F.octet_length(F.coalesce("text", "html"))).cast("long")
    return requests.select(
        "id", F.col("user_id").alias("owner_user_id"), F.when(~user, secret_hash(secret, F.col("id").cast("string"))).alias("guest_token_hash"),
        requester_hash(secret, F.col("address"), F.col("agent")).alias("requester_hash"), kind.alias("source_type"), F.nullif("url", F.lit("")).alias("source_url"),
        name.alias("input_filename"), F.col("mime").alias("input_mime"), size.alias("input_size"), queue_for_source(kind).alias("queue_name"),
        F.lit("pending").alias("status"), F.lit(0).alias("progress"), now.alias("created_at"), now.alias("updated_at"), expiry(now, user).alias("expires_at"),
        F.lit(None).cast("timestamp").alias("deleted_at"), refusal.alias("refusal"),
    )


def deleted(jobs: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """`jobs` with those in `ids` (id) marked as deleted at `now`; those that were deleted before stay as they are."""
    gone = ids.select(F.col("id").alias("gone_id")).distinct()
    marked = jobs.join(gone, F.col("id") == F.col("gone_id"), "left")
    return marked.withColumn("deleted_at", F.when(F.col("gone_id").isNotNull(), F.coalesce("deleted_at", now)).otherwise(F.col("deleted_at"))).drop("gone_id")


def result_status(status: Column, path: Column) -> Column:
    """What a request for a result gets: 409 until the job has succeeded, 404 without a file, else 200."""
    return F.when(~F.coalesce(status == "succeeded", F.lit(False)), 409).when(F.coalesce(path, F.lit("")) == "", 404).otherwise(200)


def download(status: Column, form: Column, title: Column, job_id: Column, markdown_path: Column, zip_path: Column) -> Column:
    """(code, name, media_type) of a download as `md` or `zip`; another form is a 400."""
    path = F.when(form == "md", markdown_path).otherwise(zip_path)
    code = F.when(~F.coalesce(status == "succeeded", F.lit(False)), 409).when(~form.isin("md", "zip"), 400).when(F.coalesce(path, F.lit("")) == "", 404).otherwise(200)
    name = F.concat(F.coalesce(F.nullif(title, F.lit("")), job_id.cast("string")), F.lit("."), form)
    return F.struct(code.alias("code"), F.when(code == 200, name).alias("name"), F.when(code == 200, F.when(form == "md", "text/markdown").otherwise("application/zip")).alias("media_type"))


def current_users(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """`sessions` (subject, expires_at, at) with user_id: the active user of a token that is still good, else null."""
    active = users.where("is_active").select(F.col("id").cast("string").alias("u_id"), F.col("id").alias("user_id"))
    good = F.coalesce(F.col("expires_at") > F.col("at"), F.lit(False))
    return sessions.join(active, (F.col("subject").cast("string") == F.col("u_id")) & good, "left").drop("u_id")


def capabilities(settings: dict[str, str | None]) -> dict[str, object]:
    """Which parts of the service can work, from what is installed and set (asr_provider, asr_api_key, ai_api_key)."""
    import importlib.util
    import shutil

    provider = settings.get("asr_provider") or "local_whisper"
    cloud = provider == "cloud_openai_compatible"
    found = {name: shutil.which(name) is not None for name in ("ffmpeg", "ffprobe")}
    found |= {name: importlib.util.find_spec(module) is not None for name, module in (("yt_dlp", "yt_dlp"), ("local_asr", "faster_whisper"))}
    keys = bool(settings.get("asr_api_key") or settings.get("ai_api_key"))
    return found | {"cloud_asr_configured": cloud and keys, "ai_summary_configured": bool(settings.get("ai_api_key")), "asr_provider": provider}
