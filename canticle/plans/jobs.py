"""Job, stage, party and rate-limit queries over event tables; batch twins of the streaming operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from canticle.functions.text import clean_name
from canticle.operators import jobs as J
from canticle.operators import library as L
from canticle.plans import query
from canticle.plans.library import FOLD
from canticle.plans.views import COLL, LIB, QUEUE, coll, coll_songs, epoch, lib, micros, queue, table
from canticle.shipping import ship

STATUS = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END"
RANK = "CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 2 WHEN 'error' THEN 2 ELSE 1 END"
JOBS = f"jobs AS (SELECT user_id AS job, event_id, epoch_us(ts) AS us, CAST(floor(epoch(ts)) AS BIGINT) AS secs, event_type, value, {STATUS} AS status, {RANK} AS rank FROM events)"


def jobs(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("job"), "event_id", micros("ts").alias("us"), epoch("ts").alias("at"), "event_type", "value")
    return e.withColumn("status", F.expr(STATUS)).withColumn("rank", F.expr(RANK))


@query("job_reduce", f"WITH {JOBS} SELECT job, arg_max(status, [rank, us, event_id]) AS status, count(*) AS events FROM jobs GROUP BY job")
def job_reduce(spark, sf):
    """Late events never take a job back: the highest rank wins, then the latest."""
    return jobs(spark, sf).groupBy("job").agg(F.max_by("status", F.struct("rank", "us", "event_id")).alias("status"), F.count("*").alias("events"))


def song_jobs(spark, sf):
    """Each job with its song, by id or by audio path, and its status; every fifth one was cancelled."""
    r = job_reduce(spark, sf)
    n = lib(spark, sf).select(F.col("id").alias("_id"), F.col("audio_path").alias("audio_path"))
    k = F.col("job")
    j = r.select("job", F.when(k % 3 != 0, k % 180 + 1).alias("song_id"), F.when(k % 3 != 1, k * 7 % 180 + 1).alias("_id"), F.when(k % 5 == 0, "cancelled").otherwise(F.col("status")).alias("status"), k.alias("seq"))
    return j.join(n, "_id", "left").drop("_id")


STATES = f"""{LIB}, {JOBS}, r AS (SELECT job, CASE WHEN job % 5 = 0 THEN 'cancelled' ELSE arg_max(status, [rank, us, event_id]) END AS status FROM jobs GROUP BY job),
 own AS (SELECT DISTINCT l.id, r.job, r.status FROM lib l JOIN r ON (r.job % 3 <> 0 AND r.job % 180 + 1 = l.id) OR (r.job % 3 <> 1 AND r.job * 7 % 180 + 1 = l.id)),
 last AS (SELECT id, bool_or(status IN ('queued', 'running')) AS active, arg_max(status, job) FILTER (WHERE status <> 'cancelled') AS latest FROM own GROUP BY id),
 states AS (SELECT id, title, CASE WHEN active THEN 'processing' WHEN latest = 'failed' THEN 'failed' WHEN timing_map_path IS NULL THEN 'needs-timings' WHEN reviewed_at IS NULL THEN 'review' ELSE 'ready' END AS state FROM lib LEFT JOIN last USING (id))"""


@query("song_status", f"WITH {STATES} SELECT id, state, row_number() OVER (ORDER BY list_position(['processing', 'failed', 'review', 'needs-timings', 'ready'], state), {FOLD.format('title')}, id) AS place FROM states")
def song_status(spark, sf):
    """The state of every song, and its place in a list by state."""
    s = J.song_states(lib(spark, sf), song_jobs(spark, sf))
    return L.ranked(s, J.state_rank(F.col("state")), L.ascii_fold(F.col("title")), F.col("id")).select("id", "state", "place")


@query("needs_attention", f"WITH {STATES} SELECT state, count(*) AS n FROM states WHERE state IN ('review', 'failed', 'needs-timings') GROUP BY state")
def needs_attention(spark, sf):
    s = J.song_states(lib(spark, sf), song_jobs(spark, sf))
    return s.where(F.col("state").isin("review", "failed", "needs-timings")).groupBy("state").agg(F.count("*").alias("n"))


TYPES = "CASE event_type WHEN 'view' THEN 'stage_progress' WHEN 'click' THEN 'stage_started' WHEN 'signup' THEN 'stage_skipped' WHEN 'purchase' THEN 'stage_completed' ELSE 'stage_failed' END"
STAGE_OF = "CASE event_id % 4 WHEN 0 THEN 'separate' WHEN 1 THEN 'clean_lyrics' WHEN 2 THEN 'align' ELSE 'export' END"


@query("stage_progress", f"""WITH {JOBS}, e AS (SELECT job, us, event_id, {TYPES} AS type, {STAGE_OF} AS stage, CASE WHEN event_id % 6 <> 0 THEN value / 500 END AS fraction, 'm' || event_id AS message FROM jobs)
SELECT job, arg_max(CASE WHEN type IN ('stage_started', 'stage_progress') AND stage = 'separate' THEN 'separating' ELSE 'aligning' END, [us, event_id]) FILTER (WHERE type IN ('stage_started', 'stage_progress') OR (type IN ('stage_skipped', 'stage_completed') AND stage = 'separate')) AS stage,
 nullif(arg_max(CASE WHEN type = 'stage_started' THEN -1 WHEN type = 'stage_completed' THEN 1 ELSE fraction END, [us, event_id]) FILTER (WHERE (type = 'stage_started' AND stage IN ('separate', 'align')) OR (type = 'stage_progress' AND stage IN ('separate', 'align') AND fraction IS NOT NULL) OR (type = 'stage_completed' AND stage = 'separate')), -1) AS fraction,
 arg_max(message, [us, event_id]) FILTER (WHERE type = 'stage_failed') AS failure FROM e GROUP BY job""")
def stage_progress(spark, sf):
    """What each job shows after its events: the stage, how far it is, and why it failed."""
    e = jobs(spark, sf).select("job", F.struct("us", "event_id").alias("seq"), F.expr(TYPES).alias("type"), F.expr(STAGE_OF).alias("stage"), F.when(F.col("event_id") % 6 != 0, F.col("value") / 500).alias("fraction"), F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("message"))
    return J.progress(e)


COMMAND = "CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'take' ELSE 'enqueue' END WHEN 'click' THEN 'retry' WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 'finish' ELSE 'restart' END ELSE CASE WHEN event_id % 2 = 0 THEN 'fail' ELSE 'cancel' END END"
STEP = "CASE WHEN c = 'enqueue' AND state IS NULL THEN 'queued' WHEN c = 'take' AND state = 'queued' THEN 'running' WHEN c = 'finish' AND state = 'running' THEN 'completed' WHEN c = 'fail' AND state = 'running' THEN 'failed' WHEN c = 'cancel' AND state IN ('queued', 'running') THEN 'cancelled' WHEN c = 'retry' AND state IN ('failed', 'cancelled') THEN 'queued' WHEN c = 'restart' AND state = 'running' THEN 'queued' ELSE state END"


def commands(spark, sf):
    order = Window.partitionBy("job").orderBy("us", "event_id")
    return jobs(spark, sf).select("job", F.row_number().over(order).alias("seq"), F.expr(COMMAND).alias("command"))


@query("job_lifecycles", f"""WITH RECURSIVE {JOBS}, c AS (SELECT job, {COMMAND} AS c, row_number() OVER (PARTITION BY job ORDER BY us, event_id) AS k, count(*) OVER (PARTITION BY job) AS n FROM jobs),
 s AS (SELECT job, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS state, 0 AS refused FROM c WHERE k = 1 UNION ALL SELECT c.job, c.k, {STEP}, refused + CASE WHEN {STEP} IS NOT DISTINCT FROM state THEN 1 ELSE 0 END FROM s JOIN c ON c.job = s.job AND c.k = s.k + 1)
SELECT s.job, state, CAST(refused AS BIGINT) AS refused FROM s JOIN c ON c.job = s.job AND c.k = s.k AND c.k = c.n""")
def job_lifecycles(spark, sf):
    """Jobs after their commands: what a command may do depends on the state that those before it left."""
    ship(spark)
    return J.lifecycles(commands(spark, sf))


@query("waiting_jobs", f"WITH {JOBS}, r AS (SELECT job * 40 + event_id % 40 AS job, arg_max(status, [rank, us, event_id]) AS status, min(us) AS since FROM jobs GROUP BY 1) SELECT job, row_number() OVER (ORDER BY since, job) AS place FROM r WHERE status IN ('queued', 'running') AND job % 5 <> 0")
def waiting_jobs(spark, sf):
    """What the queue file keeps over a restart: jobs that are not finished and not cancelled, the oldest first."""
    j = jobs(spark, sf).groupBy((F.col("job") * 40 + F.col("event_id") % 40).alias("job")).agg(F.max_by("status", F.struct("rank", "us", "event_id")).alias("status"), F.min("us").alias("since"))
    return L.ranked(j.where(F.col("status").isin("queued", "running") & (F.col("job") % 5 != 0)), F.col("since"), F.col("job")).select("job", "place")


STAGE = "CASE event_id % 4 WHEN 0 THEN 'separate' WHEN 1 THEN 'clean' WHEN 2 THEN 'align' ELSE 'export' END"
STAGES = f"st AS (SELECT job, event_id % 4 AS ord, {STAGE} AS stage, arg_max(status, [us, event_id]) AS status, arg_max(event_id, [us, event_id]) AS token FROM jobs GROUP BY ALL)"


def stages(spark, sf):
    s = jobs(spark, sf).withColumn("ord", F.col("event_id") % 4).withColumn("stage", F.expr(STAGE))
    seen = F.struct("us", "event_id")
    return s.groupBy("job", "ord", "stage").agg(F.max_by("status", seen).alias("status"), F.max_by("event_id", seen).alias("token"))


@query("job_summary_status", f"WITH {JOBS}, {STAGES} SELECT job, CASE WHEN count(*) FILTER (WHERE status = 'failed') > 0 THEN 'failed@' || arg_min(stage, ord) FILTER (WHERE status = 'failed') WHEN count(*) FILTER (WHERE status = 'running') > 0 THEN 'interrupted@' || arg_min(stage, ord) FILTER (WHERE status = 'running') WHEN count(*) FILTER (WHERE status = 'completed') = 4 THEN 'complete' ELSE 'partial' END AS summary FROM st GROUP BY job")
def job_summary_status(spark, sf):
    first = lambda status: F.min_by("stage", F.when(F.col("status") == status, F.col("ord")))
    s = stages(spark, sf).groupBy("job").agg(first("failed").alias("f"), F.count_if(F.col("status") == "failed").alias("nf"), first("running").alias("r"), F.count_if(F.col("status") == "running").alias("nr"), F.count_if(F.col("status") == "completed").alias("nc"))
    text = F.when(F.col("nf") > 0, F.concat(F.lit("failed@"), "f")).when(F.col("nr") > 0, F.concat(F.lit("interrupted@"), "r")).when(F.col("nc") == 4, "complete").otherwise("partial")
    return s.select("job", text.alias("summary"))


@query("stale_stages", f"WITH {JOBS}, {STAGES}, c AS (SELECT *, status = 'completed' AND token % 5 <> 0 AND token % 11 <> 0 AND token % 7 <> 0 AS fresh FROM st) SELECT job, stage, fresh, max(CASE WHEN fresh THEN 0 ELSE 1 END) OVER (PARTITION BY job ORDER BY ord) = 1 AS stale FROM c")
def stale_stages(spark, sf):
    """Stages that have to run again: incomplete, made from other inputs, without their artifact, or behind one that is."""
    t = F.col("token")
    s = stages(spark, sf).select(
        "job", "ord", "stage", "status", F.sha2(t.cast("string"), 256).alias("fingerprint"), F.sha2(F.when(t % 5 == 0, "other").otherwise(t.cast("string")), 256).alias("wanted"), (t % 100).alias("size"),
        F.when(t % 11 != 0, t % 100 + F.when(t % 7 == 0, 1).otherwise(0)).alias("found"),
    )
    return J.up_to_date(s).select("job", "stage", "fresh", "stale")


@query("latch", f"WITH {JOBS} SELECT job, event_id, max(CASE WHEN value > 300 THEN 1 ELSE 0 END) OVER (PARTITION BY job ORDER BY us, event_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) = 1 AS held FROM jobs")
def latch(spark, sf):
    """On at the first hit, off after two misses in a row."""
    two = Window.partitionBy("job").orderBy("us", "event_id").rowsBetween(-1, 0)
    return jobs(spark, sf).select("job", "event_id", (F.max(F.when(F.col("value") > 300, 1).otherwise(0)).over(two) == 1).alias("held"))


@query("fail_waiting", f"WITH {JOBS} SELECT event_id, status = 'queued' AND coalesce(max(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY job % 10 ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS failed_too FROM jobs")
def fail_waiting(spark, sf):
    """Jobs that wait for a site which has turned an earlier one away: each site's first failure is all they are held against."""
    j = jobs(spark, sf).withColumn("site", F.col("job") % 10).withColumn("seen", F.struct("us", "event_id"))
    first = j.where("status = 'failed'").groupBy("site").agg(F.min("seen").alias("first"))
    late = F.coalesce(F.col("seen") > F.col("first"), F.lit(False))
    return j.join(first, "site", "left").select("event_id", ((F.col("status") == "queued") & late).alias("failed_too"))


@query("spacing_violations", f"WITH {JOBS}, g AS (SELECT event_id, secs - lag(secs) OVER (PARTITION BY job ORDER BY us, event_id) AS gap FROM jobs) SELECT event_id, gap FROM g WHERE gap < 3600")
def spacing_violations(spark, sf):
    gap = F.col("at") - F.lag("at").over(Window.partitionBy("job").orderBy("us", "event_id"))
    return jobs(spark, sf).select("event_id", gap.alias("gap")).where("gap < 3600")


@query("change_only", f"WITH {JOBS}, h AS (SELECT job, event_id, sha256(event_type) AS h, lag(sha256(event_type)) OVER (PARTITION BY job ORDER BY us, event_id) AS p FROM jobs) SELECT job, event_id, h FROM h WHERE h IS DISTINCT FROM p")
def change_only(spark, sf):
    h = F.sha2("event_type", 256)
    j = jobs(spark, sf).withColumn("h", h).withColumn("p", F.lag(h).over(Window.partitionBy("job").orderBy("us", "event_id")))
    return j.where(~F.col("h").eqNullSafe(F.col("p"))).select("job", "event_id", "h")


def limited(spark, sf, seconds: int, most: int):
    """Events numbered inside tumbling windows of a key; those beyond the limit are refused."""
    w = Window.partitionBy("job", F.floor(F.col("at") / seconds)).orderBy("us", "event_id")
    return jobs(spark, sf).select("event_id", (F.row_number().over(w) <= most).alias("accepted"))


@query("rate_limit_minute", f"WITH {JOBS} SELECT event_id, row_number() OVER (PARTITION BY job, secs // 60 ORDER BY us, event_id) <= 30 AS accepted FROM jobs")
def rate_limit_minute(spark, sf):
    return limited(spark, sf, 60, 30)


@query("rate_limit_hour", f"WITH {JOBS} SELECT event_id, row_number() OVER (PARTITION BY job, secs // 604800 ORDER BY us, event_id) <= 10 AS accepted FROM jobs")
def rate_limit_hour(spark, sf):
    """The same with a week for the hour, as events here are hours apart."""
    return limited(spark, sf, 604800, 10)


@query("batch_progress", f"WITH {JOBS} SELECT count(*) FILTER (WHERE status = 'completed') AS done, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status NOT IN ('completed', 'failed')) AS waiting FROM jobs")
def batch_progress(spark, sf):
    s = F.col("status")
    return jobs(spark, sf).agg(F.count_if(s == "completed").alias("done"), F.count_if(s == "failed").alias("failed"), F.count_if(~s.isin("completed", "failed")).alias("waiting"))


@query("failure_groups", f"""WITH {JOBS}, f AS (SELECT job // 3 AS batch, event_id AS job, 'song ' || event_id AS title, CASE WHEN job // 3 % 4 = 0 THEN 'same' ELSE 'reason ' || (event_id % 5) END AS reason FROM jobs WHERE status = 'failed'),
 g AS (SELECT batch, reason, count(*) AS n, min(job) AS since, list(title ORDER BY job) AS titles FROM f GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY n DESC, since) AS place, count(*) OVER (PARTITION BY batch) AS reasons FROM g)
SELECT batch, CASE WHEN any_value(reasons) = 1 THEN 'Couldn''t finish: ' || any_value(array_to_string(titles[1:8], ', ') || CASE WHEN n > 8 THEN ', …' ELSE '' END) || '.' || chr(10) || any_value(reason)
 ELSE 'Couldn''t finish ' || CAST(sum(n) AS BIGINT) || ' songs:' || chr(10) || string_agg(array_to_string(titles[1:4], ', ') || CASE WHEN n > 4 THEN ', …' ELSE '' END || ' — ' || reason, chr(10) ORDER BY place) FILTER (WHERE place <= 3)
 || CASE WHEN max(place) > 3 THEN chr(10) || '…and ' || CAST(sum(n) FILTER (WHERE place > 3) AS BIGINT) || ' more for other reasons.' ELSE '' END END AS report FROM p GROUP BY batch""")
def failure_groups(spark, sf):
    """The report of each batch on its failed songs."""
    f = jobs(spark, sf).where("status = 'failed'")
    batch, i = F.floor(F.col("job") / 3), F.col("event_id")
    return J.failures(f.select(batch.alias("batch"), i.alias("job"), F.concat(F.lit("song "), i.cast("string")).alias("title"), F.when(batch % 4 == 0, "same").otherwise(F.concat(F.lit("reason "), (i % 5).cast("string"))).alias("reason")))


@query("guest_admission", f"WITH {JOBS}, h AS (SELECT event_id, job % 5 AS room, event_id * 31 % 9 AS secret, us * 100000 + event_id % 100000 AS seq, CASE WHEN event_id % 10 = 0 THEN NULL ELSE 'G' || (event_id % 3) END AS name FROM jobs), f AS (SELECT room, secret, min(seq) AS first FROM h WHERE name IS NOT NULL GROUP BY ALL), g AS (SELECT *, row_number() OVER (PARTITION BY room ORDER BY first) AS guest FROM f) SELECT event_id, CASE WHEN name IS NOT NULL AND guest <= 6 THEN guest END AS guest, name IS NOT NULL AND coalesce(guest <= 6, FALSE) AS accepted FROM h LEFT JOIN g USING (room, secret)".replace("us * 100000 + event_id % 100000", "us"))
def guest_admission(spark, sf):
    """Guests who say hello to rooms of six places: known ones come back in, names that clean to nothing do not."""
    i = F.col("event_id")
    name = clean_name(F.when(i % 10 == 0, F.lit(" \t ")).otherwise(F.concat(F.lit("  G"), (i % 3).cast("string"))))
    h = jobs(spark, sf).select("event_id", (F.col("job") % 5).alias("room"), (i * 31 % 9).alias("secret"), F.col("us").alias("seq"), name.alias("name"))
    return J.admitted(h, 6).select("event_id", "guest", "accepted")


@query("room_timers", f"WITH {JOBS}, l AS (SELECT job AS room, secs, lead(secs) OVER (PARTITION BY job ORDER BY secs) AS nx FROM jobs) SELECT room, least(min(CASE WHEN nx IS NULL OR nx - secs > 90000 THEN secs + 90000 END), min(secs) + 604800) AS ends FROM l GROUP BY room")
def room_timers(spark, sf):
    """When rooms end: their host away for 25 hours, or a week old."""
    return J.room_ends(jobs(spark, sf).select(F.col("job").alias("room"), "at"), 90000, 604800)


GUESTS = "guests AS (SELECT DISTINCT party, guest FROM queue)"


@query("guest_queues", f"WITH {LIB}, {QUEUE}, {GUESTS} SELECT g.party, g.guest, count(*) AS entries, count(*) FILTER (WHERE q.guest = g.guest) AS mine, count(*) FILTER (WHERE q.id = q.playing) AS playing, min(q.position) FILTER (WHERE q.id <> q.playing AND q.guest = g.guest) AS next_mine FROM guests g JOIN queue q ON q.party = g.party JOIN lib ON lib.id = q.song_id GROUP BY ALL")
def guest_queues(spark, sf):
    """Each guest's view of the queue, summed up: entries, own ones, what plays, and the first own one that waits."""
    q = queue(spark, sf)
    names = lib(spark, sf).select("id", L.opaque_id(F.col("id"), "salt").alias("pid"), "title")
    v = J.guest_view(q, q.select("party", "guest").distinct(), names)
    return v.groupBy("party", "guest").agg(F.count("*").alias("entries"), F.count_if("mine").alias("mine"), F.count_if("playing").alias("playing"), F.min(F.when(F.col("mine") & ~F.col("playing"), F.col("position"))).alias("next_mine"))


@query("first_waiting", f"WITH {QUEUE} SELECT party, arg_min(id, position) AS id FROM queue WHERE id IS DISTINCT FROM playing GROUP BY party")
def first_waiting(spark, sf):
    return queue(spark, sf).where(~F.col("id").eqNullSafe(F.col("playing"))).groupBy("party").agg(F.min_by("id", "position").alias("id"))


@query("shuffle_queue", f"WITH {QUEUE} SELECT party, id, row_number() OVER (PARTITION BY party ORDER BY id <> playing, md5('7:' || id), id) - 1 AS position FROM queue")
def shuffle_queue(spark, sf):
    """Each party's waiting entries in an order that a seed decides; what plays stays first."""
    key = F.md5(F.concat(F.lit("7:"), F.col("id").cast("string")))
    place = F.row_number().over(Window.partitionBy("party").orderBy(F.col("id") != F.col("playing"), key, "id")) - 1
    return queue(spark, sf).select("party", "id", place.alias("position"))


@query("guest_names", "SELECT c_custkey, row_number() OVER (PARTITION BY c_custkey // 10 ORDER BY lower(c_name), c_custkey) AS place FROM customer")
def guest_names(spark, sf):
    """Guests of each party by folded name."""
    place = F.row_number().over(Window.partitionBy(F.floor(F.col("c_custkey") / 10)).orderBy(F.lower("c_name"), "c_custkey"))
    return table(spark, sf, "customer").select("c_custkey", place.alias("place"))


@query("guest_browse", f"WITH {LIB}, {COLL} SELECT m.collection_id, count(*) AS songs, min(l.title) AS first FROM coll_songs m JOIN lib l ON l.id = m.song_id WHERE contains(lower(l.title) || ' ' || lower(coalesce(l.artist, '')), 'brand#2') GROUP BY 1")
def guest_browse(spark, sf):
    """What guests find in each collection with a word: membership and substring, over the listing they have."""
    songs = L.listing(lib(spark, sf), coll_songs(spark, sf), coll(spark, sf).select("id", F.col("id").cast("string").alias("name")), "salt")
    hits = songs.where(F.contains(F.concat_ws(" ", F.lower("title"), F.lower("artist")), F.lit("brand#2")))
    return hits.select("title", F.explode("collections").alias("c")).groupBy(F.col("c").cast("long").alias("collection_id")).agg(F.count("*").alias("songs"), F.min("title").alias("first"))


@query("listed_collections", f"WITH {COLL} SELECT c.name, row_number() OVER (ORDER BY c.name) AS place FROM coll c WHERE EXISTS (SELECT 1 FROM coll_songs m WHERE m.collection_id = c.id)")
def listed_collections(spark, sf):
    """The names of all collections in the listing, once each and in order."""
    songs = L.listing(lib(spark, sf), coll_songs(spark, sf), coll(spark, sf), "salt")
    return L.ranked(songs.select(F.explode("collections").alias("name")).distinct(), F.col("name")).select("name", "place")


@query("request_correlation", "SELECT q.conv_id, q.turn, a.turn IS NOT NULL AS answered, length(a.text) AS size FROM conversations q LEFT JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' WHERE q.role = 'user'")
def request_correlation(spark, sf):
    c = table(spark, sf, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").cast("long").alias("size"))
    return c.where("role = 'user'").select("conv_id", "turn").join(a, ["conv_id", "turn"], "left").select("conv_id", "turn", F.col("size").isNotNull().alias("answered"), "size")


@query("decode_frames", "SELECT event_id, CASE WHEN event_id % 17 = 0 OR event_id % 13 = 0 OR event_id % 19 = 0 THEN 'rejected' WHEN event_type NOT IN ('click', 'purchase', 'view') THEN 'ignored' ELSE 'accepted' END AS outcome, CASE WHEN event_id % 17 <> 0 AND event_id % 13 <> 0 AND event_id % 19 <> 0 AND event_type IN ('click', 'purchase', 'view') THEN event_id END AS song, CASE WHEN event_id % 17 <> 0 AND event_id % 13 <> 0 AND event_id % 19 <> 0 AND event_type IN ('click', 'purchase', 'view') AND event_id % 3 <> 0 THEN CASE event_id % 3 WHEN 1 THEN 'red' END END AS colour FROM events")
def decode_frames(spark, sf):
    """Frames of one protocol version: other versions and what is no object are rejected, unknown types ignored, values off the list null."""
    i = F.col("event_id")
    frame = F.to_json(F.struct(F.when(i % 13 == 0, 2).otherwise(1).alias("v"), F.col("event_type").alias("t"), i.alias("song"), F.when(i % 3 == 1, "red").when(i % 3 == 2, "plaid").alias("colour")))
    text = F.when(i % 17 == 0, "[1]").when(i % 19 == 0, "{not json").otherwise(frame)
    return table(spark, sf, "events").select("event_id", *decoded(text, ("click", "purchase", "view"), 1))


def decoded(text, types, version):
    """outcome, song and colour of a frame's text."""
    f = F.from_json(text, "v int, t string, song long, colour string")
    whole = text.startswith("{") & f["v"].eqNullSafe(F.lit(version))
    known = whole & f["t"].isin(*types)
    return F.when(~whole, "rejected").when(~known, "ignored").otherwise("accepted").alias("outcome"), F.when(known, f["song"]).alias("song"), F.when(known & f["colour"].isin("red", "blue", "green"), f["colour"]).alias("colour")


FILES = "want AS (SELECT p_brand AS pack, p_partkey AS file, p_size AS bytes, p_partkey % 4 AS version FROM part), have AS (SELECT DISTINCT l_partkey AS file, CASE WHEN l_partkey % 7 = 0 THEN 0 ELSE l_partkey % 4 END AS version FROM lineitem WHERE l_quantity > 49 OR l_linenumber = 7)"


@query("pack_status", f"WITH {FILES} SELECT pack, CAST(sum(bytes) AS BIGINT) AS total, CAST(coalesce(sum(bytes) FILTER (WHERE h.version = w.version), 0) AS BIGINT) AS present, count(*) FILTER (WHERE h.version IS NULL) AS missing, count(*) FILTER (WHERE h.version <> w.version) AS outdated FROM want w LEFT JOIN have h USING (file) GROUP BY pack")
def pack_status(spark, sf):
    """The files that each pack wants against those on disk: bytes there, files missing and outdated."""
    want = table(spark, sf, "part").select(F.col("p_brand").alias("pack"), F.col("p_partkey").alias("file"), F.col("p_size").alias("bytes"), (F.col("p_partkey") % 4).alias("version"))
    k = F.col("l_partkey")
    have = table(spark, sf, "lineitem").where("l_quantity > 49 OR l_linenumber = 7").select(k.alias("file"), F.when(k % 7 == 0, 0).otherwise(k % 4).alias("found")).distinct()
    j, same = want.join(have, "file", "left"), F.col("found") == F.col("version")
    return j.groupBy("pack").agg(F.sum("bytes").alias("total"), F.coalesce(F.sum(F.when(same, F.col("bytes"))), F.lit(0)).alias("present"), F.count_if(F.col("found").isNull()).alias("missing"), F.count_if(~same).alias("outdated"))


@query("export_freshness", f"WITH {LIB} SELECT id, CASE WHEN id % 4 = 0 THEN 'none' WHEN id % 5 = 0 THEN 'none' WHEN id % 3 = 0 OR id % 7 = 0 THEN 'stale' ELSE 'fresh' END AS freshness FROM lib")
def export_freshness(spark, sf):
    """Whether each song's export is there and still says what its map says."""
    i, h = F.col("id"), F.sha2("title", 256)
    recorded = F.when(i % 4 != 0, F.when(i % 3 == 0, F.lit("old")).otherwise(h))
    fresh = F.when(recorded.isNull() | (i % 5 == 0), "none").when((recorded == h) & (i % 7 != 0), "fresh").otherwise("stale")
    return lib(spark, sf).select("id", fresh.alias("freshness"))


@query("job_registry", f"WITH {JOBS}, p AS (SELECT DISTINCT job, job % 4 AS kind FROM jobs), m AS (SELECT job, max(secs) AS seen FROM jobs WHERE job % 4 <> 1 GROUP BY job) SELECT job, CASE kind WHEN 0 THEN NULL WHEN 2 THEN NULL ELSE seen END AS seen, CASE kind WHEN 1 THEN 'missing' WHEN 0 THEN 'unreadable' WHEN 2 THEN 'newer' ELSE 'ok' END AS state FROM p LEFT JOIN m USING (job)")
def job_registry(spark, sf):
    """Pointers to jobs and the manifests they lead to: missing, unreadable and newer ones are said, not dropped."""
    j = jobs(spark, sf)
    k = F.col("job")
    seen = j.groupBy("job").agg(F.max("at").alias("seen")).where(k % 4 != 1)
    text = F.when(k % 4 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.when(k % 4 == 2, 9).otherwise(1).alias("version"), "seen")))
    m = seen.select("job", F.from_json(text, "version int, seen long").alias("m"))
    out = j.select("job").distinct().join(m, "job", "left")
    ok = F.col("m.version") == 1
    return out.select("job", F.when(ok, F.col("m.seen")).alias("seen"), F.when(F.col("m").isNull(), "missing").when(F.col("m.version").isNull(), "unreadable").when(~ok, "newer").otherwise("ok").alias("state"))


STAGE_EVENTS = """ev AS (SELECT job, event_id % 4 AS stage, row_number() OVER (PARTITION BY job, event_id % 4 ORDER BY us, event_id) AS n, ['in_flight', 'complete', 'failed', 'not_applicable'][CAST(event_id * 31 // 4 % 4 AS INTEGER) + 1] AS type,
 'f' || (event_id % 6) AS fp, secs || '|' || (event_id % 90) || '|maps/' || job || ':' || event_id AS made, event_id % 90 AS s, 'broken ' || event_id AS m FROM jobs)"""


@query("stage_states", f"""WITH RECURSIVE {JOBS}, {STAGE_EVENTS}, f AS (
 SELECT job, stage, CAST(0 AS BIGINT) AS n, '' AS status, '' AS fingerprint, CAST(NULL AS BIGINT) AS seconds, CAST(NULL AS VARCHAR) AS error, '' AS output_token FROM ev WHERE ev.n = 1
 UNION ALL SELECT f.job, f.stage, e.n, e.type, CASE WHEN e.type IN ('in_flight', 'not_applicable') THEN e.fp ELSE f.fingerprint END,
  CASE e.type WHEN 'complete' THEN e.s WHEN 'failed' THEN f.seconds END, CASE WHEN e.type = 'failed' THEN e.m END,
  CASE e.type WHEN 'in_flight' THEN '' WHEN 'complete' THEN sha256(f.fingerprint || '|' || e.made) WHEN 'not_applicable' THEN sha256('n/a|' || e.fp) ELSE f.output_token END
 FROM f JOIN ev e ON e.job = f.job AND e.stage = f.stage AND e.n = f.n + 1)
SELECT job, stage, arg_max(status, n) AS status, arg_max(fingerprint, n) AS fingerprint, max({{'n': n, 'v': seconds}}).v AS seconds, max({{'n': n, 'v': error}}).v AS error, arg_max(output_token, n) AS output_token FROM f GROUP BY ALL""")
def stage_states(spark, sf):
    """Where each job's stages stand after their events."""
    i = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, ("in_flight", "complete", "failed", "not_applicable"))), (F.floor(i * 31 / 4) % 4 + 1).cast("int"))
    e = jobs(spark, sf).select(
        "job", (i % 4).alias("stage"), F.struct("us", "event_id").alias("seq"), kind.alias("type"), F.concat(F.lit("f"), (i % 6).cast("string")).alias("fingerprint"), "at", (i % 90).alias("seconds"),
        F.concat(F.lit("maps/"), F.col("job").cast("string"), F.lit(":"), i.cast("string")).alias("artifacts"), F.concat(F.lit("broken "), i.cast("string")).alias("message"),
    )
    return J.stage_states(e)


@query("game_in_front", "SELECT event_id, user_id % 10 = 3 OR (event_id % 4 <> 0 AND event_id % 4 <> 2 AND value >= 10) AS game FROM events")
def game_in_front(spark, sf):
    """Readings of the window in front; process 2 is the engine's own, 0 is none."""
    return table(spark, sf, "events").select("event_id", J.in_front(F.col("user_id") % 10 == 3, F.col("event_id") % 4, F.lit(2), F.col("value"), 10.0).alias("game"))


@query("jobs_list", f"""WITH {JOBS}, r AS (SELECT job, arg_max(status, [rank, us, event_id]) AS status, max(secs) AS updated FROM jobs GROUP BY job)
SELECT 'active' AS part, job, status, NULL AS updated, NULL AS map_path FROM r WHERE status NOT IN ('completed', 'failed')
UNION ALL SELECT 'registry', job, status, updated, CASE WHEN status = 'completed' THEN 'maps/' || job END FROM r""")
def jobs_list(spark, sf):
    """What runs or waits, and all that is registered with its map."""
    last = F.max_by("status", F.struct("rank", "us", "event_id"))
    r = jobs(spark, sf).groupBy("job").agg(last.alias("status"), F.max("at").alias("updated"))
    path = F.when(F.col("status") == "completed", F.concat(F.lit("maps/"), F.col("job").cast("string")))
    active = r.where(~F.col("status").isin("completed", "failed")).select("job", "status")
    return J.jobs_list(active, r.withColumn("map_path", path)).select("part", "job", "status", "updated", "map_path")
