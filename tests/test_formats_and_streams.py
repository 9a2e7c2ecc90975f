from pyspark.sql import functions as F

from canticle.plans.jobs import jobs
from canticle.sources import lrc
from canticle.streaming import twins
from tests.conftest import DATA

WORDS = [
    (1, 0, 0, "Hello", 1.0, 1.5, False, False), (1, 1, 0, "{you}", 1.505, 2.0, False, True), (1, 2, 1, "again", 4.0, 4.2, False, False), (1, 3, 1, "still", 4.1, 4.675, False, False),
    (1, 4, 2, "(ooh)", 5.0, 6.0, False, True), (1, 5, 3, "gone", 7.0, 8.0, True, False), (1, 6, None, "far", 9.0, 9.1, False, False), (1, 7, None, "off", 10.6, 10.6, False, False),
]
COLUMNS = "song_id int, word_idx int, line int, word string, start double, end double, unsung boolean, ad_lib boolean"
SONGS = [(1, "A song", "A band", "a.mp3")]


def songs(spark):
    return spark.createDataFrame(SONGS, "song_id int, title string, artist string, audio string")


def test_lrc_writer(spark):
    text = lrc.write_lrc(spark.createDataFrame(WORDS, COLUMNS), songs(spark)).first()["text"]
    assert text.splitlines() == [
        "[ti:A song]", "[ar:A band]", "", "[00:01.00]<00:01.00>Hello <00:01.50>{you} <00:02.00>", "[00:04.00]<00:04.00>again <00:04.10>still <00:04.68>", "[00:05.00]<00:05.00>(ooh) <00:06.00>",
        "[00:07.00]<00:07.00>gone <00:08.00>", "[00:09.00]<00:09.00>far <00:09.10>", "[00:10.60]<00:10.60>off <00:10.60>",
    ]
    assert lrc.write_lrc(spark.createDataFrame(WORDS, COLUMNS)).first()["text"].startswith("[00:01.00]")


def test_ass_writer(spark):
    text = lrc.write_ass(spark.createDataFrame(WORDS, COLUMNS), songs(spark)).first()["text"]
    events = [x.removeprefix("Dialogue: 0,") for x in text.splitlines() if x.startswith("Dialogue")]
    assert events == [
        r"0:00:00.50,0:00:02.00,Karaoke,,0,0,0,,{\k50}{\k50}Hello {\k50\i1}\{you\}{\i0}",
        r"0:00:03.50,0:00:04.68,Karaoke,,0,0,0,,{\k50}{\k10}again {\k58}still",
        r"0:00:04.68,0:00:06.00,AdLib,,0,0,0,,{\k32}{\k100}(ooh)",
        r"0:00:08.50,0:00:09.10,Karaoke,,0,0,0,,{\k50}{\k10}far",
    ]
    assert "Title: A song" in text and "; Artist: A band" in text


def test_ultrastar_writer_and_reader(spark):
    w = spark.createDataFrame(WORDS, COLUMNS)
    text = lrc.write_ultrastar(w, songs(spark)).first()["text"]
    assert text.splitlines() == [
        "#TITLE:A song", "#ARTIST:A band", "#MP3:a.mp3", "#LANGUAGE:English", "#BPM:300", "#GAP:1000", ": 0 10 0 Hello ", "F 10 10 0 {you}", "- 60", ": 60 4 0 again ", ": 64 10 0 still", "- 80", "F 80 20 0 (ooh)",
        "- 120", "F 120 20 0 gone", "- 160", ": 160 2 0 far", "- 192", ": 192 1 0 off", "E",
    ]
    back = lrc.merge_syllables(lrc.read_ultrastar(spark.createDataFrame([("1", text)], "path string, text string"))).orderBy("word_idx").collect()
    assert [r["word"] for r in back] == [x[3] for x in WORDS]
    assert [r["unsung"] for r in back] == [x[6] or x[7] for x in WORDS]
    assert all(abs(r["start"] - x[4]) <= 0.051 for r, x in zip(back, WORDS, strict=True) if x[3] != "still")


def test_beats_are_the_recurrence(spark):
    import random

    r = random.Random(3)
    at, rows = 0.0, []
    for k in range(300):
        at += r.choice([0.0, 0.01, 0.025, 0.075, 0.4])
        rows.append((k % 3, k, r.randrange(3), "w", at, at + r.choice([0.0, 0.05, 0.125, 1.0]), False, False))
    got = {(b["song_id"], b["word_idx"]): (b["beat"], b["length"]) for b in lrc.beats(spark.createDataFrame(rows, COLUMNS)).collect()}
    even = lambda n: n // 50 + (2 * (n % 50) > 50 or 2 * (n % 50) == 50 and n // 50 % 2)
    for song in range(3):
        mine, busy = [x for x in rows if x[0] == song], 0
        gap = round(mine[0][4] * 1000)
        for x in mine:
            start = max(even(round(x[4] * 1000) - gap), busy)
            size = max(1, even(round(x[5] * 1000) - gap) - start)
            assert got[song, x[1]] == (start, size)
            busy = start + size


def test_readers_from_a_folder(spark, tmp_path):
    """Files reach the readers through Spark's own source, whatever their encoding."""
    from canticle.sources import folders

    (tmp_path / "a.txt").write_bytes("#TITLE:É\n#BPM:300\n: 0 1 0 a\nE".encode("cp1252"))
    (tmp_path / "a.mp3").write_bytes(b"x")
    (tmp_path / ".b.txt").write_text("hidden")
    found = folders.scan(folders.files(spark, str(tmp_path)), "file:" + str(tmp_path))
    lyrics = folders.inspect(found.where("kind = 'lyrics'"))
    out = folders.songs(found.where("kind = 'audio'"), lyrics, spark.createDataFrame([], "path string, title string, artist string")).collect()
    assert [(r["kind"], r["title"]) for r in out] == [("ultrastar", "É")]


def test_cleanup_columns_agree_with_the_kernel(spark):
    """Line by line, what the columns call a line is what the kernel takes it for."""
    import random

    from canticle.operators import cleanup as C

    r = random.Random(2)
    bits = ["[", "]", "(", ")", "{", "}", "Chorus", "verse", "2", "II", "x2", "3x", "×4", "x1", ":", " - ", "Ann", "la la", "pre chorus", "Pre-Chorus", " ", "Written by ", "12", "Contributors", "embed", "break"]
    texts = ["".join(r.choice(bits) + r.choice(["", " "]) for _ in range(r.randrange(1, 6))) for _ in range(3000)] + ["", "(x2)", "[Chorus]", "[Chorus (x2)]", "Chorus: x2", "{[x2]}"]
    got = [x["k"] for x in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", C.line_kind(F.col("t")).alias("k")).orderBy("i").collect()]
    want = ["blank" if not t.strip() else "header" if C.header_of(t) else "repeat" if C.count_of(t) else "credit" if C.credit(t) else "text" for t in texts]
    wrong = [(t, g, w) for t, g, w in zip(texts, got, want, strict=True) if g != w]
    assert not wrong, wrong[:5]


def stream(spark, tmp_path, frame):
    frame.write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))


def test_job_stream_equals_its_batch_twin(spark, tmp_path):
    j = jobs(spark, DATA).select("job", "rank", "us", "event_id", "status")
    s = twins.reduced_jobs(stream(spark, tmp_path, j))
    q = s.writeStream.format("memory").queryName("reduced").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = {(r["job"], r["status"]) for r in spark.table("reduced").groupBy("job").agg(F.max_by("status", "events").alias("status")).collect()}
    want = {(r["job"], r["status"]) for r in j.groupBy("job").agg(F.max_by("status", F.struct("rank", "us", "event_id")).alias("status")).collect()}
    assert got == want


def test_play_mark_stream_equals_its_batch_twin(spark, tmp_path):
    """Two files in event order, one a trigger: state carries over from one to the next."""
    from canticle.operators import alignment as A

    plays = jobs(spark, DATA).select(F.col("job").alias("party"), "event_id", "us", (F.col("event_id") * 31 % 13).alias("entry"))
    middle = plays.agg(F.percentile("us", F.lit(0.5))).first()[0]
    for early in (True, False):
        plays.where((F.col("us") < middle) == early).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(plays.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = twins.play_marks(s).writeStream.format("memory").queryName("marks").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = {(r["event_id"], r["accepted"], r["gone"]) for r in spark.table("marks").collect()}
    want = {(r["event_id"], r["accepted"], r["left"]) for r in A.play_marks(plays.withColumn("seq", F.struct("us", "event_id"))).collect()}
    assert got == want and len(q.recentProgress) >= 2


def in_two_files(frame, at, path):
    """A stream of two triggers: rows up to the middle of a column, then the others."""
    middle = frame.agg(F.percentile(at, F.lit(0.5))).first()[0]
    for early in (True, False):
        frame.where((F.col(at) < middle) == early).coalesce(1).write.mode("append").parquet(path)
    return frame.sparkSession.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)


def collected(stream, tmp_path, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
    assert q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_latch_stream_equals_its_batch_query(spark, tmp_path):
    from canticle.plans.jobs import latch

    e = jobs(spark, DATA).select("job", "event_id", "us", (F.col("value") > 300).alias("hit"))
    got = collected(twins.latched(in_two_files(e, "us", str(tmp_path / "in"))), tmp_path, "latched", "append")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, latch(spark, DATA).collect()))


def test_minute_count_stream(spark, tmp_path):
    """A window is told once the watermark has passed it; what comes in a trigger after that is left out."""
    rows = [(k % 2, f"2024-01-01 00:00:{k:02d}") for k in range(10)] + [(0, "2024-01-01 00:01:30"), (1, "2024-01-01 03:00:00")]
    more = [(1, "2024-01-01 03:00:10"), (1, "2024-01-01 09:00:00")]
    for part in (rows, more, [(0, "2024-01-01 00:00:59"), (0, "2024-01-01 20:00:00")]):
        spark.createDataFrame(part, "job long, at string").select("job", F.to_timestamp("at").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("job long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = collected(twins.minute_counts(s, limit=3), tmp_path, "minutes", "append").select("job", F.date_format("minute", "HH:mm").alias("m"), "n", "refused").collect()
    assert sorted(map(tuple, got)) == [(0, "00:00", 5, 2), (0, "00:01", 1, 0), (1, "00:00", 5, 2), (1, "03:00", 2, 0), (1, "09:00", 1, 0)]


def test_lifecycle_stream_follows_a_snapshot(spark, tmp_path):
    from canticle.operators import jobs as J

    first = [(1, 0, "seed:running"), (2, 0, "seed:queued"), (3, 1, "enqueue"), (3, 2, "take")]
    later = [(1, 3, "finish"), (1, 4, "cancel"), (2, 3, "take"), (2, 4, "fail"), (2, 5, "retry")]
    for part in (first, later):
        spark.createDataFrame(part, "job long, seq int, command string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("job long, seq int, command string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = collected(J.lifecycle_stream(s), tmp_path, "lifecycles", "update").collect()
    told = {(r["job"], r["state"], r["refused"]) for r in got}
    assert told == {(1, "running", 0), (2, "queued", 0), (3, "running", 0), (1, "completed", 1), (2, "queued", 0)} and len(got) == 5
    batch = spark.createDataFrame([(3, 1, "enqueue"), (3, 2, "take"), (4, 1, "take")], "job long, seq int, command string")
    assert {tuple(r) for r in J.lifecycles(batch).collect()} == {(3, "running", 0), (4, None, 1)}


def test_room_views_are_told_by_trigger(spark, tmp_path):
    schema = "party long, version int, guest long, id long, position int, song_id long, playing long"
    one = [(1, 1, 7, 10, 0, 100, 10), (1, 2, 7, 10, 0, 100, 10), (1, 2, 8, 11, 1, 101, 10), (2, 1, 9, 12, 0, 999, 12)]
    two = [(1, 3, 8, 11, 0, 101, 11)]
    for part in (one, two):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    guests = spark.createDataFrame([(1, 7), (1, 8), (2, 9)], "party long, guest long")
    listing = spark.createDataFrame([(100, "sa", "A"), (101, "sb", "B")], "id long, pid string, title string")
    q = twins.fan_out(s, guests, listing, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and q.exception() is None
    got = spark.read.parquet(str(tmp_path / "out")).select("trigger", "guest", "version", "id", "title", "playing", "mine").collect()
    assert sorted(map(tuple, got)) == [
        (0, 7, 2, 10, "A", True, True), (0, 7, 2, 11, "B", False, False), (0, 8, 2, 10, "A", True, False), (0, 8, 2, 11, "B", False, True), (1, 7, 3, 11, "B", True, False), (1, 8, 3, 11, "B", True, True),
    ]
