"""Data sources of song files, and stores that publish whole versions or none."""

import json
import os

import pytest
from pyspark.sql import functions as F

from canticle.operators import resolve
from canticle.plans.files import song_folder, song_of
from canticle.sources import levels as L
from canticle.sources import lrc as R
from canticle.sources import songfiles as S

WORD = {"word": "Hi", "start": 1, "end": 2.5, "confidence": 0.9, "anchored": True, "unsung": False}
MAP = {"version": 1, "time_base": "original-song", "duration": 9.0, "words": [WORD, {**WORD, "start": 3.0, "end": 4.0, "line": 2, "word_in_line": 0, "ad_lib": True}], "unsung_spans": []}


def test_files_are_dealt_by_size_and_bad_ones_are_rows(spark, tmp_path):
    S.register(spark)
    (tmp_path / "deep").mkdir()
    for k in range(40):
        (tmp_path / "deep" / f"s{k}.txt").write_text(f"#BPM:300\n: 0 1 0 w{k}\nE\n")
    (tmp_path / "deep" / "utf16.TXT").write_bytes("#TITLE:É\n".encode("utf-16"))
    (tmp_path / "old.txt").write_bytes("#TITLE:Café\n".encode("cp1252"))
    (tmp_path / "empty.txt").write_bytes(b" \n")
    (tmp_path / ".hidden.txt").write_text("no")
    (tmp_path / "a.mp3").write_bytes(b"x")
    os.symlink(str(tmp_path / "nowhere"), str(tmp_path / "gone.txt"))
    read = spark.read.format("ultrastar").option("groupBytes", 200).load(str(tmp_path))
    rows = read.collect()
    by = {}
    for r in rows:
        by.setdefault(os.path.basename(r["path"]), []).append(r)
    assert len(by) == 43 + ("gone.txt" in by) and by["empty.txt"][0]["error"] == "empty file"
    assert by["utf16.TXT"][0]["line"] == "#TITLE:É" and by["old.txt"][0]["line"] == "#TITLE:Café"
    assert [r["line"] for r in sorted(by["s7.txt"], key=lambda r: r["line_no"])] == ["#BPM:300", ": 0 1 0 w7", "E", ""]
    assert 4 < read.rdd.getNumPartitions() < 20
    assert spark.read.format("ultrastar").load(str(tmp_path / "deep")).rdd.getNumPartitions() == 1
    notes = R.note_rows(read.where("error is null").withColumn("relative", F.lit(False)))
    assert notes.where("error is null").count() == 40


def test_timing_maps(spark, tmp_path):
    S.register(spark)
    bad = {
        "base": {**MAP, "time_base": "stretched"}, "word": {**MAP, "words": [{**WORD, "start": "1"}]}, "lacks": {**MAP, "words": [{"word": "x"}]}, "source": {**MAP, "lyric_source": "dreamt"},
        "list": [1], "truth": {**MAP, "words": [{**WORD, "unsung": 0}]}, "spans": {k: v for k, v in MAP.items() if k != "unsung_spans"},
    }
    for name, m in {"good": MAP, "empty": {**MAP, "words": [], "lyric_source": "imported"}, **bad}.items():
        (tmp_path / f"{name}.align.json").write_text(json.dumps(m))
    (tmp_path / "torn.align.json").write_text(json.dumps(MAP)[:50])
    (tmp_path / "other.json").write_text("{}")
    rows = spark.read.format("timingmap").load(str(tmp_path)).collect()
    name = lambda r: os.path.basename(r["path"]).split(".")[0]
    assert {name(r) for r in rows if r["error"]} == {*bad, "torn"}
    good = sorted((r for r in rows if name(r) == "good"), key=lambda r: r["word_idx"])
    assert [(r["word"], r["start"], r["end"], r["line"], r["ad_lib"]) for r in good] == [("Hi", 1.0, 2.5, None, False), ("Hi", 3.0, 4.0, 2, True)]
    (empty,) = (r for r in rows if name(r) == "empty")
    assert (empty["word_idx"], empty["duration"], empty["lyric_source"], empty["error"]) == (None, 9.0, "imported", None)
    assert {name(r): r["error"] for r in rows}["torn"] == "not JSON"


def files(path):
    return sorted(str(p.relative_to(path)) for p in path.rglob("*") if p.is_file() and not p.name.endswith(".crc"))


def test_a_store_publishes_whole_versions(spark, tmp_path):
    store = tmp_path / "store"
    content = lambda **x: {r["key"]: r["content"] for r in S.stored(spark, str(store)).collect()}
    rows = lambda pairs: spark.createDataFrame(pairs, "key string, content string, error string").repartition(3)
    S.publish(rows([("a", "1", None), ("b", "line\nbreak", None), ("c", None, None)]), str(store))
    assert content() == {"a": "1", "b": "line\nbreak", "c": None}
    S.publish(rows([("a", "2", None), ("d", "é", None)]), str(store))
    two = {"a": "2", "b": "line\nbreak", "c": None, "d": "é"}
    assert content() == two
    S.publish(rows([("z", "9", None)]).limit(0), str(store))
    assert content() == two
    S.vacuum(str(store))
    before = files(store)
    for wrong in ([(f"k{k}", "x", None) for k in range(50)] + [("bad", "x", "no words")], [(None, "x", None)]):
        with pytest.raises(Exception):
            S.publish(rows(wrong), str(store))
        assert content() == two
        S.vacuum(str(store))
        assert files(store) == before

    @F.udf("string")
    def fails(x):
        if x == "k49":
            raise RuntimeError("a task dies half-way")
        return x

    with pytest.raises(Exception):
        S.publish(rows([(f"k{k}", "x", None) for k in range(50)]).withColumn("content", fails("key")), str(store))
    assert content() == two
    S.vacuum(str(store))
    assert files(store) == before
    S.publish(rows([("new", "1", None)]), str(store), replace=True)
    assert content() == {"new": "1"}
    previous = spark.read.format("songstore").option("version", "previous").load(str(store))
    assert {r["key"] for r in previous.collect()} == {"a", "b", "c", "d"}


def test_a_reader_sees_one_version(spark, tmp_path):
    """A plan that was made before a publish goes on to read what it was made from."""
    store = str(tmp_path / "store")
    S.publish(spark.createDataFrame([("a", "1")], "key string, content string"), store)
    plan = spark.read.format("songstore").load(store)
    S.publish(spark.createDataFrame([("b", "2")], "key string, content string"), store, replace=True)
    assert {r["key"] for r in spark.read.format("songstore").load(store).collect()} == {"b"}
    assert {r["key"] for r in plan.collect()} in ({"a"}, {"b"})


def test_invalid_maps_are_refused(spark, tmp_path):
    columns = "song_id int, word_idx int, word string, start double, end double, confidence double, unsung boolean, line int, word_in_line int, ad_lib boolean"
    good = [(1, k, f"w{k}", float(k), k + 0.5, 0.5, False, None, None, False) for k in range(5)]
    songs = spark.createDataFrame([(1, 5.0), (2, 5.0)], "song_id int, duration double")
    texts = S.map_texts(spark.createDataFrame([*good, (2, 0, "x", 3.0, 2.0, 0.5, False, None, None, False), (2, 1, "y", 1.0, 9.0, 0.5, False, None, None, False)], columns), songs)
    got = {r["key"]: (json.loads(r["content"]), r["error"]) for r in texts.collect()}
    assert got["1"][1] is None and [w["word"] for w in got["1"][0]["words"]] == [f"w{k}" for k in range(5)] and got["1"][0]["time_base"] == "original-song"
    assert got["2"][1] == "range at word 1; reversed at word 0; unordered at word 1"
    store = str(tmp_path / "store")
    S.publish(texts.where("error is null"), store)
    with pytest.raises(Exception):
        S.publish(texts, store)
    assert [r["key"] for r in S.stored(spark, store).collect()] == ["1"]


NOTES = [
    ("--1", "#BPM:300\n: --1 2 3 x\nE", "line 2: malformed note"), ("²", "#BPM:300\n: ² 2 3 x\nE", "line 2: malformed note"), ("big", "#BPM:300\n: 99999999999999999999 2 3 x\nE", "line 2: malformed note"),
    ("short", "#BPM:300\n: 1 2\nE", "line 2: malformed note"), ("bare", "#BPM:300\n:\n", "line 2: malformed note"), ("minus", "#BPM:300\n: 1 -2 3 x", "line 2: malformed note"), ("header", "#BPM\n: 1 2 3 x", "line 1: header without ':'"),
    ("break", "#BPM:300\n: 1 2 3 x\n- a", "line 3: malformed line break"), ("duet", "#BPM:300\nP1\n: 1 2 3 x", "line 2: duets are not read"), ("what", "#BPM:300\n?\n", "line 2: unrecognized line"), ("none", "#BPM:300\nE", "no notes"),
    ("null", None, "no notes"), ("late", "#BPM:300\n: 1 2 3 x\nE\n???", None), ("plus", "﻿#BPM:300\r\n: +1 2 +3  two  \r\n\r\n- 5\r\n- 6\r\n* 7 8 9 b\r\nE \r\n", None), ("bpm", "#BPM:0\n: 1 2 3 x", "no usable #BPM"),
]


def test_notes_that_mean_nothing_are_error_rows(spark):
    rows = R.read_ultrastar(spark.createDataFrame([x[:2] for x in NOTES], "path string, text string")).collect()
    assert {r["path"]: r["error"] for r in rows} == {p: e for p, _, e in NOTES}
    plus = sorted((r["note_no"], r["kind"], r["beat"], r["length"], r["pitch"], r["syllable"], r["line"]) for r in rows if r["path"] == "plus")
    assert plus == [(0, "normal", 1, 2, 3, " two  ", 0), (1, "golden", 7, 8, 9, "b", 1)]


def test_relative_songs_move_on_at_breaks(spark):
    text = "#BPM:300\n#RELATIVE:yes\n: 0 2 1 a\n- 10 12\n: 0 2 1 b\n- 5\n- 1\n: 2 2 1 c\nE"
    rows = R.read_ultrastar(spark.createDataFrame([("s", text), ("t", text.replace("- 1\n", "-\n"))], "path string, text string")).collect()
    assert sorted((r["beat"], r["line"]) for r in rows if r["path"] == "s") == [(0, 0), (12, 1), (20, 2)]
    assert [r["error"] for r in rows if r["path"] == "t"] == ["line 7: malformed line break"]


def test_levels_are_worked_out_again_only_for_changed_stems(spark, tmp_path):
    stems = tmp_path / "stems"
    stems.mkdir()
    for name, size in (("a.wav", 10), ("b.WAV", 20), ("c.txt", 5)):
        (stems / name).write_bytes(b"x" * size)
    found = L.facts(spark, str(stems))
    assert sorted((x["key"][-5:], x["source_len"]) for x in found.collect()) == [("a.wav", 10), ("b.WAV", 20)]
    store = str(tmp_path / "store")
    keys = {x["key"][-5:]: x["key"] for x in found.collect()}
    samples = lambda own: spark.createDataFrame([(keys[k], j, v) for k, x in own.items() for j, v in enumerate(x)], "key string, j long, v double")
    peaks = lambda rows: {x["key"][-5:]: x["peaks"] for x in rows.collect()}
    # b cannot be decoded: it gets no record and is tried again.
    assert peaks(L.refresh(spark, store, found, samples({"a.wav": [0.1, -0.5, 0.25, 0.0, 1.0]}), 2)) == {"a.wav": [128, 64, 255]}
    again = samples({"a.wav": [9.0], "b.WAV": [0.0, 0.0, 0.0]})
    assert peaks(L.refresh(spark, store, found, again, 2)) == {"a.wav": [128, 64, 255], "b.WAV": [0, 0]}
    # Nothing is stale: nothing is published and nothing read.
    assert L.stale(found.selectExpr("key", "1 AS version", "100 AS bins_per_second", "source_len", "source_mtime_unix"), L.known(spark, store)).count() == 0
    (stems / "a.wav").write_bytes(b"x" * 11)
    changed = L.facts(spark, str(stems))
    assert peaks(L.refresh(spark, store, changed, samples({"a.wav": [2.0], "b.WAV": [7.0]}), 2)) == {"a.wav": [255], "b.WAV": [0, 0]}
    # A record that cannot be read and one of another version count as none.
    S.publish(spark.createDataFrame([(keys["a.wav"], "{broken")], "key string, content string"), store)
    assert set(peaks(L.known(spark, store))) == {"b.WAV"}
    assert peaks(L.refresh(spark, store, changed, samples({"b.WAV": [3.0, 6.0]}), 1, version=2)) == {"b.WAV": [128, 255]}


def test_targets_of_a_report(spark):
    asks = [(1, "jobs/1", True), (2, "jobs/1/job.json", False), (3, "x/S.one.align.json", False), (4, "in/Song.MP3", False), (5, "in/.mp3", False), (6, "jobs/9", True), (7, "jobs/2", True), (8, "in/new.flac", False), (9, "notes.txt", False)]
    jobs = [("jobs/1/job.json", "in/a.b.mp3", "jobs/1/m", 1), ("jobs/2/job.json", "in/Song.MP3", None, 9), ("jobs/3/job.json", "in/Song.MP3", "jobs/3/m", 5), ("jobs/4/job.json", "in/Song.MP3", "jobs/4/m", 5)]
    rows = resolve.targets(spark.createDataFrame(asks, "ask int, path string, is_dir boolean"), spark.createDataFrame(jobs, "path string, audio string, map string, created int"))
    assert sorted(tuple(x) for x in rows.collect()) == [
        (1, "job", "a.b", "jobs/1/m", None), (2, "job", "a.b", "jobs/1/m", None), (3, "map", "S.one", "x/S.one.align.json", None), (4, "audio", "Song", "jobs/4/m", None),
        (5, "none", None, None, "not a job, a timing map or a song"), (6, "job", None, None, "no manifest"), (7, "job", None, None, "not aligned yet"), (8, "audio", None, None, "no job of this song"), (9, "none", None, None, "not a job, a timing map or a song"),
    ]


def test_a_song_folder_is_one_plain_file_a_song(spark):
    """Files are written where they stay, without a folder, a checksum file or a rename for each."""
    texts = spark.createDataFrame([(1, "a\nb"), (999, "é"), (1000, ""), (-7, "x"), (None, "n")], "song_id long, text string")
    folder = song_folder(spark, texts, "plain").removeprefix("file:")
    found = sorted(os.path.join(d, n).removeprefix(folder + "/") for d, _, names in os.walk(folder) for n in names)
    assert found == ["0/song_id=-7.txt", "0/song_id=1.txt", "0/song_id=999.txt", "1/song_id=1000.txt", "none/song_id=none.txt"]
    rows = spark.read.format("ultrastar").load(folder).select(song_of("path").alias("song"), "line_no", "line", "error").collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(1, 1, "a", None), (1, 2, "b", None), (999, 1, "é", None), (1000, None, None, "empty file"), (-7, 1, "x", None), (None, 1, "n", None)], key=str)


def test_a_part_is_read_in_small_batches(spark, tmp_path):
    """What a read holds is bounded by bytes, however many texts a part has."""
    store = str(tmp_path / "store")
    rows = spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.when(F.col("id") != 7, F.repeat(F.lit("é"), 2000)).alias("content"))
    S.publish(rows.coalesce(1), store)
    reader = S.StoreReader({"path": store})
    (part,) = reader.partitions()
    batches = list(reader.read(part))
    assert len(batches) > 3 and max(b.num_rows for b in batches) < 1000 and sum(b.num_rows for b in batches) == 3000
    got = S.stored(spark, store).agg(F.count("*"), F.count("content"), F.sum(F.length("content")), F.max("version")).first()
    assert tuple(got) == (3000, 2999, 2999 * 2000, 1)
