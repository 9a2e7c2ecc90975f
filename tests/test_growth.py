"""What must not grow with the tables: broadcasts, batches, listings, groups."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from canticle.operators import cleanup as C
from canticle.operators import kernels as K
from canticle.operators import matching as M
from canticle.operators import resolve as R
from canticle.plans import formats
from canticle.shipping import ship
from canticle.sources import folders as D
from canticle.sources import lrc as L
from canticle.sources import songfiles as S
from canticle.storage import Scratch
from tests.conftest import DATA


def test_annotate_broadcasts_no_exploded_words(spark):
    ship(spark)
    docs = spark.createDataFrame([(1, "la la\nlo"), (2, "one two"), (3, ""), (4, None)], "song long, text string")
    timed = spark.createDataFrame([(1, 3), (2, 1), (5, 2)], "song long, n int").select("song", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("word_idx"), F.lit(0.5).alias("start"))
    out = C.annotate(C.clean(docs).select("song", "words"), timed)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("MapInArrow") == 1
    assert out.columns == ["song", "word_idx", "start", "line", "place", "word", "adlib", "error"]
    got = sorted((r.song, -1 if r.word_idx is None else r.word_idx, r.word, r.error) for r in out.collect())
    assert got == [(1, 0, "la", None), (1, 1, "la", None), (1, 2, "lo", None), (2, -1, None, "1 timed words, 2 cleaned ones"), (5, -1, None, "2 timed words, 0 cleaned ones")]


def test_cleaned_batches_are_small(spark):
    """A batch of Arrow's size goes out in pieces, with the same rows in the same order."""
    texts = ["sing it (x8)\n" * 10_000, None, "", "Written by A\nla", "o " * 400_000] * 4
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["_id", "_text"])
    got = list(C.cleaned_batches(iter([batch])))
    assert len(got) >= 4 and max(sum(len(x) for x in b.column("text").to_pylist()) for b in got) < 3 * C.BATCH_CHARS
    assert [i for b in got for i in b.column("_id").to_pylist()] == list(range(len(texts)))
    assert got[0].column("words").to_pylist()[0][1] == {"line": 0, "place": 1, "word": "it", "adlib": False}


def test_listing_leaves_no_names_with_the_driver(spark, tmp_path):
    """Tasks list the folders a level at a time and open the lyric files; Spark's own index of files stays out."""
    for name in ("a/One.mp3", "a/One.txt", "b/c/d/Two é.LRC", "b/.hid/x.txt", "b/_aside/y.txt", "b/k=v/_z=1.txt", "top.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    root = str(tmp_path)
    found = D.listed(spark, root)
    want = {r.path.removeprefix("file:"): r.length for r in D.files(spark, root).collect()}
    assert {r.path: r.length for r in found.collect()} == want and len(want) == 5
    assert not [f for f in found.inputFiles() if f.endswith((".txt", ".mp3"))]
    texts = D.with_contents(spark, root, D.scan(found, root).where("kind = 'lyrics'"))
    assert {r.path.removeprefix(root + "/"): bytes(r.content).decode() for r in texts.collect()} == {n: n for n in ("a/One.txt", "b/c/d/Two é.LRC", "b/k=v/_z=1.txt", "top.txt")}
    assert not [f for f in texts.inputFiles() if f.endswith(".txt")]


def test_equal_asks_are_answered_once(spark, monkeypatch):
    """Songs that ask the same cost one ask, with a duration, without one and in a look-up; each song has its row."""
    songs = spark.range(40).select(F.col("id").alias("song"), F.lit("La La").alias("title"), F.lit("Ann").alias("artist"), F.when(F.col("id") % 2 == 0, 100.0).alias("duration"))
    records = spark.range(30).select(F.col("id").alias("record"), F.lit("La La (Live at Home)").alias("track"), F.lit("Ann").alias("band"), F.lit("Album").alias("album"), (F.col("id") + 95.0).alias("length"), F.lit(3).alias("lines"), (F.col("id") > 6).alias("synced"))
    sizes, answered = [], M.answered
    monkeypatch.setattr(M, "answered", lambda s, answers, *by: sizes.append(answers.count()) or answered(s, answers, *by))
    best = {r.song: r.record for r in M.best_records(songs, records).collect()}
    assert best == {k: 7 if k % 2 == 0 else 0 for k in range(40)}
    assert M.look_up(songs, records).count() == 40
    assert max(sizes) <= 4  # two keys of two asks


def test_pairs_aligned_together_are_as_alone(monkeypatch):
    """Whatever the sizes, empty and long words: the same pairs as one by one; a walk takes many pairs and bounded cells."""
    rng, walks = random.Random(5), []
    vocabulary = ["", "a", "ab", "x" * 33, "x" * 40 + "y", "é", "straße", "😀a", "cat", "cart"] + ["".join(rng.choices("abc", k=rng.randint(1, 9))) for _ in range(60)]
    some = lambda r: [rng.choice(vocabulary) for _ in range(rng.randint(0, r))]
    pairs = [(some(r), some(r)) for r in (1, 2, 3, 8, 30, 70) for _ in range(40)]
    together = K.align_together
    monkeypatch.setattr(K, "align_together", lambda m: walks.append(len(m)) or together(m))
    want = [K.align(*p) for p in pairs]
    assert K.align_all(pairs) == want and len(walks) < 40 and max(walks) > 20
    monkeypatch.setattr(K, "TOGETHER", 500)
    assert K.align_all(pairs) == want
    assert K.align_all([]) == [] and K.align_all([([], ["a"])]) == [[]]


def test_asks_without_a_key_are_not_dealt_to_one_task(spark):
    """Asks by id have no folder, asks by map no id, and most of both no file: none of the joins gathers them under null."""
    asks = spark.range(400).select(F.col("id").alias("ask"), F.when(F.col("id") == 3, 3).cast("long").alias("song_id"), F.when(F.col("id") == 5, "jobs/5/map.json").alias("map_path"))
    files = lambda n: [F.concat(F.lit(f"{n}/{r}/"), F.col("id").cast("string")).alias(r) for r in R.ROLES]
    songs, manifests = spark.range(9).select("id", *files("s")), spark.range(9).select(F.concat(F.lit("jobs/"), F.col("id").cast("string")).alias("folder"), F.concat(F.lit("jobs/"), F.col("id").cast("string"), F.lit("/map.json")).alias("map"), *files("m"))
    have = spark.createDataFrame([("s/vocals/3",), ("m/original/5",), (None,)], "path string")
    out = R.playable(asks, songs, manifests, have)
    got = {r.ask: tuple(r)[1:] for r in out.collect()}
    assert len(got) == 400 and got[3] == ("ok", None, "s/vocals/3", None) and got[5] == ("ok", None, None, "m/original/5") and got[4] == ("nothing", None, None, None)
    keys = asks.select(R.spread(F.col("song_id"), F.col("ask")).alias("k"))
    assert keys.distinct().count() == 400 and keys.where("k = '3'").count() == 1 and keys.where("k = '5'").count() == 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = R.playable(asks, songs, manifests, have)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert all(f"({k}#" in plan for k in ("_id", "_folder", "_path")) and "(song_id#" not in plan.split("LeftOuter, ", 1)[1].split("\n")[0]


def test_self_check_works_words_and_texts_out_once(spark):
    """Its plan reads them where they were written; the events are in no branch of it."""
    out = formats.self_check(spark, DATA)
    assert out.count() > 0 and not [f for f in out.inputFiles() if "events" in f]


def plans_of(query, spark, monkeypatch) -> list[str]:
    """The plans of a query and of all tables that it writes on its way."""
    plan, written, plans = lambda df: df._jdf.queryExecution().executedPlan().toString(), Scratch.table, []
    monkeypatch.setattr(Scratch, "table", lambda self, df, name: plans.append(plan(df)) or written(self, df, name))
    plans.append(plan(query(spark, DATA)))
    return plans


def test_titles_broadcast_no_songs(spark, monkeypatch):
    """Songs' headers, lines and notes meet by shuffle; the one row that a collection's name needs is all that is broadcast."""
    plans = plans_of(formats.title_precedence, spark, monkeypatch)
    assert len(plans) > 10 and sum(p.count("BroadcastExchange") for p in plans) == 1 and "flat" in next(p for p in plans if "BroadcastExchange" in p)
    texts = spark.createDataFrame([("a", "#TITLE:x\n#BPM:300\n: 0 1 0 la\nE"), ("b", "#TITLE:y\nwhat")], "path string, text string")
    notes = L.read_ultrastar(texts)
    assert "Broadcast" not in notes._jdf.queryExecution().executedPlan().toString()
    assert {(r.path, r.syllable, r.error) for r in notes.collect()} == {("a", "la", None), ("b", None, "line 2: unrecognized line")}


def test_inspected_files_are_written_by_many_tasks(spark, monkeypatch):
    """Suppliers come in one file, which is one task; their songs are written by several, and none is broadcast."""
    tasks, write = [], S.write_files
    monkeypatch.setattr(S, "write_files", lambda rows, folder: tasks.append(rows.rdd.getNumPartitions()) or write(rows, folder))
    plans = plans_of(formats.inspect_files, spark, monkeypatch)
    assert min(tasks) > 1 and len(plans) > 8 and not any("Broadcast" in p for p in plans)


def test_pairs_broadcast_no_files(spark, monkeypatch):
    """Neither the lyric files that are read nor the pairs and the files that are left over."""
    plans = plans_of(formats.pair_folder, spark, monkeypatch)
    assert len(plans) > 10 and not any("Broadcast" in p for p in plans)
