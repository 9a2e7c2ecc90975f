"""Song files and song stores as Spark data sources.

    spark.read.format("ultrastar").load(folder)    lines of UltraStar texts; "lrc" likewise
    spark.read.format("timingmap").load(folder)    one row a word of timing maps in JSON
    df.write.format("songstore").mode(...).save(folder), spark.read.format("songstore").load(folder)

Folders are listed once, and files are dealt to partitions by size.  A file that cannot be read is a row
with its error.  A store keeps texts (maps, manifests, sidecars, reports) by key, in versions: tasks
write parts aside, and one small file that names a version's parts makes it the version that is read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from canticle.shipping import ship

if TYPE_CHECKING:
    import pyarrow as pa

#: Bytes of files in a partition, and of the largest file that is read.
GROUP_BYTES, MOST_BYTES = 8 << 20, 64 << 20
#: Bytes of a store's texts that are read in one batch.
BATCH_BYTES = 4 << 20
# The version and the only time base of a timing map.
MAP_VERSION, TIME_BASE = 1, "original-song"
# Where the words of a map may come from.
LYRIC_SOURCES = ("pasted", "transcribed", "imported")


def opened(path: str):
    """The file system of a path (local, HDFS, object stores) and the path on it."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file:///"):
        path = "file:///" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


@dataclass
class Files(InputPartition):
    names: tuple[tuple[str, int], ...]


class FolderReader(DataSourceReader):
    """Files under a folder, hidden ones and folders left out, in groups of about GROUP_BYTES."""

    def __init__(self, options, suffixes: tuple[str, ...], rows):
        self.root, self.rows = options["path"], rows
        self.suffixes = tuple(options["suffix"].split(",")) if "suffix" in options else suffixes
        self.group = int(options.get("groupbytes", GROUP_BYTES))

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, root = opened(self.root)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        inside = lambda p: p[len(root) :].split("/")
        files = sorted((f.path, f.size) for f in found if f.is_file and f.path.lower().endswith(self.suffixes) and not any(x[:1] in (".", "_") for x in inside(f.path) if x))
        out, held, size = [], [], 0
        for name, n in files:
            if held and size + n > self.group:
                out.append(Files(tuple(held)))
                held, size = [], 0
            held.append((name, n))
            size += n
        return [*out, Files(tuple(held))] if held or not out else out

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = opened(self.root)
        for name, size in partition.names:
            if size > MOST_BYTES:
                yield from self.rows(name, None, f"larger than {MOST_BYTES} bytes")
                continue
            try:
                with system.open_input_stream(name) as f:
                    content = f.read()
            except OSError as e:
                yield from self.rows(name, None, f"cannot be opened: {type(e).__name__}")
                continue
            yield from self.rows(name, decoded(content), None)


def decoded(content: bytes) -> str:
    """A text as it arrives: UTF-8 with or without a mark, UTF-16 with one, else the old Windows code page."""
    if content[:3] == b"\xef\xbb\xbf":
        return content[3:].decode("utf-8", "replace")
    if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return content[: len(content) // 2 * 2].decode("utf-16", "replace")
    try:
        return content.decode()
    except UnicodeDecodeError:
        return content.decode("cp1252", "replace")


def line_rows(path: str, text: str | None, error: str | None) -> Iterator[tuple]:
    if error is not None or not text or not text.strip():
        yield path, None, None, error or "empty file"
        return
    for k, line in enumerate(text.split("\n"), 1):
        yield path, k, line.removesuffix("\r"), None


class Lines(DataSource):
    SUFFIXES: tuple[str, ...] = ()

    def schema(self) -> str:
        return "path string, line_no int, line string, error string"

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options, self.SUFFIXES, line_rows)


class UltraStar(Lines):
    SUFFIXES = (".txt",)

    @classmethod
    def name(cls) -> str:
        return "ultrastar"


class Lrc(Lines):
    SUFFIXES = (".lrc",)

    @classmethod
    def name(cls) -> str:
        return "lrc"


WORD = (("word", str), ("start", float), ("end", float), ("confidence", float), ("anchored", bool), ("unsung", bool), ("line", int), ("word_in_line", int), ("ad_lib", bool))
OPTIONAL = {"line": None, "word_in_line": None, "ad_lib": False}


def field(word: dict, name: str, kind: type):
    """A word's field of the kind it has to be; whole numbers are numbers too."""
    value = word[name] if name not in OPTIONAL else word.get(name, OPTIONAL[name])
    if kind is float and isinstance(value, int) and not isinstance(value, bool):
        value = float(value)
    if value is None and name in ("line", "word_in_line"):
        return None
    if type(value) is not kind:
        raise ValueError(f"word field {name} is no {kind.__name__}")
    return value


def map_rows(path: str, text: str | None, error: str | None) -> Iterator[tuple]:
    """One row a word; a map without words is a row without one, a bad map a row with its error."""
    try:
        if error is not None:
            raise ValueError(error)
        m = json.loads(text)
        if not isinstance(m, dict) or m.get("time_base") != TIME_BASE:
            raise ValueError(f"time base is not '{TIME_BASE}'")
        source = m.get("lyric_source")
        if source is not None and source not in LYRIC_SOURCES:
            raise ValueError("unknown lyric source")
        if not isinstance(m["unsung_spans"], list):
            raise ValueError("unsung spans are no list")
        head = (path, int(m["version"]), float(m["duration"]), source)
        words = [(k, *(field(w, n, kind) for n, kind in WORD), None) for k, w in enumerate(m["words"])]
    except (ValueError, KeyError, TypeError) as e:
        reason = f"no {e.args[0]}" if isinstance(e, KeyError) else "not JSON" if isinstance(e, json.JSONDecodeError) else str(e)
        yield path, None, None, None, None, *[None] * len(WORD), reason
        return
    for w in words or [(None, *[None] * len(WORD), None)]:
        yield *head, *w


class TimingMaps(DataSource):
    @classmethod
    def name(cls) -> str:
        return "timingmap"

    def schema(self) -> str:
        kinds = {str: "string", float: "double", bool: "boolean", int: "int"}
        return "path string, version int, duration double, lyric_source string, word_idx int, " + ", ".join(f"`{n}` {kinds[k]}" for n, k in WORD) + ", error string"

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options, (".align.json",), map_rows)


# Stores


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int


@dataclass
class StorePart(InputPartition):
    name: str
    version: int


CURRENT = "CURRENT.json"


def current(system, root: str) -> dict:
    """The version that is read: its number and parts; number 0 where nothing was ever published."""
    try:
        with system.open_input_stream(f"{root}/{CURRENT}") as f:
            return json.loads(f.read())
    except FileNotFoundError:
        return {"version": 0, "parts": []}


class StoreWriter(DataSourceWriter):
    """Rows (key, content, error): a row with an error is refused, and with it the whole version."""

    def __init__(self, options, schema, overwrite: bool):
        self.root, self.overwrite = options["path"], overwrite
        self.names = schema.names
        missing = {"key", "content"} - set(self.names)
        if missing:
            raise ValueError(f"a song store takes key and content; {sorted(missing)} is missing")
        self.aside = f"parts/{uuid.uuid4().hex}"

    def write(self, iterator) -> Part:
        system, root = opened(self.root)
        task = TaskContext.get()
        name = f"{self.aside}/{task.partitionId():06d}-{task.attemptNumber()}.jsonl"
        system.create_dir(f"{root}/{self.aside}")
        key, content = self.names.index("key"), self.names.index("content")
        wrong, n = self.names.index("error") if "error" in self.names else None, 0
        with system.open_output_stream(f"{root}/{name}") as f:
            for row in iterator:
                if wrong is not None and row[wrong] is not None:
                    raise ValueError(f"{row[key]} is refused: {row[wrong]}")
                if row[key] is None:
                    raise ValueError("a row without a key is refused")
                f.write(json.dumps([row[key], row[content]]).encode() + b"\n")
                n += 1
        return Part(name, n)

    def commit(self, messages: list[Part | None]) -> None:
        """One small file is written aside and renamed: before it the old version is read, after it the new one."""
        system, root = opened(self.root)
        old = current(system, root)
        version = old["version"] + 1
        own = [[m.name, version, m.rows] for m in messages if m is not None and m.rows]
        parts = own if self.overwrite else [*old["parts"], *own]
        system.create_dir(root)
        aside = f"{root}/.{CURRENT}.{uuid.uuid4().hex}"
        if old["version"]:
            system.copy_file(f"{root}/{CURRENT}", f"{root}/{CURRENT}.bak")
        with system.open_output_stream(aside) as f:
            f.write(json.dumps({"version": version, "parts": parts}).encode())
        system.move(aside, f"{root}/{CURRENT}")

    def abort(self, messages: list[Part | None]) -> None:
        """Deletes what was written aside; a task that still runs may leave a part that no version lists, for vacuum."""
        system, root = opened(self.root)
        try:
            system.delete_dir(f"{root}/{self.aside}")
        except FileNotFoundError:
            pass


class StoreReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.name = options["path"], CURRENT + (".bak" if options.get("version") == "previous" else "")

    def partitions(self) -> list[StorePart]:
        system, root = opened(self.root)
        if self.name == CURRENT:
            now = current(system, root)
        else:
            with system.open_input_stream(f"{root}/{self.name}") as f:
                now = json.loads(f.read())
        return [StorePart(name, version) for name, version, _ in now["parts"]] or [StorePart("", 0)]

    def read(self, partition: StorePart) -> Iterator[pa.RecordBatch]:
        """Arrow batches of about BATCH_BYTES, so that what a task holds does not grow with the rows of a part."""
        import pyarrow as pa

        if not partition.name:
            return

        def batch(rows: list) -> pa.RecordBatch:
            keys, contents = zip(*rows)
            return pa.record_batch([pa.array(keys, pa.string()), pa.array(contents, pa.string()), pa.array([partition.version] * len(rows), pa.int32())], names=["key", "content", "version"])

        system, root = opened(self.root)
        with system.open_input_stream(f"{root}/{partition.name}") as f:
            rest, rows, held = b"", [], 0
            while block := f.read(1 << 20):
                *lines, rest = (rest + block).split(b"\n")
                for line in lines:
                    rows.append(json.loads(line))
                    held += len(line)
                    if held >= BATCH_BYTES:
                        yield batch(rows)
                        rows, held = [], 0
            if rows:
                yield batch(rows)


class SongStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "songstore"

    def schema(self) -> str:
        return "key string, content string, version int"

    def reader(self, schema) -> StoreReader:
        return StoreReader(self.options)

    def writer(self, schema, overwrite: bool) -> StoreWriter:
        return StoreWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session."""
    ship(spark)
    for source in (UltraStar, Lrc, TimingMaps, SongStore):
        spark.dataSource.register(source)


def publish(rows: DataFrame, folder: str, replace: bool = False) -> None:
    """Publishes rows (key, content and perhaps error) as the next version: beside what is there, or in place of all of it."""
    register(rows.sparkSession)
    rows.write.format("songstore").mode("overwrite" if replace else "append").save(folder)


def vacuum(folder: str) -> None:
    """Deletes parts that neither the current version nor the one before lists; to be run while nobody publishes."""
    from pyarrow import fs

    system, root = opened(folder)
    listed = {name.split("/")[1] for name, *_ in current(system, root)["parts"]}
    if system.get_file_info(f"{root}/{CURRENT}.bak").is_file:
        with system.open_input_stream(f"{root}/{CURRENT}.bak") as f:
            listed |= {name.split("/")[1] for name, *_ in json.loads(f.read())["parts"]}
    for f in system.get_file_info(fs.FileSelector(f"{root}/parts", allow_not_found=True)):
        if f.base_name not in listed:
            system.delete_dir(f.path)


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """key, content and version of what a store holds now: of each key the last that was published."""
    register(spark)
    rows = spark.read.format("songstore").load(folder)
    return rows.groupBy("key").agg(F.max_by("content", F.struct("version", "content")).alias("content"), F.max("version").alias("version"))


def write_files(rows: DataFrame, folder: str) -> None:
    """Writes rows (path below the folder, content) as files, each whole, from the tasks that have them."""
    ship(rows.sparkSession)

    def run(batches):
        system, root = opened(folder)
        made = set()
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                name = f"{root}/{path}"
                above = name.rsplit("/", 1)[0]
                if above not in made:
                    system.create_dir(above)
                    made.add(above)
                with system.open_output_stream(name) as f:
                    f.write(content or b"")
        yield from ()

    rows.select("path", "content").mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()


# What goes into a store


def map_texts(words: DataFrame, songs: DataFrame) -> DataFrame:
    """key, content and error: the timing map of each song in JSON, and what is wrong with it.

    words: song_id, word_idx, word, start, end, confidence, unsung, line, word_in_line, ad_lib; songs: song_id, duration.
    """
    from canticle.operators.words import violations

    row = F.struct("word", "start", "end", "confidence", F.lit(False).alias("anchored"), "unsung", "line", "word_in_line", "ad_lib")
    per = words.groupBy("song_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", row.alias("w")))), lambda x: x["w"]).alias("words"))
    spans = words.sparkSession.createDataFrame([], f"song_id {words.schema['song_id'].dataType.simpleString()}, span int, first int, last int")
    found = violations(words.join(songs, "song_id"), spans).select("song_id", F.concat_ws(" at word ", "rule", F.col("at").cast("string")).alias("wrong"))
    wrong = found.groupBy("song_id").agg(F.array_join(F.slice(F.array_sort(F.collect_list("wrong")), 1, 20), "; ").alias("error"))
    m = per.join(songs, "song_id").join(wrong, "song_id", "left")
    whole = F.struct(F.lit(MAP_VERSION).alias("version"), F.lit(TIME_BASE).alias("time_base"), "duration", "words", F.array().cast("array<struct<first_word:int>>").alias("unsung_spans"))
    return m.select(F.col("song_id").cast("string").alias("key"), F.to_json(whole).alias("content"), "error")
