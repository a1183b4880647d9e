"""The folder that all executors share, and a log of commits to what is kept there.

``spark.checkpoint.dir`` names the folder. Where it is unset, a session on a local
master (a test, the bench) gets one of its own below the system's temporary folder;
on a cluster that is an error, since executors would not see one another's files.
"""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = root + (os.pathsep + have if have else "")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session, without a trailing slash."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else ""
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"{tempfile.gettempdir()}/tessera-{os.getpid()}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def file_system(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system of a path, and the path for it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def folder(spark: SparkSession, name: str) -> str:
    """A new shared folder, which goes when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    fs, at = file_system(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def description(spark: SparkSession, *paths: str) -> str:
    """A digest of the names, lengths and times of the files below paths: what is derived
    from them holds as long as it stays the same."""
    found = []
    for path in paths:
        fs, at = file_system(spark, path)
        if fs.exists(at):
            files = fs.listFiles(at, True)
            while files.hasNext():
                f = files.next()
                found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(json.dumps([list(paths), sorted(found)]).encode()).hexdigest()


_KEPT: dict[tuple[str, str, str], str] = {}


def kept(spark: SparkSession, name: str, inputs: list[str], build: Callable[[str], None]) -> str:
    """The folder of something built once an application from input files, and again
    when these have changed."""
    key = (spark.sparkContext.applicationId, name, description(spark, *inputs))
    path = _KEPT.get(key)
    fs, at = file_system(spark, path or "/")
    if path is None or not fs.exists(at):
        path = folder(spark, name)
        build(path)
        _KEPT[key] = path
    return path


class ConflictError(Exception):
    """Another writer committed first to what this commit rests on."""


class CommitLog:
    """Numbered entries (JSON objects) below a folder, each written once.

    An entry is written aside and then put at its number, which fails if the number is
    taken: of two writers one is first, whatever their clocks say. Readers see whole
    entries only.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.root = spark, f"{path.rstrip('/')}/_log"

    def _path(self, number: int) -> str:
        return f"{self.root}/{number:020d}.json"

    def entries(self, after: int = 0) -> list[tuple[int, dict]]:
        """(number, entry) in order, of numbers above after."""
        fs, at = file_system(self.spark, self.root)
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        numbers = sorted(int(n[:20]) for n in names if n.endswith(".json") and n[:20].isdigit())
        return [(n, self._read(n)) for n in numbers if n > after]

    def last(self) -> int:
        return max((n for n, _ in self.entries()), default=0)

    def _read(self, number: int) -> dict:
        fs, at = file_system(self.spark, self._path(number))
        stream = fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def put(self, number: int, entry: dict) -> bool:
        """Whether the entry got the number."""
        fs, to = file_system(self.spark, self._path(number))
        fs.mkdirs(to.getParent())
        aside = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/.{uuid.uuid4().hex}.tmp")
        stream = fs.create(aside, False)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        try:
            if fs.getUri().getScheme() == "file":  # a rename there replaces what it finds, a link does not
                try:
                    os.link(aside.toUri().getPath(), to.toUri().getPath())
                except FileExistsError:
                    return False
                return True
            if fs.exists(to):
                return False
            jvm = self.spark._jvm
            none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
            none[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
            try:
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(aside, to, none)
            except Exception:
                if fs.exists(to):
                    return False
                raise
            return True
        finally:
            fs.delete(aside, False)

    def commit(self, entry: dict, base: int, disputed: Callable[[list[tuple[int, dict]]], bool]) -> int:
        """Puts the entry after the last one; its number. Entries that came after base are
        shown to disputed, and ConflictError is raised if it says so."""
        seen = base
        while True:
            newer = self.entries(seen)
            if newer and disputed(newer):
                raise ConflictError(f"entries {newer[0][0]} to {newer[-1][0]} came first")
            seen = newer[-1][0] if newer else seen
            if self.put(seen + 1, entry):
                return seen + 1
