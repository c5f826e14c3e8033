"""Files of a project: scans, roots and texts. Plain paths are local; those with a scheme (hdfs://, s3a://, ...) are listed by Hadoop's file systems. Texts are read by Spark in either case."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage

EXTENSIONS = (".mjs", ".js")
#: Directories that a scan never enters, besides those whose names begin with a dot.
SKIPPED = ("node_modules",)
REMOTE = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:/")


class Tree:
    """What a scan asks of a local file system."""

    is_dir, is_file, absolute = staticmethod(os.path.isdir), staticmethod(os.path.isfile), staticmethod(os.path.abspath)

    @staticmethod
    def children(path: str) -> list[tuple[str, str, bool]]:
        """(name, path, whether it is a directory), by name."""
        return sorted((e.name, e.path, e.is_dir()) for e in os.scandir(path))


class RemoteTree:
    """The same of a file system that Hadoop knows."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def is_dir(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p) and fs.getFileStatus(p).isDirectory()

    def is_file(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p) and fs.getFileStatus(p).isFile()

    @staticmethod
    def absolute(path: str) -> str:
        return path.rstrip("/")

    def children(self, path: str) -> list[tuple[str, str, bool]]:
        fs, p = self._at(path)
        return sorted((x.getPath().getName(), f"{path.rstrip('/')}/{x.getPath().getName()}", x.isDirectory()) for x in fs.listStatus(p))


def tree_of(path: str) -> Tree | RemoteTree:
    return RemoteTree(SparkSession.getActiveSession()) if REMOTE.match(path) else Tree()


# op: S1
def scan_dir(directory: str, extensions: tuple[str, ...] = EXTENSIONS) -> list[str]:
    """Paths below a directory with one of the extensions, sorted at each level."""
    tree, found = tree_of(directory), []
    for name, path, is_dir in tree.children(directory):
        if name.startswith(".") or name in SKIPPED:
            continue
        if is_dir:
            found += scan_dir(path, extensions)
        elif name.endswith(tuple(extensions)):
            found.append(path)
    return found


# op: S2
def collect_files(paths: list[str], extensions: tuple[str, ...] = EXTENSIONS) -> list[str]:
    """Files named, whatever their extension, and those below directories named; each once; what is missing is skipped."""
    out: dict[str, None] = {}
    for path in paths:
        tree = tree_of(path)
        p = tree.absolute(path)
        if tree.is_dir(p):
            out.update(dict.fromkeys(scan_dir(p, extensions)))
        elif tree.is_file(p):
            out[p] = None
    return list(out)


# op: S3
def infer_root(paths: list[str], root: str | None = None) -> str:
    """The root given; else the first directory named, or that of the first file."""
    if root:
        return tree_of(root).absolute(root)
    for path in paths:
        tree = tree_of(path)
        p = tree.absolute(path)
        if tree.is_dir(p):
            return p
        if tree.is_file(p):
            return os.path.dirname(p)
    return os.getcwd()


def relative(path: str, root: str) -> str:
    return path.removeprefix(root.rstrip("/") + "/") if REMOTE.match(path) else os.path.relpath(path, root)


def texts(spark: SparkSession, paths: list[str], root: str) -> DataFrame:
    """ord, path (relative to root), text: read whole by Spark's text source; bytes that are no UTF-8 are replaced."""
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    rows = [(k, relative(p, root), re.sub("^file:/+", "/", p)) for k, p in enumerate(paths)]
    asked = spark.createDataFrame(rows, "ord long, path string, _at string")
    if not paths:
        return asked.select("ord", "path", F.col("_at").alias("text"))
    names = {p: p if REMOTE.match(p) else f"file://{p}" for p in paths}
    seen = [n for p, n in names.items() if not hidden(p)]
    found = [(re.sub("^file:/+", "/", p), _read(spark, n)) for p, n in names.items() if hidden(p)]
    read = spark.createDataFrame(found, "_at string, text string")
    if seen:
        where = [re.sub(r"([\\\[\]{}*?])", r"\\\1", n) for n in seen]  # names are no patterns
        read = read.unionByName(spark.read.text(where, wholetext=True).select(plain(decoded(F.col("_metadata.file_path"))).alias("_at"), F.make_valid_utf8("value").alias("text")))
    return read.join(storage.if_small(asked), "_at", "right").select("ord", "path", F.coalesce("text", F.lit("")).alias("text"))


def hidden(path: str) -> bool:
    """Whether Spark's sources leave a file out by its name."""
    return path.rsplit("/", 1)[-1].startswith(("_", "."))


def _read(spark: SparkSession, path: str) -> str:
    """The text of one file, by Hadoop on the driver: for the few whose names Spark's sources leave out."""
    fs, at = RemoteTree(spark)._at(path)
    stream = fs.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")
    finally:
        stream.close()


def decoded(uri: Column) -> Column:
    """A URI's path without percent signs; a plus is a plus."""
    return F.url_decode(F.regexp_replace(uri, r"\+", "%2B"))


# op: S13
def is_stale(spark: SparkSession, cache: str, sources: list[str]) -> bool:
    """Whether there is no cache, or a source was changed after it."""
    try:
        newest = spark.read.format("binaryFile").load(sources).select(F.max("modificationTime")).first()[0] if sources else None
        kept = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(cache).select(F.max("modificationTime")).first()[0]
    except Exception as e:  # Spark says that a path is missing in several ways
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return True
        raise
    return kept is None or (newest is not None and newest > kept)
