"""Sinks: text lines (S6), numbered batch files (S7), processed copies of
local files (S14) and versioned vocabulary tables (S12)."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions import text as tx
from ..operators.index import fixed_batches

COMMIT_MARKER, CLAIM = "_COMMITTED", "_CLAIMED"


# S6 -------------------------------------------------------------------------
def write_text_lines(df: DataFrame, path: str, text_col: str = "text",
                     mode: str = "overwrite") -> str:
    """One sample per line, blank samples skipped; returns the path.  A
    newline inside a sample would split it, so Parquet is the safer default
    elsewhere."""
    tx.drop_blank(df.select(F.col(text_col).alias("value")), "value").write.mode(mode).text(path)
    return path


# S7 -------------------------------------------------------------------------
def write_batches(df: DataFrame, path: str, order_cols: list[str], batch_size: int,
                  text_col: str = "text", mode: str = "overwrite") -> str:
    """Rows numbered in order, ``batch_id = index div batch_size``, blank rows
    dropped after numbering, one folder with one file per batch (an all-blank
    batch makes none): all rows of a batch go to one task, which may hold
    several batches."""
    b = fixed_batches(df, order_cols, batch_size).drop("_pos_in_batch")
    tx.drop_blank(b, text_col).repartition("batch_id").write.mode(mode).partitionBy("batch_id").parquet(path)
    return path


# S14 ------------------------------------------------------------------------
class ItemFiles(DataSource):
    """Write-only source ``wordloom_items``: one file for each row (name, text or
    bytes), byte for byte.  A task writes into a folder of its own; the commit
    moves the folders of the tasks that ended well to ``part-<n>`` and drops
    what any other attempt left, an abort drops all.  The path is any that
    pyarrow's file systems reach."""

    @classmethod
    def name(cls) -> str:
        return "wordloom_items"

    def writer(self, schema, overwrite: bool):
        return ItemFilesWriter(self.options["path"])


@dataclass
class ItemFilesDone(WriterCommitMessage):
    folder: str
    partition: int
    files: int


class ItemFilesWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.run = uuid.uuid4().hex

    def _fs(self):
        from pyarrow import fs
        if "://" in self.path or self.path.startswith("file:"):
            return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", self.path))
        return fs.LocalFileSystem(), self.path

    def write(self, rows):
        from pyspark import TaskContext
        fs, top = self._fs()
        folder, made, held = f"_temporary/{self.run}/{uuid.uuid4().hex}", set(), {}
        files = 0
        for name, content in rows:
            name = _safe_relative(name)
            held[name] = held.get(name, 0) + 1
            if held[name] > 1:   # a name that this task has written already
                stem, dot, end = name.rpartition(".") if "." in name.rpartition("/")[2] else (name, "", "")
                name = f"{stem}~{held[name]}{dot}{end}"
            target = f"{top}/{folder}/{name}"
            parent = target.rpartition("/")[0]
            if parent not in made:
                fs.create_dir(parent, recursive=True)
                made.add(parent)
            with fs.open_output_stream(target) as out:
                out.write(content.encode() if isinstance(content, str) else bytes(content or b""))
            files += 1
        return ItemFilesDone(folder if files else "", TaskContext.get().partitionId(), files)

    def commit(self, messages):
        fs, top = self._fs()
        fs.create_dir(top, recursive=True)
        for m in messages:
            if m is not None and m.folder:
                fs.move(f"{top}/{m.folder}", f"{top}/part-{m.partition:05d}-{self.run[:8]}")
        self._clean(fs, top)

    def abort(self, messages):
        self._clean(*self._fs())

    def _clean(self, fs, top) -> None:
        from pyarrow.fs import FileType
        if fs.get_file_info(f"{top}/_temporary/{self.run}").type != FileType.NotFound:
            fs.delete_dir(f"{top}/_temporary/{self.run}")
        if fs.get_file_info(f"{top}/_temporary").type != FileType.NotFound and not fs.get_file_info(
                _selector(f"{top}/_temporary")):
            fs.delete_dir(f"{top}/_temporary")


def _selector(folder: str):
    from pyarrow.fs import FileSelector
    return FileSelector(folder)


def _safe_relative(name: str | None) -> str:
    """A relative path without empty, ``.`` or ``..`` parts."""
    parts = [x for x in (name or "").split("/") if x not in ("", ".", "..")]
    return "/".join(parts) or "unnamed"


def write_item_files(df: DataFrame, path: str, name_col: str, content_col: str) -> str:
    """One file per row under ``path``: ``part-<n>/<name>`` with the content (a
    string as UTF-8, or bytes; null: empty).  Names may have folders; of equal
    names in one part, the later ones get ``~2``, ``~3`` before the ending.
    Files from earlier calls stay.  Returns the path."""
    spark = df.sparkSession
    spark.dataSource.register(ItemFiles)
    (df.select(F.col(name_col).alias("name"), F.col(content_col).alias("content"))
     .write.format("wordloom_items").mode("append").option("path", path).save())
    return path


def write_processed_copies(corpus: DataFrame, path: str, root: str = "") -> str:
    """(path, text) of files -> blank ones skipped, each written as
    ``<folder>/<stem>_processed.txt``, the folder being the file's own below
    ``root`` (all of it without one), so that equal stems of two folders stay
    apart.  The text is kept byte for byte."""
    plain = F.regexp_replace(F.col("path"), "^[a-z0-9]+:/+", "/")
    top = re.sub("^[a-z0-9]+:/+", "/", root).rstrip("/")
    below = F.when(plain.startswith(top + "/"), F.substring(plain, len(top) + 2, 2147483647)).otherwise(plain)
    name = F.regexp_replace(below, r"(?s)([^/]+?)(\.[^./]*)?$", "$1_processed.txt")
    return write_item_files(tx.drop_blank(corpus).select(name.alias("name"), "text"), path, "name", "text")


# S12 ------------------------------------------------------------------------
def _fs(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def committed_versions(spark: SparkSession, root: str) -> list[int]:
    """Versions under ``root`` whose commit marker exists (newest last)."""
    fs, jvm = _fs(spark, root)
    rp = jvm.org.apache.hadoop.fs.Path(root)
    if not fs.exists(rp):
        return []
    out = []
    for st in fs.listStatus(rp):
        name = st.getPath().getName()
        if name.startswith("version=") and name[8:].isdigit():
            if fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), COMMIT_MARKER)):
                out.append(int(name[8:]))
    return sorted(out)


def _claimed(spark: SparkSession, path: str) -> bool:
    """Create the file; False if it is there already."""
    fs, jvm = _fs(spark, path)
    try:
        fs.create(jvm.org.apache.hadoop.fs.Path(path), False).close()
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception.getClass().getName()) or "already exists" in str(e.java_exception):
            return False
        raise


def save_model_tables(spark: SparkSession, root: str, model) -> int:
    """Write vocabulary and merges as a new version; publish it by writing the
    commit marker last.  Earlier versions stay as backups; a failed save
    leaves no marker and is ignored by readers.  A version's number is claimed
    by a file that only one writer can create, so two that save at once write
    two versions."""
    versions = committed_versions(spark, root)
    v = (versions[-1] + 1) if versions else 1
    while not _claimed(spark, f"{root.rstrip('/')}/version={v}/{CLAIM}"):
        v += 1
    base = f"{root.rstrip('/')}/version={v}"
    model.vocab_frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{base}/vocab")
    model.merges_frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{base}/merges")
    fs, jvm = _fs(spark, base)
    fs.create(jvm.org.apache.hadoop.fs.Path(f"{base}/{COMMIT_MARKER}"), True).close()
    return v


def load_model_tables(spark: SparkSession, root: str, version: int | None = None):
    """(version, vocab, merges) of the given or newest committed version."""
    versions = committed_versions(spark, root)
    if not versions:
        raise FileNotFoundError(f"no committed version under {root}")
    v = version if version is not None else versions[-1]
    if v not in versions:
        raise FileNotFoundError(f"version {v} is not committed under {root}")
    base = f"{root.rstrip('/')}/version={v}"
    return v, spark.read.parquet(f"{base}/vocab"), spark.read.parquet(f"{base}/merges")


def restore_previous(spark: SparkSession, root: str):
    """The committed version before the newest (the backup)."""
    versions = committed_versions(spark, root)
    if len(versions) < 2:
        raise FileNotFoundError("no earlier version to restore")
    return load_model_tables(spark, root, versions[-2])


def model_from_tables(vocab: DataFrame, merges: DataFrame):
    """Rebuild a BpeModel from saved tables (both bounded by the vocabulary)."""
    from ..operators.bpe import BpeModel
    v = vocab.orderBy("id").collect()
    m = merges.orderBy("rank").collect()
    specials = [r["token"] for r in v if r["kind"] == "special"]
    alphabet = [r["token_hex"] for r in v if r["kind"] == "byte"]
    return BpeModel(specials, alphabet, [(r["left"], r["right"]) for r in m],
                    [r["count"] for r in m])
