"""Files by Hadoop's file system: JSON and text written whole or not at all, keyed caches, digests, profiles."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes beside the target and renames over it, so that a reader, whenever it looks, sees the old file or the new one.

    A writer that dies before the rename leaves the old file as it was, and a part beside it.
    """
    target, fs = _at(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    stream = fs.create(part, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    jvm = spark._jvm
    if fs.getUri().getScheme() == "file":
        local = [jvm.java.nio.file.Paths.get(fs.makeQualified(p).toUri()) for p in (part, target)]
        option = spark.sparkContext._gateway.new_array(jvm.java.nio.file.CopyOption, 1)
        option[0] = jvm.java.nio.file.StandardCopyOption.ATOMIC_MOVE
        jvm.java.nio.file.Files.move(*local, option)
    else:
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsparkSession.sessionState().newHadoopConf()).rename(part, target, options)


def put_once(spark: SparkSession, path: str, text: str) -> None:
    """Makes a whole file appear under a name that nothing has; FileExistsError if something has it.

    The text is written under a name of its own first, so a reader never meets a part of it, and a writer that dies leaves only a
    file that nobody reads. The name is then taken by a hard link on a local disk, elsewhere by a rename that refuses an existing
    target: HDFS and stores with atomic renames decide between two writers; on an object store without them one writer is assumed.
    """
    jvm, (target, fs) = spark._jvm, _at(spark, path)
    part = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{uuid.uuid4().hex}.part")  # no glob of results meets it
    stream = fs.create(part, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    taken = ("java.nio.file.FileAlreadyExistsException", "org.apache.hadoop.fs.FileAlreadyExistsException")
    try:
        if fs.getUri().getScheme() == "file":
            jvm.java.nio.file.Files.createLink(*[jvm.java.nio.file.Paths.get(fs.makeQualified(p).toUri()) for p in (target, part)])
        else:
            options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsparkSession.sessionState().newHadoopConf()).rename(part, target, options)
    except Py4JJavaError as e:
        if e.java_exception.getClass().getName() in taken:
            raise FileExistsError(path) from e
        raise
    finally:
        fs.delete(part, False)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all files in a folder."""
    target, fs = _at(spark, path)
    return fs.getContentSummary(target).getLength()


def write_beside(spark: SparkSession, path: str, text: str, source: str) -> None:
    """``write_text``, but never over the file that the text was made from, however either path is written. ValueError then."""
    (target, fs), (origin, other) = _at(spark, path), _at(spark, source)
    if fs.makeQualified(target).equals(other.makeQualified(origin)):
        raise ValueError("the output is the source")
    if fs.getUri().getScheme() == "file" and fs.exists(target) and other.exists(origin):
        paths = spark._jvm.java.nio.file.Paths
        if spark._jvm.java.nio.file.Files.isSameFile(paths.get(fs.makeQualified(target).toUri()), paths.get(other.makeQualified(origin).toUri())):
            raise ValueError("the output is the source")
    write_text(spark, path, text)


def read_text(spark: SparkSession, path: str) -> str:
    target, fs = _at(spark, path)
    stream = fs.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, value: object) -> None:
    write_text(spark, path, json.dumps(value, ensure_ascii=False, indent=1, default=lambda x: list(x)))


def read_json(spark: SparkSession, path: str) -> object:
    return json.loads(read_text(spark, path))


def digests(spark: SparkSession, pattern: str) -> DataFrame:
    """path, length and sha256 of files."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length", F.sha2("content", 256).alias("sha256"))


def changed(spark: SparkSession, pattern: str, expected: DataFrame) -> DataFrame:
    """Files whose digest isn't the expected one: name, sha256 (null: the file is gone) and expected."""
    found = digests(spark, pattern).select(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256")
    both = expected.select("name", F.col("sha256").alias("expected")).join(found, "name", "left")
    return both.where(~F.col("sha256").eqNullSafe(F.col("expected")))


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """All JSON documents of a folder in order of their names."""
    rows = spark.read.option("multiLine", True).json(f"{folder}/*.json").withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return rows.orderBy("file")


def cache_key(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True).encode()).hexdigest()


class StageCache:
    """Results of stages by content key, as Parquet partitioned by stage: what is there isn't computed again."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def _stored(self, stage: str) -> DataFrame:
        """All published results with ``number``, that of their batch's commit."""
        folder, commits = f"{self.folder}/stage={stage}", f"{self.folder}/commits/stage={stage}"
        path, fs = _at(self.spark, commits)
        full = f"key_sha string, {self.schema}"
        if not fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(path, "*.json")):
            return self.spark.createDataFrame([], f"{full}, number long")
        names = self.spark.read.schema("batch string").json(f"{commits}/*.json").select("batch", F.regexp_extract(F.input_file_name(), r"(\d+)\.json$", 1).cast("long").alias("number"))
        return self.spark.read.schema(f"{full}, batch string").option("basePath", folder).parquet(folder).join(names, "batch").drop("batch")

    def read(self, stage: str) -> DataFrame:
        """One result for each key: that of the first commit, so it stays what it is whatever comes later."""
        rows = self._stored(stage)
        names = [c for c in rows.columns if c not in ("key_sha", "number")]
        return rows.groupBy("key_sha").agg(F.min_by(F.struct(*names), "number").alias("_r")).select("key_sha", "_r.*")

    def missing(self, stage: str, wanted: DataFrame) -> DataFrame:
        """Rows of ``wanted`` whose ``key_sha`` has no result yet."""
        return wanted.join(self._stored(stage).select("key_sha"), "key_sha", "left_anti")

    def add(self, stage: str, results: DataFrame) -> None:
        """Adds results that aren't there; the first result of a key stays.

        Rows are written as a batch, then published by the next free commit number, which one writer can take. Two writers that both
        find a key missing both write it; every reader takes the result of the lesser number. A writer that dies publishes nothing.
        """
        batch = uuid.uuid4().hex
        self.missing(stage, results).dropDuplicates(["key_sha"]).write.parquet(f"{self.folder}/stage={stage}/batch={batch}")
        commits = f"{self.folder}/commits/stage={stage}"
        while True:
            path, fs = _at(self.spark, commits)
            found = fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(path, "*.json")) or ()
            number = max((int(x.getPath().getName().split(".")[0]) for x in found), default=0) + 1
            try:
                return put_once(self.spark, f"{commits}/{number:09d}.json", json.dumps({"batch": batch}))
            except FileExistsError:
                continue

    def lookup(self, stage: str, wanted: DataFrame) -> DataFrame:
        """``wanted`` with its results, null where there are none."""
        return wanted.join(self.read(stage), "key_sha", "left")


def reuse(wanted: DataFrame, stored: DataFrame, keys: Sequence[str], bounds: Sequence[str]) -> DataFrame:
    """Stored results by key; an error where the bounds they were made for differ from those wanted."""
    kept = stored.select(*keys, *[F.col(b).alias(f"_{b}") for b in bounds], *[c for c in stored.columns if c not in (*keys, *bounds)])
    same: Column = F.lit(True)
    for b in bounds:
        same = same & (F.col(f"_{b}").isNull() | (F.col(b) == F.col(f"_{b}")))
    joined = wanted.join(kept, list(keys), "left")
    return joined.where(F.when(same, True).otherwise(F.raise_error(F.lit("stored result has other bounds")).cast("boolean"))).drop(*[f"_{b}" for b in bounds])


def same_request(spark: SparkSession, path: str, request: dict) -> bool:
    """Whether the request stored at ``path`` is this one; it is stored if there is none. ValueError if another one is there.

    A worker asks before it takes up stored results, so that results of another request are never taken for its own.
    """
    target, fs = _at(spark, path)
    if not fs.exists(target):
        write_json(spark, path, request)
        return False
    if read_json(spark, path) != json.loads(json.dumps(request)):
        raise ValueError("the stored result belongs to another request")
    return True
