"""Versioned review store on plain Parquet: append-only tables, one shared revision counter, atomic commits.

A commit first writes its rows as a batch in the table's folder, where no reader takes them without a commit that names them, and then
publishes the commit file of the next revision. A file is whole when its name appears, and the name can be taken once, so of two
writers with the same expected revision one is refused, and nothing of a refused, broken or half-written batch is ever seen.
State is the newest row of each key; history is all of them.

Readers pin a revision first (``Store.at``): one listing decides which commits count, and everything that is read through the pin
comes from the batches that those name, so no commit that comes meanwhile is half seen. Every ``compact_after`` commits the writer also
leaves a checkpoint, one batch with all rows so far, so that a reader opens a bounded number of batches however long the log is.
Commits stay as they are; earlier revisions can be read as long as they stand.
"""

from __future__ import annotations

import json
import math
import re
import time
import uuid
import warnings
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions.text import identity
from spanloom.operators.sequences import newest
from spanloom.sources.files import put_once

#: Batch and page limits, and the words that decisions and materials may use: fixed values of the interface.
LARGEST_BATCH = 50
#: Commits after which a checkpoint is written, unless a store has its own number.
COMPACT = 32
ORIGINS = ("agent", "user")
USAGES = ("context", "ground_truth", "both")
CONFIRMED = ("none", "agent", "user")
_ID = re.compile(r"[0-9a-f]{32}")

_WINDOW = T.StructType([T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType())])
JOBS = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "request", "state")] + [T.StructField("created", T.DoubleType())])
SEGMENTS = T.StructType([T.StructField("job", T.StringType()), T.StructField("id", T.StringType()), T.StructField("window", _WINDOW), T.StructField("variants", T.MapType(T.StringType(), T.StringType())), T.StructField("data", T.StringType())])
DECISIONS = T.StructType([T.StructField(n, T.StringType()) for n in ("job", "segment_id", "status", "choice", "text", "origin", "reason", "question")])
MATERIALS = T.StructType([T.StructField(n, T.StringType()) for n in ("job", "id", "title", "source", "original_text", "text")] + [T.StructField("window", _WINDOW)] + [T.StructField(n, T.StringType()) for n in ("usage", "origin", "confirmed_by", "reason")])
SCHEMAS = {"jobs": JOBS, "segments": SEGMENTS, "decisions": DECISIONS, "materials": MATERIALS}


class Conflict(ValueError):
    """The revision has moved on since it was read."""


def is_id(text: object) -> bool:
    return isinstance(text, str) and bool(_ID.fullmatch(text))


@dataclass(frozen=True)
class Pin:
    """A revision of a scope, and what names the batches that it consists of: a checkpoint, if there is one, and the commits since."""

    scope: str
    revision: int
    parts: list[dict]


@dataclass(frozen=True)
class Snapshot:
    """One job at one revision. All tables are read from the same commits, whenever they are read."""

    store: Store
    job: str
    own: Pin
    given: Pin
    about: Pin

    @property
    def revision(self) -> int:
        return self.own.revision

    @cached_property
    def _row(self):
        return newest(self.store.pinned("jobs", self.about), ["id"], ["revision"]).first()

    @property
    def request(self) -> dict:
        return json.loads(self._row["request"])

    @property
    def state(self) -> dict:
        return json.loads(self._row["state"])

    def decision_log(self) -> DataFrame:
        """All versions of all decisions; those that came with the segments are revision 0."""
        return self.store.pinned("decisions", self.given).withColumn("revision", F.lit(0)).unionByName(self.store.pinned("decisions", self.own))

    def segments(self) -> DataFrame:
        """Segments with the newest of their decisions."""
        stored = self.store.pinned("segments", self.given).drop("revision", "committed")
        current = newest(self.decision_log(), ["segment_id"], ["revision"])
        return stored.join(current.select(F.col("segment_id").alias("id"), F.struct("status", "choice", "text", "origin", "reason", "question").alias("decision")), "id")

    def material_history(self) -> DataFrame:
        """All versions of all materials, by the revision that brought them."""
        return self.store.pinned("materials", self.own).orderBy("revision", "id")

    def materials(self) -> DataFrame:
        """Newest versions of the materials in the order in which they were first saved."""
        rows = self.store.pinned("materials", self.own)
        order = rows.groupBy("id").agg(F.min("revision").alias("first"))
        return newest(rows, ["id"], ["revision"]).join(order, "id").orderBy("first", "id")

    def history(self) -> list[dict]:
        """Decision batches that were saved as lists, in order. Commits are read by Spark; a batch is one row."""
        if not self.revision:
            return []
        files = [self.store._file("commits", self.job, n) for n in range(1, self.revision + 1)]
        texts = self.store.spark.read.text(files, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"(\d+)\.json$", 1).cast("int").alias("revision"), "value")
        found = [(r["revision"], json.loads(r["value"])) for r in texts.orderBy("revision").collect()]
        return [{"revision": n, "changes": c["changes"], "created": c["created"]} for n, c in found if "changes" in c]

    def reference_history(self, ids: Sequence[str] | None = None) -> list[dict]:
        """Material batches in order, each with the versions that it brought; of some materials alone, if ids are given."""
        rows = self.material_history()
        found: dict[int, list[dict]] = {}
        for r in (rows if ids is None else rows.where(F.col("id").isin(*ids) if ids else F.lit(False))).collect():
            found.setdefault(r["revision"], []).append({k: v for k, v in r.asDict(True).items() if k not in ("job", "revision")})
        return [{"revision": k, "created": v[0]["committed"], "changes": [{n: x for n, x in m.items() if n != "committed"} for m in v]} for k, v in sorted(found.items())]


def decision_problems(changes: DataFrame, segments: DataFrame) -> DataFrame:
    """segment_id and problem of all that is wrong with decisions, by a join with the segments (id, variants): the rules of ``save_decisions``.

    A segment that is decided twice has one such row; a row for an unknown segment has no other problem.
    """
    blank = lambda c: ~F.rlike(F.coalesce(F.col(c), F.lit("")), F.lit(r"(?U)\S"))
    known = segments.select(F.col("id").alias("segment_id"), "variants")
    met = changes.join(known, "segment_id", "left")
    choice = F.col("choice")
    fits = F.coalesce(F.array_contains(F.concat(F.map_keys("variants"), F.array(F.lit("edited"), F.lit("uncertain"))), choice), F.lit(False))
    wrong = F.array_compact(
        F.array(
            F.when(~fits, "invalid choice"),
            F.when(blank("reason"), "a reason is required"),
            F.when((choice == "edited") & blank("text"), "edited text must not be empty"),
            F.when((choice == "uncertain") & blank("question"), "an uncertain decision needs a question"),
            F.when(~F.coalesce(F.col("origin").isin(*ORIGINS), F.col("origin").isNull()), "invalid origin"),
        )
    )
    each = F.explode(F.when(F.col("variants").isNull(), F.array(F.lit("unknown segment"))).otherwise(wrong)).alias("problem")
    twice = changes.groupBy("segment_id").agg(F.count("*").alias("n")).where("n > 1").select("segment_id", F.lit("duplicate segment decisions").alias("problem"))
    return met.select("segment_id", each).unionByName(twice)


class Store:
    def __init__(self, spark: SparkSession, folder: str, compact_after: int = COMPACT):
        self.spark, self.folder, self.compact_after = spark, folder.rstrip("/"), compact_after
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self._fs.mkdirs(self._path(f"{self.folder}/commits"))

    def _json(self, path: str) -> dict:
        stream = self._fs.open(self._path(path))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _numbers(self, folder: str, scope: str) -> list[int]:
        """Revisions that have a file in a scope's folder, ascending."""
        found = self._fs.globStatus(self._path(f"{self.folder}/{folder}/{scope}/*.json")) or ()
        return sorted(int(s.getPath().getName().split(".")[0]) for s in found)

    def _file(self, folder: str, scope: str, revision: int) -> str:
        return f"{self.folder}/{folder}/{scope}/{revision:09d}.json"

    def revision(self, scope: str) -> int:
        """The last revision of a job, or of another scope; 0 before the first."""
        return max(self._numbers("commits", scope), default=0)

    def pin(self, scope: str, revision: int | None = None) -> Pin:
        """What a reader of this revision (the last, if none is given) sees of a scope."""
        numbers = self._numbers("commits", scope)
        # A listing isn't one moment: of commits that come meanwhile it may show a later one alone. Those up to the first gap count.
        last = next((i for i, n in enumerate(numbers) if n != i + 1), len(numbers))
        if revision is not None and not 0 <= revision <= last:
            raise ValueError("unknown revision")
        upto = last if revision is None else revision
        base = max((n for n in self._numbers("checkpoints", scope) if n <= upto), default=0)
        parts = [self._json(self._file("checkpoints", scope, base))] if base else []
        return Pin(scope, upto, parts + [self._json(self._file("commits", scope, n)) for n in range(base + 1, upto + 1)])

    def _put(self, text: str, target: str) -> None:
        """Makes a whole file appear under a name that nothing has; Conflict if something has it."""
        try:
            put_once(self.spark, target, text)
        except FileExistsError as e:
            raise Conflict("revision changed; read again before saving") from e

    def _publish(self, scope: str, revision: int, tables: dict[str, DataFrame], note: dict | None = None) -> None:
        """Writes the rows as a batch, then the commit that names it: until then, and if another commit is first, no reader sees them."""
        batch, created = uuid.uuid4().hex, time.time()
        for name, rows in tables.items():
            own = rows.withColumns({"revision": F.lit(revision), "committed": F.lit(created)})
            own.write.parquet(f"{self.folder}/data/{name}/scope={scope}/batch={batch}")
        text = json.dumps({"batch": batch, "tables": list(tables), "created": created, **(note or {})}, ensure_ascii=False)
        self._put(text, self._file("commits", scope, revision))
        if revision % self.compact_after == 0:
            try:
                self.compact(scope, revision)
            except Exception as e:  # the commit stands; readers go on with the checkpoint before
                warnings.warn(f"no checkpoint of {scope} at {revision}: {e}", stacklevel=2)

    def compact(self, scope: str, revision: int | None = None) -> int:
        """Writes a checkpoint: one batch for each table with all its rows up to the revision (the last, if none is given), which it returns.

        A checkpoint is published as a commit is, whole and once; a second writer's is left unread.
        """
        pin = self.pin(scope, revision)
        names = sorted({t for c in pin.parts for t in c["tables"]})
        if not pin.revision or not names:
            return pin.revision
        batch = uuid.uuid4().hex
        for name in names:
            self.pinned(name, pin).write.parquet(f"{self.folder}/data/{name}/scope={scope}/batch={batch}")
        try:
            self._put(json.dumps({"batch": batch, "tables": names, "created": time.time()}), self._file("checkpoints", scope, pin.revision))
        except Conflict:
            pass  # another writer has made the same
        return pin.revision

    @staticmethod
    def _schema(name: str) -> T.StructType:
        return T.StructType([*SCHEMAS[name].fields, T.StructField("revision", T.IntegerType()), T.StructField("committed", T.DoubleType())])

    def pinned(self, name: str, pin: Pin) -> DataFrame:
        """All rows of a table that the pin sees, with the revision that brought them: one scan of the batches it names."""
        schema = self._schema(name)
        paths = [f"{self.folder}/data/{name}/scope={pin.scope}/batch={c['batch']}" for c in pin.parts if name in c["tables"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _rows(self, name: str, scope: str | None, prefix: str = "") -> DataFrame:
        """All published rows of a table with the revision that brought them: of one scope, or of all that begin with a prefix.

        Of all, it is one scan of the table, joined with the batches that the commits name.
        """
        if scope:
            return self.pinned(name, self.pin(scope))
        schema = self._schema(name)
        folder, commits = f"{self.folder}/data/{name}", f"{self.folder}/commits/{prefix}*/*.json"
        if not self._fs.exists(self._path(folder)) or not self._fs.globStatus(self._path(commits)):
            return self.spark.createDataFrame([], schema)
        kept = self.spark.read.schema("batch string, tables array<string>").json(commits).where(F.array_contains("tables", name)).select("batch")
        keyed = T.StructType([*schema.fields, T.StructField("batch", T.StringType())])
        return self.spark.read.schema(keyed).option("basePath", folder).parquet(folder).join(kept, "batch", "left_semi").select(*schema.names)

    def at(self, job: str, revision: int | None = None) -> Snapshot:
        """The job as it is now, or as its decisions and materials were at an earlier revision; later commits don't show in it."""
        if not is_id(job):
            raise ValueError("invalid job id")
        own = self.pin(job, revision)
        # Decisions come after the segments that they name, so what is listed last holds all that the first listing refers to.
        snapshot = Snapshot(self, job, own, self.pin(f"seg-{job}"), self.pin(f"job-{job}"))
        if not snapshot.about.revision:
            raise ValueError("unknown job")
        return snapshot

    # Jobs

    def create(self, request: dict) -> tuple[str, bool]:
        """(id, whether it is new): equal requests are one job."""
        job = identity(request)
        if self.revision(f"job-{job}"):
            return job, False
        row = (job, json.dumps(request, ensure_ascii=False, sort_keys=True), json.dumps({"status": "queued"}), time.time())
        try:
            self._publish(f"job-{job}", 1, {"jobs": self.spark.createDataFrame([row], JOBS)})
        except Conflict:
            return job, False
        return job, True

    def set_state(self, job: str, **changes: object) -> None:
        """The state's fields overridden by ``changes``: a new version of the job's row."""
        revision = self.revision(f"job-{job}")  # before the row is read, so a version that comes between is a conflict
        old = self.get(job)
        state = {**json.loads(old["state"]), **changes}
        row = (job, old["request"], json.dumps(state, ensure_ascii=False), old["created"])
        self._publish(f"job-{job}", revision + 1, {"jobs": self.spark.createDataFrame([row], JOBS)})

    def get(self, job: str):
        if not is_id(job):
            raise ValueError("invalid job id")
        pin = self.pin(f"job-{job}")
        if not pin.revision:
            raise ValueError("unknown job")
        return newest(self.pinned("jobs", pin), ["id"], ["revision"]).first()

    def state(self, job: str) -> dict:
        return json.loads(self.get(job)["state"])

    def jobs(self, limit: int = 20, audio_path: str | None = None) -> DataFrame:
        """The newest jobs, of one audio path if given."""
        if not 1 <= limit <= 50:
            raise ValueError("limit must be 1 to 50")
        rows = newest(self._rows("jobs", None, "job-"), ["id"], ["revision"])
        if audio_path is not None:
            rows = rows.where(F.get_json_object("request", "$.audio_path") == audio_path)
        return rows.orderBy(F.desc("created"), "id").limit(limit)

    # Segments and decisions

    def initialize(self, job: str, segments: DataFrame) -> None:
        """Segments that aren't stored yet, each with its first decision: agreed variants resolve themselves.

        ``segments`` has id, window, variants (name to text) and data; a single variant agrees with itself.
        """
        self.get(job)
        revision = self.revision(f"seg-{job}")
        own = segments.select(F.lit(job).alias("job"), "id", "window", "variants", "data").join(self._rows("segments", f"seg-{job}").select("id"), "id", "left_anti").select(*SEGMENTS.names)
        texts = F.map_values("variants")
        first = F.element_at(texts, 1)
        agreed = (F.size(F.array_distinct(texts)) == 1) & (F.trim(first) != "")
        value = lambda yes, no: F.when(agreed, yes).otherwise(no)
        nothing = F.lit(None).cast("string")
        decisions = own.select("job", F.col("id").alias("segment_id"), value(F.lit("resolved"), F.lit("pending")).alias("status"), value(F.lit("agreement"), nothing).alias("choice"), value(first, nothing).alias("text"), F.lit("asr").alias("origin"), value(F.lit("identical transcripts"), F.lit("")).alias("reason"), F.lit("").alias("question"))
        self._publish(f"seg-{job}", revision + 1, {"segments": own, "decisions": decisions})
        state = json.loads(self.get(job)["state"])
        if state.get("status") != "ready":
            self.set_state(job, status="ready")

    def segments(self, job: str) -> DataFrame:
        """Segments with their current decisions."""
        return self.at(job).segments()

    def decision_errors(self, job: str, changes: Sequence[dict]) -> list[str]:
        """What is wrong with a batch of decisions; empty if it may be committed."""
        if not 1 <= len(changes) <= LARGEST_BATCH:
            return [f"supply 1 to {LARGEST_BATCH} decisions"]
        ids = [c.get("segment_id") for c in changes]
        if len(set(ids)) != len(ids):
            return ["duplicate segment decisions"]
        known = {r["id"]: r["variants"] for r in self._rows("segments", f"seg-{job}").where(F.col("id").isin(*ids)).select("id", "variants").collect()}  # at most a batch
        errors = []
        for c in changes:
            variants, choice = known.get(c["segment_id"]), c.get("choice")
            if variants is None:
                errors.append(f"{c['segment_id']}: unknown segment")
                continue
            checks = (
                (choice in (*variants, "edited", "uncertain"), "invalid choice"),
                (bool(str(c.get("reason") or "").strip()), "a reason is required"),
                (choice != "edited" or isinstance(c.get("text"), str) and bool(c["text"].strip()), "edited text must not be empty"),
                (choice != "uncertain" or bool(str(c.get("question") or "").strip()), "an uncertain decision needs a question"),
                (c.get("origin", "agent") in ORIGINS, "invalid origin"),
            )
            errors += [f"{c['segment_id']}: {what}" for fine, what in checks if not fine]
        return errors

    def save_decisions(self, job: str, changes: Sequence[dict], expected: int) -> int:
        """The new revision; all changes or none. Conflict if ``expected`` isn't the job's revision."""
        if self.revision(job) != expected:
            raise Conflict("revision changed; read the segments again before saving")
        errors = self.decision_errors(job, changes)
        if errors:
            raise ValueError("; ".join(errors))
        variants = {r["id"]: r["variants"] for r in self._rows("segments", f"seg-{job}").where(F.col("id").isin(*[c["segment_id"] for c in changes])).collect()}
        rows = []
        for c in changes:
            choice = c["choice"]
            text = None if choice == "uncertain" else c["text"] if choice == "edited" else variants[c["segment_id"]][choice]
            rows.append((job, c["segment_id"], "uncertain" if choice == "uncertain" else "resolved", choice, text, c.get("origin", "agent"), c["reason"], c.get("question", "")))
        self._publish(job, expected + 1, {"decisions": self.spark.createDataFrame(rows, DECISIONS)}, {"changes": list(changes)})
        return expected + 1

    def import_decisions(self, job: str, changes: DataFrame, expected: int) -> int:
        """The new revision: a batch of any size as a table (segment_id, choice, text, origin, reason, question), checked by joins; all or none."""
        if self.revision(job) != expected:
            raise Conflict("revision changed; read the segments again before saving")
        segments = self.pinned("segments", self.pin(f"seg-{job}")).select("id", "variants")
        wrong = decision_problems(changes, segments).limit(LARGEST_BATCH).collect()
        if wrong:
            raise ValueError("; ".join(f"{r['segment_id']}: {r['problem']}" for r in wrong))
        own = changes.join(segments, changes["segment_id"] == segments["id"])
        open_ = F.col("choice") == "uncertain"
        text = F.when(open_, F.lit(None).cast("string")).when(F.col("choice") == "edited", F.col("text")).otherwise(F.element_at("variants", F.col("choice")))
        rows = own.select(F.lit(job).alias("job"), "segment_id", F.when(open_, "uncertain").otherwise("resolved").alias("status"), "choice", text.alias("text"), F.coalesce("origin", F.lit("agent")).alias("origin"), "reason", F.coalesce("question", F.lit("")).alias("question"))
        self._publish(job, expected + 1, {"decisions": rows})
        return expected + 1

    def history(self, job: str) -> list[dict]:
        """Decision batches in order."""
        return self.at(job).history()

    # Materials

    def materials(self, job: str) -> DataFrame:
        """Current materials in the order in which they were first saved."""
        return self.at(job).materials()

    def material_history(self, job: str) -> DataFrame:
        return self.at(job).material_history()

    def import_materials(self, job: str, rows: DataFrame, expected: int) -> int:
        """The new revision: materials as a table of ``MATERIALS`` without job, whose ids and texts come from elsewhere."""
        if self.revision(job) != expected:
            raise Conflict("revision changed; read again before saving")
        self._publish(job, expected + 1, {"materials": rows.select(F.lit(job).alias("job"), *MATERIALS.names[1:])})
        return expected + 1

    def material_errors(self, given: dict, old: dict | None, duration: float | None) -> list[str]:
        original = given.get("original_text")
        if old is not None:
            if original is not None and original != old["original_text"]:
                return ["original text is immutable"]
            original = old["original_text"]
        filled = lambda v: isinstance(v, str) and bool(v.strip())
        title, source = given.get("title", ""), given.get("source", "")
        usage, window = given.get("usage", "context"), given.get("window")
        number = lambda v: type(v) in (int, float) and math.isfinite(v)
        shaped = window is None or isinstance(window, (list, tuple)) and len(window) == 2 and all(map(number, window)) and 0 <= window[0] < window[1]
        checks = (
            (filled(original), "original_text must not be empty"),
            (filled(given.get("text")), "text must not be empty"),
            (filled(given.get("reason")), "reason must not be empty"),
            (isinstance(title, str) and isinstance(source, str) and bool(title.strip() or source.strip()), "supply a title or a source"),
            (usage in USAGES, "invalid usage"),
            (given.get("origin", "agent") in ORIGINS and given.get("confirmed_by", "none") in CONFIRMED, "invalid provenance"),
            (usage == "context" or window is not None, "ground truth requires an interval"),
            (shaped, "invalid interval"),
            (not shaped or window is None or duration is not None and window[1] <= duration, "the interval must lie within the timeline"),
        )
        return [what for fine, what in checks if not fine]

    def duration(self, job: str) -> float | None:
        row = self.get(job)
        request, state = json.loads(row["request"]), json.loads(row["state"])
        known = [v for v in (state.get("duration", request.get("duration")), request.get("limit_seconds")) if v is not None]
        return min(known) if known else None

    def save_materials(self, job: str, given: Sequence[dict], expected: int) -> tuple[int, list[str]]:
        """(new revision, ids): new materials without id, new versions with it; all or none."""
        if not 1 <= len(given) <= LARGEST_BATCH:
            raise ValueError(f"supply 1 to {LARGEST_BATCH} materials")
        duration = self.duration(job)
        if self.revision(job) != expected:
            raise Conflict("revision changed; read again before saving")
        named = [m["id"] for m in given if m.get("id") is not None]
        if not all(map(is_id, named)):
            raise ValueError("invalid material id")
        if len(set(named)) != len(named):
            raise ValueError("duplicate material updates")
        old = {r["id"]: r for r in newest(self._rows("materials", job), ["id"], ["revision"]).where(F.col("id").isin(*named) if named else F.lit(False)).collect()}
        rows = []
        for m in given:
            if m.get("id") is not None and m["id"] not in old:
                raise ValueError("unknown material; omit the id to create one")
            before = old.get(m.get("id"))
            errors = self.material_errors(m, before, duration)
            if errors:
                raise ValueError("; ".join(errors))
            window = m.get("window")
            rows.append((job, m.get("id") or uuid.uuid4().hex, m.get("title", ""), m.get("source", ""), before["original_text"] if before else m["original_text"], m["text"], tuple(map(float, window)) if window else None, m.get("usage", "context"), m.get("origin", "agent"), m.get("confirmed_by", "none"), m["reason"]))
        self._publish(job, expected + 1, {"materials": self.spark.createDataFrame(rows, MATERIALS)})
        return expected + 1, [r[1] for r in rows]
