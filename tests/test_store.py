"""The versioned store and its review queries: atomic batches, conflicts, histories, pages and exports."""

from __future__ import annotations

import pytest

from spanloom.operators import review
from spanloom.sources import files
from spanloom.sources.store import Conflict, Store

REQUEST = {"audio_path": "/a.wav", "profile": "general", "duration": 20.0, "context": "x"}
MATERIAL = {"title": "Slides", "original_text": "raw", "text": "clean", "reason": "given", "window": [8, 12], "usage": "both", "origin": "user", "confirmed_by": "user"}


def _segments(spark):
    rows = [("S000001", (0.0, 10.0), {"A": "нестационарных данных", "B": "стационарных данных"}, "{}"), ("S000002", (10.0, 20.0), {"A": "ряд", "B": "ряд"}, "{}")]
    return spark.createDataFrame(rows, "id string, window struct<start:double,end:double>, variants map<string,string>, data string")


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


@pytest.fixture
def job(store, spark):
    job, _ = store.create(REQUEST)
    store.initialize(job, _segments(spark))
    return job


def test_create_is_idempotent(store):
    job, new = store.create(REQUEST)
    assert new and store.create(dict(reversed(list(REQUEST.items())))) == (job, False)
    with pytest.raises(ValueError):
        store.get("../x")
    with pytest.raises(ValueError):
        store.get("0" * 32)


def test_agreement_resolves_itself(store, job, spark):
    store.initialize(job, _segments(spark))  # again: nothing new
    got = {r["id"]: r["decision"] for r in store.segments(job).collect()}
    assert (got["S000001"]["status"], got["S000001"]["text"]) == ("pending", None)
    assert (got["S000002"]["status"], got["S000002"]["text"], got["S000002"]["choice"]) == ("resolved", "ряд", "agreement")


def test_batches_are_atomic(store, job):
    good = {"segment_id": "S000001", "choice": "A", "reason": "heard"}
    with pytest.raises(ValueError, match="unknown"):
        store.save_decisions(job, [good, {"segment_id": "S9", "choice": "A", "reason": "r"}], 0)
    assert store.revision(job) == 0
    assert store.save_decisions(job, [good], 0) == 1
    with pytest.raises(Conflict):
        store.save_decisions(job, [good], 0)
    with pytest.raises(Conflict):
        store._publish(job, 1, {})
    assert [h["revision"] for h in store.history(job)] == [1]


def test_a_writer_that_dies_leaves_nothing(store, job, monkeypatch):
    good = {"segment_id": "S000001", "choice": "A", "reason": "heard"}

    def dies(text, target):
        stream = store._fs.create(store._path(f"{store.folder}/parts/half"), False)
        stream.write(bytearray(text[:9].encode()))
        stream.close()
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(store, "_put", dies)
        with pytest.raises(OSError, match="gone"):  # rows and half a commit are written, nothing is published
            store.save_decisions(job, [good], 0)
    assert store.revision(job) == 0 and store.history(job) == []
    assert {r["id"]: r["decision"]["status"] for r in store.segments(job).collect()}["S000001"] == "pending"
    assert store.save_decisions(job, [good], 0) == 1
    assert {r["id"]: r["decision"]["text"] for r in store.segments(job).collect()}["S000001"] == "нестационарных данных"


def test_other_errors_are_no_conflicts(store, job, monkeypatch):
    monkeypatch.setattr(store, "folder", "nofs://nowhere/x")
    with pytest.raises(Exception) as e:
        store._put("{}", "nofs://nowhere/x/commits/a-000000001.json")
    assert not isinstance(e.value, Conflict)


def test_one_scan_for_all_commits(store, job):
    for i in range(5):
        store.save_decisions(job, [{"segment_id": "S000001", "choice": "edited", "text": f"v{i}", "reason": "r"}], i)
    rows = store._rows("decisions", job)
    assert sorted((r["revision"], r["text"]) for r in rows.collect()) == [(i + 1, f"v{i}") for i in range(5)]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1


@pytest.mark.parametrize("change", [{"reason": " "}, {"choice": "C"}, {"choice": "edited", "text": " "}, {"choice": "uncertain"}, {"origin": "robot"}])
def test_bad_decisions(store, job, change):
    with pytest.raises(ValueError):
        store.save_decisions(job, [{"segment_id": "S000001", "choice": "A", "reason": "r", **change}], 0)


def test_uncertain_draft_then_final(store, job, spark):
    store.save_decisions(job, [{"segment_id": "S000001", "choice": "uncertain", "reason": "noise", "question": "which?"}], 0)
    with pytest.raises(ValueError, match="unresolved"):
        review.export(store, job)
    draft = review.export(store, job, allow_draft=True)
    assert draft["draft"] and "which?" in files.read_text(spark, draft["paths"]["markdown"])
    store.save_decisions(job, [{"segment_id": "S000001", "choice": "edited", "text": "готово", "reason": "asked", "origin": "user"}], 1)
    final = review.export(store, job)
    assert files.read_text(spark, final["paths"]["srt"]) == "1\n00:00:00,000 --> 00:00:10,000\nготово\n\n2\n00:00:10,000 --> 00:00:20,000\nряд\n"
    audit = files.read_json(spark, final["paths"]["audit"])
    assert len(audit["history"]) == 2 and audit["segments"][0]["variants"] == {"A": "нестационарных данных", "B": "стационарных данных"} and audit["segments"][1]["window"] == {"start": 10.0, "end": 20.0}
    assert audit["unresolved"] == [] and "timing" in audit and audit["request"]["profile"] == "general"
    assert files.read_text(spark, draft["paths"]["text"])  # earlier revisions stay


def test_materials(store, job):
    revision, ids = store.save_materials(job, [MATERIAL], 0)
    assert revision == 1
    store.save_decisions(job, [{"segment_id": "S000001", "choice": "B", "reason": "slides"}], 1)
    assert store.save_materials(job, [{**MATERIAL, "id": ids[0], "original_text": None, "text": "better"}], 2)[0] == 3
    page = review.get_references(store, job)
    assert page["total"] == 1 and page["references"][0]["text"] == "better" and [h["revision"] for h in page["history"]] == [1, 3]
    segments = review.get_segments(store, job, limit=1)
    assert segments["segments"][0]["reference_ids"] == ids and segments["total"] == 2 and segments["next_offset"] == 1
    assert [n["id"] for n in segments["segments"][0]["neighbours"]] == ["S000002"]
    assert segments["reference_count"] == 1 and segments["other_reference_count"] == 0


BAD = [
    {"text": ""}, {"reason": " "}, {"original_text": None}, {"title": "", "source": ""}, {"usage": "maybe"}, {"origin": "x"}, {"confirmed_by": "x"}, {"window": None},
    {"window": [1]}, {"window": [2, 1]}, {"window": [-1, 1]}, {"window": [0, float("nan")]}, {"window": [True, 2]}, {"window": [1, 30]}, {"id": "zz"}, {"id": "0" * 32},
]


@pytest.mark.parametrize("change", BAD)
def test_bad_materials(store, job, change):
    with pytest.raises(ValueError):
        store.save_materials(job, [{**MATERIAL, **change}], 0)
    assert store.revision(job) == 0


def test_pages_and_filters(store, job):
    only = review.get_segments(store, job, unresolved_only=True, reverse_order=True)
    assert [s["id"] for s in only["segments"]] == ["S000001"] and only["total"] == 1 and only["next_offset"] is None
    assert list(only["segments"][0]["variants"]) == ["B", "A"] and only["segments"][0]["neighbours"][0]["id"] == "S000002"
    assert review.status(store, job)["unresolved"] == 1
    for bad in ({"offset": -1}, {"limit": 0}, {"limit": 21}):
        with pytest.raises(ValueError):
            review.get_segments(store, job, **bad)


def test_newest_jobs(store):
    ids = [store.create({**REQUEST, "n": i, "audio_path": f"/{i % 2}.wav"})[0] for i in range(3)]
    assert [r["id"] for r in store.jobs(2).collect()] == ids[:0:-1]
    assert {r["id"] for r in store.jobs(audio_path="/0.wav").collect()} == {ids[0], ids[2]}


def _edit(text, segment="S000001"):
    return {"segment_id": segment, "choice": "edited", "text": text, "reason": "r"}


def test_a_pinned_reader_sees_one_revision(store, job):
    """A commit between two reads shows in neither of a snapshot's tables, histories or counts."""
    store.save_materials(job, [MATERIAL], 0)
    at = store.at(job)
    before = at.segments().where("id = 'S000001'").first()["decision"]["status"]
    store.save_decisions(job, [_edit("later")], 1)
    store.save_materials(job, [{**MATERIAL, "title": "Other"}], 2)
    assert at.revision == 1 and before == at.segments().where("id = 'S000001'").first()["decision"]["status"] == "pending"
    assert at.materials().count() == 1 and at.history() == [] and [h["revision"] for h in at.reference_history()] == [1]
    now = store.at(job)
    assert now.revision == 3 and now.materials().count() == 2 and [h["revision"] for h in now.history()] == [2] and [h["revision"] for h in now.reference_history()] == [1, 3]


def test_exports_are_one_revision(store, job, spark, monkeypatch):
    """A writer that comes while an export is being written changes nothing in it, its name included."""
    from spanloom.operators import review as r

    plain = r.export_rows

    def and_a_commit(segments, keys=()):
        out = plain(segments, keys)
        store.save_decisions(job, [_edit("later")], 1)
        return out

    store.save_decisions(job, [_edit("first")], 0)
    monkeypatch.setattr(r, "export_rows", and_a_commit)
    made = r.export(store, job)
    audit = files.read_json(spark, made["paths"]["audit"])
    assert made["revision"] == audit["revision"] == 1 and len(audit["history"]) == 1 and audit["segments"][0]["decision"]["text"] == "first" and audit["reference_history"] == []
    assert "first" in files.read_text(spark, made["paths"]["text"]) and store.revision(job) == 2
    monkeypatch.undo()
    assert r.export(store, job, revision=1)["paths"] == made["paths"]  # an earlier revision can be exported later


def test_earlier_revisions(store, job):
    for i in range(4):
        store.save_decisions(job, [_edit(f"v{i}")], i)
    assert [store.at(job, n).segments().where("id = 'S000001'").first()["decision"]["text"] for n in range(5)] == [None, "v0", "v1", "v2", "v3"]
    for bad in (-1, 5):
        with pytest.raises(ValueError, match="unknown revision"):
            store.at(job, bad)


def test_checkpoints_bound_what_a_reader_opens(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store", compact_after=3)
    job, _ = store.create(REQUEST)
    store.initialize(job, _segments(spark))
    for i in range(8):
        store.save_decisions(job, [_edit(f"v{i}")], i)
        assert len(store.pin(job).parts) <= 3
    assert store._numbers("checkpoints", job) == [3, 6]
    assert [len(store.pin(job, n).parts) for n in range(9)] == [0, 1, 2, 1, 2, 3, 1, 2, 3]
    rows = store._rows("decisions", job)
    assert sorted((r["revision"], r["text"]) for r in rows.collect()) == [(i + 1, f"v{i}") for i in range(8)]
    assert [store.at(job, n).segments().where("id = 'S000001'").first()["decision"]["text"] for n in (2, 3, 4, 7)] == ["v1", "v2", "v3", "v6"]
    assert store.compact(job) == 8 and store.compact(job) == 8  # again: the same, left unread
    assert len(store.pin(job).parts) == 1 and store._rows("decisions", job).count() == 8 and len(store.history(job)) == 8


def test_a_checkpoint_that_fails_leaves_the_commit(store, job, monkeypatch):
    monkeypatch.setattr(store, "compact_after", 1)
    monkeypatch.setattr(store, "compact", lambda *a: (_ for _ in ()).throw(OSError("disk")))
    with pytest.warns(UserWarning, match="disk"):
        assert store.save_decisions(job, [_edit("x")], 0) == 1
    assert store.segments(job).where("id = 'S000001'").first()["decision"]["text"] == "x"


def test_a_gap_in_the_listing_ends_what_counts(store, job, monkeypatch):
    for i in range(3):
        store.save_decisions(job, [_edit(f"v{i}")], i)
    plain = store._numbers
    monkeypatch.setattr(store, "_numbers", lambda folder, scope: [n for n in plain(folder, scope) if (scope, n) != (job, 2)])
    assert store.at(job).revision == 1


def test_bulk_decisions(store, job, spark):
    kind = "segment_id string, choice string, text string, origin string, reason string, question string"
    rows = [("S000001", "B", None, None, "heard", None), ("S000002", "uncertain", None, "user", "noise", "which?")]
    assert store.import_decisions(job, spark.createDataFrame(rows, kind), 0) == 1
    got = {r["id"]: r["decision"] for r in store.segments(job).collect()}
    assert (got["S000001"]["text"], got["S000001"]["origin"], got["S000001"]["status"]) == ("стационарных данных", "agent", "resolved")
    assert (got["S000002"]["text"], got["S000002"]["question"], got["S000002"]["status"]) == (None, "which?", "uncertain")
    with pytest.raises(Conflict):
        store.import_decisions(job, spark.createDataFrame(rows, kind), 0)
    with pytest.raises(ValueError, match="duplicate"):
        store.import_decisions(job, spark.createDataFrame(rows[:1] * 2, kind), 1)
    assert store.revision(job) == 1


def test_bulk_rules_are_those_of_batches(store, job, spark):
    """Every combination of good and bad fields, as a table and as a list."""
    from itertools import product

    from spanloom.sources.store import decision_problems

    kind = "segment_id string, choice string, text string, origin string, reason string, question string"
    segments = store.at(job).segments().select("id", "variants")
    for i, (segment, choice) in enumerate(product(["S000001", "S9"], ["A", "edited", "uncertain", "C", None])):
        rows = [(f"{segment}", choice, t, o, r, q) for t, o, r, q in product([None, " ", "t"], ["user", "robot"], ["", "r"], ["\u00a0", "q"])]
        expected = sorted(e for r in rows for e in store.decision_errors(job, [dict(zip(("segment_id", "choice", "text", "origin", "reason", "question"), r, strict=True))]))
        named = [(f"{segment}", *r[1:]) for r in rows]
        got = decision_problems(spark.createDataFrame(named, kind), segments).where("problem NOT LIKE 'duplicate%'").collect()
        assert sorted(f"{r['segment_id']}: {r['problem']}" for r in got) == expected, i


def test_text_is_replaced_at_once(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t.txt"
    files.write_text(spark, path, "old")
    plain = files._at

    class Dies:
        """A file system that is gone when the new text is complete."""

        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def getUri(self):
            raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(files, "_at", lambda s, p: (plain(s, p)[0], Dies(plain(s, p)[1])))
        with pytest.raises(OSError, match="gone"):
            files.write_text(spark, path, "new")
    assert files.read_text(spark, path) == "old"
    files.write_text(spark, path, "new")
    assert files.read_text(spark, path) == "new"


def test_two_writers_of_a_stage(spark, tmp_path, monkeypatch):
    """Both find the key missing and both write it: readers take the first one published, before and after."""
    cache = files.StageCache(spark, f"file://{tmp_path}/cache", "v int")
    wanted = spark.createDataFrame([("a",), ("b",)], "key_sha string")
    monkeypatch.setattr(cache, "missing", lambda stage, rows: rows)  # what both saw before either wrote
    cache.add("asr", spark.createDataFrame([("a", 1)], "key_sha string, v int"))
    before = cache.lookup("asr", wanted).where("v IS NOT NULL").collect()
    cache.add("asr", spark.createDataFrame([("a", 9), ("b", 2)], "key_sha string, v int"))
    assert {r["key_sha"]: r["v"] for r in before} == {"a": 1}
    assert sorted((r["key_sha"], r["v"]) for r in cache.lookup("asr", wanted).collect()) == [("a", 1), ("b", 2)]


def test_a_name_is_taken_once(spark, tmp_path):
    files.put_once(spark, f"file://{tmp_path}/d/x.json", "1")
    with pytest.raises(FileExistsError):
        files.put_once(spark, f"file://{tmp_path}/d/x.json", "2")
    assert files.read_text(spark, f"file://{tmp_path}/d/x.json") == "1" and [p.name for p in (tmp_path / "d").iterdir() if not p.name.startswith(".")] == ["x.json"]


def test_results_of_another_request(spark, tmp_path):
    path = f"file://{tmp_path}/r/request.json"
    assert not files.same_request(spark, path, {"model": "a", "limits": (1, 2)})
    assert files.same_request(spark, path, {"limits": [1, 2], "model": "a"})
    with pytest.raises(ValueError, match="another request"):
        files.same_request(spark, path, {"model": "b", "limits": [1, 2]})


def test_stage_cache(spark, tmp_path):
    cache = files.StageCache(spark, f"file://{tmp_path}/cache", "v int")
    wanted = spark.createDataFrame([("a",), ("b",)], "key_sha string")
    assert cache.missing("asr", wanted).count() == 2
    cache.add("asr", spark.createDataFrame([("a", 1)], "key_sha string, v int"))
    cache.add("asr", spark.createDataFrame([("a", 9), ("b", 2)], "key_sha string, v int"))
    assert {r["key_sha"]: r["v"] for r in cache.lookup("asr", wanted).collect()} == {"a": 1, "b": 2}
    assert files.cache_key({"b": 1, "a": "ё"}) == files.cache_key({"a": "ё", "b": 1})


def test_reuse_checks_bounds(spark):
    wanted = spark.createDataFrame([(0, 1.0), (1, 2.0)], "i int, start double")
    stored = spark.createDataFrame([(0, 1.0, "x")], "i int, start double, text string")
    assert {r["i"]: r["text"] for r in files.reuse(wanted, stored, ["i"], ["start"]).collect()} == {0: "x", 1: None}
    with pytest.raises(Exception, match="other bounds"):
        files.reuse(wanted, stored.withColumn("start", stored.start + 1), ["i"], ["start"]).collect()


def test_files(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    files.write_json(spark, f"{path}/b.json", {"name": "b"})
    files.write_json(spark, f"{path}/a.json", {"name": "a"})
    files.write_json(spark, f"{path}/a.json", {"name": "a2"})
    assert [r["name"] for r in files.profiles(spark, path).collect()] == ["a2", "b"]
    assert files.digests(spark, f"{path}/a.json").count() == 1
