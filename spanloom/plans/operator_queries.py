"""The library's review, alignment, layout and store operators over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions.text import ends_sentence, identities
from spanloom.operators import alignment as A
from spanloom.operators import layouts
from spanloom.operators import partitioning as P
from spanloom.operators import reconcile as R
from spanloom.operators import review, subtitles
from spanloom.operators.sequences import newest
from spanloom.plans.review_queries import CORE, _aligned, _words
from spanloom.plans.scratch import scratch_dir
from spanloom.sources.store import Store, decision_problems
from spanloom.sources.tables import read

WORDS = "array<struct<text:string,start_time:double,end_time:double>>"


def word_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Words of chunks in absolute time, with margin and owner."""
    found = R.word_rows(_aligned(_words(spark, folder)))
    return found.select("rec_id", F.col("chunk_idx").cast("int").alias("chunk_idx"), F.col("pos").cast("long").alias("pos"), F.round("start", 4).alias("start"), F.round("end", 4).alias("end"), "text", F.round("margin", 4).alias("margin"), "owner")


def seam_merge_jittered(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that hear each word at times of their own: what overlaps is merged, and every word comes back once."""
    off = F.pmod(F.col("w").getField("start_time") * 20 + F.col("chunk_idx") * 7, F.lit(5)) / 100 - 0.02
    moved = F.struct(F.col("w.text").alias("text"), (F.col("w.start_time") + off).alias("start_time"), (F.col("w.end_time") + off).alias("end_time"))
    rows = _aligned(_words(spark, folder)).select("rec_id", "chunk_idx", "chunk", F.posexplode("words").alias("i", "w")).select("rec_id", "chunk_idx", "chunk", F.struct("i", moved.alias("w")).alias("w"))
    chunks = rows.groupBy("rec_id", "chunk_idx", "chunk").agg(F.transform(F.sort_array(F.collect_list("w")), lambda x: x["w"]).alias("words"))
    merged = R.merge_recordings(chunks)
    parts = F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"])
    return merged.groupBy("rec_id").agg(F.count("*").alias("n"), F.array_join(parts, " ").alias("text"))


def seam_repairs(spark: SparkSession, folder: str) -> DataFrame:
    """Three words of a turn at a seam, in six ways, by turns, that each call for another repair: what is read, and its audit."""
    t = read(spark, folder, "conversations").where("role = 'assistant'").withColumn("w", F.expr("regexp_extract_all(lower(text), '([a-z]+)', 1)"))
    three = t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("rec"), "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w").cast("int"), F.lit(3)) - 3, F.lit(3))).alias("k"))
    three = three.select((F.col("rec") * 10_000 + F.col("k")).alias("rec_id"), *[F.get("w", F.col("k") + i).alias(n) for i, n in enumerate("abc")])
    three = three.where("length(a) >= 3 AND length(b) >= 5 AND length(c) >= 4 AND a <> b AND b <> c AND a <> c AND right(a, 1) <> left(b, 1)")
    a, b, c = F.col("a"), F.col("b"), F.col("c")

    def word(text: Column, start: float, end: float, chunk: float = 0.0) -> Column:
        return F.struct(text.alias("text"), F.lit(start - chunk).alias("start_time"), F.lit(end - chunk).alias("end_time"))

    def side(chunk: float, *words: tuple) -> Column:
        return F.array(*[word(t, low, high, chunk) for t, low, high in words])

    stem = F.left(c, F.lit(3))
    # Where a copy has a letter in front, the word before lasts over half as long: else, if it ends as the copy begins, it is the first that a repair fits.
    cases = (
        (side(0, (a, 9.2, 9.5), (b, 9.5, 9.9)), side(9, (a, 9.2, 9.5), (b, 9.5, 9.9))),
        (side(0, (a, 9.2, 9.5), (b, 9.5, 9.9)), side(9, (a, 11.2, 11.5), (b, 11.5, 11.9))),
        (side(0, (a, 9.1, 9.8), (b, 10.05, 10.35), (c, 10.4, 10.6)), side(9, (F.concat(F.lit("x"), b), 9.2, 10.4), (c, 10.4, 10.62))),
        (side(0, (a, 9.3, 9.95), (b, 10.05, 10.4), (stem, 10.45, 10.6)), side(9, (F.concat(F.lit("e"), b), 9.3, 10.5), (c, 10.45, 10.9))),
        (side(0, (a, 9.0, 9.4), (stem, 10.85, 10.98)), side(9, (F.concat(F.right(a, F.lit(2)), b), 9.1, 10.7), (c, 10.85, 11.3))),
        (side(0, (a, 9.0, 9.4), (F.concat_ws(" ", c, b, c), 10.05, 10.6)), side(9, (c, 10.3, 10.55), (a, 10.75, 10.95))),
    )
    kind = F.expr("rec_id div 3 % 6")
    both = F.array(*[F.array(*x) for x in cases])
    bounds = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("start", "end", "core_start", "core_end"), x, strict=True)]) for x in ((0.0, 11.0, 0.0, 10.0), (9.0, 20.0, 10.0, 20.0))])
    chunks = three.select("rec_id", F.posexplode(F.get(both, kind)).alias("chunk_idx", "words")).select("rec_id", "chunk_idx", F.get(bounds, "chunk_idx").alias("chunk"), F.col("words").cast(WORDS).alias("words"))
    words, audit = R.reconciled(chunks)
    read_out = words.groupBy("rec_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("text"))
    return read_out.join(audit, "rec_id", "left").select("rec_id", "text", "reason", "phrase", "kept_chunk", F.size("removed").alias("removed"), F.array_join(F.array_sort(F.map_values("evidence")), ",").alias("evidence"))


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    """Assistant turns as aligned words: every third has no length, and the audio of some ends early."""
    w = _words(spark, folder)
    word = F.struct("i", F.struct(F.col("word").alias("text"), F.col("start").alias("start_time"), F.when(F.col("i") % 3 == 1, F.col("start")).otherwise(F.col("end")).alias("end_time")).alias("w"))
    lists = w.groupBy("rec").agg(F.transform(F.sort_array(F.collect_list(word)), lambda x: x["w"]).cast(WORDS).alias("words"))
    return lists.withColumn("seconds", F.size("words") * 0.5 - F.col("rec") % 3)


def alignment_valid(spark: SparkSession, folder: str) -> DataFrame:
    t = _turns(spark, folder)
    clipped = A.clipped(F.col("words"), F.col("seconds"))
    return t.select("rec", A.valid(F.col("words"), F.col("seconds")).alias("valid"), F.round(F.aggregate(clipped, F.lit(0.0), lambda a, w: a + w["end_time"]), 4).alias("ends"))


def original_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The transcript's tokens where it has as many as the aligner; here a mark tells them apart, and odd turns have one more."""
    t = _turns(spark, folder)
    text = F.concat_ws(" ", F.transform("words", lambda w: F.concat(w["text"], F.lit("~"))), F.when(F.col("rec") % 2 == 1, F.lit("MORE")))
    return t.select("rec", F.array_join(F.transform(A.original_texts(F.col("words"), text), lambda w: w["text"]), " ").alias("text"))


def measured_words(spark: SparkSession, folder: str) -> DataFrame:
    found = A.measured_words(F.col("words"))
    return _turns(spark, folder).select("rec", F.array_join(F.transform(found, lambda w: w["text"]), "|").alias("text"))


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    d = read(spark, folder, "events").groupBy("user_id").agg(F.max("value").alias("seconds"))
    return P.fixed_layout(d, "seconds").select("user_id", F.col("chunk_idx").cast("int").alias("chunk_idx"), "start", "end", "core_start", "core_end")


def widened_chunks(spark: SparkSession, folder: str) -> DataFrame:
    regions = read(spark, folder, "nation").select(F.col("n_nationkey").cast("long").alias("user_id"), (F.col("n_nationkey") * 2.0).alias("a"), (F.col("n_nationkey") * 2.0 + 60).alias("b"))
    regions = regions.union(regions.selectExpr("user_id", "a - 3", "b + 30"))
    found = A.widened(_chunks(spark, folder), regions, ["user_id"])
    return found.select("user_id", "chunk_idx", "wider", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"))


def chunk_lengths(spark: SparkSession, folder: str) -> DataFrame:
    found = A.lengths(_chunks(spark, folder), ["user_id"])
    return found.select("user_id", "n", *[F.round(F.col(f"{f}_{kind}") + 1e-9, 4).alias(f"{f}_{kind}") for kind in ("core", "input") for f in ("least", "mean", "most")])


def chunk_progress(spark: SparkSession, folder: str) -> DataFrame:
    chunks = _chunks(spark, folder)
    return A.progress(chunks, chunks.where("chunk_idx % 3 <> 1"), ["user_id"], 2)


def region_words(spark: SparkSession, folder: str) -> DataFrame:
    """Words in regions that take turns: seven seconds from every tenth on."""
    w = _words(spark, folder)
    regions = w.groupBy("rec").agg(F.max("end").alias("n")).select("rec", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / 10).cast("int"))).alias("k")).select("rec", (F.col("k") * 10.0).alias("a"), (F.col("k") * 10.0 + 7.3).alias("b"))
    found = subtitles.region_words(w.select("rec", "i", "word", "start", "end"), regions, ["rec"])
    return found.select("rec", F.col("i").cast("int").alias("i"), "word", F.round("region", 3).alias("region"), F.round("start", 4).alias("start"), F.round("end", 4).alias("end"))


def compare_channels(spark: SparkSession, folder: str) -> DataFrame:
    """Two channels, the second with every fifth word changed, dealt to the cores that hold their words' middles."""
    w = _words(spark, folder).withColumnRenamed("rec", "rec_id")
    a = w.select("rec_id", F.lit("A").alias("channel"), F.col("i").alias("pos"), "start", "end", F.col("word").alias("text"))
    b = a.withColumn("channel", F.lit("B")).withColumn("text", F.when(F.col("pos") % 5 == 2, F.lit("other")).otherwise(F.col("text")))
    chunks = P.fixed_layout(w.groupBy("rec_id").agg(F.max("end").alias("seconds")), "seconds", CORE).select("rec_id", "chunk_idx", "core_start", "core_end")
    transcripts = chunks.select("rec_id", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("channel"), "chunk_idx", F.lit("raw").alias("text"))
    found = subtitles.compare_rows(a.unionByName(b), chunks, transcripts)
    variant = lambda c: F.col("variants")[c]["text"].alias(c.lower())
    return found.select("rec_id", "id", F.col("chunk_idx").cast("int").alias("chunk_idx"), variant("A"), variant("B"), (F.size("conflicts") > 0).alias("differ"))


def _frames(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as frames of five recordings, whose energies are their prices."""
    o = read(spark, folder, "orders")
    return o.select((F.col("o_orderkey") % 5).alias("rec"), F.expr("o_orderkey div 5").alias("frame"), F.col("o_totalprice").alias("energy"))


def _timelines(frames: DataFrame) -> DataFrame:
    return frames.groupBy("rec").agg((F.max("frame") + 1).alias("n"))


def _speech(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of speech: ten frames from every third urgent order on."""
    o = read(spark, folder, "orders").where("o_orderpriority = '1-URGENT' AND o_orderkey % 3 = 0")
    return o.select((F.col("o_orderkey") % 5).alias("rec"), F.expr("o_orderkey div 5").alias("a"), F.expr("o_orderkey div 5 + 10").alias("b"))


def region_layout(spark: SparkSession, folder: str) -> DataFrame:
    """Two regions of each recording, in cores of 1.6 seconds at most."""
    frames = _frames(spark, folder)
    n = F.col("n")
    spans = F.array(F.struct(F.lit(10).cast("long").alias("a"), F.expr("n * 2 div 3").alias("b")), F.struct(F.expr("n * 2 div 3 + 3").alias("a"), n.alias("b")))
    regions = _timelines(frames).select("rec", F.explode(spans).alias("s")).select("rec", "s.a", "s.b")
    return layouts.region_chunks(frames, regions, ["rec"], 1.6).select("rec", "region", "chunk_idx", *[F.round(c, 4).alias(c) for c in ("start", "end", "core_start", "core_end")])


def sliding_layout(spark: SparkSession, folder: str) -> DataFrame:
    """Whole recordings in cores of 1.8 seconds at most, where there is speech."""
    frames = _frames(spark, folder)
    found = layouts.sliding_chunks(frames, _timelines(frames), _speech(spark, folder), ["rec"], 1.8, 0.4)
    return found.select("rec", "chunk_idx", *[F.round(c, 4).alias(c) for c in ("start", "end", "core_start", "core_end")])


def packed_layout(spark: SparkSession, folder: str) -> DataFrame:
    """Padded recordings in as few cores of 0.6 to 1.18 seconds as hold them, where there is speech."""
    frames = _frames(spark, folder)
    found = layouts.packed_chunks(frames, _timelines(frames), _speech(spark, folder), ["rec"], 0.6, 1.18, 0.5)
    return found.select("rec", "chunk_idx", *[F.round(c, 4).alias(c) for c in ("start", "end", "core_start", "core_end")])


def halved_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of three seconds, each cut in two near its middle."""
    frames = _frames(spark, folder)
    chunks = P.fixed_layout(_timelines(frames).withColumn("seconds", F.col("n") / 100), "seconds", 3.0).where("core_end - core_start > 2")
    found = layouts.split_chunks(frames, chunks.select("rec", "chunk_idx", "start", "end", "core_start", "core_end"), ["rec"])
    return found.select("rec", "chunk_idx", "part", *[F.round(c, 4).alias(c) for c in ("start", "end", "core_start", "core_end")])


def silenced_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Frames with the speech taken out."""
    found = layouts.silenced(_frames(spark, folder), _speech(spark, folder), ["rec"], 500)
    return found.select("rec", "frame", F.round("energy", 2).alias("energy"))


def content_identity(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of orders by their canonical JSON."""
    o = read(spark, folder, "orders")
    return o.select("o_orderkey", identities({"status": F.col("o_orderstatus"), "key": F.col("o_orderkey"), "priority": F.col("o_orderpriority"), "né": F.when(F.col("o_orderkey") % 2 == 0, F.lit('a"b'))}).alias("id"))


def _decided(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as segments of their customers' jobs, some without a decision."""
    o = read(spark, folder, "orders")
    k = F.col("o_orderkey")
    low = (k % 10_000).cast("double")
    name = F.concat(F.lit("S"), F.lpad(k.cast("string"), 9, "0"))
    is_open = F.col("o_orderstatus") == "P"
    decision = F.struct(F.when(is_open, "pending").otherwise("resolved").alias("status"), F.when(~is_open, F.when(k % 7 == 0, F.lit("  ")).otherwise(F.col("o_orderpriority"))).alias("text"), F.when(k % 2 == 0, F.lit("which?")).otherwise(F.lit("")).alias("question"))
    return o.select(F.col("o_custkey").alias("job"), name.alias("id"), F.struct(low.alias("start"), (low + 1.5).alias("end")).alias("window"), F.create_map(F.lit("A"), F.col("o_orderpriority"), F.lit("B"), F.lower("o_orderpriority")).alias("variants"), decision.alias("decision"))


def export_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The files of each job, and how many of its segments are unresolved."""
    found = review.export_rows(_decided(spark, folder), ["job"])
    return found.select("job", "markdown", "text", "srt", F.size("unresolved").cast("long").alias("unresolved"))


def _store(spark: SparkSession, folder: str) -> tuple[Store, str]:
    """A store with one job: nations as segments, of which every third has variants that agree, a batch of decisions, and materials."""
    store = Store(spark, f"{scratch_dir(spark)}/spanloom/store-{uuid.uuid4().hex}")
    job, _ = store.create({"audio_path": "/nations", "duration": 100.0})
    k = F.col("n_nationkey")
    name = F.concat(F.lit("S"), F.lpad(k.cast("string"), 6, "0"))
    variants = F.create_map(F.lit("A"), F.col("n_name"), F.lit("B"), F.when(k % 3 == 0, F.col("n_name")).otherwise(F.lower("n_name")))
    store.initialize(job, read(spark, folder, "nation").select(name.alias("id"), F.struct((k * 4.0).alias("start"), (k * 4.0 + 4).alias("end")).alias("window"), variants.alias("variants"), F.lit("{}").alias("data")))
    store.save_decisions(job, [{"segment_id": f"S{i:06d}", "choice": "B", "reason": "heard"} for i in (1, 2, 4)], 0)
    store.save_decisions(job, [{"segment_id": "S000002", "choice": "edited", "text": "Second", "reason": "asked", "origin": "user"}, {"segment_id": "S000005", "choice": "uncertain", "reason": "noise", "question": "which?"}], 1)
    material = {"title": "Slides", "original_text": "raw", "text": "one", "reason": "given", "usage": "both", "origin": "user", "confirmed_by": "user"}
    _, ids = store.save_materials(job, [{**material, "window": [6, 14]}, {**material, "window": [20, 21], "text": "two"}], 2)
    store.save_materials(job, [{**material, "id": ids[0], "original_text": None, "text": "better", "window": [6, 14]}], 3)
    return store, job


def store_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Segments with the newest of their decisions."""
    store, job = _store(spark, folder)
    return store.segments(job).select("id", "decision.status", "decision.choice", "decision.text", "decision.origin", "decision.reason", "decision.question")


def review_page(spark: SparkSession, folder: str) -> DataFrame:
    """Unresolved segments with their places among those, neighbours in the whole list, and the texts of the materials that overlap them."""
    store, job = _store(spark, folder)
    at = store.at(job)
    rows = review.segment_rows(at, unresolved_only=True)
    texts = at.materials().select(F.col("id").alias("material"), F.col("text").alias("note"))
    named = rows.select("id", F.explode("reference_ids").alias("material")).join(texts, "material").groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("note")), ",").alias("notes"))
    return rows.join(named, "id", "left").select("id", F.col("place").cast("long").alias("place"), "total", F.col("previous.id").alias("previous"), F.col("following.id").alias("following"), "notes")


def _customer_segments(spark: SparkSession, folder: str) -> DataFrame:
    c = read(spark, folder, "customer")
    k = F.col("c_custkey")
    variants = F.create_map(F.lit("A"), F.col("c_mktsegment"), F.lit("B"), F.when(F.col("c_nationkey") % 3 == 0, F.col("c_mktsegment")).otherwise(F.lower("c_mktsegment")))
    return c.select(F.concat(F.lit("S"), F.lpad(k.cast("string"), 9, "0")).alias("id"), F.struct((k * 4.0).alias("start"), (k * 4.0 + 4).alias("end")).alias("window"), variants.alias("variants"), F.lit("{}").alias("data"), "c_acctbal")


def _order_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as decisions on their customers' segments, by status."""
    o = read(spark, folder, "orders")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    choice = F.when(status == "F", F.lit("B")).when(status == "O", F.lit("edited")).otherwise(F.lit("uncertain"))
    return o.select(F.concat(F.lit("S"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("segment_id"), choice.alias("choice"), priority.alias("text"), F.when(F.col("o_orderkey") % 2 == 0, "user").otherwise("agent").alias("origin"), F.lit("ordered").alias("reason"), priority.alias("question"), F.year("o_orderdate").alias("year"), "o_orderkey", "o_totalprice")


def order_log_at(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as a log of decisions, a commit a year, with checkpoints on the way: customers' segments as they were after 1999."""
    store = Store(spark, f"{scratch_dir(spark)}/spanloom/store-{uuid.uuid4().hex}", compact_after=3)
    job, _ = store.create({"audio_path": "/customers"})
    store.initialize(job, _customer_segments(spark, folder).drop("c_acctbal"))
    decisions = _order_decisions(spark, folder)
    known = store.at(job).segments().select(F.col("id").alias("segment_id"))
    for i, year in enumerate(range(1995, 2002)):
        last = newest(decisions.where(F.col("year") == year), ["segment_id"], ["o_orderkey"]).join(known, "segment_id", "left_semi")
        store.import_decisions(job, last.select("segment_id", "choice", "text", "origin", "reason", "question"), i)
    return store.at(job, 5).segments().select("id", "decision.status", "decision.choice", "decision.text", "decision.origin", "decision.question")


def material_history(spark: SparkSession, folder: str) -> DataFrame:
    """All versions, by revision, of the materials that are chosen by their newest text: suppliers, of whom some are changed twice."""
    store = Store(spark, f"{scratch_dir(spark)}/spanloom/store-{uuid.uuid4().hex}", compact_after=2)
    job, _ = store.create({"audio_path": "/suppliers"})
    s = read(spark, folder, "supplier")
    fixed = [F.lit(x).alias(n) for n, x in (("source", ""), ("usage", "context"), ("origin", "agent"), ("confirmed_by", "none"), ("reason", "given"))]
    rows = s.select(F.md5(F.col("s_suppkey").cast("string").cast("binary")).alias("id"), F.col("s_name").alias("title"), F.col("s_name").alias("original_text"), F.col("s_name").alias("text"), F.lit(None).cast("struct<start:double,end:double>").alias("window"), *fixed, "s_acctbal", "s_nationkey")
    store.import_materials(job, rows, 0)
    store.import_materials(job, rows.where("s_acctbal < 3000").withColumn("text", F.lower("text")), 1)
    store.import_materials(job, rows.where("s_nationkey % 2 = 0").withColumn("text", F.concat("text", F.lit("!"))), 2)
    at = store.at(job)
    chosen = at.materials().where("text LIKE '%!' OR text = lower(text)").select("id")
    return at.material_history().join(chosen, "id", "left_semi").select("id", F.col("revision").cast("long").alias("revision"), "original_text", "text")


def decision_errors(spark: SparkSession, folder: str) -> DataFrame:
    """What is wrong with orders as decisions on the segments of customers in credit, several a customer."""
    cheap, late = F.col("o_totalprice") < 60_000, F.col("year") > 1999
    given = _order_decisions(spark, folder).withColumns({
        "text": F.when(cheap, F.lit(" ")).otherwise(F.col("text")),
        "question": F.when(~cheap, F.col("question")),
        "reason": F.when(F.col("text") == "5-LOW", F.lit("\u00a0")).otherwise(F.col("reason")),
        "origin": F.when(F.col("text") == "1-URGENT", F.lit("robot")).otherwise(F.col("origin")),
        "choice": F.when(late & cheap, F.lit("C")).otherwise(F.col("choice")),
    })
    return decision_problems(given, _customer_segments(spark, folder).where("c_acctbal > 0"))


def split_after_marker(spark: SparkSession, folder: str) -> DataFrame:
    """What follows the last mark of a name, or the whole name without one."""
    p = read(spark, folder, "part")
    return p.select("p_partkey", F.element_at(F.split("p_name", " "), -1).alias("last"), F.substring_index("p_brand", "#", -1).alias("number"))


def chunk_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Sets of line numbers of two groups of an order's lines: their union, what they share, and whether they meet."""
    line = read(spark, folder, "lineitem")
    sets = line.groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_quantity") < 30, F.col("l_partkey") % 10)).alias("a"), F.collect_set(F.when(F.col("l_quantity") > 20, F.col("l_partkey") % 10)).alias("b"))
    text = lambda c: F.array_join(F.sort_array(c).cast("array<string>"), ",")
    return sets.select("l_orderkey", text(F.array_union("a", "b")).alias("either"), text(F.array_intersect("a", "b")).alias("both"), F.arrays_overlap("a", "b").alias("meet"))


def array_steps(spark: SparkSession, folder: str) -> DataFrame:
    """Differences, running sums, places above zero, a slice and padding of vectors."""
    e = read(spark, folder, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 8), lambda x: F.rint(x * 10).cast("long")).alias("v"))
    steps = F.zip_with(F.slice("v", 2, 7), F.slice("v", 1, 7), lambda x, y: x - y)
    sums = F.transform(F.sequence(F.lit(1), F.size("v")), lambda i: F.aggregate(F.slice("v", 1, i), F.lit(0).cast("long"), lambda a, x: a + x))
    places = F.filter(F.transform("v", lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())
    padded = F.concat(F.slice("v", 3, 2), F.array_repeat(F.lit(0).cast("long"), 2))
    return e.select("vec_id", *[F.array_join(c.cast("array<string>"), ",").alias(n) for n, c in (("steps", steps), ("sums", sums), ("places", places), ("padded", padded))])


def map_steps(spark: SparkSession, folder: str) -> DataFrame:
    """Lookups in an event's properties by a key that its user says: a value, a default, the keys, whether the key is there, and what a purchase overrides."""
    e = read(spark, folder, "events").withColumn("m", F.from_json("props", "map<string,int>"))
    key = F.when(F.col("user_id") % 2 == 0, F.lit("k")).otherwise(F.col("event_type"))
    change = F.when(F.col("event_type") == "purchase", F.create_map(F.lit("k"), F.rint("value").cast("int"), F.lit("n"), F.col("user_id").cast("int"))).otherwise(F.create_map().cast("map<string,int>"))
    over = F.map_zip_with("m", change, lambda k, x, y: F.coalesce(y, x))
    return e.select("event_id", F.col("m")["k"].alias("k"), F.coalesce(F.col("m")[key], F.lit(-1)).alias("other"), F.array_join(F.array_sort(F.map_keys(over)), ",").alias("keys"), F.map_contains_key("m", key).alias("held"), over["k"].alias("k_over"))


def number_types(spark: SparkSession, folder: str) -> DataFrame:
    """Whether JSON values are whole numbers: ids are, amounts aren't, nor are truth values or objects."""
    e = read(spark, folder, "events")
    kind, value = F.col("event_type"), F.col("value")
    text = F.when(kind == "click", F.col("event_id").cast("string")).when(kind == "purchase", value.cast("string")).when(kind == "view", (value > 100).cast("string")).otherwise(F.col("props"))
    made = F.schema_of_variant(F.parse_json(text))
    return e.select("event_id", (made == "BIGINT").alias("whole"), (made == "BOOLEAN").alias("truth"))


def sliding_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Events an hour, every half hour."""
    e = read(spark, folder, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    return e.groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select(F.unix_seconds("w.start").alias("start"), "n")


def sentence_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Words of turns in runs that end with a sentence: each run's place and words."""
    w = _words(spark, folder).withColumn("ends", ends_sentence(F.col("word")).cast("int"))
    before = Window.partitionBy("rec").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return w.withColumn("run", F.coalesce(F.sum("ends").over(before), F.lit(0).cast("long"))).groupBy("rec", "run").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        word_rows, seam_merge_jittered, seam_repairs, alignment_valid, original_tokens, measured_words, widened_chunks, chunk_lengths, chunk_progress, region_words, compare_channels, region_layout, sliding_layout, packed_layout, halved_chunks, silenced_frames,
        content_identity, export_texts, store_segments, review_page, order_log_at, material_history, decision_errors, split_after_marker, chunk_sets, array_steps, map_steps, number_types, sliding_windows, sentence_runs,
    )
}

_W = r"t AS (SELECT conv_id * 1000 + turn AS rec, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM conversations WHERE role = 'assistant'), x AS (SELECT rec, unnest(w) AS word, unnest(range(0, len(w))) AS i, len(w) AS n FROM t), y AS (SELECT *, i * 0.5::DOUBLE AS s, i * 0.5::DOUBLE + 0.4::DOUBLE AS e, (n - 1) * 0.5::DOUBLE + 0.4::DOUBLE AS seconds FROM x)"
_CUTS = "c AS (SELECT rec, seconds, k, k * 20.0::DOUBLE AS cs, least(seconds, (k + 1) * 20.0::DOUBLE) AS ce FROM (SELECT rec, seconds, unnest(range(0, greatest(1, CAST(ceil(seconds / 20) AS BIGINT)))) AS k FROM (SELECT DISTINCT rec, seconds FROM y))), g AS (SELECT *, greatest(0.0::DOUBLE, cs - 1) AS a, least(seconds, ce + 1) AS b FROM c)"
_D = "d AS (SELECT user_id, max(value) AS seconds FROM events GROUP BY user_id HAVING max(value) > 0), c AS (SELECT user_id, seconds, CAST(unnest(range(0, greatest(1, CAST(ceil(seconds / 18) AS BIGINT)))) AS INTEGER) AS chunk_idx FROM d), g AS (SELECT user_id, chunk_idx, chunk_idx * 18.0::DOUBLE AS cs, least(seconds, (chunk_idx + 1) * 18.0::DOUBLE) AS ce, greatest(0.0::DOUBLE, chunk_idx * 18.0::DOUBLE - 1) AS a, least(seconds, least(seconds, (chunk_idx + 1) * 18.0::DOUBLE) + 1) AS b FROM c)"
_STAMP = "printf('%02d:%02d:%02d,%03d', ({0}) // 3600000, ({0}) // 60000 % 60, ({0}) // 1000 % 60, ({0}) % 1000)"
_O = f"""o AS (SELECT o_custkey AS job, o_orderkey AS k, o_orderstatus = 'P' AS open, (o_orderkey % 10000) * 1000 AS a, o_orderpriority AS p FROM orders),
q AS (SELECT *, CASE WHEN open THEN '[требует уточнения]' WHEN k % 7 = 0 THEN '  ' ELSE p END AS text, {_STAMP.format('a')} AS low, {_STAMP.format('a + 1500')} AS high FROM o), s AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY k) AS i FROM q WHERE trim(text) <> ''),
u AS (SELECT job, count(*) FILTER (WHERE open) AS unresolved FROM o GROUP BY job)"""


_FRAMES = """f AS (SELECT o_orderkey % 5 AS rec, o_orderkey // 5 AS f, CAST(round(o_totalprice, 9) AS DECIMAL(28, 9)) AS e FROM orders), n AS (SELECT rec, max(f) + 1 AS n FROM f GROUP BY rec),
p AS (SELECT o_orderkey % 5 AS rec, o_orderkey // 5 AS a, o_orderkey // 5 + 10 AS b FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 3 = 0)"""
_WINDOWS = "w AS (SELECT rec, f, sum(e) OVER v AS e FROM f WINDOW v AS (PARTITION BY rec ORDER BY f ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) QUALIFY count(*) OVER v = 10)"


def _cut_regions(low: int, high: int) -> str:
    """Cut after cut: the least window of those that begin ``low`` to ``high`` - 10 frames on, while more than ``high`` are left."""
    return f"""r(rec, a, b, pos) AS (SELECT rec, a, b, a FROM g WHERE b > a UNION ALL
SELECT r.rec, r.a, r.b, min({{'e': w.e, 'f': w.f}}).f + 5 FROM r JOIN w ON w.rec = r.rec AND w.f BETWEEN r.pos + {low} AND r.pos + {high - 10} WHERE r.b - r.pos > {high} GROUP BY r.rec, r.a, r.b, r.pos),
c AS (SELECT rec, a, b, pos, coalesce(lead(pos) OVER (PARTITION BY rec, a ORDER BY pos), b) AS next, CAST(row_number() OVER (PARTITION BY rec, a ORDER BY pos) - 1 AS INTEGER) AS i FROM r)"""


def _bounds(low: str, high: str) -> str:
    return f"""round(greatest(({low}) / 100.0::DOUBLE, pos / 100.0::DOUBLE - 1), 4) AS start, round(least(({high}) / 100.0::DOUBLE, next / 100.0::DOUBLE + 1), 4) AS "end", round(pos / 100.0::DOUBLE, 4) AS core_start, round(next / 100.0::DOUBLE, 4) AS core_end"""


_STORE = """g AS (SELECT n_nationkey AS k, 'S' || lpad(CAST(n_nationkey AS VARCHAR), 6, '0') AS id, n_name AS name FROM nation), f AS (SELECT *, CASE WHEN k = 2 THEN 'edited' WHEN k IN (1, 4) THEN 'B' WHEN k = 5 THEN 'uncertain' WHEN k % 3 = 0 THEN 'agreement' END AS choice FROM g)"""

_CUSTOMERS = "c AS (SELECT 'S' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS id, c_acctbal AS bal, c_mktsegment AS a, CASE WHEN c_nationkey % 3 = 0 THEN c_mktsegment ELSE lower(c_mktsegment) END AS b FROM customer)"
_ORDERS = "o AS (SELECT 'S' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS id, o_orderkey AS k, year(o_orderdate) AS year, o_totalprice AS price, o_orderpriority AS p, CASE o_orderstatus WHEN 'F' THEN 'B' WHEN 'O' THEN 'edited' ELSE 'uncertain' END AS choice, CASE WHEN o_orderkey % 2 = 0 THEN 'user' ELSE 'agent' END AS origin FROM orders)"

ORACLE_SQL = {
    "word_rows": f"""WITH {_W}, {_CUTS}, h AS (SELECT *, row_number() OVER (PARTITION BY rec, k ORDER BY i) - 1 AS pos FROM y JOIN g USING (rec) WHERE s >= a AND e <= b)
SELECT rec AS rec_id, CAST(k AS INTEGER) AS chunk_idx, pos, round(a + (s - a), 4) AS start, round(a + (e - a), 4) AS "end", word AS text, round(least((a + (s - a) + a + (e - a)) / 2 - a, b - (a + (s - a) + a + (e - a)) / 2), 4) AS margin, ((a + (s - a) + a + (e - a)) / 2 >= cs AND (a + (s - a) + a + (e - a)) / 2 < ce) AS owner FROM h""",
    "seam_merge_jittered": f"WITH {_W} SELECT rec AS rec_id, CAST(len(w) AS BIGINT) AS n, array_to_string(w, ' ') AS text FROM t WHERE len(w) > 0",
    "seam_repairs": r"""WITH t AS (SELECT conv_id * 1000 + turn AS rec, regexp_extract_all(lower(text), '[a-z]+') AS w FROM conversations WHERE role = 'assistant'), x AS (SELECT rec, w, unnest(range(0, greatest(len(w), 3) - 2, 3)) AS k FROM t),
y AS (SELECT rec * 10000 + k AS rec_id, w[k + 1] AS a, w[k + 2] AS b, w[k + 3] AS c FROM x), z AS (SELECT *, rec_id // 3 % 6 AS kind, right(a, 2) || b AS glued FROM y WHERE length(a) >= 3 AND length(b) >= 5 AND length(c) >= 4 AND a <> b AND b <> c AND a <> c AND right(a, 1) <> left(b, 1)),
v AS (SELECT *, CASE WHEN length(glued) >= 8 AND right(a, 3) = left(glued, 3) THEN 3 ELSE 2 END AS cut FROM z)
SELECT rec_id, CASE WHEN kind < 2 THEN a || ' ' || b WHEN kind < 4 THEN a || ' ' || b || ' ' || c WHEN kind = 4 THEN a || ' ' || substr(glued, cut + 1) || ' ' || c ELSE a || ' ' || c || ' ' || b || ' ' || c || ' ' || a END AS text,
['coincident_phrase', 'shifted_phrase', 'recovered_unowned_word', 'recovered_prefixed_copy', 'recovered_clipped_prefix', 'recovered_compound_prefix'][kind + 1] AS reason,
CASE WHEN kind < 2 THEN a || ' ' || b WHEN kind < 4 THEN b WHEN kind = 4 THEN substr(glued, cut + 1) ELSE c || ' ' || b || ' ' || c END AS phrase, CASE WHEN kind = 4 THEN 1 ELSE 0 END::INTEGER AS kept_chunk, [2, 2, 0, 0, 0, 1][kind + 1]::INTEGER AS removed,
array_to_string(list_sort(CASE kind WHEN 2 THEN ['x' || b, c] WHEN 3 THEN ['e' || b, a, c] WHEN 4 THEN [glued, a, c, left(glued, cut)] WHEN 5 THEN [c || ' ' || b || ' ' || c, c] ELSE [] END), ',') AS evidence FROM v""",
    "alignment_valid": f"""WITH {_W}, z AS (SELECT rec, s, CASE WHEN i % 3 = 1 THEN s ELSE e END AS e, n * 0.5::DOUBLE - rec % 3 AS l FROM y)
SELECT rec, bool_and(s >= -0.1 AND s <= e AND e <= l + 0.2::DOUBLE AND s < l AND e >= 0) AND bool_or(least(l, e) > greatest(0, s)) AS valid, round(sum(least(l, e)), 4) AS ends FROM z GROUP BY rec""",
    "original_tokens": f"WITH {_W} SELECT rec, CASE WHEN rec % 2 = 1 THEN array_to_string(w, ' ') ELSE array_to_string(list_transform(w, lambda x: x || '~'), ' ') END AS text FROM t WHERE len(w) > 0",
    "measured_words": f"""WITH {_W}, z AS (SELECT rec, i, word, least(count(*) FILTER (WHERE i % 3 <> 1) OVER (PARTITION BY rec ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), count(*) FILTER (WHERE i % 3 <> 1) OVER (PARTITION BY rec) - 1) AS k FROM y), v AS (SELECT rec, k, string_agg(word, ' ' ORDER BY i) AS w FROM z GROUP BY ALL)
SELECT rec, string_agg(w, '|' ORDER BY k) AS text FROM v GROUP BY rec""",
    "widened_chunks": f"""WITH {_D}, q AS (SELECT n_nationkey AS user_id, n_nationkey * 2.0::DOUBLE AS x, n_nationkey * 2.0::DOUBLE + 60 AS z FROM nation), r AS (SELECT * FROM q UNION ALL SELECT user_id, x - 3, z + 30 FROM q),
h AS (SELECT g.user_id, chunk_idx, a, b, min({{'x': x, 'z': z}}) AS m FROM g LEFT JOIN r ON g.user_id = r.user_id AND x <= a AND b <= z GROUP BY ALL), l AS (SELECT *, CASE WHEN m.x IS NULL THEN a ELSE greatest(m.x, a - 2) END AS low, CASE WHEN m.x IS NULL THEN b ELSE least(m.z, b + 2) END AS high FROM h)
SELECT user_id, chunk_idx, low < a OR high > b AS wider, round(low, 4) AS start, round(high, 4) AS "end" FROM l""",
    "chunk_lengths": f"WITH {_D} SELECT user_id, count(*) AS n, " + ", ".join(f"round({f}({c}) + 1e-9, 4) AS {name}_{kind}" for kind, c in (("core", "ce - cs"), ("input", "b - a")) for name, f in (("least", "min"), ("mean", "avg"), ("most", "max"))) + " FROM g GROUP BY user_id",
    "chunk_progress": f"WITH {_D} SELECT user_id, count(*) * 2 AS total, count(*) FILTER (WHERE chunk_idx % 3 <> 1) AS completed FROM g GROUP BY user_id",
    "region_words": f"""WITH {_W}, z AS (SELECT *, floor((s + e) / 2 / 10) * 10 AS region FROM y WHERE (s + e) / 2 - floor((s + e) / 2 / 10) * 10 < 7.3::DOUBLE)
SELECT rec, CAST(i AS INTEGER) AS i, word, round(region, 3) AS region, round(greatest(s, region), 4) AS start, round(least(e, region + 7.3::DOUBLE), 4) AS "end" FROM z WHERE round_even(least(e, region + 7.3::DOUBLE) * 1000, 0) > round_even(greatest(s, region) * 1000, 0)""",
    "compare_channels": f"""WITH {_W}, {_CUTS}, h AS (SELECT rec, least(CAST(floor((s + e) / 2 / 20) AS BIGINT), (SELECT max(k) FROM c WHERE c.rec = y.rec)) AS k, i, word, CASE WHEN i % 5 = 2 THEN 'other' ELSE word END AS changed FROM y), j AS (SELECT rec, k, string_agg(word, ' ' ORDER BY i) AS a, string_agg(changed, ' ' ORDER BY i) AS b FROM h GROUP BY ALL)
SELECT rec AS rec_id, 'S' || lpad(CAST(k + 1 AS VARCHAR), 6, '0') AS id, CAST(k AS INTEGER) AS chunk_idx, coalesce(j.a, '') AS a, coalesce(j.b, '') AS b, coalesce(j.a, '') <> coalesce(j.b, '') AS differ FROM c LEFT JOIN j USING (rec, k)""",
    "region_layout": f"""WITH RECURSIVE {_FRAMES}, {_WINDOWS}, g AS (SELECT rec, 10::BIGINT AS a, n * 2 // 3 AS b FROM n UNION ALL SELECT rec, n * 2 // 3 + 3, n FROM n), {_cut_regions(80, 160)}
SELECT rec, a AS region, i AS chunk_idx, {_bounds("a", "b")} FROM c WHERE next > pos""",
    "sliding_layout": f"""WITH RECURSIVE {_FRAMES}, {_WINDOWS}, g AS (SELECT rec, 0::BIGINT AS a, n AS b FROM n), {_cut_regions(140, 180)}
SELECT rec, i AS chunk_idx, {_bounds("a", "b")} FROM c WHERE EXISTS (SELECT 1 FROM p WHERE p.rec = c.rec AND p.a < c.next AND p.b > c.pos)""",
    "packed_layout": f"""WITH RECURSIVE {_FRAMES}, s AS (SELECT rec, n, greatest(1, CAST(ceil(n / 118.0) AS BIGINT)) AS cores, greatest(n, greatest(1, CAST(ceil(n / 118.0) AS BIGINT)) * 60) AS size FROM n),
u AS (SELECT rec, f, e FROM f UNION ALL SELECT rec, unnest(range(n, size)), 0 FROM s), w AS (SELECT rec, f, sum(e) OVER v AS e FROM u WINDOW v AS (PARTITION BY rec ORDER BY f ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) QUALIFY count(*) OVER v = 10),
r(rec, cores, size, k, pos) AS (SELECT rec, cores, size, 0::BIGINT, 0::BIGINT FROM s UNION ALL
SELECT q.rec, q.cores, q.size, q.k + 1, CASE WHEN high - low > 1600 THEN min({{'e': w.e, 'f': w.f}}).f * 160 + 800 ELSE CAST(round_even((low + high) / 2.0, 0) AS BIGINT) END
FROM (SELECT *, greatest(pos + 9600, (size - (cores - k - 1) * 118) * 160, high - 8000) AS low FROM (SELECT *, least(pos + 18880, (size - (cores - k - 1) * 60) * 160) AS high FROM r WHERE k + 1 < cores)) q
LEFT JOIN w ON w.rec = q.rec AND high - low > 1600 AND w.f BETWEEN low // 160 AND high // 160 - 10 GROUP BY q.rec, q.cores, q.size, q.k, q.pos, low, high),
c AS (SELECT rec, size, k, pos / 160.0::DOUBLE AS pos, coalesce(lead(pos) OVER (PARTITION BY rec ORDER BY k) / 160.0::DOUBLE, size) AS next FROM r)
SELECT rec, CAST(k AS INTEGER) AS chunk_idx, {_bounds("0", "size")} FROM c WHERE EXISTS (SELECT 1 FROM p WHERE p.rec = c.rec AND p.a < c.next AND p.b > c.pos)""",
    "halved_chunks": f"""WITH {_FRAMES}, {_WINDOWS}, k AS (SELECT rec, n, CAST(unnest(range(0, CAST(ceil(n / 300.0) AS BIGINT))) AS INTEGER) AS i FROM n), c AS (SELECT rec, n, i, i * 300 AS pos, least(n, i * 300 + 300) AS next FROM k WHERE least(n, i * 300 + 300) - i * 300 > 200),
m AS (SELECT c.rec, c.n, c.i, c.pos, c.next, min({{'e': w.e, 'f': w.f}}).f + 5 AS cut FROM c JOIN w ON w.rec = c.rec AND w.f BETWEEN CAST(round_even((c.pos + c.next) / 2.0 - least(50, (c.next - c.pos) / 2.0 - 100), 0) AS BIGINT) AND CAST(round_even((c.pos + c.next) / 2.0 + least(50, (c.next - c.pos) / 2.0 - 100), 0) AS BIGINT) - 10 GROUP BY ALL
UNION ALL SELECT rec, n, i, pos, next, (CAST(round_even((pos + next) / 2.0 - reach, 0) AS BIGINT) + CAST(round_even((pos + next) / 2.0 + reach, 0) AS BIGINT)) / 2.0 FROM (SELECT *, least(50, (next - pos) / 2.0 - 100) AS reach FROM c) WHERE CAST(round_even((pos + next) / 2.0 + reach, 0) AS BIGINT) - CAST(round_even((pos + next) / 2.0 - reach, 0) AS BIGINT) <= 10)
SELECT rec, i AS chunk_idx, 0::INTEGER AS part, round(greatest(0, pos - 100) / 100.0::DOUBLE, 4) AS start, round(least(least(n, next + 100), cut + 100) / 100.0::DOUBLE, 4) AS "end", round(pos / 100.0::DOUBLE, 4) AS core_start, round(cut / 100.0::DOUBLE, 4) AS core_end FROM m
UNION ALL SELECT rec, i, 1::INTEGER, round(greatest(greatest(0, pos - 100), cut - 100) / 100.0::DOUBLE, 4), round(least(n, next + 100) / 100.0::DOUBLE, 4), round(cut / 100.0::DOUBLE, 4), round(next / 100.0::DOUBLE, 4) FROM m""",
    "silenced_frames": f"WITH {_FRAMES} SELECT rec, f AS frame, round(CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.rec = f.rec AND p.a <= f.f AND f.f < p.b) THEN 0 ELSE CAST(e AS DOUBLE) END, 2) AS energy FROM f",
    "content_identity": """SELECT o_orderkey, left(sha256('{"key": ' || o_orderkey || ', "né": ' || (CASE WHEN o_orderkey % 2 = 0 THEN '"a\\"b"' ELSE 'null' END) || ', "priority": "' || o_orderpriority || '", "status": "' || o_orderstatus || '"}'), 32) AS id FROM orders""",
    "export_texts": f"""WITH {_O}, v AS (SELECT job, string_agg('## ' || low || ' - ' || high || chr(10) || chr(10) || text || chr(10) || CASE WHEN open THEN chr(10) || 'Вариант A: ' || p || chr(10) || 'Вариант B: ' || lower(p) || chr(10) || 'Вопрос: ' || CASE WHEN k % 2 = 0 THEN 'which?' ELSE 'Какой вариант соответствует записи?' END || chr(10) ELSE '' END, chr(10) ORDER BY i) AS body,
string_agg(text, chr(10) || chr(10) ORDER BY i) || chr(10) AS plain, string_agg(i || chr(10) || low || ' --> ' || high || chr(10) || text || chr(10), chr(10) ORDER BY i) AS srt FROM s GROUP BY job)
SELECT u.job, '# Транскрипция лекции' || chr(10) || chr(10) || (CASE WHEN unresolved > 0 THEN 'Черновик: есть неразрешённые места.' ELSE 'Все решения сохранены.' END) || chr(10) || coalesce(chr(10) || body, '') AS markdown, coalesce(plain, chr(10)) AS text, coalesce(srt, '') AS srt, unresolved FROM u LEFT JOIN v USING (job)""",
    "store_segments": f"""WITH {_STORE} SELECT id, CASE WHEN choice IS NULL THEN 'pending' WHEN choice = 'uncertain' THEN 'uncertain' ELSE 'resolved' END AS status, choice, CASE choice WHEN 'edited' THEN 'Second' WHEN 'B' THEN lower(name) WHEN 'agreement' THEN name END AS text,
CASE WHEN k = 2 THEN 'user' WHEN k IN (1, 4, 5) THEN 'agent' ELSE 'asr' END AS origin, CASE WHEN k = 2 THEN 'asked' WHEN k IN (1, 4) THEN 'heard' WHEN k = 5 THEN 'noise' WHEN choice = 'agreement' THEN 'identical transcripts' ELSE '' END AS reason, CASE WHEN k = 5 THEN 'which?' ELSE '' END AS question FROM f""",
    "review_page": f"""WITH {_STORE}, n AS (SELECT *, lag(id) OVER (ORDER BY id) AS previous, lead(id) OVER (ORDER BY id) AS following FROM f)
SELECT id, row_number() OVER (ORDER BY id) - 1 AS place, count(*) OVER () AS total, previous, following, CASE WHEN k BETWEEN 1 AND 3 THEN 'better' WHEN k = 5 THEN 'two' END AS notes FROM n WHERE choice IS NULL OR choice = 'uncertain'""",
    "order_log_at": f"""WITH {_CUSTOMERS}, {_ORDERS}, y AS (SELECT DISTINCT ON (id) * FROM o WHERE year <= 1999 ORDER BY id, year DESC, k DESC)
SELECT c.id, CASE WHEN y.id IS NULL THEN CASE WHEN a = b THEN 'resolved' ELSE 'pending' END WHEN y.choice = 'uncertain' THEN 'uncertain' ELSE 'resolved' END AS status,
CASE WHEN y.id IS NOT NULL THEN y.choice WHEN a = b THEN 'agreement' END AS choice, CASE WHEN y.id IS NULL THEN CASE WHEN a = b THEN a END WHEN y.choice = 'B' THEN b WHEN y.choice = 'edited' THEN y.p END AS text,
CASE WHEN y.id IS NULL THEN 'asr' ELSE y.origin END AS origin, CASE WHEN y.id IS NULL THEN '' ELSE y.p END AS question FROM c LEFT JOIN y USING (id)""",
    "material_history": """WITH v AS (SELECT s_suppkey, 1::BIGINT AS revision, s_name, s_name AS text FROM supplier UNION ALL SELECT s_suppkey, 2, s_name, lower(s_name) FROM supplier WHERE s_acctbal < 3000 UNION ALL SELECT s_suppkey, 3, s_name, s_name || '!' FROM supplier WHERE s_nationkey % 2 = 0)
SELECT md5(CAST(s_suppkey AS VARCHAR)) AS id, revision, s_name AS original_text, text FROM v WHERE s_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey % 2 = 0 OR s_acctbal < 3000)""",
    "decision_errors": f"""WITH {_CUSTOMERS}, {_ORDERS}, g AS (SELECT o.*, price < 60000 AS cheap, CASE WHEN year > 1999 AND price < 60000 THEN 'C' ELSE choice END AS made, c.id IS NOT NULL AS known FROM o LEFT JOIN (SELECT id FROM c WHERE bal > 0) c USING (id))
SELECT id AS segment_id, 'unknown segment' AS problem FROM g WHERE NOT known UNION ALL SELECT id, 'invalid choice' FROM g WHERE known AND made = 'C' UNION ALL SELECT id, 'a reason is required' FROM g WHERE known AND p = '5-LOW'
UNION ALL SELECT id, 'edited text must not be empty' FROM g WHERE known AND made = 'edited' AND cheap UNION ALL SELECT id, 'an uncertain decision needs a question' FROM g WHERE known AND made = 'uncertain' AND cheap
UNION ALL SELECT id, 'invalid origin' FROM g WHERE known AND p = '1-URGENT' UNION ALL SELECT id, 'duplicate segment decisions' FROM g GROUP BY id HAVING count(*) > 1""",
    "split_after_marker": "SELECT p_partkey, string_split(p_name, ' ')[-1] AS last, string_split(p_brand, '#')[-1] AS number FROM part",
    "chunk_sets": """WITH s AS (SELECT l_orderkey, coalesce(list(DISTINCT l_partkey % 10) FILTER (WHERE l_quantity < 30), []) AS a, coalesce(list(DISTINCT l_partkey % 10) FILTER (WHERE l_quantity > 20), []) AS b FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS either, array_to_string(list_sort(list_intersect(a, b)), ',') AS both, list_has_any(a, b) AS meet FROM s""",
    "array_steps": """WITH e AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: CAST(round_even(CAST(x * 10::FLOAT AS DOUBLE), 0) AS BIGINT)) AS v FROM embeddings)
SELECT vec_id, array_to_string(list_transform(range(2, 9), lambda i: v[i] - v[i - 1]), ',') AS steps, array_to_string(list_transform(range(1, 9), lambda i: CAST(list_sum(v[1:i]) AS BIGINT)), ',') AS sums, array_to_string(list_filter(range(0, 8), lambda i: v[i + 1] > 0), ',') AS places, array_to_string(list_concat(v[3:4], [0::BIGINT, 0::BIGINT]), ',') AS padded FROM e""",
    "map_steps": """WITH e AS (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k, CASE WHEN user_id % 2 = 0 THEN 'k' ELSE event_type END AS key FROM events)
SELECT event_id, k, CASE WHEN key = 'k' THEN coalesce(k, -1) ELSE -1 END AS other, CASE WHEN event_type = 'purchase' THEN 'k,n' ELSE array_to_string(json_keys(props), ',') END AS keys, list_contains(json_keys(props), key) AS held, CASE WHEN event_type = 'purchase' THEN CAST(round_even(value, 0) AS INTEGER) ELSE k END AS k_over FROM e""",
    "number_types": """WITH t AS (SELECT event_id, json_type(CASE event_type WHEN 'click' THEN CAST(event_id AS VARCHAR) WHEN 'purchase' THEN CAST(value AS VARCHAR) WHEN 'view' THEN CASE WHEN value > 100 THEN 'true' ELSE 'false' END ELSE props END) AS kind FROM events)
SELECT event_id, kind IN ('UBIGINT', 'BIGINT') AS whole, kind = 'BOOLEAN' AS truth FROM t""",
    "sliding_windows": "WITH e AS (SELECT epoch_us(ts) // 1000000 // 1800 * 1800 AS t FROM events), w AS (SELECT t AS start FROM e UNION ALL SELECT t - 1800 FROM e) SELECT start, count(*) AS n FROM w GROUP BY start",
    "sentence_runs": rf"""WITH {_W}, z AS (SELECT rec, i, CAST(regexp_matches(word, '[.!?…]["»)]?$') AS BIGINT) AS stop FROM y), v AS (SELECT rec, i, coalesce(sum(stop) OVER (PARTITION BY rec ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM z)
SELECT rec, CAST(run AS BIGINT) AS run, count(*) AS n FROM v GROUP BY ALL""",
}
