"""Secret scans with corpus-wide ownership frequency.

A scan finds candidates in every whole text: the three base kinds, and wider kinds (provider tokens, web tokens,
whole private keys, dense random-looking strings) that alone would raise many false alarms. Each candidate's value is
hashed, and the hashes are counted over the whole corpus by distinct repositories and distinct owners. A value that
several owners hold, or two in many repositories, is an example that has been copied around; a value with fewer that looks random
is a live credential of its owner, in however many of that owner's repositories it stands. Base spans always stay; spans of the wider kinds are added only where the count leaves a
live-looking credential.

Counting is by three nested group-bys, (hash, owner, repository), (hash, owner), (hash), each combined before its
shuffle, so a value held by a third of all rows sends one row a task.

Defined results: null text counts as empty. A null owner or repository is one owner or repository like another. Rows
may repeat; a repeated row is the same repository. Spans count code points, end exclusive. A text without spans has
empty lists. Empty tables give none. Columns beside those named are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import fresh, in_arrow, map_rows, slices, table, texts
from spanloom.plans.scratch import materialise, release

#: Kinds in the order that breaks ties of position; the first three are the base.
KINDS = ("assign", "access", "hex", "provider", "webtoken", "private", "dense")
BASE = 3
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Prefixes of well-known token formats, each with the shape that follows it.
PROVIDER = re.compile(r"(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|[rs]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})")
#: The parts of a web token, and the signs that the first two begin with and the least number of those that follow.
WEB_PART, WEB_START, WEB_LEAST = re.compile(r"[A-Za-z0-9_-]+"), "eyJ", 8
PRIVATE = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")
FOOTER = re.compile(r"-----END (?:[A-Z]+ )*PRIVATE KEY-----")
#: What stands between the lines of a key: white space, escaped or not, and the signs of quoted, joined or commented lines.
_BETWEEN = re.compile(r"""(?:\s|\\[nrt]|["',;>#*|]|\+(?=\s))*""")
_KEY_LINE = re.compile(r"(?:[A-Za-z0-9+/]|\\/)+={0,2}")
_KEY_HEADER = re.compile(r"[A-Za-z][A-Za-z0-9-]*: [^\n\\]*")
_LINE_END = re.compile(r"""(?:[^\S\n]|["',;+|])*(?:\n|\\[nr]|\Z)""")
#: Characters from which a line is one of a key wherever it stands.
KEY_LINE = 32
DENSE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{32,}")
#: Owners from which a value is an example, repositories from which two owners are enough, and bits a character from which it looks random.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES, LEAST_BITS = 3, 10, 3.0
DENSE_BITS = 4.0
#: Hashes of widely copied values that may be sent to all tasks.
SENT_EXAMPLES = 200_000
_PLACEHOLDER = re.compile(r"example|sample|dummy|changeme|placeholder|your|xxxx|0123456789|1234567890|abcdef", re.IGNORECASE)


def bits_per_character(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def digest(value: str) -> bytes:
    return hashlib.sha256(value.encode("utf-8", "surrogatepass")).digest()[:16]


def looks_random(value: str) -> bool:
    if value.startswith("-----BEGIN") and any(bits_per_character(m[0]) >= DENSE_BITS for m in DENSE.finditer(value)):
        return True  # by chance a long key may hold the letters of a placeholder
    return bits_per_character(value) >= LEAST_BITS and not _PLACEHOLDER.search(value)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind, value) of the base kinds, leftmost and without overlap in each kind."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), 0, m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    # A run that isn't cut off is matched whole or not at all, so the length can stand in the pattern.
    found += [(m.start(), m.end(), 2, m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def key_end(text: str, start: int) -> int:
    """Where the private key whose header ends at ``start`` ends: after its footer, or with its base64 lines if that is missing."""
    after = text.find("-----BEGIN", start)
    after = after if after >= 0 else len(text)
    footer = FOOTER.search(text, start, after)
    if footer:
        return footer.end()
    end, first = start, 0
    at = _BETWEEN.match(text, start, after).end()
    while header := _KEY_HEADER.match(text, at, after):
        end = header.end()
        at = _BETWEEN.match(text, end, after).end()
    # All lines but the last are as long as the first.
    while line := _KEY_LINE.match(text, at, after):
        n = line.end() - at
        if n < KEY_LINE and not (first >= KEY_LINE or _LINE_END.match(text, line.end(), after)):
            break
        end, first = line.end(), first or n
        if n < min(first, KEY_LINE):
            break
        at = _BETWEEN.match(text, end, after).end()
    return end


def key_value(text: str, start: int, end: int) -> str:
    """A key's header and body, however its lines are broken, quoted or escaped."""
    return re.sub(r"""\s|\\[nrt]|\\(?=/)|["',;>#*|]|\+(?=\s)""", "", FOOTER.sub("", text[start:end]))


def web_tokens(text: str) -> list[tuple[int, int]]:
    """Start and end of what three parts between points make: the first two hold, and begin with, the start sign. Each part is read once."""
    found, parts = [], [(-2, -2)] * 3
    for m in WEB_PART.finditer(text):
        parts = [*parts[1:], m.span()]
        (a, b), (c, d), (e, f) = parts
        if b + 1 == c and d + 1 == e and text[b] == text[d] == "." and d - c >= WEB_LEAST + 3 and f - e >= WEB_LEAST and text.startswith(WEB_START, c):
            start = text.find(WEB_START, a, max(a, b - WEB_LEAST))
            if start >= 0:
                found.append((start, f))
                parts = [(-2, -2)] * 3
    return found


def wider_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind, value) of the wider kinds."""
    found, keys = [], []
    if "_" in text or "-" in text or "AIza" in text:
        found += [(m.start(), m.end(), 3, m[0]) for m in PROVIDER.finditer(text)]
    if ".eyJ" in text:
        found += [(a, b, 4, text[a:b]) for a, b in web_tokens(text)]
    if "-----BEGIN" in text:
        for m in PRIVATE.finditer(text):
            end = key_end(text, m.end())
            found.append((m.start(), end, 5, key_value(text, m.start(), end)))
            keys.append((m.start(), end))
    for m in DENSE.finditer(text):
        value = m[0]
        if keys:  # a key's lines stand or go with the whole key
            at = bisect_right(keys, (m.start(), len(text))) - 1
            if at >= 0 and m.end() <= keys[at][1]:
                continue
        if not value.isupper() and not value.islower() and any(map(str.isdigit, value)) and bits_per_character(value) >= DENSE_BITS:
            found.append((m.start(), m.end(), 6, value))
    return found


def listed(spans) -> str:
    return ",".join(f"{KINDS[s[2]]}:{s[0]}:{s[1]}" for s in spans)


def scan(documents: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """One row for each document: its base counts and digest, and its candidates with hashed values."""
    own = documents.select("doc_id", F.col("text"), owner.cast("string").alias("owner"), repository.cast("string").alias("repository"))
    fields = "start:int,end:int,kind:int,value:binary,random:boolean"
    kind = documents.schema["doc_id"].dataType.simpleString()
    struct = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("value", pa.binary()), ("random", pa.bool_())])

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, digests, candidates = [], [], []
            for text in texts(batch):
                base = base_spans(text)
                counts.append(Counter(s[2] for s in base))
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                candidates.append([{"start": a, "end": b, "kind": k, "value": digest(v), "random": looks_random(v)} for a, b, k, v in base + wider_spans(text)])
            n = [pa.array([c[k] for c in counts], pa.int64()) for k in range(BASE)]
            return pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "owner", "repository")), *n, pa.array(digests), pa.array(candidates, pa.list_(struct))],
                names=["doc_id", "owner", "repository", "n_assign", "n_access", "n_hex", "base_sha256", "candidates"],
            )

        return f

    return map_rows(own, make, f"doc_id {kind}, owner string, repository string, n_assign long, n_access long, n_hex long, base_sha256 string, candidates array<struct<{fields}>>")


def ownership(candidates: DataFrame) -> DataFrame:
    """owners and repositories of each hashed value in columns value, owner and repository."""
    each = candidates.groupBy("value", "owner", "repository").agg(F.lit(1).alias("one"))
    by_owner = each.groupBy("value", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def is_example(example_owners: int, example_repositories: int = EXAMPLE_REPOSITORIES) -> Column:
    """Whether a counted value has been copied widely."""
    return (F.col("owners") >= example_owners) | ((F.col("owners") > 1) & (F.col("repositories") >= example_repositories))


def judged_spans(documents: DataFrame, owner: Column, repository: Column, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """doc_id, the base columns, and ``found``: the judged candidates by position, each with owners, repositories and verdict.

    Verdicts: ``example`` (held by ``example_owners`` owners or more, or by two in ``EXAMPLE_REPOSITORIES`` repositories
    or more), ``live`` (by fewer, and it looks random), ``weak`` (by fewer, and it doesn't).
    """
    rows = materialise(scan(documents, owner, repository).withColumn("row", F.monotonically_increasing_id()), "candidates")
    each = rows.select("row", "owner", "repository", F.explode("candidates").alias("c")).select("row", "owner", "repository", "c.*")
    verdict = F.when(is_example(example_owners), "example").when(F.col("random"), "live").otherwise("weak")
    # Written first, so that both sides of the join are plain shuffles, of which Spark splits a hot value.
    counted = materialise(ownership(each.select("value", "owner", "repository")), "ownership")
    judged = each.join(counted, "value").withColumn("verdict", verdict)
    # One document's own spans are gathered, never those of a value.
    lists = judged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "verdict", "owners", "repositories"))).alias("found"))
    return rows.join(lists, "row", "left").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("found", F.array().cast(lists.schema["found"].dataType)).alias("found"))


def kept_spans(found: Column) -> Column:
    """Base spans, and spans of wider kinds that look live."""
    return F.filter(found, lambda s: (s["kind"] < BASE) | (s["verdict"] == "live"))


def redact_live(documents: DataFrame, owner: Column, repository: Column, mark: str = "<secret>", example_owners: int = EXAMPLE_OWNERS, sent_examples: int = SENT_EXAMPLES) -> DataFrame:
    """All rows and columns; in ``text`` every span that isn't a widely copied example is replaced by ``mark``.

    Base spans with the verdict weak go too, as the base takes them for secrets; spans of the wider kinds go if they look
    live. ``n_chars`` follows a changed text where the column exists. The hashes of the examples are counted: up to
    ``sent_examples`` of them go to all tasks, and a second scan needs no join; beyond that each document is joined with its own.
    """
    columns, place = documents.columns, {c: i for i, c in enumerate(documents.columns)}
    row, listed_ = fresh("key", columns), fresh("examples", columns)
    found = materialise(scan(documents.select("doc_id", "text", owner.alias("__owner"), repository.alias("__repository")), F.col("__owner"), F.col("__repository")), "candidates")
    each = found.select("owner", "repository", F.explode("candidates").alias("c")).select("owner", "repository", "c.value")
    examples = materialise(ownership(each).where(is_example(example_owners)).select("value"), "examples")
    release(found)
    if examples.count() <= sent_examples:
        sent = documents.sparkSession.sparkContext.broadcast({bytes(r["value"]) for r in examples.toLocalIterator()})
        joined = documents
    else:
        key = F.xxhash64("doc_id", "text")
        own = documents.select(key.alias(row), F.explode(_hashes("text")).alias("value")).distinct()
        shared = own.join(examples, "value").groupBy(row).agg(F.collect_set("value").alias(listed_))
        joined, sent = documents.withColumn(row, key).join(shared, row, "left").select(*columns, listed_), None

    def run(batches):
        for batch in (x for b in batches for x in slices(b)):
            arrays, changed = [batch.column(c) for c in columns], {}
            for i, text in enumerate(texts(batch)):
                known = sent.value if sent else {bytes(v) for v in batch.column(listed_)[i].as_py() or ()}
                spans = [(a, b) for a, b, k, v in base_spans(text) + wider_spans(text) if (k < BASE or looks_random(v)) and digest(v) not in known]
                if spans:
                    changed[i] = redacted(text, spans, mark)
            if changed:
                out = batch.column("text").to_pylist()
                sizes = batch.column("n_chars").to_pylist() if "n_chars" in place else []
                for i, text in changed.items():
                    out[i] = text
                    if sizes:
                        sizes[i] = len(text)
                for name, values in (("text", out), ("n_chars", sizes)):
                    if values:
                        arrays[place[name]] = pa.array(values, arrays[place[name]].type)
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return in_arrow(joined, run, documents.schema)


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def _hashes(text: pd.Series) -> pd.Series:
    """Hashes of a text's candidates."""
    return text.map(lambda t: [digest(v) for *_, v in base_spans(t or "") + wider_spans(t or "")])


def redacted(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """The text with the union of the spans replaced, each connected run by one mark."""
    parts, at = [], 0
    for start, end in sorted(spans):
        if start >= at or not parts:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan of ``documents``; a source is an owner, a document one of its repositories."""
    judged = judged_spans(table(spark, sf_dir, "documents"), F.col("source"), F.col("doc_id"))
    names = F.array(*map(F.lit, KINDS))
    text = F.transform(kept_spans(F.col("found")), lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"]))
    count = lambda v: F.size(F.filter("found", lambda s: s["verdict"] == v)).cast("long").alias(f"n_{v}")
    return judged.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(text, ",").alias("spans"), count("live"), count("example"))
