"""Text functions: folding, tokens, time stamps, identifiers, differences and wrapping."""

from __future__ import annotations

import hashlib
import json
import re
import textwrap
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a token; the engine's own \w differs from this class.
TOKEN = r"[\p{L}\p{N}_]+"
CONFLICT = T.ArrayType(T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("operation", T.StringType())]))


def folded(text: Column | str) -> Column:
    """Lower case, with sharp s as two letters and the letter yo as ye."""
    return F.translate(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), "ё", "е")


def norm(text: Column | str) -> Column:
    """Lower case without anything but letters, digits and underscores; yo stays."""
    return F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}_]", "")


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(f"({TOKEN})"), F.lit(1))


def split_words(text: Column | str) -> Column:
    """White-space words without empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def ends_sentence(text: Column | str) -> Column:
    return F.rlike(text if isinstance(text, Column) else F.col(text), F.lit(r'[.!?…]["»)]?$'))


def stamp(seconds: Column | str) -> Column:
    """HH:MM:SS,mmm of seconds, half to even, never negative; hours are not capped."""
    s = F.col(seconds) if isinstance(seconds, str) else seconds
    ms = F.greatest(F.lit(0).cast("long"), F.rint(s * 1000).cast("long"))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hours = ((ms - ms % 3600000) / 3600000).cast("long").cast("string")
    return F.concat(
        F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours), F.lit(":"),
        two(((ms % 3600000) / 60000).cast("long")), F.lit(":"),
        two(((ms % 60000) / 1000).cast("long")), F.lit(","),
        F.lpad((ms % 1000).cast("string"), 3, "0"),
    )


def identity(value: object) -> str:
    """First 32 hex digits of sha256 over canonical JSON: sorted keys, plain characters."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:32]


def canonical_json(values: dict[str, Column]) -> Column:
    """The canonical JSON of a flat object of text and numbers, as ``identity`` writes it: sorted keys, plain characters."""
    member = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    parts = [F.concat(F.lit(json.dumps(k, ensure_ascii=False) + ": "), F.when(c.isNull(), "null").otherwise(member(c))) for k, c in sorted(values.items())]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def identities(values: dict[str, Column]) -> Column:
    """``identity`` of an object in each row."""
    return F.substring(F.sha2(canonical_json(values), 256), 1, 32)


def _shared_runs(a: list[str], b: list[str]) -> np.ndarray:
    """Maximal stretches of equal words as rows (start in a, start in b, words), each once: pairs of equal words, by diagonals."""
    number: dict[str, int] = {}
    x = np.array([number.setdefault(w, len(number)) for w in a], dtype=np.int64)
    y = np.array([number.setdefault(w, len(number)) for w in b], dtype=np.int64)
    order = np.argsort(y, kind="stable")
    low, high = np.searchsorted(y[order], x), np.searchsorted(y[order], x, side="right")
    i = np.repeat(np.arange(len(x)), high - low)
    j = order[np.repeat(low, high - low) + np.arange(len(i)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)]
    along = np.lexsort((i, j - i))
    i, j = i[along], j[along]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(j - i) != 0) | (np.diff(i) != 1)])) if len(i) else np.empty(0, dtype=np.int64)
    return np.column_stack([i[first], j[first], np.diff(np.append(first, len(i)))]) if len(i) else np.empty((0, 3), dtype=np.int64)


def common_blocks(a: list[str], b: list[str]) -> list[tuple[int, int, int]]:
    """(start in a, start in b, words) of the blocks that two word lists share: the longest one, and so on before and after it.

    Of equally long blocks the first in a counts, then the first in b. The stretches are found once; a rectangle of the two lists cuts
    them to what lies in it, and its longest piece divides it in two.
    """
    runs, found, open_ = _shared_runs(a, b), [], [(0, len(a), 0, len(b))]
    while open_:
        low, high, left, right = open_.pop()
        skip = np.maximum(np.maximum(low - runs[:, 0], left - runs[:, 1]), 0)
        size = np.minimum(np.minimum(high - runs[:, 0], right - runs[:, 1]), runs[:, 2]) - skip
        if not len(size) or size.max() <= 0:
            continue
        best = np.flatnonzero(size == size.max())
        i, j = min(zip((runs[best, 0] + skip[best]).tolist(), (runs[best, 1] + skip[best]).tolist(), strict=True))
        n = int(size.max())
        found.append((i, j, n))
        open_ += [(low, i, left, j), (i + n, high, j + n, right)]
    return sorted(found)


def differences(a: str, b: str) -> list[dict[str, str]]:
    """What turns the words of a into those of b: replaced, deleted and inserted runs between the blocks that both share."""
    mine, other = (a or "").split(), (b or "").split()
    at, found = (0, 0), []
    for i, j, n in [*common_blocks(mine, other), (len(mine), len(other), 0)]:
        gone, come = mine[at[0] : i], other[at[1] : j]
        if gone or come:
            kind = "replace" if gone and come else "delete" if gone else "insert"
            found.append({"a": " ".join(gone), "b": " ".join(come), "operation": kind})
        at = i + n, j + n
    return found


@F.pandas_udf(CONFLICT)
def token_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    """``differences`` of two text columns."""
    return pd.Series([differences(x, y) for x, y in zip(a, b, strict=True)])


def wrapped(text: str, width: int = 42) -> list[str]:
    """At most two lines: greedy wrapping, or the most even split where that gives more."""
    lines = textwrap.wrap(text, width=width, break_long_words=False, break_on_hyphens=False)
    if len(lines) <= 2:
        return lines
    words = text.split()
    total = sum(map(len, words)) + len(words) - 1
    best, seen, least = 1, 0, None
    for i, word in enumerate(words[:-1], 1):
        seen += len(word) + (i > 1)
        uneven = abs(seen - (total - seen - 1))
        if least is None or uneven < least:
            best, least = i, uneven
    return [" ".join(words[:best]), " ".join(words[best:])]


def wrapped_lines(text: Column | str, width: int = 42) -> Column:
    """``wrapped`` as an expression, over the text's white-space words: an array of at most two lines, none for a blank text."""
    words = split_words(text)
    joined = lambda parts: F.array_join(parts, " ")

    def longer(lines: Column, word: Column) -> Column:
        last = F.element_at(lines, -1)
        fits = F.length(last) + 1 + F.length(word) <= width
        return F.when(fits, F.concat(F.slice(lines, 1, F.size(lines) - 1), F.array(F.concat(last, F.lit(" "), word)))).otherwise(F.concat(lines, F.array(word)))

    greedy = F.aggregate(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 1, 1), longer)
    uneven = lambda i: F.abs(F.length(joined(F.slice(words, F.lit(1), i))) - F.length(joined(F.slice(words, i + 1, F.size(words)))))
    best = F.array_min(F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.struct(uneven(i).alias("uneven"), i.alias("i"))))["i"]
    return F.when(F.size(greedy) <= 2, greedy).otherwise(F.array(joined(F.slice(words, F.lit(1), best)), joined(F.slice(words, best + 1, F.size(words)))))


def token_places(text: str) -> list[tuple[str, int, int]]:
    """(folded token, start, end) in the text."""
    return [(m[0].casefold().replace("ё", "е"), m.start(), m.end()) for m in re.finditer(r"\w+", text)]


TOKENS = T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


@F.pandas_udf(TOKENS)
def tokens_with_places(text: pd.Series) -> pd.Series:
    """Fully case-folded tokens with their places; null gives none."""
    return text.map(lambda x: [{"token": t, "start": a, "end": b} for t, a, b in token_places(x or "")])


@F.udtf(returnType="token string, start int, end int", useArrow=True)
class TokenPlaces:
    """A row for each fully case-folded token of a text, with its place: a table function for lateral joins. Null gives none."""

    def eval(self, text: str) -> Iterator[tuple[str, int, int]]:
        yield from token_places(text or "")
