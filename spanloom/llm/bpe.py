"""Byte-level BPE encoding and decoding by backtracking over an Aho-Corasick automaton.

The ranks of a vocabulary become an automaton over Latin-1 strings, one character a byte. One pass of the
automaton over a piece finds its longest matches from left to right, and encoding walks along them; a token may
follow another only if the merge order would leave a boundary between them, which is decided by undoing their
merges and is memoised for each pair. Where the pair isn't compatible, the next shorter prefix token is tried, and
where none is left, the walk steps back. Each byte offset is given up at most once, so the work is linear in the
piece. The result is that of merging the pairs of lowest rank first.

Inputs: any DataFrame with a text column; null text encodes as the empty text. Empty text gives no ids. Other columns
pass through unchanged. Nothing is truncated: a text is one row whatever its length.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import in_arrow, slices, table, texts

#: File of ranks that the registered query uses.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pieces that a worker keeps encoded, in each of two generations, and pairs whose compatibility it keeps until they start anew.
CACHED_PIECES = 120_000
CACHED_PAIRS = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


class BytePairEncoder:
    """Encodes and decodes single pieces by the ranks of a vocabulary that holds all 256 bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary must hold every single byte")
        self.ranks = ranks
        self.length = {rank: len(token) for token, rank in ranks.items()}
        #: The two tokens whose merge makes a token; a token that no merge makes stands for itself twice.
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.pairs: dict[int, bool] = {}  # by the left rank's bits above the right one's
        self._find_parts()
        reachable = [t for t, r in ranks.items() if len(t) == 1 or self.parts[r][0] != r]
        self.shorter = self._prefix_links(reachable)
        self.widest = max(map(len, reachable))
        self.automaton = ahocorasick.Automaton()
        for token in reachable:
            self.automaton.add_word(token.decode("latin-1"), ranks[token])
        self.automaton.make_automaton()

    def _find_parts(self) -> None:
        """Undoes the last merge of every token, in order of rank, so that earlier answers serve later ones."""
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            self.parts[rank] = (rank, rank)
            for cut in range(len(token) - 1, 0, -1):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is None or right is None or left >= rank or right >= rank:
                    continue
                if self._apart(left, right):
                    self.parts[rank] = (left, right)
                    self.merged[left, right] = rank
                    break
        self.pairs.clear()

    def _prefix_links(self, tokens: list[bytes]) -> dict[int, int | None]:
        known = set(tokens)
        return {self.ranks[t]: next((self.ranks[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in known), None) for t in tokens}

    def _apart(self, left: int, right: int) -> bool:
        """Whether merging in rank order leaves a boundary between these two tokens.

        The tokens are taken apart from the latest merge backwards on the sides that touch. A pair that would
        have merged before the merge just undone contradicts the boundary.
        """
        merged, parts = self.merged, self.parts
        bound = float("inf")
        while True:
            joint = merged.get((left, right))
            if joint is not None and joint < bound:
                return False
            inner_left, inner_right = parts[left][1], parts[right][0]
            # The side of the later merge is undone first; of equal ranks the left one merged earlier.
            if left > right and inner_left != left or inner_right == right:
                if inner_left == left:
                    return True
                bound, left = left, inner_left
            else:
                bound, right = right + 1, inner_right

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self._apart(left, right)
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        """Token ids of one piece; a piece that is itself a token stays whole."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size, latin = len(piece), piece.decode("latin-1")
        length, shorter, pairs, longest = self.length, self.shorter, self.pairs, self.automaton.iter_long
        # The walk's first way takes the longest match at each place, up to the first neighbours that don't fit.
        ids: list[int] = []
        at, last = 0, None
        for _, token in longest(latin):
            if last is not None:
                fits = pairs.get(last << 32 | token)
                if fits is None:
                    fits = self.compatible(last, token)
                if not fits:
                    break
            ids.append(token)
            at += length[token]
            last = token
        else:
            return ids
        # From there on the automaton is asked place by place; a place is asked once, as it closes when it is given up.
        open_ = bytearray(b"\x01") * (size + 1)
        while at < size:
            while token is not None:
                end = at + length[token]
                if open_[end]:
                    if not ids:
                        break
                    fits = pairs.get(ids[-1] << 32 | token)
                    if fits is None:
                        fits = self.compatible(ids[-1], token)
                    if fits:
                        break
                token = shorter[token]
            if token is None:
                open_[at] = 0
                token = ids.pop()
                at -= length[token]
            else:
                ids.append(token)
                at = end
                if at < size:
                    token = next(longest(latin[at : at + self.widest]))[1]
        return ids


@lru_cache(maxsize=2)
def decoding_table(path: str) -> pa.BinaryArray:
    """The bytes of each token, at the place of its rank; null where no token has that rank."""
    tokens = {rank: token for token, rank in read_ranks(path).items()}
    return pa.array([tokens.get(rank) for rank in range(max(tokens) + 1)], pa.binary())


def decoded_rows(table: pa.BinaryArray, ids: pa.Array, offsets: np.ndarray) -> pa.BinaryArray:
    """The bytes of the tokens from each offset to the next, one value for each row; a null id stands for no bytes."""
    if not len(ids):
        return pa.array([b""] * (len(offsets) - 1), pa.binary())
    tokens = table.take(ids)
    if tokens.null_count > ids.null_count:
        raise ValueError("an id stands for no token")
    _, places, data = tokens.buffers()
    ends = np.frombuffer(places, dtype=np.int32)[tokens.offset : tokens.offset + len(tokens) + 1]
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(ends[offsets].tobytes()), data])


@lru_cache(maxsize=2)
def encoder(path: str) -> BytePairEncoder:
    """One encoder a worker process and vocabulary file."""
    return BytePairEncoder(read_ranks(path))


class TextEncoder:
    """Encodes texts split by a pattern, keeping the ids of recent pieces as packed 32-bit numbers.

    Pieces are kept in two generations: the younger one becomes the older when it is full, and a piece that is met
    again is young again.
    """

    def __init__(self, path: str, pattern: str):
        self.bpe, self.find = encoder(path), regex.compile(pattern).findall
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def packed(self, text: str) -> bytes:
        pieces = self.find(text)
        ids = list(map(self.young.get, pieces))
        if None in ids:
            for i, known in enumerate(ids):
                if known is None:
                    ids[i] = self._piece(pieces[i])
        return b"".join(ids)

    def _piece(self, piece: str) -> bytes:
        found = self.young.get(piece)
        if found is not None:
            return found
        found = self.old.get(piece)
        if found is None:
            found = array("i", self.bpe.encode_piece(piece.encode("utf-8", "surrogatepass"))).tobytes()
        if len(piece) <= 64:  # a long piece hardly comes again
            if len(self.young) >= CACHED_PIECES:
                self.old, self.young = self.young, {}
            self.young[piece] = found
        return found


@lru_cache(maxsize=2)
def text_encoder(path: str, pattern: str) -> TextEncoder:
    """One text encoder a worker process, so that its pieces serve the worker's later tasks too."""
    return TextEncoder(path, pattern)


def encode_texts(df: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, text: str = "text", into: str = "ids", keep_text: bool = False, decoded: str | None = None) -> DataFrame:
    """Adds ``into``, the token ids of ``text`` as array<int>, to all other columns.

    With ``decoded`` the bytes that the ids stand for come too, decoded from the ids by the same worker, so that a round
    trip takes one Python process a task. Null text gives no ids, as empty text does. The text itself goes unless
    ``keep_text``. Tables without rows give none. Columns already named ``into`` or ``decoded`` are replaced.
    """
    kept = [f for f in df.schema.fields if f.name not in (into, decoded) and (keep_text or f.name != text)]
    names = [f"__c{i}" for i in range(len(kept))]
    source = df.select(F.col(f"`{text}`").alias("__text"), *[F.col(f"`{f.name}`").alias(n) for f, n in zip(kept, names, strict=True)])
    added = [T.StructField("__ids", T.ArrayType(T.IntegerType(), True)), *([T.StructField("__decoded", T.BinaryType())] if decoded else [])]
    schema = T.StructType([*(T.StructField(n, f.dataType, True) for f, n in zip(kept, names, strict=True)), *added])

    def run(batches):
        coder, tokens = text_encoder(path, pattern), decoding_table(path)
        for batch in (x for b in batches for x in slices(b, "__text")):
            packed = [coder.packed(x) for x in texts(batch, "__text")]
            offsets = np.zeros(len(packed) + 1, dtype=np.int32)
            np.cumsum([len(x) // 4 for x in packed], out=offsets[1:])
            ids = pa.array(np.frombuffer(b"".join(packed), dtype=np.int32))
            columns = [*(batch.column(n) for n in names), pa.ListArray.from_arrays(pa.array(offsets), ids)]
            if decoded:
                columns.append(decoded_rows(tokens, ids, offsets))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return in_arrow(source, run, schema).toDF(*[f.name for f in kept], into, *([decoded] if decoded else []))


def decode_ids(df: DataFrame, path: str, ids: str = "ids", into: str = "decoded", keep_ids: bool = False) -> DataFrame:
    """Adds ``into``, the bytes that ``ids`` stand for; other columns pass through, the ids if kept.

    A null or empty list and a null in a list stand for no bytes; an id that isn't in the vocabulary is an error.
    """
    kept = [f for f in df.schema.fields if f.name != into and (keep_ids or f.name != ids)]
    source = df.select(F.col(f"`{ids}`").alias("__ids"), *[F.col(f"`{f.name}`").alias(f"__c{i}") for i, f in enumerate(kept)])
    schema = T.StructType([*(T.StructField(f"__c{i}", f.dataType, True) for i, f in enumerate(kept)), T.StructField("__out", T.BinaryType())])

    def run(batches):
        tokens = decoding_table(path)
        for batch in (x for b in batches for x in slices(b, "__ids")):
            lists = batch.column("__ids")
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            offsets = np.zeros(len(lists) + 1, dtype=np.int64)
            np.cumsum(lengths, out=offsets[1:])
            out = decoded_rows(tokens, pc.list_flatten(lists), offsets)
            columns = [batch.column(f"__c{i}") for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, out], names=[*(f"__c{i}" for i in range(len(kept))), "__out"])

    return in_arrow(source, run, schema).toDF(*[f.name for f in kept], into)


def round_trip(documents: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for each row: the ids encoded, then the bytes decoded from them."""
    return encode_texts(documents.select("doc_id", "text"), path, pattern, decoded="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
