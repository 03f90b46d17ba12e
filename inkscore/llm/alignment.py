"""Which tokens of one tokenizer stand for which of another.

A text is encoded by both; the byte offsets at which tokens of both end cut
the tokens into groups, and two tokens whose byte ranges end together are a link.
A table from each id of the first tokenizer to the id of the second with the same
bytes is made once: groups of one such pair are counted in a vector as long as the
vocabulary, and only the links of all other groups are shuffled as pairs.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .encoding import Encoder, byte_characters
from .shared import in_batches, settle

# Pairs of ids up to this many rows (16 bytes each) are broadcast when the documents
# look up their counts; more are met by a join.
PAIRS_AT_ONCE = 500_000
REMEMBERED = 400_000
WORD_MARK = "▁"
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>\Z")
CHUNK = re.compile(r" *[^ \n\t]+| +|[\n\t]")


class PieceEncoder:
    """Ids of a sentencepiece model, each stretch between blanks asked for once.

    No piece of the model has a blank behind another character, nor a line feed or
    tab in it, so what stands between such places is merged on its own. For
    a model in which that does not hold, and for texts with the mark that the
    library writes for a blank, the whole text is encoded.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        inner = any(WORD_MARK in p.lstrip(WORD_MARK) or "\n" in p or "\t" in p for p in self.pieces)
        probe = "a\n  b c ﬁ\td"
        shown = b"".join(map(self.bytes_of, self.model.encode(probe)))
        # Blanks and other characters have to come through as they are.
        self.may_cut = not inner and shown == b" " + probe.encode()
        self.known: dict[str, bytes] = {}
        self.limit = remembered

    def bytes_of(self, piece: int) -> bytes:
        found = BYTE_PIECE.match(self.pieces[piece])
        if found:
            return bytes([int(found[1], 16)])
        return self.pieces[piece].replace(WORD_MARK, " ").encode()

    def _chunk(self, chunk: str) -> bytes:
        own = self.known.get(chunk)
        if own is None:
            if chunk[0] == " " and chunk[-1] != " ":
                ids = self.model.encode(chunk[1:])
            else:
                # The blank that the library adds goes with the line feed.
                ids = self.model.encode("\n" + chunk)[2:]
            own = array("I", ids).tobytes()
            if len(chunk) < 100:  # longer ones do not return and would fill the memory
                if len(self.known) >= self.limit:
                    self.known.clear()
                self.known[chunk] = own
        return own

    def one(self, text: str) -> np.ndarray:
        if self.may_cut and text and WORD_MARK not in text:
            return np.frombuffer(b"".join(map(self._chunk, CHUNK.findall(" " + text))), "<u4")
        return np.array(self.model.encode(text), np.uint32)


class Aligner:
    """Tokens of both tokenizers, their groups and links."""

    def __init__(self, first: str, second: str):
        self.a = Encoder(first)
        # Strings of special tokens in a text are plain text.
        self.a.tokenizer.encode_special_tokens = True
        self.b = PieceEncoder(second)
        place = {c: i for i, c in enumerate(byte_characters())}
        self.bytes_a = []
        for i in range(self.a.tokenizer.get_vocab_size()):
            token = self.a.tokenizer.id_to_token(i) or ""
            plain = all(c in place for c in token)
            self.bytes_a.append(bytes(place[c] for c in token) if plain else token.encode())
        self.bytes_b = [self.b.bytes_of(i) for i in range(len(self.b.pieces))]
        self.long_a, self.long_b = (np.array([len(t) for t in s], np.int64) for s in (self.bytes_a, self.bytes_b))
        ids = {own: i for i, own in enumerate(self.bytes_b)}
        self.same = np.array([ids.get(own, -1) for own in self.bytes_a], np.int64)
        # "12," "12|" of the first ids, then "34," "34;" of the second.
        self.shown = np.array(
            [f"{i}{end}" for n, ends in ((len(self.bytes_a), ",|"), (len(self.bytes_b), ",;")) for end in ends for i in range(n)],
            object,
        )

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both; None without tokens."""
        if not text:
            return None
        want = f" {text}"
        a = np.frombuffer(self.a.one(want), "<u4").astype(np.int64)
        b = self.b.one(text).astype(np.int64)
        whole = want.encode()
        for own, known in ((a, self.bytes_a), (b, self.bytes_b)):
            if b"".join(map(known.__getitem__, own.tolist())) != whole:
                return None
        return a, b

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the last token of each group, in both."""
        _, last_a, last_b = np.intersect1d(
            np.cumsum(self.long_a[a]), np.cumsum(self.long_b[b]), assume_unique=True, return_indices=True
        )
        return last_a, last_b

    def text_of(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``: the ids of each group."""
        n_a, n_b = len(self.bytes_a), len(self.bytes_b)
        before_a, before_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        shown = np.zeros(len(a) + len(b), np.int64)
        own_a, own_b = a.copy(), 2 * n_a + b
        own_a[last_a] += n_a
        own_b[last_b] += n_b
        # Tokens of the other side that stand before a token's group, or in it.
        shown[np.arange(len(a)) + np.repeat(last_b + 1 - before_b, before_a)] = own_a
        shown[np.arange(len(b)) + np.repeat(last_a + 1, before_b)] = own_b
        return "".join(self.shown[shown].tolist())[:-1]

    def row(self, text: str | None) -> tuple:
        """n_a, n_b, groups, sha256, then ids and counts of the plain groups, and
        pairs and counts of the links of the others."""
        found = self.tokens(text)
        none = np.zeros(0, np.int64)
        if found is None:
            return 0, 0, 0, "", none, none, none, none
        a, b = found
        last_a, last_b = self.groups(a, b)
        digest = hashlib.sha256(self.text_of(a, b, last_a, last_b).encode()).hexdigest()
        x, y = a[last_a], b[last_b]
        plain = (np.diff(last_a, prepend=-1) == 1) & (np.diff(last_b, prepend=-1) == 1) & (self.same[x] == y)
        same, same_n = np.unique(x[plain], return_counts=True)
        odd, odd_n = np.unique(x[~plain] << 32 | y[~plain], return_counts=True)
        return len(a), len(b), len(last_a), digest, same, same_n, odd, odd_n


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(first: str, second: str) -> Aligner:
    """One aligner for each pair of files and task. Not for the driver: functions
    travel with what their module holds."""
    if (first, second) not in _ALIGNERS:
        _ALIGNERS[first, second] = Aligner(first, second)
    return _ALIGNERS[first, second]


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.append(0, np.cumsum([len(v) for v in values])).astype(np.int32)
    joined = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(joined, pa.int64()).cast(kind))


ROWS = (
    "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string,"
    " same array<int>, same_n array<int>, odd array<long>, odd_n array<int>"
)


def _encoded(docs: DataFrame, first: str, second: str) -> DataFrame:
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = aligner(first, second)
        rows = list(zip(*map(own.row, batch.column("text").to_pylist())))
        counts = [pa.array(c, pa.int64()) for c in rows[:3]]
        lists = [_lists(list(c), k) for c, k in zip(rows[4:], (pa.int32(), pa.int32(), pa.int64(), pa.int32()))]
        names = [field.split()[0] for field in ROWS.split(", ")]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *counts, pa.array(rows[3], pa.string()), *lists], names=names
        )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(in_batches(make), ROWS)


def _plain_counts(rows: DataFrame, same_of: np.ndarray) -> DataFrame:
    """Counts of the pairs of equal bytes: each task adds up one vector."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(same_of), np.int64)
        for batch in batches:
            same, n = (batch.column(c).flatten().to_numpy() for c in ("same", "same_n"))
            np.add.at(total, same, n)
        seen = np.flatnonzero(total)
        pair = seen << 32 | same_of[seen]
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(total[seen])], names=["pair", "n"])

    return rows.select("same", "same_n").mapInArrow(run, "pair long, n long")


def pair_counts(rows: DataFrame, same_of: np.ndarray) -> DataFrame:
    """pair (first id * 2^32 + second id), n, plain, and whether n is the highest of the
    second id (best, 1 or 0)."""
    odd = rows.select(F.inline(F.arrays_zip("odd", "odd_n")).alias("pair", "n"))
    odd = odd.select("pair", F.col("n").cast("long").alias("n"), F.lit(False).alias("plain"))
    plain = _plain_counts(rows, same_of).withColumn("plain", F.lit(True))
    counts = plain.unionByName(odd).groupBy("pair").agg(F.sum("n").alias("n"), F.max("plain").alias("plain"))
    second_id = F.col("pair").bitwiseAND((1 << 32) - 1)
    counts = settle(counts.withColumn("b", second_id), "pairs")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("pair", "n", "plain", (F.col("n") == F.col("most")).cast("long").alias("best"))


def _of_plain(rows: DataFrame, counts: DataFrame, size: int) -> DataFrame:
    """Adds what the plain links give: n_best, count_sum, from two vectors."""
    found = counts.select("pair", "n", "best").collect()
    n, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for pair, own, is_best in found:
        n[pair >> 32], best[pair >> 32] = own, is_best
    shared = rows.sparkSession.sparkContext.broadcast((n, best))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        of_n, of_best = shared.value
        same, times = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("same", "same_n"))
        ends = np.cumsum(batch.column("same").value_lengths().to_numpy())
        sums = []
        for vector in (of_best, of_n):
            total = np.append(0, np.cumsum(vector[same] * times))[np.append(0, ends)]
            sums.append(pa.array(np.diff(total)))
        return pa.RecordBatch.from_arrays([batch.column("row"), *sums], names=["row", "n_best", "count_sum"])

    return rows.select("row", "same", "same_n").mapInArrow(in_batches(make), "row long, n_best long, count_sum long")


def align_tokens(docs: DataFrame, first: str, second: str, pairs_at_once: int = PAIRS_AT_ONCE) -> DataFrame:
    """How the tokens of ``first`` (a byte-level file of the tokenizers library, given a
    blank and the text) and of ``second`` (a sentencepiece model, which adds the
    blank) stand for one another: doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256.

    A pair's count is the number of links of all rows that hold it; n_best counts the
    links whose pair is the most frequent of its second id, ties included, and
    count_sum adds up the counts of all links. groups_sha256 is that of
    ``a1,a2|b1;a3|b2,b3``. A text that is null or empty, or that a tokenizer
    does not give back byte by byte, has zeros and ''. Repeated rows count each
    time, null ids stay null, an empty table gives no rows; other columns are ignored.
    """
    rows = _encoded(docs, first, second).withColumn("row", F.monotonically_increasing_id())
    rows = settle(rows, "aligned")
    same_of = Aligner(first, second).same
    counts = settle(pair_counts(rows, same_of), "counts")
    # At most one pair for each id of the first vocabulary.
    plain = _of_plain(rows, counts.where("plain"), len(same_of))

    odd = rows.select("row", F.inline(F.arrays_zip("odd", "odd_n")).alias("pair", "times"))
    few = counts.count() <= pairs_at_once
    met = odd.join(F.broadcast(counts) if few else counts, "pair")
    sums = met.groupBy("row").agg(
        F.sum(F.col("times") * F.col("best")).alias("odd_best"), F.sum(F.col("times") * F.col("n")).alias("odd_sum")
    )
    total = rows.drop("same", "same_n", "odd", "odd_n").join(plain, "row").join(sums, "row", "left")

    def added(name: str, more: str) -> Column:
        return (F.col(name) + F.coalesce(F.col(more), F.lit(0))).alias(name)

    return total.select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"),
        added("n_best", "odd_best"), added("count_sum", "odd_sum"), "groups_sha256",
    )
