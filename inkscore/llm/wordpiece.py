"""Numbers of greedy longest-match word pieces, in time linear in the text.

The vocabulary is a trie. A node has a failure link: where matching goes on when
no child fits, after the pieces that are then settled are popped. Only their
number is kept with the node, so a word's length in pieces is counted without
building a piece or going back in the text.
"""

from __future__ import annotations

import json
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_batches, text_bytes

REMEMBERED = 400_000
START = 0  # root for pieces that begin a word
INSIDE = 1  # root for pieces that go on in one
UNKNOWN = -1


class PieceCounter:
    """Automaton over bytes for the pieces that begin words and those that go on."""

    def __init__(self, beginning: set[bytes], inside: set[bytes]):
        self.next: list[dict[int, int]] = [{}, {}]
        piece = [False, False]
        depth_of = [0, 0]
        for root, words in ((START, beginning), (INSIDE, inside)):
            for word in words:
                node = root
                for byte in word:
                    below = self.next[node].get(byte)
                    if below is None:
                        below = self.next[node][byte] = len(self.next)
                        self.next.append({})
                        piece.append(False)
                        depth_of.append(depth_of[node] + 1)
                    node = below
                if node != root:
                    piece[node] = True
        # Where matching goes on, and how many pieces are settled then. A node
        # without a link spells nothing that can be cut into pieces.
        self.link: list[int | None] = [None] * len(self.next)
        self.popped = [0] * len(self.next)
        waiting = deque([START, INSIDE])
        while waiting:
            above = waiting.popleft()
            for byte, node in self.next[above].items():
                if piece[node]:
                    self.link[node], self.popped[node] = INSIDE, 1
                else:
                    at, count = self.link[above], self.popped[above]
                    while at is not None and byte not in self.next[at]:
                        count += self.popped[at]
                        at = self.link[at]
                    if at is not None:
                        self.link[node], self.popped[node] = self.next[at][byte], count
                waiting.append(node)

    def count(self, word: bytes) -> int:
        """Pieces of a word, or UNKNOWN if it cannot be cut into pieces."""
        follow, link, popped = self.next, self.link, self.popped
        node, total = START, 0
        for byte in word:
            below = follow[node].get(byte)
            while below is None:
                total += popped[node]
                node = link[node]
                if node is None:
                    return UNKNOWN
                below = follow[node].get(byte)
            node = below
        while node > INSIDE:
            total += popped[node]
            node = link[node]
            if node is None:
                return UNKNOWN
        return total


class WordCounts(dict):
    """Pieces of each word; remembered for a bounded number of words."""

    def __init__(self, counter: PieceCounter, prefix: bytes, limit: int = REMEMBERED):
        super().__init__()
        self.counter, self.prefix, self.limit = counter, prefix, limit

    def __missing__(self, word: bytes) -> int:
        found = self.counter.count(self.prefix + word)
        if len(self) >= self.limit:
            self.clear()
        if len(word) < 100:
            self[word] = found
        return found


def byte_level_pieces(path: str) -> tuple[set[bytes], set[bytes]]:
    """Pieces of a byte-level vocabulary file: those that begin with a space begin
    words, the others go on in them."""
    from .encoding import byte_characters

    back = {c: b for b, c in enumerate(byte_characters())}
    with open(path, encoding="utf-8") as file:
        plan = json.load(file)
    special = {t["content"] for t in plan["added_tokens"]}
    pieces = {bytes(back[c] for c in t) for t in plan["model"]["vocab"] if t not in special}
    beginning = {p for p in pieces if p[:1] == b" "}
    return beginning, pieces - beginning


_COUNTS: dict[str, WordCounts] = {}


def _counts(path: str) -> WordCounts:
    if path not in _COUNTS:
        _COUNTS[path] = WordCounts(PieceCounter(*byte_level_pieces(path)), b" ")
    return _COUNTS[path]


def count_pieces(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Word pieces of each row's whole text: doc_id, n_words, n_pieces, n_unknown.

    A word, with a space before it, is cut greedily into the longest pieces of
    the byte-level vocabulary file; one that cannot be cut is one unknown piece.
    A null text has none; a null id stays null; repeated rows are counted each;
    an empty table gives no rows; other columns are ignored.
    """

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        pieces = _counts(vocabulary).__getitem__
        rows = []
        for text in text_bytes(batch.column(1)):
            found = list(map(pieces, text.split()))
            unknown = found.count(UNKNOWN)
            rows.append((len(found), sum(found) + 2 * unknown, unknown))
        columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *columns], names=["doc_id", "n_words", "n_pieces", "n_unknown"]
        )

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, n_words long, n_pieces long, n_unknown long"
    return plain.mapInArrow(in_batches(count), schema)
