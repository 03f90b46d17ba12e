"""Documents linked by the Jaccard similarity of their word shingles.

Two sets of sizes x and y at a similarity of p % differ in at most
H = (x + y) (100 - p) / (100 + p) tokens. Sets are grouped by size band, and a
band hashes the universe of tokens into m > H segments. H differing tokens
leave some segment equal on both sides, and more: if a set picks segments at
value 1 (equal) or 2 (equal but for one token) worth more than H together, one of
the picked segments holds what was picked for it. So every set is indexed under
the content of each of its segments, and, for a few segments of the band,
under that content less any one token; then it picks, by the measured lengths of the
lists it would meet, the cheapest segments that are worth enough. Lists of one set
cost nothing, so a set with many tokens of its own often meets nobody.

Sets that meet are compared by a parity sketch, whose differing bits never
exceed the differing tokens, and what it cannot exclude is settled by the sets
themselves. Equal sets are one node from the start. In the first round a list
yields a forest over the pairs that look near; the following rounds take the
pairs between nodes that are still apart, so what moves stays in proportion
to the lists and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import WORD_HASHES, free, in_batches, mix, settle, text_bytes

SHINGLE = 4
PERCENT = 85
BAND = 1.5
# One more segment with neighbourhoods for so many segments of a band.
NEIGHBOURS = 16
# Rows of one list that are compared in one task; longer lists are dealt as
# pairs of blocks of this size.
TOGETHER = 4096
SKETCH_BITS, WIDE_BITS = 512, 4096
# Pairs that a row of a list may yield in the first round that is no forest.
PAIRS = 64
WORDS_AT_ONCE = 200_000
# Sets that a task remembers having sent, and bits of the sieve for texts.
SEEN = 200_000
SIEVE_BITS = 1 << 24
STEP = np.uint64(0x9E3779B97F4A7C15)
LANES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


class Bands:
    """Sizes of sets by band, with the segments of each.

    ``m`` segments, of which the last ``d`` have neighbourhoods.
    """

    def __init__(self, percent: int, largest: int):
        self.percent = percent
        ratio = max(BAND, 100 / percent)
        edges = [1]
        while edges[-1] <= 100 * largest // percent:
            edges.append(int(edges[-1] * ratio) + 1)
        self.low = np.array(edges, np.int64)
        high = np.append(self.low[1:] - 1, int(edges[-1] * ratio))
        self.high = high
        self.m = self.most(high, high) + 1
        self.d = np.where(self.m > 1, 1 + self.m // NEIGHBOURS, 0)

    def most(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Differing tokens of two linked sets of these sizes, at most."""
        return (x + y) * (100 - self.percent) // (100 + self.percent)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, sizes, "right") - 1

    def reach(self, sizes: np.ndarray) -> np.ndarray:
        """The size of the largest set that can be linked."""
        return 100 * sizes // self.percent


def shingles(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text's shingles in order, joined, and their numbers.

    A text of fewer words is one shingle; one without words has none.
    """
    words = [WORD_HASHES.of(text.lower().split()) for text in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    joined = np.concatenate(words) if words else np.zeros(0, np.uint64)
    ends = np.repeat(np.cumsum(lengths), lengths)
    at = np.arange(len(joined))
    found = np.full(len(joined), size, np.uint64)
    for offset in range(size):
        # Past a text's end nothing is mixed in, but the number of words is.
        found = mix(found * STEP + joined[np.minimum(at + offset, ends - 1)]) if len(joined) else found
    owner = np.repeat(np.arange(len(texts)), lengths)
    whole = at + size <= ends
    short = np.flatnonzero((lengths > 0) & (lengths < size))
    firsts = (np.cumsum(lengths) - lengths)[short]
    for row, first in zip(short.tolist(), firsts.tolist()):
        value = np.full(1, lengths[row], np.uint64)
        for word in joined[first : first + lengths[row]]:
            value = mix(value * STEP + word)
        found[first], whole[first] = value[0], True
    found, owner = found[whole], owner[whole]
    order = np.lexsort([found, owner])
    found, owner = found[order], owner[order]
    if len(found):
        new = np.append(True, (found[1:] != found[:-1]) | (owner[1:] != owner[:-1]))
        found, owner = found[new], owner[new]
    return found, np.bincount(owner, minlength=len(texts))


def _chunks(texts: list[bytes]) -> Iterator[slice]:
    """Ranges of texts that are worked on together."""
    low = total = 0
    for at, text in enumerate(texts):
        total += 1 + len(text) // 6
        if total >= WORDS_AT_ONCE:
            yield slice(low, at + 1)
            low, total = at + 1, 0
    if low < len(texts):
        yield slice(low, len(texts))


def entries(tokens: np.ndarray, sizes: np.ndarray, bands: Bands) -> tuple[np.ndarray, ...]:
    """Index entries of several sets: row, key, code.

    A code is 4 * segment + 2 if the set is a visitor from the band below, + 1 if
    a token is left out.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    own = bands.of(np.maximum(sizes, 1))
    made = []
    for visitor in (0, 1):
        band = own + visitor
        m = bands.m[band]
        there = (sizes > 0) & (m > 1)
        if visitor:
            there &= bands.reach(sizes) >= bands.low[band]
        start = np.cumsum(np.where(there, m, 0)) - np.where(there, m, 0)
        total = int(np.where(there, m, 0).sum())
        if not total:
            continue
        inside = there[owner]
        token, row = tokens[inside], owner[inside]
        seg = ((mix(token) >> np.uint64(32)) * m[row].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        value = mix(token ^ LANES[0])
        sums = np.zeros(total, np.uint64)
        place = start[row] + seg
        np.add.at(sums, place, value)
        row_of = np.repeat(np.arange(len(sizes))[there], m[there])
        seg_of = np.arange(total) - start[row_of]
        salt = mix((band[row_of].astype(np.uint64) << np.uint64(32)) + seg_of.astype(np.uint64))
        made.append((row_of, mix(sums + salt), 4 * seg_of + 2 * visitor))
        near = seg >= (m - bands.d[band])[row]
        at = place[near]
        made.append((row[near], mix(sums[at] - value[near] + salt[at]), 4 * seg[near] + 2 * visitor + 1))
    if not made:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*made))


PREPARED = "doc_id long, t1 long, t2 long, n long, node long, need int, m int, d int"


def _texts(docs: DataFrame) -> DataFrame:
    """The rows as id, 128 bits of the text, and the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text).alias("t1"),
        F.xxhash64(F.lit("and"), text).alias("t2"),
        text.alias("text"),
    )


def contents(tokens: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of each set, by which equal ones are one node."""
    total = np.zeros(len(n), np.uint64)
    np.add.at(total, np.repeat(np.arange(len(n)), n), mix(tokens ^ LANES[1]))
    return mix(total + n.astype(np.uint64))


def _prepare(docs: DataFrame, size: int, bands: Bands) -> DataFrame:
    """Each row's number of shingles, its node, and what its band asks of it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for part in _chunks(texts):
                tokens, n = shingles(texts[part], size)
                band = bands.of(np.maximum(n, 1))
                need = bands.most(n, np.minimum(bands.high[band], bands.reach(n))) + 1
                own = batch.slice(part.start, len(n))
                yield pa.RecordBatch.from_arrays(
                    [
                        *[own.column(c) for c in ("doc_id", "t1", "t2")],
                        pa.array(n.astype(np.int64)),
                        pa.array(contents(tokens, n).view(np.int64)),
                        *[pa.array(c.astype(np.int32)) for c in (need, bands.m[band], bands.d[band])],
                    ],
                    names=["doc_id", "t1", "t2", "n", "node", "need", "m", "d"],
                )

    return _texts(docs).mapInArrow(run, PREPARED)


ALONE, KNOWN, WITNESS = 0, 1, 2
SENT = "route long, node long, code int, key long"


def _index(docs: DataFrame, size: int, bands: Bands) -> DataFrame:
    """Index entries on their way to their lists: route, node, code, key.

    A task sends each set once. An entry whose list has another in the same batch is
    known to meet someone: it goes anywhere (its key beside it), and one witness for
    all of them goes to the list; so no task gets all entries of a long list.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for part in _chunks(texts):
                tokens, n = shingles(texts[part], size)
                node = contents(tokens, n).view(np.int64)
                _, first = np.unique(node, return_index=True)
                fresh = np.zeros(len(n), bool)
                fresh[[i for i in first.tolist() if node[i] not in seen]] = True
                if len(seen) < SEEN:
                    seen.update(node[fresh].tolist())
                row, key, code = entries(tokens[np.repeat(fresh, n)], n[fresh], bands)
                order = np.argsort(key, kind="stable")
                key, code, own = key[order].view(np.int64), code[order], node[fresh][row[order]]
                new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
                known = ~(new & np.append(new[1:], True)) if len(key) else new
                head = np.flatnonzero(known & new)
                elsewhere = mix(own.view(np.uint64) * STEP + key.view(np.uint64)).view(np.int64)
                sent = np.append(np.arange(len(key)), head)
                kind = np.append(np.where(known, KNOWN, ALONE), np.full(len(head), WITNESS))
                aside = kind == KNOWN
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.where(aside, elsewhere[sent], key[sent])),
                        pa.array(own[sent]),
                        pa.array((4 * code[sent] + kind).astype(np.int32)),
                        pa.array(key[sent], mask=~aside),
                    ],
                    names=["route", "node", "code", "key"],
                )

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, SENT)


def _meeting(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries, sorted by route, whose list has another one: key, node, code."""
    carry, told = np.zeros((0, 3), np.int64), True  # the last entry, and whether it went on
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        route, node, code = (batch.column(c).to_numpy() for c in ("route", "node", "code"))
        rows = np.stack([route, node, code.astype(np.int64), batch.column("key").fill_null(0).to_numpy()], axis=1)
        # Another task may have sent the same entry of the same set.
        fresh = np.append(before is None or (rows[0] != before).any(), (rows[1:] != rows[:-1]).any(axis=1))
        before = rows[-1]
        rows = rows[fresh]
        aside = rows[:, 2] % 4 == KNOWN
        known = np.stack([rows[aside, 3], rows[aside, 1], rows[aside, 2] // 4], axis=1)
        rest = np.concatenate([carry, rows[~aside, :3]])
        out = [known]
        if len(rest):
            same = rest[1:, 0] == rest[:-1, 0]
            meets = np.append(False, same) | np.append(same, False)
            go = meets & (rest[:, 2] % 4 == ALONE)
            if len(carry) and told:
                go[0] = False
            told = bool(meets[-1]) if len(rest) > len(carry) else told or bool(meets[-1])
            carry = rest[-1:]
            going = rest[go]
            out.append(np.stack([going[:, 0], going[:, 1], going[:, 2] // 4], axis=1))
        found = np.concatenate(out)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(found[:, 2].astype(np.int32))],
            names=["key", "node", "code"],
        )


def _met(docs: DataFrame, size: int, bands: Bands) -> DataFrame:
    """Index entries whose list has someone to meet: key, node, code, n0, n1.

    n0 counts the list's whole segments, n1 those less a token.
    """
    sent = _index(docs, size, bands).repartition("route").sortWithinPartitions("route", "node", "code")
    rows = settle(sent.mapInArrow(_meeting, "key long, node long, code int"), "entries")
    less = F.col("code").bitwiseAND(1)
    counts = (
        rows.groupBy("key")
        .agg(F.sum(1 - less).alias("n0"), F.sum(less).alias("n1"))
        .where((F.col("n0") >= 2) | ((F.col("n0") >= 1) & (F.col("n1") >= 1)))
    )
    met = settle(rows.join(counts, "key"), "met")
    free(rows)
    return met


EQUAL, NEAR = 1, 2


def allocate(met: DataFrame, nodes: DataFrame) -> DataFrame:
    """What each set probes: node, and a map from unit (code without its last bit) to
    EQUAL, NEAR or their sum: whether it looks for equal segments, and for those of
    one token's difference.

    An equal segment is worth 1 and costs the others of its list; its neighbourhood is
    worth 1 more and costs the lists of that. Lists of nobody else are free and are
    taken first, then the cheapest, until the worth passes the differing tokens.
    """
    unit = F.shiftright("code", 1).alias("unit")
    less = F.col("code").bitwiseAND(1) == 1
    lists = (
        met.where(F.col("code").bitwiseAND(2) == 0)
        .groupBy("node", unit)
        .agg(
            F.max(F.when(less, 0).otherwise(F.col("n0") - 1)).alias("equal"),
            F.sum(F.when(less, F.col("n0")).otherwise(F.col("n1"))).alias("near"),
        )
        .join(nodes.select("node", "need", "m", "d"), "node")
    )
    has_near = F.shiftright("unit", 1) >= F.col("m") - F.col("d")

    def choice(cost: Column, kind: int) -> Column:
        return F.struct(cost.alias("cost"), F.lit(kind).alias("kind"), F.col("unit").alias("unit"))

    offered = F.array_compact(
        F.array(
            F.when(F.col("equal") > 0, choice(F.col("equal"), EQUAL)),
            F.when(has_near & (F.col("equal") + F.col("near") > 0), choice(F.col("equal") + F.col("near"), NEAR)),
        )
    )
    by_node = lists.groupBy("node").agg(
        F.first("need").alias("need"),
        F.first(F.col("m") + F.col("d")).alias("worth"),
        F.array_sort(F.flatten(F.collect_list(offered))).alias("offered"),
    )
    short = F.col("need") - (F.col("worth") - F.size("offered"))
    taken = by_node.where(short > 0).select("node", F.slice("offered", F.lit(1), short).alias("t"))
    units = F.array_distinct(F.transform("t", lambda o: o["unit"]))

    def kinds(u: Column) -> Column:
        own = F.filter("t", lambda o: o["unit"] == u)
        return F.aggregate(own, F.lit(0), lambda total, o: total + o["kind"])

    return taken.select("node", F.map_from_arrays(units, F.transform(units, kinds)).alias("probes"))


def _sketch(tokens: np.ndarray, bits: int) -> bytes:
    """Bit i: whether the number of tokens that fall on i is odd."""
    place = (mix(tokens ^ LANES[1]) >> np.uint64(40)).astype(np.int64) % bits
    odd = np.bincount(place, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _sieve(chosen: DataFrame) -> np.ndarray:
    """SIEVE_BITS bits, set where a chosen row's hash falls."""
    place = F.pmod(F.xxhash64("doc_id", "t1"), F.lit(SIEVE_BITS)).cast("int")
    places = chosen.select(place.alias("place")).distinct().toArrow().column("place").to_numpy()
    bits = np.zeros(SIEVE_BITS, bool)
    bits[places] = True
    return np.packbits(bits, bitorder="little")


def _sets(docs: DataFrame, chosen: DataFrame, size: int) -> DataFrame:
    """The sets of the chosen nodes, from their texts: node, n, data, sketch.

    A sieve of fixed size holds back most texts but the first of each chosen node;
    sets that pass it by chance belong to nodes that nobody asks for.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_sieve(chosen))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = shared.value
        for batch in batches:
            place = batch.column("t1").to_numpy() % SIEVE_BITS
            held = sieve[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1
            texts = text_bytes(batch.column("text").filter(pa.array(held)))
            for part in _chunks(texts):
                tokens, n = shingles(texts[part], size)
                each = np.split(tokens, np.cumsum(n)[:-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(contents(tokens, n).view(np.int64)),
                        pa.array(n.astype(np.int64)),
                        pa.array([t.tobytes() for t in each], pa.binary()),
                        pa.array([_sketch(t, SKETCH_BITS) for t in each], pa.binary()),
                    ],
                    names=["node", "n", "data", "sketch"],
                )

    own = _texts(docs).withColumn("t1", F.xxhash64("doc_id", "t1")).select("t1", "text")
    sets = settle(own.mapInArrow(run, "node long, n long, data binary, sketch binary"), "sets")
    repeated = sets.groupBy("node").count().where("count > 1")
    if not repeated.limit(1).count():
        return sets
    # Rows that repeat id and text, or copies that pass the sieve.
    once = settle(sets.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "data", "sketch")]), "sets")
    free(sets)
    return once


def _near(rows: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of rows may be linked and have to be asked for it."""
    code, equal, near = rows["less"], rows["equal"], rows["near"]
    a, b = rows["n"][i], rows["n"][j]
    both = ~code[i] & ~code[j]
    ask = (both & (equal[i] | equal[j])) | ((code[i] != code[j]) & (near[i] | near[j]))
    ask &= (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (rows["node"][i] != rows["node"][j])
    ask &= (rows["label"][i] != rows["label"][j]) & (rows["own"][i] != rows["own"][j])
    at = np.flatnonzero(ask)
    sketch, most = rows["sketch"], (a + b)[at] * (100 - percent) // (100 + percent)
    for low in range(0, len(at), 1 << 14):
        some = at[low : low + (1 << 14)]
        differ = np.bitwise_count(sketch[i[some]] ^ sketch[j[some]]).sum(axis=1, dtype=np.int64)
        ask[some] = differ <= most[low : low + (1 << 14)]
    return np.flatnonzero(ask)


def forest(rows: dict[str, np.ndarray], run: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that join what all near pairs of each run join: fewer than rows."""
    n = len(run)
    # Rows of one node stand side by side and are one from the start.
    new = np.append(True, (run[1:] != run[:-1]) | (rows["node"][1:] != rows["node"][:-1]))
    parent = np.flatnonzero(new)[np.cumsum(new) - 1]
    made: list[tuple[np.ndarray, np.ndarray]] = []
    at, shift = np.arange(n), 0
    while len(at):
        shift += 1
        at = at[at + shift < n]
        at = at[run[at] == run[at + shift]]
        open_ = at[parent[at] != parent[at + shift]]
        hit = open_[_near(rows, open_, open_ + shift, percent)]
        while len(hit):
            a, b = parent[hit], parent[hit + shift]
            low, high = np.minimum(a, b), np.maximum(a, b)
            # One pair for each root that is moved; the others look again.
            root, first = np.unique(high, return_index=True)
            parent[root] = low[first]
            made.append((hit[first], hit[first] + shift))
            while (parent[parent] != parent).any():
                parent = parent[parent]
            hit = hit[parent[hit] != parent[hit + shift]]
    if not made:
        return at, at
    return tuple(np.concatenate(c) for c in zip(*made))


def across(rows: dict[str, np.ndarray], run: np.ndarray, percent: int, pairs: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Near pairs of different labels, at most ``pairs`` for each row, and whether there are more."""
    n = len(run)
    given, more = np.zeros(n, np.int64), False
    made = [(np.zeros(0, np.int64),) * 2]
    at, shift = np.arange(n), 0
    while len(at):
        shift += 1
        at = at[at + shift < n]
        at = at[run[at] == run[at + shift]]
        hit = at[_near(rows, at, at + shift, percent)]
        fits = (given[hit] < pairs) | (given[hit + shift] < pairs)
        more |= not fits.all()
        hit = hit[fits]
        given[hit] += 1
        given[hit + shift] += 1
        made.append((hit, hit + shift))
    return (*(np.concatenate(c) for c in zip(*made)), more)


def _asked(bucket: DataFrame, sets: DataFrame, labels: DataFrame | None, percent: int, together: int, pairs: int) -> DataFrame:
    """Pairs (a, b) of nodes to settle; a row (null, null) if a list has yet more.

    Without labels, a forest over the near pairs of each list; with labels, the near
    pairs whose labels differ.
    """
    rows, first = bucket, labels is None
    bits = SKETCH_BITS if first else WIDE_BITS
    own = sets.select("node", "n", "sketch")
    if first:
        rows = rows.withColumn("label", F.col("node"))
    else:
        known = labels.withColumnRenamed("node", "_node")
        rows = rows.join(known, F.col("node") == F.col("_node"), "left").withColumn("label", F.coalesce("label", "node"))
        apart = rows.groupBy("key").agg(F.min("label").alias("l1"), F.max("label").alias("l2")).where("l1 <> l2")
        rows = rows.join(apart.select("key"), "key", "left_semi").drop("_node")

        def widen(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [_sketch(np.frombuffer(d, np.uint64), WIDE_BITS) for d in batch.column("data").to_pylist()]
            return pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("n"), pa.array(made, pa.binary())], names=["node", "n", "sketch"]
            )

        own = sets.select("node", "n", "data").mapInArrow(in_batches(widen), "node long, n long, sketch binary")
    # Short rows are dealt into blocks before their sketches come to them.
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / together).cast("int").alias("blocks")).where("blocks > 1")
    dealt = rows.join(sizes, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.join(own, "node").select(
        "key",
        F.least("own", "other").alias("b1"),
        F.greatest("own", "other").alias("b2"),
        # Where two blocks meet, rows of one block are not compared again.
        F.when(F.col("own") == F.col("other"), F.col("node")).otherwise(-1 - F.col("own")).alias("own"),
        "node", "label", "n", (F.col("code").bitwiseAND(1) == 1).alias("less"), "equal", "near", "sketch",
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def found(table: pa.Table) -> pa.RecordBatch:
            own = {c: table.column(c).to_numpy() for c in ("key", "b1", "b2", "own", "node", "label", "n", "less", "equal", "near")}
            data = b"".join(table.column("sketch").to_pylist())
            own["sketch"] = np.frombuffer(data, np.uint64).reshape(len(own["key"]), bits // 64)
            new = (np.diff(own["key"]) != 0) | (np.diff(own["b1"]) != 0) | (np.diff(own["b2"]) != 0)
            number = np.append(0, np.cumsum(new))
            more = False
            if first:
                i, j = forest(own, number, percent)
            else:
                i, j, more = across(own, number, percent, pairs)
            a, b = own["node"][i], own["node"][j]
            low, high = np.minimum(a, b).tolist(), np.maximum(a, b).tolist()
            if more:
                low.append(None)
                high.append(None)
            return pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["a", "b"])

        def key_of(table: pa.Table, at: int) -> tuple:
            return tuple(table.column(c)[at].as_py() for c in ("key", "b1", "b2"))

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            last, at = key_of(table, -1), len(table) - batch.num_rows
            # The last list may go on in the next batch.
            if key_of(table, 0) != last:
                keys = [table.column(c).to_numpy() for c in ("key", "b1", "b2")]
                at = int(np.flatnonzero(np.any([k != v for k, v in zip(keys, last)], axis=0))[-1]) + 1
                yield found(table.slice(0, at).combine_chunks())
                rest = table.slice(at)
            else:
                rest = table
        if rest is not None and len(rest):
            yield found(rest.combine_chunks())

    dealt = dealt.repartition("key", "b1", "b2").sortWithinPartitions("key", "b1", "b2", "node", "less")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are similar enough."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        keep = []
        for x, y in zip(batch.column("x"), batch.column("y")):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            same = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * same >= percent * (len(x) + len(y) - same))
        kept = batch.filter(pa.array(keep, pa.bool_()))
        return pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], names=["a", "b"])

    first = sets.select(F.col("node").alias("a"), F.col("data").alias("x"))
    second = sets.select(F.col("node").alias("b"), F.col("data").alias("y"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(in_batches(run), "a long, b long")


def link_documents(
    docs: DataFrame,
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    together: int = TOGETHER,
    pairs: int = PAIRS,
) -> DataFrame:
    """Components of documents whose shingle sets are similar: doc_id, n_shingles,
    component_id (the smallest id reachable by links, the own included).

    A set holds the distinct runs of ``shingle`` lower-cased (A-Z) words; a text of
    fewer words is one run. Two sets are linked if 100 times their intersection is at
    least ``percent`` times their union. Null and blank texts have no set and are
    linked with nothing, so they keep their own id. Repeated rows are rows of one component; a
    null id is kept and is a component's id only where it has no other. An empty
    table gives no rows; other columns are ignored. Shingles, and sets for being
    equal, are told apart by hashes of 64 bits.
    """
    largest = docs.agg(F.max(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    bands = Bands(percent, 1 + largest // 2)
    prepared = settle(_prepare(docs, shingle, bands), "prepared")
    parts = ("n", "need", "m", "d", "doc_id", "t1", "t2")
    nodes = settle(
        prepared.where("n > 0").groupBy("node").agg(F.min(F.struct(*parts)).alias("one")).select("node", "one.*"),
        "nodes",
    )
    met = _met(docs, shingle, bands)
    # Dealt by node once, for the allocation and for its answer.
    own = met.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "node")
    probes = allocate(own, nodes)
    kind = F.coalesce(F.element_at("probes", F.shiftright("code", 1)), F.lit(0))
    flagged = own.join(probes, "node", "left").select(
        "key", "node", "code",
        (kind.bitwiseAND(EQUAL) > 0).alias("equal"), (kind.bitwiseAND(NEAR) > 0).alias("near"),
    )
    flagged = settle(flagged, "flagged")
    asking = flagged.where("equal or near").select("key").distinct()
    bucket = settle(flagged.join(asking, "key", "left_semi"), "bucket")
    free(met, flagged)
    chosen = nodes.join(bucket.select("node").distinct(), "node", "left_semi")
    sets = _sets(docs, chosen, shingle)

    asked = settle(_asked(bucket, sets, None, percent, together, pairs), "asked")
    links = settle(_linked(asked, sets, percent), "linked")
    labels = components(links)
    # A list whose pairs all proved to be links, or that had none, is settled by them.
    failed = asked.join(links, ["a", "b"], "left_anti")
    doubtful = failed.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    keys = bucket.join(doubtful, "node", "left_semi").select("key").distinct()
    left = settle(bucket.join(keys, "key", "left_semi"), "left")
    more = left.limit(1).count() > 0
    while more:
        new = _asked(left, sets, labels, percent, together, pairs)
        # Pairs that are settled need not be asked for again.
        new = settle(new.join(asked, ["a", "b"], "left_anti"), "asked")
        more = new.where("a IS NULL").limit(1).count() > 0
        pairs *= 8
        found = settle(_linked(new.where("a IS NOT NULL"), sets, percent), "linked")
        if found.limit(1).count():
            links = settle(links.unionByName(found), "links")
            labels = components(links)
        asked = settle(asked.unionByName(new.where("a IS NOT NULL")), "asked")
    free(bucket, left, sets, asked)

    rows = prepared.select("doc_id", "n", "node")
    with_set = rows.where("n > 0").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = with_set.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    linked = with_set.join(least, "label").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)
