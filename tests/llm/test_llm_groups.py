import random

import xxhash
from conftest import SF_DIR
from llm_cases import ROWS, docs, words

import __spark_entry__ as driver
from inkscore.llm.components import components
from inkscore.llm.neardup import covering_masks, first_of_each, fingerprint, links, near_duplicates


def slow_fingerprint(text, shingle=3):
    found = words((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    parts = [b" ".join(found[i : i + shingle]) for i in range(len(found) - shingle + 1)]
    if found and not parts:
        parts = [b" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_labels(values, radius=3):
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= radius:
                a_root, b_root = root(i), root(j)
                parent[max(a_root, b_root)] = min(a_root, b_root)
    return [root(i) for i in range(len(values))]


def test_masks_cover_every_pair_in_the_radius():
    rng = random.Random(3)
    for radius in (1, 2, 3):
        free = sorted(rng.sample(range(64), 40))
        masks = covering_masks(free, radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(2000):
            apart = sum(1 << b for b in rng.sample(free, radius))
            assert any(not apart & m for m in masks)


def test_links_of_crowded_buckets(spark):
    """Many fingerprints around a few centres, with buckets small enough to be refined."""
    rng = random.Random(8)
    values = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(120):
            flips = rng.sample(range(64), rng.randint(0, 6))
            values.add(centre ^ sum(1 << b for b in flips))
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    table = spark.createDataFrame([(v,) for v in signed], "fp long")
    wanted = slow_labels(values)
    for together in (4096, 20):
        found = links(table, 3, together).collect()
        joined = {v: i for i, v in enumerate(signed)}
        parent = list(range(len(values)))

        def root(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in found:
            x, y = root(joined[a]), root(joined[b])
            parent[max(x, y)] = min(x, y)
        assert [root(i) for i in range(len(values))] == wanted


def test_components_of_paths_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)]
    edges += [(200, 200), (161, 160), (161, 162)]
    rng.shuffle(edges)
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    wanted = {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 160)} | {161: 160, 162: 160}
    assert found == wanted
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_fingerprint():
    for text in ["", "  ", "One", "one TWO", "a b c d e f", "É é x y z", ROWS[0][1] * 40]:
        assert fingerprint(text.encode()) == slow_fingerprint(text)


def check_groups(rows, found):
    values = [slow_fingerprint(t) for _, t in rows]
    labels = slow_labels(values)
    least = {}
    for (doc_id, _), label in zip(rows, labels):
        if doc_id is not None:
            least[label] = min(doc_id, least.get(label, doc_id))
    wanted = sorted(
        repr((d, f"{v:016x}", least.get(label))) for (d, _), v, label in zip(rows, values, labels)
    )
    assert sorted(repr(tuple(r)) for r in found) == wanted


def test_groups_of_odd_documents(spark):
    check_groups([r[:2] for r in ROWS], near_duplicates(docs(spark)).collect())
    assert near_duplicates(docs(spark, [])).collect() == []
    kept = first_of_each(docs(spark))
    assert kept.columns == docs(spark).columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    # 2, 3, 4 and the null text are one group without words; 10 copies 1, 8 itself.
    assert ids == [(False, i) for i in (1, 2, 5, 6, 7, 8, 9)] + [(True, 0)]
    assert first_of_each(docs(spark, [])).collect() == []


def test_groups_query(spark):
    found = driver.queries()["op5_simhash_covering"](spark, SF_DIR).collect()
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    check_groups([tuple(r) for r in rows], found)
