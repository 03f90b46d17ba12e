import random

import numpy as np
from conftest import SF_DIR
from llm_cases import ROWS, docs

import __spark_entry__ as driver
from inkscore.llm.jaccard import Bands, entries, link_documents


def slow_sets(rows, size=4):
    found = []
    for _, text in rows:
        own = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
        found.append({tuple(own[i : i + size]) for i in range(max(1, len(own) - size + 1))} if own else set())
    return found


def slow_components(rows, percent=85, size=4):
    """doc_id, number of shingles, smallest id reachable, of each row by all pairs."""
    sets = slow_sets(rows, size)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=repr)


def copies(rng, n, length, edits):
    """A text and copies with up to ``edits`` words changed."""
    text = [f"w{rng.randrange(5000)}" for _ in range(length)]
    made = [text]
    for _ in range(n):
        own = list(text)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(len(own))] = f"e{rng.randrange(400)}"
        made.append(own)
    return [" ".join(t) for t in made]


def found_in(spark, rows, **shape):
    table = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in link_documents(table, **shape).collect()), key=repr)


def test_segments_leave_no_linked_pair_apart():
    """Any two sets within the radius share a list that one of them may probe."""
    rng = np.random.default_rng(3)
    for percent in (85, 60):
        bands = Bands(percent, 4000)
        for _ in range(60):
            n = int(rng.integers(6, 300))
            base = rng.integers(0, 2**63, n).astype(np.uint64)
            other = np.unique(np.append(base[rng.integers(0, n // 12 + 1) :], rng.integers(0, 2**63, n // 25).astype(np.uint64)))
            base = np.unique(base)
            same = len(np.intersect1d(base, other))
            if 100 * same < percent * (len(base) + len(other) - same):
                continue
            row, key, code = entries(np.concatenate([base, other]), np.array([len(base), len(other)]), bands)
            lists = [{(k, c >> 2) for r, k, c in zip(row.tolist(), key.tolist(), code.tolist()) if r == i and not c & 1} for i in (0, 1)]
            assert lists[0] & lists[1] or set(base) == set(other)


def test_components_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    texts = []
    for length, edits in ((3, 1), (5, 1), (8, 2), (20, 2), (60, 4), (150, 9), (400, 14)):
        texts += copies(rng, 24, length, edits)
    # A common passage in a third of all texts, and sets of the same few words.
    texts += [f"all of these hold one passage of nine words here u{i} v{i}" for i in range(60)]
    texts += [" ".join(f"x{(i + j) % 7}" for j in range(9)) for i in range(20)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    wanted = slow_components(rows)
    assert found_in(spark, rows) == wanted
    # Lists in blocks, and one pair for each row and round.
    assert found_in(spark, rows, together=7, pairs=1) == wanted
    assert found_in(spark, rows, percent=60, shingle=2) == slow_components(rows, 60, 2)


def test_chains_join(spark):
    """Each text is near the next one only."""
    words = [f"c{i}" for i in range(400)]
    rows = [(100 - i, " ".join(words[5 * i : 5 * i + 120])) for i in range(50)]
    found = found_in(spark, rows)
    assert found == slow_components(rows) and {r[2] for r in found} == {51}


def test_odd_documents(spark):
    rows = [(r[0], r[1]) for r in ROWS]
    found = link_documents(docs(spark))
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == slow_components(rows)
    same = [(None, "a b c d e f"), (None, "a b c d e f"), (9, "A b c d e f"), (None, "q"), (4, "q r"), (3, "q  r\n")]
    assert found_in(spark, same) == slow_components(same)
    assert link_documents(docs(spark, [])).collect() == []


def test_a_group_of_copies_moves_few_rows(spark, monkeypatch):
    """Pairs that are settled grow with the copies, not with their square."""
    from inkscore.llm import jaccard

    real, seen = jaccard._linked, []

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(jaccard, "_linked", counted)
    asked = []
    for n in (100, 200, 400):
        rng = random.Random(1)
        seen.clear()
        found_in(spark, list(enumerate(copies(rng, n, 200, 6))))
        asked.append(sum(seen))
    assert asked[1] < 3 * asked[0] + 100 and asked[2] < 3 * asked[1] + 100


def test_query(spark, duck):
    found = driver.queries()["op11_jaccard_join"](spark, SF_DIR)
    twin = duck.sql(driver.oracle_sql()["op11_jaccard_join"])
    assert found.columns == twin.columns
    assert sorted(map(tuple, found.collect())) == sorted(twin.fetchall())
