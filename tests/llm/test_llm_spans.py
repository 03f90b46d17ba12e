import hashlib
import random

import numpy as np
import pytest
from conftest import SF_DIR
from llm_cases import PASSAGE, ROWS, docs, words

import __spark_entry__ as driver
from inkscore.llm.spans import least_in_windows, remove_repeats, with_repeats_removed


def slow_repeats(rows, size):
    """Rows (id, text) with ids all different: id -> kept words and removed places."""
    seen, found = set(), {}
    for doc_id, text in sorted(rows):
        own = words(text)
        gone = set()
        for i in range(len(own) - size + 1):
            window = tuple(own[i : i + size])
            if window in seen:
                gone.update(range(i, i + size))
            seen.add(window)
        found[doc_id] = (len(own), len(gone), b" ".join(w for i, w in enumerate(own) if i not in gone))
    return found


def test_least_in_windows():
    rng = np.random.default_rng(1)
    for width in (1, 2, 5, 15):
        values = rng.integers(0, 4, 60).astype(np.uint64)
        wanted = [i + int(np.argmin(values[i : i + width])) for i in range(60 - width + 1)]
        assert least_in_windows(values, width).tolist() == wanted


@pytest.mark.parametrize("seed", range(3))
def test_random_texts_full_of_repeats(spark, seed):
    rng = random.Random(seed)
    rows = []
    for doc_id in range(60):
        text = [rng.choice("ab c d e".split()) for _ in range(rng.randint(0, 40))]
        if rows and rng.random() < 0.5:
            other = rng.choice(rows)[1].split()
            at = rng.randint(0, len(text))
            text[at:at] = other[rng.randint(0, 5) :]
        rows.append((doc_id, " ".join(text)))
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = remove_repeats(table, size=5, kmer=2).collect()
    wanted = slow_repeats(rows, 5)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"].encode()) for r in found} == wanted
    for r in found:
        assert sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"]


def test_odd_documents(spark):
    found = remove_repeats(docs(spark)).collect()
    assert len(found) == len(ROWS)
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], []).append(r)
    assert [r["n_removed"] for r in by[8]] == [60, 60]
    assert [r["kept"] for r in by[8]] == ["something else then the end"] * 2
    assert by[7][0]["n_removed"] == 0 and PASSAGE in by[7][0]["kept"]
    assert {(r["n_words"], r["n_removed"]) for r in by[2] + by[3] + by[4]} == {(0, 0)}
    assert by[6][0]["n_words"] == 30_000 and by[6][0]["n_removed"] == 0
    assert remove_repeats(docs(spark, [])).collect() == []


def test_rows_keep_their_columns(spark):
    table = docs(spark)
    found = with_repeats_removed(table)
    assert found.schema.simpleString() == table.schema.simpleString()
    before = sorted(map(repr, table.where("doc_id IS NULL OR doc_id <> 8").collect()))
    assert sorted(map(repr, found.where("doc_id IS NULL OR doc_id <> 8").collect())) == before
    for r in found.where("doc_id = 8").collect():
        assert r["text"] == "something else then the end" and r["n_chars"] == len(r["text"])
    assert with_repeats_removed(docs(spark, [])).collect() == []


def test_spans_query(spark, duck):
    name = "op10_de_bruijn_spans"
    found = sorted(map(tuple, driver.queries()[name](spark, SF_DIR).collect()))
    assert found == sorted(duck.sql(driver.oracle_sql()[name]).fetchall())
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    wanted = {
        d: (n, gone, hashlib.sha256(kept).hexdigest())
        for d, (n, gone, kept) in slow_repeats([tuple(r) for r in rows], 20).items()
    }
    assert {r[0]: r[1:] for r in found} == wanted
