import random
import re
from collections import Counter

import numpy as np
from conftest import SF_DIR
from llm_cases import ROWS, docs

import __spark_entry__ as driver
from inkscore.llm import collocations
from inkscore.llm.collocations import (
    NEVER,
    OPEN,
    Names,
    Scan,
    count_phrases,
    dealt_texts,
    marks_of,
    mine_collocations,
    name_phrases,
    places_of,
)


def slow_pieces(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [re.findall(r"[^ \t]+", piece) for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low)]


def slow_counts(rows, longest):
    found = Counter()
    for lang, text in rows:
        for piece in slow_pieces(text):
            for k in range(1, longest + 1):
                for i in range(len(piece) - k + 1):
                    found[lang or "und", tuple(piece[i : i + k])] += 1
    return found


def slow_mine(rows, longest=3, least=10, inside=50, top=2000):
    f = slow_counts(rows, longest)
    n = Counter()
    for (lang, phrase), count in f.items():
        n[lang] += count * (len(phrase) == 1)
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    most = Counter()
    for (lang, phrase), a in candidates.items():
        for size in range(2, len(phrase)):
            for i in range(len(phrase) - size + 1):
                key = lang, phrase[i : i + size]
                most[key] = max(most[key], a)
    scored = {}
    for (lang, phrase), a in candidates.items():
        if 100 * most[lang, phrase] >= inside * a:
            continue
        cuts = []
        for k in range(1, len(phrase)):
            left, right = f[lang, phrase[:k]], f[lang, phrase[k:]]
            cuts.append((10**6 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        scored.setdefault(lang, []).append((-score, -a, " ".join(phrase).encode(), left, right))
    out = []
    for lang, own in scored.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(own)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def prose(rng, rows, words):
    """Texts whose words repeat unevenly, with set phrases in them."""
    made = []
    for i in range(rows):
        text = []
        for _ in range(rng.randint(0, words)):
            text.append(f"w{int(rng.paretovariate(0.7)) % 300}")
            if rng.random() < 0.1:
                text.append(rng.choice(["New York City", "in spite of", "Ärger über", "a.b", "x,\ty z", "of of of of"]))
            if rng.random() < 0.1:
                text.append(rng.choice(".,;:!?\n\r\x0b\x0c"))
        made.append((i, " ".join(text), rng.choice(["en", "en", "en", "de", None])))
    return made


def found_in(spark, rows, **shape):
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return sorted(tuple(r) for r in mine_collocations(table, **shape).collect())


def test_phrases_are_those_of_plain_counts(spark):
    rows = prose(random.Random(2), 300, 80)
    plain = [(lang, text) for _, text, lang in rows]
    assert found_in(spark, rows) == slow_mine(plain)
    assert found_in(spark, rows, longest=5, least=4, inside=80, top=7, shards=3) == slow_mine(plain, 5, 4, 80, 7)


def test_counts_do_not_depend_on_the_table_of_marks(spark):
    """Marks that others set, down to a single place, make more phrases active; counts stay."""
    rows = prose(random.Random(4), 120, 60)
    wanted = slow_mine([(lang, text) for _, text, lang in rows])
    for slots, shards in ((1, 2), (50, 4), (1 << 20, 1)):
        assert found_in(spark, rows, slots=slots, shards=shards) == wanted


def test_inactive_phrases_are_not_counted(spark):
    rows = [(i, f"common words here u{i} v{i}", "en") for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts = dealt_texts(table, 3)
    frequent = count_phrases(texts, 3, 10)
    # Three common words, their phrases, and the language.
    assert sorted(r["f"] for r in frequent.collect()) == [60] * 6 + [300]
    named = {(r["k"], r["lang"], r["phrase"], r["f"]) for r in name_phrases(texts, frequent, 3).collect()}
    assert named == {(0, "en", "", 300), (3, "en", "common words here", 60)} | {
        (w.count(" ") + 1, "en", w, 60) for w in ("common", "words", "here", "common words", "words here")
    }
    marks = np.full(1 << 16, NEVER, np.uint8)
    scan = Scan(1, marks, 3, 3)
    rows = [(b"en", f"common words here u{i}".encode()) for i in range(5)]
    # Without marks, words and the language alone are counted.
    assert sum(batch.num_rows for batch in scan.of(rows)) == 3 + 5 + 1


def test_a_phrase_is_told_by_the_first_portion_that_has_it(spark, monkeypatch):
    """Names that a portion of the texts has told are not read from the others again."""
    rows = prose(random.Random(8), 400, 60) + [(1000 + i, "", "en") for i in range(3)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts = dealt_texts(table, 3)
    frequent = count_phrases(texts, 3, 4)
    plain = slow_counts([(lang, text) for _, text, lang in rows], 3)
    wanted = sorted((len(p), lang, " ".join(p), n) for (lang, p), n in plain.items() if n >= 4)
    for slots in (1 << 24, 200):
        settled, settle = [], collocations.settle

        def counted(df, name):
            made = settle(df, name)
            settled.append(made.count())
            return made

        with monkeypatch.context() as patch:
            patch.setattr(collocations, "settle", counted)
            named = [tuple(r) for r in name_phrases(texts, frequent, 3, slots).collect()]
        assert sorted(r for r in named if r[0]) == wanted
        assert sum(settled) == len(named) == frequent.count() and len(settled) > 1
    # What is told and what is open, and what shares its places, in one table.
    one = Names(np.full(64, OPEN, np.uint8), 2)
    assert sum(b.num_rows for b in one.of([(b"en", b"a b a b")])) == 1 + 2 + 2
    assert sum(b.num_rows for b in one.of([(b"en", b"a b c")])) == 1 + 1
    assert sum(b.num_rows for b in Names(np.zeros(64, np.uint8), 2).of([(b"en", b"a b")])) == 0


def test_scans_read_numbers_and_send_arrays(spark, monkeypatch):
    """Texts are cut into words once; counts move as a row for each bucket, not for each phrase."""
    rows = prose(random.Random(5), 300, 80)
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    texts = dealt_texts(table, 3)
    assert "text" not in texts.columns
    # A shard and a language have one block here, in which each word stands once.
    found = Counter()
    blocks = texts.collect()
    assert len({(r["shard"], r["lang"]) for r in blocks}) == len(blocks) == 9
    for r in blocks:
        words = ["", *r["words"].decode().split("\n")[:-1]]
        assert len(set(words)) == len(words) == len(r["hashes"]) // 8
        for n in np.frombuffer(bytes(r["numbers"]), f"<u{len(r['numbers']) // r['size']}").tolist():
            found[r["lang"], words[n]] += n > 0
    plain = slow_counts([(lang, text) for _, text, lang in rows], 1)
    assert +found == {(lang, word): n for (lang, (word,)), n in plain.items()}
    settled, settle = Counter(), collocations.settle

    def counted(df, name):
        made = settle(df, name)
        settled[name] += made.count()
        return made

    monkeypatch.setattr(collocations, "WORDS_A_BUCKET", 1 << 10)
    monkeypatch.setattr(collocations, "settle", counted)
    frequent = count_phrases(texts, 3, 4)
    # 9 scans at most, of so few words that 4 or 8 buckets do.
    assert 2 < settled["scan"] <= 9 * 8 < frequent.count()
    wanted = Counter(n for n in slow_counts([(lang, text) for _, text, lang in rows], 3).values() if n >= 4)
    assert Counter(r["f"] for r in frequent.collect()) == wanted + Counter(
        sum(n for (own, _), n in plain.items() if own == lang) for lang in ("en", "de", "und")
    )


def test_blocks_are_bounded(monkeypatch):
    """A block ends where it is full, and where the task holds too much; no word is lost."""
    rows = [(i % 3, b"en" if i % 2 else b"de", f"A word{i}, and more. of it".encode()) for i in range(200)]
    wanted = Counter(w for i in range(200) for w in ("a", f"word{i}", "and", "more", "of", "it"))
    for once, held in ((20, 10_000), (10_000, 50), (10_000, 10_000)):
        monkeypatch.setattr(collocations, "WORDS_AT_ONCE", once)
        monkeypatch.setattr(collocations, "WORDS_HELD", held)
        blocks = list(collocations.blocks_of(rows))
        assert len(blocks) == 6 if once == held else len(blocks) > 12
        found = Counter()
        for _, block in blocks:
            words = block.words.decode().split("\n")
            found.update(words[n - 1] for n in block.numbers.tolist() if n)
            # Three pieces a text.
            assert 2 * np.count_nonzero(block.numbers == 0) == np.count_nonzero(block.numbers)
        assert found == wanted
    assert list(collocations.blocks_of([(0, b"en", b" \t\n.,"), (1, b"en", b"")])) == []


def test_sorted_hashes_are_kept_as_steps():
    rng = np.random.default_rng(3)
    for size, low in ((0, 0), (1, 0), (1, 2**64 - 1), (2, 0), (1000, 0), (50_000, 2**63)):
        hashes = np.unique(rng.integers(low, 2**64 - 1, size, np.uint64, endpoint=True))
        data = collocations._steps(hashes)
        assert (collocations._hashes(data) == hashes).all() and len(collocations._hashes(data)) == len(hashes)
    assert len(data) < 8 * size
    few = np.array([5, 6, 2**64 - 1], np.uint64)
    assert collocations._hashes(collocations._steps(few)).tolist() == few.tolist()


def test_a_mark_stays_once_it_is_seen():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 2**63, 500).astype(np.uint64)
    marks, seen = np.full(997, 255, np.uint8), {}
    for step in range(1, 9):
        places = np.unique(places_of(hashes[20 * step : 20 * step + 20], 997))
        marks[places[marks[places] == 255]] = step
        now = marks_of(hashes, marks)
        assert (now[20 * step : 20 * step + 20] <= step).all()
        assert all(now[i] == m for i, m in seen.items())
        seen |= {i: m for i, m in enumerate(now.tolist()) if m != 255}


def test_odd_documents(spark):
    plain = [(r[2], r[1]) for r in ROWS]
    found = mine_collocations(docs(spark), least=2)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in found.collect()) == slow_mine(plain, least=2)
    assert mine_collocations(docs(spark, [])).collect() == []
    many = [(None, "one and the same", None)] * 40 + [(1, None, "en"), (2, " \t", "en"), (3, "und", "und")]
    assert found_in(spark, many) == slow_mine([(r[2], r[1]) for r in many])


def test_query(spark, duck):
    found = driver.queries()["op12_itemset_collocations"](spark, SF_DIR)
    twin = duck.sql(driver.oracle_sql()["op12_itemset_collocations"])
    assert found.columns == twin.columns
    assert sorted(map(tuple, found.collect())) == sorted(twin.fetchall())
