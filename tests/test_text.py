"""Tokens and BLEU against plain Python, markup functions on literal cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from conftest import SF_DIR
from inkscore.functions import markup as M
from inkscore.functions.rounding import sig3, steady_sum
from inkscore.functions.text import SPACES, _split_marks, tokenize_13a
from inkscore.operators import bleu as B
from inkscore.operators.bleu import bleu, ngram_counts, ngram_precision
from inkscore.session import configure


# The published tokenizer's steps, written out here and not taken from the code.
LITERALS = [("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&")]
LITERALS += [("&lt;", "<"), ("&gt;", ">")]
PATTERNS = [
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "),
    (r"([^0-9])([\.,])", r"\1 \2 "),
    (r"([\.,])([^0-9])", r" \1 \2"),
    (r"([0-9])(-)", r"\1 \2 "),
]


def python_tokens(text):
    for old, new in LITERALS:
        text = text.replace(old, new)
    for pattern, new in PATTERNS:
        text = re.sub(pattern, new, text)
    return text.split()


def python_bleu(cand, ref):
    if not cand or not ref:
        return 0.0
    logs = 0.0
    for n in range(1, 5):
        a = Counter(tuple(cand[i : i + n]) for i in range(len(cand) - n + 1))
        b = Counter(tuple(ref[i : i + n]) for i in range(len(ref) - n + 1))
        hit = sum((a & b).values())
        if hit == 0:
            return 0.0
        logs += math.log(hit / (len(cand) - n + 1)) / 4
    return math.exp(logs) * (1.0 if len(cand) > len(ref) else math.exp(1 - len(ref) / len(cand)))


def random_texts(n, alphabet, longest):
    rng = random.Random(7)
    return ["".join(rng.choices(alphabet, k=rng.randint(0, longest))) for _ in range(n)]


MARKS = list("ab1 5.,.,--&<>\"'/:;={}[]`~!#%^_|\\$()*+?@\n\t") + [
    "&quot;", "&amp;", "&lt;", "<skipped>", "-\n", "　", "\xa0", "\x1c", " ", "é", "\U0001f600",
]


def test_tokens_equal_plain_python(spark):
    texts = random_texts(6000, MARKS, 12) + random_texts(6000, list("a1.,- ;"), 9)
    texts += ["", " ", "...", "1...5", "a..5", "5.", ".5", "1,000.5-6", "a.,b,.1", "-", "<svg/>"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = rows.select("i", "t", tokenize_13a(F.col("t")).alias("k")).collect()
    wrong = [(r.t, r.k, python_tokens(r.t)) for r in found if r.k != python_tokens(r.t)]
    assert not wrong[:5]


def test_marks_and_spaces_take_one_pass_each(spark, capsys):
    rng = random.Random(11)
    marks = [chr(i) for i in range(1, 256)] + list(SPACES) + ["&amp;", "&quot;", "&lt;", "&gt;", "<skipped>", "-\n", "\U0001f600", "é", "中"]
    few = [".", ",", "-", " ", "1", "a", "!", "\n"]
    texts = ["".join(rng.choice(rng.choice((marks, few))) for _ in range(rng.randint(0, 30))) for _ in range(6000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokenize_13a(F.col("t")).alias("k"))
    wrong = [(r.t, r.k, python_tokens(r.t)) for r in rows.collect() if r.k != python_tokens(r.t)]
    assert not wrong[:5]
    spark.range(1).select(_split_marks(F.concat(F.lit("a"), F.col("id"))).alias("cut")).explain("simple")
    assert capsys.readouterr().out.count("regexp_replace") == 1


@pytest.mark.parametrize("method", ["rows", "grams"])
def test_bleu_equals_plain_python(spark, method):
    rng = random.Random(3)
    words = ["a", "b", "c", "<g>", "1.5", "x-y", "."]
    pairs = []
    for i in range(400):
        ref = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        cand = [w if rng.random() < 0.9 else rng.choice(words) for w in ref]
        pairs.append((i, " ".join(cand[: rng.randint(0, 45)]), " ".join(ref)))
    pairs += [(900, "a b c", "a b c"), (901, "a b c d", "a b c d"), (902, "", "a"), (903, "a", "")]
    df = spark.createDataFrame(pairs, "id int, cand string, ref string")
    found = {r.id: r for r in bleu(df, ["id"], method=method).collect()}
    assert len(found) == len(pairs)
    for key, cand, ref in pairs:
        want = python_bleu(python_tokens(cand), python_tokens(ref))
        assert found[key].bleu == pytest.approx(want, abs=1e-12)
        assert found[key].len_c == len(python_tokens(cand))
    assert found[900].bleu == 0.0 and found[901].bleu == pytest.approx(1.0)


def test_counted_tokens_score_as_their_texts(spark, capsys):
    texts = [(0, None), (1, ""), (2, " ,  a\u3000b.c&amp;d "), (3, "a b . c & d"), (4, "a b , c & d e f"), (5, "\t\n")]
    sides = spark.createDataFrame(texts, "i int, t string")
    ours, theirs = sides.withColumnRenamed("i", "j").withColumnRenamed("t", "u"), sides
    plain = bleu(ours.crossJoin(theirs), ["i", "j"], "u", "t")
    pairs = B.counted_tokens(ours, "u").crossJoin(B.counted_tokens(theirs, "t"))
    found = bleu(pairs, ["i", "j"], "u", "t", counted=True)
    assert found.columns == plain.columns
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))
    # What is tokenized is worked out once, and nothing is tokenized above the join.
    sides.select(tokenize_13a(F.upper("t")).alias("k")).explain("simple")
    assert capsys.readouterr().out.count("upper(") == 1
    found.explain("simple")
    above = re.split(r"NestedLoopJoin|CartesianProduct", capsys.readouterr().out)[0]
    assert "regexp_replace" not in above and "clipped" not in above
    with pytest.raises(ValueError):
        bleu(pairs, ["i", "j"], "u", "t", method="grams", counted=True)


def test_repeated_grams_are_clipped(spark):
    df = spark.createDataFrame([(1, "the the the the", "the cat the")], "id int, cand string, ref string")
    rows = {r.n: (r.matched, r.possible) for r in ngram_precision(df, ["id"]).collect()}
    assert rows == {1: (2, 4), 2: (0, 3), 3: (0, 2), 4: (0, 1)}
    counts = ngram_counts(df, ["id"], "cand").where("n = 1").collect()
    assert [(r.gram, r["count"]) for r in counts] == [("the", 4)]


def test_grams_need_one_exchange(spark):
    df = spark.createDataFrame([(1, "a b", "a")], "id int, cand string, ref string")
    plan = bleu(df, ["id"], method="grams")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


@pytest.mark.parametrize("make", [lambda df: ngram_precision(df, ["id"]), lambda df: bleu(df, ["id"], method="grams")])
def test_grams_are_never_rows(spark, make):
    df = spark.createDataFrame([(1, "a b", "a")], "id int, cand string, ref string")
    assert "Generate explode" not in make(df)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("given", [False, True])
def test_pairs_of_one_key_are_one_group(spark, given):
    """Grams of all its texts, none over the end of a text; keys may be NULL."""
    rows = [(1, "a b c d", "a b x y"), (1, "a b c d", "c d a b"), (None, "", ""), (None, "", ""), (2, "a", "a")]
    df = spark.createDataFrame(rows, "id int, cand string, ref string")
    if given:
        df = df.select("id", *[F.filter(F.split(c, " "), lambda t: t != "").alias(c) for c in ("cand", "ref")])
    found = {(r.id, r.n): r.matched for r in ngram_precision(df, ["id"]).collect()}
    # By hand: candidate plus reference grams of one pair, less what differs over both, halved.
    assert [found[1, n] for n in (1, 2, 3, 4)] == [2, 0, -2, -1]
    assert [found[None, n] for n in (1, 2, 3, 4)] == [0, 0, 0, 0]
    assert [found[2, n] for n in (1, 2, 3, 4)] == [1, 0, 0, 0]


def one(spark, **columns):
    names = {k: v for k, v in columns.items()}
    return spark.range(1).select(*[v.alias(k) for k, v in names.items()]).first()


def test_markup(spark):
    cases = {
        "Here it is:\n<svg id='k'>dots</svg>\nbye": "<svg id='k'>dots</svg>",
        "sorry, nothing drawn": None,
        "<svg>open": None,
        "<SVG>x</SVG>": None,
        "<svg a>\n<svg>x</svg></svg>": "<svg a>\n<svg>x</svg>",
        "<svg>1</svg><svg>2</svg>": "<svg>1</svg>",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    for row in df.select("t", M.extract_markup(F.col("t")).alias("m")).collect():
        assert row.m == cases[row.t]


def test_markup_is_found_without_a_pattern(spark):
    df = spark.createDataFrame([("<axb>1</axb><a.b>2</a.b>",), ("</a.b><a.b>",), (None,)], "t string")
    found = df.select(M.extract_markup(F.col("t"), "a.b").alias("m"))
    assert [r.m for r in found.collect()] == ["<a.b>2</a.b>", None, None]
    assert "regexp" not in found._jdf.queryExecution().executedPlan().toString()


def test_assets(spark):
    text = (
        '<svg><image href="data:image/png;base64,Qk0x"/>'
        "<image href='data:image/jpeg;base64,Qk0y'/>"
        '<image href="data:image/png;base64,Qk0x"/></svg>'
    )
    row = one(spark, a=M.extract_assets(F.lit(text)))
    assert [tuple(a) for a in row.a] == [
        ("cdn://1.jpg", "data:image/png;base64,Qk0x"),
        ("cdn://2.jpg", "data:image/jpeg;base64,Qk0y"),
        ("cdn://3.jpg", "data:image/png;base64,Qk0x"),
    ]
    short = '<svg><image href="cdn://1.jpg"/></svg>'
    restored = one(spark, r=M.restore_assets(F.lit(short), M.extract_assets(F.lit(text)))).r
    assert restored == '<svg><image href="data:image/png;base64,Qk0x"/></svg>'


def test_restore_runs_in_array_order(spark):
    assets = F.array(
        F.struct(F.lit("a").alias("short"), F.lit("b").alias("url")),
        F.struct(F.lit("b").alias("short"), F.lit("c").alias("url")),
    )
    assert one(spark, r=M.restore_assets(F.lit("ab"), assets)).r == "cc"


def test_data_urls(spark):
    row = one(
        spark,
        raw=M.to_data_url(F.lit("Qk0x")),
        done=M.to_data_url(F.lit("data:image/gif;base64,X")),
        long=M.to_data_url(F.encode(F.repeat(F.lit("x"), 200), "UTF-8"), binary=True),
        bad=M.decode_data_url(F.lit("data:image/png;base64,*")),
        none=M.decode_data_url(F.lit("nothing")),
        good=M.decode_data_url(F.lit("data:image/png;base64,QUJD")),
    )
    assert row.raw == "data:image/png;base64,Qk0x"
    assert row.done == "data:image/gif;base64,X"
    assert "\r" not in row.long and "\n" not in row.long
    assert row.bad is None and row.none is None and bytes(row.good) == b"ABC"


def test_sig3_equals_python(spark):
    rng = random.Random(5)
    values = [i / 10000 for i in range(20001)] + [rng.random() * 10 ** rng.randint(-120, 5) for _ in range(9999)]
    values += [2.79e-30, 0.1235, 0.5315, 999.5, 0.0, 5e-324, -0.12345, 1e300]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for row in df.select("x", sig3(F.col("x")).alias("y")).collect():
        assert row.y == float(f"{row.x:.3g}")
    odd = one(spark, n=sig3(F.lit(None)), i=sig3(F.lit(float("inf"))), q=sig3(F.lit(float("nan"))))
    assert odd.n is None and odd.i == math.inf and math.isnan(odd.q)


def test_steady_sum(spark):
    rng = random.Random(9)
    groups = {
        0: [round(rng.random(), 3) for _ in range(3001)],
        1: [2.79e-30, 1e-112, 3e-31],
        2: [0.0, -0.5, 1e9, 12.5, None],
        3: [None],
    }
    rows = [(g, v) for g, values in groups.items() for v in values]
    expected = {}
    for g, values in groups.items():
        known = [v for v in values if v is not None]
        expected[g] = math.fsum(known) if known else None
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "g int, v double").repartition(5 + seed)
        for row in df.groupBy("g").agg(steady_sum(F.col("v")).alias("m")).collect():
            assert row.m == expected[row.g]


def test_bleu_of_given_tokens(spark):
    """Tokens with spaces and empty ones are the same for both methods."""
    rows = [
        (1, ["a b", "c", "d", "e f"], ["a", "b c", "d", "e f"]),
        (2, ["a b", "", "d", "e f", "g"], ["a b", "", "d", "e f", "g"]),
        (3, [], ["a"]),
    ]
    df = spark.createDataFrame(rows, "k long, cand array<string>, ref array<string>")
    found = [{r.k: r.bleu for r in bleu(df, ["k"], method=m).collect()} for m in ("rows", "grams")]
    assert found[0] == pytest.approx(found[1]) and found[0] == pytest.approx({1: 0.0, 2: 1.0, 3: 0.0})


def slow_matches(cand, ref, max_n):
    found = []
    for n in range(1, max_n + 1):
        ours, theirs = (Counter(zip(*(side[i:] for i in range(n)))) for side in (cand, ref))
        found.append((ours & theirs).total())
    return found


@pytest.mark.parametrize("bits", [64, 3, 0])
def test_clipped_matches_are_those_of_the_grams(monkeypatch, bits):
    """Also where hashes of so few bits collide all the time."""
    if bits < 64:
        monkeypatch.setattr(B, "_mix", lambda values: values & np.uint64(2**bits - 1))
    rng = np.random.default_rng(bits)
    rows = [([f"t{t}" for t in rng.integers(0, 9, n)], [f"t{t}" for t in rng.integers(0, 9, m)])
            for n, m in rng.integers(0, 40, (60, 2))]
    rows += [([], []), (["a"], []), (["", "a", ""], ["", "", "a"]), ([""], [""]), (["é b", "c"], ["é", "b", "c"])]
    cand, ref = (pa.array([r[k] for r in rows], pa.list_(pa.string())) for k in (0, 1))
    c_n, r_n, matches = B.clipped_matches(cand, ref, 4)
    assert c_n.tolist() == [len(c) for c, _ in rows] and r_n.tolist() == [len(r) for _, r in rows]
    assert matches.T.tolist() == [slow_matches(c, r, 4) for c, r in rows]
    plain = [r for r in rows if not any(" " in t or not t for side in r for t in side)]
    cand, ref = (pa.array([" ".join(r[k]) for r in plain]) for k in (0, 1))
    assert B.clipped_matches(cand, ref, 4)[2].T.tolist() == [slow_matches(c, r, 4) for c, r in plain]


def test_long_rows_are_counted_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{w}" for w in rng.integers(0, 50, n)) for n in (0, 1, 9, 300, 5000, 3, 800)]
    rows = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in texts for b in texts)]
    df = spark.createDataFrame(rows, "id long, cand string, ref string")
    whole = {r["id"]: r["bleu"] for r in B.bleu(df, ["id"]).collect()}
    monkeypatch.setattr(B, "TOKENS_AT_ONCE", 500)
    parts = {r["id"]: r["bleu"] for r in B.bleu(df, ["id"]).collect()}
    assert parts == whole and whole[4 * 7 + 4] == pytest.approx(1.0)


def test_python_batches_are_bounded(spark):
    """What a Python worker holds of texts at once does not follow from their length."""
    configure(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("16m", "16777216b")
    assert B.TOKENS_AT_ONCE <= 250_000


def test_pairs_are_scored_where_they_meet(spark, capsys):
    """No pair, which holds its target, crosses an exchange; a response is made once to find its markup."""
    queries()["bleu_leaderboard"](spark, SF_DIR).explain("simple")
    assert "REPARTITION" not in capsys.readouterr().out
    spark.createDataFrame([("<svg></svg>",)], "t string").select(M.extract_markup(F.upper("t")).alias("m")).explain("simple")
    assert capsys.readouterr().out.count("upper(") == 1


def test_spaces_of_plain_and_other_texts(spark):
    texts = [f"a{c}b{c}{c}c" for c in SPACES] + [f"é{c}b{c}" for c in SPACES] + ["\x1f", "é", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", tokenize_13a(F.col("t")).alias("tokens")).collect():
        assert row["tokens"] == (None if row["t"] is None else row["t"].split())
