"""Sources, inference, gates, summaries, scoring and skew."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkscore.operators import grid as G
from inkscore.operators import infer as N
from inkscore.operators import prompts as Q
from inkscore.operators import reports as R
from inkscore.operators import rows as W
from inkscore.operators import summary as S
from inkscore.operators.skew import frequent_keys, heavy_keys, pair_all, salted_join
from inkscore.plans.scoring import score, score_summary
from inkscore.sources import ledger as L
from inkscore.sources import tables as T


def data(df):
    return sorted(tuple(r) for r in df.collect())


# sources


def test_raw_log(spark, tmp_path):
    path = str(tmp_path / "raw")
    df = spark.createDataFrame(
        [(0, "m", 'a "b"\nc', None), (1, "m", None, "boom")], "record long, model string, response string, error string"
    )
    T.append_raw(df, path, "2024-01-01_00-00-00")
    T.append_raw(df.limit(1), path, "2024-01-02_00-00-00")
    assert T.read_raw(spark, path).count() == 3
    one = T.read_raw(spark, path, "2024-01-01_00-00-00")
    assert one.count() == 2
    assert "run_time" in one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]
    shown = N.with_response(one).orderBy("record").select("response").collect()
    assert [r.response for r in shown] == ['a "b"\nc', "boom"]


def test_raw_csv(spark, tmp_path):
    file = tmp_path / "raw.csv"
    file.write_text('record,model,response,run_time\n0,m,"a ""b""\nc, d",r1\n1,m,x,r2\n')
    rows = T.read_raw_csv(spark, str(file)).orderBy("record").collect()
    assert [r.response for r in rows] == ['a "b"\nc, d', "x"]
    assert T.read_raw_csv(spark, str(file), "r2").count() == 1


def test_examples_and_artifacts(spark, tmp_path):
    path = str(tmp_path / "examples")
    df = spark.createDataFrame([(0, "<svg/>", 1, 2, "test"), (1, "<svg/>", 1, 2, "train")], "record int, completion string, width int, height int, split string")
    df.write.partitionBy("split").parquet(path)
    assert [r.record for r in T.read_examples(spark, path, "test").collect()] == [0]
    with pytest.raises(ValueError, match="completion"):
        df.drop("completion").write.parquet(str(tmp_path / "bad"))
        T.read_examples(spark, str(tmp_path / "bad"))
    raw = spark.createDataFrame([("r", "m", 0, "x <svg>1</svg>", True), ("r", "m", 1, "none", True)], "run_time string, model string, record long, response string, ok boolean")
    found = N.to_artifacts(raw, "ok")
    T.write_artifacts(found, str(tmp_path / "artifacts"))
    back = T.read_artifacts(spark, str(tmp_path / "artifacts"), "r").select(*found.columns)
    assert data(back) == data(found)
    again = found.withColumn("run_time", F.lit("r2"))
    T.write_artifacts(again, str(tmp_path / "artifacts"))
    assert T.read_artifacts(spark, str(tmp_path / "artifacts")).count() == 4


def test_score_files(spark, tmp_path):
    scores = spark.createDataFrame([(1, "b", 0.5, 0.25, 1.0), (0, "a", 1e-112, 0.0, 0.0)], T.SCORE_SCHEMA)
    T.write_scores(scores, str(tmp_path / "scores"))
    assert data(T.read_scores(spark, str(tmp_path / "scores"))) == data(scores)
    flags = scores.withColumns({"has_markup": F.lit(True), "has_render": F.lit(True)})
    summary = S.summarize(flags)
    T.write_summary(summary, str(tmp_path / "summary"))
    back = T.read_summary(spark, str(tmp_path / "summary"))
    assert back.columns == list(S.SUMMARY_COLUMNS) and data(back) == data(summary)


def test_score_files_keep_the_run(spark, tmp_path):
    rows = [("r2", 1, "b", 0.5, 0.25, 1.0), ("r1", 0, "a", 0.125, 0.5, 0.0)]
    scores = spark.createDataFrame(rows, "run_time STRING, " + T.SCORE_SCHEMA)
    T.write_scores(scores, str(tmp_path / "scores"))
    back = T.read_scores(spark, str(tmp_path / "scores"))
    assert back.columns == scores.columns and data(back) == data(scores)
    flags = scores.withColumns({"has_markup": F.lit(True), "has_render": F.lit(True)})
    summary = S.summarize(flags, ("run_time", "model"))
    T.write_summary(summary, str(tmp_path / "summary"))
    back = T.read_summary(spark, str(tmp_path / "summary"))
    assert back.columns == summary.columns and data(back) == data(summary)
    assert S.leaderboard(back).columns[:2] == ["run_time", "model"]
    with pytest.raises(ValueError, match="expected"):
        T.read_summary(spark, str(tmp_path / "scores"))


def test_csv_log_round_trip(spark, tmp_path):
    raw = spark.createDataFrame(
        [(1, "m", 'a "b",\n<svg/>', None), (2, "m", None, "too slow")],
        "record long, model string, response string, error string",
    )
    T.append_raw_csv(raw, str(tmp_path / "log"), "r1")
    T.append_raw_csv(raw, str(tmp_path / "log"), "r2")
    found = {(r.run_time, r.record): r.response for r in T.read_raw_csv(spark, str(tmp_path / "log")).collect()}
    texts = {1: 'a "b",\n<svg/>', 2: "too slow"}
    assert found == {(t, i): texts[i] for t in ("r1", "r2") for i in texts}


def test_usable_targets_and_unique_keys(spark):
    records = spark.range(4).withColumnRenamed("id", "record")
    targets = spark.createDataFrame(
        [(0, "x", True), (1, None, True), (2, " ", True), (3, "y", False)],
        "record long, completion string, has_render boolean",
    )
    assert sorted(r[0] for r in W.missing_targets(records, targets).collect()) == [1, 2, 3]
    assert [r[0] for r in W.missing_targets(records, targets, needs=[]).collect()] == []
    with pytest.raises(ValueError, match="20 of 100"):
        W.require_targets(spark.range(100).withColumnRenamed("id", "record"), targets.limit(0))
    twice = spark.createDataFrame([("r", "m", 1), ("r", "m", 1)], "run_time string, model string, record long")
    with pytest.raises(ValueError, match="more than one row"):
        W.require_unique(twice, twice.columns)
    scores = spark.createDataFrame([("a", 1)], "model string, record long")
    with pytest.raises(ValueError, match="2 groups"):
        S.check_complete(scores, 1, groups=2)


def test_pairing_keeps_every_type(spark):
    right = spark.sql(
        "SELECT 'm' AS model, map('k', 1) AS params, struct(1 AS a) AS s, array(2) AS l,"
        " CAST(1.5 AS DECIMAL(5,2)) AS d, TIMESTAMP '2025-01-01' AS t, X'01' AS b, CAST(NULL AS INT) AS z"
        " UNION ALL SELECT 'n', NULL, NULL, NULL, NULL, NULL, NULL, 3"
    )
    left = spark.range(3).withColumn("m", F.create_map(F.lit("x"), F.col("id")))
    for salts in (None, 1):
        rows = pair_all(left, right, salts).collect()
        assert len(rows) == 6
        assert {(r.id, r.model, str(r.params), r.z) for r in rows} == {
            (i, *rest) for i in range(3) for rest in (("m", "{'k': 1}", None), ("n", "None", 3))
        }


# rows


def test_with_record(spark):
    df = spark.range(0, 5000, 1, 7).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")
    )
    rows = W.with_record(df, ["k"]).collect()
    assert sorted(r.record for r in rows) == list(range(5000))
    ordered = [r.k for r in sorted(rows, key=lambda r: r.record)]
    assert ordered == sorted(ordered)


def test_gates(spark):
    df = spark.createDataFrame([(0, "x", 1, 1), (1, "", 1, 1), (2, "x", None, 1)], "record long, completion string, width int, height int")
    assert W.require_examples(df) is df
    with pytest.raises(ValueError, match="no examples"):
        W.require_examples(df.limit(0))
    with pytest.raises(ValueError, match="missing columns"):
        W.require_examples(df.drop("width"))
    errors = {r.record: r.error for r in W.validate_examples(df).collect()}
    assert errors[0] is None and "completion" in errors[1] and "width" in errors[2]
    assert W.require_targets(df, df, needs=[]) is df
    with pytest.raises(ValueError, match=r"\[1, 2\]"):
        W.require_targets(df, df.limit(1))
    assert [r.record for r in W.missing_ids(df, [0, 7]).collect()] == [7]
    with pytest.raises(ValueError, match="no models"):
        W.select_models(spark.createDataFrame([("a",)], "model string"), ["b"])


# prompts and inference


def test_prompt(spark):
    df = spark.createDataFrame(
        [(0, "cGl4ZWxz", 100, 200, '<svg><i h="data:image/png;base64,A"/><i h="data:image/jpeg;base64,B"/></svg>'), (1, "data:image/png;base64,Z", 1, 2, "<svg/>")],
        "record long, image string, width int, height int, completion string",
    )
    rows = {r.record: r.prompt for r in Q.build_prompt(df).collect()}
    assert len(rows[0]) == 6 and len(rows[1]) == 2
    assert rows[0][0].text == "Write SVG code to recreate this 100 x 200 px design."
    assert rows[0][1].image_url.url == "data:image/png;base64,cGl4ZWxz"
    assert rows[0][4].text == "Image asset href='cdn://2.jpg'"
    assert rows[0][5].image_url.url == "data:image/jpeg;base64,B"
    assert rows[1][1].image_url.url == "data:image/png;base64,Z"
    chat = Q.build_prompt(df).select(Q.to_chat(F.col("prompt")).alias("c")).first().c
    assert chat[0].role == "user" and chat[0].content[1].type == "image"


def test_infer(spark):
    def answer(row):
        if row["record"] % 5 == 0:
            raise RuntimeError(f"bad {row['record']}")
        return f"<svg>{row['prompt'][0]['text']}</svg>"

    def counting(row, instance):
        instance.append(1)
        return f"{len(instance)}"

    items = F.array(F.struct(F.lit("text").alias("type"), F.lit("p").alias("text")))
    work = spark.range(20).select(
        F.col("id").alias("record"), F.lit("m").alias("model"), items.alias("prompt"),
        F.when(F.col("id") == 1, "skip").alias("error"),
    )
    rows = {r.record: r for r in N.infer(work, answer, parallel=3).collect()}
    assert len(rows) == 20
    assert rows[5].error == "bad 5" and rows[5].response is None
    assert rows[1].error == "skip" and rows[2].response == "<svg>p</svg>"
    odd = {0: {"a": 1}, 1: 5, 2: None, 3: "text"}
    found = {r.record: r for r in N.infer(work.drop("error").where("record < 5"), lambda r: odd[r["record"]]).collect()}
    assert found[3].response == "text" and found[2].response is found[2].error is None
    assert all(found[i].response is None and "no text" in found[i].error for i in (0, 1))
    assert found[4].error  # the function raised a KeyError
    two = work.drop("error").withColumn("model", F.when(F.col("record") < 3, "a").otherwise("b"))
    by = N.infer(two, {"a": lambda r: "from a"}, parallel={"a": 1}).collect()
    assert len(by) == 20 and {r.response for r in by if r.model == "a"} == {"from a"}
    assert all(r.error for r in by if r.model == "b")
    serial = N.infer(work.drop("error"), counting, setup=list, parallel=1).collect()
    assert sorted(int(r.response) for r in serial) == list(range(1, 21))  # one instance for all


# skew


def jobs_of(spark, build):
    """What ``build`` returns, and the number of jobs it runs."""
    tracker, name = spark.sparkContext.statusTracker(), f"test-{id(build)}"
    spark.sparkContext.setJobGroup(name, "building")
    try:
        built = build()
        return built, len(tracker.getJobIdsForGroup(name))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def skewed(spark, rows=30000):
    """A third of all rows have the key 7."""
    key = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500)
    return spark.range(rows).select(key.alias("k"), F.col("id").alias("v"))


def test_heavy_keys_have_their_exact_count(spark):
    many = skewed(spark).union(spark.range(50).selectExpr("CAST(NULL AS BIGINT)", "id"))
    found, jobs = jobs_of(spark, lambda: heavy_keys(many, "k", share=0.1, least=100))
    assert jobs == 0
    seven = many.where("k = 7").count()
    salts = -(-seven * 8 // 30000)  # an even share for each of eight partitions
    assert [tuple(r) for r in found.collect()] == [(7, seven, salts)]
    assert heavy_keys(many, "k").collect() == []  # too few rows to matter
    assert heavy_keys(many.limit(0), "k", share=0.1, least=1).collect() == []
    text = many.select(F.concat(F.lit("key"), "k").alias("k"))
    assert [r["k"] for r in heavy_keys(text, "k", share=0.1, least=100).collect()] == ["key7"]


def test_sketches_miss_no_frequent_key(spark):
    """Keys around the share, over more distinct keys than counters, in any layout."""
    spans = " UNION ALL ".join(f"SELECT {-k} AS k, id FROM range({n})" for k, n in ((1, 900), (2, 700), (3, 560)))
    many = spark.sql(f"SELECT id AS k, id FROM range(50000) UNION ALL {spans}")
    for layout in (many, many.repartition(40), many.orderBy("k")):
        found = {r["k"] for r in frequent_keys(layout, "k", 0.01).collect()}
        assert {-1, -2, -3} <= found and len(found) <= 200
        exact = {tuple(r)[:2] for r in heavy_keys(layout, "k", share=0.01, least=10).collect()}
        assert exact == {(-1, 900), (-2, 700), (-3, 560)}


def test_salted_join_equals_plain_join(spark):
    many = skewed(spark)
    one = spark.range(600).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    hot = heavy_keys(many, "k", share=0.1, least=100)
    more = spark.createDataFrame([(7, 10060, 100)], "k long, n long, salts int")
    for how in ("inner", "left"):
        plain = many.join(one.where("k <> 8"), "k", how)
        for given in (hot, more, None):
            joined, jobs = jobs_of(spark, lambda: salted_join(many, one.where("k <> 8"), "k", ["v"], how, given))
            assert jobs == 0
            assert data(joined.select("k", "v", "w")) == data(plain.select("k", "v", "w"))
    # The hot key is met in as many partitions as its count asks for, not in one or 64.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        spread = salted_join(many, one.hint("merge"), "k", ["v"], hot=more).where("k = 7")
        sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) > 50 and max(sizes) < 10060 / 10


def test_building_a_score_plan_runs_no_job(spark):
    """One record owns most of the candidates: it is salted, by the plan itself."""
    sizes = [(0, i) for i in range(400)] + [(r, 0) for r in range(1, 40)]
    artifacts = spark.createDataFrame(
        [("r", f"m{m}", r, f"<svg>{r} {m}</svg>", True, True) for r, m in sizes],
        "run_time string, model string, record long, markup string, has_markup boolean, has_render boolean",
    )
    examples = spark.createDataFrame([(r, f"<svg>{r} 0</svg>") for r in range(40)], "record long, completion string")
    image = F.struct(F.lit(8).alias("height"), F.lit(8).alias("width"), F.expr("repeat(X'07', 192)").cast("binary").alias("rgb"))
    images = examples.select("record", image.alias("image"))
    (scored, jobs) = jobs_of(spark, lambda: score(artifacts, examples, images, images))
    assert jobs == 0
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "approx_top_k_accumulate" in plan and "_salt" in plan
    found = scored.where("bleu = 1").select("record", "model").collect()
    assert {tuple(r) for r in found} >= {(r, "m0") for r in range(40)}
    hot = heavy_keys(artifacts, "record", least=100)
    pairs = G.pair_candidates(artifacts, examples, hot)
    assert data(pairs.select("record", "model", "completion")) == data(
        artifacts.join(examples, "record").select("record", "model", "completion")
    )


def test_pair_all(spark):
    left = spark.range(50).withColumnRenamed("id", "record")
    right = spark.createDataFrame([(f"m{i}", i) for i in range(9)], "model string, n int")
    (short, jobs), long = jobs_of(spark, lambda: pair_all(left, right)), pair_all(left, right.hint("merge"), 4)
    assert jobs == 0 and short.count() == 450 and data(short) == data(long)
    for df in (short, long):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert pair_all(left, right.limit(0)).count() == 0
    assert pair_all(left.select(F.array("record").alias("a")), right).count() == 450


# summaries


def rows_of(spark, rows):
    return spark.createDataFrame(
        rows, "record long, model string, bleu double, structural double, pixel double, has_markup boolean, has_render boolean"
    )


def test_summary_rules(spark):
    df = rows_of(spark, [
        (0, "a", 0.5, 0.5, 0.5, True, True), (1, "a", 0.0, 0.0, 0.0, True, False),
        (0, "b", 0.0, 0.0, 0.0, False, False), (1, "b", 0.0, 0.0, 0.0, False, True),
        (0, "c", 2.79e-30, 0.0, 0.0, True, True), (1, "c", 0.2, 0.2, 0.2, True, True),
    ])
    rows = {r.model: r for r in S.summarize(df).collect()}
    a, b, c = rows["a"], rows["b"], rows["c"]
    assert (a["count"], a.successful_count, a.render_failures, a.generation_failures) == (2, 1, 1, 0)
    assert (a.bleu, a.bleu_successful) == (0.25, 0.5)
    assert (b.successful_count, b.bleu_successful, b.generation_failures) == (None, None, 1)
    assert c.successful_count == 2  # a tiny score is no failure
    board = S.leaderboard(S.summarize(df)).collect()
    assert [r.model for r in board] == ["a", "c", "b"]
    none = S.summarize(df.where("model = 'b'")).first()
    assert (none.successful_count, none.bleu_successful) == (0, 0.0)
    chart = R.chart_table(S.summarize(df)).where("model = 'a'").orderBy("pos").collect()
    assert [r.metric for r in chart] == ["bleu", "structural", "pixel"]


def test_rounding_comes_before_the_means(spark):
    rows = [(i, "a", 0.12349, 0.12349, 0.12349, True, True) for i in range(2)]
    rows.append((2, "a", 0.12451, 0.12451, 0.12451, True, True))
    summary = S.summarize(S.round_scores(rows_of(spark, rows))).first()
    assert summary.bleu == float(f"{(0.123 + 0.123 + 0.125) / 3:.3g}")


def test_check_complete(spark):
    df = rows_of(spark, [(0, "a", 0.0, 0.0, 0.0, True, True)])
    assert S.check_complete(df, 1) is df
    with pytest.raises(ValueError, match="expected 2"):
        S.check_complete(df, 2)


def test_manifest_keeps_order_and_repeats(spark):
    examples = spark.range(5).withColumnRenamed("id", "record")
    found = spark.createDataFrame([("m", 3, True), ("m", 1, False)], "model string, record long, has_render boolean")
    rows = R.comparison_manifest(examples, ["m"], found, [3, 9, 1, 3], 10, 20).collect()
    cells = sorted((r.row, r.model, r.record, r.status, r.x, r.y) for r in rows)
    assert cells == [
        (0, "m", 3, "ok", 18, 0), (0, "target", 3, "ok", 0, 0),
        (2, "m", 1, "Image not found", 18, 116), (2, "target", 1, "ok", 0, 116),
        (3, "m", 3, "ok", 18, 174), (3, "target", 3, "ok", 0, 174),
    ]


# scoring


def image(value, size=9):
    return (size, size, np.full((size, size, 3), value, np.uint8).tobytes())


IMAGE = "struct<height: int, width: int, rgb: binary>"


@pytest.mark.parametrize("method", ["rows", "grams"])
def test_score(spark, method):
    target = '<svg a="data:image/png;base64,QQ"><b>one two three</b></svg>'
    examples = spark.createDataFrame([(0, target), (1, target), (2, "")], "record long, completion string")
    artifacts = spark.createDataFrame(
        [
            ("r1", "m", 0, target, True, True),
            ("r1", "m", 1, target, True, False),
            ("r1", "m", 2, target, True, True),
            ("r1", "n", 0, target.replace("data:image/png;base64,QQ", "cdn://1.jpg"), True, True),
            ("r1", "n", 1, target, True, True),
            ("r2", "m", 0, None, False, False),
        ],
        "run_time string, model string, record long, markup string, has_markup boolean, has_render boolean",
    )
    gen = spark.createDataFrame([("r1", "m", r, image(9)) for r in (0, 1, 2)] + [("r1", "n", 0, image(10))], f"run_time string, model string, record long, image {IMAGE}")
    tgt = spark.createDataFrame([(r, image(9)) for r in (0, 1, 2)], f"record long, image {IMAGE}")
    rows = {(r.run_time, r.model, r.record): r for r in score(artifacts, examples, gen, tgt, bleu_method=method).collect()}
    assert len(rows) == 9  # three groups, three records
    scores = {k: (r.bleu, r.structural, r.pixel) for k, r in rows.items()}
    assert scores["r1", "m", 0] == (1.0, 1.0, 1.0)
    assert scores["r1", "m", 1] == (0.0, 0.0, 0.0)  # no drawing
    assert scores["r1", "m", 2] == (0.0, 0.0, 0.0)  # target without tokens fails as a whole
    assert scores["r1", "n", 1] == (1.0, 0.0, 0.0)  # image missing, code score stays
    assert scores["r2", "m", 0] == scores["r2", "m", 2] == (0.0, 0.0, 0.0)
    assert 0 < scores["r1", "n", 0][0] < 1 and scores["r1", "n", 0][2] == 0.996
    restored = score(artifacts, examples, gen, tgt, restore=True, bleu_method=method)
    assert restored.where("run_time = 'r1' AND model = 'n' AND record = 0").first().bleu == 1.0
    summary = score_summary(score(artifacts, examples, gen, tgt)).collect()
    assert {(r.run_time, r.model): r["count"] for r in summary} == {("r1", "m"): 3, ("r1", "n"): 3, ("r2", "m"): 3}


def test_missing_artifacts(spark):
    artifacts = spark.createDataFrame([("m", 0, True, False)], "model string, record long, has_markup boolean, has_render boolean")
    records = spark.range(2).withColumnRenamed("id", "record")
    rows = G.missing_artifacts(artifacts, artifacts.select("model").distinct(), records)
    assert data(rows) == [("m", 0, ["render"]), ("m", 1, ["markup", "render"])]


def test_holes_over_several_bitmaps(spark):
    """Far apart records, repeated rows, strangers, and groups without any row."""
    ids = [0, 1, 7, 32767, 32768, 40000, 98304, 10**12]
    rng = np.random.default_rng(1)
    rows = [(r, m, int(i), bool(rng.random() < 0.6), bool(rng.random() < 0.4))
            for r in ("a", "b") for m in ("m", "n") for i in rng.choice(ids, 5, replace=False)]
    rows += rows[:3] + [("a", "m", 5, True, True), ("z", "m", 0, True, True), ("a", "m", None, True, True)]
    artifacts = spark.createDataFrame(rows, "run_time string, model string, record long, has_markup boolean, has_render boolean")
    groups = spark.createDataFrame([("a", "m"), ("a", "n"), ("b", "m"), ("b", "n"), ("c", "m")], "run_time string, model string")
    records = spark.createDataFrame([(i,) for i in ids] + [(0,)], "record long")
    have = {}
    for r, m, i, markup, render in rows:
        old = have.get((r, m, i), (False, False))
        have[r, m, i] = (old[0] or markup, old[1] or render)
    wanted, counts = [], []
    for g in ("a", "m"), ("a", "n"), ("b", "m"), ("b", "n"), ("c", "m"):
        cells = [(i, have.get((*g, i), (False, False))) for i in ids]
        for i, has in cells:
            missing = [name for name, there in zip(("markup", "render"), has) if not there]
            if missing:
                wanted.append((*g, i, missing))
        sums = [sum(has[k] for _, has in cells) for k in (0, 1)]
        counts.append((*g, len(ids), *sums, sums == [len(ids)] * 2))
    found = G.missing_artifacts(artifacts, groups, records)
    assert data(found) == sorted(wanted)
    assert data(G.artifact_coverage(artifacts, groups, records)) == sorted(counts)
    # What meets the groups are bitmaps, not records.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "bitmap_construct_agg" in plan and "has_render" in plan
    assert G.missing_artifacts(artifacts, groups, records.limit(0)).count() == 0
    assert G.missing_artifacts(artifacts.limit(0), groups, records).count() == 5 * len(ids)


# the ledger of responses


def test_a_broken_run_goes_on_where_it_stopped(spark, tmp_path):
    path, calls = str(tmp_path / "ledger"), spark.sparkContext.accumulator(0)
    prompts = spark.range(60).select(
        F.col("id").alias("record"), F.explode(F.array(F.lit("m"), F.lit("n"))).alias("model"), F.lit("p").alias("prompt")
    )

    def answer(row):
        calls.add(1)
        if row["record"] % 10 == 3:
            raise ValueError("no answer")
        return f"{row['model']} {row['record']}"

    asked = []

    def breaking(rows):
        asked.append(rows.count())
        answers = N.infer(rows, answer)
        if len(asked) < 3:
            return answers
        # Killed while the third part is written.
        return answers.withColumn("response", F.when(F.col("record") >= 0, F.raise_error(F.lit("killed"))))

    with pytest.raises(Exception, match="killed"):
        L.record_responses(prompts, breaking, path, "r1", parts=5)
    kept = L.read_ledger(spark, path, "r1").count()
    assert kept == sum(asked[:2]) > 0
    calls.value = 0
    parts = L.record_responses(prompts, lambda rows: N.infer(rows, answer), path, "r1", parts=5)
    assert parts == 3 and calls.value == 120 - kept
    rows = L.read_ledger(spark, path, "r1").collect()
    assert len(rows) == 120 == len({(r["model"], r["record"]) for r in rows})
    assert {r["record"] % 10 for r in rows if r["error"]} == {3}
    assert all(r["response"] == f"{r['model']} {r['record']}" for r in rows if not r["error"])
    # Repeated, it asks nothing; another run starts anew.
    assert L.record_responses(prompts, breaking, path, "r1", parts=5) == 0
    assert L.pending(prompts, path, "r2").count() == 120
    L.commit_part(N.infer(prompts.where("record = 1"), answer), path, "r2")
    assert L.read_ledger(spark, path).count() == 122 and L.pending(prompts, path, "r2").count() == 118
    assert not (tmp_path / "ledger" / "_staging").exists() or not list((tmp_path / "ledger" / "_staging").iterdir())


def test_an_empty_ledger(spark, tmp_path):
    path = str(tmp_path / "none")
    assert L.read_ledger(spark, path).columns == ["record", "model", "response", "error", "run_time"]
    assert L.read_ledger(spark, path, "r").count() == 0
    prompts = spark.createDataFrame([], "record long, model string, prompt string")
    assert L.record_responses(prompts, lambda rows: N.infer(rows, str), path, "r") == 0
    assert L.read_ledger(spark, path).count() == 0


# summaries that are kept, tables in buckets


def test_a_kept_summary_is_that_of_all_rows(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(f"r{r}", f"m{m}", i, *[float(v) for v in np.round(rng.random(3), 3) * (rng.random() < 0.8)],
             bool(rng.random() < 0.9), bool(rng.random() < 0.8))
            for r in range(4) for m in range(3) for i in range(rng.integers(1, 60)) if (r, m) != (2, 1)]
    rows += [("r3", "m9", i, 0.0, 0.0, 0.0, False, False) for i in range(3)]
    scores = spark.createDataFrame(rows, "run_time string, model string, record long, bleu double,"
                                   " structural double, pixel double, has_markup boolean, has_render boolean")
    path = str(tmp_path / "state")
    # A run is put in, found wrong, and put in anew; the others are not read again.
    T.update_summary_state(scores.where("run_time = 'r0'").limit(5), path)
    for run in ("r1", "r0", "r3"):
        T.update_summary_state(scores.where(F.col("run_time") == run), path)
    T.update_summary_state(scores.where("run_time = 'r2'"), path)
    state = T.read_summary_state(spark, path)
    for by in (("model",), ("run_time", "model")):
        assert data(S.summary_of_state(state, by)) == data(S.summarize(scores, by))
    one, two = scores.where("record % 2 = 0"), scores.where("record % 2 = 1")
    merged = S.merge_states(S.summary_state(one).union(S.summary_state(two)))
    assert data(S.summary_of_state(merged)) == data(S.summarize(scores))
    assert S.summary_of_state(state.limit(0)).count() == 0


def test_tables_in_buckets_meet_where_they_are(spark, tmp_path):
    text = F.concat(F.lit("text of "), "record")
    many = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("record"), F.col("id").cast("string").alias("model")
    ).withColumn("markup", text)
    examples = spark.range(60).select(F.col("id").alias("record")).withColumn("completion", text)
    ours = T.write_bucketed(many, "bucketed_candidates", str(tmp_path / "a"), 4)
    theirs = T.write_bucketed(examples, "bucketed_examples", str(tmp_path / "b"), 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for hot in (heavy_keys(ours, "record", share=0.1, least=100), heavy_keys(ours, "record")):
            pairs = G.pair_bucketed(ours, theirs, hot)
            assert data(pairs.select("record", "model", "markup", "completion")) == data(
                many.join(examples, "record").select("record", "model", "markup", "completion")
            )
            plan = pairs._jdf.queryExecution().executedPlan().toString()
            # What is shuffled are sketches and counts of records; no exchange has a text.
            lines = plan.split("Final Plan ==")[-1].split("Initial Plan ==")[0].splitlines()
            moved = [at for at, line in enumerate(lines) if " Exchange" in line]
            assert all("markup" not in line and "completion" not in line for at in moved for line in lines[at : at + 2])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_candidates")
        spark.sql("DROP TABLE bucketed_examples")
