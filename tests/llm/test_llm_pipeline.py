import corpus_pipeline
import public_tokenizers
import pyarrow as pa
from conftest import SF_DIR
from llm_cases import PASSAGE, docs

import __spark_entry__ as driver
from inkscore.llm.encoding import Encoder, encoder
from inkscore.llm.shared import WORD_HASHES, remember, settle

CLEAN = [(i, f"clean text number{i} " + " ".join(f"k{i}w{j}" for j in range(30)), "en", "s", 1) for i in range(20, 60)]


def test_stages(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "substrings", "decontamination", "packing"]
    assert "pipeline" in driver.queries() and corpus_pipeline.ORACLE_SQL is None


def test_stages_on_odd_documents(spark, tmp_path):
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    from llm_cases import ROWS

    table = docs(spark, ROWS + CLEAN)
    columns, ids = table.columns, []
    current = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = settle(stage(spark, current, str(tmp_path)), f"test-{name}")
        assert current.columns == columns
        ids.append({r["doc_id"] for r in current.select("doc_id").collect()})
    clean = {r[0] for r in CLEAN}
    assert all(clean <= own for own in ids)
    assert not {2, 3, 4, 5} & ids[0]
    assert 1 in ids[1] and 10 not in ids[1]
    assert {7, 8} <= ids[2] and 7 not in ids[3] and 8 in ids[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, current, str(tmp_path))
    assert {r["doc_id"] for r in packed.collect()} == ids[3]
    empty = docs(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).collect() == []


def test_pipeline_query(spark):
    """The rows of the whole run against slow versions of what each stage decides."""
    from test_llm_groups import slow_fingerprint, slow_labels
    from test_llm_spans import slow_repeats

    from inkscore.llm.decontaminate import Matcher

    found = driver.queries()["pipeline"](spark, SF_DIR).collect()
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    known = corpus_pipeline.language(spark, spark.read.parquet(f"{SF_DIR}/documents.parquet"), SF_DIR)
    ids = sorted(r["doc_id"] for r in known.collect())
    labels = slow_labels([slow_fingerprint(rows[i]) for i in ids])
    ids = [i for n, i in enumerate(ids) if labels[n] == n]
    cut = slow_repeats([(i, rows[i]) for i in ids], 20)
    texts = {i: cut[i][2].decode() if cut[i][1] else rows[i] for i in ids}
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()
    matcher = Matcher([(r["item_id"], r["text"]) for r in items])
    kept = {i for i, t in texts.items() if not matcher.find(t)}
    assert {r["doc_id"] for r in found} == kept
    from test_llm_packing import check_packed

    check_packed([(i, texts[i]) for i in kept], found, 1024, 2)


def test_workers_get_small_batches_of_texts(spark):
    """A task and its Python worker hold little of the texts at once, in every stage."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    table = spark.range(0, 12_000, 1, 1).selectExpr("id AS doc_id", "repeat('some words ', 200) AS text", "'en' AS lang")
    try:
        for _, stage in corpus_pipeline.STAGES[1:3]:
            spark.conf.set(setting, "64m")
            stage(spark, table, SF_DIR)

            def held(batches):
                for batch in batches:
                    yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["held"])

            sizes = [r["held"] for r in table.mapInArrow(held, "held long").collect()]
            assert sum(sizes) > 24_000_000 and max(sizes) < 6_000_000
    finally:
        spark.conf.set(setting, before)


def test_a_worker_remembers_one_operator():
    """Word hashes and token pieces are not held beside one another, nor while neither is used."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    hashes = WORD_HASHES.of([b"one", b"two"]).tolist()
    assert len(WORD_HASHES) >= 2
    ids = encoder(path).encode(["one two"])
    assert not WORD_HASHES and encoder(path).pieces and ids == Encoder(path).encode(["one two"])
    assert WORD_HASHES.of([b"one", b"two"]).tolist() == hashes and not encoder(path).pieces
    remember(None)
    assert not WORD_HASHES and not encoder(path).pieces
