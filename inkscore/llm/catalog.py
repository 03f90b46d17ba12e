"""The queries of this package and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align_tokens
from .collocations import mine_collocations
from .decontaminate import contaminated
from .jaccard import link_documents
from .language import identify
from .neardup import near_duplicates
from .ngram_lm import score_texts
from .packing import pack_documents
from .quality import rate_quality
from .spans import remove_repeats
from .token_files import token_files
from .toxicity import score_toxicity
from .wordpiece import count_pieces

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_gru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op2_bloom_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every n-gram of up to three tokens counts, also one found once."""
    return score_texts(table(spark, sf_dir, "documents"), order=3, least=1)


def op3_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item it holds."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return contaminated(docs, items)


def op4_decision_list_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rate_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.drop("features")


def op5_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=3)


def op6_wordpiece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_pieces(table(spark, sf_dir, "documents"), BYTE_BPE)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), BYTE_BPE, end_id=0)


def op8_weak_supervision_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), BYTE_BPE, capacity=1024, end_id=2)


def op10_de_bruijn_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"), size=20)
    kept_sha256 = F.sha2(F.col("kept"), 256).alias("kept_sha256")
    return found.select("doc_id", "n_words", "n_removed", kept_sha256)


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents"), shingle=4, percent=85)


def op12_itemset_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_collocations(table(spark, sf_dir, "documents"), longest=3, least=10, inside=50, top=2000)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_BPE)


QUERIES = {
    "op1_byte_gru_language": op1_byte_gru_language,
    "op2_bloom_ngram_lm": op2_bloom_ngram_lm,
    "op3_pigeonhole_decontamination": op3_pigeonhole_decontamination,
    "op4_decision_list_quality": op4_decision_list_quality,
    "op5_simhash_covering": op5_simhash_covering,
    "op6_wordpiece_counts": op6_wordpiece_counts,
    "op7_token_files": op7_token_files,
    "op8_weak_supervision_toxicity": op8_weak_supervision_toxicity,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_de_bruijn_spans": op10_de_bruijn_spans,
    "op11_jaccard_join": op11_jaccard_join,
    "op12_itemset_collocations": op12_itemset_collocations,
    "op13_token_alignment": op13_token_alignment,
}

SPANS_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), k AS (
  SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)
), f AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS r FROM k
), c AS (
  SELECT DISTINCT doc_id, s + o AS i FROM (SELECT * FROM f WHERE r > 1), unnest(range(0, 20)) AS t(o)
), u AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d
), g AS (
  SELECT u.doc_id, count(c.i) AS n_removed,
         string_agg(word, ' ' ORDER BY u.i) FILTER (WHERE c.i IS NULL) AS kept
  FROM u LEFT JOIN c ON u.doc_id = c.doc_id AND u.i = c.i GROUP BY u.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""

JACCARD_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g
    FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i
  FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b
  WHERE 100 * i >= 85 * (x.n + y.n - i)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM d
  UNION
  SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id
JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) AS c ON c.a = d.doc_id
"""

COLLOCATIONS_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM d
), g AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM w
  UNION ALL
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')))
  FROM w, (VALUES (2), (3)) AS t(k) WHERE len(w) >= k
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL
), n AS (
  SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS p FROM f WHERE k >= 2 AND f >= 10
), cut AS (
  SELECT c.lang, c.phrase, c.a, x.cut, l.f AS l, r.f AS r,
         (CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM c JOIN (VALUES (1), (2)) AS x(cut) ON x.cut < c.k
  JOIN f AS l ON l.lang = c.lang AND l.phrase = array_to_string(c.p[1:x.cut], ' ')
  JOIN f AS r ON r.lang = c.lang AND r.phrase = array_to_string(c.p[x.cut + 1:c.k], ' ')
), s AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), h AS (
  SELECT lang, phrase, max(a) AS most FROM (
    SELECT lang, a, unnest([array_to_string(p[1:2], ' '), array_to_string(p[2:3], ' ')]) AS phrase FROM c WHERE k = 3
  ) GROUP BY lang, phrase
), o AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
  FROM s LEFT JOIN h ON h.lang = s.lang AND h.phrase = s.phrase
  WHERE h.most IS NULL OR 100 * h.most < 50 * s.a
)
SELECT o.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
       CAST(r AS BIGINT) AS r, CAST(n.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000
"""

ORACLE: dict[str, str] = {
    "op10_de_bruijn_spans": SPANS_SQL,
    "op11_jaccard_join": JACCARD_SQL,
    "op12_itemset_collocations": COLLOCATIONS_SQL,
}
