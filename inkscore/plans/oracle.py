"""The same results in SQL over the given tables, for comparison in DuckDB."""

from __future__ import annotations

from inkscore.plans.catalog import PICKED
from inkscore.plans.fixtures import MODELS, RUNS

_SPACE = (
    r"[\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _tokens(expr: str) -> str:
    for old, new in (
        ("<skipped>", ""),
        ("-\n", ""),
        ("\n", " "),
        ("&quot;", '"'),
        ("&amp;", "&"),
        ("&lt;", "<"),
        ("&gt;", ">"),
    ):
        expr = f"replace({expr}, {_q(old)}, {_q(new)})"
    for pattern, new in (
        (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "),
        (r"([^0-9])([\.,])", r"\1 \2 "),
        (r"([\.,])([^0-9])", r" \1 \2"),
        (r"([0-9])(-)", r"\1 \2 "),
    ):
        expr = f"regexp_replace({expr}, {_q(pattern)}, {_q(new)}, 'g')"
    return f"list_filter(regexp_split_to_array({expr}, {_q(_SPACE)}), lambda t: t <> '')"


EXAMPLES = """examples AS (
  SELECT page_id AS record, title, md5(url) AS image, width, height,
    '<svg width="' || width || '" height="' || height || '"><text>'
      || regexp_replace(html, '<[^>]*>', ' ', 'g') || '</text><image href="data:image/png;base64,' || md5(url) || '"/>'
      || CASE WHEN page_id % 3 = 0
           THEN '<image href="data:image/jpeg;base64,' || md5(html) || '"/>' ELSE '' END
      || '</svg>' AS completion
  FROM (SELECT page_id, url, html, regexp_extract(html, '<title>(.*?)</title>', 1) AS title,
          CAST(200 + (page_id % 5) * 40 AS INTEGER) AS width,
          CAST(280 + (page_id % 3) * 20 AS INTEGER) AS height FROM pages))"""

GROUPS = "grp AS (SELECT * FROM (VALUES {}) AS t(run_time, model))".format(
    ", ".join(
        f"({_q(r)}, {_q(m)})" for r in RUNS for m in MODELS if (r, m) != (RUNS[1], "m_trunc")
    )
)
NAMES = "names AS (SELECT * FROM (VALUES {}) AS t(model))".format(
    ", ".join(f"({_q(m)})" for m in MODELS)
)

OUTPUTS = f"""{EXAMPLES}, {GROUPS}, outputs AS (
  SELECT g.run_time, g.model, e.record, CASE g.model
      WHEN 'm_exact' THEN 'Here you go:' || chr(10) || e.completion || ' done.'
      WHEN 'm_alt' THEN CASE WHEN e.record % 11 = 0 THEN 'Sorry, I cannot draw this.'
        ELSE '<svg width="' || e.width || '"><text>' || coalesce(n.title, 'none')
          || '</text><image href="cdn://1.jpg"/></svg>' END
      ELSE CASE WHEN e.record % 7 = 0 THEN e.completion[1:length(e.completion) - 6]
        ELSE '<svg width="' || e.width || '" height="' || e.height || '"><text>'
          || substr(e.title, 1, 30) || '</text></svg>' END END AS response,
    NOT (g.model = 'm_trunc' AND e.record % 5 = 0) AS rendered
  FROM examples e CROSS JOIN grp g
  LEFT JOIN examples n ON n.record = e.record + 1 - 2 * (e.record % 2))"""

ARTIFACTS = rf"""{OUTPUTS}, artifacts AS (
  SELECT run_time, model, record, markup, markup IS NOT NULL AS has_markup,
    markup IS NOT NULL AND rendered AS has_render, response
  FROM (SELECT *, nullif(regexp_extract(response, '(<svg[\s\S]*?</svg>)', 1), '') AS markup
        FROM outputs))"""

ASSETS = r"""urls AS (
  SELECT record, regexp_extract_all(completion, 'data:image[^"'']*') AS u FROM examples),
assets AS (
  SELECT record, i, 'cdn://' || i || '.jpg' AS short, u[i] AS url
  FROM urls, unnest(range(1, len(u) + 1)) AS t(i))"""

PIXELS = """pixels AS (
  SELECT image_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, c,
    CAST(least(255, greatest(0, floor((CAST(e AS DOUBLE) + 0.6::DOUBLE)
      * (212.5::DOUBLE - 20 * c)))) AS INTEGER) AS v, low
  FROM (SELECT vec_id AS image_id, unnest(embedding) AS e,
          generate_subscripts(embedding, 1) - 1 AS i,
          CAST(embedding[1] AS DOUBLE) < -0.15 AS low FROM embeddings) q
  CROSS JOIN (VALUES (0), (1), (2)) AS t(c))"""

RAGGED = f"""{PIXELS}, ragged AS (SELECT * FROM pixels WHERE y < CASE WHEN low THEN 6 ELSE 8 END)"""

PAIRS = """pairs AS (
  SELECT a.vec_id AS gen_id, b.vec_id AS tgt_id
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""

SIDE = f"""{PIXELS}, {PAIRS}, side AS (
  SELECT gen_id, tgt_id, g.y, g.x, g.c, g.v AS a, t.v AS b
  FROM pairs JOIN pixels g ON g.image_id = gen_id
  JOIN pixels t ON t.image_id = tgt_id AND t.y = g.y AND t.x = g.x AND t.c = g.c)"""

SSIM = """across AS (
  SELECT gen_id, tgt_id, y, x, c, count(*) OVER w AS n, sum(a) OVER w AS a, sum(b) OVER w AS b,
    sum(a * a) OVER w AS aa, sum(b * b) OVER w AS bb, sum(a * b) OVER w AS ab
  FROM side WINDOW w AS (PARTITION BY gen_id, tgt_id, c, y ORDER BY x
    ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
down AS (
  SELECT gen_id, tgt_id, count(*) OVER w AS n, (sum(a) OVER w) / 49::DOUBLE AS p,
    (sum(b) OVER w) / 49::DOUBLE AS q, (sum(aa) OVER w) / 49::DOUBLE AS pp,
    (sum(bb) OVER w) / 49::DOUBLE AS qq, (sum(ab) OVER w) / 49::DOUBLE AS pq
  FROM across WHERE n = 7 WINDOW w AS (PARTITION BY gen_id, tgt_id, c, x ORDER BY y
    ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
structural AS (
  SELECT gen_id, tgt_id, avg((2 * p * q + 6.5025::DOUBLE)
      * (2 * (49::DOUBLE / 48) * (pq - p * q) + 58.5225::DOUBLE)
      / ((p * p + q * q + 6.5025::DOUBLE) * ((49::DOUBLE / 48) * (pp - p * p)
        + (49::DOUBLE / 48) * (qq - q * q) + 58.5225::DOUBLE))) AS structural
  FROM down WHERE n = 7 GROUP BY gen_id, tgt_id)"""

WRAP = """wrap AS (
  SELECT gen_id, tgt_id, 1 - avg((a - b + 256) % 256) / 255 AS pixel
  FROM side GROUP BY gen_id, tgt_id)"""


def _lanczos_weights(shapes: str) -> str:
    """CTE ``weights(n_in, n_out, o, i, k)`` for the query ``shapes`` of n_in, n_out."""
    return f"""shapes AS ({shapes}),
cells AS (
  SELECT n_in, n_out, o, (o + 0.5::DOUBLE) * n_in / n_out AS centre,
    greatest(n_in::DOUBLE / n_out, 1) AS stretch
  FROM shapes, unnest(range(0, n_out)) AS t(o)),
taps AS (
  SELECT n_in, n_out, o, i, (i - centre + 0.5::DOUBLE) / stretch AS d
  FROM cells, unnest(range(0, n_in)) AS t(i)
  WHERE i >= floor(centre - 3 * stretch + 0.5::DOUBLE)
    AND i < floor(centre + 3 * stretch + 0.5::DOUBLE)),
lobes AS (
  SELECT n_in, n_out, o, i, CASE WHEN d = 0 THEN 1::DOUBLE WHEN d >= -3 AND d < 3
    THEN sin(pi() * d) / (pi() * d) * (sin(pi() * d / 3) / (pi() * d / 3)) ELSE 0 END AS f
  FROM taps),
weights AS (
  SELECT n_in, n_out, o, i, CAST(CASE WHEN z < 0 THEN ceil(z - 0.5::DOUBLE)
    ELSE floor(z + 0.5::DOUBLE) END AS BIGINT) AS k
  FROM (SELECT n_in, n_out, o, i,
      f / (sum(f) OVER (PARTITION BY n_in, n_out, o)) * 4194304 AS z FROM lobes))"""


def _clip(total: str) -> str:
    return f"CAST(least(255, greatest(0, ((({total}) + 2097152)::BIGINT >> 22))) AS INTEGER)"


RAGGED_SIDE = f"""{RAGGED}, {PAIRS},
sizes AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM ragged GROUP BY image_id),
usable AS (
  SELECT gen_id, tgt_id, g.h AS n_in, t.h AS n_out FROM pairs
  JOIN sizes g ON g.image_id = gen_id JOIN sizes t ON t.image_id = tgt_id
  WHERE t.h >= 7 AND t.w >= 7),
{_lanczos_weights("SELECT DISTINCT n_in, n_out FROM usable")},
moved AS (
  SELECT gen_id, tgt_id, CAST(o AS INTEGER) AS y, x, c, {_clip("sum(v * k)")} AS a
  FROM usable JOIN ragged ON image_id = gen_id JOIN weights USING (n_in, n_out)
  WHERE i = y GROUP BY gen_id, tgt_id, o, x, c),
side AS (
  SELECT gen_id, tgt_id, m.y, m.x, m.c, m.a, t.v AS b
  FROM moved m JOIN ragged t ON t.image_id = tgt_id AND t.y = m.y AND t.x = m.x AND t.c = m.c),
{SSIM}, {WRAP},
alike AS (
  SELECT gen_id, tgt_id, coalesce(structural, 0) AS structural, coalesce(pixel, 0) AS pixel
  FROM pairs LEFT JOIN structural USING (gen_id, tgt_id) LEFT JOIN wrap USING (gen_id, tgt_id))"""

LARGE = f"""{PIXELS}, ragged AS (
  SELECT image_id // 100 AS image_id, CAST(8 * (image_id % 100 // 10) + y + 80 * ty AS INTEGER) AS y,
    CAST(8 * (image_id % 10) + x + 80 * tx AS INTEGER) AS x, c, v
  FROM pixels, unnest(range(0, 13)) AS t(tx), unnest(range(0, 13)) AS u(ty)
  WHERE 8 * (image_id % 10) + x + 80 * tx < 1024 AND 8 * (image_id % 100 // 10) + y + 80 * ty
    < CASE WHEN image_id // 100 % 2 = 0 THEN 1024 ELSE 896 END)"""

LARGE_PAIRS = """pairs AS (
  SELECT DISTINCT a.vec_id // 100 AS gen_id, b.vec_id // 100 AS tgt_id
  FROM embeddings a JOIN embeddings b ON b.vec_id // 100 = a.vec_id // 100 + 1)"""

LARGE_SIDE = (
    RAGGED_SIDE.replace(RAGGED, LARGE).replace(PAIRS, LARGE_PAIRS).replace("WHERE i = y GROUP", "WHERE i = y AND k <> 0 GROUP")
)

EVENTS = """scored AS (
  SELECT strftime(ts, '%Y-%m-%d') || '_00-00-00' AS run_time, event_id AS record,
    'm_' || event_type AS model,
    CASE WHEN f THEN 0::DOUBLE ELSE value / 500 END AS bleu,
    CASE WHEN f THEN 0::DOUBLE ELSE 1 - value / 1000 END AS structural,
    CASE WHEN f THEN 0::DOUBLE ELSE (event_id % 1000) / 1000::DOUBLE END AS pixel,
    event_id % 32 <> 0 AS has_markup, event_id % 16 <> 0 AS has_render
  FROM (SELECT *, event_id % 16 = 0 OR event_type = 'error' AS f FROM events))"""


def _sig3(expr: str) -> str:
    return f"CAST(printf('%.3g', CAST({expr} AS DOUBLE)) AS DOUBLE)"


ROUNDED = f"""{EVENTS}, rounded AS (
  SELECT run_time, record, model, has_markup, has_render, {_sig3("bleu")} AS bleu,
    {_sig3("structural")} AS structural, {_sig3("pixel")} AS pixel FROM scored)"""

_OK = "NOT (bleu = 0 AND structural = 0 AND pixel = 0)"
_FAILURES = """count(*) FILTER (WHERE has_markup AND NOT has_render) AS render_failures,
    count(*) FILTER (WHERE NOT has_markup AND NOT has_render) AS generation_failures"""


def _mean(value: str) -> str:
    """Mean by whole multiples of 2^-60, since a plain sum misses exact ties."""
    unit = "1152921504606846976::DOUBLE"
    whole = f"trunc({value} * {unit})"
    return f"""((sum(CAST({whole} AS HUGEINT))::DOUBLE / {unit}
      + sum({value} - {whole} / {unit})) / count({value}))"""


def _summary(source: str, by: str, name: str = "summary") -> str:
    """CTE with the summary of ``source``, grouped by the columns ``by``."""
    run = by.replace("model", "").strip(", ")
    over = f"OVER (PARTITION BY {run})" if run else "OVER ()"
    wins = f"sum(ok) {over} = 0"
    means = ", ".join(f"{_mean(m)} AS {m}" for m in ("bleu", "structural", "pixel"))
    good = ", ".join(
        f"{_mean(f'CASE WHEN {_OK} THEN {m} END')} AS {m}_ok"
        for m in ("bleu", "structural", "pixel")
    )
    rounded = ", ".join(f"{_sig3(m)} AS {m}" for m in ("bleu", "structural", "pixel"))
    rounded_good = ", ".join(
        f"CASE WHEN {wins} THEN 0 ELSE {_sig3(m + '_ok')} END AS {m}_successful"
        for m in ("bleu", "structural", "pixel")
    )
    return f"""{name} AS (
  SELECT {by}, n AS count, CASE WHEN {wins} THEN 0 ELSE nullif(ok, 0) END AS successful_count,
    render_failures, generation_failures, {rounded}, {rounded_good}
  FROM (SELECT {by}, count(*) AS n, count(*) FILTER (WHERE {_OK}) AS ok, {means}, {good},
          {_FAILURES} FROM {source} GROUP BY {by}))"""


def _grams(source: str, key: str) -> str:
    """CTE ``grams(key, n, gram)`` of the token lists ``t`` of ``source``."""
    return f"""words AS (SELECT {key}, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM {source}),
nexts AS (
  SELECT {key}, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4
  FROM words WINDOW o AS (PARTITION BY {key} ORDER BY i)),
grams AS (
  SELECT {key}, 1 AS n, w AS gram FROM nexts
  UNION ALL SELECT {key}, 2, w || ' ' || w2 FROM nexts WHERE w2 IS NOT NULL
  UNION ALL SELECT {key}, 3, w || ' ' || w2 || ' ' || w3 FROM nexts WHERE w3 IS NOT NULL
  UNION ALL SELECT {key}, 4, w || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM nexts
    WHERE w4 IS NOT NULL)"""


def _ngrams(source: str, key: str, text: str) -> str:
    """CTEs ``toks`` and ``grams(key, n, gram)`` of one text column."""
    return f"""toks AS (SELECT {key}, {_tokens(text)} AS t FROM {source}),
{_grams('toks', key)}"""


def _bleu(source: str, key: str, cand: str, ref: str) -> str:
    """CTEs ending in ``bleu(key, len_c, len_r, bleu)`` and ``orders``."""
    return f"""toks AS (
  SELECT {key}, {_tokens(cand)} AS ct, {_tokens(ref)} AS rt FROM {source}),
sides AS (SELECT {key}, 1 AS cand, ct AS t FROM toks UNION ALL
          SELECT {key}, 0 AS cand, rt AS t FROM toks),
{_grams('sides', key + ', cand')},
counts AS (
  SELECT {key}, n, gram, count(*) FILTER (WHERE cand = 1) AS c,
    count(*) FILTER (WHERE cand = 0) AS r FROM grams GROUP BY {key}, n, gram),
hits AS (SELECT {key}, n, CAST(sum(least(c, r)) AS BIGINT) AS hit FROM counts GROUP BY {key}, n),
orders AS (
  SELECT {key}, CAST(a.n AS INTEGER) AS n, CAST(len(ct) AS INTEGER) AS len_c,
    CAST(len(rt) AS INTEGER) AS len_r, coalesce(hit, 0) AS matched,
    CAST(greatest(len(ct) - a.n + 1, 0) AS INTEGER) AS possible
  FROM toks CROSS JOIN unnest(range(1, 5)) AS a(n) LEFT JOIN hits USING ({key}, n)),
bleu AS (
  SELECT {key}, len_c, len_r, CASE WHEN min(matched) > 0 AND len_r > 0
    THEN exp(sum(ln(CASE WHEN matched > 0 THEN matched / possible::DOUBLE ELSE 1 END)) / 4)
      * CASE WHEN len_c > len_r THEN 1 ELSE exp(1 - len_r / len_c::DOUBLE) END
    ELSE 0 END AS bleu
  FROM orders GROUP BY {key}, len_c, len_r)"""


def _neighbours(table: str, key: str, text: str) -> str:
    return f"""tp AS (
  SELECT d.{key} AS pair_id, d.{text} AS cand, n.{text} AS ref
  FROM {table} d JOIN {table} n ON d.{key} = n.{key} + 1 - 2 * (n.{key} % 2))"""


_RUN_KEY = "run_time, model, record"
PAGE_BLEU = f"WITH {_neighbours('pages', 'page_id', 'html')}, {_bleu('tp', 'pair_id', 'cand', 'ref')}"
DOC_BLEU = (
    f"WITH {_neighbours('documents', 'doc_id', 'text')}, {_bleu('tp', 'pair_id', 'cand', 'ref')}"
)
OUTPUT_BLEU = f"""{ARTIFACTS}, tp AS (
  SELECT run_time, model, record, has_render, markup, completion
  FROM artifacts JOIN examples USING (record) WHERE has_markup),
{_bleu('tp', _RUN_KEY, 'markup', 'completion')}"""

SCORES = f"""{OUTPUT_BLEU}, {RAGGED_SIDE}, final AS (
  SELECT g.run_time, g.model, e.record, coalesce(a.has_markup, false) AS has_markup,
    coalesce(a.has_render, false) AS has_render,
    {_sig3("CASE WHEN a.has_render THEN b.bleu ELSE 0 END")} AS bleu,
    {_sig3("CASE WHEN a.has_render THEN coalesce(s.structural, 0) ELSE 0 END")} AS structural,
    {_sig3("CASE WHEN a.has_render THEN coalesce(s.pixel, 0) ELSE 0 END")} AS pixel
  FROM examples e CROSS JOIN grp g
  LEFT JOIN artifacts a ON a.run_time = g.run_time AND a.model = g.model AND a.record = e.record
  LEFT JOIN bleu b ON b.run_time = g.run_time AND b.model = g.model AND b.record = e.record
  LEFT JOIN alike s ON s.gen_id = e.record)"""

_ITEMS = f"""{EXAMPLES}, {ASSETS}, items AS (
  SELECT record, 0 AS pos, 'text' AS type, 'Write SVG code to recreate this ' || width || ' x '
    || height || ' px design.' AS text, NULL AS url FROM examples
  UNION ALL SELECT record, 1, 'image_url', NULL, 'data:image/png;base64,' || image FROM examples
  UNION ALL SELECT record, 2 * i, 'text', 'Image asset href=''' || short || '''', NULL FROM assets
  UNION ALL SELECT record, 2 * i + 1, 'image_url', NULL, url FROM assets)"""

_BAD = f"""{EXAMPLES}, bad AS (
  SELECT record, width AS w, height, CASE WHEN record % 13 = 0 THEN '' ELSE completion END AS done,
    CASE WHEN record % 17 <> 0 THEN width END AS width FROM examples),
checked AS (
  SELECT *, CASE WHEN done = '' THEN 'no completion'
    WHEN width IS NULL OR height IS NULL
    THEN 'image without width or height' END AS error FROM bad)"""

_PICK = ", ".join(str(i) for i in PICKED)
_PICK_ROWS = ", ".join(f"({row}, {record})" for row, record in enumerate(PICKED))
_COLS = ", ".join(f"({col}, {_q(m)})" for col, m in enumerate(("target", *MODELS)))
_MANIFEST = f"""{ARTIFACTS}, manifest AS (
  SELECT e.record, p.row, m.model, m.col,
    CASE WHEN m.model = 'target' OR a.has_render THEN 'ok' ELSE 'Image not found' END AS status,
    m.col * 288 AS x, p.row * 358 AS y
  FROM (VALUES {_PICK_ROWS}) AS p(row, record) JOIN examples e ON e.record = p.record
  CROSS JOIN (VALUES {_COLS}) AS m(col, model)
  LEFT JOIN artifacts a ON a.record = p.record AND a.model = m.model AND a.run_time = {_q(RUNS[0])})"""

_DOC_URL = "'data:image/png;base64,' || to_base64(encode(text))"

ORACLE: dict[str, str] = {
    "examples_scan": f"WITH {EXAMPLES} SELECT record, completion, width, height FROM examples",
    "raw_one_run": f"""WITH {OUTPUTS} SELECT record, model, response, run_time FROM outputs
        WHERE run_time = {_q(RUNS[1])}""",
    "first_n_examples": f"""WITH {EXAMPLES} SELECT record, title, width, height FROM examples
        ORDER BY record LIMIT 32""",
    "record_numbering": """SELECT event_id, user_id, value,
        row_number() OVER (ORDER BY value, event_id) - 1 AS record FROM events""",
    "validate_rows": f"WITH {_BAD} SELECT record, error FROM checked",
    "select_models": f"""WITH {EVENTS} SELECT record, model FROM scored
        WHERE model IN ('m_view', 'm_click')""",
    "scores_one_run": f"""WITH {EVENTS} SELECT run_time, record, model, bleu, structural, pixel
        FROM scored WHERE run_time = '2024-01-15_00-00-00'""",
    "successful_rows": f"""WITH {EVENTS} SELECT record, model, bleu, structural, pixel
        FROM scored WHERE {_OK}""",
    "pick_records": f"WITH {EXAMPLES} SELECT record, title FROM examples WHERE record IN ({_PICK})",
    "extract_markup_rows": f"WITH {ARTIFACTS} SELECT run_time, model, record, markup FROM artifacts",
    "extract_assets_rows": f"""WITH {EXAMPLES}, {ASSETS} SELECT record,
        CAST(count(*) AS INTEGER) AS n, string_agg(short || '=' || url, '|' ORDER BY i) AS assets
        FROM assets GROUP BY record""",
    "explode_assets": f"""WITH {EXAMPLES}, {ASSETS} SELECT record, CAST(i AS INTEGER) AS i, short,
        url FROM assets""",
    "restore_assets_rows": f"""WITH {ARTIFACTS}, {ASSETS}
        SELECT run_time, model, a.record,
          replace(replace(markup, 'cdn://1.jpg', coalesce(one.url, 'cdn://1.jpg')),
            'cdn://2.jpg', coalesce(two.url, 'cdn://2.jpg')) AS markup
        FROM artifacts a LEFT JOIN assets one ON one.record = a.record AND one.i = 1
        LEFT JOIN assets two ON two.record = a.record AND two.i = 2 WHERE has_markup""",
    "to_data_url_rows": f"""SELECT doc_id, {_DOC_URL} AS from_bytes,
        'data:image/png;base64,' || md5(text) AS from_text, 'data:' || md5(text) AS from_url
        FROM documents""",
    "decode_data_url_rows": f"""SELECT doc_id,
        hex(from_base64(string_split({_DOC_URL}, ',')[2])) AS payload FROM documents""",
    "preview_url_rows": f"""WITH {EXAMPLES} SELECT record,
        u[1:30] || '...' || right(u, 10) AS preview, image AS unchanged
        FROM (SELECT record, image, 'data:image/png;base64,' || image AS u FROM examples)""",
    "sig3_rows": f"""WITH {EVENTS} SELECT record, {_sig3("bleu")} AS bleu,
        {_sig3("structural")} AS structural, {_sig3("pixel")} AS pixel,
        {_sig3("bleu * structural / 7")} AS product FROM scored""",
    "tokens_13a": f"""SELECT page_id, CAST(len(t) AS INTEGER) AS n,
        array_to_string(t, ' ') AS tokens FROM (SELECT page_id, {_tokens('html')} AS t FROM pages)""",
    "score_bands": f"""WITH {EVENTS} SELECT record,
        CASE WHEN bleu >= 0.7 THEN 'near_perfect' WHEN bleu >= 0.4 THEN 'good_structure'
          ELSE 'different' END AS bleu_band,
        CASE WHEN structural >= 0.95 THEN 'identical' WHEN structural >= 0.8
          THEN 'minor_differences' ELSE 'noticeable_differences' END AS structural_band,
        CASE WHEN pixel >= 1 THEN 'perfect' WHEN pixel >= 0.9 THEN 'nearly_identical'
          ELSE 'significant_differences' END AS pixel_band FROM scored""",
    "metric_disagreement": f"""WITH {EVENTS} SELECT record, CASE
        WHEN bleu >= 0.7 AND structural < 0.8 AND pixel < 0.9 THEN 'code_good_image_bad'
        WHEN bleu < 0.4 AND structural >= 0.95 AND pixel >= 1 THEN 'code_bad_image_good'
        WHEN structural >= 0.95 AND pixel < 0.9 THEN 'structural_good_pixel_bad' END AS disagreement
        FROM scored""",
    "work_grid": f"""WITH {EXAMPLES}, {NAMES} SELECT record, width, height, model
        FROM examples CROSS JOIN names""",
    "prompt_items": f"WITH {_ITEMS} SELECT record, CAST(pos AS INTEGER) AS pos, type, text, url FROM items",
    "to_chat": f"""WITH {_ITEMS} SELECT record, 'user' AS role, CAST(pos AS INTEGER) AS pos,
        CASE WHEN type = 'image_url' THEN 'image' ELSE type END AS type, text, url AS image
        FROM items""",
    "conversation_messages": """SELECT conv_id, turn, role, 'text' AS type, text
        FROM conversations""",
    "prompt_preview": f"""WITH {_ITEMS} SELECT record,
        CAST(count(*) FILTER (WHERE pos > 1) // 2 AS INTEGER) AS assets,
        '[' || string_agg(CASE WHEN type = 'text'
          THEN '{{"type":"text","text":"' || text || '"}}'
          ELSE '{{"type":"image_url","image_url":{{"url":"' || url[1:30] || '...' || right(url, 10)
            || '"}}}}' END, ',' ORDER BY pos) || ']' AS items
        FROM items GROUP BY record ORDER BY record LIMIT 6""",
    "infer_stub": f"""WITH {_BAD}, {NAMES} SELECT record, model, coalesce(answer, problem) AS response,
        problem AS error FROM (SELECT record, model, coalesce(error, CASE WHEN record % 5 = 0
            THEN 'no answer for ' || record END) AS problem,
          CASE WHEN error IS NULL AND record % 5 <> 0 THEN model
            || ': Write SVG code to recreate this ' || width || ' x ' || height
            || ' px design.' END AS answer FROM checked CROSS JOIN names)""",
    "resumed_responses": f"""WITH {_BAD}, {NAMES} SELECT '2025-01-10_08-00-00' AS run_time, record, model, coalesce(answer, problem) AS response,
        problem AS error FROM (SELECT record, model, coalesce(error, CASE WHEN record % 5 = 0
            THEN 'no answer for ' || record END) AS problem,
          CASE WHEN error IS NULL AND record % 5 <> 0 THEN model
            || ': Write SVG code to recreate this ' || width || ' x ' || height
            || ' px design.' END AS answer FROM checked CROSS JOIN names)""",
    "artifacts": f"WITH {ARTIFACTS} SELECT * FROM artifacts",
    "candidate_pairs": f"""WITH {ARTIFACTS} SELECT run_time, model, record, markup, completion
        FROM artifacts JOIN examples USING (record) WHERE has_markup""",
    "bucketed_pairs": f"""WITH {ARTIFACTS} SELECT run_time, model, record, markup, completion
        FROM artifacts JOIN examples USING (record) WHERE has_markup""",
    "complete_grid": f"""WITH {EVENTS} SELECT m.model, r.record, coalesce(bleu, 0) AS bleu,
        coalesce(structural, 0) AS structural, coalesce(pixel, 0) AS pixel
        FROM (SELECT record FROM scored) r CROSS JOIN (SELECT DISTINCT model FROM scored) m
        LEFT JOIN scored s ON s.record = r.record AND s.model = m.model""",
    "missing_targets": f"""WITH {PAIRS} SELECT gen_id AS record FROM pairs
        WHERE gen_id NOT IN (SELECT page_id FROM pages)""",
    "missing_artifacts": f"""WITH {ARTIFACTS} SELECT run_time, model, record,
        CASE WHEN has_markup THEN 'render' ELSE 'markup,render' END AS missing
        FROM artifacts WHERE NOT has_render""",
    "artifact_coverage": f"""WITH {ARTIFACTS} SELECT run_time, model,
        (SELECT count(*) FROM examples) AS expected, count(*) FILTER (WHERE has_markup) AS markup,
        count(*) FILTER (WHERE has_render) AS render, bool_and(has_render) AS complete
        FROM artifacts GROUP BY run_time, model""",
    "ngram_counts": f"""WITH {_ngrams('pages', 'page_id', 'html')}
        SELECT page_id, CAST(n AS INTEGER) AS n, gram, count(*) AS count FROM grams
        GROUP BY page_id, n, gram""",
    "ngram_precision": f"""{PAGE_BLEU} SELECT pair_id, n, matched, possible,
        round(CASE WHEN possible > 0 THEN matched / possible::DOUBLE ELSE 0 END, 9) AS precision
        FROM orders""",
    "bleu_pages": f"{PAGE_BLEU} SELECT pair_id, len_c, len_r, round(bleu, 9) AS bleu FROM bleu",
    "bleu_documents": f"{DOC_BLEU} SELECT pair_id, len_c, len_r, round(bleu, 9) AS bleu FROM bleu",
    "bleu_documents_grams": f"""{DOC_BLEU} SELECT pair_id, len_c, len_r, round(bleu, 9) AS bleu
        FROM bleu""",
    "bleu_outputs": f"""WITH {OUTPUT_BLEU} SELECT run_time, model, record, len_c, len_r,
        round(bleu, 9) AS bleu FROM bleu""",
    "bleu_leaderboard": f"""WITH {OUTPUT_BLEU} SELECT model, round(avg(bleu), 6) AS bleu,
        count(*) AS count FROM bleu GROUP BY model ORDER BY bleu DESC, model""",
    "pixel_wrap": f"""WITH {SIDE}, {WRAP} SELECT gen_id, tgt_id, round(pixel, 9) AS pixel
        FROM wrap""",
    "pixel_abs": f"""WITH {SIDE} SELECT gen_id, tgt_id, round(1 - avg(abs(a - b)) / 255, 9) AS pixel
        FROM side GROUP BY gen_id, tgt_id""",
    "ssim": f"""WITH {SIDE}, {SSIM} SELECT gen_id, tgt_id, round(structural, 6) AS structural
        FROM structural""",
    "lanczos_resample": f"""WITH {PIXELS}, tiled AS (
          SELECT image_id // 4 AS image_id, y + 8 * (image_id % 4 // 2) AS y,
            x + 8 * (image_id % 4 % 2) AS x, c, v FROM pixels),
        sizes AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM tiled GROUP BY image_id),
        {_lanczos_weights("SELECT w AS n_in, 8 AS n_out FROM sizes UNION SELECT h, 8 FROM sizes")},
        across AS (
          SELECT image_id, h, y, c, o AS x, {_clip("sum(v * k)")} AS v
          FROM tiled JOIN sizes USING (image_id) JOIN weights ON n_in = w AND i = x
          GROUP BY image_id, h, y, c, o)
        SELECT image_id, CAST(o AS INTEGER) AS y, CAST(x AS INTEGER) AS x, c,
          {_clip("sum(v * k)")} AS v
        FROM across JOIN weights ON n_in = h AND i = y GROUP BY image_id, o, x, c""",
    "image_similarity": f"""WITH {RAGGED_SIDE} SELECT gen_id, tgt_id,
        round(structural, 6) AS structural, round(pixel, 6) AS pixel FROM alike""",
    "image_similarity_packed": f"""WITH {RAGGED_SIDE} SELECT gen_id, tgt_id,
        round(structural, 6) AS structural, round(pixel, 6) AS pixel FROM alike""",
    "strip_similarity": f"""WITH {LARGE_SIDE} SELECT gen_id, tgt_id,
        round(structural, 6) AS structural, round(pixel, 6) AS pixel FROM alike""",
    "unpack_pixels": f"WITH {RAGGED} SELECT image_id, y, x, c, v FROM ragged",
    "scores": f"WITH {SCORES} SELECT * FROM final",
    "scores_summary": f"WITH {SCORES}, {_summary('final', 'run_time, model')} SELECT * FROM summary",
    "mean_scores": f"""WITH {ROUNDED} SELECT model, round(avg(bleu), 6) AS bleu,
        round(avg(structural), 6) AS structural, round(avg(pixel), 6) AS pixel, count(*) AS count
        FROM rounded GROUP BY model""",
    "successful_means": f"""WITH {ROUNDED} SELECT model,
        round(avg(bleu) FILTER (WHERE {_OK}), 6) AS bleu_successful,
        round(avg(structural) FILTER (WHERE {_OK}), 6) AS structural_successful,
        round(avg(pixel) FILTER (WHERE {_OK}), 6) AS pixel_successful,
        nullif(count(*) FILTER (WHERE {_OK}), 0) AS successful_count
        FROM rounded GROUP BY model""",
    "failure_type": f"""WITH {EVENTS} SELECT record, model, CASE WHEN has_markup AND NOT has_render
        THEN 'render' WHEN NOT has_markup AND NOT has_render THEN 'generation' END AS failure
        FROM scored""",
    "failure_counts": f"WITH {EVENTS} SELECT model, {_FAILURES} FROM scored GROUP BY model",
    "failure_totals": f"""WITH {EVENTS} SELECT 'render' AS failure, count(*) AS count FROM scored
        WHERE has_markup AND NOT has_render UNION ALL SELECT 'generation', count(*) FROM scored
        WHERE NOT has_markup AND NOT has_render""",
    "distinct_models": f"WITH {EVENTS} SELECT DISTINCT model FROM scored",
    "incomplete_models": f"""WITH {EVENTS} SELECT run_time, model, count(*) AS count FROM scored
        GROUP BY run_time, model HAVING count(*) <> 67""",
    "success_rate": f"""WITH {EVENTS} SELECT model, count(*) FILTER (WHERE {_OK}) AS successful_count,
        count(*) AS count, round(count(*) FILTER (WHERE {_OK}) * 100 / count(*)::DOUBLE, 6)
          AS success_percent FROM scored GROUP BY model""",
    "summary": f"WITH {ROUNDED}, {_summary('rounded', 'model')} SELECT * FROM summary",
    "summary_by_run": f"""WITH {ROUNDED}, {_summary('rounded', 'run_time, model')}
        SELECT * FROM summary""",
    "kept_summary": f"WITH {ROUNDED}, {_summary('rounded', 'model')} SELECT * FROM summary",
    "kept_summary_by_run": f"""WITH {ROUNDED}, {_summary('rounded', 'run_time, model')}
        SELECT * FROM summary""",
    "leaderboard": f"""WITH {ROUNDED}, {_summary('rounded', 'model')} SELECT model, bleu_successful,
        successful_count FROM summary ORDER BY bleu_successful DESC NULLS LAST, model""",
    "chart_table": f"""WITH {ROUNDED}, {_summary('rounded', 'model')}
        SELECT model, 0 AS pos, 'bleu' AS metric, bleu AS value FROM summary
        UNION ALL SELECT model, 1, 'structural', structural FROM summary
        UNION ALL SELECT model, 2, 'pixel', pixel FROM summary""",
    "leaderboard_by_run": f"""WITH {ROUNDED}, {_summary('rounded', 'run_time, model')}
        SELECT run_time, model, bleu_successful, successful_count FROM summary""",
    "chart_table_by_run": f"""WITH {ROUNDED}, {_summary('rounded', 'run_time, model')}
        SELECT run_time, model, 0 AS pos, 'bleu' AS metric, bleu AS value FROM summary
        UNION ALL SELECT run_time, model, 1, 'structural', structural FROM summary
        UNION ALL SELECT run_time, model, 2, 'pixel', pixel FROM summary""",
    "comparison_manifest": f"WITH {_MANIFEST} SELECT * FROM manifest",
    "comparison_pivot": f"""WITH {_MANIFEST} SELECT row, record, {", ".join(
        f"max(status) FILTER (WHERE model = {_q(m)}) AS {m}" for m in ("target", *MODELS)
    )} FROM manifest GROUP BY row, record""",
    "grid_layout": f"""WITH {EXAMPLES} SELECT record, CAST(record // 8 AS INTEGER) AS row,
        CAST(record % 8 AS INTEGER) AS col, CAST((record % 8) * 288 AS INTEGER) AS x,
        CAST((record // 8) * 328 AS INTEGER) AS y, 2296 AS canvas_width, 1304 AS canvas_height
        FROM examples WHERE record < 32""",
}
