"""The queries as DuckDB SQL, written from what they mean and not from how the engine computes it."""

from __future__ import annotations

from linewright.functions.text import CLOSING_BRACKETS, COMBINING_E, GAP, OPENING_BRACKETS, TOKEN

_Q = "'"


def lit(s: str) -> str:
    return _Q + s.replace(_Q, _Q * 2) + _Q


def _among(values) -> str:
    return "(" + ", ".join(map(lit, values)) + ")"


_FOLD_FROM = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
_FOLD_TO = " || ".join(f"chr({i})" for i in [*range(1, 9), *range(14, 27)])


def _bytes_as_letters(c: str) -> str:
    """DuckDB's levenshtein counts bytes, so letters of two bytes become unused ones of one."""
    return f"translate({c}, '{_FOLD_FROM}', {_FOLD_TO})"


def _distance(a: str, b: str) -> str:
    return f"levenshtein({_bytes_as_letters(a)}, {_bytes_as_letters(b)})"


LINES = r"""
toks AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS t FROM documents WHERE text IS NOT NULL),
lines AS MATERIALIZED (
  SELECT 'd' || doc_id || '_' || i AS line_id, doc_id, i AS chunk, array_to_string(t[i * 8 + 1 : i * 8 + 8], ' ') AS gt
  FROM (SELECT doc_id, t, unnest(range(CAST(ceil(len(t) / 8.0) AS BIGINT)))::INT AS i FROM toks WHERE len(t) > 0)
),
triples AS MATERIALIZED (
  SELECT line_id, ocr, replace(replace(ocr, 'tb', 'th'), '<h', 'ch') AS cor, gt, doc_id, chunk
  FROM (SELECT *, CASE WHEN chunk % 4 = 0 THEN gt ELSE replace(replace(replace(replace(gt, 'th', 'tb'), 'ch', '<h'), 'nn', 'un'), 'en ', 'cn ') END AS ocr FROM lines)
)"""

TOKENS = rf"""
tokens AS MATERIALIZED (
  SELECT token, CASE WHEN token IN {_among(OPENING_BRACKETS)} THEN 'open' WHEN token IN {_among(CLOSING_BRACKETS)} THEN 'close'
    WHEN regexp_matches(token, '^[^\p{{L}}\p{{N}}]+$') AND token <> '—' THEN 'punct' ELSE 'word' END AS class
  FROM (SELECT unnest(regexp_extract_all(gt, {lit(TOKEN)})) AS token FROM lines WHERE length(gt) >= 3)
)"""

_MASK = r"CASE WHEN regexp_matches({0}, '^[0-9]|^\p{{Nd}}+$') THEN repeat('1', length({0})) ELSE {0} END"
_VARIANT = r"CASE WHEN regexp_matches({0}, '^\p{{Lu}}') THEN lower({0}) WHEN {0}[1] = 'ß' THEN 'Ss' || lower({0}[2:]) ELSE upper({0}[1]) || lower({0}[2:]) END"


def _decomposed(c: str) -> str:
    for umlaut, base in zip("äöüÄÖÜ", "aouAOU", strict=True):
        c = f"replace({c}, '{umlaut}', '{base}{COMBINING_E}')"
    return c


LEXICON = f"""
forms AS (SELECT class, token, {_MASK.format(_decomposed("token"))} AS form FROM tokens),
lexicon AS MATERIALIZED (
  SELECT class, form, CAST(count(*) AS BIGINT) AS cnt FROM (
    SELECT 'word' AS class, unnest(list_distinct([form, {_VARIANT.format("form")}])) AS form FROM forms WHERE class = 'word'
    UNION ALL SELECT class, token FROM forms WHERE class <> 'word') GROUP BY ALL
)"""

_WEIGHTED = "SELECT class, form, cnt, cnt / sum(cnt) OVER (PARTITION BY class) AS share FROM lexicon"
WEIGHTS = f", weights AS MATERIALIZED (SELECT class, form, -ln(share) AS weight FROM ({_WEIGHTED}) WHERE NOT (cnt <= 3 AND share < 2e-6))"
WITH_LEXICON = f"WITH RECURSIVE {LINES}, {TOKENS}, {LEXICON}"


def _grams(source: str, columns: str, max_n: int = 3) -> str:
    return f"SELECT *, unnest(range(1, least({max_n}, length(s) - pos) + 1))::INT AS n FROM (SELECT {columns}, unnest(range(length(s)))::INT AS pos, s FROM {source})"


def _counts(column: str) -> str:
    return f"SELECT substr(s, pos + 1, n) AS ngram, count(*) AS cnt FROM ({_grams(f'(SELECT {column} AS s FROM triples)', '1 AS one')}) GROUP BY ALL"


VOCABULARY = f"""
counts AS (SELECT ngram, CAST(sum(cnt) AS BIGINT) AS cnt FROM ({_counts("ocr")} UNION ALL {_counts("gt")}) GROUP BY ngram),
vocabulary AS MATERIALIZED (
  SELECT ngram, cnt, CAST(row_number() OVER (ORDER BY least(length(ngram), 2), CASE WHEN length(ngram) > 1 THEN -cnt END, ngram) - 1 AS INT) AS id FROM counts QUALIFY id < 1000
)"""


def _confusions(pairs: str, max_n: int = 3) -> str:
    """Place by place, the shorter side followed by gaps."""
    padded = f"(SELECT rpad(ocr, greatest(length(ocr), length(gt))::INT, '{GAP}') AS s, rpad(gt, greatest(length(ocr), length(gt))::INT, '{GAP}') AS g FROM {pairs} WHERE ocr <> '' AND gt <> '')"
    return f"SELECT n, substr(s, pos + 1, n) AS raw, substr(g, pos + 1, n) AS gt, count(*) AS cnt FROM ({_grams(padded, 'g', max_n)}) GROUP BY ALL"


def _probabilities(counts: str) -> str:
    idle = f"SELECT n, '{GAP}', '{GAP}', sum(cnt) - sum(cnt) FILTER (raw = '{GAP}') FROM {counts} GROUP BY n HAVING sum(cnt) FILTER (raw = '{GAP}') > 0"
    return f"SELECT n, raw, gt, cnt / sum(cnt) OVER (PARTITION BY n, raw) AS prob FROM (SELECT n, raw, gt, cnt FROM {counts} UNION ALL {idle})"


_BLANK = f"('{GAP}', ' ')"


def _letter(c: str) -> str:
    return rf"({c} = '{COMBINING_E}' OR regexp_matches({c}, '^[\p{{L}}\p{{N}}]$'))"


def _punctuation_edit(r: str, g: str) -> str:
    return f"NOT ({r} = {g} OR ({r} IN {_BLANK} AND {g} IN {_BLANK}) OR {_letter(g)} OR ({g} IN {_BLANK} AND {_letter(r)}))"


def _rules(probs: str, identity: bool = False, more: str = "true") -> str:
    inner = f"SELECT n, replace(raw, '{GAP}', '') AS raw, replace(gt, '{GAP}', '') AS gt, -ln(prob) AS weight FROM {probs} WHERE {more}"
    return f"SELECT * FROM ({inner}) WHERE weight <= 7.0 AND (raw <> '' OR gt <> '')" + ("" if identity else " AND raw <> gt")


CONFUSED = f", confused AS MATERIALIZED ({_confusions('triples')}), probs AS MATERIALIZED ({_probabilities('confused')})"
PUNCTUATED = f", punctuated AS (SELECT replace(ocr, ',', '.') AS ocr, gt FROM triples), confused AS MATERIALIZED ({_confusions('punctuated')}), probs AS MATERIALIZED ({_probabilities('confused')})"
TOKEN_PAIRS = f", token_pairs AS (SELECT token AS ocr, {_decomposed('token')} AS gt FROM tokens), confused AS MATERIALIZED ({_confusions('token_pairs')}), probs AS MATERIALIZED ({_probabilities('confused')})"
RULES = f", rules AS MATERIALIZED (SELECT raw, gt, min(weight) AS weight FROM ({_rules('probs')}) GROUP BY ALL)"

WINDOWS = """
, windows AS MATERIALIZED (
  SELECT line_id, len(t)::INT AS n_tokens, start, len, array_to_string(t[start + 1 : start + len], ' ') AS input FROM (
    SELECT *, unnest(range(1, least(2, len(t) - start) + 1))::INT AS len FROM (SELECT line_id, t, unnest(range(len(t)))::INT AS start FROM (SELECT line_id, string_split(ocr, ' ') AS t FROM triples)))
)"""


def _rewrites(inputs: str, max_errors: int) -> str:
    return f""", prices AS MATERIALIZED (SELECT raw, gt, CAST(round(weight * 1000000) AS BIGINT) AS price FROM rules WHERE round(weight * 1000000) <= 5000000),
    states AS (
      SELECT input, 0 AS pos, '' AS done, 0::BIGINT AS cost, 0 AS k FROM (SELECT DISTINCT input FROM {inputs})
      UNION ALL
      SELECT s.input, s.spot + length(p.raw)::INT, s.done || substr(s.input, s.pos + 1, s.spot - s.pos) || p.gt, s.cost + p.price, s.k + 1
      FROM (SELECT *, unnest(range(1, least(3, length(input) - spot) + 1))::INT AS n FROM (SELECT *, unnest(range(pos, length(input)))::INT AS spot FROM states WHERE k < {max_errors})) s
      JOIN prices p ON p.raw = substr(s.input, s.spot + 1, s.n) WHERE s.cost + p.price <= 5000000
    ),
    rewrites AS MATERIALIZED (SELECT input, done || substr(input, pos + 1) AS output, min(cost) AS cost FROM states GROUP BY ALL)"""


def _token_costs(tokens: str) -> str:
    return rf""", lex AS MATERIALIZED (SELECT class, form, CAST(round(weight * 1000000) AS BIGINT) AS c FROM weights),
    readings AS (
      SELECT token, substr(token, 1, o) AS open, substr(token, o + 1, length(token) - o - c - k) AS word, substr(token, length(token) - c - k + 1, k) AS punct, substr(token, length(token) - c + 1, c) AS close
      FROM (SELECT DISTINCT token FROM {tokens} WHERE token <> ''), (VALUES (0), (1)) a(o), (VALUES (0), (1)) b(c), (SELECT unnest(range(coalesce((SELECT max(length(form)) FROM lex WHERE class = 'punct'), 0) + 1)) AS k)
      WHERE length(token) - o - c - k >= 1 AND (o = 0 OR token[1] IN {_among(OPENING_BRACKETS)}) AND (c = 0 OR token[-1] IN {_among(CLOSING_BRACKETS)})
    ),
    token_costs AS MATERIALIZED (
      SELECT token, min(w.c + coalesce(o.c, 0) + coalesce(p.c, 0) + coalesce(e.c, 0)) AS cost
      FROM readings r JOIN lex w ON w.class = 'word' AND w.form = r.word LEFT JOIN lex o ON o.class = 'open' AND o.form = r.open
      LEFT JOIN lex p ON p.class = 'punct' AND p.form = r.punct LEFT JOIN lex e ON e.class = 'close' AND e.form = r.close
      WHERE (r.open = '' OR o.c IS NOT NULL) AND (r.punct = '' OR p.c IS NOT NULL AND regexp_matches(r.punct, '^[^\p{{L}}\p{{N}}]+$') AND r.punct <> '—') AND (r.close = '' OR e.c IS NOT NULL) GROUP BY token
    )"""


PRUNED = (
    _rewrites("windows", 1)
    + ", candidates AS MATERIALIZED (SELECT *, string_split(output, ' ') AS t FROM rewrites WHERE len(string_split(output, ' ')) <= 3), candidate_tokens AS (SELECT DISTINCT unnest(t) AS token FROM candidates)"
    + _token_costs("candidate_tokens")
    + """, known AS (
      SELECT input, output, min(cost) + CAST(sum(token_cost) AS BIGINT) AS cost FROM (SELECT c.input, c.output, c.cost, len(c.t) AS n, x.cost AS token_cost FROM (SELECT *, unnest(t) AS token FROM candidates) c JOIN token_costs x USING (token))
      GROUP BY input, output, n HAVING count(*) = n
    ), pruned AS MATERIALIZED (SELECT input, output, cost FROM known QUALIFY cost <= min(cost) OVER (PARTITION BY input) + 5000000)"""
)
UNCHANGED = PRUNED.replace(_rewrites("windows", 1), ", rewrites AS MATERIALIZED (SELECT DISTINCT input, input AS output, 0::BIGINT AS cost FROM windows)")
_SCORED = """, scored AS MATERIALIZED (
  SELECT input, output, cost FROM pruned
  UNION ALL SELECT input, input, CAST(round(1.5 * (length(input) + 2) * 1000000) AS BIGINT) FROM (SELECT DISTINCT input FROM windows WHERE NOT contains(input, ' '))
)"""
SCORED = PRUNED + _SCORED
DECODER = f"{WITH_LEXICON}{WEIGHTS}{CONFUSED}{RULES}{WINDOWS}"
_PATHS = """, best AS MATERIALIZED (SELECT line_id, n_tokens, start, len, b.cost AS cost, b.output AS output FROM windows JOIN (SELECT input, min({'cost': cost, 'output': output}) AS b FROM scored GROUP BY input) USING (input)),
steps AS MATERIALIZED (
  SELECT line_id, n_tokens, spot, max(cost) FILTER (len = 1) AS c1, max(output) FILTER (len = 1) AS o1, max(cost) FILTER (len = 2) AS c2, max(output) FILTER (len = 2) AS o2 FROM (SELECT *, start + len AS spot FROM best) GROUP BY line_id, n_tokens, spot
),
ways AS (
  SELECT line_id, 0 AS spot, {'cost': 0::BIGINT, 'output': ''} AS p1, NULL::STRUCT(cost BIGINT, output VARCHAR) AS p2, max(n_tokens) AS n FROM windows GROUP BY line_id
  UNION ALL
  SELECT w.line_id, w.spot + 1, list_min(list_filter([
      CASE WHEN c1 IS NOT NULL AND p1.cost IS NOT NULL THEN {'cost': p1.cost + c1, 'output': p1.output || CASE WHEN w.spot > 0 THEN ' ' ELSE '' END || o1} END,
      CASE WHEN c2 IS NOT NULL AND p2.cost IS NOT NULL THEN {'cost': p2.cost + c2, 'output': p2.output || CASE WHEN w.spot > 1 THEN ' ' ELSE '' END || o2} END], lambda x: x IS NOT NULL)), p1, n
  FROM ways w LEFT JOIN steps s ON s.line_id = w.line_id AND s.spot = w.spot + 1 WHERE w.spot < w.n
),
paths AS MATERIALIZED (SELECT line_id, p1.output AS output, p1.cost / 1000000.0::DOUBLE AS weight FROM ways WHERE spot = n)"""

PATHS = SCORED + _PATHS
LEXICON_ONLY = f"{WITH_LEXICON}{WEIGHTS}{WINDOWS}{UNCHANGED}{_SCORED}{_PATHS}"


def _bigrams(column: str) -> str:
    return f"SELECT substr(s, pos + 1, 1) AS x, substr(s, pos + 2, 1) AS y, count(*)::DOUBLE AS p FROM (SELECT s, unnest(range(length(s) - 1)) AS pos FROM (SELECT {column} AS s FROM triples)) GROUP BY ALL"


def _normal(rows: str) -> str:
    return f"SELECT x, y, p / sum(p) OVER (PARTITION BY x) AS p FROM ({rows})"


WITH = f"WITH RECURSIVE {LINES}"
_SPACE = r"[\s\pZ\x0b\x1c-\x1f\x85]"
_EDITS = f"SELECT line_id, {_distance('ocr', 'gt')} AS edits_ocr, {_distance('cor', 'gt')} AS edits_cor, length(gt) AS len_gt FROM triples"
_WORDS = r"""WITH parts AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
texts AS (SELECT doc_id AS page_id, CAST(line // 20 AS INT) AS region, line, array_to_string(list_filter(string_split_regex(l, '\s+'), lambda x: x <> ''), ' ') AS s FROM parts)
SELECT page_id, region, string_agg(s, chr(10) ORDER BY line) AS text FROM texts GROUP BY ALL"""

ORACLE_SQL: dict[str, str] = {
    "eval_cer_levenshtein": f"{WITH} SELECT CAST(sum(edits_ocr) AS BIGINT) AS edits_ocr, CAST(sum(len_gt) AS BIGINT) AS len_ocr, CAST(sum(edits_cor) AS BIGINT) AS edits_cor, CAST(sum(len_gt) AS BIGINT) AS len_cor, round(sum(edits_ocr) / sum(len_gt), 6) AS cer_ocr, round(sum(edits_cor) / sum(len_gt), 6) AS cer_cor FROM ({_EDITS})",
    "eval_cer_per_line": f"{WITH} SELECT *, round(edits_ocr / len_gt, 6) AS cer_ocr, round(edits_cor / len_gt, 6) AS cer_cor FROM ({_EDITS})",
    "eval_rates_from_counts": f"""{WITH}, c AS (SELECT count(*) FILTER (ocr <> cor AND cor = gt) AS tp, count(*) FILTER (ocr = cor AND cor = gt) AS tn, count(*) FILTER (ocr <> cor AND cor <> gt) AS fp, count(*) FILTER (ocr = cor AND cor <> gt) AS fn FROM triples),
      r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 1.0) AS pr, coalesce(tp / nullif(tp + fn, 0), 1.0) AS re, coalesce(fp / nullif(fp + tn, 0), 0.0) AS fr FROM c)
      SELECT tp, tn, fp, fn, round(pr, 6) AS precision, round(re, 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(re, 6) AS tpr, round(fr, 6) AS fpr, round(0.5 * re * fr + re * (1 - fr) + 0.5 * (1 - re) * (1 - fr), 6) AS auc FROM r""",
    "eval_missing_keys": f"{WITH} SELECT line_id FROM triples WHERE ocr = gt",
    "pairs_inner_join": f"{WITH} SELECT line_id, ocr, gt FROM triples WHERE ocr <> gt",
    "pairs_key_intersect": f"{WITH} SELECT line_id FROM triples WHERE ocr <> gt",
    "pairs_last_wins": f"{WITH} SELECT doc_id, max_by(gt, chunk) AS gt FROM lines GROUP BY doc_id",
    "pairs_sorted": f"{WITH} SELECT line_id, ocr, gt FROM triples ORDER BY line_id",
    "tsv_scan": r"""SELECT p[1] AS key, p[2] AS value FROM (SELECT string_split(regexp_replace('c' || conv_id || '_' || turn || chr(9) || coalesce(text, '') || chr(9) || coalesce(role, ''), '\s+$', ''), chr(9)) AS p FROM conversations) WHERE len(p) >= 2""",
    "wordlist_scan": "SELECT lang AS word, max_by(n_chars, doc_id) AS freq FROM documents WHERE lang IS NOT NULL AND n_chars IS NOT NULL GROUP BY lang",
    "lexicon_source_union": f"{WITH} SELECT line, count(*) AS cnt FROM (SELECT gt AS line FROM triples UNION ALL SELECT text FROM benchmark) GROUP BY line",
    "tokens_whitespace": f"{WITH} SELECT doc_id, generate_subscripts(t, 1)::INT - 1 AS pos, unnest(t) AS token FROM toks",
    "tokens_short_line_filter": "SELECT doc_id, count(*) AS n_lines, count(*) FILTER (length(line) >= 3) AS n_kept FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id",
    "token_class": f"{WITH}, {TOKENS} SELECT class, count(*) AS cnt FROM tokens GROUP BY class",
    "token_problems": f"""{WITH}, x AS (SELECT generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS t FROM toks), y AS (SELECT CASE WHEN pos % 3 = 0 THEN t || '—' ELSE '—' || t END AS token FROM x)
      SELECT token, count(*) AS cnt FROM y WHERE trim(token) <> token OR (length(token) > 1 AND ends_with(token, '—')) GROUP BY token""",
    "round_trip_pairs": f"{WITH} SELECT line_id, gt AS text FROM triples",
    "round_trip_keyed": "SELECT 'c' || conv_id AS line_id, 't' || max(turn) AS text FROM conversations GROUP BY conv_id",
    "round_trip_files": f"SELECT * FROM (SELECT 'd' || doc_id AS line_id, regexp_replace(regexp_replace(l, '^{_SPACE}+', ''), '{_SPACE}+$', '') AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)) WHERE text <> ''",
    "round_trip_training_pairs": f"{WITH} SELECT ocr, gt FROM triples",
    "round_trip_lines": f"SELECT line, count(*) AS cnt FROM (SELECT regexp_replace(unnest(string_split(coalesce(text, ''), chr(10))), '{_SPACE}+$', '') AS line FROM documents) GROUP BY line",
    "round_trip_frequencies": f"{WITH}, {TOKENS}{TOKEN_PAIRS} SELECT raw, gt, round(prob, 6) AS prob FROM probs WHERE n = 1",
    "round_trip_ngrams": f"{WITH}, {VOCABULARY} SELECT ngram, id FROM vocabulary",
    "word_windows": r"""WITH l AS (SELECT doc_id AS page_id, generate_subscripts(string_split(text, chr(10)), 1)::INT - 1 AS line_no, unnest(string_split(text, chr(10))) AS l FROM documents),
      w AS (SELECT page_id, line_no, list_filter(string_split_regex(l, '\s+'), lambda x: x <> '') AS t FROM l), n AS (SELECT *, unnest(range(len(t)))::INT AS start FROM w WHERE len(t) > 0),
      r AS (SELECT *, unnest(range(1, least(2, len(t) - start) + 1))::INT AS len FROM n)
      SELECT page_id, line_no, len(t)::INT AS n_tokens, start, len, array_to_string(t[start + 1 : start + len], ' ') AS input, CASE len WHEN 1 THEN 'w' || start ELSE 'w' || start || ',w' || (start + 1) END AS ids FROM r""",
    "number_mask": f"{WITH}, {TOKENS} SELECT DISTINCT token, {_MASK.format('token')} AS out FROM tokens",
    "umlaut_decompose": f"{WITH}, {TOKENS} SELECT DISTINCT token, {_decomposed('token')} AS out FROM tokens",
    "case_variant": f"{WITH}, {TOKENS} SELECT DISTINCT token, {_VARIANT.format('token')} AS out FROM tokens",
    "escape_automaton": r"SELECT page_id, replace(replace(replace(html, '\', '\\'), '[', '\['), ']', '\]') AS out FROM pages",
    "strip_unicode": r"SELECT doc_id, length(regexp_replace(regexp_replace(text, '^[\s\pZ\x0b\x1c-\x1f\x85]+', ''), '[\s\pZ\x0b\x1c-\x1f\x85]+$', ''))::INT AS stripped, length(regexp_replace(text, '[\s\pZ\x0b\x1c-\x1f\x85]+$', ''))::INT AS right_stripped FROM documents",
    "lexicon_counts": f"{WITH_LEXICON} SELECT * FROM lexicon",
    "lexicon_with_word_list": f"{WITH_LEXICON} SELECT class, form, CAST(sum(cnt) AS BIGINT) AS cnt FROM (SELECT * FROM lexicon UNION ALL SELECT 'word', source, sum(n_chars) FROM documents WHERE source IS NOT NULL AND n_chars IS NOT NULL GROUP BY source) GROUP BY ALL",
    "lexicon_weights": f"{WITH_LEXICON}{WEIGHTS} SELECT class, form, round(weight, 6) AS weight FROM weights",
    "lexicon_weights_added_cost": f"{WITH_LEXICON}{WEIGHTS} SELECT class, form, round(weight + CASE class WHEN 'word' THEN 2.0 ELSE 0.0 END, 6) AS weight FROM weights",
    "lexicon_rare_pruned": f"{WITH_LEXICON} SELECT class, form, round(-ln(share), 6) AS weight FROM ({_WEIGHTED}) WHERE NOT (cnt <= 3 AND share < 1e-4)",
    "lexicon_unweighted": f"{WITH_LEXICON}{WEIGHTS} SELECT class, form, 0.0::DOUBLE AS weight FROM weights",
    "lexicon_digits": f"{WITH_LEXICON}{WEIGHTS} SELECT class, CASE WHEN class = 'word' AND form = '1' THEN unnest(range(10))::VARCHAR ELSE form END AS form, round(weight, 6) AS weight FROM weights WHERE class = 'word' AND form = '1' UNION ALL SELECT class, form, round(weight, 6) FROM weights WHERE NOT (class = 'word' AND form = '1')",
    "ngram_counts": f"{WITH} {_counts('gt')}",
    "ngram_merge": f"{WITH}, {VOCABULARY} SELECT * FROM counts",
    "ngram_topk": f"{WITH}, {VOCABULARY} SELECT * FROM vocabulary",
    "ngram_ids": f"{WITH}, {VOCABULARY} SELECT line_id, n, count(id) AS known, CAST(sum((pos + 1) * coalesce(id, -1)) AS BIGINT) AS id_sum FROM ({_grams('(SELECT line_id, ocr AS s FROM triples)', 'line_id')}) g LEFT JOIN vocabulary v ON v.ngram = substr(s, pos + 1, n) GROUP BY line_id, n",
    "quick_ratio_filter": f"""{WITH}, r AS (SELECT line_id, gt, 2.0 * list_sum(list_transform(list_distinct(string_split(ocr, '')), lambda c: least(length(ocr) - length(replace(ocr, c, '')), length(gt) - length(replace(gt, c, ''))))) / (length(ocr) + length(gt)) AS ratio FROM triples)
      SELECT line_id, round(ratio, 6)::DOUBLE AS ratio, ratio < 0.1 AND length(gt) > 5 AS skipped FROM r""",
    "align_invariants": f"{WITH} SELECT line_id, ocr, gt FROM triples",
    "confusion_counts_positional": f"{WITH}{CONFUSED} SELECT * FROM confused",
    "confusion_probs": f"{WITH}{CONFUSED} SELECT n, raw, gt, round(prob, 6) AS prob FROM probs",
    "confusion_gap_probs": f"{WITH}, {TOKENS}{TOKEN_PAIRS} SELECT n, raw, gt, round(prob, 6) AS prob FROM probs",
    "frequency_list": f"{WITH}, {TOKENS}{TOKEN_PAIRS} SELECT replace(raw, '{GAP}', '□') AS raw, replace(gt, '{GAP}', '□') AS gt, round(prob, 6) AS prob FROM probs WHERE n = 1",
    "confusion_rules": f"{WITH}{CONFUSED} SELECT n, raw, gt, round(weight, 6) AS weight FROM ({_rules('probs')})",
    "confusion_rules_gaps": f"{WITH}, {TOKENS}{TOKEN_PAIRS} SELECT n, raw, gt, round(weight, 6) AS weight FROM ({_rules('probs', True)})",
    "punctuation_edits": f"{WITH}, {TOKENS}{TOKEN_PAIRS} SELECT DISTINCT raw, gt, {_punctuation_edit('raw', 'gt')} AS edit FROM (SELECT raw, gt FROM confused WHERE n = 1 UNION ALL SELECT raw, gt FROM ({_confusions('triples', 1)}))",
    "punctuation_rules": f"{WITH}{PUNCTUATED} SELECT n, raw, gt, round(weight, 6) AS weight FROM ({_rules('probs')})",
    "punctuation_filter": f"{WITH}{PUNCTUATED} SELECT n, raw, gt, round(weight, 6) AS weight FROM ({_rules('probs', more='len(list_filter(range(1, n + 1), lambda i: ' + _punctuation_edit('raw[i]', 'gt[i]') + ')) = 0')})",
    "rules_combined": f"{WITH}{CONFUSED}{RULES} SELECT raw, gt, round(weight, 6) AS weight FROM rules",
    "rules_alphabet": f"{WITH}{CONFUSED}{RULES} SELECT DISTINCT unnest(string_split(raw || gt, '')) AS symbol FROM rules",
    "row_normalise": f"{WITH} SELECT x, y, round(p, 6) AS p FROM ({_normal(_bigrams('ocr'))})",
    "m_step": f"{WITH}, a AS ({_normal(_bigrams('ocr'))}), b AS ({_normal(_bigrams('gt'))}) SELECT x, y, round(p, 6) AS p FROM (SELECT * FROM a WHERE x <> 'e' UNION ALL SELECT * FROM b WHERE x NOT IN (SELECT x FROM a WHERE x <> 'e'))",
    "kl_divergence": f"{WITH}, o AS ({_normal(_bigrams('gt'))}), n AS ({_normal(_bigrams('ocr'))}) SELECT round(sum(n.p * (ln(n.p) - ln(o.p))) / (SELECT count(DISTINCT x) FROM o), 6) AS kl FROM n JOIN o USING (x, y)",
    "matrix_mappings": f"{WITH} SELECT x, y, round(-ln(p), 6) AS weight FROM ({_normal(_bigrams('ocr'))}) WHERE -ln(p) < 5.0",
    "windows_sliding": f"{WITH}{WINDOWS} SELECT line_id, start, len, input FROM windows",
    "window_candidates": f"{DECODER}{_rewrites('windows', 1)} SELECT * FROM rewrites",
    "window_candidates_two_edits": f"{DECODER}{_rewrites('(SELECT input FROM windows WHERE len = 1)', 2)} SELECT * FROM rewrites",
    "token_costs": f"{WITH_LEXICON}{WEIGHTS}, own AS (SELECT DISTINCT unnest(string_split(ocr, ' ')) AS token FROM triples){_token_costs('own')} SELECT * FROM token_costs",
    "window_pruned": f"{DECODER}{PRUNED} SELECT * FROM pruned",
    "window_with_rejection": f"{DECODER}{SCORED} SELECT input, output, cost / 1000000.0::DOUBLE AS weight FROM scored",
    "lattice_edges": f"{DECODER}{SCORED} SELECT line_id, start AS src, start + len AS dst, n, b.output AS best, round(pow(2.0, -(b.cost / 1000000.0::DOUBLE)), 6) AS conf FROM windows JOIN (SELECT input, count(*) AS n, min({{'cost': cost, 'output': output}}) AS b FROM scored GROUP BY input) USING (input)",
    "lattice_best_path": f"{DECODER}{PATHS} SELECT * FROM paths",
    "correct_lines_one_edit": f"{DECODER}{PATHS} SELECT line_id, output FROM paths",
    "correct_lines_lexicon_only": f"{LEXICON_ONLY} SELECT line_id, output FROM paths",
    "text_rollup": _WORDS,
    "text_rollup_glyphs": _WORDS,
    "majority_vote": "SELECT source, lang FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM documents WHERE lang IS NOT NULL GROUP BY source, lang) WHERE r = 1",
    "merged_words": """WITH c AS (SELECT source, CAST(doc_id // 10 AS BIGINT) AS run, lang, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY ALL),
      l AS (SELECT source, run, lang FROM c WHERE lang IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source, run ORDER BY n DESC, lang) = 1)
      SELECT d.source, d.run, ids, lang FROM (SELECT source, CAST(doc_id // 10 AS BIGINT) AS run, string_agg('w' || doc_id, ',' ORDER BY doc_id) AS ids FROM documents GROUP BY ALL) d LEFT JOIN l ON d.source IS NOT DISTINCT FROM l.source AND d.run = l.run""",
    "context_decade": "SELECT doc_id, CASE WHEN lang = 'en' THEN CAST(ceil(n_chars / 10.0) AS BIGINT) ELSE 0 END AS context FROM documents",
    "perplexity": r"""WITH RECURSIVE """ + LINES + r""", c AS (SELECT line_id, gt, ch, count(*) AS k FROM (SELECT line_id, gt, unnest(string_split(gt, '')) AS ch FROM lines) GROUP BY ALL),
      e AS (SELECT line_id, sum(-k * log2(k / length(gt))) AS entropy, min(length(gt)) AS n, min(len(string_split(gt, ' '))) AS m FROM c GROUP BY line_id)
      SELECT line_id, round(pow(2.0, -entropy / n), 6) AS avg, round(pow(2.0, entropy / n), 6) AS char_ppl, CASE WHEN isfinite(pow(2.0, entropy / m)) THEN printf('%.5e', pow(2.0, entropy / m)) END AS element_ppl FROM e""",
}
