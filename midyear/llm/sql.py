"""DuckDB SQL of the queries that SQL can express.

Not among them: counts of a byte-pair vocabulary (1), sampled segmentations (4, pipeline),
draws by XXH64 (5), XXH64 fingerprints and their components (7). Tests hold these
against plain Python.
"""

from .codebooks import ENTRIES, PARTS, ROUNDS
from .quality import ERROR, HARM, MIN_WORDS, MOST_REPEATED_PERCENT, RISK, RULES

BLANK = r"[\x20\x09-\x0D]"

EXACT = rf"""
WITH texts AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '{BLANK}', '', 'g') AS norm
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER best = 1 AS kept, sha256(norm) AS text_sha256
FROM texts WINDOW best AS (PARTITION BY norm ORDER BY points DESC, doc_id)
"""

WARC = """
WITH payloads AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
marked AS (
  SELECT page_id, payload, octet_length(payload) AS payload_bytes,
         CASE WHEN octet_length(payload) >= 1000 THEN max(page_id) OVER (PARTITION BY payload) ELSE page_id END AS first_id
  FROM payloads
)
SELECT page_id, payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM marked
"""

SUBSTRING = rf"""
WITH split AS (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '{BLANK}+') AS parts FROM documents),
numbered AS (SELECT doc_id, unnest(parts) AS word, generate_subscripts(parts, 1) AS place FROM split),
words AS (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS i FROM numbered WHERE word <> ''),
texts AS (SELECT doc_id, list(word ORDER BY i) AS ws FROM words GROUP BY doc_id),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM texts),
windows AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS window_key FROM starts),
counted AS (SELECT doc_id, i, count(*) OVER (PARTITION BY window_key) > 1 AS again FROM windows),
marked AS (
  SELECT words.doc_id, word, words.i,
         max(coalesce(again, false)::int) OVER (PARTITION BY words.doc_id ORDER BY words.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) = 1 AS gone
  FROM words LEFT JOIN counted ON words.doc_id = counted.doc_id AND words.i = counted.i
),
totals AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept
  FROM marked GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN totals USING (doc_id)
"""

LINES = """
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM split),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
  FROM lines
),
frequent AS (SELECT line_key FROM keyed WHERE line_key <> '' GROUP BY line_key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT doc_id, line, i, frequent.line_key IS NOT NULL AS gone FROM keyed LEFT JOIN frequent USING (line_key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

# Bytes as pairs of hexadecimal digits; a string of 200 bytes is known by its MD5.
BYTES = """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS digits FROM documents),
starts AS (SELECT doc_id, digits, unnest(range(1, len(digits) // 2 - 198)) AS i FROM texts),
keys AS (SELECT doc_id, i, md5_number(substr(digits, 2 * i - 1, 400)) AS k FROM starts),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM keys) WHERE n > 1),
jumps AS (SELECT *, coalesce(i > lag(i) OVER w + 200, true) AS fresh FROM again WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
runs AS (
  SELECT doc_id, min(i) AS first, max(i) + 199 AS last
  FROM (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM jumps) GROUP BY doc_id, run
),
gaps AS (
  SELECT doc_id, first, last, coalesce(lag(last) OVER (PARTITION BY doc_id ORDER BY first), 0) + 1 AS kept_from FROM runs
),
cut AS (
  SELECT doc_id, sum(last - first + 1) AS n_removed, count(*) AS n_spans, max(last) AS last,
         string_agg(substr(digits, 2 * kept_from - 1, 2 * (first - kept_from)), '' ORDER BY first) AS kept
  FROM gaps JOIN texts USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, len(digits) // 2 AS n_bytes, coalesce(n_removed, 0)::bigint AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(digits, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM texts LEFT JOIN cut USING (doc_id)
"""

_values = ", ".join(f"('{rule}', {cut}::double)" for rule, cuts in RULES.items() for cut in cuts)
QUALITY = rf"""
WITH base AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
split AS (
  SELECT *, list_filter(regexp_split_to_array(t, '{BLANK}+'), lambda w: w <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{BLANK}', '', 'g') <> '') AS ls FROM base
),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM split),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS k FROM starts),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id),
counts AS (
  SELECT doc_id, lang, md5(regexp_replace(t, '{BLANK}', '', 'g')) AS norm, len(ws) AS n_words, length(regexp_replace(t, '{BLANK}', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words, len(ls) AS n_lines
  FROM split LEFT JOIN covered USING (doc_id)
),
measured AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed FROM counts
),
scored AS (
  SELECT doc_id, lang, base_failed, 'symbols_per_word' AS rule, n_symbols / greatest(n_words, 1) AS v FROM measured
  UNION ALL SELECT doc_id, lang, base_failed, 'repeated_word_share', n_repeat_words / greatest(n_words, 1) FROM measured
  UNION ALL SELECT doc_id, lang, base_failed, 'repeated_line_share', n_dup_lines / greatest(n_lines, 1) FROM measured
  UNION ALL SELECT doc_id, lang, base_failed, 'chars_per_word', word_chars / greatest(n_words, 1) FROM measured
),
clear AS (
  SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id
  HAVING min(quality) = max(quality) AND count(*) = count(quality)
),
samples AS (
  SELECT lang, norm, min(doc_id) AS doc_id, min(quality) AS quality FROM measured JOIN clear USING (doc_id) WHERE NOT base_failed
  GROUP BY lang, norm HAVING min(quality) = max(quality)
),
holdout AS (SELECT s.lang, rule, v, quality FROM scored s JOIN samples USING (doc_id)),
tests AS (
  SELECT lang, rule, cutoff, count(*) FILTER (quality = 1) AS n, count(*) FILTER (quality = 1 AND v > cutoff) AS lost,
         count(*) FILTER (quality = 0 AND v > cutoff) AS caught
  FROM holdout JOIN (VALUES {_values}) c(rule, cutoff) USING (rule) GROUP BY lang, rule, cutoff
),
certified AS (
  SELECT *, caught - {HARM} * lost AS gain FROM tests
  WHERE caught > {HARM} * lost AND lost <= n * {RISK / len(RULES)} AND list_sum(list_transform(range(0, lost + 1), lambda k:
      exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({RISK / len(RULES)}) + (n - k) * ln(1 - {RISK / len(RULES)}))))
    <= {ERROR / len(RULES)} / (SELECT count(*) FROM (SELECT DISTINCT lang FROM holdout))
),
chosen AS (
  SELECT lang, rule, cutoff FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, rule ORDER BY gain DESC, cutoff DESC) AS r FROM certified) WHERE r = 1
),
rejected AS (
  SELECT DISTINCT s.doc_id FROM scored s JOIN chosen c ON s.rule = c.rule AND s.lang IS NOT DISTINCT FROM c.lang WHERE v > cutoff
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rejected) AS kept
FROM measured
"""

# Rows are numbered, since ids need not be unique. Inner products of whole doubles are exact.
VECTORS = """
SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label,
       list_transform(embedding, lambda x: floor({scale} * x::double)) AS v
FROM embeddings WHERE embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))), true)
"""

TOP_K = f"""
WITH vectors AS MATERIALIZED ({VECTORS.format(scale=1024)}),
scored AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint AS score, c.rid AS other
  FROM vectors q JOIN vectors c ON q.vec_id % 100 = 0 AND c.vec_id IS NOT NULL AND c.rid <> q.rid
)
SELECT query_id, rank::int AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id, other) AS rank FROM scored) WHERE rank <= 10
"""

NEGATIVES = f"""
WITH vectors AS MATERIALIZED (
  SELECT rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, v
  FROM ({VECTORS.format(scale=256)}) WHERE label IS NOT NULL AND vec_id IS NOT NULL
),
scored AS MATERIALIZED (
  SELECT a.rid AS anchor, a.vec_id AS anchor_id, c.rid AS other, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::bigint AS score
  FROM vectors a JOIN vectors c ON a.vec_id % 100 = 0 AND c.rid <> a.rid
),
positives AS (
  SELECT anchor, anchor_id, other, vec_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, other) AS r FROM scored WHERE same) WHERE r <= 5
),
negatives AS (
  SELECT p.anchor, p.other, p.anchor_id, p.positive_id, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.vec_id, n.other) AS rank
  FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same AND 100 * n.score BETWEEN 30 * p.positive_score AND 90 * p.positive_score
)
SELECT anchor_id, positive_id, rank::int AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 10
"""


def _round(i: int) -> str:
    """Assignment to the codebooks after i rounds, and the codebooks after one more."""
    return f"""
near{i} AS MATERIALIZED (
  SELECT rid, p, min({{'d': aa - 2 * list_dot_product(a, b) + bb, 'e': entry}}) AS best FROM parts JOIN book{i} USING (p) GROUP BY rid, p
),
means{i} AS (
  SELECT p, entry, list(m ORDER BY j) AS b FROM (
    SELECT p, best.e AS entry, j, floor(sum(a[j]) / count(*)) AS m
    FROM near{i} JOIN parts USING (rid, p), (SELECT unnest(range(1, {WIDTH} + 1)) AS j) GROUP BY ALL) GROUP BY p, entry
),
book{i + 1} AS MATERIALIZED (
  SELECT p, entry, coalesce(m.b, o.b) AS b, list_dot_product(coalesce(m.b, o.b), coalesce(m.b, o.b)) AS bb
  FROM book{i} o LEFT JOIN means{i} m USING (p, entry)
),"""


WIDTH = f"(SELECT len(v) // {PARTS} FROM vectors LIMIT 1)"
CODES = f"""
WITH vectors AS MATERIALIZED ({VECTORS.format(scale=1024)}),
cut AS (SELECT rid, vec_id, label, p, v[p * {WIDTH} + 1:(p + 1) * {WIDTH}] AS a FROM vectors, (SELECT unnest(range({PARTS})) AS p)),
parts AS MATERIALIZED (SELECT *, list_dot_product(a, a) AS aa FROM cut),
book0 AS MATERIALIZED (SELECT p, rid - 1 AS entry, a AS b, aa AS bb FROM parts WHERE rid <= {ENTRIES}),
{"".join(_round(i) for i in range(ROUNDS))}
near{ROUNDS} AS MATERIALIZED (
  SELECT rid, p, min({{'d': aa - 2 * list_dot_product(a, b) + bb, 'e': entry}}) AS best FROM parts JOIN book{ROUNDS} USING (p) GROUP BY rid, p
),
coded AS (
  SELECT rid, string_agg(printf('%02x', best.e::int), '' ORDER BY p) AS code, sum(best.d)::bigint AS error FROM near{ROUNDS} GROUP BY rid
),
numbers AS (SELECT p, entry, unnest(b) AS x, generate_subscripts(b, 1) AS j FROM book{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::bigint AS label_error,
       (SELECT sha256(string_agg(x::bigint::varchar, ',' ORDER BY p, entry, j)) FROM numbers) AS codebooks_sha256
FROM vectors JOIN coded USING (rid)
"""

ORACLE = {
    "op11_exact_topk": TOP_K,
    "op12_hard_negatives": NEGATIVES,
    "op13_vector_codes": CODES,
    "op2_exact_dedup": EXACT,
    "op3_suffix_array_dedup": BYTES,
    "op6_warc": WARC,
    "op8_substring_dedup": SUBSTRING,
    "op9_quality_rules": QUALITY,
    "op10_line_dedup": LINES,
}
