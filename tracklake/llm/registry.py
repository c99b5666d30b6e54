"""Queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracklake.llm.classifier import op7_quality
from tracklake.llm.conversations import op13_conversations
from tracklake.llm.covertree import op12_embeddings
from tracklake.llm.decontaminate import op1_benchmark
from tracklake.llm.lengths import op5_token_counts
from tracklake.llm.lexical import op11_ranked_search
from tracklake.llm.lines import op8_line_dedup
from tracklake.llm.pieces import op4_pieces
from tracklake.llm.rules import op2_quality_rules
from tracklake.llm.secrets import op6_secrets
from tracklake.llm.simhash import op3_simhash
from tracklake.llm.substring import op9_substring_dedup
from tracklake.llm.suffixes import op10_suffix_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark": op1_benchmark,
    "op2_quality_rules": op2_quality_rules,
    "op3_simhash": op3_simhash,
    "op4_pieces": op4_pieces,
    "op5_token_counts": op5_token_counts,
    "op6_secrets": op6_secrets,
    "op7_quality": op7_quality,
    "op8_line_dedup": op8_line_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_ranked_search": op11_ranked_search,
    "op12_embeddings": op12_embeddings,
    "op13_conversations": op13_conversations,
}

#: SQL states these on whole tables; the others need a hash, a tokenizer, byte offsets or a fitted model that SQL
#: lacks, or are far too slow there, and are tested against brute force, round trips or held-out rows.
ORACLES: dict[str, str] = {
    "op1_benchmark": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
pat AS (SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[i : i + 9], ' ') AS p FROM b, unnest(range(1, greatest(1, len(w) - 9) + 1)) t(i) WHERE len(w) > 0),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
ahead AS (SELECT doc_id, j, list(word) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS l FROM words),
tried AS MATERIALIZED (SELECT a.doc_id, a.j, s.m, array_to_string(a.l[1 : s.m], ' ') AS p FROM ahead a JOIN (SELECT DISTINCT m FROM pat) s ON len(a.l) >= s.m),
hits AS (SELECT doc_id, j, m, item FROM tried JOIN pat USING (m, p)),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM hits, unnest(range(j, j + m)) t(k) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op9_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j, len(w) AS n FROM d),
win AS (SELECT doc_id, j, n, sha256(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) AS h FROM words),
first AS (SELECT h, min(doc_id) AS least FROM win WHERE j + 49 <= n GROUP BY h),
hit AS (SELECT win.doc_id, win.j FROM win JOIN first USING (h) WHERE win.j + 49 <= win.n AND first.least < win.doc_id),
marked AS (SELECT words.*, max(hit.j) OVER (PARTITION BY words.doc_id ORDER BY words.j ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM words LEFT JOIN hit ON hit.doc_id = words.doc_id AND hit.j = words.j),
runs AS (SELECT *, CASE WHEN gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY j), false) THEN 1 ELSE 0 END AS opens FROM marked),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY j) FILTER (NOT gone), '') AS text, sum(opens) AS n_spans FROM runs GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans FROM d LEFT JOIN kept USING (doc_id)""",
    "op10_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
p AS (SELECT doc_id, CAST(length(hx) // 2 AS BIGINT) AS n, unnest(range(0, CAST(length(hx) // 2 AS BIGINT))) AS i FROM d),
win AS (SELECT p.doc_id, p.i, md5(substr(hx, CAST(2 * i + 1 AS BIGINT), 200)) AS h FROM p JOIN d USING (doc_id) WHERE i + 100 <= n),
hit AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
marked AS (SELECT p.doc_id, p.i, max(hit.i) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM p LEFT JOIN hit ON hit.doc_id = p.doc_id AND hit.i = p.i),
edge AS (SELECT *, lag(gone) OVER (PARTITION BY doc_id ORDER BY i) AS was FROM marked),
runs AS (SELECT doc_id, i, gone, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM edge WHERE was IS NULL OR was <> gone),
kept AS (SELECT doc_id, sum(coalesce(nxt, length(hx) // 2) - i) FILTER (gone) AS n_removed, count(*) FILTER (gone) AS n_spans, string_agg(substr(hx, CAST(2 * i + 1 AS BIGINT), CAST(2 * (coalesce(nxt, length(hx) // 2) - i) AS BIGINT)), '' ORDER BY i) FILTER (NOT gone) AS hx FROM runs JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(d.hx) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.hx, ''))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op11_ranked_search": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark),
g AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_words FROM d),
m AS (SELECT r, doc_id, 50 + (50 * len(w) * n_docs) // n_words AS m FROM d, g WHERE len(w) > 0),
words AS (SELECT r, unnest(w) AS term FROM d),
tf AS (SELECT r, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM q) GROUP BY r, term),
wt AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), g),
s AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM q JOIN wt USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50""",
}
