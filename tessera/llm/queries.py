"""Registered queries of the subpackage, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (alignment, conversations, decontaminate, embeddings, html_text, langid, licenses, packing, quality, secrets,
               sentencepiece_codec, simhash, token_counts)
from .common import table


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.trie(table(spark, sf_dir, "conversations"), base=lambda c: c - c % 5,
                              head=lambda c: F.crc32(c.cast("string")) % 9, max_head=8)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                             public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_licenses, op2_sentencepiece, op3_decontamination, op4_html, op5_secrets, op6_token_counts,
                            op7_embeddings, op8_language, op9_quality, op10_simhash, op11_conversation_trie, op12_alignment, op13_packing)}

_TEMPLATES = ", ".join(f"('{name}', '{text}')" for name, text in licenses.TEMPLATES)

_PEM = (r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[\x20\t\r\n]*Proc-Type:[^\n]*\n[\x20\t\r\n]*DEK-Info:[^\n]*\n)?"
        r"(?:[^-]*-----END [A-Z ]{0,40}PRIVATE KEY-----|(?:[\x20\t\r\n]+[A-Za-z0-9+/]{40,}={0,2})*(?:[\x20\t\r\n]+[A-Za-z0-9+/]+={1,2})?)")

SQL: dict[str, str] = {
    # Brute force: every template's shingles against every document's.
    "op1_licenses": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
t(license, text) AS (VALUES {_TEMPLATES}),
i AS (SELECT license, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM t),
dp AS (SELECT r, doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0),
ip AS (SELECT license, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM i),
ds AS (SELECT DISTINCT r, doc_id, array_to_string(list_slice(w, p, p + 4), ' ') AS s FROM dp),
xs AS (SELECT DISTINCT license, array_to_string(list_slice(w, p, p + 4), ' ') AS s FROM ip),
n AS (SELECT license, count(*) AS n_template FROM xs GROUP BY license)
SELECT doc_id, license, count(*) AS n_shared, any_value(n_template) AS n_template, count(*) / any_value(n_template) AS containment
FROM ds JOIN xs USING (s) JOIN n USING (license) GROUP BY r, doc_id, license
HAVING count(*) >= 0.8 * any_value(n_template) - 1e-9""",
    # Brute force: every item's shingles against every document's.
    "op3_decontamination": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
i AS (SELECT row_number() OVER () AS k, item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM benchmark),
dp AS (SELECT r, doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0),
ip AS (SELECT k, item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM i WHERE len(w) > 0),
ds AS (SELECT DISTINCT r, doc_id, array_to_string(list_slice(w, p, p + 4), ' ') AS s FROM dp),
xs AS (SELECT DISTINCT k, item_id, array_to_string(list_slice(w, p, p + 4), ' ') AS s FROM ip),
n AS (SELECT k, count(*) AS n_item FROM xs GROUP BY k)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*) / any_value(n_item) AS containment
FROM ds JOIN xs USING (s) JOIN n USING (k) GROUP BY r, doc_id, k, item_id
HAVING count(*) >= 0.8 * any_value(n_item) - 1e-9""",
    "op5_secrets": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
rules(k, kind, rx, g, least) AS (VALUES
  (0, 'assign', '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
  (1, 'access', '(AKIA[A-Z0-9]+)', 1, 20),
  (2, 'hex', '([0-9a-f]+)', 1, 24),
  (3, 'github', '(gh[pousr]_[A-Za-z0-9]{36,})', 1, 1),
  (4, 'pem', '(@PEM@)', 1, 1)),
m AS (
  SELECT r, 0 AS k, regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS m,
    regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS v,
    string_split_regex(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS p FROM d
  UNION ALL SELECT r, 1, regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), string_split_regex(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT r, 2, regexp_extract_all(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+'), string_split_regex(t, '[0-9a-f]+') FROM d
  UNION ALL SELECT r, 3, regexp_extract_all(t, 'gh[pousr]_[A-Za-z0-9]{36,}'), regexp_extract_all(t, 'gh[pousr]_[A-Za-z0-9]{36,}'), string_split_regex(t, 'gh[pousr]_[A-Za-z0-9]{36,}') FROM d
  UNION ALL SELECT r, 4, regexp_extract_all(t, '@PEM@'), regexp_extract_all(t, '@PEM@'), string_split_regex(t, '@PEM@') FROM d),
e AS (SELECT r, k, unnest(range(1, len(m) + 1)) AS j, m, v, p FROM m WHERE len(m) > 0),
x AS (SELECT r, k, j, length(m[j]) AS n, length(v[j]) AS nv, length(p[j]) AS gap FROM e),
s AS (SELECT r, k, nv, n, sum(gap + n) OVER (PARTITION BY r, k ORDER BY j) AS stop FROM x),
f AS (SELECT r, k, kind, (stop - n)::BIGINT AS a, stop::BIGINT AS b FROM s JOIN rules USING (k) WHERE nv >= least),
g AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (k < 3) AS base,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans FROM f GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)""".replace("@PEM@", _PEM),
    # Rebuilt conversations as lists of turns; a node is a list, its subtree all lists that begin with it.
    "op11_conversation_trie": """
WITH t AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS s
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (
  SELECT conv_id, s, xor(list_reduce(
    list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda u, w: CASE WHEN u & 1 = 1 THEN xor(u >> 1, 3988292384) ELSE u >> 1 END)), 4294967295) % 9 AS h FROM t),
r AS (
  SELECT h.conv_id, list_concat(coalesce(list_slice(b.s, 1, h.h), []), list_slice(h.s, h.h + 1, len(h.s))) AS s
  FROM h LEFT JOIN t b ON b.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM r),
m AS (SELECT conv_id, d, list_slice(s, 1, d) AS k, len(s) AS size, CASE WHEN d = 0 THEN 0 ELSE strlen(s[d].text) END AS bytes FROM p),
n AS (
  SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
    string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = size) AS ends FROM m GROUP BY k, d),
c AS (SELECT list_slice(k, 1, d - 1) AS k, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (k, d)),
u AS (SELECT k, n_children, (n_convs - 1) * bytes AS saved, unnest(range(0, d + 1)) AS e FROM f),
v AS (SELECT list_slice(k, 1, e) AS k, e AS d, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM u GROUP BY ALL)
SELECT f.conv_id, f.d AS depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens,
  sha256(coalesce(f.ends, '')) AS ends_sha256
FROM f JOIN v USING (k, d) LEFT JOIN f q ON q.d = f.d - 1 AND q.k = list_slice(f.k, 1, f.d - 1)""",
}
