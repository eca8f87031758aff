"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

import os

from . import chat_format, decontaminate, fingerprints, lm_scoring, mixing, near_dedup, token_counts, token_output, toxicity, url_filter
from .common import table

SQL: dict[str, str] = {}


def tokenizer_path() -> str:
    """The tokenizer file: ``CLAUSELOOM_TOKENIZER`` if set, else the public byte-level BPE with 50k ids."""
    if path := os.environ.get("CLAUSELOOM_TOKENIZER"):
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_counts(spark, sf_dir):
    return token_counts.section_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_chat_format(spark, sf_dir):
    return chat_format.formatted(table(spark, sf_dir, "conversations"))


SQL["op2_chat_format"] = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, row_number() OVER w AS k, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS line FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
p AS (SELECT conv_id, k, string_agg(line, '') OVER (PARTITION BY conv_id ORDER BY k) AS pre, max(k) OVER (PARTITION BY conv_id) AS n FROM o),
w AS (SELECT n, pre, min(conv_id) AS conv_id FROM p WHERE k = n GROUP BY n, pre),
x AS (SELECT DISTINCT k, pre FROM p WHERE k < n)
SELECT conv_id, n::BIGINT AS n_turns, pre AS rendered FROM w WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.k = w.n AND x.pre = w.pre)
"""


def op3_lm_scoring(spark, sf_dir):
    return lm_scoring.scores(table(spark, sf_dir, "documents"))


def op4_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


SQL["op4_near_dedup"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] END) AS sh FROM d),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
c AS (SELECT min(doc_id) AS id, any_value(n) AS n, any_value(h) AS h FROM (SELECT doc_id, any_value(n) AS n, md5(string_agg(x, chr(10) ORDER BY x)) AS h FROM e GROUP BY doc_id) GROUP BY h),
ce AS (SELECT c.id, c.n, e.x FROM c JOIN e ON e.doc_id = c.id),
pair AS (SELECT a.id AS u, b.id AS v, any_value(a.n) AS nu, any_value(b.n) AS nv, count(*) AS inter FROM ce a JOIN ce b ON a.x = b.x AND a.id < b.id WHERE 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY a.id, b.id),
link AS (SELECT u, v FROM pair WHERE 100 * inter >= 75 * (nu + nv - inter)),
edge AS (SELECT u, v FROM link UNION SELECT v, u FROM link),
reach AS (SELECT id AS a, id AS b FROM c UNION SELECT reach.a, edge.v FROM reach JOIN edge ON edge.u = reach.b),
comp AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY a),
own AS (SELECT doc_id, md5(string_agg(x, chr(10) ORDER BY x)) AS h FROM e GROUP BY doc_id),
ch AS (SELECT c.h, comp.component FROM c JOIN comp USING (id))
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(ch.component, s.doc_id) AS component_id, s.doc_id = coalesce(ch.component, s.doc_id) AS kept
FROM s LEFT JOIN own USING (doc_id) LEFT JOIN ch USING (h)
"""


def op5_url_filter(spark, sf_dir):
    return url_filter.judged(table(spark, sf_dir, "pages"), url_filter.outcomes_of(table(spark, sf_dir, "labels")))


SQL["op5_url_filter"] = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
l AS (SELECT *, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS labels FROM p),
s AS (SELECT *, CASE WHEN len(labels) >= 2 AND array_to_string(labels[-2:], '.') IN ('co.uk', 'org.uk', 'ac.uk', 'gov.uk', 'com.au', 'net.au', 'org.au', 'co.jp', 'ne.jp', 'or.jp', 'com.br', 'com.cn', 'co.in', 'co.nz', 'co.za') THEN array_to_string(labels[-2:], '.') ELSE labels[-1] END AS suffix FROM l),
d AS (SELECT *, CASE WHEN len(labels) > len(string_split(suffix, '.')) THEN array_to_string(labels[len(labels) - len(string_split(suffix, '.')):], '.') ELSE host END AS domain FROM s),
o AS (SELECT doc_id AS page_id, max((quality = 0)::INT) AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
h AS (SELECT host, domain, suffix, count(o.bad)::DOUBLE AS n, coalesce(sum(o.bad), 0)::DOUBLE AS bad FROM d LEFT JOIN o USING (page_id) GROUP BY host, domain, suffix),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM h) AS prior FROM h GROUP BY suffix),
s1 AS (SELECT *, least(greatest(prior, 1e-6), 1 - 1e-6) AS m FROM s0),
s2 AS (SELECT sum((bad - n * m) * (bad - n * m) / (m * (1 - m))) AS z, sum(n) AS n1, sum(n * n) AS n2 FROM s1),
s3 AS (SELECT CASE WHEN z > n1 THEN least(greatest((n2 - n1) / (z - n1) - 1, 2.0), 1000.0) ELSE 1000.0 END AS k FROM s2),
s4 AS (SELECT suffix, (k * m + bad) / (k + n) AS prior FROM s1, s3),
d0 AS (SELECT h.domain, h.suffix, sum(n) AS n, sum(bad) AS bad, any_value(s4.prior) AS prior FROM h JOIN s4 USING (suffix) GROUP BY h.domain, h.suffix),
d1 AS (SELECT *, least(greatest(prior, 1e-6), 1 - 1e-6) AS m FROM d0),
d2 AS (SELECT sum((bad - n * m) * (bad - n * m) / (m * (1 - m))) AS z, sum(n) AS n1, sum(n * n) AS n2 FROM d1),
d3 AS (SELECT CASE WHEN z > n1 THEN least(greatest((n2 - n1) / (z - n1) - 1, 2.0), 1000.0) ELSE 1000.0 END AS k FROM d2),
d4 AS (SELECT domain, suffix, (k * m + bad) / (k + n) AS prior FROM d1, d3),
h1 AS (SELECT h.*, least(greatest(d4.prior, 1e-6), 1 - 1e-6) AS m FROM h JOIN d4 USING (domain, suffix)),
h2 AS (SELECT sum((bad - n * m) * (bad - n * m) / (m * (1 - m))) AS z, sum(n) AS n1, sum(n * n) AS n2 FROM h1),
h3 AS (SELECT CASE WHEN z > n1 THEN least(greatest((n2 - n1) / (z - n1) - 1, 2.0), 1000.0) ELSE 1000.0 END AS k FROM h2),
h4 AS (SELECT host, k * m + bad AS a, k * (1 - m) + n - bad AS b FROM h1, h3),
h5 AS (SELECT host, round(a / (a + b) - 1.0 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 6) AS bound FROM h4),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
f AS (SELECT page_id, host, path, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(verdict, length(rhost || rpath)) AS ruled
  FROM d JOIN r ON (d.host = r.rhost OR d.host LIKE '%.' || r.rhost) AND starts_with(d.path, r.rpath) GROUP BY page_id, host, path)
SELECT d.page_id, d.host, d.path, f.rule, coalesce(f.ruled, CASE WHEN h5.bound > 0.25 THEN 'block' ELSE 'allow' END) AS verdict, h5.bound
FROM d LEFT JOIN f USING (page_id, host, path) LEFT JOIN h5 USING (host)
"""


def op6_fingerprints(spark, sf_dir):
    return fingerprints.edited_report(table(spark, sf_dir, "documents"))


def op7_decontamination(spark, sf_dir):
    return decontaminate.digest(decontaminate.occurrences(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")))


SQL["op7_decontamination"] = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, unnest([array_to_string(w[i:i + least(10, len(w)) - 1], ' ') for i in range(1, len(w) - least(10, len(w)) + 2)]) AS win FROM b WHERE len(w) > 0),
ms AS (SELECT DISTINCT m FROM p),
dw AS (SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS i, w FROM d, ms WHERE len(w) >= m),
hit AS (SELECT dw.doc_id, p.item_id, dw.i, dw.m FROM (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS win FROM dw) dw JOIN p ON p.m = dw.m AND p.win = dw.win),
n AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS pos FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n.n_hit, 0)::BIGINT AS n_hit, coalesce(it.n_items, 0)::BIGINT AS n_items, sha256(coalesce(it.s, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def op8_token_output(spark, sf_dir):
    return token_output.write_and_read(table(spark, sf_dir, "documents"), tokenizer_path())


#: Wanted shares of tokens by domain.
TARGETS = {"en": 0.5, "fr": 0.18, "de": 0.16, "es": 0.16}


def op9_source_mixing(spark, sf_dir):
    """The rate of each document, the targets' domains being languages; rows that look toxic or low want no tokens."""
    docs = table(spark, sf_dir, "documents")
    return mixing.rates(docs, mixing.domain_rows(docs, table(spark, sf_dir, "labels")), TARGETS)[0]


def op10_toxicity(spark, sf_dir):
    return toxicity.toxic_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_chat_format, op3_lm_scoring, op4_near_dedup, op5_url_filter, op6_fingerprints, op7_decontamination, op8_token_output,
        op9_source_mixing, op10_toxicity,
    )
}
