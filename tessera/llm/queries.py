"""The registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import (bpe, conversation_repair, decontaminate, html_text, line_dedup, mtree, pii, prefix_trie, quality, secret_crf,
                         simhash, url_alias, warc)
from tessera.llm.common import table


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_classes(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.disclosing_terms(docs))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_url_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_alias.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), byte_bpe(), with_ids=False, with_text=False)


def op9_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_crf.find(docs, secret_crf.train(docs))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversation_repair.damaged(table(spark, sf_dir, "conversations"))
    return conversation_repair.digests(conversation_repair.repair(damaged))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


QUERIES = {"op1_line_dedup": op1_line_dedup, "op2_pii": op2_pii, "op3_quality": op3_quality, "op4_simhash": op4_simhash,
           "op5_warc": op5_warc, "op6_url_alias": op6_url_alias,
           "op7_decontaminate": op7_decontaminate, "op8_bpe": op8_bpe, "op9_mtree": op9_mtree, "op10_secrets": op10_secrets,
           "op11_repair": op11_repair, "op12_prefix_trie": op12_prefix_trie, "op13_html_text": op13_html_text}

def _words_sql(table_: str, key: str) -> str:
    return (f"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
            f"'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table_}")


#: Every window of every size as one string, joined with the same strings of the documents.
OP7_SQL = f"""
WITH d AS ({_words_sql("documents", "doc_id")}), b AS ({_words_sql("benchmark", "item_id")}),
places AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM places),
grams AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win))),
hit AS (SELECT g.doc_id, g.i, g.n, win.item_id FROM grams g JOIN win ON g.n = win.n AND g.phrase = win.phrase),
n_hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
OP9_SQL = """
WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scores AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores) WHERE rank <= 5
"""
OP5_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT payload_bytes, payload_digest, max(page_id) AS keep FROM p WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < keep THEN keep END AS refers_to
FROM p LEFT JOIN k USING (payload_bytes, payload_digest)
"""

#: No page of the given tables has a canonical link or a redirect (a test holds them to that), so
#: the method allows every page that no rule decides. Aliases are tested against brute force.
OP6_SQL = """
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw, coalesce(rest, '') AS rest FROM r),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
rules(rule, host, path, verdict) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
    ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
best AS (SELECT p.page_id, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
         FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN best USING (page_id)
"""


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    return (f"xor(4294967295, list_reduce(list_transform(range(1, length({text}) + 1), lambda k: ascii(({text})[k])), lambda c, b: "
            f"list_reduce(range(8), lambda x, k: xor(x >> 1, (x & 1) * 3988292384), xor(c, b)), 4294967295))")


#: The repair as a walk over the turns, one state of the pattern at a time: '' nothing yet, then the
#: initial of the last turn. ``edits``: an edit of one turn and the turns inserted behind it.
OP11_SQL = f"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS id FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
      FROM (SELECT *, {_crc32_sql("id")} % 20 AS kind FROM k)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d),
t AS (SELECT *, left(role, 1) AS initial, CASE WHEN last = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN last IN ('.', '!', '?') THEN '' ELSE 'truncated' END AS fault
      FROM (SELECT *, right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) AS last,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS again FROM n)),
moves(p, q) AS (VALUES ('', 's'), ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
roles(q, role) AS (VALUES ('u', 'user'), ('a', 'assistant')),
inserted(p, q, cost, audit, made) AS (VALUES ('', '', 0, '', ''), ('', 'u', 5, 'I', chr(10) || 'user:'),
    ('', 'a', 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), ('s', 's', 0, '', ''), ('s', 'u', 5, 'I', chr(10) || 'user:'),
    ('s', 'a', 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), ('u', 'u', 0, '', ''), ('u', 'a', 5, 'I', chr(10) || 'assistant:'),
    ('a', 'a', 0, '', ''), ('a', 'u', 5, 'I', chr(10) || 'user:')),
edits AS (SELECT e.p, i.q, e.edit, e.at, e.role, e.cost + i.cost AS cost, e.edit || i.audit AS audit, i.made
          FROM (SELECT p, q, 'K' AS edit, q AS at, NULL AS role, 0 AS cost FROM moves
                UNION ALL SELECT p, q, 'R', NULL, role, 1 FROM moves JOIN roles USING (q)
                UNION ALL SELECT DISTINCT p, p, 'D', NULL, NULL, 2 FROM inserted) e JOIN inserted i ON i.p = e.q),
walk AS (
    SELECT c.conv_id, 0 AS i, s.q AS state, CAST(s.cost AS BIGINT) AS cost, CAST(s.audit AS VARCHAR) AS audit, CAST(s.made AS VARCHAR) AS made
    FROM (SELECT DISTINCT conv_id FROM conversations) c, (SELECT * FROM inserted WHERE p = '') s
    UNION ALL
    SELECT conv_id, i, state, best.cost, best.audit, best.made FROM (
        SELECT w.conv_id, w.i + 1 AS i, e.q AS state,
               min({{'cost': w.cost + e.cost + CASE WHEN t.fault = 'truncated' AND e.edit <> 'D' THEN 5 ELSE 0 END, 'audit': w.audit || e.audit,
                    'made': w.made || CASE WHEN e.edit = 'D' THEN '' ELSE chr(10) || coalesce(e.role, t.role) || ':' || t.text END || e.made}}) AS best
        FROM walk w JOIN t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1
        JOIN edits e ON e.p = w.state AND (e.edit = 'D' OR t.fault NOT IN ('blank', 'duplicate') AND (e.edit = 'R' OR e.at = t.initial))
        GROUP BY w.conv_id, w.i, e.q)),
sums AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal
         FROM (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM t) GROUP BY conv_id)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, best.cost AS cost, best.audit AS audit, sha256(substr(best.made, 2)) AS repaired_sha256
FROM (SELECT w.conv_id, any_value(s.gaps) AS gaps, any_value(blank) AS blank, any_value(duplicate) AS duplicate, any_value(truncated) AS truncated, any_value(illegal) AS illegal,
             min({{'cost': w.cost, 'audit': w.audit, 'made': w.made}}) AS best
      FROM walk w LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.i = coalesce(s.n, 0) AND w.state IN ('', 'a') GROUP BY w.conv_id)
"""

#: Nodes are the beginnings of the rebuilt conversations themselves; subtrees are found by comparing them.
OP12_SQL = f"""
WITH c AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS turns
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, {_crc32_sql("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM c),
w AS (SELECT h.conv_id, coalesce(b.turns, [])[:h.h] || h.turns[h.h + 1:] AS turns FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 100),
m AS (SELECT conv_id, d, len(turns) AS n, turns[:d] AS node FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM w)),
g AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '') AS ends FROM m GROUP BY node, d),
f AS (SELECT g.*, p.conv_id AS parent_conv_id, CASE WHEN g.d = 0 THEN 0 ELSE (g.n_convs - 1) * length(g.node[-1].text) END AS size
      FROM g LEFT JOIN g p ON p.d = g.d - 1 AND p.node = g.node[:g.d - 1]),
k AS (SELECT f.*, coalesce(x.n_children, 0) AS n_children FROM f
      LEFT JOIN (SELECT node[:d - 1] AS up, d - 1 AS up_d, count(*) AS n_children FROM f WHERE d > 0 GROUP BY ALL) x ON x.up_d = f.d AND x.up = f.node),
s AS (SELECT a.node, a.d, sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(b.size) AS saved_tokens
      FROM k a JOIN (SELECT *, unnest(range(d + 1)) AS up_d FROM k) b ON b.up_d = a.d AND b.node[:b.up_d] = a.node GROUP BY a.node, a.d)
SELECT k.conv_id, CAST(k.d AS BIGINT) AS depth, k.parent_conv_id, k.n_convs, k.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(k.ends) AS ends_sha256
FROM k JOIN s ON s.d = k.d AND s.node = k.node
"""
SQL: dict[str, str] = {"op5_warc": OP5_SQL, "op6_url_alias": OP6_SQL, "op7_decontaminate": OP7_SQL, "op9_mtree": OP9_SQL, "op11_repair": OP11_SQL,
                       "op12_prefix_trie": OP12_SQL}
