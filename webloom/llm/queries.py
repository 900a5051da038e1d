"""The queries of this subpackage, by name, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from webloom.llm import (
    bpe,
    conversation_repair,
    decontaminate,
    fill_middle,
    language_id,
    near_dup,
    quality_model,
    quality_rules,
    repeat_spans,
    secret_scan,
    sharding,
    token_counts,
    token_store,
)
from webloom.llm.common import table


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), limit=2048)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.write_and_read(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.write_and_read(table(spark, sf_dir, "documents"), shards=16)


def op11_repeat_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_spans.report(table(spark, sf_dir, "documents"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.report(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversation_repair.damage(table(spark, sf_dir, "conversations"))
    return conversation_repair.report(conversation_repair.repair(damaged))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_bpe_round_trip,
        op2_token_counts,
        op3_language_id,
        op4_token_store,
        op5_decontamination,
        op6_near_duplicates,
        op7_quality_rules,
        op8_secret_scan,
        op9_quality_model,
        op10_sharding,
        op11_repeat_spans,
        op12_fill_middle,
        op13_conversation_repair,
    )
    return {f.__name__: f for f in every}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP5_SQL = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
  b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
  windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS win
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
  places AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
  hits AS (SELECT doc_id, i, p.n, item_id FROM (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM places) p JOIN windows USING (n, win)),
  covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY 1),
  items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY 1)
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""

_OP6_SQL = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
    JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
  reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
  least_of AS (SELECT a, min(b) AS m FROM reach GROUP BY 1)
  SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, m) AS component_id, least(doc_id, m) = doc_id AS kept
  FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_of ON a = doc_id"""


_OP11_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
  w AS (SELECT r, doc_id, i, b[i : i + 49] AS s FROM (SELECT r, doc_id, b, unnest(range(1, octet_length(b) - 48)) AS i FROM d)),
  first AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s),
  hit AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM w JOIN first USING (s) WHERE m < coalesce(doc_id, m + 1)),
  run AS (SELECT r, i, sum(CASE WHEN i <= p + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS k FROM hit),
  span AS (SELECT r, k, min(i) AS a, max(i) + 50 AS z FROM run GROUP BY r, k),
  gone AS (SELECT r, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans FROM span GROUP BY r),
  piece AS (SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 1) AS a, a AS z FROM span
    UNION ALL SELECT d.r, coalesce(max(z), 1), max(octet_length(b)) + 1 FROM d LEFT JOIN span USING (r) GROUP BY d.r),
  kept AS (SELECT r, string_agg(CASE WHEN piece.z > piece.a THEN hex(b[piece.a : piece.z - 1]) ELSE '' END, '' ORDER BY piece.a, piece.z) AS h FROM piece JOIN d USING (r) GROUP BY r)
  SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(h)) AS kept_sha256
  FROM d JOIN kept USING (r) LEFT JOIN gone USING (r)"""

_OP12_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
  drawn AS (SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS x, ('0x' || h[9:16])::BIGINT % (n + 1) AS y, ('0x' || h[17:24])::BIGINT % 100 AS h3, ('0x' || h[25:32])::BIGINT % 100 AS h4 FROM d),
  formed AS (SELECT *, least(x, y) AS a, greatest(x, y) AS z,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
  made AS (SELECT doc_id, n, form, a, z, CASE form WHEN 'plain' THEN t
    WHEN 'psm' THEN '<P>' || substring(t, 1, a) || '<S>' || substring(t, z + 1) || '<M>' || substring(t, a + 1, z - a)
    ELSE '<S>' || substring(t, z + 1) || '<P>' || substring(t, 1, a) || '<M>' || substring(t, a + 1, z - a) END AS o FROM formed),
  cut AS (SELECT *, string_split(replace(replace(substring(o, 4), '<S>', '<M>'), '<P>', '<M>'), '<M>') AS part FROM made)
  SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN z - a END AS middle_chars, sha256(o) AS output_sha256,
    sha256(CASE form WHEN 'plain' THEN o WHEN 'psm' THEN part[1] || part[3] || part[2] ELSE part[2] || part[3] || part[1] END) AS restored_sha256 FROM cut"""

# States: 0 nothing yet, 1 after s, 2 after u, 3 after a. Each row, from the last one back, takes the least (cost, edits) of all edits, with up to two inserts before.
_OP13_SQL = r"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
  src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8))) % 20 AS fate FROM conversations, crc),
  damaged AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS nth FROM src),
  placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, substring(text, 1, 64), sha256(text)) AS k FROM damaged),
  faulty AS (SELECT conv_id, turn, role, text, k, role[1:1] AS initial, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY k) AS prior,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM placed),
  counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (prior || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id),
  states(i, nxt, price, tail) AS (VALUES (0, 2, 0, ''), (1, 2, 6, 'II'), (2, 3, 3, 'I'), (3, 2, 0, '')),
  inserted AS (SELECT i, i AS here, 0 AS price, '' AS edits FROM states UNION ALL SELECT i, nxt, 3, 'I' FROM states UNION ALL SELECT a.i, b.nxt, 6, 'II' FROM states a JOIN states b ON b.i = a.nxt),
  kept(initial, here, j) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
  moves AS (SELECT i, here AS j, price + 4 AS price, edits || 'D' AS edits, 'D' AS edit, NULL::VARCHAR AS initial FROM inserted
    UNION ALL SELECT x.i, nxt, x.price + 3, edits || 'R', 'R', NULL FROM inserted x JOIN states y ON y.i = here
    UNION ALL SELECT i, j, price, edits || 'K', 'K', initial FROM inserted JOIN kept USING (here)),
  least_of AS (SELECT conv_id, n + 1 AS k, i, {'cost': price::BIGINT, 'edits': tail} AS best FROM counts, states
    UNION ALL SELECT f.conv_id, f.k, m.i, min({'cost': l.best.cost + m.price + CASE WHEN m.edit <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END, 'edits': m.edits || l.best.edits})
    FROM least_of l JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.k = l.k - 1 JOIN moves m ON m.j = l.i
    WHERE (m.edit = 'D' OR fault NOT IN ('blank', 'duplicate')) AND coalesce(m.initial = f.initial, true) GROUP BY f.conv_id, f.k, m.i),
  solved AS (SELECT conv_id, best.cost AS cost, best.edits AS audit FROM least_of WHERE k = 1 AND i = 0),
  letters AS (SELECT conv_id, p, audit[p] AS edit, length(replace(audit[1:p], 'I', '')) AS k, length(replace(audit[1:p], 'D', '')) AS o FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM solved)),
  turns AS (SELECT e.conv_id, p, edit, o, role, CASE WHEN edit = 'I' THEN '' ELSE text END AS text, coalesce(edit = 'K' AND initial = 's', false) AS lead
    FROM letters e LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.k = e.k WHERE edit <> 'D'),
  named AS (SELECT *, max(lead::INT) OVER (PARTITION BY conv_id) AS led FROM turns),
  repaired AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (o - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS lines FROM named GROUP BY conv_id)
  SELECT v.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
  FROM (SELECT DISTINCT conv_id FROM conversations) v LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM v.conv_id
  LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM v.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM v.conv_id"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express; learned models, tokenizers and exact byte cuts are tested otherwise."""
    return {
        "op5_decontamination": _OP5_SQL,
        "op6_near_duplicates": _OP6_SQL,
        "op11_repeat_spans": _OP11_SQL,
        "op12_fill_middle": _OP12_SQL,
        "op13_conversation_repair": _OP13_SQL,
    }
