"""The operators of this subpackage as registered queries."""

import public_tokenizers
from pyspark.sql import functions as F

from stockmill.llm import (
    collocations, conversation_repair, decontaminate, embedding_dedup, language_id, license_scan,
    line_dedup, ngram_join, packing, pieces, quality, sharding, suffix_dedup,
)
from stockmill.llm.common import held_out, table

QUERIES, ORACLE = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def joined_ids(ids):
    """SHA-256 of ids sorted as text and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(ids.cast("array<string>")), ","), 256)


@query
def op1_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"))
    return scanned.select(
        "row.doc_id", "out.n_words", "out.n_hit", F.size("out.items").cast("bigint").alias("n_items"),
        joined_ids(F.col("out.items")).alias("items_sha256"), "out.contaminated")


@query
def op2_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedupe_lines(docs).select(
        "row.doc_id", "out.n_lines", F.size("out.dropped").cast("bigint").alias("n_dropped"),
        joined_ids(F.col("out.dropped")).alias("dropped_sha256"),
        F.sha2(F.coalesce("out.text", F.lit("")), 256).alias("kept_sha256"))


@query
def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs)
    return language_id.predict(docs.select("doc_id", "text"), model).select(
        "row.doc_id", held_out("row.doc_id").alias("held_out"), "out.lang_pred", "out.score")


@query
def op4_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select("doc_id", "text"), model).select(
        "row.doc_id", held_out("row.doc_id").alias("held_out"), "out.score",
        (F.col("out.score") >= quality.KEEP_FROM).cast("int").alias("predicted"))


@query
def op5_ngram_join(spark, sf_dir):
    return ngram_join.similar(table(spark, sf_dir, "documents")).withColumn(
        "kept", F.col("doc_id") == F.col("component_id"))


@query
def op6_embedding_dedup(spark, sf_dir):
    found, _ = embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


@query
def op7_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query
def op8_sharding(spark, sf_dir):
    packed = sharding.pack(table(spark, sf_dir, "documents"), shards=sharding.SHARDS)
    return packed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query
def op9_suffix_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    span = F.aggregate("out.spans", F.lit(0).cast("bigint"), lambda n, s: n + s[1] - s[0])
    return suffix_dedup.dedupe(docs).select(
        "row.doc_id", "out.n_bytes", span.alias("n_removed"),
        F.size("out.spans").cast("bigint").alias("n_spans"),
        F.sha2("out.kept", 256).alias("kept_sha256"))


@query
def op10_pieces(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, pieces.load()).select(
        "row.doc_id", F.size("out.ids").cast("bigint").alias("n_pieces"), "out.ids",
        "out.lossless")


@query
def op11_conversation_repair(spark, sf_dir):
    rows = conversation_repair.damaged(table(spark, sf_dir, "conversations"))
    return conversation_repair.repair(rows, copies="copies").drop("given")


@query
def op12_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query
def op13_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    packed = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


ORACLE["op1_decontamination"] = r"""
WITH item_words AS (
  SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n,
    array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i
        FROM item_words WHERE len(w) > 0)),
doc_words AS (
  SELECT doc_id, row_number() OVER () AS r, CASE WHEN text IS NULL THEN []
    ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END AS w
  FROM documents),
grams AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS phrase
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i
        FROM doc_words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (SELECT r, n, i, item_id FROM grams JOIN windows USING (n, phrase)),
hits AS (
  SELECT r, count(*) AS n_hit FROM (
    SELECT DISTINCT r, unnest(generate_series(i, i + n - 1)) AS word FROM found) GROUP BY r),
ids AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(joined, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN hits USING (r) LEFT JOIN ids USING (r)
"""

ORACLE["op2_line_dedup"] = r"""
WITH cut AS (
  SELECT doc_id, i - 1 AS line, parts[i] AS body,
    regexp_extract_all(translate(parts[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i
        FROM (SELECT doc_id, string_split(text, chr(10)) AS parts
              FROM documents WHERE text <> ''))),
lines AS (SELECT doc_id, line, body, len(w) AS n, array_to_string(w, ' ') AS phrase, w FROM cut),
firsts AS (
  SELECT phrase, any_value(w) AS w, any_value(n) AS n, min(doc_id * 1000000 + line) AS spot
  FROM lines WHERE n >= 3 GROUP BY phrase),
variants AS (
  SELECT phrase, spot, i AS gone, array_to_string(list_concat(w[1 : i - 1], w[i + 1 :]), ' ') AS v
  FROM (SELECT phrase, spot, w, unnest(generate_series(1, n)) AS i FROM firsts WHERE n >= 8)),
same AS (SELECT v, gone, min(spot) AS low FROM variants GROUP BY v, gone),
part AS (SELECT v, min(spot) AS low FROM variants GROUP BY v),
near AS (
  SELECT phrase FROM variants JOIN same USING (v, gone) WHERE low < spot
  UNION SELECT a.phrase FROM variants a JOIN firsts b ON a.v = b.phrase
    WHERE b.n >= 8 AND b.spot < a.spot
  UNION SELECT f.phrase FROM firsts f JOIN part ON f.phrase = part.v
    WHERE f.n >= 8 AND part.low < f.spot),
judged AS (
  SELECT doc_id, line, body, l.n >= 3 AND (near.phrase IS NOT NULL
    OR doc_id * 1000000 + line <> spot) AS gone
  FROM lines l LEFT JOIN firsts f ON l.phrase = f.phrase LEFT JOIN near ON l.phrase = near.phrase),
done AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    coalesce(string_agg(line::VARCHAR, ',' ORDER BY line::VARCHAR) FILTER (gone), '') AS dropped,
    coalesce(string_agg(body, chr(10) ORDER BY line) FILTER (NOT gone), '') AS kept
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines,
  coalesce(n_dropped, 0)::BIGINT AS n_dropped, sha256(coalesce(dropped, '')) AS dropped_sha256,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN done USING (doc_id)
"""

ORACLE["op5_ngram_join"] = r"""
WITH RECURSIVE doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE text IS NOT NULL),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i
        FROM doc_words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b, c = m.n AND c = o.n AS same
  FROM pairs JOIN sizes m ON m.doc_id = a JOIN sizes o ON o.doc_id = b
  WHERE 5 * c >= 4 * (m.n + o.n - c)),
reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
parts AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (
  SELECT a AS doc_id, count(*) AS n_links, min(b) FILTER (same) AS twin FROM links GROUP BY a)
SELECT d.doc_id, least(d.doc_id, coalesce(twin, d.doc_id)) AS class_id,
  coalesce(n_links, 0)::BIGINT AS n_links, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN parts p ON p.doc_id = d.doc_id LEFT JOIN counts c ON c.doc_id = d.doc_id
"""

ORACLE["op11_conversation_repair"] = r"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS name
  FROM conversations),
crc_table AS (
  SELECT list(v ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS b))),
coded AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(range(1, octet_length(name) + 1),
        lambda i: ('0x' || substr(hex(name), (2 * i - 1)::INT, 2))::BIGINT)),
      lambda v, b: xor(v >> 8, t[(xor(v, b) & 255) + 1])), 4294967295) % 20 AS code
  FROM named, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
    CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy
  FROM coded WHERE code <> 0),
placed AS (
  SELECT *, row_number() OVER w AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1
      AS again, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS seen,
    lag(role) OVER w AS before
  FROM damaged WINDOW w AS (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, encode(role), encode(text), copy)),
rows AS (
  SELECT conv_id, i, turn, role, text, left(role, 1) AS first,
    CASE WHEN seen = '' THEN 'b' WHEN again THEN 'd' WHEN right(seen, 1) NOT IN ('.', '!', '?')
      THEN 't' ELSE '' END AS fault,
    before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal
  FROM placed),
-- states: start, after a system row, after a user row, after a pair
inserts AS (
  SELECT * FROM (VALUES (0, 0, ''), (0, 2, 'u'), (0, 3, 'ua'), (1, 1, ''), (1, 2, 'u'),
    (1, 3, 'ua'), (2, 2, ''), (2, 3, 'a'), (2, 2, 'au'), (3, 3, ''), (3, 2, 'u'), (3, 3, 'ua'))
    AS v(q, p, put)),
moves AS (SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2))
  AS v(q, x, p)),
steps AS (
  SELECT i.q, m.x AS needs, m.p AS p, put, 'K' AS edit, 0 AS cost
  FROM inserts i JOIN moves m ON m.q = i.p
  UNION ALL SELECT i.q, NULL, m.p, put, 'R' || m.x, 1
  FROM inserts i JOIN moves m ON m.q = i.p WHERE m.x <> 's'
  UNION ALL SELECT q, NULL, p, put, 'D', 2 FROM inserts),
ways AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, 0::BIGINT AS cost, '' AS audit, ''::VARCHAR AS body
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, q, best.cost, best.audit, best.body FROM (
    SELECT w.conv_id, r.i, s.p AS q, min({
      'cost': w.cost + s.cost + 5 * len(s.put)
        + CASE WHEN r.fault = 't' AND s.edit <> 'D' THEN 5 ELSE 0 END,
      'audit': w.audit || repeat('I', len(s.put)) || left(s.edit, 1),
      'body': w.body || replace(replace(s.put, 'u', chr(10) || 'user:'), 'a', chr(10) || 'assistant:')
        || CASE s.edit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || r.role || ':' || r.text
           WHEN 'Ru' THEN chr(10) || 'user:' || r.text ELSE chr(10) || 'assistant:' || r.text END
      }) AS best
    FROM ways w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1
    JOIN steps s ON s.q = w.q AND (s.needs IS NULL OR s.needs = r.first)
      AND (s.edit = 'D' OR r.fault NOT IN ('b', 'd'))
    GROUP BY w.conv_id, r.i, s.p)),
counts AS (
  SELECT conv_id, count(*) AS rows,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (illegal) AS illegal
  FROM rows GROUP BY conv_id),
ends AS (
  SELECT w.conv_id, min({'cost': w.cost + 5 * len(i.put),
    'audit': w.audit || repeat('I', len(i.put)),
    'body': w.body || replace(replace(i.put, 'u', chr(10) || 'user:'), 'a', chr(10) || 'assistant:')
    }) AS best
  FROM ways w LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id
  JOIN inserts i ON i.q = w.q AND i.p IN (0, 3)
  WHERE w.i = coalesce(c.rows, 0) GROUP BY w.conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
  coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, best.cost::BIGINT AS cost, best.audit AS audit,
  sha256(substr(best.body, 2)) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""

ORACLE["op12_collocations"] = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS p, list_filter(string_split_regex(piece, '[\x20\x09]+'),
    lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(
          coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
freq AS (
  SELECT lang, k, phrase, count(*) AS f FROM (
    SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
    FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
          FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k))
  GROUP BY lang, k, phrase HAVING count(*) >= 30),
candidates AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM freq WHERE k >= 2),
cuts AS (
  SELECT lang, phrase, c, array_to_string(w[1 : c], ' ') AS head,
    array_to_string(w[c + 1 :], ' ') AS tail
  FROM (SELECT lang, phrase, w, unnest(generate_series(1, k - 1)) AS c FROM candidates)),
scored AS (
  SELECT x.lang, x.phrase, x.c, h.f AS l, t.f AS r,
    (2000000::HUGEINT * c.a // (h.f::HUGEINT + t.f)) AS score
  FROM cuts x JOIN candidates c ON c.lang = x.lang AND c.phrase = x.phrase
    JOIN freq h ON h.lang = x.lang AND h.phrase = x.head
    JOIN freq t ON t.lang = x.lang AND t.phrase = x.tail),
low AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS place FROM scored),
inside AS (
  SELECT lang, part, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(w[i : i + m - 1], ' ') AS part
    FROM (SELECT lang, a, w, m, unnest(generate_series(1, k - m + 1)) AS i
          FROM candidates, (SELECT unnest([2, 3]) AS m) WHERE m < k)) GROUP BY lang, part),
kept AS (
  SELECT c.lang, c.phrase, c.a, s.l, s.r, s.score FROM candidates c
    JOIN low s ON s.lang = c.lang AND s.phrase = c.phrase AND s.place = 1
    LEFT JOIN inside i ON i.lang = c.lang AND i.part = c.phrase
  WHERE i.longer IS NULL OR 100::HUGEINT * i.longer < 80::HUGEINT * c.a),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC,
    encode(phrase)) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n,
  score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
