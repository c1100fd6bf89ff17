"""Registered queries of the subpackage: each applies one operator, with production
parameters, to its whole table. ``ORACLE`` holds the same in DuckDB SQL where SQL has it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from logsmith.llm.ann import nearest
from logsmith.llm.bpe import with_bpe
from logsmith.llm.chat import format_conversations, read_back
from logsmith.llm.common import shipped, table
from logsmith.llm.decontam import find_contamination
from logsmith.llm.lexical import rank_documents
from logsmith.llm.line_dedup import dedup_lines
from logsmith.llm.merkle import row_hash, verify
from logsmith.llm.quality import COUNTS, judge
from logsmith.llm.simhash import near_duplicates
from logsmith.llm.suffix_dedup import remove_repeats
from logsmith.llm.token_counts import with_token_counts
from logsmith.llm.toxicity import train, with_toxicity
from logsmith.llm.warc import archive_pages

#: Documents of more tokens do not fit the context of the model that is trained.
TOKEN_LIMIT = 2048


def _bytes(text: str):
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counted = with_token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))
    return counted.select(
        "doc_id", _bytes("text").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit")
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"  # control strings inside texts
    more = spark.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    made = format_conversations(talks, public_tokenizers.path("byte_bpe_50k.json"))
    back = made.withColumn("r", read_back(F.col("formatted"), F.col("loss_spans")))
    return back.select(
        "conv_id",
        "r.n_turns",
        "r.turns_sha256",
        "r.loss_chars",
        "r.loss_sha256",
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = near_duplicates(table(spark, sf_dir, "documents"))
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archive_pages(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *COUNTS, "base_failed", "kept")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    coded = with_bpe(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(
        "doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded_text", 256).alias("decoded_sha256")
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    scorer = train(docs, labels.where(~held_out))
    return with_toxicity(docs, scorer).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op11_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), every=20)


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    n_chars = F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    found = row_hash("doc_id", "source", "lang", n_chars, "text")
    return verify(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", found)


_ALL = [
    op1_token_counts,
    op2_line_dedup,
    op3_chat,
    op4_simhash,
    op5_warc,
    op6_quality,
    op7_suffix_dedup,
    op8_bpe,
    op9_toxicity,
    op10_decontamination,
    op11_ann,
    op12_lexical,
    op13_merkle,
]
QUERIES = {query.__name__: shipped(query) for query in _ALL}

ORACLE: dict[str, str] = {
    # equal lines, and from 20 characters on those at one edit: they share the first or the last half of the shorter one
    "op2_line_dedup": r"""
WITH l AS (
  SELECT doc_id, pos, string_split(text, chr(10))[pos] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents)
), said AS (SELECT doc_id, pos, line, length(line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
d AS (
  SELECT line, n, doc_id, pos FROM said
  QUALIFY row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) = 1
), k AS (
  SELECT line, n, doc_id, pos, m, side,
    CASE side WHEN 0 THEN left(line, (m // 2)::INT) ELSE right(line, (m - m // 2)::INT) END AS half
  FROM d, (VALUES (0), (1)) s(side), (VALUES (0), (1)) j(less), LATERAL (SELECT n - less AS m) WHERE n >= 20
), pairs AS (
  SELECT DISTINCT a.line, b.line AS earlier, a.n, b.n AS bn
  FROM k a JOIN k b ON a.m = b.m AND a.side = b.side AND a.half = b.half AND (b.doc_id, b.pos) < (a.doc_id, a.pos)
  WHERE abs(a.n - b.n) <= 1
), met AS (
  SELECT line, earlier, n, bn, coalesce(list_position(list_transform(
    range(1, least(n, bn) + 1), lambda i: substr(line, i, 1) = substr(earlier, i, 1)), false), least(n, bn) + 1) - 1 AS p
  FROM pairs
), near AS (
  SELECT DISTINCT line FROM met
  WHERE CASE WHEN n = bn THEN substr(line, p + 2) = substr(earlier, p + 2)
    WHEN n > bn THEN substr(line, p + 2) = substr(earlier, p + 1) ELSE substr(line, p + 1) = substr(earlier, p + 2) END
), kept AS (
  SELECT l.doc_id, l.pos, l.line,
    NOT regexp_matches(l.line, '[^\x20\x09-\x0D]') OR (d.line IS NOT NULL AND d.line NOT IN (SELECT line FROM near)) AS keep
  FROM l LEFT JOIN d ON d.line = l.line AND d.doc_id = l.doc_id AND d.pos = l.pos
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT keep) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keep), '')) AS text_sha256
FROM kept GROUP BY doc_id
""",
    "op3_chat": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, length(role || text) + length(regexp_replace(role, '(<\|endoftext\|>|</?s>|\[/?INST\]|\\)', 'x\1', 'g'))
    - length(role) + length(regexp_replace(text, '(<\|endoftext\|>|</?s>|\[/?INST\]|\\)', 'x\1', 'g')) - length(text) AS chars
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(chars + 17))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op5_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS hex FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY html) AS first,
    list_aggregate(list_transform(range(1, 41), lambda i: lpad(bin(instr('0123456789abcdef', substr(hex, i, 1)) - 1), 4, '0')),
      'string_agg', '') AS bits
  FROM p
)
SELECT page_id, n AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + list_sum(list_transform(range(0, 5), lambda j: substr(bits, 5 * i + j + 1, 1)::INT << (4 - j)))::INT, 1)), 'string_agg', '')
    AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f
""",
    # strings of 400 bytes by their start and hash; covered runs, and what lies between them
    "op7_suffix_dedup": """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(encode(text), ''::BLOB) AS b FROM documents
), w AS (
  SELECT r, p, md5(b[p:p + 399]) AS h FROM (SELECT r, b, unnest(range(1, octet_length(b) - 398)) AS p FROM d WHERE octet_length(b) >= 400)
), hit AS (
  SELECT r, p FROM w QUALIFY count(*) OVER (PARTITION BY h) > 1
), island AS (
  SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS i
  FROM (SELECT r, p, CASE WHEN p > lag(p) OVER (PARTITION BY r ORDER BY p) + 400 THEN 1 ELSE 0 END AS fresh FROM hit)
), run AS (SELECT r, min(p) AS a, max(p) + 400 AS e FROM island GROUP BY r, i),
gap AS (
  SELECT r, coalesce(lag(e) OVER (PARTITION BY r ORDER BY a), 1) AS a, a - 1 AS e FROM run
  UNION ALL SELECT r, max(e), octet_length(any_value(b)) FROM run JOIN d USING (r) GROUP BY r
), kept AS (
  SELECT r, list_reduce(list(b[a:e] ORDER BY a), lambda x, y: x || y) AS k FROM gap JOIN d USING (r) WHERE a <= e GROUP BY r
), total AS (SELECT r, sum(e - a)::BIGINT AS n_removed, count(*) AS n_spans FROM run GROUP BY r)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN n_spans IS NULL THEN b ELSE coalesce(k, ''::BLOB) END) AS kept_sha256
FROM d LEFT JOIN total USING (r) LEFT JOIN kept USING (r)
""",
    "op10_decontamination": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS size, array_to_string(list_slice(words, p, p + least(10, len(words)) - 1), ' ') AS win
  FROM (SELECT item_id, words, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS p FROM b WHERE len(words) > 0)
), dw AS (
  SELECT doc_id, p, size, array_to_string(list_slice(words, p, p + size - 1), ' ') AS win
  FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS p
    FROM w, (SELECT DISTINCT size FROM bw) WHERE len(words) >= size)
), hits AS (SELECT DISTINCT doc_id, p, dw.size, item_id FROM dw JOIN bw ON dw.size = bw.size AND dw.win = bw.win),
words_hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS k FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT w.doc_id, len(w.words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words_hit USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op12_lexical": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), s AS (SELECT count(*) AS docs, sum(len(words))::BIGINT AS terms FROM d WHERE len(words) > 0),
m AS (
  SELECT r, doc_id, 100 - 75 + ((75 * len(words) * (SELECT docs FROM s)) // (SELECT terms FROM s)) AS m FROM d WHERE len(words) > 0
), i AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL
), tf AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * (SELECT docs FROM s) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf GROUP BY term
), scored AS (
  SELECT item_id, r, sum(w * times * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM i JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY item_id, r
), ranked AS (
  SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score
  FROM scored JOIN m USING (r) WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
""",
    # crc32 by its bits: a byte is mixed in, then eight steps of one bit
    "op13_merkle": """
WITH RECURSIVE d AS (
  SELECT *, 4294967295 - list_reduce(
    flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_concat([ascii(c)::BIGINT], list_transform(range(0, 8), lambda i: -1::BIGINT)))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END, 4294967295::BIGINT) AS crc
  FROM documents
), v AS (
  SELECT doc_id, lang, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS before,
    coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS n,
    CASE WHEN crc % 7 = 0 THEN coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') END AS n_found,
    coalesce(strlen(text) || ':' || text, '-') AS after
  FROM d
), leaves AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, sha256(before || n || after) AS leaf,
    sha256(before || coalesce(n_found, n) || after) AS found
  FROM v
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS size
  FROM leaves
), built AS (
  SELECT tree, 0 AS level, pos, leaf AS h, size FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (size + 1) // 2
  FROM built WHERE size > 1 GROUP BY tree, level, pos // 2, size
), top AS (
  SELECT 0 AS level, tree AS pos, h, count(*) OVER () AS size FROM built WHERE size = 1
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (size + 1) // 2
  FROM top WHERE size > 1 GROUP BY level, pos // 2, size
), climb AS (
  SELECT tree, pos AS home, 0 AS level, pos, '' AS proof, found AS f, size FROM placed
  UNION ALL
  SELECT c.tree, c.home, c.level + 1, c.pos // 2, c.proof || coalesce(b.h, ''),
    sha256(CASE WHEN c.pos % 2 = 1 THEN b.h || c.f ELSE c.f || coalesce(b.h, '') END), (c.size + 1) // 2
  FROM climb c LEFT JOIN built b ON b.tree = c.tree AND b.level = c.level AND b.pos = xor(c.pos, 1) WHERE c.size > 1
), ascent AS (
  SELECT tree, home, 0 AS level, tree AS pos, proof, f, (SELECT max(size) FROM top) AS size FROM climb WHERE size = 1
  UNION ALL
  SELECT c.tree, c.home, c.level + 1, c.pos // 2, c.proof || coalesce(b.h, ''),
    sha256(CASE WHEN c.pos % 2 = 1 THEN b.h || c.f ELSE c.f || coalesce(b.h, '') END), (c.size + 1) // 2
  FROM ascent c LEFT JOIN top b ON b.level = c.level AND b.pos = xor(c.pos, 1) WHERE c.size > 1
)
SELECT p.doc_id, p.leaf, s.h AS subroot, r.h AS root, sha256(a.proof) AS proof_sha256, a.f AS folded_root, a.f = r.h AS verified
FROM placed p JOIN ascent a ON a.tree = p.tree AND a.home = p.pos AND a.size = 1
  JOIN built s ON s.tree = p.tree AND s.size = 1 CROSS JOIN (SELECT h FROM top WHERE size = 1) r
""",
}
