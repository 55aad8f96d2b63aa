"""The named queries of this subpackage: each applies one operator to its whole table and derives the digest columns of
its contract from the operator's real output. ``SQL`` has the DuckDB counterpart where SQL can express the result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pegwatch.llm import chat, decontaminate, language_id, lexical, line_dedup, maxscore, near_dedup, pii, secret_scan, sentencepiece_codec, spelling, token_counts, token_frames
from pegwatch.llm.common import table, tokenizer_file
from pegwatch.llm.spans import counted, joined
from pegwatch.session import cut, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentencepiece_codec.encode_decode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op2_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/token-frames-{uuid.uuid4().hex}"
    token_frames.write_shards(table(spark, sf_dir, "documents"), folder, tokenizer_file("byte_bpe_50k.json"), end_id=2)
    read = token_frames.read_shards(spark, folder)
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


@query
def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", "kept")


@query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL["op3_decontaminate"] = r"""
WITH split AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), items AS (
  SELECT id AS item_id, words, least(len(words), 13) AS size FROM split WHERE kind = 'b' AND len(words) > 0
), grams AS (
  SELECT DISTINCT item_id, size, list_slice(words, i, i + size - 1) AS gram FROM items, unnest(range(1, len(words) - size + 2)) AS t(i)
), places AS (
  SELECT id AS doc_id, s.size, i, list_slice(words, i, i + s.size - 1) AS gram
  FROM split, (SELECT DISTINCT size FROM items) s, unnest(range(1, len(words) - s.size + 2)) AS t(i) WHERE kind = 'd'
), hits AS (
  SELECT doc_id, i, p.size, item_id FROM places p JOIN grams g ON p.gram = g.gram
), counted AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(0, size)) AS u(k) GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.id AS doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM split d LEFT JOIN counted c ON c.doc_id = d.id LEFT JOIN listed l ON l.doc_id = d.id WHERE kind = 'd'
"""


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "lines_removed", "emptied", F.sha2("text", 256).alias("text_sha256"))


SQL["op4_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(13)) AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
), worded AS (
  SELECT *, length(line) - length(replace(line, ' ', '')) + 1 AS words FROM lines WHERE line <> ''
), placed AS (
  SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS after FROM worded
), ahead AS (
  SELECT doc_id, pos AS lo, max(pos) OVER w AS hi, list(line) OVER w AS body, sum(words) OVER w AS total FROM placed
  WINDOW w AS (PARTITION BY doc_id ORDER BY after - words RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
), back AS (
  SELECT doc_id, min(pos) OVER w AS lo, pos AS hi, list(line) OVER w AS body, sum(words) OVER w AS total FROM placed
  WINDOW w AS (PARTITION BY doc_id ORDER BY after RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)
), windows AS (
  SELECT * FROM ahead WHERE total >= 50 UNION SELECT * FROM back WHERE total >= 50
), ranked AS (
  SELECT *, first_value(doc_id) OVER w AS first_doc, first_value(hi) OVER w AS first_hi FROM windows WINDOW w AS (PARTITION BY body ORDER BY doc_id, lo)
), gone AS (
  SELECT DISTINCT r.doc_id, w.pos FROM ranked r JOIN worded w ON w.doc_id = r.doc_id AND w.pos BETWEEN r.lo AND r.hi WHERE first_doc <> r.doc_id OR first_hi < lo
), marked AS (
  SELECT doc_id, list(pos) AS gone FROM gone GROUP BY doc_id
), left_over AS (
  SELECT d.doc_id, coalesce(len(gone), 0) AS lines_removed, text, gone,
         list_filter(list_zip(string_split(text, chr(10)), range(0, len(string_split(text, chr(10))))), lambda x: NOT list_contains(gone, x[2])) AS kept
  FROM documents d LEFT JOIN marked m ON m.doc_id = d.doc_id
), judged AS (
  SELECT *, gone IS NOT NULL AND NOT coalesce(list_bool_or(list_transform(kept, lambda x: trim(x[1], ' ' || chr(9) || chr(13)) <> '')), false) AS emptied FROM left_over
)
SELECT doc_id, lines_removed, emptied,
       sha256(CASE WHEN gone IS NULL THEN text WHEN emptied THEN '' ELSE array_to_string(list_transform(kept, lambda x: x[1]), chr(10)) END) AS text_sha256
FROM judged
"""


@query
def op5_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


SQL["op5_maxscore"] = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 5
"""


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    return language_id.predict(docs, model).select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "response")


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    counts = [counted(F.col("base"), k).alias(f"n_{k}") for k in secret_scan.KINDS]
    return out.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query
def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_personal_data(table(spark, sf_dir, "documents"))
    counts = [counted(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS]
    return out.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


SQL["op11_spelling"] = r"""
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents) WHERE length(run) >= 7
), bytes AS (
  SELECT id, run, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [192 | (ord(c) >> 6), 128 | (ord(c) & 63)] END)) AS b FROM runs
), hashed AS (
  SELECT run, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(b, lambda x: list_prepend(CAST(x AS BIGINT), [-1, -1, -1, -1, -1, -1, -1, -1])))),
         lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END)) AS h FROM bytes
), counted AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, count(*) AS n FROM hashed GROUP BY 1
), words AS (
  SELECT * FROM counted WHERE n >= 2 AND length(word) >= 7
), holes AS (
  SELECT DISTINCT word, n, i, left(word, i - 1) || substr(word, i + 1) AS hole FROM words, unnest(range(1, length(word) + 1)) AS t(i)
), pairs AS (
  SELECT x.word, y.word AS other, y.n AS m FROM holes x JOIN holes y ON x.i = y.i AND x.hole = y.hole AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM holes x JOIN words y ON x.hole = y.word
  UNION SELECT y.word, x.word, x.n FROM holes x JOIN words y ON x.hole = y.word
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM pairs GROUP BY word
), formed AS (
  SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word
), path AS (
  SELECT word, word AS at FROM formed UNION ALL SELECT p.word, f.form FROM path p JOIN formed f ON f.word = p.at WHERE f.form IS NOT NULL
), roots AS (
  SELECT p.word, p.at AS root FROM path p JOIN formed f ON f.word = p.at WHERE f.form IS NULL
)
SELECT f.word, form, root, n, n_near, form_n FROM formed f JOIN roots r ON r.word = f.word
"""


@query
def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op13_lexical"] = r"""
WITH split AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
), asked AS (
  SELECT item, item_id, term, count(*) AS repeats FROM (
    SELECT item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT item_id, text, row_number() OVER () AS item FROM (SELECT DISTINCT item_id, text FROM benchmark))) GROUP BY ALL
), lengths AS (
  SELECT row, doc_id, CAST(len(words) AS BIGINT) AS n FROM split WHERE len(words) > 0
), totals AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS l FROM lengths
), tf AS (
  SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(words) AS term FROM split) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, totals GROUP BY term, docs
), gains AS (
  SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // l))) AS gain FROM tf JOIN weights USING (term) JOIN lengths USING (row), totals
), scored AS (
  SELECT item, item_id, doc_id, CAST(sum(repeats * gain) AS BIGINT) AS score FROM gains JOIN asked USING (term) GROUP BY item, item_id, row, doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 20
"""


@query
def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    own = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    formatted = cut(chat.format_chats(given.select("conv_id", "turn", "role", "text").unionByName(own)), "chats")
    return chat.digests(formatted)


SQL["op12_chat"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
), marked AS (
  SELECT *, regexp_replace(regexp_replace(text, '<(\\*/?s>)', '<\\\1', 'g'), '\[(\\*/?INST\])', '[\\\1', 'g') AS escaped,
         regexp_replace(regexp_replace(role, '<(\\*/?s>)', '<\\\1', 'g'), '\[(\\*/?INST\])', '[\\\1', 'g') AS named FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(escaped) + length(named) + 22) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
