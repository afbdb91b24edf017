"""Registered queries of the training-data operators, and their SQL where SQL can express them.

Every query applies its operator with production parameters to its whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltcast.llm.url_filter import TRACKING


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL; the list stands for one of ad pages: URLs of the pages whose HTML has an ad block."""
    from voltcast.llm import url_filter
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    listed = pages.where(F.col("html").contains('class="ad"')).select("url")
    return url_filter.judge(pages.select("page_id", "url"), listed, URL_RULES)


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document under a model of the documents that are not held out."""
    from voltcast.llm import lm_score
    docs = _docs(spark, sf_dir).select("doc_id", "text", (_remainder(10) != 0).alias("training"))
    return lm_score.score(docs, "training").select(
        "doc_id", F.coalesce(_remainder(10) == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and the verdict of the rule cascade."""
    from voltcast.llm import quality_rules
    return quality_rules.judge(_docs(spark, sf_dir))


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item, replaced words tolerated; one row per document and item."""
    from voltcast.llm import decontam
    return decontam.overlaps(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from labels outside the held-out fifth."""
    from voltcast.llm import quality_model
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    out = quality_model.classify(_docs(spark, sf_dir), labels, _remainder(5) != 0)
    return out.select("doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle-set size and near-duplicate component of every document."""
    from voltcast.llm import jaccard_join
    return jaccard_join.components(_docs(spark, sf_dir))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base counts, base digest and all spans."""
    from voltcast.llm import pii
    return pii.digests(pii.find(_docs(spark, sf_dir)))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the lines that repeat elsewhere, or earlier in it, taken out."""
    from voltcast.llm import line_dedup
    return line_dedup.dedup(_docs(spark, sf_dir)).select("doc_id", "text", "n_removed")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BPE ids of every document and the text decoded from them, as digests."""
    import public_tokenizers

    from voltcast.llm import bpe
    return bpe.encoded_digests(bpe.encode(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from labels outside the held-out quarter."""
    from voltcast.llm import toxicity
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    out = toxicity.classify(_docs(spark, sf_dir), labels, _remainder(4) != 2)
    return out.select("doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), "score", "predicted", "n_abusive", "n_quoted")


def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte alignment of two tokenizers over every document, with corpus-wide counts of linked ids."""
    import public_tokenizers

    from voltcast.llm import token_align
    return token_align.digests(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one whose texts look like control strings, formatted and read back."""
    from voltcast.llm import chat_format
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, i, role, CONTROL_TEXT) for i, role in enumerate(["user", "assistant"])], "conv_id long, turn long, role string, text string")
    rows = turns.unionByName(own).withColumn("parts", chat_format.text_part(F.coalesce("text", F.lit(""))))
    return chat_format.read_back(rows)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest-scoring documents of every benchmark item."""
    from voltcast.llm import ranked_search
    return ranked_search.search(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_lm_score, op3_quality_rules, op4_decontam, op5_quality_model, op6_jaccard_join, op7_pii, op8_line_dedup, op9_bpe, op10_toxicity,
                                 op11_token_align, op12_chat_format, op13_ranked_search)}
_CANONICAL = """
    CASE WHEN contains(url, '://') THEN
      regexp_replace(regexp_replace(host, '^(www|m)\\.', ''), ':(80|443)$', '')
      || regexp_replace(regexp_replace(path, '(/index)?\\.html?$', ''), '/+$', '')
      || CASE WHEN len(params) > 0 THEN '?' || array_to_string(list_sort(params), '&') ELSE '' END END"""
SQL: dict[str, str] = {
    "op1_url_filter": f"""
WITH cut AS (
  SELECT page_id, url, html,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(?:\\?([^#]*))?', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(?:\\?([^#]*))?', 2), '') AS path,
         list_filter(string_split(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(?:\\?([^#]*))?', 3), ''), '&'),
                     lambda x: x <> '' AND NOT list_contains({TRACKING!r}, split_part(x, '=', 1))) AS params
  FROM pages),
named AS (SELECT page_id, host, path, html, {_CANONICAL} AS canonical FROM cut),
listed AS (SELECT DISTINCT canonical AS entry FROM named WHERE canonical IS NOT NULL AND contains(html, 'class="ad"')),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM named)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN entry IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, canonical
FROM ruled LEFT JOIN listed ON canonical = entry""",
    "op3_quality_rules": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM t),
tok AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
runs AS (SELECT doc_id, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o
                || ' ' || lead(w, 5) OVER o || ' ' || lead(w, 6) OVER o || ' ' || lead(w, 7) OVER o AS g, (lag(w) OVER o = w)::INT AS same
         FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM runs WHERE g IS NOT NULL),
stut AS (SELECT doc_id, sum(same) AS same FROM runs GROUP BY doc_id),
cover AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS place FROM again WHERE n > 1) GROUP BY doc_id),
c AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
             coalesce(cover.n, 0) AS n_repeat_words, len(ls) AS n_lines,
             length(regexp_replace(text, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(text, '[^a-z]', '', 'g')) AS low,
             length(regexp_replace(text, '[^!?]', '', 'g')) AS marks, length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits,
             length(regexp_replace(text, '[^|]', '', 'g')) AS bars,
             coalesce(stut.same, 0) AS same
      FROM w LEFT JOIN cover ON w.doc_id = cover.doc_id LEFT JOIN stut ON w.doc_id = stut.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > word_chars OR up > low OR 3 * marks > n_words OR 2 * digits > word_chars
            OR word_chars < 2 * n_words OR word_chars > 18 * n_words OR (n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines)
            OR 5 * bars > n_words OR 5 * same > n_words) AS kept
FROM b""",
    "op4_decontam": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM benchmark),
it AS (SELECT item_id, len(ws) AS n, least(len(ws), 13) AS span, unnest(ws) AS w, unnest(range(len(ws))) AS q FROM i WHERE len(ws) >= 5),
dt AS (SELECT doc_id, len(ws) AS m, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM d),
eq AS (SELECT doc_id, item_id, m, n, span, p - q AS shift, p FROM dt JOIN it USING (w)),
diag AS (SELECT doc_id, item_id, m, n, span, shift, count(*) AS n_matched, list(p) AS ps FROM eq GROUP BY ALL HAVING 4 * count(*) >= 3 * span),
win AS (SELECT *, unnest(range(greatest(shift, 0), least(shift + n, m) - span + 1)) AS place FROM diag),
hit AS (SELECT doc_id, item_id, n, n_matched, span, shift, place, len(list_filter(ps, lambda x: x >= place AND x < place + span)) AS inside FROM win),
best AS (SELECT doc_id, item_id, n, n_matched, shift, span, max(inside) AS top, arg_min(place, (-inside, place)) AS start_word FROM hit GROUP BY ALL)
SELECT doc_id, item_id, arg_max(start_word, (n_matched, -start_word)) AS start_word, max(n_matched) AS n_matched, n AS n_item
FROM best WHERE 4 * top >= 3 * span GROUP BY doc_id, item_id, n""",
    "op6_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))
                          WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS g FROM w),
t AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT reach.x, p.y FROM reach JOIN p ON reach.y = p.x)
SELECT s.doc_id, len(g) AS n_shingles, c.component_id
FROM s JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON s.doc_id = c.x""",
    "op12_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) x(i, r))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|turn|>' || '<|body|>' || '<|end|>') + length(replace(replace(role, '\', '\\'), '|', '\|'))
           + length(replace(replace(text, '\', '\\'), '|', '\|')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id""",
    "op13_ranked_search": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents WHERE text IS NOT NULL),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
g AS (SELECT count(*) FILTER (len(ws) > 0)::BIGINT AS n_docs, sum(len(ws))::BIGINT AS n_terms FROM d),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
df AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, g GROUP BY term, n_docs),
m AS (SELECT r, doc_id, 100 - 90 + ((90 * len(ws)::BIGINT * n_docs) // n_terms) AS m FROM d, g WHERE len(ws) > 0),
s AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM tf JOIN i USING (term) JOIN df USING (term) JOIN m USING (r) GROUP BY ALL),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM o WHERE rank <= 10""",
}
