"""The opN_ queries and their SQL; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, license_scan, lm_score, mixing, near_dedup, quality, search, token_store, toxicity
from .common import materialize, table

Query = Callable[[SparkSession, str], DataFrame]


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", both), (-1, 1, "assistant", both)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = chat.read_chat(chat.format_chat(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


_ESCAPE = r"regexp_replace({0}, '([<\[])(&*)(/?s>|/?INST\]|\|[a-z_]+\|>)', '\1&\2\3', 'g')"
OP1_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), o AS (
  SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS opens,
         length({_ESCAPE.format("role")}) AS role_chars, length({_ESCAPE.format("text")}) AS text_chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(text_chars + CASE WHEN opens THEN role_chars + {len(chat.TURN) + len(chat.TEXT) + len(chat.END)} ELSE {len(chat.NEXT)} END)::BIGINT AS formatted_chars
FROM o GROUP BY conv_id
"""


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counts = materialize(lm_score.count_words(docs), "counts")
    vocabulary = lm_score.corpus_vocabulary(docs, counts=counts)
    coded, units = lm_score.encode(docs, vocabulary)
    return lm_score.score_coded(coded, lm_score.train(coded, units, vocabulary), counts)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 9).alias("probability"), "kept")


OP3_SQL = mixing.duckdb_sql()


def op4_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    asked = docs.filter(F.col("doc_id") % 50 == 0).select(F.col("doc_id").alias("query_id"), "text")
    return search.top_k(docs, asked, k=10)


OP4_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents WHERE doc_id IS NOT NULL),
w AS (SELECT r, doc_id, unnest({_WORDS}) AS t FROM d),
n AS (SELECT count(*) AS docs, (SELECT count(*) FROM w) / count(*) AS mean FROM d),
tf AS (SELECT r, doc_id, t, count(*) AS c FROM w GROUP BY ALL),
dl AS (SELECT r, sum(c) AS l FROM tf GROUP BY r),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
q AS (SELECT doc_id AS query_id, t, sum(c) * ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS w FROM tf JOIN df USING (t), n WHERE doc_id % 50 = 0 GROUP BY doc_id, t, docs, df),
s AS (
  SELECT query_id, r, doc_id, round(sum(w * (c * 2.2::DOUBLE / (c + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / mean)))), 6) AS score
  FROM q JOIN tf USING (t) JOIN dl USING (r), n GROUP BY query_id, r, doc_id
), o AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM o WHERE rank <= 10
"""


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


#: Texts of equal words first; all pairs that share a shingle; classes by spreading the least id.
OP5_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
one AS MATERIALIZED (SELECT min(doc_id) AS rep, any_value(w) AS w, CASE WHEN len(w) = 0 THEN text ELSE array_to_string(w, ' ') END AS body, len(w) = 0 AS bare FROM d WHERE doc_id IS NOT NULL GROUP BY body, bare),
g AS (SELECT rep, unnest(CASE WHEN len(w) < 5 THEN [body] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM one WHERE NOT bare),
b AS MATERIALIZED (SELECT rep, g, count(*) AS c FROM g GROUP BY ALL),
n AS (SELECT rep, sum(c) AS n FROM b GROUP BY rep),
links AS MATERIALIZED (
  SELECT x, y FROM (SELECT p.rep AS x, q.rep AS y, sum(least(p.c, q.c)) AS common FROM b p JOIN b q ON p.g = q.g AND p.rep < q.rep GROUP BY ALL) JOIN n s ON s.rep = x JOIN n t ON t.rep = y
  WHERE common >= 0.8 * (s.n + t.n - common) - 1e-9
), e AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT rep AS a, rep AS z FROM one UNION SELECT reach.a, e.y FROM reach JOIN e ON e.x = reach.z),
root AS (SELECT a AS rep, min(z) AS class_id FROM reach GROUP BY a)
SELECT d.doc_id, root.class_id FROM d LEFT JOIN one ON d.doc_id IS NOT NULL AND one.bare = (len(d.w) = 0) AND one.body = CASE WHEN len(d.w) = 0 THEN d.text ELSE array_to_string(d.w, ' ') END LEFT JOIN root USING (rep)
"""


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.match_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP6_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item_id, {_WORDS} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, p, p + least(len(w), 10) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM i WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT r, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)
), m AS (SELECT dw.r, dw.n, dw.p, iw.item_id FROM dw JOIN iw USING (n, g)),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM m) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(hit.n_hit, 0)::BIGINT AS n_hit, coalesce(its.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"), license_scan.templates(spark), threshold=0.8)
    return found.select("doc_id", "license_id", "n_starts", F.round("dice", 9).alias("dice"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    network = quality.fit(docs, table(spark, sf_dir, "labels"), where=~held_out)
    return quality.score(docs, network).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


_TEMPLATES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in license_scan.TEMPLATES)
_PLAIN = r"trim(regexp_replace(lower(coalesce({0}, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'))"
OP8_SQL = f"""
WITH t AS (SELECT license_id, string_split({_PLAIN.format("text")}, ' ') AS w FROM (VALUES {_TEMPLATES}) AS v(license_id, text)),
tg AS (SELECT license_id, m, g, count(*) AS wanted FROM (SELECT license_id, len(w) - 1 AS m, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM t) GROUP BY ALL),
d AS (SELECT row_number() OVER () AS r, doc_id, string_split({_PLAIN.format("text")}, ' ') AS w FROM documents),
b AS (SELECT r, doc_id, unnest(range(1, len(w))) AS p, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM d),
e AS MATERIALIZED (SELECT r, doc_id, license_id, m, p, g, wanted FROM b JOIN tg USING (g)),
runs AS (SELECT x.r, x.doc_id, x.license_id, x.m, x.p AS start, y.p, row_number() OVER (PARTITION BY x.r, x.license_id, x.p, y.g ORDER BY y.p) <= y.wanted AS counts
         FROM e x JOIN e y ON x.r = y.r AND x.license_id = y.license_id AND y.p BETWEEN x.p AND x.p + x.m * 1.5 - 1),
s AS (SELECT *, 2 * sum(counts::INT) OVER (PARTITION BY r, license_id, start ORDER BY p) / (m + p - start + 1)::DOUBLE AS dice FROM runs),
best AS (SELECT doc_id, r, license_id, start, max(dice) AS dice FROM s GROUP BY ALL HAVING max(dice) >= 0.8)
SELECT doc_id, license_id, count(*) AS n_starts, round(max(dice), 9) AS dice FROM best GROUP BY doc_id, license_id
"""


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.write_tokens(table(spark, sf_dir, "documents"), end_id=0)
    return token_store.token_index(spark, path)


QUERIES: dict[str, Query] = {"op1_chat_format": op1_chat_format, "op2_lm_score": op2_lm_score, "op3_source_mixing": op3_source_mixing, "op4_bm25_search": op4_bm25_search, "op5_near_dedup": op5_near_dedup, "op6_decontamination": op6_decontamination, "op7_quality_classifier": op7_quality_classifier, "op8_license_scan": op8_license_scan, "op9_toxicity": op9_toxicity, "op10_token_output": op10_token_output}
ORACLE_SQL: dict[str, str] = {"op1_chat_format": OP1_SQL, "op3_source_mixing": OP3_SQL, "op4_bm25_search": OP4_SQL, "op5_near_dedup": OP5_SQL, "op6_decontamination": OP6_SQL, "op8_license_scan": OP8_SQL}
