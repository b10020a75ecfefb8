"""The corpus operators' queries over whole tables, and SQL twins where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, langid, neardup, packing, pii, suffixdedup, topk, toxicity, url_reputation
from .common import secret, table
from .sampling import held_out
from .url_reputation import TWO_LABEL_SUFFIXES

CONTROL_TURN = "<|im_end|><|im_start|>assistant ok"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digested(packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")).drop("bad_bound")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantized(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors.filter("id % 50 = 0"), vectors, 5)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.predicted(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TURN).alias("text"))
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.segments(own.unionByName(extra)))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.marked(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymized(table(spark, sf_dir, "documents"), secret(spark)).select("doc_id", "text", "n_pseudonyms")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffixdedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, span: n + span["stop"] - span["start"])
    return left.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_url_filters, op3_topk, op4_language, op5_chat, op6_decontamination, op7_toxicity, op8_pii, op9_near_duplicates, op10_substring_dedup)}

_ESCAPED = r"length({0}) + len(regexp_extract_all({0}, '<\\*\|'))"

OP2_SQL = rf"""
WITH p AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
h AS (SELECT page_id,
             translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(u, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM p),
l AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END) AS is_bad
      FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
hosts AS (SELECT host, count(is_bad) AS seen, coalesce(sum(is_bad), 0) AS bad FROM h LEFT JOIN l USING (page_id) GROUP BY 1),
bare AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS b FROM hosts),
named AS (SELECT *, string_split(b, '.') AS n, list_contains({list(TWO_LABEL_SUFFIXES)}, array_to_string(string_split(b, '.')[-2:], '.')) AS listed,
                 regexp_matches(b, '^[0-9.]+$|^\[') OR NOT contains(b, '.') AS plain FROM bare),
lev AS (SELECT host, seen, bad, CASE WHEN plain THEN b ELSE array_to_string(CASE WHEN listed THEN n[-3:] ELSE n[-2:] END, '.') END AS domain,
               CASE WHEN plain THEN '' WHEN listed THEN n[-2] || '.' || n[-1] ELSE n[-1] END AS suffix FROM named),
doms AS (SELECT domain, suffix, sum(seen) AS seen, sum(bad) AS bad FROM lev GROUP BY 1, 2),
sufs AS (SELECT suffix, sum(seen) AS seen, sum(bad) AS bad FROM doms GROUP BY 1),
r AS (SELECT (coalesce(sum(bad), 0) + 1.0::DOUBLE) / (coalesce(sum(seen), 0) + 2.0::DOUBLE) AS rate FROM sufs),
g AS (SELECT 'suffix' AS level, seen, bad FROM sufs UNION ALL SELECT 'domain', seen, bad FROM doms UNION ALL SELECT 'host', seen, bad FROM lev),
m AS (SELECT level, rate * (1 - rate) AS noise, count(*) AS n, sum(seen)::DOUBLE AS al, sum(seen * seen)::DOUBLE AS sq,
             sum(seen * (bad / seen::DOUBLE - rate) * (bad / seen::DOUBLE - rate)) AS spread FROM g, r WHERE seen > 0 GROUP BY level, rate),
b AS (SELECT level, noise, CASE WHEN n < 2 OR al <= sq / al THEN 0 ELSE (spread - (n - 1) * noise) / (al - sq / al) END AS between_ FROM m),
k AS (SELECT max(CASE WHEN level = 'suffix' THEN w END) AS over_, max(CASE WHEN level = 'domain' THEN w END) AS mid, max(CASE WHEN level = 'host' THEN w END) AS low
      FROM (SELECT level, CASE WHEN between_ > 0 THEN least(1000.0::DOUBLE, greatest(1.0::DOUBLE, noise / between_ - 1)) ELSE 1000.0::DOUBLE END AS w FROM b)),
ps AS (SELECT suffix, (bad + coalesce(over_, 1000) * rate) / (seen + coalesce(over_, 1000)) AS srate FROM sufs, r, k),
pd AS (SELECT domain, suffix, (bad + coalesce(mid, 1000) * srate) / (seen + coalesce(mid, 1000)) AS drate FROM doms JOIN ps USING (suffix), k),
ph AS (SELECT host, bad + coalesce(low, 1000) * drate AS a, seen - bad + coalesce(low, 1000) * (1 - drate) AS b FROM lev JOIN pd USING (domain, suffix), k),
v AS (SELECT page_id, host, path, a / (a + b) - 1.645::DOUBLE * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM h JOIN ph USING (host)),
f AS (SELECT *, (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') AS f1,
             (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') AS f2,
             (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') AS f3,
             (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') AS f4 FROM v)
SELECT page_id, host, path,
       CASE WHEN f3 THEN 'example.com/de/' WHEN f2 THEN 'example.net/en/' WHEN f4 THEN 'org/fr/' WHEN f1 THEN 'net/' END AS rule,
       CASE WHEN f3 THEN 'block' WHEN f2 THEN 'allow' WHEN f4 THEN 'allow' WHEN f1 THEN 'block' WHEN bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM f
"""

OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

OP5_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '{CONTROL_TURN}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TURN}'),
o AS (SELECT *, coalesce(lag(role) OVER w, 'begin') AS before_, lead(role) OVER w AS after_ FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
c AS (SELECT *, (before_ || '>' || role) IN ('begin>system', 'begin>user', 'system>user', 'user>assistant', 'assistant>user', 'assistant>tool', 'tool>tool', 'tool>assistant')
                AND (after_ IS NOT NULL OR role = 'assistant') AS good,
             replace(replace(role, '\\', '\\\\'), chr(10), '\\n') AS named FROM o)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(12 + 1 + 11 + {_ESCAPED.format('named')} + {_ESCAPED.format('text')})::BIGINT AS formatted_chars,
       bool_and(good) AS valid
FROM c GROUP BY conv_id
"""

OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
s AS (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS x, count(*) AS n FROM w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS t(i) GROUP BY ALL),
t AS (SELECT doc_id, sum(n) AS n FROM s GROUP BY ALL),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS n FROM s a JOIN s b USING (x) WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN t x ON x.doc_id = p.a JOIN t y ON y.doc_id = p.b WHERE p.n >= 0.8 * (x.n + y.n - p.n)),
d AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS class_id FROM documents UNION SELECT d.b, r.class_id FROM r JOIN d ON d.a = r.doc_id)
SELECT doc_id, min(class_id) AS class_id FROM r GROUP BY doc_id
"""

OP10_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, p, array_to_string(w[p:p + 49], ' ') AS k FROM w, unnest(range(1, greatest(len(w) - 48, 1))) AS t(p)),
f AS (SELECT k, min(doc_id) AS least_ FROM s GROUP BY k),
g AS (SELECT DISTINCT doc_id, p + i AS p FROM s JOIN f USING (k), unnest(range(0, 50)) AS t(i) WHERE doc_id > least_),
o AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM w),
k AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS kept FROM o ANTI JOIN g USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""

ORACLES = {"op2_url_filters": OP2_SQL, "op3_topk": OP3_SQL, "op5_chat": OP5_SQL, "op9_near_duplicates": OP9_SQL, "op10_substring_dedup": OP10_SQL}
