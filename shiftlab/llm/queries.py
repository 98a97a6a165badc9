"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlab.llm import (ann, collocations, cross_alignment, exact_dedup, html_text, mixing, near_dedup, packing,
                          quality, substring_dedup, token_files, toxicity, url_filter)
from shiftlab.llm.common import table

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return deco



@register("op1_token_files")
def q_token_files(spark, d) -> DataFrame:
    folder, manifest = token_files.write_token_files(table(spark, d, "documents"))
    return token_files.read_token_files(folder, manifest)


@register("op2_minhash_near_dedup")
def q_near_dedup(spark, d) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, d, "documents"), width=4, share=(80, 100))


@register("op3_best_fit_packing")
def q_packing(spark, d) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), capacity=4096, end_id=1)


@register("op7_exact_dedup", """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM d JOIN g USING (text_sha256)""")
def q_exact_dedup(spark, d) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, d, "documents"))


@register("op8_toxicity_grammar")
def q_toxicity(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    return toxicity.score_toxicity(docs, toxicity.learn(docs, table(spark, d, "labels")))


@register("op6_quality_cnn")
def q_quality(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    return quality.score_quality(docs, quality.learn(docs, table(spark, d, "labels")))


@register("op4_html_extraction")
def q_html_text(spark, d) -> DataFrame:
    return html_text.main_text(table(spark, d, "pages"))


URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@register("op5_url_filters", """
WITH p AS (SELECT page_id, CASE WHEN position('://' IN url) > 0
                  THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM p),
u AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM q),
r AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
                            ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) v(verdict, h, s)),
f AS (SELECT page_id, host, path,
             (SELECT max(struct_pack(n := length(h || s), rule := h || s, verdict := verdict)) FROM r
              WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s)) AS best FROM u)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM f""")
def q_url_filters(spark, d) -> DataFrame:
    return url_filter.judge_urls(table(spark, d, "pages"), URL_RULES)


_TOPIC = "CASE WHEN contains(text, 'Licensed under') OR contains(text, 'Copyright') THEN 'legal' " \
         "WHEN contains(text, '@') THEN 'contact' ELSE 'general' END"


@register("op9_mixing", f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, {_TOPIC} AS topic,
    greatest(ceil(strlen(coalesce(text, '')) / 4), 1)::BIGINT AS n_tokens FROM documents),
c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL),
s AS (SELECT source, p / sum(p) OVER () AS share FROM (SELECT source, pow(sum(tokens), 0.7) AS p FROM c GROUP BY 1)),
l AS (SELECT lang, p / sum(p) OVER () AS share FROM (SELECT lang, pow(sum(tokens), 0.9) AS p FROM c GROUP BY 1)),
t AS (SELECT topic, p / sum(p) OVER () AS share FROM (SELECT topic, sum(tokens) AS p FROM c GROUP BY 1)),
r AS (SELECT 0 AS i, source, lang, topic, tokens, tokens / sum(tokens) OVER () AS w,
             s.share AS ts, l.share AS tl, t.share AS tt
      FROM c JOIN s USING (source) JOIN l USING (lang) JOIN t USING (topic)
      UNION ALL
      SELECT i + 1, source, lang, topic, tokens,
             CASE i % 3 WHEN 0 THEN w * ts / sum(w) OVER (PARTITION BY source)
                        WHEN 1 THEN w * tl / sum(w) OVER (PARTITION BY lang)
                        ELSE w * tt / sum(w) OVER (PARTITION BY topic) END, ts, tl, tt
      FROM r WHERE i < 180),
f AS (SELECT source, lang, topic, w * sum(tokens) OVER () / tokens AS factor FROM r WHERE i = 180),
g AS (SELECT *, factor / max(factor) OVER () AS probability FROM f)
SELECT doc_id, source, lang, topic, n_tokens, round(factor, 6) AS factor, round(probability, 6) AS probability,
       ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':0'), 1, 13))::BIGINT / pow(16, 13) < probability AS selected
FROM d JOIN g USING (source, lang, topic)""")
def q_mixing(spark, d) -> DataFrame:
    out = mixing.mix_documents(table(spark, d, "documents"))
    return out.withColumn("factor", F.round("factor", 6)).withColumn("probability", F.round("probability", 6))


@register("op10_multiprobe_ann")
def q_nearest(spark, d) -> DataFrame:
    return ann.nearest(table(spark, d, "embeddings"), k=20, every=20)


@register("op11_cross_alignment")
def q_cross_alignment(spark, d) -> DataFrame:
    return cross_alignment.align_tokenizers(table(spark, d, "documents"))


@register("op12_substring_dedup", r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS rid,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT rid, doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t),
h AS (SELECT rid, i, w[i] AS word,
             CASE WHEN i + 34 <= len(w) THEN md5(array_to_string(w[i:i + 34], ' ')) END AS win FROM p),
r AS (SELECT rid, i, word, win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1 AS again FROM h),
c AS (SELECT rid, i, word, bool_or(again) OVER (PARTITION BY rid ORDER BY i
                                                ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM r),
k AS (SELECT rid, count(*) FILTER (WHERE gone) AS n_removed,
             string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN k USING (rid)""")
def q_substring_dedup(spark, d) -> DataFrame:
    out = substring_dedup.remove_repeated_passages(table(spark, d, "documents"), length=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@register("op13_collocations", r"""
WITH s AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
                    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM s),
g AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i
      FROM w, (SELECT unnest(range(1, 5)) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*)::BIGINT AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
q AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE a >= 30),
c AS (SELECT * FROM q WHERE k > 1),
cuts AS (SELECT lang, phrase, a, k, w, unnest(range(1, k)) AS cut FROM c),
parts AS (SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS p1, array_to_string(w[cut + 1:k], ' ') AS p2 FROM cuts),
scored AS (SELECT x.lang, x.phrase, x.a, cut, y.a AS l, z.a AS r,
                  ((2000000::HUGEINT * x.a) // (y.a::HUGEINT + z.a))::BIGINT AS score
           FROM parts x JOIN q y ON y.lang = x.lang AND y.phrase = p1 JOIN q z ON z.lang = x.lang AND z.phrase = p2),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nr FROM scored),
ins AS (SELECT lang, a, w, k, m, unnest(range(1, k - m + 2)) AS i
        FROM c, (SELECT unnest(range(2, 4)) AS m) WHERE m < k),
held AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM ins GROUP BY ALL),
kept AS (SELECT b.lang, b.phrase, b.a, b.l, b.r, b.score FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.phrase = b.phrase
         WHERE nr = 1 AND (longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * b.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000""")
def q_collocations(spark, d) -> DataFrame:
    return collocations.collocations(table(spark, d, "documents"), least=30, longest=4, top=2000)
