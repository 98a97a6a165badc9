"""DuckDB SQL for every registered query (the correctness oracle).

The fixture CTEs restate ``shiftlab.sources.fixtures`` in DuckDB SQL; each
oracle query is ``WITH <fixtures it needs> <query>``. Real-valued results are
rounded to 6 decimals on both sides (summation order differs by engine).
"""

from __future__ import annotations

# --- fixture CTEs -----------------------------------------------------------

FX = {}

FX["fx1"] = """fx1 AS (
  SELECT 'embeddings' AS dataset,
    CASE WHEN vec_id % 8 = 5 THEN 'val'
         WHEN vec_id % 8 IN (6, 7) THEN 'test'
         WHEN (vec_id // 8) % 10 = 8 THEN 'id_val'
         WHEN (vec_id // 8) % 10 = 9 THEN 'id_test'
         ELSE 'train' END AS split,
    vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS features, label AS y_true,
    CAST(vec_id % 8 AS INTEGER) AS domain
  FROM embeddings)"""

FX["fx1_long"] = """fx1_long AS (
  SELECT item_id, split, y_true, domain, UNNEST(features) AS x,
         UNNEST(range(1, len(features) + 1)) AS pos
  FROM fx1)"""

FX["fx2"] = """fx2 AS (
  SELECT class_id, list(v ORDER BY pos) AS vec FROM (
    SELECT y_true AS class_id, pos, avg(x) AS v FROM fx1_long WHERE split = 'train'
    GROUP BY y_true, pos) GROUP BY class_id)"""

# contrastive scores: 100 * cosine(item, class)
FX["fx12"] = """fx12 AS (
  SELECT f.item_id, f.split, f.domain, f.y_true, c.class_id,
         100.0 * list_dot_product(f.features, c.vec)
           / (sqrt(list_dot_product(f.features, f.features)) * sqrt(list_dot_product(c.vec, c.vec))) AS score
  FROM fx1 f, fx2 c)"""

FX["fx12_pred"] = """fx12_pred AS (
  SELECT item_id, split, domain, y_true, CAST(arg_max(class_id, score) AS INTEGER) AS y_pred
  FROM fx12 GROUP BY item_id, split, domain, y_true)"""

FX["fx3"] = """fx3 AS (
  SELECT CAST(r.run AS INTEGER) AS run,
    CASE WHEN year(o.o_orderdate) <= 1997 THEN
           CASE WHEN o.o_orderkey % 10 = 8 THEN 'id_val' WHEN o.o_orderkey % 10 = 9 THEN 'id_test' ELSE 'train' END
         WHEN year(o.o_orderdate) <= 1999 THEN 'val' ELSE 'test' END AS split,
    o.o_orderkey AS item_id,
    CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) - 1 AS y_true,
    CASE WHEN (o.o_orderkey * 7 + o.o_custkey * 3 + r.run * 11) % 10 < 6
         THEN CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) - 1
         ELSE CAST((o.o_custkey + r.run) % 5 AS INTEGER) END AS y_pred,
    CAST(n.n_regionkey AS INTEGER) AS domain,
    c.c_mktsegment AS segment,
    CAST(c.c_nationkey AS INTEGER) AS nation
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey, (SELECT range AS run FROM range(3)) r)"""

FX["fx4"] = """fx4 AS (
  SELECT CAST(user_id % 3 AS INTEGER) AS run, CAST(day(ts) - 1 AS INTEGER) AS epoch,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*) / 10000 AS metric
  FROM events GROUP BY 1, 2)"""

FX["fx5"] = """fx5 AS (
  SELECT l_returnflag || l_linestatus AS arch,
         CAST(round(l_discount * 100) AS INTEGER) AS perc_ord,
         CAST(round(l_tax * 100) AS INTEGER) AS lr_ord,
         CAST(l_linenumber % 3 AS INTEGER) AS run,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*) / 100 AS id_metric,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100000000 AS ood_metric
  FROM lineitem GROUP BY 1, 2, 3, 4)"""

FX["fx6"] = """fx6 AS (
  SELECT CAST(label AS VARCHAR) AS param, CAST((vec_id // 10) % 30 AS INTEGER) AS epoch,
         CAST(embedding AS DOUBLE[]) AS v, vec_id
  FROM embeddings)"""

FX["fx7_present"] = """fx7_present AS (
  SELECT DISTINCT l_returnflag || l_linestatus AS arch,
         CAST(round(l_discount * 100) AS INTEGER) AS perc_ord,
         CAST(round(l_tax * 100) AS INTEGER) AS lr_ord,
         CAST(l_linenumber % 3 AS INTEGER) AS run
  FROM lineitem WHERE l_quantity >= 45 AND l_suppkey % 4 = 0)"""


def with_fx(names: list[str], body: str) -> str:
    """``WITH`` the named fixture CTEs (in order) followed by ``body``."""
    return "WITH " + ",\n".join(FX[n] for n in names) + "\n" + body


ORACLE: dict[str, str] = {}

ORACLE["zero_shot_split_domain"] = with_fx(
    ["fx1", "fx1_long", "fx2", "fx12", "fx12_pred"],
    """SELECT split, domain, avg(CAST(y_true = y_pred AS DOUBLE)) AS acc, count(*) AS n
       FROM fx12_pred GROUP BY split, domain""")

# --- P ---------------------------------------------------------------------------

ORACLE["l2_normalize"] = with_fx(["fx1"], """
SELECT item_id, CAST(pos - 1 AS INTEGER) AS pos, round(x / nrm, 6) AS value FROM (
  SELECT item_id, UNNEST(features) AS x, UNNEST(range(1, len(features) + 1)) AS pos,
         sqrt(list_dot_product(features, features)) AS nrm FROM fx1)""")

_SCORES = with_fx(["fx1", "fx1_long", "fx2", "fx12"], """
SELECT item_id, CAST(class_id AS INTEGER) AS class_id, round(score, 6) AS score FROM fx12""")
ORACLE["contrastive_scores"] = _SCORES
ORACLE["score_pairs"] = _SCORES

_LINEAR = with_fx(["fx1", "fx1_long", "fx2"], """
SELECT f.item_id, CAST(c.class_id AS INTEGER) AS class_id,
       round(list_dot_product(f.features, c.vec) + c.class_id / 10.0, 6) AS score
FROM fx1 f, fx2 c""")
ORACLE["linear_scores"] = _LINEAR
ORACLE["batch_inference"] = _LINEAR

FX["fx12_prob"] = """fx12_prob AS (
  SELECT item_id, split, y_true, class_id, e / sum(e) OVER (PARTITION BY item_id) AS prob FROM (
    SELECT item_id, split, y_true, class_id,
           exp(score - max(score) OVER (PARTITION BY item_id)) AS e FROM fx12))"""

ORACLE["softmax_probs"] = with_fx(["fx1", "fx1_long", "fx2", "fx12", "fx12_prob"], """
SELECT item_id, CAST(class_id AS INTEGER) AS class_id, round(prob, 6) AS prob FROM fx12_prob""")

ORACLE["prediction_table"] = with_fx(["fx1", "fx1_long", "fx2", "fx12", "fx12_prob"], """
SELECT item_id, y_true, CAST(class_id AS INTEGER) AS class_id, round(prob, 6) AS prob FROM fx12_prob""")

ORACLE["argmax_predictions"] = with_fx(["fx1", "fx1_long", "fx2", "fx12", "fx12_pred"], """
SELECT item_id, y_pred FROM fx12_pred""")

ORACLE["prediction_table_bucketed"] = with_fx(["fx1", "fx1_long", "fx2", "fx12", "fx12_pred"], """
SELECT item_id, y_pred, true AS same, (SELECT count(*) FROM fx1) AS n_rows FROM fx12_pred""")

ORACLE["standardize_pixels"] = """
SELECT vec_id AS item_id, CAST(pos AS INTEGER) AS pos,
       round((x - [0.48145466, 0.4578275, 0.40821073][pos % 3 + 1])
             / [0.26862954, 0.26130258, 0.27577711][pos % 3 + 1], 6) AS value
FROM (SELECT vec_id, UNNEST(CAST(embedding AS DOUBLE[])) AS x, UNNEST(range(len(embedding))) AS pos FROM embeddings)"""

ORACLE["single_domain_filter"] = with_fx(["fx1"], """
SELECT item_id, split, domain FROM fx1 WHERE split <> 'train' OR domain = 0""")

# --- A ---------------------------------------------------------------------------

ORACLE["accuracy_by_split"] = with_fx(["fx3"], """
SELECT run, split, avg(CAST(y_true = y_pred AS DOUBLE)) AS acc_avg, count(*) AS n
FROM fx3 GROUP BY run, split""")

ORACLE["group_accuracy"] = with_fx(["fx3"], """
SELECT run, split, domain, avg(CAST(y_true = y_pred AS DOUBLE)) AS acc, count(*) AS n
FROM fx3 GROUP BY run, split, domain""")

ORACLE["worst_group"] = with_fx(["fx3"], """
SELECT run, split, acc AS acc_wg, domain AS worst_group FROM (
  SELECT run, split, domain, acc,
         row_number() OVER (PARTITION BY run, split ORDER BY acc, domain) AS rn FROM (
    SELECT run, split, domain, avg(CAST(y_true = y_pred AS DOUBLE)) AS acc
    FROM fx3 GROUP BY run, split, domain)) WHERE rn = 1""")

ORACLE["confusion_counts"] = with_fx(["fx3"], """
SELECT run, split, y_true, y_pred, count(*) AS n FROM fx3 GROUP BY run, split, y_true, y_pred""")
ORACLE["streaming_confusion"] = ORACLE["confusion_counts"]

FX["prf"] = """prf AS (
  SELECT s.run, s.split, s.class_id,
         CAST(coalesce(t.tp, 0) AS BIGINT) AS tp, CAST(s.support AS BIGINT) AS support,
         CAST(coalesce(p.predicted, 0) AS BIGINT) AS predicted
  FROM (SELECT run, split, y_true AS class_id, count(*) AS support FROM fx3 GROUP BY ALL) s
  LEFT JOIN (SELECT run, split, y_pred AS class_id, count(*) AS predicted FROM fx3 GROUP BY ALL) p
    USING (run, split, class_id)
  LEFT JOIN (SELECT run, split, y_true AS class_id, count(*) AS tp FROM fx3 WHERE y_true = y_pred GROUP BY ALL) t
    USING (run, split, class_id))"""

ORACLE["per_class_prf"] = with_fx(["fx3", "prf"], """
SELECT run, split, class_id, tp, support, predicted,
       round(CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END, 6) AS precision,
       round(tp / support, 6) AS recall,
       round(2 * tp / (support + predicted), 6) AS f1
FROM prf""")

ORACLE["macro_f1"] = with_fx(["fx3", "prf"], """
SELECT run, split, round(avg(2 * tp / (support + predicted)), 6) AS f1_macro FROM prf GROUP BY run, split""")

ORACLE["epoch_loss"] = with_fx(["fx1", "fx1_long", "fx2", "fx12"], """
SELECT split, round(avg(batch_loss), 6) AS loss, count(*) AS n_batches FROM (
  SELECT split, batch, avg(ce) AS batch_loss FROM (
    SELECT i.split, i.batch, l.lse - l.sy AS ce FROM (
      SELECT item_id, max(score) + ln(sum(exp(score - m))) AS lse,
             max(CASE WHEN class_id = y_true THEN score END) AS sy FROM (
        SELECT *, max(score) OVER (PARTITION BY item_id) AS m FROM fx12) GROUP BY item_id) l
    JOIN (SELECT item_id, split,
                 (row_number() OVER (PARTITION BY split ORDER BY item_id) - 1) // 32 AS batch FROM fx1) i
    USING (item_id)) GROUP BY split, batch) GROUP BY split""")

FX["fx3_metrics"] = """fx3_metrics AS (
  SELECT run, split, 'acc_avg' AS metric, avg(CAST(y_true = y_pred AS DOUBLE)) AS value
  FROM fx3 GROUP BY run, split
  UNION ALL
  SELECT run, split, 'acc_wg' AS metric, min(acc) AS value FROM (
    SELECT run, split, domain, avg(CAST(y_true = y_pred AS DOUBLE)) AS acc FROM fx3 GROUP BY ALL)
  GROUP BY run, split
  UNION ALL
  SELECT run, split, 'F1-macro_all' AS metric, avg(2 * tp / (support + predicted)) AS value
  FROM prf GROUP BY run, split)"""

ORACLE["headline_metric"] = with_fx(["fx3", "prf", "fx3_metrics"], """
SELECT d.dataset, m.run, m.split, m.metric, round(m.value, 6) AS value
FROM fx3_metrics m, (VALUES ('iwildcam'), ('fmow')) d(dataset)
WHERE m.metric = CASE WHEN d.dataset LIKE '%iwildcam%' THEN 'F1-macro_all' ELSE 'acc_avg' END""")

ORACLE["run_summary"] = with_fx(["fx3", "prf", "fx3_metrics"], """
SELECT split, metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
       count(*) AS n_runs
FROM fx3_metrics GROUP BY split, metric""")


def _wide(metrics_cte: str, extra: list[str]) -> str:
    cols = []
    for s, lab in (("train", "Train"), ("id_val", "ID Val"), ("id_test", "ID Test"),
                   ("val", "OOD Val"), ("test", "OOD Test")):
        cols.append(f"round(max(CASE WHEN split = '{s}' THEN mean END), 6) AS \"{lab}|mean\"")
        cols.append(f"round(max(CASE WHEN split = '{s}' THEN std END), 6) AS \"{lab}|std\"")
    return with_fx(extra + [metrics_cte], f"""
SELECT metric, {', '.join(cols)} FROM (
  SELECT split, metric, avg(value) AS mean, stddev_samp(value) AS std
  FROM {metrics_cte} GROUP BY split, metric) GROUP BY metric""")


ORACLE["wide_report"] = _wide("fx3_metrics", ["fx3", "prf"])

FX["fx3_metrics_nation"] = FX["fx3_metrics"].replace("fx3_metrics AS", "fx3_metrics_nation AS") \
    .replace("SELECT run, split, domain, avg", "SELECT run, split, nation, avg")
ORACLE["evaluation_report"] = _wide("fx3_metrics_nation", ["fx3", "prf"])

ORACLE["vector_mean"] = with_fx(["fx6"], """
SELECT param, CAST(pos - 1 AS INTEGER) AS pos, round(avg(x), 6) AS value FROM (
  SELECT param, UNNEST(v) AS x, UNNEST(range(1, len(v) + 1)) AS pos FROM fx6 WHERE epoch > 19)
GROUP BY param, pos""")

ORACLE["dataset_summary"] = with_fx(["fx1"], """
SELECT split, n_rows, CAST(ceil(n_rows / 32) AS BIGINT) AS n_batches, n_classes, n_groups,
       CAST(sum(n_rows) OVER () AS BIGINT) AS n_total FROM (
  SELECT split, count(*) AS n_rows, count(DISTINCT y_true) AS n_classes,
         count(DISTINCT domain) AS n_groups FROM fx1 GROUP BY split)""")

ORACLE["rows_per_group"] = with_fx(["fx1"], """
SELECT split, domain, count(*) AS n_rows FROM fx1 GROUP BY split, domain""")

# --- T ---------------------------------------------------------------------------

_TOPN = with_fx(["fx1", "fx1_long", "fx2", "fx12"], """
SELECT CAST(row_number() OVER (ORDER BY score DESC, item_id) AS INTEGER) AS rank, item_id,
       round(score, 6) AS similarity
FROM fx12 WHERE class_id = 0 ORDER BY score DESC, item_id LIMIT 5""")
ORACLE["global_top_n"] = _TOPN
ORACLE["streaming_top_n"] = _TOPN

ORACLE["many_prompts_top_n"] = with_fx(["fx1", "fx1_long", "fx2", "fx12"], """
SELECT prompt_id, rank, item_id, similarity FROM (
  SELECT CAST(class_id AS INTEGER) AS prompt_id, item_id, round(score, 6) AS similarity,
         CAST(row_number() OVER (PARTITION BY class_id ORDER BY score DESC, item_id) AS INTEGER) AS rank
  FROM fx12) WHERE rank <= 5""")

ORACLE["retrieval_labels"] = with_fx(["fx1", "fx1_long", "fx2", "fx12"], """
SELECT t.rank, t.item_id, t.similarity, t.y_true, lower(n.n_name) AS class_name FROM (
  SELECT CAST(row_number() OVER (ORDER BY score DESC, item_id) AS INTEGER) AS rank, item_id,
         round(score, 6) AS similarity, y_true
  FROM fx12 WHERE class_id = 0 ORDER BY score DESC, item_id LIMIT 5) t
LEFT JOIN nation n ON n.n_nationkey = t.y_true""")


def _with_topk(split: str, k: int, body: str) -> str:
    base = with_fx(["fx1", "fx1_long", "fx2", "fx12", "fx12_prob"], "")
    return base + f""", topk AS (
  SELECT CAST(class_id AS INTEGER) AS class_id, item_id, y_true,
         CAST(row_number() OVER (PARTITION BY class_id ORDER BY round(prob, 12) DESC, item_id) AS INTEGER) AS rank
  FROM fx12_prob WHERE split = '{split}'),
ncls AS (SELECT max(y_true) + 1 AS n FROM fx1),
per_class AS (
  SELECT CAST(c.range AS INTEGER) AS class_id,
         coalesce(sum(CASE WHEN t.y_true = t.class_id THEN 1 ELSE 0 END), 0) / {float(k)} AS recall
  FROM ncls, range(ncls.n) c LEFT JOIN topk t ON t.class_id = c.range AND t.rank <= {k}
  GROUP BY c.range)
{body}"""


ORACLE["top_k_per_class"] = _with_topk("test", 20, "SELECT class_id, rank, item_id FROM topk WHERE rank <= 20")
ORACLE["recall_at_k_per_class"] = _with_topk("test", 20, "SELECT class_id, round(recall, 6) AS recall FROM per_class")
ORACLE["streaming_top_k"] = ORACLE["top_k_per_class"]
ORACLE["streaming_recall"] = ORACLE["recall_at_k_per_class"]
ORACLE["recall_at_k"] = _with_topk("test", 20, "SELECT round(sum(recall) / count(*), 6) AS recall_at_k FROM per_class")
ORACLE["recall_at_k_large_k"] = _with_topk("id_test", 200,
                                           "SELECT round(sum(recall) / count(*), 6) AS recall_at_k FROM per_class")

FX["fx4_flags"] = """fx4_flags AS (
  SELECT run, epoch, metric,
         coalesce(m > greatest(coalesce(max(m) OVER (PARTITION BY run ORDER BY epoch
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 0.0), false) AS is_best
  FROM (SELECT *, CASE WHEN isnan(metric) THEN NULL ELSE metric END AS m FROM fx4
        WHERE epoch = 0 OR (epoch + 1) % 5 = 0))"""

ORACLE["checkpoint_flags"] = with_fx(["fx4", "fx4_flags"], """
SELECT run, epoch, metric, is_best FROM fx4_flags""")

ORACLE["best_checkpoint"] = with_fx(["fx4"], """
SELECT run, CAST(best_epoch AS INTEGER) AS best_epoch, best_metric,
       CAST(best_epoch + 1 AS INTEGER) AS checkpoint_epoch FROM (
  SELECT run, metric AS best_metric, epoch AS best_epoch,
         row_number() OVER (PARTITION BY run ORDER BY metric DESC, epoch) AS rn
  FROM fx4 WHERE (epoch = 0 OR (epoch + 1) % 5 = 0) AND metric > 0 AND NOT isnan(metric))
WHERE rn = 1""")

FX["fx5_summary"] = """fx5_summary AS (
  SELECT arch, perc_ord, lr_ord, avg(id_metric) AS id_mean, avg(ood_metric) AS ood_mean,
         stddev_samp(id_metric) AS id_std, stddev_samp(ood_metric) AS ood_std
  FROM fx5 GROUP BY arch, perc_ord, lr_ord HAVING perc_ord <> 0 OR lr_ord = 0)"""

FX["fx5_best"] = """fx5_best AS (
  SELECT arch, perc_ord, lr_ord, id_mean, ood_mean, id_std, ood_std FROM (
    SELECT *, row_number() OVER (PARTITION BY arch, perc_ord ORDER BY ood_mean DESC, lr_ord) AS rn
    FROM fx5_summary WHERE perc_ord <> 0 AND ood_mean > 0 AND NOT isnan(ood_mean)) WHERE rn = 1
  UNION ALL
  SELECT arch, perc_ord, lr_ord, id_mean, ood_mean, id_std, ood_std FROM fx5_summary WHERE perc_ord = 0)"""

ORACLE["best_lr"] = with_fx(["fx5", "fx5_summary", "fx5_best"], """
SELECT arch, perc_ord, lr_ord, round(id_mean, 6) AS id_mean, round(ood_mean, 6) AS ood_mean,
       round(id_std, 6) AS id_std, round(ood_std, 6) AS ood_std FROM fx5_best""")

ORACLE["curve_series"] = with_fx(["fx5", "fx5_summary", "fx5_best"], """
SELECT arch, arch AS label, round(perc_ord / 100.0, 6) AS perc, 'ID Test' AS split,
       round(id_mean, 6) AS value, round(id_std, 6) AS err FROM fx5_best
UNION ALL
SELECT arch, arch AS label, round(perc_ord / 100.0, 6) AS perc, 'OOD Test' AS split,
       round(ood_mean, 6) AS value, round(ood_std, 6) AS err FROM fx5_best""")

# --- D ---------------------------------------------------------------------------

ORACLE["group_ids"] = with_fx(["fx3"], """
SELECT item_id,
       (dense_rank() OVER (ORDER BY domain) - 1) * (SELECT count(DISTINCT segment) FROM fx3 WHERE run = 0)
       + (dense_rank() OVER (ORDER BY segment) - 1) AS group_id
FROM fx3 WHERE run = 0""")

ORACLE["subset_fraction"] = with_fx(["fx3"], """
, tr AS (SELECT item_id, ('0x' || substr(md5(CAST(item_id AS VARCHAR) || ':7'), 1, 15))::BIGINT AS h
         FROM fx3 WHERE run = 0 AND split = 'train')
SELECT item_id FROM (
  SELECT item_id, row_number() OVER (ORDER BY h, item_id) AS rn FROM tr)
WHERE rn <= (SELECT round_even(count(*) * 0.3, 0) FROM tr)""".replace("\n, tr AS", ", tr AS", 1))

ORACLE["group_weights"] = with_fx(["fx1"], """
SELECT item_id, domain,
       round(1.0 / (count(*) OVER (PARTITION BY domain) * (SELECT count(DISTINCT domain) FROM fx1)), 9) AS weight
FROM fx1""")

ORACLE["group_balanced_sample"] = with_fx(["fx1"], """
, g AS (SELECT domain, CAST(row_number() OVER (ORDER BY domain) - 1 AS BIGINT) AS gno, count(*) AS group_n
        FROM fx1 GROUP BY domain),
gi AS (SELECT item_id, domain, row_number() OVER (PARTITION BY domain ORDER BY item_id) - 1 AS gidx FROM fx1),
d AS (SELECT range AS draw,
             ('0x' || substr(md5(CAST(range AS VARCHAR) || ':g:3'), 1, 15))::BIGINT % (SELECT count(*) FROM g) AS gno,
             ('0x' || substr(md5(CAST(range AS VARCHAR) || ':r:3'), 1, 15))::BIGINT AS h2
      FROM range(1000))
SELECT d.draw, gi.item_id, gi.domain FROM d JOIN g USING (gno)
JOIN gi ON gi.domain = g.domain AND gi.gidx = d.h2 % g.group_n""".replace("\n, g AS", ", g AS", 1))


def _shard(where: str, world: int) -> str:
    return with_fx(["fx1"], f"""
, b AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS position FROM fx1 {where}),
n AS (SELECT count(*) AS n FROM b),
allp AS (
  SELECT item_id, position FROM b
  UNION ALL
  SELECT b.item_id, b.position + n.n FROM b, n
  WHERE b.position < least(CAST(ceil(n.n / {world}) AS BIGINT) * {world} - n.n, n.n))
SELECT item_id, position, CAST(position % {world} AS INTEGER) AS shard FROM allp""".replace("\n, b AS", ", b AS", 1))


ORACLE["shard"] = _shard("", 4)
ORACLE["shard_padded"] = _shard("WHERE split = 'train'", 4)

ORACLE["shards_placed"] = f"SELECT *, true AS in_place FROM ({ORACLE['shard_padded']})"

ORACLE["batches"] = with_fx(["fx1"], """
SELECT item_id, (row_number() OVER (ORDER BY item_id) - 1) // 32 AS batch FROM fx1""")

ORACLE["row_index"] = with_fx(["fx3"], """
SELECT item_id, run, row_number() OVER (ORDER BY item_id, run) - 1 AS idx FROM fx3""")

# --- S ---------------------------------------------------------------------------

ORACLE["items_split_scan"] = with_fx(["fx1"], """
SELECT item_id, split, y_true, domain FROM fx1 WHERE split IN ('id_test', 'test')""")

ORACLE["class_prompt_dimension"] = """
SELECT 'fmow' AS dataset, CAST(n_nationkey AS INTEGER) AS class_id, lower(n_name) AS class_name,
       'a centered satellite photo of ' || lower(n_name) AS prompt FROM nation"""

FX["grid"] = """grid AS (
  SELECT a.arch, a.arch_ord, p.perc_ord, p.perc_label, p.perc_raw, l.lr_ord, l.lr_label, l.lr_raw
  FROM (SELECT arch, CAST(row_number() OVER (ORDER BY arch) - 1 AS INTEGER) AS arch_ord
        FROM (SELECT DISTINCT arch FROM fx5)) a,
       (SELECT CAST(row_number() OVER (ORDER BY perc_ord) - 1 AS INTEGER) AS perc_ord,
               CAST(perc_ord / 100.0 AS VARCHAR) AS perc_label, perc_ord AS perc_raw
        FROM (SELECT DISTINCT perc_ord FROM fx5)) p,
       (SELECT CAST(row_number() OVER (ORDER BY lr_ord) - 1 AS INTEGER) AS lr_ord,
               CAST(lr_ord / 100.0 AS VARCHAR) AS lr_label, lr_ord AS lr_raw
        FROM (SELECT DISTINCT lr_ord FROM fx5)) l)"""

ORACLE["grid_expand_train"] = with_fx(["fx5", "grid"], """
SELECT arch_ord, arch, perc_ord, perc_label, lr_ord, lr_label FROM grid
WHERE CAST(perc_label AS DOUBLE) > 0""")

ORACLE["grid_expand_test"] = with_fx(["fx5", "grid"], """
SELECT arch_ord, arch, perc_ord, perc_label, lr_ord, lr_label FROM grid
WHERE CAST(perc_label AS DOUBLE) > 0
UNION ALL
SELECT DISTINCT arch_ord, arch, min(perc_ord) AS perc_ord, '0' AS perc_label,
       CAST(NULL AS INTEGER) AS lr_ord, CAST(NULL AS VARCHAR) AS lr_label
FROM grid WHERE CAST(perc_label AS DOUBLE) = 0 GROUP BY arch_ord, arch""")

ORACLE["report_roundtrip"] = with_fx(["fx3", "prf", "fx3_metrics"], """
SELECT 'orders_eval' AS name, metric, split, round(avg(value), 6) AS mean,
       round(stddev_samp(value), 6) AS std
FROM fx3_metrics GROUP BY split, metric""")

ORACLE["report_format_roundtrip"] = ORACLE["report_roundtrip"]

ORACLE["epoch_log_roundtrip"] = with_fx(["fx4"], """
SELECT run, epoch, metric FROM fx4""")

# --- J ---------------------------------------------------------------------------

ORACLE["missing_artifacts"] = with_fx(["fx5", "grid", "fx7_present"], """
SELECT g.arch, p.perc_raw AS perc_ord, l.lr_raw AS lr_ord, r.run FROM
  (SELECT DISTINCT arch FROM fx5) g, (SELECT DISTINCT perc_ord AS perc_raw FROM fx5) p,
  (SELECT DISTINCT lr_ord AS lr_raw FROM fx5) l, (SELECT CAST(range AS INTEGER) AS run FROM range(3)) r
WHERE NOT EXISTS (SELECT 1 FROM fx7_present x WHERE x.arch = g.arch AND x.perc_ord = p.perc_raw
                  AND x.lr_ord = l.lr_raw AND x.run = r.run)""")

ORACLE["missing_artifacts_stored"] = ORACLE["missing_artifacts"]

ORACLE["grid_results_join"] = with_fx(["fx5", "fx5_summary", "grid"], """
SELECT g.arch, g.perc_raw AS perc_ord, g.lr_raw AS lr_ord, round(s.id_mean, 6) AS id_mean,
       round(s.ood_mean, 6) AS ood_mean
FROM (SELECT * FROM grid UNION ALL SELECT 'NO_swa' AS arch, * EXCLUDE (arch) FROM grid WHERE arch = 'NO') g
LEFT JOIN fx5_summary s ON s.arch = replace(g.arch, '_swa', '') AND s.perc_ord = g.perc_raw AND s.lr_ord = g.lr_raw
WHERE g.perc_raw <> 0""")

# --- M ---------------------------------------------------------------------------

ORACLE["zero_shot_report"] = with_fx(["fx1", "fx1_long", "fx2", "fx12", "fx12_pred"], """
, prf0 AS (
  SELECT s.split, s.class_id, coalesce(t.tp, 0) AS tp, s.support, coalesce(p.predicted, 0) AS predicted
  FROM (SELECT split, y_true AS class_id, count(*) AS support FROM fx12_pred GROUP BY ALL) s
  LEFT JOIN (SELECT split, y_pred AS class_id, count(*) AS predicted FROM fx12_pred GROUP BY ALL) p
    USING (split, class_id)
  LEFT JOIN (SELECT split, y_true AS class_id, count(*) AS tp FROM fx12_pred WHERE y_true = y_pred GROUP BY ALL) t
    USING (split, class_id))
SELECT split, 'acc_avg' AS metric, round(avg(CAST(y_true = y_pred AS DOUBLE)), 6) AS value
FROM fx12_pred GROUP BY split
UNION ALL
SELECT split, 'acc_wg' AS metric, round(min(acc), 6) AS value FROM (
  SELECT split, domain, avg(CAST(y_true = y_pred AS DOUBLE)) AS acc FROM fx12_pred GROUP BY ALL)
GROUP BY split
UNION ALL
SELECT split, 'F1-macro_all' AS metric, round(avg(2 * tp / (support + predicted)), 6) AS value
FROM prf0 GROUP BY split""".replace("\n, prf0 AS", ", prf0 AS", 1))

# --- retrieval over runs (leave-one-third-out centroids) -----------------------------

FX["run_cls"] = """run_cls AS (
  SELECT run, class_id, list(v ORDER BY pos) AS vec FROM (
    SELECT r.run, l.y_true AS class_id, l.pos, avg(l.x) AS v
    FROM fx1_long l, (SELECT CAST(range AS INTEGER) AS run FROM range(3)) r
    WHERE l.split = 'train' AND l.item_id % 3 <> r.run
    GROUP BY r.run, l.y_true, l.pos) GROUP BY run, class_id)"""

FX["run_prob"] = """run_prob AS (
  SELECT run, item_id, split, y_true, class_id, e / sum(e) OVER (PARTITION BY run, item_id) AS prob FROM (
    SELECT run, item_id, split, y_true, class_id, exp(score - max(score) OVER (PARTITION BY run, item_id)) AS e
    FROM (SELECT c.run, f.item_id, f.split, f.y_true, c.class_id,
                 100.0 * list_dot_product(f.features, c.vec)
                   / (sqrt(list_dot_product(f.features, f.features)) * sqrt(list_dot_product(c.vec, c.vec))) AS score
          FROM fx1 f, run_cls c)))"""


def _run_recall(split: str, k: int) -> str:
    return f"""run_recall AS (
  SELECT run, sum(CASE WHEN y_true = class_id THEN 1 ELSE 0 END) / {float(k)}
              / (SELECT max(y_true) + 1 FROM fx1) AS recall_at_k FROM (
    SELECT run, class_id, y_true,
           row_number() OVER (PARTITION BY run, class_id ORDER BY round(prob, 12) DESC, item_id) AS rk
    FROM run_prob WHERE split = '{split}') WHERE rk <= {k} GROUP BY run)"""


FX["run_recall_val10"] = _run_recall("val", 10)
FX["run_recall_test20"] = _run_recall("test", 20).replace("run_recall AS", "run_recall_test20 AS")
FX["run_recall_val10"] = FX["run_recall_val10"].replace("run_recall AS", "run_recall_val10 AS")

_RUN_FX = ["fx1", "fx1_long", "run_cls", "run_prob"]

ORACLE["recall_summary"] = with_fx(_RUN_FX + ["run_recall_val10"], """
SELECT round(avg(recall_at_k), 6) AS mean, round(stddev_pop(recall_at_k), 6) AS std, count(*) AS n_runs
FROM run_recall_val10""")

ORACLE["retrieval_report"] = with_fx(_RUN_FX + ["run_recall_test20"], """
SELECT round(avg(recall_at_k), 6) AS mean, round(stddev_pop(recall_at_k), 6) AS std, count(*) AS n_runs
FROM run_recall_test20""")

ORACLE["recall_json"] = with_fx(_RUN_FX + ["run_recall_test20"], """
SELECT 'centroid' AS arch, 'embeddings' AS dataset,
       CAST(to_json({'arch': 'centroid', 'dataset': 'embeddings',
                     'recall_at_k': list(CAST(recall_at_k AS DECIMAL(18, 6)) ORDER BY run)}) AS VARCHAR) AS json
FROM run_recall_test20""")

ORACLE["best_results_json"] = with_fx(["fx5", "fx5_summary", "fx5_best"], """
SELECT arch, CAST(to_json(map(list(CAST(perc_ord / 100.0 AS VARCHAR) ORDER BY perc_ord),
                         list([CAST(id_mean AS DECIMAL(18, 6)), CAST(ood_mean AS DECIMAL(18, 6)),
                               CAST(id_std AS DECIMAL(18, 6)), CAST(ood_std AS DECIMAL(18, 6))]
                              ORDER BY perc_ord))) AS VARCHAR) AS json
FROM fx5_best GROUP BY arch""")

ORACLE["streaming_report"] = with_fx(["fx3", "prf", "fx3_metrics"], """
SELECT run, split, metric, round(value, 6) AS value FROM fx3_metrics""")

# --- wide vocabularies, nullable groups, other group types -------------------------

ORACLE["wide_softmax_probs"] = with_fx(["fx1", "fx1_long"], """
, w AS (SELECT class_id, list(v ORDER BY pos) AS vec FROM (
    SELECT item_id % 182 AS class_id, pos, avg(x) AS v FROM fx1_long GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT f.item_id, w.class_id, 100.0 * list_dot_product(f.features, w.vec)
        / (sqrt(list_dot_product(f.features, f.features)) * sqrt(list_dot_product(w.vec, w.vec))) AS score
      FROM fx1 f, w),
e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY item_id)) AS e FROM s)
SELECT item_id, CAST(class_id AS INTEGER) AS class_id, round(e / sum(e) OVER (PARTITION BY item_id), 6) AS prob
FROM e""".replace("\n, w AS", ", w AS", 1))

FX["fx1n"] = """fx1n AS (SELECT * REPLACE (nullif(domain, 3) AS domain) FROM fx1)"""

ORACLE["group_weights_nullable"] = with_fx(["fx1", "fx1n"], """
SELECT item_id, domain,
       round(1.0 / (count(*) OVER (PARTITION BY domain)
                    * (SELECT count(*) FROM (SELECT DISTINCT domain FROM fx1n))), 9) AS weight
FROM fx1n""")

ORACLE["group_balanced_nullable"] = with_fx(["fx1", "fx1n"], """
, g AS (SELECT domain, CAST(row_number() OVER (ORDER BY domain NULLS FIRST) - 1 AS BIGINT) AS gno, count(*) AS group_n
        FROM fx1n GROUP BY domain),
gi AS (SELECT item_id, domain, row_number() OVER (PARTITION BY domain ORDER BY item_id) - 1 AS gidx FROM fx1n),
d AS (SELECT range AS draw,
             ('0x' || substr(md5(CAST(range AS VARCHAR) || ':g:5'), 1, 15))::BIGINT % (SELECT count(*) FROM g) AS gno,
             ('0x' || substr(md5(CAST(range AS VARCHAR) || ':r:5'), 1, 15))::BIGINT AS h2
      FROM range(1000))
SELECT d.draw, gi.item_id, gi.domain FROM d JOIN g USING (gno)
JOIN gi ON gi.domain IS NOT DISTINCT FROM g.domain AND gi.gidx = d.h2 % g.group_n""".replace("\n, g AS", ", g AS", 1))

ORACLE["group_ids_nullable"] = with_fx(["fx1", "fx1n"], """
SELECT item_id,
       (dense_rank() OVER (ORDER BY domain NULLS FIRST) - 1) * (SELECT count(DISTINCT y_true) FROM fx1n)
       + (dense_rank() OVER (ORDER BY y_true) - 1) AS group_id
FROM fx1n""")

FX["fx3_metrics_segment"] = FX["fx3_metrics"].replace("fx3_metrics AS", "fx3_metrics_segment AS") \
    .replace("SELECT run, split, domain, avg", "SELECT run, split, segment, avg")
ORACLE["evaluation_report_segment"] = _wide("fx3_metrics_segment", ["fx3", "prf"])

FX["fx3_plain"] = FX["fx3"].replace("fx3 AS", "fx3_plain AS", 1)
FX["fx3_resampled"] = """
g3 AS (SELECT run, domain, CAST(row_number() OVER (PARTITION BY run ORDER BY domain) - 1 AS BIGINT) AS gno,
              count(*) AS group_n FROM fx3_plain WHERE split = 'train' GROUP BY run, domain),
gi3 AS (SELECT *, row_number() OVER (PARTITION BY run, domain ORDER BY item_id) - 1 AS gidx
        FROM fx3_plain WHERE split = 'train'),
n3 AS (SELECT run, count(*) AS n, count(DISTINCT domain) AS groups FROM gi3 GROUP BY run),
r3 AS (SELECT run, groups, unnest(range(n)) AS draw FROM n3),
d3 AS (SELECT run, ('0x' || substr(md5(CAST(draw AS VARCHAR) || ':g:' || run), 1, 15))::BIGINT % groups AS gno,
              ('0x' || substr(md5(CAST(draw AS VARCHAR) || ':r:' || run), 1, 15))::BIGINT AS h2 FROM r3),
fx3 AS (SELECT * FROM fx3_plain WHERE split <> 'train' UNION ALL
        SELECT gi3.* EXCLUDE (gidx) FROM d3 JOIN g3 USING (run, gno)
        JOIN gi3 ON gi3.run = d3.run AND gi3.domain = g3.domain AND gi3.gidx = d3.h2 % g3.group_n)"""
ORACLE["evaluation_report_resampled"] = _wide("fx3_metrics", ["fx3_plain", "fx3_resampled", "prf"])

ORACLE["prediction_table_ordered"] = with_fx(["fx1", "fx1_long", "fx2", "fx12", "fx12_prob"], """
SELECT i.idx, p.item_id, p.y_true, CAST(p.class_id AS INTEGER) AS class_id, round(p.prob, 6) AS prob,
       (SELECT count(*) FROM fx1) AS n_rows
FROM fx12_prob p JOIN (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM fx1) i USING (item_id)""")

ORACLE["score_pairs_blocked"] = _SCORES

ORACLE["top_k_per_class_large_k"] = with_fx(["fx1", "fx1_long", "fx2", "fx12", "fx12_prob"], """
SELECT class_id, rank, item_id FROM (
  SELECT CAST(class_id AS INTEGER) AS class_id, item_id,
         CAST(row_number() OVER (PARTITION BY class_id ORDER BY round(prob, 12) DESC, item_id) AS INTEGER) AS rank
  FROM fx12_prob) WHERE rank <= 5000""")

# --- the limited-data study ---------------------------------------------------------------

FX["study"] = """study AS (
  SELECT arch, perc_ord, perc_ord / 100.0 AS perc,
         CASE WHEN perc_ord = 0 THEN '0' ELSE CAST(perc_ord / 100.0 AS VARCHAR) END AS perc_label,
         CASE WHEN perc_ord = 0 THEN NULL ELSE CAST(lr_ord / 100.0 AS VARCHAR) END AS lr_label,
         id_mean, ood_mean, id_std, ood_std FROM fx5_best
  UNION ALL
  SELECT arch || '_swa' AS arch, perc_ord, perc_ord / 100.0 AS perc, CAST(perc_ord / 100.0 AS VARCHAR) AS perc_label,
         CAST(lr_ord / 100.0 AS VARCHAR) AS lr_label, id_mean, ood_mean, id_std, ood_std
  FROM fx5_best WHERE arch = 'NO' AND perc_ord <> 0)"""
_STUDY = ["fx5", "fx5_summary", "fx5_best", "study"]

ORACLE["limited_data_results"] = with_fx(_STUDY, """
SELECT arch, perc_label, lr_label, round(id_mean, 6) AS id_mean, round(ood_mean, 6) AS ood_mean,
       round(id_std, 6) AS id_std, round(ood_std, 6) AS ood_std FROM study""")

ORACLE["limited_data_curve"] = with_fx(_STUDY, """
SELECT arch, arch AS label, round(perc, 6) AS perc, 'ID Test' AS split, round(id_mean, 6) AS value,
       round(id_std, 6) AS err FROM study
UNION ALL
SELECT arch, arch AS label, round(perc, 6) AS perc, 'OOD Test' AS split, round(ood_mean, 6) AS value,
       round(ood_std, 6) AS err FROM study""")

ORACLE["limited_data_json"] = with_fx(_STUDY, """
SELECT arch, CAST(to_json(map(list(perc_label ORDER BY perc_ord),
                         list([CAST(id_mean AS DECIMAL(18, 6)), CAST(ood_mean AS DECIMAL(18, 6)),
                               CAST(id_std AS DECIMAL(18, 6)), CAST(ood_std AS DECIMAL(18, 6))]
                              ORDER BY perc_ord))) AS VARCHAR) AS json
FROM study GROUP BY arch""")

ORACLE["summary_parquet_roundtrip"] = with_fx(["fx5", "fx5_summary"], """
SELECT arch, perc_ord, lr_ord, round(id_mean, 6) AS id_mean, round(ood_mean, 6) AS ood_mean
FROM fx5_summary WHERE arch = 'NO'""")

ORACLE["grid_label_roundtrip"] = with_fx(["fx5"], """
SELECT 'fmow_' || a.arch || '_perctrain_' || p.perc_ord || '_lr_' || (l.lr_ord + 1) || 'e-05' AS name,
       CAST(p.perc_ord AS VARCHAR) AS perc_label, (l.lr_ord + 1) || 'e-05' AS lr_label
FROM (SELECT DISTINCT arch FROM fx5) a, (SELECT DISTINCT perc_ord FROM fx5 WHERE perc_ord > 0) p,
     (SELECT DISTINCT lr_ord FROM fx5) l""")

# --- zero-shot from prompts -----------------------------------------------------------------

ORACLE["zero_shot_prompts"] = """
WITH w AS (SELECT 'd' AS side, doc_id AS id, unnest(string_split_regex(trim(lower(text)), '\\s+')) AS w FROM documents
  UNION ALL
  SELECT 'c', n_nationkey, unnest(string_split_regex('a centered satellite photo of ' || lower(n_name), '\\s+'))
  FROM nation),
b AS (SELECT side, id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS b, count(*)::DOUBLE AS n FROM w
      WHERE w <> '' GROUP BY ALL),
norms AS (SELECT side, id, sqrt(sum(n * n)) AS norm FROM b GROUP BY ALL),
dots AS (SELECT d.id AS item_id, c.id AS class_id, sum(d.n * c.n) AS dot
         FROM b d JOIN b c ON d.side = 'd' AND c.side = 'c' AND d.b = c.b GROUP BY ALL),
s AS (SELECT i.id AS item_id, c.id AS class_id, round(100.0 * coalesce(x.dot, 0) / (i.norm * c.norm), 9) AS score
      FROM norms i JOIN norms c ON i.side = 'd' AND c.side = 'c'
      LEFT JOIN dots x ON x.item_id = i.id AND x.class_id = c.id),
p AS (SELECT item_id, class_id AS y_pred FROM (
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, class_id) AS r FROM s) WHERE r = 1)
SELECT CASE WHEN item_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, CAST(item_id % 4 AS INTEGER) AS domain,
       CAST(y_pred AS INTEGER) AS y_pred, avg(CAST(item_id % 25 = y_pred AS DOUBLE)) AS acc, count(*) AS n
FROM p GROUP BY ALL"""

# --- linear probes: the facts that must hold ----------------------------------------------------

FX["fx9"] = """fx9 AS (
  SELECT doc_id AS item_id, list_position(['en', 'fr', 'de', 'es'], lang) - 1 AS y_true,
    CASE WHEN dom BETWEEN 14 AND 16 THEN 'val' WHEN dom BETWEEN 17 AND 19 THEN 'test'
         WHEN doc_id % 10 = 8 THEN 'id_val' WHEN doc_id % 10 = 9 THEN 'id_test' ELSE 'train' END AS split
  FROM (SELECT *, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) AS dom FROM documents))"""

ORACLE["linear_probe"] = with_fx(["fx9"], """
SELECT split, CAST(sum(n) AS BIGINT) AS n, round(max(n) / sum(n), 6) AS majority,
       round(sum(n * guess) / sum(n), 6) AS prior_loss, true AS holds_majority,
       CASE WHEN split = 'train' THEN true END AS beats_prior, true AS finite_loss, true AS converged
FROM (SELECT split, y_true, count(*) AS n FROM fx9 GROUP BY ALL) JOIN
     (SELECT y_true, -ln(count(*) / sum(count(*)) OVER ()) AS guess FROM fx9 WHERE split = 'train' GROUP BY y_true)
     USING (y_true) GROUP BY split""")

ORACLE["probe_epochs"] = with_fx(["fx9"], """
SELECT CAST(e AS INTEGER) AS epoch, n AS n_draws, CAST(ceil(n / 1024) AS BIGINT) AS n_batches,
       e = 0 OR (e + 1) % 2 = 0 AS evaluated, CASE WHEN e > 0 THEN true END AS loss_falls, e > 6 - 2 - 1 AS in_mean,
       true AS swa_is_mean, true AS best_is_first_highest
FROM (SELECT count(*) AS n FROM fx9 WHERE split = 'train'), range(0, 6) r(e)""")

ORACLE["learning_curve"] = with_fx(["fx9"], """
SELECT 'linear_probe' AS arch, round(f.perc, 6) AS perc,
       CASE e.split WHEN 'id_test' THEN 'ID Test' ELSE 'OOD Test' END AS split,
       CAST(round_even((SELECT count(*) FROM fx9 WHERE split = 'train') * f.perc, 0) AS BIGINT) AS n_train,
       e.n AS n_eval, CASE WHEN f.perc > 1e-5 THEN true END AS holds_majority,
       CASE WHEN f.perc > 1e-5 THEN true END AS has_spread
FROM (SELECT split, count(*) AS n FROM fx9 WHERE split IN ('id_test', 'test') GROUP BY 1) e,
     (VALUES (0.0::DOUBLE), (0.000001), (0.1), (1.0)) f(perc)""")
