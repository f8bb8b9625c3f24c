"""Registered queries: splits, samples, orders, batches, training histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.catalog import base as B
from quillmark.functions import text as X
from quillmark.operators import batches as BA
from quillmark.operators import history as H
from quillmark.operators import profile as P
from quillmark.operators import rank as R
from quillmark.operators import split as SP
from quillmark.operators import tokens as K
from quillmark.session import stored


@B.register("stratified_split", f"""
WITH {B.SNIPS}, {B.sql_split('snips', 'label')} SELECT row_id, label, split FROM parted""")
def stratified_split(spark, sf_dir):
    return SP.stratified_split(B.snippets(spark, sf_dir)).select("row_id", "label", "split")


_ORDERS = "orders_in AS (SELECT o_orderkey AS row_id, o_orderstatus AS status FROM orders)"


def _orders(spark, sf_dir):
    return B.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("status")
    )


@B.register("stratified_split_orders", f"""
WITH {_ORDERS}, {B.sql_split('orders_in', 'status')} SELECT row_id, status, split FROM parted""")
def stratified_split_orders(spark, sf_dir):
    """Three classes, named by text, on a larger table."""
    return SP.stratified_split(_orders(spark, sf_dir), "status")


@B.register("split_quotas", f"""
WITH {B.SNIPS}, {B.sql_split('snips', 'label')}
SELECT s AS label, n::BIGINT AS n, n_train::BIGINT AS n_train, n_validation::BIGINT AS n_validation, n_test::BIGINT AS n_test FROM quotas""")
def split_quotas(spark, sf_dir):
    counts = B.snippets(spark, sf_dir).groupBy(F.col("label").alias("stratum")).agg(F.count("*").alias("n"))
    return SP.split_quotas(counts).withColumnRenamed("stratum", "label")


@B.register("split_balance", f"""
WITH {B.SNIPS}, {B.sql_split('snips', 'label')}, c AS (SELECT split, label, count(*) AS n FROM parted GROUP BY ALL)
SELECT split, label, n, round(100.0 * n / sum(n) OVER (PARTITION BY split), 6)::DOUBLE AS pct FROM c""")
def split_balance(spark, sf_dir):
    out = P.class_balance(SP.stratified_split(B.snippets(spark, sf_dir)), by=["split"])
    return out.select("split", "label", "n", *B.r6("pct"))


@B.register("subsample", f"""
WITH {B.DOCS} SELECT row_id FROM docs ORDER BY {B.sql_key('42')}, row_id LIMIT 100""")
def subsample(spark, sf_dir):
    """A small sample."""
    return SP.subsample(B.documents(spark, sf_dir), 100).select("row_id")


@B.register("subsample_large", f"""
WITH {_ORDERS} SELECT row_id FROM orders_in ORDER BY {B.sql_key('42')}, row_id LIMIT 12000""")
def subsample_large(spark, sf_dir):
    """Most of a table."""
    return SP.subsample(_orders(spark, sf_dir).select("row_id"), 12_000)


@B.register("shuffle_epoch", f"""
WITH {B.DOCS} SELECT row_id, row_number() OVER (ORDER BY {B.sql_key('42:3')}, row_id) - 1 AS position FROM docs""")
def shuffle_epoch(spark, sf_dir):
    return SP.shuffle_epoch(B.documents(spark, sf_dir).select("row_id"), epoch=3)


_VOCAB = f"""
words AS (SELECT unnest({B.SQL_TOKENS}) AS token FROM snips),
vocab AS (SELECT token, count(*) AS n, (row_number() OVER (ORDER BY count(*) DESC, token) + 3)::INTEGER AS token_id
          FROM words GROUP BY token QUALIFY row_number() OVER (ORDER BY count(*) DESC, token) <= 500)"""
_ENCODED = f"""
cut AS (SELECT row_id, label, ({B.SQL_TOKENS})[1:126] AS tokens FROM snips),
pieces AS (SELECT row_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM cut),
body AS (SELECT row_id, list(coalesce(token_id, 3) ORDER BY pos) AS ids FROM pieces LEFT JOIN vocab USING (token) GROUP BY row_id),
encoded AS (SELECT row_id, label, list_concat([0], coalesce(ids, []), [2]) AS input_ids FROM cut LEFT JOIN body USING (row_id))"""


def _encoded(spark, sf_dir):
    rows = B.snippets(spark, sf_dir, heavy=True)
    return K.encode_ids(K.tokenize(rows, 128), K.build_vocab(rows, 500))


@B.register("assemble_batches", f"""
WITH {B.SNIPS}, {_VOCAB}, {_ENCODED},
ranked AS (SELECT *, row_number() OVER (ORDER BY {B.sql_key('42:0')}, row_id) - 1 AS r FROM encoded),
placed AS (SELECT *, r // 32 AS batch_id, (r % 32)::INTEGER AS slot, max(len(input_ids)) OVER (PARTITION BY r // 32) AS pad_to FROM ranked)
SELECT batch_id::BIGINT AS batch_id, slot, row_id, label, pad_to::INTEGER AS width, len(input_ids)::BIGINT AS mask_sum,
       (list_sum(input_ids) + (pad_to - len(input_ids)))::BIGINT AS ids_sum FROM placed""")
def assemble_batches(spark, sf_dir):
    encoded = _encoded(spark, sf_dir).select("row_id", "label", "input_ids", "attention_mask")
    batches = BA.assemble_batches(stored(encoded, "encoded"))
    zero = F.lit(0).cast("bigint")
    return batches.select(
        "batch_id", "slot", "row_id", "label", F.size("input_ids").alias("width"),
        F.aggregate("attention_mask", zero, lambda a, x: a + x).alias("mask_sum"),
        F.aggregate("input_ids", zero, lambda a, x: a + x).alias("ids_sum"),
    )


@B.register("tokenize", f"""
WITH {B.DOCS}, t AS (SELECT row_id, ({B.SQL_TOKENS})[1:510] AS tokens FROM docs)
SELECT row_id, (len(tokens) + 2)::INTEGER AS n_tokens, md5(array_to_string(tokens, ' ')) AS tokens_md5 FROM t""")
def tokenize(spark, sf_dir):
    out = K.tokenize(B.documents(spark, sf_dir, heavy=True))
    return out.select("row_id", "n_tokens", F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


@B.register("build_vocab", f"WITH {B.SNIPS}, {_VOCAB} SELECT token, n, token_id FROM vocab")
def build_vocab(spark, sf_dir):
    return K.build_vocab(B.snippets(spark, sf_dir, heavy=True), 500)


@B.register("encode_ids", f"""
WITH {B.SNIPS}, {_VOCAB}, {_ENCODED}
SELECT row_id, label, len(input_ids)::INTEGER AS n_tokens, md5(array_to_string(input_ids, ',')) AS ids_md5 FROM encoded""")
def encode_ids(spark, sf_dir):
    return _encoded(spark, sf_dir).select(
        "row_id", "label", F.size("attention_mask").alias("n_tokens"), F.md5(F.array_join("input_ids", ",")).alias("ids_md5")
    )


@B.register("encode_ids_by_join", f"""
WITH {B.SNIPS}, {_VOCAB}, {_ENCODED}
SELECT row_id, label, len(input_ids)::INTEGER AS n_tokens, md5(array_to_string(input_ids, ',')) AS ids_md5 FROM encoded""")
def encode_ids_by_join(spark, sf_dir):
    """The way of a vocabulary that is too large to be sent to every task: all but its first 20 tokens are joined."""
    rows = B.snippets(spark, sf_dir, heavy=True)
    out = K.encode_ids(K.tokenize(rows, 128), stored(K.build_vocab(rows, 500), "vocab"), in_place=20)
    return out.select("row_id", "label", F.size("attention_mask").alias("n_tokens"), F.md5(F.array_join("input_ids", ",")).alias("ids_md5"))


@B.register("keep_token_columns", f"""
WITH {B.SNIPS}, {_VOCAB}, {_ENCODED}
SELECT row_id, array_to_string(input_ids, ',') AS input_ids,
       array_to_string(list_transform(input_ids, lambda x: 1), ',') AS attention_mask, label FROM encoded""")
def keep_token_columns(spark, sf_dir):
    kept = K.keep_token_columns(_encoded(spark, sf_dir))
    return kept.withColumn("input_ids", F.array_join("input_ids", ",")).withColumn(
        "attention_mask", F.array_join("attention_mask", ",")
    )


@B.register("token_length_summary", f"""
WITH {B.SNIPS}, {B.sql_split('snips', 'label')},
t AS (SELECT split, least(len({B.SQL_TOKENS}), 126) + 2 AS v FROM parted)
SELECT split, count(*) AS count, round(avg(v), 6) AS mean, min(v)::INTEGER AS min,
       round(quantile_cont(v, 0.5), 6)::DOUBLE AS p50, round(quantile_cont(v, 0.95), 6)::DOUBLE AS p95,
       round(quantile_cont(v, 0.99), 6)::DOUBLE AS p99, max(v)::INTEGER AS max,
       round(100.0 * avg((v >= 128)::INT), 6)::DOUBLE AS truncated_pct FROM t GROUP BY split""")
def token_length_summary(spark, sf_dir):
    rows = K.tokenize(SP.stratified_split(B.snippets(spark, sf_dir)), 128)
    out = K.token_length_summary(rows, 128)
    return out.select("split", "count", *B.r6("mean"), "min", *B.r6("p50", "p95", "p99"), "max", *B.r6("truncated_pct"))


@B.register("global_rank", f"""
WITH {_ORDERS} SELECT row_id, status,
  row_number() OVER (PARTITION BY status ORDER BY {B.sql_key('42')}, row_id) - 1 AS rank FROM orders_in""")
def global_rank(spark, sf_dir):
    keyed = _orders(spark, sf_dir).withColumn("k", X.seeded_key(42, "row_id"))
    return R.global_rank(keyed, "k", ["row_id"], X.HASH_BITS, by=["status"]).drop("k")


@B.register("exact_quantiles", f"""
WITH q AS (SELECT l_returnflag, unnest([0.05, 0.5, 0.99]) AS prob,
  unnest(quantile_cont(l_extendedprice, [0.05, 0.5, 0.99])) AS quantile FROM lineitem GROUP BY l_returnflag)
SELECT l_returnflag, prob::DOUBLE AS prob, round(quantile, 4)::DOUBLE AS quantile FROM q""")
def exact_quantiles(spark, sf_dir):
    lines = B.table(spark, sf_dir, "lineitem")
    out = R.exact_quantiles(lines, "l_extendedprice", [0.05, 0.5, 0.99], by=["l_returnflag"])
    return out.withColumn("quantile", F.round("quantile", 4))


def _history(spark, sf_dir):
    """Supplier as run, month as epoch, mean quantity as loss: many runs with ups and downs."""
    lines = B.table(spark, sf_dir, "lineitem")
    month = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("int")
    return lines.groupBy(F.col("l_suppkey").alias("run_id"), month.alias("epoch")).agg(
        (F.sum(F.col("l_quantity").cast("bigint")) / F.count("*")).alias("val_loss"),
        F.count("*").alias("n"),
    )


_HISTORY = """
hist AS (SELECT l_suppkey AS run_id, (year(l_shipdate) * 12 + month(l_shipdate))::INTEGER AS epoch,
                sum(l_quantity::BIGINT)::DOUBLE / count(*) AS val_loss, count(*) AS n FROM lineitem GROUP BY ALL)"""


@B.register("early_stop", f"""
WITH RECURSIVE {_HISTORY}, e AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS i FROM hist),
walk AS (
  SELECT run_id, i, epoch AS best_epoch, val_loss AS best, 0 AS bad, epoch AS last_epoch, false AS stopped FROM e WHERE i = 1
  UNION ALL
  SELECT w.run_id, e.i, CASE WHEN e.val_loss < w.best - 1e-6 THEN e.epoch ELSE w.best_epoch END,
         CASE WHEN e.val_loss < w.best - 1e-6 THEN e.val_loss ELSE w.best END,
         CASE WHEN e.val_loss < w.best - 1e-6 THEN 0 ELSE w.bad + 1 END, e.epoch,
         NOT e.val_loss < w.best - 1e-6 AND w.bad + 1 >= 5
  FROM walk w JOIN e ON e.run_id = w.run_id AND e.i = w.i + 1 WHERE NOT w.stopped)
SELECT run_id, best_epoch, round(best, 6) AS best_val_loss, last_epoch, stopped AS stopped_early
FROM walk QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY i DESC) = 1""")
def early_stop(spark, sf_dir):
    out = H.early_stop(_history(spark, sf_dir), patience=5)
    return out.select("run_id", "best_epoch", *B.r6("best_val_loss"), "last_epoch", "stopped_early")


@B.register("training_curves", f"""
WITH {_HISTORY} SELECT run_id, epoch, round(val_loss / 2, 6) AS train_loss, round(val_loss, 6) AS val_loss,
  round(1 / val_loss, 6) AS val_accuracy, round(1 / (val_loss + 1), 6) AS val_macro_f1, round(1 / (val_loss + 2), 6) AS val_auc_roc
FROM hist ORDER BY run_id, epoch""")
def training_curves(spark, sf_dir):
    loss = F.col("val_loss")
    nested = _history(spark, sf_dir).select(
        "run_id", "epoch", (loss / 2).alias("train_loss"), "val_loss",
        F.struct((1 / loss).alias("accuracy"), (1 / (loss + 1)).alias("macro_f1"), (1 / (loss + 2)).alias("auc_roc")).alias("val_metrics"),
    )
    out = H.training_curves(nested)
    return out.select("run_id", "epoch", *B.r6("train_loss", "val_loss", "val_accuracy", "val_macro_f1", "val_auc_roc"))
