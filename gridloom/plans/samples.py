"""Queries of sampling, ordering and batching over documents, annotations and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.operators import batches as K
from gridloom.operators import sampling as S
from gridloom.operators.layout import small
from gridloom.plans.scalars import FRACTION
from gridloom.sources.tables import table


def _fraction(text: str, seed: int) -> str:
    return FRACTION.format(seed=f"'{seed}'", text=text)


def docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("source"), F.coalesce(F.col("n_chars"), F.lit(0)).alias("n"))


DOCS = "d AS (SELECT doc_id, coalesce(source, 'none') AS source, coalesce(n_chars, 0) AS n FROM documents)"


def c1_epoch_shuffle(spark, folder):
    return S.epoch_shuffle(docs(spark, folder), ["source"], "doc_id", 42, 3).select("doc_id", "position")


C1 = f"WITH {DOCS} SELECT doc_id, (row_number() OVER (PARTITION BY source ORDER BY {_fraction('doc_id::VARCHAR', 42 + 3 * 999983)}, doc_id) - 1)::INT AS position FROM d"


def c2_downsample(spark, folder):
    return S.downsample(docs(spark, folder), ["source"], "doc_id", F.when(F.col("source") == "tracker", 0.3).otherwise(1.0)).select("doc_id", "source")


C2 = f"WITH {DOCS}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_fraction('doc_id::VARCHAR', 10086)}, doc_id) AS k, count(*) OVER (PARTITION BY source) AS c FROM d) SELECT doc_id, source FROM r WHERE source <> 'tracker' OR k <= floor(c * 0.3::DOUBLE)"


def recipe_counts(spark, folder):
    a = table(spark, folder, "annotations").filter("dataset is not null").groupBy("dataset").agg(F.count_distinct("record_id").alias("n"))
    return a.join(small(table(spark, folder, "recipe").select("dataset", "repeat_time")), "dataset")


def c3_dataset_weights(spark, folder):
    return S.dataset_weights(recipe_counts(spark, folder), F.col("repeat_time")).select("dataset", F.round("weight", 12).alias("weight"))


_W = "w AS (SELECT dataset, CASE WHEN repeat_time >= 1 THEN repeat_time * n ELSE floor(n * repeat_time) END AS raw FROM (SELECT dataset, count(DISTINCT record_id) AS n FROM annotations WHERE dataset IS NOT NULL GROUP BY dataset) JOIN recipe USING (dataset))"
C3 = f"WITH {_W} SELECT dataset, round(raw / sum(raw) OVER (), 12) AS weight FROM w"


def c4_weighted_draw(spark, folder):
    weights = recipe_counts(spark, folder).select(F.col("dataset").alias("name"), (F.pow(F.lit(2.0), -F.row_number().over(W.orderBy("dataset")))).alias("weight"))
    return S.weighted_draw(weights, table(spark, folder, "documents").select(F.col("doc_id").alias("draw")), 5)


C4 = f"""WITH w AS (SELECT dataset AS name, 2.0 ** -row_number() OVER (ORDER BY dataset) AS weight FROM (SELECT DISTINCT dataset FROM annotations JOIN recipe USING (dataset))), e AS (SELECT name, weight, sum(weight) OVER (ORDER BY name) AS high FROM w),
u AS (SELECT doc_id AS draw, {_fraction('doc_id::VARCHAR', 5)} AS u FROM documents) SELECT draw, name, (row_number() OVER (PARTITION BY name ORDER BY draw) - 1)::INT AS nth FROM u JOIN e ON u >= high - weight AND u < high"""


def c5_weighted_shuffle(spark, folder):
    return S.weighted_shuffle(docs(spark, folder), ["source"], "doc_id", F.lit(2.0), 9).select("doc_id", "position")


C5 = f"WITH {DOCS} SELECT doc_id, (row_number() OVER (PARTITION BY source ORDER BY ({_fraction('doc_id::VARCHAR', 9)}) ** 0.5, doc_id) - 1)::INT AS position FROM d"


def _tasks(spark, folder):
    m = table(spark, folder, "manifest").filter("task rlike '^ui_[a-z_]+$'").groupBy("sample_id").agg(F.min("task").alias("task"), F.min("kind").alias("kind"))
    return m


def c6_balance_classes(spark, folder):
    return S.balance_classes(_tasks(spark, folder), "task", F.col("kind") == "positive", "sample_id", 120, 2.0, 3)


_TASKS = "m AS (SELECT sample_id, min(task) AS task, min(kind) AS kind FROM manifest WHERE regexp_full_match(task, 'ui_[a-z_]+') GROUP BY sample_id)"
C6 = f"""WITH {_TASKS}, r AS (SELECT task, kind = 'positive' AS positive, sample_id, row_number() OVER (PARTITION BY task, kind = 'positive' ORDER BY {_fraction('sample_id::VARCHAR', 3)}, sample_id) - 1 AS k FROM m),
s AS (SELECT task, positive, count(*) AS n FROM r GROUP BY ALL), t AS (SELECT task, positive, n, i::INT AS slot FROM s, range(80) x(i) WHERE i < CASE WHEN positive THEN 40 ELSE 80 END)
SELECT task, positive, slot, sample_id FROM t JOIN r USING (task, positive) WHERE r.k = slot % n"""


def c7_even_interleave(spark, folder):
    rows = table(spark, folder, "images").selectExpr("image_id as position")
    return rows.select("position", S.even_interleave(F.col("position"), F.lit(37), F.lit(101)).alias("positive"))


C7 = "SELECT image_id AS position, floor((image_id + 1) * 37 / 101) > floor(image_id * 37 / 101) AS positive FROM images"


def c8_rotating_round_robin(spark, folder):
    rows = S.epoch_shuffle(_tasks(spark, folder), ["task"], "sample_id", 1, 0)
    index = F.array_position(F.array(*map(F.lit, ("ui_content_missing", "ui_cropping", "ui_occlusion", "ui_text_ellipsis", "ui_text_overflow"))), F.col("task")) - 1
    return rows.select("sample_id", S.rotating_order(F.col("position"), index, 5).alias("place"))


C8 = f"""WITH {_TASKS}, p AS (SELECT sample_id, task, row_number() OVER (PARTITION BY task ORDER BY {_fraction('sample_id::VARCHAR', 1)}, sample_id) - 1 AS position FROM m)
SELECT sample_id, position * 5 + ((list_position(['ui_content_missing', 'ui_cropping', 'ui_occlusion', 'ui_text_ellipsis', 'ui_text_overflow'], task) - 1 - position) % 5 + 5) % 5 AS place FROM p"""


def c9_reservoir_pick(spark, folder):
    return S.reservoir_pick(_tasks(spark, folder), ["task", "kind"], "sample_id", 77)


C9 = f"WITH {_TASKS} SELECT task, kind, arg_min(sample_id, ({_fraction('sample_id::VARCHAR', 77)}, sample_id)) AS sample_id FROM m GROUP BY ALL"


def c10_random_resize(spark, folder):
    """Half of the images keep their size, the others get a long edge of 640 to 2560."""
    from gridloom.functions.geometry import stable_fraction

    keep, edge = stable_fraction(F.col("image"), F.lit(1)) < 0.5, F.floor(640 + stable_fraction(F.col("image"), F.lit(2)) * 1921)
    return table(spark, folder, "images").select("image_id", F.when(~keep, edge).alias("long_edge"))


C10 = f"SELECT image_id, CASE WHEN NOT ({_fraction('image', 1)}) < 0.5 THEN floor(640 + ({_fraction('image', 2)}) * 1921)::BIGINT END AS long_edge FROM images"


def c11_retry_next(spark, folder):
    return S.retry_next(docs(spark, folder), "doc_id", F.col("n") > 300, ["source"]).select("doc_id", "used")


C11 = f"WITH {DOCS} SELECT doc_id, min(CASE WHEN n > 300 THEN doc_id END) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING) AS used FROM d"


def _workers(spark, folder):
    """Documents dealt to workers: 64 of each source."""
    return docs(spark, folder).selectExpr("concat(source, '-', doc_id % 64) as worker", "doc_id", "n")


def c12_pack_stream(spark, folder):
    return K.next_fit(_workers(spark, folder), ["worker"], "doc_id", "n", 2048)


C12 = f"""WITH RECURSIVE {DOCS}, r AS (SELECT source || '-' || (doc_id % 64) AS worker, doc_id, n, row_number() OVER (PARTITION BY source || '-' || (doc_id % 64) ORDER BY doc_id) AS k FROM d WHERE n <= 2048),
w(worker, k, doc_id, used, batch) AS (
  SELECT worker, k, doc_id, n, 0 FROM r WHERE k = 1
  UNION ALL
  SELECT r.worker, r.k, r.doc_id, CASE WHEN w.used + r.n <= 2048 OR w.used = 0 THEN w.used + r.n ELSE r.n END, CASE WHEN w.used + r.n <= 2048 OR w.used = 0 THEN w.batch ELSE w.batch + 1 END
  FROM w JOIN r ON r.worker = w.worker AND r.k = w.k + 1)
SELECT worker, doc_id, batch FROM w"""


def c12b_pack_best_fit(spark, folder):
    return K.per_group(_workers(spark, folder).filter("n <= 2048"), ["worker"], "doc_id", "n", lambda lengths: K.buffered_best_fit(lengths, 2048, 16))


def c13_pack_heap(spark, folder):
    return K.per_group(_workers(spark, folder), ["worker"], "doc_id", "n", lambda lengths: K.heap_bins(lengths, 2048))


def c14_length_groups(spark, folder):
    """Megabatches of 32 documents over 4 workers."""
    rows = S.global_positions(docs(spark, folder).select("doc_id", "n"), "doc_id").withColumn("megabatch", F.expr("position div 32"))
    return K.per_group(rows, ["megabatch"], "doc_id", "n", lambda lengths: K.length_groups(lengths, 4, 8))


def c15_rank_shard(spark, folder):
    return S.rank_shard(docs(spark, folder).select("doc_id"), "doc_id", 7)


C15 = """WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position, count(*) OVER () AS total FROM documents), q AS (SELECT doc_id, position FROM p UNION ALL SELECT doc_id, position + total FROM p WHERE position < (7 - total % 7) % 7)
SELECT (position % 7)::INT AS rank, position // 7 AS step, doc_id FROM q"""


def c17_pack_pad(spark, folder):
    """Every batch of every worker's stream laid end to end and padded; a document longer than a batch gets one of its own."""
    rows = _workers(spark, folder)
    batches = K.next_fit(rows.withColumn("n", F.least("n", F.lit(2048))), ["worker"], "doc_id", "n", 2048)
    return K.pack_pad(batches.join(rows, ["worker", "doc_id"]), ["worker", "batch"], "doc_id", "n", 4096)


C17 = f"""WITH RECURSIVE {DOCS}, r AS (SELECT source || '-' || (doc_id % 64) AS worker, doc_id, n AS whole, least(n, 2048) AS n, row_number() OVER (PARTITION BY source || '-' || (doc_id % 64) ORDER BY doc_id) AS k FROM d),
w(worker, k, doc_id, whole, used, batch) AS (
  SELECT worker, k, doc_id, whole, n, 0 FROM r WHERE k = 1
  UNION ALL
  SELECT r.worker, r.k, r.doc_id, r.whole, CASE WHEN w.used + r.n <= 2048 OR w.used = 0 THEN w.used + r.n ELSE r.n END, CASE WHEN w.used + r.n <= 2048 OR w.used = 0 THEN w.batch ELSE w.batch + 1 END
  FROM w JOIN r ON r.worker = w.worker AND r.k = w.k + 1),
e AS (SELECT worker, batch, sum(whole) OVER o AS hi, row_number() OVER o = 1 AS first FROM w WINDOW o AS (PARTITION BY worker, batch ORDER BY doc_id))
SELECT worker, batch, count(*) FILTER (hi <= 4096 OR first) AS samples, count(*) FILTER (hi > 4096 AND NOT first) AS dropped, greatest(0, 4096 - max(hi) FILTER (hi <= 4096 OR first))::BIGINT AS padding FROM e GROUP BY worker, batch"""


def c18_packed_validate(spark, folder):
    """Batches whose samples exceed the limit or that hold no sample with text."""
    packed = c12_pack_stream(spark, folder).join(docs(spark, folder), "doc_id")
    return packed.groupBy("worker", "batch").agg(F.sum("n").alias("used"), F.max("n").alias("most")).filter("used > 2048 or most = 0").select("worker", "batch", "used")


C18 = f"SELECT worker, batch, sum(n)::BIGINT AS used FROM ({C12}) JOIN (SELECT doc_id, coalesce(n_chars, 0) AS n FROM documents) USING (doc_id) GROUP BY ALL HAVING sum(n) > 2048 OR max(n) = 0"


def a24_pack_efficiency(spark, folder):
    packed = c12_pack_stream(spark, folder).join(docs(spark, folder), "doc_id").groupBy("worker", "batch").agg(F.sum("n").alias("used"), F.count("*").alias("samples"))
    return packed.agg(F.count("*").alias("batches"), F.round(F.sum("used") / (F.count("*") * 2048), 9).alias("used_share"), F.round(F.avg("samples"), 9).alias("samples_a_step"))


A24 = f"SELECT count(*) AS batches, round(sum(u) / (count(*) * 2048), 9) AS used_share, round(avg(c), 9) AS samples_a_step FROM (SELECT worker, batch, sum(n) AS u, count(*) AS c FROM ({C12}) JOIN (SELECT doc_id, coalesce(n_chars, 0) AS n FROM documents) USING (doc_id) GROUP BY ALL)"


def c22_limit(spark, folder):
    """The first three records of each data set (the limit is the feature)."""
    rows = table(spark, folder, "annotations").select("dataset", "record_id").distinct()
    return rows.withColumn("k", F.row_number().over(W.partitionBy("dataset").orderBy("record_id"))).filter("k <= 3").select("dataset", "record_id")


C22 = "SELECT dataset, record_id FROM (SELECT DISTINCT dataset, record_id FROM annotations) QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY record_id) <= 3"

_SQL = {
    "c1_epoch_shuffle": C1, "c2_downsample": C2, "c3_dataset_weights": C3, "c4_weighted_draw": C4, "c5_weighted_shuffle": C5, "c6_balance_classes": C6, "c7_even_interleave": C7, "c8_rotating_round_robin": C8, "c9_reservoir_pick": C9, "c10_random_resize": C10,
    "c11_retry_next": C11, "c12_pack_stream": C12, "c15_rank_shard": C15, "c17_pack_pad": C17, "c18_packed_validate": C18, "a24_pack_efficiency": A24, "c22_limit": C22,
}
QUERIES = {name: globals()[name] for name in _SQL} | {"c12b_pack_best_fit": c12b_pack_best_fit, "c13_pack_heap": c13_pack_heap, "c14_length_groups": c14_length_groups}
SQL = dict(_SQL)
