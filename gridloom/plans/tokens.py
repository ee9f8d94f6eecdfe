"""Queries of token labels, blocks, masks and logits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.functions import tokens as T
from gridloom.plans.boxes import BOXES, gt_boxes
from gridloom.sources.tables import table


def sequences(spark, folder):
    """A sequence of token ids for each order: part keys of its lines modulo 50, in the order of the lines."""
    return gt_boxes(spark, folder).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.expr("cast(x1 as int) % 50").alias("t")))).alias("s")).select("image_id", F.transform("s", lambda x: x["t"]).alias("tokens"))


SEQ = f"WITH RECURSIVE {BOXES}, q AS (SELECT image_id, list((x1::INT % 50)::INT ORDER BY ord) AS tokens FROM gt GROUP BY image_id), u AS (SELECT image_id, ord, (x1::INT % 50)::INT AS t FROM gt) "


def t1_assistant_spans(spark, folder):
    """Labelled tokens: after one below 5, up to the next above 44."""
    marks = F.transform("tokens", lambda t: F.when(t < 5, 1).when(t > 44, 2).otherwise(0))
    return sequences(spark, folder).select("image_id", F.aggregate(T.assistant_spans(marks, F.lit(1), F.lit(2)), F.lit(0), lambda s, x: s + x).alias("labelled"))


T1 = SEQ + ", m AS (SELECT image_id, ord, max(CASE WHEN t < 5 THEN ord END) OVER w AS s, max(CASE WHEN t > 44 THEN ord END) OVER w AS e FROM u WINDOW w AS (PARTITION BY image_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT image_id, count(*) FILTER (s IS NOT NULL AND (e IS NULL OR e < s))::INT AS labelled FROM m GROUP BY image_id"


def t2_mtp_blocks(spark, folder):
    blocks = T.mtp_blocks(F.col("tokens"), 3, (F.col("image_id") % 2).cast("int"), -1)
    return sequences(spark, folder).select("image_id", F.size(blocks).alias("blocks"), F.transform(blocks, lambda b: F.array_join(b["labels"].cast("array<string>"), "-")).alias("labels"), F.transform(blocks, lambda b: F.array_join(b["input"].cast("array<string>"), "/")).alias("input"))


T2 = SEQ + """, n AS (SELECT image_id, tokens, image_id % 2 AS o, greatest((len(tokens) - image_id % 2) // 3, 0) AS c FROM q)
SELECT image_id, c::INT AS blocks, list_transform(range(c), lambda i: array_to_string(tokens[o + i * 3 + 1:o + i * 3 + 3], '-')) AS labels, list_transform(range(c), lambda i: tokens[o + i * 3 + 1] || '/-1/-1') AS input FROM n"""


def t3_mtp_blocks_tagged(spark, folder):
    return sequences(spark, folder).select("image_id", T.mtp_blocks_tagged(F.col("tokens"), 4, F.sequence(F.lit(45), F.lit(49))).alias("blocks"))


T3 = SEQ + """, r(image_id, ord, n, out) AS (
  SELECT image_id, 0::BIGINT, 0, []::INT[] FROM q
  UNION ALL
  SELECT r.image_id, u.ord, CASE WHEN r.n + 1 = 4 OR u.t > 44 THEN 0 ELSE r.n + 1 END, CASE WHEN r.n + 1 = 4 OR u.t > 44 THEN list_append(r.out, r.n + 1) ELSE r.out END FROM r JOIN u ON u.image_id = r.image_id AND u.ord = r.ord + 1)
SELECT image_id, CASE WHEN n > 0 THEN list_append(out, n) ELSE out END AS blocks FROM r QUALIFY ord = max(ord) OVER (PARTITION BY image_id)"""


def t4_image_token_align(spark, folder):
    """Images whose declared tokens differ from those of their patches."""
    i = table(spark, folder, "images").filter("width > 0 and height > 0")
    tokens = F.expr("ceil(width / 28) * ceil(height / 28)")
    return i.select("image_id", tokens.cast("long").alias("tokens"), F.when(F.expr("image_id % 10 = 0"), tokens + 1).otherwise(tokens).cast("long").alias("declared")).filter("tokens <> declared")


T4 = "SELECT image_id, (ceil(width / 28.0) * ceil(height / 28.0))::BIGINT AS tokens, (ceil(width / 28.0) * ceil(height / 28.0))::BIGINT + 1 AS declared FROM images WHERE width > 0 AND height > 0 AND image_id % 10 = 0"


def t5_pred_pos(spark, folder):
    return sequences(spark, folder).select("image_id", T.pred_pos(F.transform("tokens", lambda t: t % 2 == 0)).alias("places"))


T5 = SEQ + """, g AS (SELECT *, t % 2 = 0 AND ord > 1 AS m, sum((NOT (t % 2 = 0 AND ord > 1))::INT) OVER (PARTITION BY image_id ORDER BY ord) AS isle FROM u),
p AS (SELECT image_id, ord, CASE WHEN m THEN sum(m::INT) OVER (PARTITION BY image_id, isle ORDER BY ord) ELSE 0 END::INT AS p FROM g) SELECT image_id, list(p ORDER BY ord) AS places FROM p GROUP BY image_id"""


def t6_x0_length(spark, folder):
    return sequences(spark, folder).select("image_id", T.x0_length(F.col("tokens")).alias("x0"))


T6 = SEQ + ", d AS (SELECT image_id, ord, t < lag(t) OVER (PARTITION BY image_id ORDER BY ord) AS f FROM u) SELECT image_id, coalesce(min(ord) FILTER (f) - 1, count(*))::INT AS x0 FROM d GROUP BY image_id"


def t7_visibility(spark, folder):
    """Keys that each query token may see: causal ones, and those of its own block of four, within its order."""
    rows = gt_boxes(spark, folder).select("image_id", "ord")
    pairs = rows.alias("q").join(rows.alias("k"), "image_id").filter("k.ord <= q.ord or (k.ord - 1) div 4 = (q.ord - 1) div 4")
    return pairs.groupBy("image_id", F.col("q.ord").alias("ord")).agg(F.count("*").alias("visible"))


T7 = SEQ + "SELECT q.image_id, q.ord, count(*) AS visible FROM u q JOIN u k ON k.image_id = q.image_id AND (k.ord <= q.ord OR (k.ord - 1) // 4 = (q.ord - 1) // 4) GROUP BY ALL"


def t8_block_pattern(spark, folder):
    frames = F.expr("case event_id % 7 when 0 then array('<|im_end|>') when 1 then array('<box>','none','</box>') when 2 then array('<box>','<1>','<2>','<3>','<4>','</box>') when 3 then array('<box>','<1>','<2>','</box>') when 4 then array('<box>','<1>','x') when 5 then array('<ref>','a') else array('a') end")
    return table(spark, folder, "events").groupBy(T.block_pattern(frames).alias("kind")).agg(F.count("*").alias("n"))


T8 = "SELECT ['im_end', 'empty_box', 'coord_box', 'point_box', 'error_box', 'ref_object', NULL][event_id % 7 + 1] AS kind, count(*) AS n FROM events GROUP BY ALL"


def logits(spark, folder):
    e = table(spark, folder, "embeddings")
    return e.select("vec_id", F.posexplode("embedding").alias("token", "logit")).withColumn("logit", F.round(F.col("logit").cast("double"), 4))


LOGITS = "l AS (SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INT AS token, round(unnest(embedding)::DOUBLE, 4) AS logit FROM embeddings)"


def t9_logit_filters(spark, folder):
    """Tokens kept by top-k 10 and by a nucleus of 0.5, the token that crosses it included, after a repetition penalty."""
    seen = F.col("token") % 5 == 0
    rows = logits(spark, folder).withColumn("logit", F.when(seen & (F.col("logit") > 0), F.col("logit") / 1.2).when(seen, F.col("logit") * 1.2).otherwise(F.col("logit")))
    order = W.partitionBy("vec_id").orderBy(F.col("logit").desc(), "token")
    share = F.exp("logit") / F.sum(F.exp("logit")).over(W.partitionBy("vec_id"))
    rows = rows.withColumn("rank", F.row_number().over(order)).withColumn("share", share).withColumn("before", F.coalesce(F.sum("share").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    return rows.groupBy("vec_id").agg(F.count_if(F.expr("rank <= 10")).alias("top_k"), F.count_if(F.expr("round(before, 9) < 0.5")).alias("nucleus"))


T9 = f"""WITH {LOGITS}, p AS (SELECT vec_id, token, CASE WHEN token % 5 = 0 AND logit > 0 THEN logit / 1.2::DOUBLE WHEN token % 5 = 0 THEN logit * 1.2::DOUBLE ELSE logit END AS logit FROM l),
s AS (SELECT vec_id, row_number() OVER w AS rank, coalesce(sum(x) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT *, exp(logit) / sum(exp(logit)) OVER (PARTITION BY vec_id) AS x FROM p) WINDOW w AS (PARTITION BY vec_id ORDER BY logit DESC, token))
SELECT vec_id, count(*) FILTER (rank <= 10) AS top_k, count(*) FILTER (round(before, 9) < 0.5) AS nucleus FROM s GROUP BY vec_id"""


# The shares at which a frame of six tokens is a box, an empty box or none, and when a coordinate is not sure.
START_SHARE, END_SHARE, NONE_SHARE, CLOSE_SHARE, NULL_SHARE, SURE_SHARE, WIDEST, KEPT = 0.7, 0.2, 0.2, 0.2, 0.1, 0.9, 60, 5
#: tokens of the test logits
BOX_START, BOX_END, NONE, NULL, IM_END, COORD_START, COORD_END = 0, 2, 4, 6, 8, 20, 126


def _frames(spark, folder):
    """(frame, place, token, share): six vectors in a row are the logits of a frame, sharpened, with a lift of the first and last token in some frames."""
    rows = logits(spark, folder).select(F.expr("vec_id div 6").alias("frame"), F.expr("vec_id % 6").alias("place"), (F.col("token") * 2).alias("token"), (F.col("logit") * 8).alias("logit"))
    lift = (
        F.when((F.col("place") == 0) & (F.col("token") == BOX_START) & F.expr("frame % 2 = 0"), 9.0)
        .when((F.col("place") == 5) & (F.col("token") == BOX_END) & F.expr("frame % 3 > 0"), 5.0)
        .when((F.col("place") == 1) & (F.col("token") == NONE) & F.expr("frame % 4 = 0"), 6.0)
        .when((F.col("place") == 2) & (F.col("token") == BOX_END) & F.expr("frame % 4 = 0"), 6.0)
        .when(F.col("place").isin(3, 4) & (F.col("token") == NULL) & F.expr("frame % 8 = 0"), 6.0)
        .otherwise(0.0)
    )
    lifted = rows.withColumn("logit", F.col("logit") + lift)
    whole = F.sum(F.exp("logit")).over(W.partitionBy("frame", "place"))
    return lifted.select("frame", "place", "token", F.round(F.exp("logit") / whole, 9).alias("share"))


def t10_decode_topk(spark, folder):
    """Each frame as a box with its four coordinates, an empty box, or nothing.

    A sure start followed by none, an end and nulls is an empty box; else enough mass on an end makes it a box. A coordinate is the first
    coordinate token among the five likeliest, 0 where it is not sure and the candidates lie far apart; a place without one spoils the box.
    """
    shares = _frames(spark, folder)
    at = lambda place, *tokens: F.coalesce(F.sum(F.when((F.col("place") == place) & F.col("token").isin(*tokens), F.col("share"))), F.lit(0.0))
    frames = shares.groupBy("frame").agg(
        ((at(0, BOX_START) >= START_SHARE) & (at(1, NONE) > NONE_SHARE) & (at(2, BOX_END) > CLOSE_SHARE) & (at(3, NULL) > NULL_SHARE) & (at(4, NULL) > NULL_SHARE)).alias("empty"),
        (F.round(at(5, BOX_END, NULL, IM_END), 8) >= END_SHARE).alias("legal"),
    )
    top = shares.filter("place between 1 and 4").withColumn("rank", F.row_number().over(W.partitionBy("frame", "place").orderBy(F.col("share").desc(), "token"))).filter(F.col("rank") <= KEPT)
    coord = F.col("token").between(COORD_START, COORD_END)
    places = top.filter(coord).groupBy("frame", "place").agg(F.min_by("token", "rank").alias("token"), F.min_by("share", "rank").alias("share"), F.count("*").alias("n"), (F.max("token") - F.min("token")).alias("spread"))
    unsure = (F.col("share") < SURE_SHARE) & (F.col("n") > 1) & (F.col("spread") > WIDEST)
    coords = places.withColumn("value", F.when(unsure, 0).otherwise(F.col("token"))).groupBy("frame").agg(F.count("*").alias("found"), F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("values"))
    box = F.coalesce(F.col("legal") & (F.col("found") == 4), F.lit(False))
    kind = F.when(F.col("empty"), "empty").when(box, "box").otherwise("nothing")
    return frames.join(coords, "frame", "left").select("frame", kind.alias("kind"), F.when(kind == "box", F.array_join(F.col("values").cast("array<string>"), " ")).alias("coords"))


T10 = f"""WITH {LOGITS}, r AS (SELECT vec_id // 6 AS frame, vec_id % 6 AS place, token * 2 AS token, logit * 8 AS logit FROM l),
f AS (SELECT frame, place, token, logit + CASE WHEN place = 0 AND token = 0 AND frame % 2 = 0 THEN 9.0 WHEN place = 5 AND token = 2 AND frame % 3 > 0 THEN 5.0 WHEN place = 1 AND token = 4 AND frame % 4 = 0 THEN 6.0
  WHEN place = 2 AND token = 2 AND frame % 4 = 0 THEN 6.0 WHEN place IN (3, 4) AND token = 6 AND frame % 8 = 0 THEN 6.0 ELSE 0.0 END::DOUBLE AS logit FROM r),
s AS (SELECT frame, place, token, round(exp(logit) / sum(exp(logit)) OVER (PARTITION BY frame, place), 9) AS share FROM f),
frames AS (SELECT frame, coalesce(sum(share) FILTER (place = 0 AND token = 0), 0) >= 0.7 AND coalesce(sum(share) FILTER (place = 1 AND token = 4), 0) > 0.2 AND coalesce(sum(share) FILTER (place = 2 AND token = 2), 0) > 0.2
  AND coalesce(sum(share) FILTER (place = 3 AND token = 6), 0) > 0.1 AND coalesce(sum(share) FILTER (place = 4 AND token = 6), 0) > 0.1 AS empty, round(coalesce(sum(share) FILTER (place = 5 AND token IN (2, 6, 8)), 0), 8) >= 0.2 AS legal FROM s GROUP BY frame),
top AS (SELECT *, row_number() OVER (PARTITION BY frame, place ORDER BY share DESC, token) AS rank FROM s WHERE place BETWEEN 1 AND 4 QUALIFY rank <= 5),
places AS (SELECT frame, place, arg_min(token, rank) AS token, arg_min(share, rank) AS share, count(*) AS n, max(token) - min(token) AS spread FROM top WHERE token BETWEEN 20 AND 126 GROUP BY ALL),
coords AS (SELECT frame, count(*) AS found, string_agg(CASE WHEN share < 0.9 AND n > 1 AND spread > 60 THEN 0 ELSE token END::VARCHAR, ' ' ORDER BY place) AS v FROM places GROUP BY frame)
SELECT frame, CASE WHEN empty THEN 'empty' WHEN legal AND found = 4 THEN 'box' ELSE 'nothing' END AS kind, CASE WHEN NOT empty AND legal AND found = 4 THEN v END AS coords FROM frames LEFT JOIN coords USING (frame)"""


def t11_focal_weights(spark, folder):
    counts = table(spark, folder, "manifest").groupBy("task").agg(F.count("*").alias("n")).withColumn("w", T.focal_weight(F.col("n")))
    return counts.select("task", F.round(F.col("w") / F.avg("w").over(W.partitionBy()), 9).alias("weight"))


T11 = "SELECT task, round(w / avg(w) OVER (), 9) AS weight FROM (SELECT task, (1 - 0.999::DOUBLE) / (1 - 0.999::DOUBLE ** count(*)) AS w FROM manifest GROUP BY task)"


def t12_seq_split(spark, folder):
    rows = gt_boxes(spark, folder).select("image_id", "ord", F.count("*").over(W.partitionBy("image_id")).alias("n"))
    return rows.select("image_id", "ord", T.seq_split(F.col("ord") - 1, F.col("n"), 3, "contiguous").alias("plain"), T.seq_split(F.col("ord") - 1, F.col("n"), 3, "zigzag").alias("zigzag"))


T12 = SEQ + ", n AS (SELECT image_id, ord, count(*) OVER (PARTITION BY image_id) AS n FROM u) SELECT image_id, ord, floor((ord - 1) * 3 / n)::INT AS plain, least(floor((ord - 1) * 6 / n), 5 - floor((ord - 1) * 6 / n))::INT AS zigzag FROM n"


def t13_cu_seqlens(spark, folder):
    return sequences(spark, folder).select("image_id", T.cu_seqlens(F.col("tokens")).alias("sums"), F.array_max("tokens").alias("longest"))


T13 = SEQ + ", s AS (SELECT image_id, ord, sum(t) OVER (PARTITION BY image_id ORDER BY ord)::BIGINT AS s, t FROM u) SELECT image_id, list_prepend(0::BIGINT, list(s ORDER BY ord)) AS sums, max(t) AS longest FROM s GROUP BY image_id"


def t14_pad_collate(spark, folder):
    return sequences(spark, folder).select("image_id", T.pad(F.col("tokens"), F.lit(6), -100).alias("padded"))


T14 = SEQ + "SELECT image_id, list_concat(tokens[1:6], list_transform(range(greatest(6 - len(tokens), 0)), lambda i: -100)) AS padded FROM q"


def t16_mode_switch(spark, folder):
    names = F.transform("tokens", lambda t: F.when(t < 15, "error_box").when(t < 25, "box_end").when(t > 47, "end").otherwise("step"))
    return sequences(spark, folder).select("image_id", T.mode_switches(names).alias("switches"))


T16 = SEQ + """, r(image_id, ord, par, done, n) AS (
  SELECT image_id, 0::BIGINT, true, false, 0 FROM q
  UNION ALL
  SELECT r.image_id, u.ord, CASE WHEN NOT done AND par AND t < 15 THEN false WHEN NOT done AND t >= 15 AND t < 25 THEN true ELSE par END, done OR t > 47, n + (NOT done AND par AND t < 15)::INT FROM r JOIN u ON u.image_id = r.image_id AND u.ord = r.ord + 1)
SELECT image_id, n AS switches FROM r QUALIFY ord = max(ord) OVER (PARTITION BY image_id)"""


def t17_strip_prompt(spark, folder):
    prompt = F.when(F.col("image_id") % 2 == 0, F.slice("tokens", 1, 2)).otherwise(F.array(F.lit(-7)))
    return sequences(spark, folder).select("image_id", F.size(T.strip_prompt(F.col("tokens"), prompt)).alias("left"))


T17 = SEQ + "SELECT image_id, CASE WHEN image_id % 2 = 0 THEN greatest(len(tokens) - 2, 0) ELSE len(tokens) END::INT AS left FROM q"

_SQL = {
    "t1_assistant_spans": T1, "t2_mtp_blocks": T2, "t3_mtp_blocks_tagged": T3, "t4_image_token_align": T4, "t5_pred_pos": T5, "t6_x0_length": T6, "t7_visibility": T7, "t8_block_pattern": T8, "t9_logit_filters": T9, "t10_decode_topk": T10, "t11_focal_weights": T11,
    "t12_seq_split": T12, "t13_cu_seqlens": T13, "t14_pad_collate": T14, "t16_mode_switch": T16, "t17_strip_prompt": T17,
}
QUERIES = {name: globals()[name] for name in _SQL}
SQL = {n: s.replace(" AS left ", ' AS "left" ') for n, s in _SQL.items()}
