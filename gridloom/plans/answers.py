"""Queries of the answer grammar over the annotation records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import grammar as P
from gridloom.sources.tables import table


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """record_id, task, turns, and the texts of both roles, each record once."""
    a = table(spark, folder, "annotations").filter("conversations is not null").select("record_id", "defect_type", "conversations", "image").distinct()
    return a.select("record_id", "defect_type", "image", F.col("conversations").alias("turns"), P.conversation_text(F.col("conversations"), "gpt").alias("gpt"), P.conversation_text(F.col("conversations"), "human").alias("human"))


_TEXT = "array_to_string(list_transform(list_filter(conversations, lambda t: t.speaker = '{r}'), lambda t: t.value), chr(10))"
ANSWERS = f"WITH a AS (SELECT DISTINCT record_id, defect_type, image, conversations AS turns, coalesce({_TEXT.format(r='gpt')}, '') AS gpt, coalesce({_TEXT.format(r='human')}, '') AS human FROM annotations WHERE conversations IS NOT NULL) "
_N = r"\s*<(-?[0-9]+(?:\.[0-9]+)?)>\s*"
_S = "<([0-9]+)>"


def _all(text: str, pattern: str, n: int, kind: str = "DOUBLE") -> str:
    """DuckDB: list of lists of the numbers of all matches."""
    inner = ", ".join(f"regexp_extract(m, '{pattern}', {i + 1})::{kind}" for i in range(n))
    return f"list_transform(regexp_extract_all({text}, '{pattern}'), lambda m: [{inner}])"


def p1_parse_ref_boxes(spark, folder):
    rows = answers(spark, folder).select("record_id", F.posexplode(P.parse_ref_boxes(F.col("gpt"))).alias("pos", "b"))
    return rows.select("record_id", "pos", "b.label", "b.coords")


def _p1(points: bool) -> str:
    pts = f"list_filter({_all('g', '<box>' + _N * 2 + '</box>', 2)}, lambda c: list_min(c) >= 0 AND list_max(c) <= 10000)"
    bxs = f"list_filter({_all('g', '<box>' + _N * 4 + '</box>', 4)}, lambda c: list_min(c) >= 0 AND list_max(c) <= 10000)"
    both = f"list_concat({pts}, {bxs})" if points else bxs
    return ANSWERS + f""", g AS (SELECT record_id, unnest(regexp_extract_all(gpt, '<ref>([^<]+)</ref>((?:<box>.*?</box>)+)')) AS g, generate_subscripts(regexp_extract_all(gpt, '<ref>([^<]+)</ref>((?:<box>.*?</box>)+)'), 1) AS k FROM a),
c AS (SELECT record_id, k, regexp_extract(g, '<ref>([^<]+)</ref>', 1) AS label, {both} AS cs FROM g),
f AS (SELECT record_id, k, label, unnest(cs) AS coords, generate_subscripts(cs, 1) AS j FROM c)
SELECT record_id, (row_number() OVER (PARTITION BY record_id ORDER BY k, j) - 1)::INT AS pos, label, coords FROM f"""


P1 = _p1(True)


def p2_parse_ref_boxes_only(spark, folder):
    rows = answers(spark, folder).select("record_id", F.posexplode(P.parse_ref_boxes(F.col("gpt"), points=False)).alias("pos", "b"))
    return rows.select("record_id", "pos", "b.label", "b.coords")


P2 = _p1(False)


def p3_parse_plain(spark, folder):
    rows = answers(spark, folder)
    return rows.select("record_id", F.size(P.parse_boxes_plain(F.col("gpt"), F.lit(720.0), F.lit(1600.0))).alias("boxes"), F.size(P.parse_points_plain(F.col("gpt"), F.lit(720.0), F.lit(1600.0))).alias("points"), F.round(F.aggregate(P.parse_boxes_plain(F.col("gpt"), F.lit(720.0), F.lit(1600.0)), F.lit(0.0), lambda s, b: s + b[0]), 6).alias("sum_x1"))


P3 = ANSWERS + f"SELECT record_id, len({_all('gpt', '<box>' + _S * 4 + '</box>', 4)})::INT AS boxes, len({_all('gpt', '<box>' + _S * 2 + '</box>', 2)})::INT AS points, round(coalesce(list_sum(list_transform({_all('gpt', '<box>' + _S * 4 + '</box>', 4)}, lambda b: b[1] / 1000 * 720)), 0), 6) AS sum_x1 FROM a"


def p4_parse_answer_repair(spark, folder):
    return answers(spark, folder).select("record_id", F.size(P.repaired_boxes(F.col("gpt"))).alias("boxes"), P.answer_status(F.col("gpt")).alias("status"))


_REPAIR = f"""list_distinct(list_filter(list_transform({_all('gpt', '<box>' + '[ ]*<(-?[0-9]+)>[ ]*' * 4 + '</box>', 4, 'BIGINT')}, lambda b: [least(greatest(least(b[1], b[3]), 0), 1000), least(greatest(least(b[2], b[4]), 0), 1000), least(greatest(greatest(b[1], b[3]), 0), 1000), least(greatest(greatest(b[2], b[4]), 0), 1000)]), lambda b: b[1] < b[3] AND b[2] < b[4]))"""
P4 = ANSWERS + f", r AS (SELECT record_id, gpt, len({_REPAIR})::INT AS boxes FROM a) SELECT record_id, boxes, CASE WHEN boxes > 0 THEN 'defect' WHEN contains(lower(gpt), '<box>none</box>') THEN 'ok' ELSE 'parse_error' END AS status FROM r"

ALIASES = [("text", "text"), ("mark", "mark"), ("find", "find"), ("place", "place"), ("any", "is there")]


def p5_identify_task(spark, folder):
    return answers(spark, folder).select("record_id", P.identify_task(F.col("human"), ALIASES).alias("task"))


P5 = ANSWERS + "SELECT record_id, CASE " + " ".join(f"WHEN contains(lower(human), '{a}') THEN '{t}'" for t, a in ALIASES) + " END AS task FROM a"


def p6_is_positive(spark, folder):
    return answers(spark, folder).groupBy(P.is_positive(F.col("gpt")).alias("positive"), (F.col("gpt") != P.NONE).alias("not_none")).agg(F.count("*").alias("n"))


P6 = ANSWERS + f"SELECT regexp_matches(gpt, '<box>{_S * 4}</box>') AS positive, gpt <> '<box>none</box>' AS not_none, count(*) AS n FROM a GROUP BY ALL"


def p7_conversation_text(spark, folder):
    return answers(spark, folder).select("record_id", F.length("human").alias("human_letters"), F.length("gpt").alias("gpt_letters"))


P7 = ANSWERS + "SELECT record_id, length(human)::INT AS human_letters, length(gpt)::INT AS gpt_letters FROM a"


def p8_extract_targets(spark, folder):
    t = P.extract_targets(F.col("gpt"), 4)
    return answers(spark, folder).select("record_id", t["boxes"].alias("boxes"), t["mask"].alias("mask"))


P8 = ANSWERS + f""", v AS (SELECT record_id, list_filter({_all('gpt', '<box>' + _S * 4 + '</box>', 4, 'INT')}, lambda b: b[1] < b[3] AND b[2] < b[4] AND b[3] <= 1000 AND b[4] <= 1000)[1:4] AS v FROM a)
SELECT record_id, list_concat(v, list_transform(range(4 - len(v)), lambda i: [0, 0, 0, 0])) AS boxes, list_concat(list_transform(v, lambda i: 1), list_transform(range(4 - len(v)), lambda i: 0)) AS mask FROM v"""


def p9_declared_count(spark, folder):
    return table(spark, folder, "documents").filter("lang like 'zh%'").select("doc_id", P.declared_count(F.col("text"), r"返回(\d+)\s*个框").alias("n"))


P9 = r"SELECT doc_id, try_cast(nullif(regexp_extract(text, '返回(\d+)\s*个框', 1), '') AS INT) AS n FROM documents WHERE lang LIKE 'zh%'"


def p10_normalize_categories(spark, folder):
    return table(spark, folder, "documents").select("doc_id", P.normalize_categories(F.array("source", F.concat(F.col("lang"), F.lit(" , ,"), F.col("source")), F.lit(None))).alias("categories"))


P10 = "SELECT doc_id, list_filter(x, lambda v, i: v <> '' AND list_position(x, v) = i) AS categories FROM (SELECT doc_id, list_concat([trim(coalesce(source, ''))], CASE WHEN lang IS NULL OR source IS NULL THEN [''] ELSE [trim(lang), '', trim(source)] END) AS x FROM documents)"


def p11_normalize_category_name(spark, folder):
    return table(spark, folder, "manifest").select("sample_id", P.normalize_category_name(F.col("expected_label"), F.col("kind") == "positive").alias("name")).distinct()


P11 = r"SELECT DISTINCT sample_id, CASE WHEN kind = 'positive' THEN regexp_replace(lower(expected_label), '[^\p{L}]', '', 'g') ELSE translate(expected_label, '_ ', '') END AS name FROM manifest"


def p12_coco_name_key(spark, folder):
    return table(spark, folder, "manifest").groupBy(P.coco_name_key(F.col("expected_label")).alias("key")).agg(F.count("*").alias("n"))


P12 = "SELECT replace(lower(expected_label), '_', ' ') AS key, count(*) AS n FROM manifest GROUP BY ALL"


def p13_build_prompt(spark, folder):
    kinds = list(P.PROMPTS)
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("record_id") % len(kinds)).cast("int") + 1)
    return answers(spark, folder).select("record_id", P.build_prompt(kind, F.coalesce("defect_type", F.lit("?"))).alias("prompt"))


P13 = ANSWERS + """SELECT record_id, CASE record_id % 9
  WHEN 0 THEN 'Locate all the instances that matches the following description: ' || d || '.'
  WHEN 1 THEN 'Detect all the objects in the image that belong to the category set: <visual_prompt>.'
  WHEN 2 THEN 'Locate a single instance that matches the following description: ' || d || '.'
  WHEN 3 THEN 'Locate all the instances that match the following description: ' || d || '.'
  WHEN 4 THEN 'Please locate the text referred as ' || d || '.'
  WHEN 5 THEN 'Detect all the text in box format.'
  WHEN 6 THEN 'Locate the region that matches the following description: ' || d || '.'
  ELSE 'Point to: ' || d || '.' END AS prompt FROM (SELECT record_id, coalesce(defect_type, '?') AS d FROM a)"""


def p13_detection_prompt(spark, folder):
    """The detection prompt of all labels of a task."""
    labels = table(spark, folder, "label_targets").groupBy("task").agg(F.array_sort(F.collect_set("expected_label")).alias("labels"))
    return labels.select("task", P.detection_prompt(F.col("labels")).alias("prompt"))


P13_DETECTION = "SELECT task, 'Locate all the instances that matches the following description: ' || string_agg(DISTINCT expected_label, '</c>' ORDER BY expected_label) || '.' AS prompt FROM label_targets GROUP BY task"


def p16_to_messages(spark, folder):
    """Messages of records whose turns name their image, and one that there is not."""
    rows = table(spark, folder, "annotations").filter("conversations is not null and size(conversations) > 0")
    turns = F.transform("conversations", lambda t: F.struct(t["speaker"].alias("from"), F.concat(F.coalesce(t["value"], F.lit("")), F.lit(" <image-1> <image-7>")).alias("value")))
    images = F.when(F.col("image").isNotNull(), F.array("image")).otherwise(F.coalesce("image_list", F.array().cast("array<string>")))
    messages = P.to_messages(turns, images)
    summed = F.transform(messages, lambda m: F.concat_ws(":", m["role"], F.array_join(m["content"]["type"], ","), F.array_join(F.slice(m["content"]["value"], 2, 9), ",")))
    return rows.select("record_id", F.array_join(summed, "|").alias("messages")).groupBy("record_id").agg(F.min("messages").alias("messages"))


P16 = """WITH r AS (SELECT record_id, conversations, CASE WHEN image IS NOT NULL THEN [image] ELSE coalesce(image_list, []) END AS images FROM annotations WHERE len(conversations) > 0),
m AS (SELECT record_id, list_transform(conversations, lambda t: {'who': t.speaker, 'media':
  list_filter(list_transform(regexp_extract_all(coalesce(t.value, '') || ' <image-1> <image-7>', '<image-([0-9]+)>', 1), lambda n: images[n::INT]), lambda x: x IS NOT NULL)}) AS parts FROM r)
SELECT record_id, min(array_to_string(list_transform(parts, lambda p: CASE WHEN p.who = 'human' THEN 'user:' || array_to_string(list_concat(['text'], list_transform(p.media, lambda x: 'image')), ',') || ':' || array_to_string(p.media, ',')
  ELSE 'assistant:text:' END), '|')) AS messages FROM m GROUP BY record_id"""


def p14_build_answer(spark, folder):
    """Answers built again from the boxes of the records with a single label."""
    boxes = P.repaired_boxes(F.col("gpt"))
    return answers(spark, folder).select("record_id", P.build_answer(F.coalesce("defect_type", F.lit("thing")), F.slice(boxes, 1, 2)).alias("answer"))


P14 = ANSWERS + f""", r AS (SELECT record_id, defect_type, list_filter(list_transform({_all('gpt', '<box>' + '[ ]*<(-?[0-9]+)>[ ]*' * 4 + '</box>', 4, 'BIGINT')}, lambda b: [least(b[1], b[3]), least(b[2], b[4]), greatest(b[1], b[3]), greatest(b[2], b[4])]), lambda b: least(greatest(b[1], 0), 1000) < least(greatest(b[3], 0), 1000) AND least(greatest(b[2], 0), 1000) < least(greatest(b[4], 0), 1000)) AS b0 FROM a),
q AS (SELECT record_id, defect_type, list_transform(b0, lambda b: list_transform(b, lambda v: least(greatest(v, 0), 1000))) AS b1 FROM r), d AS (SELECT record_id, defect_type, list_filter(b1, lambda b, i: list_position(b1, b) = i)[1:2] AS b FROM q)
SELECT record_id, CASE WHEN len(b) = 0 THEN '<box>none</box>' ELSE '<ref>' || coalesce(defect_type, 'thing') || '</ref>' || array_to_string(list_transform(b, lambda x: '<box>' || array_to_string(list_transform(x, lambda v: '<' || v || '>'), '') || '</box>'), '') END AS answer FROM d"""


def p15_media_placeholders(spark, folder):
    a = table(spark, folder, "annotations").filter("conversations is not null and size(conversations) > 0").select("record_id", "conversations", F.coalesce(F.size("image_list"), F.lit(1)).alias("images")).distinct()
    return a.select("record_id", P.media_placeholders(F.col("conversations"), F.when(F.col("images") > 0, F.col("images")).otherwise(1))[0].alias("first"))


P15 = """SELECT DISTINCT record_id, array_to_string(list_transform(range(1, CASE WHEN coalesce(len(image_list), 1) > 0 THEN coalesce(len(image_list), 1) ELSE 1 END + 1), lambda i: '<image-' || i || '>'), '') || coalesce(conversations[1].value, '') AS first
FROM annotations WHERE len(conversations) > 0"""


def p17_chat_template(spark, folder):
    return answers(spark, folder).select("record_id", F.sha2(P.chat_template(F.col("turns"), generate=True), 256).alias("digest"))


P17 = ANSWERS + """SELECT record_id, sha256('<|im_start|>system' || chr(10) || 'You are a helpful assistant.<|im_end|>' || chr(10) || array_to_string(list_transform(turns, lambda t: '<|im_start|>' || CASE t.speaker WHEN 'gpt' THEN 'assistant' WHEN 'human' THEN 'user' ELSE t.speaker END || chr(10) || coalesce(t.value, '') || '<|im_end|>' || chr(10)), '') || '<|im_start|>assistant' || chr(10)) AS digest FROM a"""


def p19_thinking_markers(spark, folder):
    text = F.concat(F.when(F.col("record_id") % 2 == 0, "<think> \n</think>\n").otherwise("<think>x</think>"), F.col("gpt"))
    return answers(spark, folder).select("record_id", F.length(P.strip_thinking(text)).alias("letters"))


P19 = ANSWERS + "SELECT record_id, (CASE WHEN record_id % 2 = 0 THEN length(regexp_replace(gpt, '^\\s+', '')) ELSE length(gpt) + 16 END)::INT AS letters FROM a"


def p21_replace_prompt(spark, folder):
    prompt = F.when(F.col("record_id") % 2 == 0, "Find {x} now").otherwise("Find it")
    return answers(spark, folder).select("record_id", P.replace_prompt(prompt, "{x}", F.coalesce("defect_type", F.lit("it"))).alias("prompt"))


P21 = ANSWERS + "SELECT record_id, CASE WHEN record_id % 2 = 0 THEN 'Find ' || coalesce(defect_type, 'it') || ' now' ELSE 'Find it' || chr(10) || coalesce(defect_type, 'it') END AS prompt FROM a"


def p22_data_source(spark, folder):
    return table(spark, folder, "manifest").groupBy(P.data_source(F.col("source")).alias("device")).agg(F.count("*").alias("n"))


P22 = "SELECT CASE WHEN source LIKE 'pc\\_%' ESCAPE '\\' THEN 'pc' WHEN source LIKE 'mobile\\_%' ESCAPE '\\' THEN 'mobile' WHEN source LIKE 'web\\_%' ESCAPE '\\' THEN 'web' END AS device, count(*) AS n FROM manifest GROUP BY ALL"


def p23_output_stem(spark, folder):
    """Stems of the image files and how many images share each."""
    return table(spark, folder, "images").groupBy(P.output_stem(F.col("image")).alias("stem")).agg(F.count("*").alias("n"))


P23 = r"SELECT replace(regexp_replace(regexp_extract(image, '([^/\\]*)$', 1), '\.[^.]*$', ''), ':', '_') AS stem, count(*) AS n FROM images GROUP BY ALL"


def f8_validate_sample(spark, folder):
    """Records that break the rules of a sample, with the rules broken."""
    a = answers(spark, folder)
    rules = {"turns": F.size("turns") == 2, "roles": (F.size("turns") == 2) & (F.get("turns", F.lit(0))["speaker"] == "human") & (F.get("turns", F.lit(1))["speaker"] == "gpt"), "image": F.coalesce(F.col("image"), F.lit("")) != "", "answer": P.answer_status(F.col("gpt")) != "parse_error"}
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()]))
    return a.select("record_id", F.array_join(broken, ",").alias("broken")).filter("broken <> ''").groupBy("broken").agg(F.count("*").alias("n"))


F8 = ANSWERS + f""", r AS (SELECT len(turns) = 2 AS turns2, len(turns) = 2 AND turns[1].speaker = 'human' AND turns[2].speaker = 'gpt' AS roles, coalesce(image, '') <> '' AS image, len({_REPAIR}) > 0 OR contains(lower(gpt), '<box>none</box>') AS answer FROM a),
b AS (SELECT array_to_string(list_filter([CASE WHEN NOT turns2 THEN 'turns' END, CASE WHEN NOT coalesce(roles, false) THEN 'roles' END, CASE WHEN NOT image THEN 'image' END, CASE WHEN NOT answer THEN 'answer' END], lambda x: x IS NOT NULL), ',') AS broken FROM r) SELECT broken, count(*) AS n FROM b WHERE broken <> '' GROUP BY broken"""


def c19_sort_boxes(spark, folder):
    return answers(spark, folder).select("record_id", F.array_sort(P.repaired_boxes(F.col("gpt"))).alias("boxes"))


C19 = ANSWERS + f"SELECT record_id, list_sort({_REPAIR}) AS boxes FROM a"

_SQL = {
    "p1_parse_ref_boxes": P1, "p2_parse_ref_boxes_only": P2, "p3_parse_plain": P3, "p4_parse_answer_repair": P4, "p5_identify_task": P5, "p6_is_positive": P6, "p7_conversation_text": P7, "p8_extract_targets": P8, "p9_declared_count": P9, "p10_normalize_categories": P10,
    "p11_normalize_category_name": P11, "p12_coco_name_key": P12, "p13_build_prompt": P13, "p13_detection_prompt": P13_DETECTION, "p16_to_messages": P16, "p14_build_answer": P14, "p15_media_placeholders": P15, "p17_chat_template": P17, "p19_thinking_markers": P19, "p21_replace_prompt": P21, "p22_data_source": P22,
    "p23_output_stem": P23, "f8_validate_sample": F8, "c19_sort_boxes": C19,
}
#: in the catalogue of queries the grammar's names begin with grammar_, as pN_ is taken by the pipeline's problems
QUERIES = {f"grammar_{n}" if n[0] == "p" else n: globals()[n] for n in _SQL}
SQL = {f"grammar_{n}" if n[0] == "p" else n: sql for n, sql in _SQL.items()}
