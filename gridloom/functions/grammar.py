"""The tagged answers, prompts and conversations of grounding data as column expressions.

An answer is groups of an optional ``<ref>label</ref>`` and boxes: four numbers, two numbers (a point) or ``none``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NONE = "<box>none</box>"
_NUMBER = r"\s*<(-?[0-9]+(?:\.[0-9]+)?)>\s*"
_BOX4, _BOX2 = rf"<box>{_NUMBER * 4}</box>", rf"<box>{_NUMBER * 2}</box>"
_STRICT4, _STRICT2 = "<box>" + "<([0-9]+)>" * 4 + "</box>", "<box>" + "<([0-9]+)>" * 2 + "</box>"
_SIGNED4 = r"<box>" + r"\s*<(-?[0-9]+)>\s*" * 4 + "</box>"
GROUP = r"<ref>([^<]+)</ref>((?:<box>.*?</box>)+)"


def _numbers(text: Column, pattern: str, n: int, kind: str = "double") -> Column:
    """array<array<number>> of all matches."""
    columns = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i + 1)) for i in range(n)]
    zipped = F.arrays_zip(*[c.alias(f"v{i}") for i, c in enumerate(columns)])
    return F.transform(zipped, lambda z: F.array(*[z[f"v{i}"].try_cast(kind) for i in range(n)]))


def _within(coords: Column, most: float = 10000) -> Column:
    return F.filter(coords, lambda c: F.forall(c, lambda v: v.between(0, most)))


def ref_groups(text: Column) -> Column:
    """array<struct<label, boxes>> of the labelled groups, boxes still being text."""
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(GROUP), F.lit(1)).alias("label"), F.regexp_extract_all(text, F.lit(GROUP), F.lit(2)).alias("boxes"))


def parse_ref_boxes(text: Column, points: bool = True) -> Column:
    """array<struct<label, coords>>: per labelled group its points, then its boxes, in range."""
    def of(group: Column) -> Column:
        boxes = _within(_numbers(group["boxes"], _BOX4, 4))
        coords = F.concat(_within(_numbers(group["boxes"], _BOX2, 2)), boxes) if points else boxes
        return F.transform(coords, lambda c: F.struct(group["label"].alias("label"), c.alias("coords")))

    return F.flatten(F.transform(ref_groups(text), of))


def parse_boxes_plain(text: Column, width: Column, height: Column) -> Column:
    """Strictly written boxes of an answer, labels aside, in pixels."""
    return F.transform(_numbers(text, _STRICT4, 4), lambda b: F.array(b[0] / 1000 * width, b[1] / 1000 * height, b[2] / 1000 * width, b[3] / 1000 * height))


def parse_points_plain(text: Column, width: Column, height: Column) -> Column:
    return F.transform(_numbers(text, _STRICT2, 2), lambda p: F.array(p[0] / 1000 * width, p[1] / 1000 * height))


def repaired_boxes(text: Column) -> Column:
    """Boxes clipped to 0..1000 with their corners in order, without empty ones, each once in order."""
    clip = lambda v: F.least(F.greatest(v, F.lit(0)), F.lit(1000))
    clipped = F.transform(_numbers(text, _SIGNED4, 4, "int"), lambda b: F.array(*[clip(b[i]) for i in range(4)]))
    ordered = F.transform(clipped, lambda b: F.array(F.least(b[0], b[2]), F.least(b[1], b[3]), F.greatest(b[0], b[2]), F.greatest(b[1], b[3])))
    return F.array_distinct(F.filter(ordered, lambda b: (b[0] < b[2]) & (b[1] < b[3])))


def answer_status(text: Column) -> Column:
    """defect if a box is left after repair, ok if the answer says none, else parse_error."""
    return F.when(F.size(repaired_boxes(text)) > 0, "defect").when(F.lower(text).contains(NONE), "ok").otherwise("parse_error")


def identify_task(text: Column, aliases: list[tuple[str, str]], explicit: Column | None = None) -> Column:
    """An explicit task, else the task of the first alias in table order that stands in the text; an unknown explicit one raises."""
    low, names = F.lower(text), sorted({task for task, _ in aliases})
    found = F.lit(None).cast("string")
    for task, alias in reversed(aliases):
        found = F.when(low.contains(alias), task).otherwise(found)
    if explicit is None:
        return found
    return F.when(explicit.isNull(), found).when(explicit.isin(names), explicit).otherwise(F.raise_error(F.concat(F.lit("unknown task "), explicit)).cast("string"))


def is_positive(text: Column) -> Column:
    """Whether a strictly written box stands in the answer."""
    return F.coalesce(text.rlike(_STRICT4), F.lit(False))


def conversation_text(turns: Column, role: str) -> Column:
    return F.array_join(F.transform(F.filter(turns, lambda t: t["speaker"] == role), lambda t: t["value"]), "\n")


def extract_targets(text: Column, most: int) -> Column:
    """struct<boxes, mask>: the first valid boxes, padded with zeros to a fixed number."""
    valid = F.filter(_numbers(text, _STRICT4, 4, "int"), lambda b: (b[0] < b[2]) & (b[1] < b[3]) & (b[2] <= 1000) & (b[3] <= 1000))
    boxes = F.slice(valid, 1, most)
    missing = F.lit(most) - F.size(boxes)
    zero = F.array(*[F.lit(0)] * 4)
    return F.struct(F.concat(boxes, F.array_repeat(zero, missing)).alias("boxes"), F.concat(F.array_repeat(F.lit(1), F.size(boxes)), F.array_repeat(F.lit(0), missing)).alias("mask"))


def declared_count(text: Column, pattern: str = r"(\d+)\s*个问题") -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("int")


def normalize_categories(values: Column) -> Column:
    """Items split at commas, trimmed, without empty ones, each once in order; null gives none."""
    split = F.flatten(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.transform(F.split(F.coalesce(v, F.lit("")), ","), lambda s: F.trim(s))))
    return F.array_distinct(F.filter(split, lambda v: v != ""))


def normalize_category_name(name: Column, detection: Column) -> Column:
    return F.when(detection, F.regexp_replace(F.lower(name), r"[^\p{L}]", "")).otherwise(F.translate(name, "_ ", ""))


def coco_name_key(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit("_"), F.lit(" "))


# The prompts that the models were trained on, by kind; {x} is the subject.
PROMPTS = {
    "detect": "Locate all the instances that matches the following description: {x}.",
    "visual": "Detect all the objects in the image that belong to the category set: <visual_prompt>.",
    "single": "Locate a single instance that matches the following description: {x}.",
    "multi": "Locate all the instances that match the following description: {x}.",
    "phrase": "Please locate the text referred as {x}.",
    "text": "Detect all the text in box format.",
    "gui_box": "Locate the region that matches the following description: {x}.",
    "gui_point": "Point to: {x}.",
    "point": "Point to: {x}.",
}
#: what stands between the categories of a detection prompt
CATEGORY_BREAK = "</c>"


def build_prompt(kind: Column, subject: Column) -> Column:
    """The prompt of a kind with its subject; an unknown kind gives null."""
    out = F.lit(None).cast("string")
    for name, text in PROMPTS.items():
        out = F.when(kind == name, F.replace(F.lit(text), F.lit("{x}"), subject)).otherwise(out)
    return out


def detection_prompt(categories: Column) -> Column:
    """The detection prompt of a list of categories."""
    return build_prompt(F.lit("detect"), F.array_join(categories, CATEGORY_BREAK))


def to_messages(turns: Column, images: Column) -> Column:
    """Turns as messages: a role and parts of type text or image. A user's placeholders <image-n> add the n-th image; numbers without an image add nothing."""
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("value"))

    def message(turn: Column) -> Column:
        numbers = F.regexp_extract_all(turn["value"], F.lit(r"<image-(\d+)>"), F.lit(1))
        media = F.filter(F.transform(numbers, lambda n: F.try_element_at(images, F.when(n.try_cast("int") > 0, n.try_cast("int")))), lambda x: x.isNotNull())
        human = turn["from"] == "human"
        own = F.array(part("text", turn["value"]))
        return F.struct(F.when(human, "user").otherwise("assistant").alias("role"), F.when(human, F.concat(own, F.transform(media, lambda x: part("image", x)))).otherwise(own).alias("content"))

    return F.transform(turns, message)


def build_answer(label: Column, boxes: Column) -> Column:
    """One label and all its boxes, or none; a label that is blank or holds a tag sign raises."""
    bad = (F.trim(label) == "") | label.rlike("[<>]")
    text = F.concat(F.lit("<ref>"), label, F.lit("</ref>"), F.array_join(F.transform(boxes, lambda b: F.concat(F.lit("<box>"), F.array_join(F.transform(b, lambda v: F.concat(F.lit("<"), v.cast("string"), F.lit(">"))), ""), F.lit("</box>"))), ""))
    return F.when(bad, F.raise_error(F.lit("bad label")).cast("string")).when(F.size(boxes) == 0, NONE).otherwise(text)


def media_placeholders(turns: Column, images: Column, tag: str = "image") -> Column:
    """Texts of the turns with numbered placeholders; those without one are put before the first turn."""
    mark = f"<{tag}>"

    def step(state: Column, text: Column) -> Column:
        parts = F.split(text, mark)
        numbered = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.struct(parts[0].alias("t"), state["n"].alias("n")), lambda s, p: F.struct(F.concat(s["t"], F.lit(f"<{tag}-"), (s["n"] + 1).cast("string"), F.lit(">"), p).alias("t"), (s["n"] + 1).alias("n")))
        return F.struct(numbered["n"].alias("n"), F.array_append(state["out"], numbered["t"]).alias("out"))

    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(F.transform(turns, lambda t: F.coalesce(t["value"], F.lit(""))), start, step)
    missing = F.when(images > done["n"], F.array_join(F.transform(F.sequence(done["n"] + 1, images), lambda i: F.concat(F.lit(f"<{tag}-"), i.cast("string"), F.lit(">"))), "")).otherwise("")
    return F.transform(done["out"], lambda t, i: F.when(i == 0, F.concat(missing, t)).otherwise(t))


def chat_template(turns: Column, system: str = "You are a helpful assistant.", generate: bool = False) -> Column:
    role = lambda t: F.when(t["speaker"] == "gpt", "assistant").otherwise(F.when(t["speaker"] == "human", "user").otherwise(t["speaker"]))
    body = F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|im_start|>"), role(t), F.lit("\n"), F.coalesce(t["value"], F.lit("")), F.lit("<|im_end|>\n"))), "")
    return F.concat(F.lit(f"<|im_start|>system\n{system}<|im_end|>\n"), body, F.lit("<|im_start|>assistant\n" if generate else ""))


def strip_thinking(text: Column) -> Column:
    """Answers without empty think blocks."""
    return F.regexp_replace(text, r"<think>\s*</think>\s*", "")


def replace_prompt(prompt: Column, marker: str, text: Column) -> Column:
    """The marker of a prompt replaced; without a marker the text goes to a line of its own at the end."""
    return F.when(prompt.contains(marker), F.replace(prompt, F.lit(marker), text)).otherwise(F.concat(prompt, F.lit("\n"), text))


def data_source(name: Column) -> Column:
    return F.when(name.startswith("pc_"), "pc").when(name.startswith("mobile_"), "mobile").when(name.startswith("web_"), "web")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def output_stem(path: Column) -> Column:
    return F.replace(F.regexp_replace(basename(path), r"\.[^.]*$", ""), F.lit(":"), F.lit("_"))
