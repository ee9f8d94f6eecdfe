"""Labels, blocks and positions over arrays of token ids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def assistant_spans(tokens: Column, start: Column, end: Column) -> Column:
    """1 for tokens after a start mark up to and with the next end mark, else 0."""
    def step(state: Column, t: Column) -> Column:
        inside = state["inside"]
        return F.struct((F.when(t == start, True).when(t == end, False).otherwise(inside)).alias("inside"), F.array_append(state["out"], F.when(inside, 1).otherwise(0)).alias("out"))

    start_state = F.struct(F.lit(False).alias("inside"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(tokens, start_state, step)["out"]


def mtp_blocks(tokens: Column, size: int, offset: Column, mask: int) -> Column:
    """Blocks from an offset on: an anchor and masks as input, the anchor and the next tokens as labels; whole blocks only."""
    count = F.floor((F.size(tokens) - offset) / size).cast("int")
    starts = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: offset + i * size)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(F.concat(F.slice(tokens, s + 1, 1), F.array_repeat(F.lit(mask), size - 1)).alias("input"), F.slice(tokens, s + 1, size).alias("labels")))


def mtp_blocks_tagged(tokens: Column, size: int, ends: Column) -> Column:
    """Lengths of consecutive blocks of at most ``size`` tokens, each cut after the first token that ends one."""
    def step(state: Column, t: Column) -> Column:
        n = state["n"] + 1
        closes = (n == size) | F.array_contains(ends, t)
        return F.struct(F.when(closes, 0).otherwise(n).alias("n"), F.when(closes, F.array_append(state["out"], n)).otherwise(state["out"]).alias("out"))

    state = F.aggregate(tokens, F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("out")), step)
    return F.when(state["n"] > 0, F.array_append(state["out"], state["n"])).otherwise(state["out"])


def pred_pos(is_mask: Column) -> Column:
    """The place of a mask in its run of masks, 0 for other tokens; the first token is never counted."""
    def step(state: Column, m: Column) -> Column:
        n = F.when(m & (F.size(state["out"]) > 0), state["n"] + 1).otherwise(0)
        return F.struct(n.alias("n"), F.array_append(state["out"], n).alias("out"))

    return F.aggregate(is_mask, F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("out")), step)["out"]


def x0_length(position_ids: Column) -> Column:
    """The number of tokens before a position id is lower than the one before it; all if none is."""
    drops = F.filter(F.sequence(F.lit(1), F.greatest(F.size(position_ids) - 1, F.lit(1))), lambda i: F.coalesce(F.get(position_ids, i) < F.get(position_ids, i - 1), F.lit(False)))
    return F.coalesce(F.get(drops, F.lit(0)), F.size(position_ids))


def block_pattern(frame: Column) -> Column:
    """What a frame of six tokens is: end, empty box, coordinate box, point, label or an error."""
    token = lambda i: F.get(frame, F.lit(i))
    coord = lambda i: F.coalesce(token(i).rlike(r"^<[0-9]{1,4}>$"), F.lit(False))
    return (
        F.when(token(0) == "<|im_end|>", "im_end")
        .when((token(0) == "<box>") & (token(1) == "none") & (token(2) == "</box>"), "empty_box")
        .when((token(0) == "<box>") & coord(1) & coord(2) & coord(3) & coord(4) & (token(5) == "</box>"), "coord_box")
        .when((token(0) == "<box>") & coord(1) & coord(2) & (token(3) == "</box>"), "point_box")
        .when(token(0) == "<box>", "error_box")
        .when(token(0) == "<ref>", "ref_object")
    )


def seq_split(position: Column, length: Column, ranks: int, mode: str) -> Column:
    """The rank of a token of a sequence: contiguous parts, or zig-zag, where a rank has a part from either end."""
    if mode == "contiguous":
        return F.floor(position * ranks / length).cast("int")
    part = F.floor(position * (2 * ranks) / length).cast("int")
    return F.least(part, 2 * ranks - 1 - part)


def cu_seqlens(lengths: Column) -> Column:
    """Running sums of lengths, from 0."""
    return F.aggregate(lengths, F.array(F.lit(0).cast("long")), lambda s, n: F.array_append(s, F.element_at(s, -1) + n.cast("long")))


def pad(tokens: Column, length: Column, value: int) -> Column:
    return F.concat(F.slice(tokens, 1, length), F.array_repeat(F.lit(value), F.greatest(length - F.size(tokens), F.lit(0))))


def strip_prompt(output: Column, prompt: Column) -> Column:
    """The output without an echoed prompt in front."""
    return F.when(F.slice(output, 1, F.size(prompt)) == prompt, F.slice(output, F.size(prompt) + 1, F.size(output))).otherwise(output)


def mode_switches(events: Column) -> Column:
    """How often decoding falls back to single steps: on an error it does, at the end of a box it goes on in parallel; end stops."""
    def step(state: Column, e: Column) -> Column:
        live = ~state["done"]
        falls = live & state["parallel"] & (e == "error_box")
        return F.struct(
            F.when(falls, False).when(live & (e == "box_end"), True).otherwise(state["parallel"]).alias("parallel"),
            (state["done"] | (e == "end")).alias("done"),
            (state["n"] + falls.cast("int")).alias("n"),
        )

    return F.aggregate(events, F.struct(F.lit(True).alias("parallel"), F.lit(False).alias("done"), F.lit(0).alias("n")), step)["n"]


def focal_weight(count: Column, beta: float = 0.999) -> Column:
    """Weight of a class by its effective number of samples, not yet normalised."""
    return F.lit(1 - beta) / (1 - F.pow(F.lit(beta), count))
