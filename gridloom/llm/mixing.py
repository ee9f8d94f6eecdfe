"""A mixture of sources with target shares of all tokens.

Documents of different sources with the same text are one text, whose sources are those of its copies; the second, third
and further copies within a source are texts of their own, so that every document can be used. Texts are aggregated by the set of
their sources (the membership pattern); a min-cost flow routes the tokens of the patterns to the quotas of the sources,
where each further repetition of a text costs more than the one before (convex costs), so that repetition is spread and
as low as the quotas allow. The total is the largest that the capped repetitions can serve in the target shares, unless
one is given; the sources that keep it from being larger are named in the report. Within a pattern, texts are taken in a seeded order up to the tokens that the flow routes.

Defined results for odd input
-----------------------------
* null ids and null, empty or blank texts are left out; an id that comes more than once counts once.
* null sources and sources without target are in no quota. Sources are compared in lower case without blanks around.
* A target whose source has no texts is reported as absent; the shares of the others then hold relative to their sum.
* null or non-positive shares and repeats below 1 count as no target. Targets of one source are added, with the largest cap.
* Empty tables: empty mixture; the report has every target. Extra columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.llm.draws import positions
from gridloom.llm.packing import ranked
from gridloom.operators.layout import bounded, cut, small, spread_small

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
SEED = 31
#: sets of sources are few; more than this is refused
MOST_PATTERNS = 20_000
#: up to so many sources, the total follows from all sets of sources
MOST_SETS_OF = 12
BATCH = 128


def with_tokens(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, text_key, tokens) of the documents with text."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        encoder = Tokenizer.from_file(tokenizer)
        encoder.encode_special_tokens = True
        for batch in batches:
            sizes = []
            for at in range(0, len(batch), BATCH):
                sizes += [len(e.ids) for e in encoder.encode_batch_fast(batch["text"].iloc[at : at + BATCH].tolist(), add_special_tokens=False)]
            yield batch[["doc_id", "source", "text_key"]].assign(tokens=sizes)

    text = F.col("text").cast("string")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.trim(F.col("source").cast("string"))).alias("source"), F.sha2(text, 256).alias("text_key"), text.alias("text"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("source").isNotNull() & F.col("text").rlike(r"[^\s\p{Z}]"))
    return spread_small(rows).mapInPandas(count, "doc_id long, source string, text_key string, tokens long")


class Flow:
    """A network with integer capacities and costs; flow is sent along cheapest paths."""

    def __init__(self, nodes: int):
        self.edges: list[list] = []  # to, rest of capacity, cost
        self.out: list[list[int]] = [[] for _ in range(nodes)]

    def add(self, a: int, b: int, capacity: int, cost: int = 0) -> int:
        self.out[a].append(len(self.edges))
        self.edges.append([b, capacity, cost])
        self.out[b].append(len(self.edges))
        self.edges.append([a, 0, -cost])
        return len(self.edges) - 2

    def send(self, source: int, sink: int) -> tuple[int, int]:
        """(flow, cost) of the cheapest greatest flow."""
        total = cost = 0
        while True:
            far, via, queue, queued = {source: 0}, {}, deque([source]), {source}
            while queue:
                a = queue.popleft()
                queued.discard(a)
                for e in self.out[a]:
                    b, rest, price = self.edges[e]
                    if rest > 0 and far[a] + price < far.get(b, 1 << 62):
                        far[b], via[b] = far[a] + price, e
                        if b not in queued:
                            queued.add(b)
                            queue.append(b)
            if sink not in far:
                return total, cost
            path, b = [], sink
            while b != source:
                path.append(via[b])
                b = self.edges[via[b] ^ 1][0]
            amount = min(self.edges[e][1] for e in path)
            for e in path:
                self.edges[e][1] -= amount
                self.edges[e ^ 1][1] += amount
            total, cost = total + amount, cost + amount * far[sink]


def route(patterns: list[tuple[tuple[str, ...], int]], quotas: dict[str, int], repeats: dict[str, int]) -> tuple[int, list[tuple[int, int, str, int]]]:
    """(flow, routes): (pattern, repetition from 1, source, tokens), the cheapest way to serve as much as possible."""
    names = sorted(quotas)
    levels = [(p, r) for p, (sources, _) in enumerate(patterns) for r in range(1, max((repeats[s] for s in sources if s in quotas), default=0) + 1)]
    flow = Flow(2 + len(levels) + len(names))
    place = {s: 2 + len(levels) + i for i, s in enumerate(names)}
    arcs = []
    for i, (p, r) in enumerate(levels):
        sources, tokens = patterns[p]
        flow.add(0, 2 + i, tokens, r * r)
        arcs += [(p, r, s, flow.add(2 + i, place[s], tokens)) for s in sources if s in quotas and r <= repeats[s]]
    for s in names:
        flow.add(place[s], 1, quotas[s])
    sent, _ = flow.send(0, 1)
    return sent, [(p, r, s, flow.edges[e ^ 1][1]) for p, r, s, e in arcs if flow.edges[e ^ 1][1] > 0]


def shares_of(total: int, shares: dict[str, float]) -> dict[str, int]:
    whole = sum(shares.values())
    return {s: int(total * x / whole) for s, x in shares.items()}


def total_and_limits(patterns: list[tuple[tuple[str, ...], int]], shares: dict[str, float], repeats: dict[str, int]) -> tuple[int, set[str]]:
    """(the largest total whose quotas can all be served, the sources that limit it).

    By the theorem of the least cut, quotas can be served if and only if no set of sources wants more than the texts of its
    sources give with as many repetitions as the most patient of them allows; so the total is the least ratio of what a set can get to
    its share. Beyond MOST_SETS_OF sources, the sets are too many and the total is bisected over feasible flows.
    """
    names = sorted(shares)
    if len(names) > MOST_SETS_OF:
        return bisected_total(patterns, shares, repeats), set()
    sets = np.arange(1, 1 << len(names))
    order = sorted(range(len(names)), key=lambda i: -repeats[names[i]])
    supply = np.zeros(len(sets))
    for sources, tokens in patterns:
        most, open_ = np.zeros(len(sets)), np.ones(len(sets), dtype=bool)
        for i in order:
            if names[i] in sources:
                hit = open_ & (sets >> i & 1 == 1)
                most[hit] = repeats[names[i]]
                open_ &= ~hit
        supply += most * tokens
    whole = sum(shares.values())
    wanted = sum((sets >> i & 1) * (shares[name] / whole) for i, name in enumerate(names))
    ratio = supply / wanted
    least = int(ratio.argmin())  # of equal sets the one of the lowest number, which is no wider than it must be
    return int(ratio[least] * (1 + 1e-12)), {name for i, name in enumerate(names) if sets[least] >> i & 1}


def largest_total(patterns: list[tuple[tuple[str, ...], int]], shares: dict[str, float], repeats: dict[str, int]) -> int:
    """The largest total whose quotas can all be served."""
    return total_and_limits(patterns, shares, repeats)[0]


def bisected_total(patterns: list[tuple[tuple[str, ...], int]], shares: dict[str, float], repeats: dict[str, int]) -> int:
    low, high = 0, sum(tokens * max((repeats[s] for s in sources if s in shares), default=0) for sources, tokens in patterns)
    while low < high:
        middle = (low + high + 1) // 2
        quotas = shares_of(middle, shares)
        if route(patterns, quotas, repeats)[0] == sum(quotas.values()):
            low = middle
        else:
            high = middle - 1
        if high - low <= high // 1_000_000:
            break
    return low


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, tokenizer: str = TOKENIZER, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(mixture, report): documents with their source and number of uses; shares wanted and reached per source."""
    spark = documents.sparkSession
    wanted = targets.select(F.lower(F.trim(F.col("source").cast("string"))).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("repeats")).filter("source is not null")
    wanted = wanted.groupBy("source").agg(F.sum(F.when(F.col("share") > 0, F.col("share")).otherwise(0.0)).alias("share"), F.max(F.coalesce("repeats", F.lit(0))).alias("repeats"))
    goals = {r.source: (r.share, r.repeats) for r in bounded(wanted, MOST_PATTERNS, "sources")}
    rows = with_tokens(documents, tokenizer)
    names = [s for s, (share, repeats) in goals.items() if share > 0 and repeats >= 1]
    # the copies of a text are numbered within their source, so one of each source meets, and sources with a target are few
    copies = cut(rows.filter(F.col("source").isin(names)).groupBy("text_key", "source", "doc_id").agg(F.max("tokens").alias("tokens")))
    copies = ranked(copies, ["text_key", "source"], "doc_id")
    copies = copies.withColumn("text_key", F.when(F.col("rank") == 0, F.col("text_key")).otherwise(F.concat_ws("-", "text_key", "rank")))
    texts = copies.groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("source", "doc_id"))).alias("members"), F.max("tokens").alias("tokens"))
    texts = cut(texts.withColumn("pattern", F.array_join(F.col("members.source"), "\u001f")))
    found = texts.filter("tokens > 0").groupBy("pattern").agg(F.sum("tokens").alias("tokens"))
    patterns = sorted((tuple(r.pattern.split("\u001f")), int(r.tokens)) for r in bounded(found, MOST_PATTERNS, "sets of sources"))
    present = {s for sources, _ in patterns for s in sources}
    shares, repeats = {s: goals[s][0] for s in names if s in present}, {s: goals[s][1] for s in names}
    most, limiting = total_and_limits(patterns, shares, repeats) if shares else (0, set())
    total = most if total_tokens is None else total_tokens
    routes = route(patterns, shares_of(total, shares), repeats)[1] if shares else []
    # Where the tokens of a repetition end up: consecutive stretches of the seeded order of the pattern.
    stretches, reach = [], {}
    for p, r, s, tokens in sorted(routes):
        low = reach.get((p, r), 0)
        stretches.append(("\u001f".join(patterns[p][0]), r, s, low, low + tokens))
        reach[p, r] = low + tokens
    plan = spark.createDataFrame(stretches, "pattern string, repetition int, source string, low long, high long")
    placed = positions(texts.filter("tokens > 0"), ["pattern"], "text_key", F.col("tokens"), seed)
    middle = F.col("position") * 2 + F.col("tokens")
    used = placed.join(small(plan), "pattern").filter((middle >= F.col("low") * 2) & (middle < F.col("high") * 2))
    member = F.filter("members", lambda m: m["source"] == F.col("source"))[0]["doc_id"]
    mixed = used.select(member.alias("doc_id"), "source", "tokens").groupBy("doc_id", "source", "tokens").agg(F.count("*").cast("int").alias("uses"))
    have = texts.select(F.explode("members.source").alias("source"), "tokens").groupBy("source").agg(F.sum("tokens").alias("available_tokens"))
    reached = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("mixed_tokens"), F.max("uses").alias("most_uses"), F.count("*").alias("documents"))
    whole = sum(shares.values())
    wanted_rows = [(s, x, r, shares[s] / whole if s in shares else None, "absent" if s not in present and s in names else "no target" if s not in names else "limits the total" if s in limiting and total >= most else None) for s, (x, r) in sorted(goals.items())]
    report = spark.createDataFrame(wanted_rows, "source string, target_share double, max_repeats int, share_of_present double, reason string").join(small(have), "source", "left").join(small(reached), "source", "left")
    report = report.withColumn("all_tokens", F.sum("mixed_tokens").over(W.partitionBy())).select(
        "source", "target_share", F.round("share_of_present", 6).alias("share_of_present"), "max_repeats", F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"), F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
        F.round(F.coalesce(F.col("mixed_tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("reached_share"), "reason",
    )
    return mixed.select("doc_id", "source", "uses", "tokens"), report
