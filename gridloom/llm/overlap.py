"""Same or near-same records across splits.

Every sample is normalised to short texts: the hex digits of its digest and the key of its capture. The texts of the
evaluation splits are cut into passages; passages and train texts are sharded by an anchor that equal texts share, an
Aho-Corasick automaton per shard scans the train texts of its shard, and the intervals matched at their own place are
merged. Two texts are linked if the merged intervals cover the whole passages of the shorter one from its begin on and the
letters after them agree; the intervals of all linked train texts together are the coverage of the evaluation record. Only
distinct texts are scanned. Pairs of samples are what links are expanded to for the list of pairs, by joins whose keys are salted;
the report multiplies counts of texts instead, so a hot capture costs it no pairs.

Defined results for odd input
-----------------------------
* null or unknown split, null, blank or malformed digest, image without app or capture number: no text, thus no pair.
* a sample delivered twice counts once; a pair found both ways comes out once; a sample is no partner of itself.
* empty tables give an empty result; extra columns are ignored; very long strings are normalised whole.
* apps with the same folded key count as one app.
"""

from __future__ import annotations

import base64
import binascii
import re
import unicodedata
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.layout import bounded, cut

HASH_LETTERS = 64
SHORTEST = 16
#: sha256 of empty input
EMPTY_DIGEST = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
SHARDS = 8192
LINKS = "eval_text string, train_text string, intervals array<struct<start:int,end:int>>"
SALTS = 16
#: apps is a small dimension; beyond this many rows the operator refuses to ship it to the executors
MAX_APPS = 200_000


def digest_text(value: str | None) -> str | None:
    """The hex digits that a digest denotes, whole or shortened; None if it denotes no file."""
    if value is None:
        return None
    text = re.sub(r"(?i)^sha-?256\s*[:=\-]?\s*", "", unicodedata.normalize("NFKC", value).strip())
    digits = re.sub(r"[\s:_\-]", "", re.sub(r"(?i)^(?:0x|\\x)", "", text)).lower()
    if not re.fullmatch(r"[0-9a-f]+", digits):
        try:
            raw = base64.b64decode(text.replace("-", "+").replace("_", "/").rstrip("=") + "=", validate=True)
        except (binascii.Error, ValueError):
            return None
        digits = raw.hex() if len(raw) * 2 == HASH_LETTERS else ""
    if not SHORTEST <= len(digits) <= HASH_LETTERS or not digits.strip("0") or EMPTY_DIGEST.startswith(digits):
        return None
    return digits


def fold(text: str) -> str:
    """Letters and digits of a text without case and accents."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))
    return "".join(c for c in bare if c.isalnum())


def capture_text(image: str | None, apps: dict[str, str], longest: int) -> str | None:
    """app|number|frame of an image path, None if it names no capture of a known app."""
    if image is None:
        return None
    path = unquote(image).replace("\\", "/").strip()
    parts = [p for p in re.split(r"[?#]", path, maxsplit=1)[0].split("/") if p.strip()]
    if not parts:
        return None
    name = parts[-1]
    app = apps.get(fold(parts[-2])) if len(parts) > 1 else None
    rest = name
    if app is None:
        head = ""
        for at, letter in enumerate(name):
            head += fold(letter)
            if len(head) > longest:
                break
            if head in apps:  # the longest head that is an app counts
                app, rest = apps[head], name[at + 1 :]
        if app is None:
            return None
    rest = unicodedata.normalize("NFKC", rest).lower()
    rest = re.sub(r"\.[a-z0-9]{1,5}\s*$", "", rest)
    number = re.search(r"[0-9]+", rest)
    if not number:
        return None
    frame = re.match(r"(?:.*?[\W_])?f(?:rame)?[\W_]*([0-9]+)(?![^\W_])", rest[number.end() :])
    return f"{app}|{int(number[0])}|{int(frame[1]) if frame else ''}"


def _split_of(column: Column) -> Column:
    name = F.regexp_replace(F.lower(column.cast("string")), r"[\s\p{Z}]", "")
    return F.when(name == "train", "train").when(name.isin("val", "test"), name)


def sample_texts(manifest: DataFrame, apps: DataFrame) -> DataFrame:
    """(sample_id, split, text): the normalised texts of the samples, each once."""
    keys = [r[0] for r in bounded(apps.select("app_key").filter("app_key is not null").distinct(), MAX_APPS, "apps")]
    folded = {fold(k): fold(k) for k in keys if fold(k)}
    longest = max(map(len, folded), default=0)

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for sample, split, digest, image in batch.itertuples(index=False):
                if key := digest_text(digest):
                    found.append((sample, split, "d" + key))
                if key := capture_text(image, folded, longest):
                    found.append((sample, split, "c" + key))
            yield pd.DataFrame(found, columns=["sample_id", "split", "text"])

    rows = manifest.select(F.col("sample_id").cast("long").alias("sample_id"), _split_of(F.col("split")).alias("split"), F.col("sha256").cast("string").alias("sha256"), F.col("image").cast("string").alias("image"))
    return rows.filter("split is not null and sample_id is not null").mapInPandas(texts, "sample_id long, split string, text string").distinct()


def passages(text: str) -> list[tuple[int, str]]:
    """(offset, passage): a digest's pieces of SHORTEST digits, the last one flush with its end; a capture whole."""
    if text[0] == "c":
        return [(0, text)]
    starts = [*range(1, len(text) - SHORTEST + 1, SHORTEST)]
    if starts[-1] + SHORTEST < len(text):
        starts.append(len(text) - SHORTEST)
    return [(0, text[: SHORTEST + 1]), *((s, text[s : s + SHORTEST]) for s in starts[1:])]


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The intervals without overlaps, touching ones as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(intervals):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def covered(text: str, other: str, intervals: list[tuple[int, int]]) -> bool:
    """Whether matched intervals show that two texts denote the same: they cover all whole passages of the shorter one."""
    shorter = min(len(text), len(other))
    first = merged(intervals)[0]
    if text[0] == "c":
        return first == (0, len(other)) and len(text) == len(other)
    whole = 1 + (shorter - 1) // SHORTEST * SHORTEST
    return first[0] == 0 and first[1] >= whole and text[whole:shorter] == other[whole:shorter]


def _scan_shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by shard, evaluation texts first: they build the automaton that scans the shard's train texts."""
    import ahocorasick

    shard, texts, automaton = None, [], None
    for batch in batches:
        links = []
        for number, train, text in batch.itertuples(index=False):
            if number != shard:
                shard, texts, automaton = number, [], None
            if not train:
                texts.append(text)
                continue
            if not texts:
                continue
            if automaton is None:
                places: dict[str, list[tuple[int, int]]] = {}
                for index, passage_text in enumerate(texts):
                    for offset, passage in passages(passage_text):
                        places.setdefault(passage, []).append((index, offset))
                automaton = ahocorasick.Automaton()
                for passage, at in places.items():
                    automaton.add_word(passage, (len(passage), at))
                automaton.make_automaton()
            hits: dict[int, list[tuple[int, int]]] = {}
            for end, (size, at) in automaton.iter(text):
                start = end + 1 - size
                for index, offset in at:
                    if start == offset:
                        hits.setdefault(index, []).append((start, end + 1))
            for index, intervals in hits.items():
                other = texts[index]
                if covered(text, other, intervals):
                    links.append((other, text, [{"start": a, "end": b} for a, b in merged(intervals)]))
        yield pd.DataFrame(links, columns=["eval_text", "train_text", "intervals"])


def text_links(texts: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(eval_text, train_text, intervals): the distinct texts of the two sides that denote the same file or capture."""
    anchor = F.when(F.col("text").startswith("d"), F.substring("text", 1, SHORTEST + 1)).otherwise(F.col("text"))
    sides = texts.select(F.pmod(F.xxhash64(anchor), F.lit(shards)).cast("int").alias("shard"), (F.col("split") == "train").alias("train"), "text").distinct()
    return sides.repartition("shard").sortWithinPartitions("shard", "train").mapInPandas(_scan_shards, LINKS)


def coverage_of(links: DataFrame) -> DataFrame:
    """(eval_text, coverage): the share of each evaluation text that the intervals of all its train texts cover together.

    The borders of the passages bound the number of different intervals of a text, so their set is small however many texts match.
    """
    spans = F.array_sort(F.flatten(F.collect_set("intervals")))
    zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("reach"))
    step = lambda at, x: F.struct((at["sum"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], at["reach"]))).alias("sum"), F.greatest(at["reach"], x["end"]).alias("reach"))
    return links.groupBy("eval_text").agg(spans.alias("spans")).select("eval_text", (F.aggregate("spans", zero, step)["sum"] / F.length("eval_text")).alias("coverage"))


def cross_split_pairs(manifest: DataFrame, apps: DataFrame, shards: int = SHARDS, salts: int = SALTS) -> DataFrame:
    """(eval_id, eval_split, train_id, kind): every evaluation sample with a train sample it repeats."""
    texts = cut(sample_texts(manifest, apps))  # normalised once, read three times
    links = text_links(texts, shards).select("eval_text", "train_text")
    members = texts.withColumn("salt", F.pmod(F.xxhash64("sample_id"), F.lit(salts)).cast("int"))
    spread = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    evaluation = members.filter("split <> 'train'").select(F.col("sample_id").alias("eval_id"), F.col("split").alias("eval_split"), F.col("text").alias("eval_text"), "salt")
    train = members.filter("split = 'train'").select(F.col("sample_id").alias("train_id"), F.col("text").alias("train_text"), "salt")
    first = spread(links).join(evaluation, ["eval_text", "salt"]).drop("salt")
    pairs = spread(first).join(train, ["train_text", "salt"])
    return pairs.filter("eval_id <> train_id").select("eval_id", "eval_split", "train_id", kind_of("eval_text").alias("kind"))


def kind_of(text: str) -> Column:
    return F.when(F.col(text).startswith("d"), "sha256").otherwise("image")


def found_pairs(pairs: DataFrame) -> DataFrame:
    """(sample_id_a, sample_id_b), the smaller id first, each pair once."""
    return pairs.select(F.least("eval_id", "train_id").alias("sample_id_a"), F.greatest("eval_id", "train_id").alias("sample_id_b")).distinct()


def overlap_report(manifest: DataFrame, apps: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Repeated evaluation samples, their pairs and mean coverage per evaluation split, source and kind; null sources count as one source.

    Samples with the same texts of a kind are one set of texts; each set meets each of its train samples once, and the
    counts of a set are multiplied by the number of its samples. A sample that is also in train is no partner of itself.
    """
    texts = cut(sample_texts(manifest, apps))
    links = cut(text_links(texts, shards))
    latest = manifest.filter("sample_id is not null").groupBy(F.col("sample_id").cast("long").alias("sample_id")).agg(F.max_by("source", F.coalesce("ingested_at", "captured_at")).alias("source"))
    linked = links.select(F.col("eval_text").alias("text")).distinct()
    samples = texts.filter("split <> 'train'").join(linked, "text").groupBy("sample_id", "split", kind_of("text").alias("kind")).agg(F.sort_array(F.collect_set("text")).alias("texts"))
    samples = cut(samples.withColumn("text_set", F.sha2(F.to_json("texts"), 256)))
    sets = samples.groupBy("text_set").agg(F.first("texts").alias("texts")).select("text_set", F.explode("texts").alias("eval_text"))
    train = texts.filter("split = 'train'").select(F.col("sample_id").alias("train_id"), F.col("text").alias("train_text"))
    partners = sets.join(links, "eval_text").select("text_set", "train_text").distinct()
    # counted in two steps, so that the train samples of a hot text are never in one task
    met = partners.join(train, "train_text").groupBy("text_set", "train_id").agg(F.lit(1).alias("one")).groupBy("text_set").agg(F.count("*").alias("partners"))
    share = sets.join(coverage_of(links), "eval_text").groupBy("text_set").agg(F.max("coverage").alias("coverage"))
    itself = samples.join(train, samples.sample_id == train.train_id).join(partners, ["text_set", "train_text"]).select("sample_id", "split", "kind").distinct().withColumn("itself", F.lit(1))
    known = samples.drop("texts").join(met, "text_set").join(share, "text_set").join(itself, ["sample_id", "split", "kind"], "left").join(latest, "sample_id")
    pairs = F.col("partners") - F.coalesce("itself", F.lit(0))
    return (
        known.filter(pairs > 0)
        .groupBy(F.col("split").alias("eval_split"), "source", "kind")
        .agg(F.count("*").alias("eval_samples"), F.sum(pairs).alias("pairs"), F.round(F.avg("coverage"), 6).alias("mean_coverage"))
    )
