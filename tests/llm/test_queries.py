from pathlib import Path

import pytest

from gridloom.llm.queries import QUERIES, SQL
from tests.sql_twin import connect, rows_of, sql_rows

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, name):
    assert rows_of(QUERIES[name](spark, FOLDER)) == sql_rows(connect(FOLDER), SQL[name])


def read(name):
    import pandas as pd

    return pd.read_parquet(f"{FOLDER}/{name}.parquet")


def p1_found(df):
    manifest = read("manifest").dropna(subset=["sample_id", "split"])
    side = manifest.assign(s=manifest["split"].str.strip().str.lower()).groupby("sample_id")["s"].agg(set)
    a, b = df["sample_id_a"].map(side), df["sample_id_b"].map(side)
    assert len(df) and (df["sample_id_a"] < df["sample_id_b"]).all() and not df.duplicated().any()
    assert all("train" in x | y and {"val", "test"} & (x | y) for x, y in zip(a, b))


def p1_report(df):
    assert len(df) and (df["pairs"] >= df["eval_samples"]).all() and set(df["eval_split"]) <= {"val", "test"} and df["mean_coverage"].between(0, 1).all()


def p2_packed(df):
    recipe, records = read("recipe"), read("annotations").dropna(subset=["record_id"])
    assert set(df["record_id"]) == set(records["record_id"])
    fills = df.dropna(subset=["container"]).groupby(["dataset", "container"])["tokens"].sum().reset_index()
    limit = fills["dataset"].map(recipe.groupby("dataset")["max_tokens"].max())
    assert (fills["tokens"] <= limit).all()
    pieces = df.groupby("record_id").agg(n=("piece", "size"), total=("tokens", "sum"), dataset=("dataset", "first"))
    long = pieces[pieces["n"] > 1]
    assert (long["total"] > long["dataset"].map(recipe.groupby("dataset")["max_tokens"].max())).all()


def p2_fill(df):
    assert (df["containers"] >= df["fewest"]).all() and df["used_share"].between(0, 1).all() and (df["tokens"] <= df["containers"] * df["capacity"]).all()


def p4_sample(df):
    samples = read("manifest")["sample_id"].dropna().nunique()
    assert not df["sample_id"].duplicated().any() and len(df) == round(samples / 10)


def p4_report(df):
    assert len(df) == len(read("label_targets")) and (df["quota"] <= df["available"]).all() and df["quota"].sum() == df["sample_rows"].max()
    unmet = df[(df["quota"] < df["min_rows"])]
    assert unmet["reason"].notna().all()


def p5_found(df):
    assert set(df["doc_id"]) <= set(read("documents")["doc_id"].dropna()) and set(df["item_id"]) <= set(read("heldout_items")["item_id"]) and not df.duplicated().any() and len(df)


def p5_leaks(df):
    assert set(df["kind"]) <= {"verbatim", "paraphrase"} and (df["lcs_share"] >= 0.75).all() and not df.duplicated(["doc_id", "item_id"]).any()


def p6_mix(df):
    documents, targets = read("documents"), read("mix_targets")
    caps = targets.assign(source=targets["source"].str.strip().str.lower()).groupby("source")["max_repeats"].max()
    assert len(df) and (df["uses"] <= df["source"].map(caps)).all() and set(df["doc_id"]) <= set(documents["doc_id"].dropna())


def p6_shares(df):
    targets = read("mix_targets")
    present = df.dropna(subset=["share_of_present"])
    assert len(df) == targets["source"].dropna().str.strip().str.lower().nunique() and abs(present["share_of_present"].sum() - 1) < 1e-5
    assert (df["mixed_tokens"] <= df["available_tokens"] * df["max_repeats"]).all() and "limits the total" in set(df["reason"])


def p7_found(df):
    texts = read("documents").dropna(subset=["text"]).set_index("doc_id")["text"]
    assert len(df) and not df.duplicated().any() and all(t in texts[d] for d, t in zip(df["doc_id"], df["pii_text"]) if d == d and d in texts.index and isinstance(texts[d], str))
    assert set(df["pii_kind"]) == {"person", "email", "phone", "idno", "street"}


def p7_redacted(df):
    documents = read("documents")
    assert len(df) == len(documents) and df["text"].isna().sum() == documents["text"].isna().sum() and df["text"].dropna().str.contains(r"\[PHONE\]").any()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_invariants(spark, name):
    globals()[name](QUERIES[name](spark, FOLDER).toPandas())
