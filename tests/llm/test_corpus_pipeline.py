"""The training-data pipeline on a small table with odd rows: three stages against brute force, mixture and run() by bounds."""

import random
from collections import Counter

import pytest

import corpus_pipeline as CP

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
_RNG = random.Random(4)
_VOCABULARY = ["".join(_RNG.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(400)]
PASSAGE = " ".join(_VOCABULARY[:50])


def rows():
    rng = random.Random(6)
    found = []
    for i in range(60):
        body = " ".join(rng.choices(_VOCABULARY, k=18))
        found.append((i, f"{body}\n{PASSAGE}" if i % 10 == 1 else body, "en", f"s{i % 4}"))
    found += [(200, PASSAGE, "en", "s1"), (201, None, "en", "s0"), (202, "", "en", None), (203, " \t\n", None, "s1"),
              (204, "123 !!! 456", "en", "s2"), (205, found[7][1], "en", "s3")]
    return [(i, t, l, s, None if t is None else len(t)) for i, t, l, s in found]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows(), DOCS).write.parquet(f"{path}/documents.parquet")
    return path


def lettered():
    return {i for i, t, *_ in rows() if t and any(c.isalpha() for c in t)}


def cleaned():
    """Rows after the lines stage: the passage stays in document 1, where it stands first; document 200 held nothing else."""
    return {i: t if i == 1 or not t else t.replace(f"\n{PASSAGE}", "") for i, t, *_ in rows() if i != 200}


def test_each_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert {r["doc_id"] for r in CP.language(spark, docs, folder).collect()} == lettered()
    lines = CP.lines(spark, docs, folder)
    assert lines.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == cleaned()
    some = docs.where("doc_id < 60 or doc_id = 205")
    assert sorted(r["doc_id"] for r in CP.near_duplicates(spark, some, folder).collect()) == list(range(60))
    mixed = Counter(r["doc_id"] for r in CP.mixture(spark, some, folder).collect())
    assert mixed and set(mixed) <= set(range(60)) | {205}


def test_run_with_odd_rows(spark, folder):
    out = CP.run(spark, folder).collect()
    assert out and {r["doc_id"] for r in out} <= (lettered() & set(cleaned())) - {205}
    assert all(0 < r["length"] <= r["doc_tokens"] and len(r["ids"]) == 4 * r["length"] for r in out)
