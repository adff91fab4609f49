"""Each stage of the pipeline against a plain version of its decision."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest

import corpus_pipeline as P
from loomfield.llm import bpe, jaccard, langid, secrets
from loomfield.llm.common import tokenizer_path

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


def test_stages_keep_columns(spark, docs):
    d = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, d, DATA).columns == d.columns, name
    assert P.ORACLE_SQL is None and len(P.STAGES) == 5


def test_language_stage_drops_only_texts_without_letters(spark, docs, table):
    d = docs.select("doc_id", "text", "lang", "source", "n_chars")
    got = Counter(r["doc_id"] for r in P.identify_language(spark, d, DATA).collect())
    assert got == Counter(r["doc_id"] for r in d.collect() if r["text"] and any(c.isalpha() for c in r["text"]))
    assert P.identify_language(spark, table, DATA).count() == table.count()
    assert langid.train(table).languages == ["de", "en", "es", "fr"]


def test_near_copies_stage(spark, docs, table):
    found = jaccard.similar_components(table).collect()
    kept = {r["doc_id"] for r in P.drop_near_copies(spark, table, DATA).collect()}
    assert kept == {r["component_id"] for r in found}
    odd = P.drop_near_copies(spark, docs.select("doc_id", "text", "lang", "source", "n_chars"), DATA).collect()
    ids = [r["doc_id"] for r in odd if r["doc_id"] is not None]
    assert len(ids) == len(set(ids)) and 0 in ids and 1 not in ids and {5, 6, 7} <= set(ids)


def test_near_copies_stage_tells_rows_apart(spark):
    words = [f"{w}{i}" for i in range(4) for w in "the quiet river runs past an old mill where nobody ever stops to rest".split()]
    a, b, c, d = (" ".join(x + k for x in words) for k in ("a", "b", "c", "d"))
    near = a + " and more"
    rows = [(1, a, "x"), (2, b, "x"), (2, near, "x"), (2, c, "x"), (2, c, "y"), (None, a, "x"), (None, near, "x"), (None, d, "x"), (None, d, "x"), (None, d + " indeed", "x"), (None, "", "x"), (3, "", "x"), (4, "", "x")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    runs = [P.drop_near_copies(spark, table.repartition(n, "text"), DATA).collect() for n in (1, 5)]
    assert Counter(map(tuple, runs[0])) == Counter(map(tuple, runs[1]))
    got = Counter(map(tuple, runs[0]))
    last = [r for r in got if r[0] is None and r[1]]
    assert len(last) == 1 and last[0][1] in (d, d + " indeed")
    assert got - Counter(last) == Counter([(1, a, "x"), (2, b, "x"), (2, c, "x"), (None, "", "x"), (3, "", "x"), (4, "", "x")])


def test_secret_stage_changes_only_texts_with_secrets(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r["doc_id"] for r in secrets.scan(rows).where("spans <> ''").collect()}
    before = {r["doc_id"]: r["text"] for r in rows.collect()}
    after = P.blank_secrets(spark, rows, DATA).collect()
    assert found and {r["doc_id"] for r in after if "[SECRET]" in r["text"]} == found
    assert len(after) == len(before)
    for r in after:
        assert (r["text"] == before[r["doc_id"]]) == ("[SECRET]" not in r["text"]) and r["n_chars"] == len(r["text"])


def test_mix_stage_repeats_rows(spark, table):
    n = Counter(r["doc_id"] for r in P.mix_sources(spark, table, DATA).collect())
    assert set(n.values()) <= {1, 2} and len(n) <= table.count()


def test_run(spark):
    rows = P.run(spark, DATA).collect()
    assert rows == P.run(spark, DATA).collect() or Counter(map(tuple, rows)) == Counter(map(tuple, P.run(spark, DATA).collect()))
    empty = hashlib.sha256(b"").hexdigest()
    assert all((r["n_tokens"] == 0) == (r["decoded_sha256"] == empty) for r in rows)


def test_last_stage(spark, table):
    c = bpe.codec(tokenizer_path(bpe.VOCABULARY))
    want = {r["doc_id"]: (len(c.leaf(r["text"])), hashlib.sha256(r["text"].encode()).hexdigest()) for r in table.collect()}
    assert {r["doc_id"]: (r["n_tokens"], r["decoded_sha256"]) for r in P.encode_texts(spark, table, DATA).collect()} == want
