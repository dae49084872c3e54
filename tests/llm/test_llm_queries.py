import random

import duckdb
import pytest

from seriate.llm.bpe import encode, vocabulary
from seriate.llm.queries import ORACLES, QUERIES
from seriate.llm.subjects import assign_subjects

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(name, same_rows):
    same_rows(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_ids_of_all_documents(spark):
    vocab = vocabulary("/opt/tokenizers/byte_bpe_50k.json")
    got = {r["doc_id"]: r["ids"] for r in QUERIES["p7_ids"](spark, SF).collect()}
    want = {d: encode(t or "", vocab) for d, t in duckdb.execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()}
    assert got == want


def test_cleaned_documents_keep_no_leak(spark, tmp_path):
    """Every run of words that p8_found reports goes, in long documents too."""
    passage = [f"item{i}" for i in range(20)]
    docs = [(n, " ".join(["own", *passage[:n], *["filler"] * 200])) for n in (9, 10, 11, 13, 14)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(passage))], "item_id long, passage string").write.parquet(f"{tmp_path}/eval_items.parquet")
    out = {r["doc_id"]: r for r in QUERIES["p8_cleaned"](spark, str(tmp_path)).collect()}
    assert set(out) == {r["doc_id"] for r in QUERIES["p8_found"](spark, str(tmp_path)).collect()} == {10, 11, 13, 14}
    assert all(not r["dropped"] and r["removed_words"] == n and r["kept_text"] == "own  " + " ".join(["filler"] * 200) for n, r in out.items())


def test_subjects_of_held_out_labels(spark):
    """Fitted on two thirds of the labelled posts of a larger scale, compared with the rest of the labels, some of which are wrong."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/subject_labels.parquet")
    ids = sorted({r[0] for r in labels.select("doc_id").collect()})
    random.Random(2).shuffle(ids)
    train = set(ids[: 2 * len(ids) // 3])
    fit = spark.createDataFrame([tuple(r) for r in labels.collect() if r["doc_id"] in train], labels.schema)
    names = [r[0] for r in spark.read.parquet(f"{sf}/subjects.parquet").select("subject").collect()]
    got, want = {}, {}
    for r in assign_subjects(docs, fit, names).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    for r in labels.collect():
        if r["doc_id"] not in train:
            want.setdefault(r["doc_id"], set()).add(r["subject"].strip().lower())
    hits = sum(len(got.get(d, set()) & w) for d, w in want.items())
    wrong, missed = sum(len(got.get(d, set()) - w) for d, w in want.items()), sum(len(w - got.get(d, set()) - {"none"}) for d, w in want.items())
    assert hits / (hits + wrong) > 0.9 and hits / (hits + missed) > 0.8


def test_lengths_are_those_of_the_ids(spark):
    ids = {r["doc_id"]: len(r["ids"]) for r in QUERIES["p7_ids"](spark, SF).collect()}
    want = {}
    for d, lang, source in duckdb.execute(f"SELECT doc_id, lang, source FROM '{SF}/documents.parquet'").fetchall():
        n, tokens = want.get((lang, source), (0, 0))
        want[lang, source] = n + 1, tokens + ids[d]
    assert {(r["lang"], r["source"]): (r["n_docs"], r["n_tokens"]) for r in QUERIES["p7_lengths"](spark, SF).collect()} == want
