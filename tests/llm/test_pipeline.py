from pathlib import Path

import pytest

import corpus_pipeline
from palimpsest.llm.common import Workspace
from palimpsest.llm.packing import cut, token_ids
from palimpsest.llm.quality import fit_machine, features
from palimpsest.llm.secrets import base_spans, masked
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_nearcopies import brute as components

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_stages_as_brute_force(spark):
    P = pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    machine = fit_machine(docs, spark.read.parquet(str(DATA / "labels.parquet")))
    items = [tuple(r) for r in spark.read.parquet(str(DATA / "benchmark.parquet")).select("item_id", "text").collect()]
    rows = [tuple(r) for r in docs.select("doc_id", "text", "n_chars").collect()]
    steps = [rows := [r[:2] for r in rows if machine.score(*features(r[1].encode(), r[2])) >= 0.3]]
    first = {c for _, c in components(rows)}
    steps.append(rows := [r for r in rows if r[0] in first])
    bad = {r[0] for r in contaminated(rows, items) if r[-1]}
    steps.append(rows := [r for r in rows if r[0] not in bad])
    now, ws = docs, Workspace(spark)
    for (name, stage), want in zip(corpus_pipeline.STAGES[:3], steps):
        now = ws.save(stage(spark, now, str(DATA)), name.split()[0])
        assert now.columns == docs.columns
        assert sorted(map(tuple, now.select("doc_id", "text").collect())) == sorted(want), name
    now = ws.save(corpus_pipeline.mask_secrets(spark, now, str(DATA)), "masked")
    got = {r.doc_id: r for r in now.collect()}
    assert set(got) == {d for d, _ in rows}
    for d, t in rows:
        if not base_spans(t):
            assert got[d].text == t or "[secret]" in got[d].text
        elif "[secret]" in got[d].text:
            assert all(t[a:b] not in got[d].text for _, a, b in base_spans(t)) and got[d].n_chars == len(got[d].text)
        assert not base_spans(got[d].text)
    last = corpus_pipeline.packing(spark, now, str(DATA)).collect()
    args = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    want = sorted((d, p, s, n) for d, r in got.items() for p, (s, n) in enumerate(cut(len(token_ids(r.text, *args)) + 1, 2048)))
    assert sorted((r.doc_id, r.piece, r.start, r.length) for r in last) == want
    assert masked("ab", []) == "ab"


def test_one_of_each_group(spark):
    """A text without a doc_id goes if another of its group has one; of rows with the smallest doc_id one stays."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(d, "the same few words of text here", "en", "s", 31) for d in (None, 4, 4, 9)] + [(5, "quite another text with words of its own", "en", "s", 40)]
    kept = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, schema), "").collect()
    assert sorted(r.doc_id for r in kept) == [4, 5]


def test_edges(spark):
    """Nulls, repeated rows, a clashing column and an empty table pass through every stage."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _masked string, spans string, _t1 long, d int, `_row` int"
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "Some words here", "en", "s", 15), (2, "token = 0123456789abcdef0123", "en", "s", 28), (3, "x " * 60_000, "en", "s", 120_000)]
    rows = [(*r, "c", "other", 4, 5, 6) for r in rows]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES[1:4]:
            docs = stage(spark, docs, str(DATA))
            assert docs.columns == [c.split()[0].strip("`") for c in schema.split(", ")], name
        assert all(tuple(r)[5:] == ("c", "other", 4, 5, 6) for r in docs.collect())
        kept = docs.collect()
        assert sorted(str(r.doc_id) for r in kept) == (["1", "2", "3", "None"] if data else [])
        assert [r.text for r in kept if r.doc_id == 2] == (["[secret]"] if data else [])


def test_rows_of_one_doc_id(spark, tmp_path):
    """Rows that share a doc_id, or have none, go or stay each by its own text."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    copy, other, third, bad = ("the same few words of text here", "quite another text with words of its own", "nothing like the rest of these at all", " ".join(f"item{k}" for k in range(13)))
    rows = [(1, copy), (None, copy), (None, other), (None, third), (7, copy), (7, "a seventh text that no other row repeats"), (7, bad), (8, bad + " and then quite a few other words behind them"), (8, "eighth and clean but of a repeated number")]
    rows += [(None, other), (8, "eighth and clean but of a repeated number")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], schema)
    kept = corpus_pipeline.near_copies(spark, docs, "")
    texts = lambda df: sorted((str(r.doc_id), r.text) for r in df.collect())
    want = {(str(d), t) for d, t in rows if t != copy or d == 1}
    assert texts(kept) == sorted(want)
    spark.createDataFrame([(1, bad)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert texts(corpus_pipeline.decontaminate(spark, kept, str(tmp_path))) == sorted(x for x in want if bad not in x[1])
