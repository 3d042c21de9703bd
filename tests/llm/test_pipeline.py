"""The pipeline against a plain version of its stages."""

import sys
from pathlib import Path

import public_tokenizers
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))
import corpus_pipeline
from awardgrid.llm import secrets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        out[name] = docs.toPandas()
    return out


def test_stages(spark, stages):
    from test_operators import brute_components

    documents = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    assert list(stages) == ["language", "near_dedup", "decontamination", "secrets", "packing"]
    assert all(list(stages[s].columns) == list(corpus_pipeline.COLUMNS) for s in list(stages)[:-1])
    spoken = stages["language"]
    assert set(spoken.doc_id) == {d for d, t in zip(documents.doc_id, documents.text, strict=True) if any(c.isalpha() for c in t)}
    parts = brute_components(list(zip(spoken.doc_id, spoken.text, strict=True)), 5)
    assert set(stages["near_dedup"].doc_id) == {d for d, (_, root) in parts.items() if d == root}
    clean = stages["secrets"].set_index("doc_id")
    model = secrets.default_model()
    for d, t in zip(stages["decontamination"].doc_id, stages["decontamination"].text, strict=True):
        assert clean.text[d] == secrets.redact(t, secrets.all_spans(t, model)[1]) and clean.n_chars[d] == len(clean.text[d])
    packed = stages["packing"]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert packed.groupby("doc_id").length.sum().to_dict() == {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in clean.text.items()}


def test_run(spark, stages):
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert len(out) == len(stages["packing"]) and out.length.sum() == stages["packing"].length.sum()
    assert corpus_pipeline.ORACLE_SQL is None


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, "..."), (4, "some plain words here"), (4, "some plain words here"), (5, "some plain words here"), (None, "a row without an id")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.where("false")):
        out = frame
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, SF)
        out.collect()


def test_clashing_columns(spark):
    """Columns that stages use inside, on the documents: they are dropped, and nothing else changes."""
    rows = [(i, f"plain words that make document number {i} what it is and nothing else", "en", "s", 60) for i in range(6)]
    plain = "doc_id long, text string, lang string, source string, n_chars long"
    more = "kept boolean, lang_pred string, redacted string, rep long, group long, h long, n long, doc long, item long, score double"
    extra = tuple([None] * len(more.split(",")))
    one, two = spark.createDataFrame(rows, plain), spark.createDataFrame([r + extra for r in rows], f"{plain}, {more}")
    for name, stage in corpus_pipeline.STAGES:
        a, b = stage(spark, one, SF), stage(spark, two, SF)
        assert a.columns == b.columns
        by = ["doc_id", "start"] if name == "packing" else ["doc_id"]
        assert a.drop("sequence_id", "offset").orderBy(*by).collect() == b.drop("sequence_id", "offset").orderBy(*by).collect()
        one = two = a.cache()
