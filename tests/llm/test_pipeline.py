"""The corpus pipeline against a brute-force version, stage by stage."""

import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from test_dedup import roots, slow_fingerprint
from test_queries import crc, plain_language, plain_languages, plain_toxicity

from foliant.llm import language, toxicity
from foliant.llm.common import table

DATA = "/root/testdata/sf0.001"


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "simhash", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_against_brute_force(spark):
    """Each stage by plain code; of the operators' own only the toxicity machine's weights are taken."""
    from tokenizers import Tokenizer

    docs = table(spark, DATA, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    machine = toxicity.fit(docs, table(spark, DATA, "labels"))
    kept = {k for k, r in rows.items() if plain_toxicity(machine, r.text) < corpus_pipeline.TOXIC}
    assert 0 < len(kept) < len(rows)
    # Training takes whole texts of up to 20,000 characters, and the heads of longer ones.
    learn = [(rows[k].text[:20_000], rows[k].lang) for k in sorted(kept, key=str) if rows[k].lang is not None and rows[k].text is not None and crc(k, 4) != 2]
    model = plain_languages(learn)
    for k in list(kept):
        said = plain_language(model, rows[k].text)
        if said is None or said[1] < corpus_pipeline.SURE or said[2] > corpus_pipeline.ALIKE * said[1]:
            kept.remove(k)
    fp = {k: slow_fingerprint(rows[k].text) for k in kept}
    group = roots(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2])
    kept = {k for k in kept if group[k] == k}
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = set()
    for k in kept:
        data = np.array([*lib.encode(rows[k].text, add_special_tokens=False).ids, 1], "<u4").tobytes()
        n, at = len(data) // 4, 0
        while at < n:
            size = min(2048, 1 << (n - at).bit_length() - 1)
            want.add((k, at, size, zlib.crc32(data[4 * at : 4 * (at + size)]), n))
            at += size
    out = corpus_pipeline.run(spark, DATA).collect()
    assert len(out) == len(want) and {(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out} == want


@pytest.mark.parametrize("k", range(3))
def test_stages_keep_columns_nulls_and_empty_tables(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    docs = table(spark, DATA, "documents")
    odd = spark.createDataFrame([(10_001, None, None, None, None), (10_002, "", "en", "s", 0), (None, "the and of that", "en", "s", 3)], docs.schema)
    out = stage(spark, docs.limit(60).union(odd), DATA)
    assert out.columns == docs.columns
    ids = {r.doc_id for r in out.collect()}
    if name == "language":
        assert not ids & {10_001, 10_002}
    assert stage(spark, docs.where("false"), DATA).count() == 0


def test_of_two_languages_an_even_mixture_is_rejected(spark, monkeypatch):
    text = {"a": "the cat sat on the mat ", "b": "zoo quux jynx vow fez "}
    x = [language._counts(t) for t in text.values()]
    model = language.fit_ecoc(np.array(x), list(text))
    mixed = next(t for t in (text["a"] * i + text["b"] * (40 - i) for i in range(1, 40)) if model.decode(language._counts(t)[None, :], corpus_pipeline.ALIKE)[2][0])
    monkeypatch.setattr(language, "fit", lambda docs: model)
    docs = spark.createDataFrame([(1, text["a"]), (2, text["b"]), (3, mixed), (4, "12 3")], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.drop_unidentified(spark, docs, DATA).collect()} == {1, 2}
