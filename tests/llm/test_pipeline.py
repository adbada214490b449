"""The pipeline's stages against a plain version of each, run on the stage's own input."""

import hashlib
from collections import Counter

import corpus_pipeline
from plinth.llm import bpe, mixing, secrets
from plinth.llm.common import table


def bag(df):
    return Counter(map(str, df.collect()))


def test_stages_follow_each_other(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    inputs = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, inputs[-1], sf)
        out.write.parquet(str(tmp_path / str(k)))
        inputs.append(spark.read.parquet(str(tmp_path / str(k))))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert inputs[-1].columns == columns, name
    raw, known, single, clean, mixed, encoded = inputs
    assert known.count() >= 0.99 * raw.count()
    ids = [r["doc_id"] for r in single.collect()]
    assert len(ids) == len(set(ids)) < known.count()
    first = {r["text"]: r["doc_id"] for r in sorted(known.collect(), key=lambda r: -r["doc_id"])}
    assert all(first[r["text"]] == r["doc_id"] for r in single.collect())
    for a, b in zip(sorted(single.collect()), sorted(clean.collect()), strict=True):
        spans = secrets.base_spans(a["text"])
        assert (a["text"] != b["text"]) >= bool(spans) and not secrets.base_spans(b["text"]) and b["n_chars"] == len(b["text"])
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(clean).collect()}
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({k: v for k, v in copies.items() if v})
    own = bpe.tokenizer(bpe.path(bpe.VOCABULARY))
    text = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert encoded.count() == mixed.count() and all(list(r["ids"]) == own.encode(text[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) for r in encoded.collect())
    assert bag(corpus_pipeline.run(spark, sf)) == bag(encoded)


def test_encoding_is_decoded_again(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.path(bpe.VOCABULARY))
    texts = ["Some words, twice: some words.", "naïve Σ 日本語", "", None, "tail\u2003end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in corpus_pipeline.encode(spark, df, "").collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert found[i]["ids"] == ids and found[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_stages_take_empty_tables(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == 0
