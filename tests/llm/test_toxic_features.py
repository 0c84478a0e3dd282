"""The toxicity model learns from whole texts, of a sample bounded by whole rows."""

import numpy as np

from traceloom.llm import op2_toxicity


def _sample(spark, monkeypatch):
    """What is learnt from, and the whole feature sets of the texts by their number of words."""
    texts = {i: " ".join(f"word{i}x{j}" for j in range(9000 if i % 4 == 0 else 30)) for i in range(40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id bigint, toxic int")
    seen = {}
    monkeypatch.setattr(op2_toxicity, "train", lambda positive, unlabelled, prior: seen.update(p=positive, u=unlabelled))
    op2_toxicity.fit(docs, labels)
    return seen, {op2_toxicity.features(op2_toxicity.lowered(t)).astype(np.int32).tobytes() for t in texts.values()}


def test_long_texts_are_learnt_from_whole(spark, monkeypatch):
    seen, whole = _sample(spark, monkeypatch)
    assert max(len(r) for r in seen["u"]) > 4096
    assert all(r.tobytes() in whole for r in seen["p"] + seen["u"])


def test_a_bounded_sample_has_whole_rows(spark, monkeypatch):
    monkeypatch.setattr(op2_toxicity, "UNLABELLED", 40)
    monkeypatch.setattr(op2_toxicity, "FEATURES_READ", 300)
    seen, whole = _sample(spark, monkeypatch)
    assert 0 < sum(len(r) for r in seen["u"]) <= 40 * 300 and all(r.tobytes() in whole for r in seen["u"])
