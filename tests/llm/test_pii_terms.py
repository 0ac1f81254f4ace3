"""Disclosing terms are masked wherever they stand."""

import random

import pytest

from stratavox.llm import pii


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_disclosing_terms_far_from_their_entity(spark, monkeypatch, most):
    monkeypatch.setattr(pii, "MOST_TERMS", most)
    filler = [f"plain{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    rng = random.Random(2)
    rows = [(i, " ".join([*rng.sample(filler, 15), "zanzibar", "boss@corp.com", *rng.sample(filler, 15)])) for i in range(14)]
    rows += [(i, " ".join(rng.sample(filler, 40))) for i in [*range(14, 60), *range(100, 250)]]
    rows[0] = (0, "é Zanzibar " + " ".join(rng.sample(filler, 20)) + " zanzibar@corp.com " + rows[0][1])
    rows += [(60, "É the zanzibar of no address"), (61, "the zanzibar of no address"), (62, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    text = dict(rows)
    found = {r["doc_id"]: [x.split(":")[1:] for x in r["spans"].split(",") if x.startswith("term")] for r in pii.query(df).collect()}
    assert {d: [text[d][int(s) : int(e)] for s, e in own] for d, own in found.items() if own} == {0: ["Zanzibar", "zanzibar"], **{d: ["zanzibar"] for d in (*range(1, 14), 60, 61)}}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert not any("zanzibar" in (t or "").lower() for t in clean.values()) and clean[62] is None and clean[20] == text[20]
    assert "[EMAIL]" in clean[0] and clean[60].startswith("É the ")
