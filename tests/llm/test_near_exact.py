"""Near-duplicates whose pairs the rounds don't meet are linked all the same."""

import pytest

pytest.importorskip("public_tokenizers")

from tarifold.llm import op10_near  # noqa: E402


def test_links_do_not_depend_on_rounds(spark, monkeypatch):
    words = [f"w{k}" for k in range(80)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:-1])), (4, " ".join(words[:-2])), (3, " ".join(f"v{w}" for w in words))], "doc_id long, text string")
    for step in ("promising", "partners"):
        monkeypatch.setattr(op10_near, step, lambda *a, own=getattr(op10_near, step): own(*a).limit(0))
    assert {r.doc_id: r.class_id for r in op10_near.classes(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 1}
    assert {r.doc_id for r in op10_near.first_of_each(docs).collect()} == {1, 3}
