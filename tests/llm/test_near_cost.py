"""How many rounds and tables the search for near-duplicates takes."""

import pytest

pytest.importorskip("public_tokenizers")

from tarifold.llm import op10_near  # noqa: E402


def test_rounds_end_when_few_link(spark, monkeypatch):
    """A round links one of its eleven pairs, so it is the last; links that further rounds would bring are found all the same."""
    words = [f"w{k}" for k in range(80)]
    texts = [" ".join(words), " ".join(words[:-1]), " ".join(words[:-2])] + [" ".join(f"{c}{w}" for w in words) for c in "abcde"]
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    node = {r.doc_id: bytes(r.node) for r in op10_near.sign(docs).collect()}
    turns = []

    def partners(crowded, roots, sketches, tried, turn):
        turns.append(turn)
        pairs = [(i, j) for i in range(4, 9) for j in range(i + 1, 9)] + [(turn + 1, turn + 2)] * (turn < 2)
        return spark.createDataFrame([tuple(sorted((node[i], node[j]))) for i, j in pairs], "a binary, b binary")

    monkeypatch.setattr(op10_near, "promising", lambda *a, own=op10_near.promising: own(*a).limit(0))
    monkeypatch.setattr(op10_near, "partners", partners)
    assert {r.doc_id: r.class_id for r in op10_near.classes(docs).collect()} == {1: 1, 2: 1, 3: 1} | {k: k for k in range(4, 9)}
    assert turns == [0]


def test_components_write_a_table_a_step(spark, monkeypatch):
    calls = {"store": 0, "stars": 0}
    for name in calls:
        def counted(*a, own=getattr(op10_near, name), name=name):
            calls[name] += 1
            return own(*a)
        monkeypatch.setattr(op10_near, name, counted)
    links = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(30, 31), (31, 30), (31, 31)], "a long, b long")
    assert {tuple(r) for r in op10_near.components(links).collect()} == {(k, 0) for k in range(21)} | {(30, 30), (31, 30)}
    assert calls["store"] == calls["stars"] > 1
