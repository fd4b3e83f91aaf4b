"""The last search for near-duplicates gives links, not pairs, and looks at every promising pair."""

import itertools

import pytest

pytest.importorskip("public_tokenizers")

from tarifold.llm import op10_near  # noqa: E402


@pytest.mark.parametrize("most", [1 << 20, 1 << 13])
def test_crowded_buckets_give_links_only(spark, monkeypatch, most):
    """Sixty pairs of alike texts that share a passage with all others; blocks that hold all, and that hold few."""
    monkeypatch.setattr(op10_near, "BLOCK_BYTES", most, raising=False)
    passage = [f"w{k}" for k in range(80)]
    words = {k: [*passage, *(f"v{k // 2}x{j}" for j in range(11)), f"end{k}"] for k in range(120)}
    words |= {120: words[7] * 2, 121: words[7] * 3}  # with weights
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in words.items()], "doc_id long, text string")
    signed = {r.doc_id: r for r in op10_near.sign(docs).collect()}
    want = {k: k for k in words}
    for a, b in itertools.combinations(words, 2):
        x, y = signed[a], signed[b]
        if want[a] != want[b] and op10_near.likeness(x.shingles, x.n_shingles, y.shingles, y.n_shingles) >= op10_near.LIKENESS:
            want = {k: min(want[a], want[b]) if v in (want[a], want[b]) else v for k, v in want.items()}
    assert len(set(want.values())) == 60
    across, found = op10_near.across, []
    monkeypatch.setattr(op10_near, "across", lambda *a: found.append(across(*a).count()) or across(*a))
    for step in ("promising", "partners"):  # all is left to the last search
        monkeypatch.setattr(op10_near, step, lambda *a, own=getattr(op10_near, step): own(*a).limit(0))
    assert {r.doc_id: r.class_id for r in op10_near.classes(docs).collect()} == want
    assert found and max(found) < 20 * len(words)
