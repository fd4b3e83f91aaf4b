"""What the Jaccard join keeps on disk while it searches."""

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from tarifold.llm import op11_jaccard  # noqa: E402


def test_keys_go_before_the_search(spark, monkeypatch):
    words = [f"w{k}" for k in range(80)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:-1])), (3, " ".join(f"v{w}" for w in words))], "doc_id long, text string")
    dropped, seen = [], []
    drop, searched = op11_jaccard.drop_stored, op11_jaccard.searched
    monkeypatch.setattr(op11_jaccard, "drop_stored", lambda df: dropped.append(df.stored_at) or drop(df))
    monkeypatch.setattr(op11_jaccard, "searched", lambda *a: seen.append([p for p in dropped if "jaccard-keys" in p or "jaccard-heads" in p]) or searched(*a))
    assert {r.doc_id: r.component_id for r in op11_jaccard.join_components(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert all(len(found) == 2 for found in seen) and seen


def test_blocks_are_few(spark):
    """Six hundred nodes of one group, half of them of one component: nobody is copied to meet the others."""
    groups = spark.range(600).selectExpr("true AS small", "1L AS key", "id AS nid", "300L AS bytes")
    roots = spark.range(300).selectExpr("id AS nid", "0L AS root")
    met = op11_jaccard.meetings(groups, roots).collect()
    assert len(met) == 600 and {r.root for r in met} == {0, *range(300, 600)}


def test_pairs_of_a_block(spark):
    """Every linked pair of different components, and no pair of sizes too far apart; as one block, by sides, and the best of each node."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 48, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate((base[:-k - 1] if k % 2 else base[k + 1:], rng.integers(0, 1 << 48, k % 5).astype(np.uint64)))) for k in range(300)]
    n, root, nid = np.array([len(x) for x in sets]), np.arange(300) // 2, np.arange(1000, 1300)
    common = np.array([[len(np.intersect1d(x, y)) for y in sets] for x in sets])
    want = {(i + 1000, j + 1000) for i, j in np.argwhere(op11_jaccard.linked(common, n[:, None], n[None, :])).tolist() if i < j and root[i] != root[j]}
    assert len(want) > 300
    for side in (np.zeros(300, int), np.arange(300) % 3 // 2):
        args = nid, root, n, side, [op11_jaccard.bitmap(x).tobytes() for x in sets]
        own = {(a, b) for a, b in want if not side.any() or side[a - 1000] != side[b - 1000]}
        got = {(a, b): slack for a, b, slack in op11_jaccard.block_pairs(*args, False)}
        assert own <= set(got) and all(100 * min(n[a - 1000], n[b - 1000]) >= 90 * max(n[a - 1000], n[b - 1000]) for a, b in got)
        best = {k: max(slack for pair, slack in got.items() if k in pair) for pair in got for k in pair}
        for a, b, slack in op11_jaccard.block_pairs(*args, True):
            assert got[a, b] == slack and slack in (best[a], best[b])
        assert {k for a, b, _ in op11_jaccard.block_pairs(*args, True) for k in (a, b)} >= set(best)
