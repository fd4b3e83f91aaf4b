"""The n-gram join, the whitening and the vector codes against plain versions, and on odd and empty tables."""

import hashlib
import math
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from tarifold.llm import op11_jaccard, op12_whitening, op13_codes, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
VECTORS = "vec_id long, embedding array<float>, label int, n int, x string, size string, code string"


def shingle_set(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[k:k + 3]) for k in range(len(words) - 2)} if len(words) >= 3 else {tuple(words)} - {()}


def plain_components(texts):
    """Component of each of a list of (id, text), by looking at all pairs that share a shingle."""
    sets = [shingle_set(t) for _, t in texts]
    by_shingle, root = defaultdict(list), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, s in enumerate(sets):
        for g in s:
            by_shingle[g].append(k)
    for k, s in enumerate(sets):
        for j in {j for g in s for j in by_shingle[g] if j < k}:
            inter = len(s & sets[j])
            if 100 * inter >= 90 * (len(s) + len(sets[j]) - inter):
                a, b = sorted((find(j), find(k)))
                root[b] = a
    least = {}
    for k, (i, _) in enumerate(texts):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(texts)]


def joined(spark, rows):
    got = op11_jaccard.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr)


def test_jaccard_join(spark, sf_dir):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet' ORDER BY 1").fetchall()
    got = queries.QUERIES["op11_jaccard_join"](spark, sf_dir).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(plain_components(rows))


def test_jaccard_join_at_the_threshold(spark):
    """Pairs just on either side of the likeness, of all sizes, whose sizes also differ as much as links allow."""
    rng, rows = np.random.default_rng(3), []
    for n in (3, 4, 11, 12, 21, 22, 23, 40, 57, 90, 133, 200, 400, 1200):
        for v in range(6):
            words = [f"n{n}v{v}w{k}" for k in range(n)]
            rows.append((len(rows), " ".join(words)))
            cut = max(0, (n - 2) // 10 + v - 3)
            rows.append((len(rows), " ".join(words[:n - cut])))  # differs in size only
            own = words.copy()
            for k in range((n - 2) // 57 + (v > 2)):  # a new word changes three shingles
                own[2 + (57 * k + int(rng.integers(0, 9))) % (n - 2)] = f"y{n}v{v}k{k}"
            rows.append((len(rows), " ".join(own)))
    assert joined(spark, rows) == sorted(plain_components(rows), key=repr)


def test_jaccard_join_of_crowded_groups(spark):
    """Variants of one text that are linked in chains, and others that lie just below the likeness."""
    rng, rows = np.random.default_rng(8), []
    base = [f"w{k}" for k in range(120)]
    for v in range(400):
        own = base.copy()
        for at in rng.choice(np.arange(4, 116, 4), 3 if v % 2 else 1, replace=False):
            own[at] = f"v{v}x{at}"
        rows.append((v, " ".join(own)))
    assert joined(spark, rows) == sorted(plain_components(rows), key=repr)


def test_jaccard_join_is_not_reached_by_blocks_alone(spark, monkeypatch):
    """With small blocks the same components come out."""
    monkeypatch.setattr(op11_jaccard, "BLOCK", 8)
    monkeypatch.setattr(op11_jaccard, "CLUSTER", 20)
    test_jaccard_join_of_crowded_groups(spark)


def test_keys_meet():
    """Every linked pair has a common key, empty places or not."""
    rng = np.random.default_rng(6)
    for n in rng.integers(10, 3000, 150).tolist():
        pool = np.unique(rng.integers(1, 1 << 48, n + n // 9 + 2, dtype=np.uint64))
        both = -(-90 * n // 100)
        a, extra = pool[:both], pool[both:]
        most = 0
        while op11_jaccard.linked(np.array(both), np.array(both + most + 1), np.array(both)):
            most += 1
        cut = int(rng.integers(0, most + 1))
        left, right = np.sort(np.concatenate((a, extra[:cut]))), np.sort(np.concatenate((a, extra[cut:most])))
        key, sizes = op11_jaccard.keys_of([op11_jaccard.packed(s).tobytes() for s in (left, right)])
        assert set(key[:sizes[0]].tolist()) & set(key[sizes[0]:].tolist()) or left.tolist() == right.tolist()


def test_bitmaps_bound_from_above():
    rng = np.random.default_rng(7)
    pool = rng.integers(1, 1 << 48, 900, dtype=np.uint64)
    sets = [np.sort(rng.choice(pool, n, replace=False)) for n in (30, 300, 600, 610)]
    n = np.array([len(s) for s in sets])
    bits = [op11_jaccard.bitmap(s).tobytes() for s in sets]
    most = op11_jaccard.bound(bits, n, bits, n)
    assert all(most[i, j] >= len(np.intersect1d(sets[i], sets[j])) for i in range(4) for j in range(4))
    assert op11_jaccard.bound(bits[2:], n[2:], bits[2:], n[2:])[0, 1] < 1.25 * len(np.intersect1d(sets[2], sets[3]))


def test_jaccard_join_of_odd_tables(spark, odd_docs, no_docs):
    assert op11_jaccard.join_components(no_docs).count() == 0
    got = op11_jaccard.join_components(odd_docs).collect()
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == sorted(plain_components(rows), key=repr)
    nameless = [(None, "a b c"), (None, "a b c"), (None, ""), (5, ""), (6, None)]
    assert joined(spark, nameless) == sorted([(None, 1, None)] * 2 + [(None, 0, None), (5, 0, 5), (6, 0, 6)], key=repr)


def vectors_of(sf_dir):
    rows = duckdb.sql(f"SELECT vec_id, embedding, label FROM '{sf_dir}/embeddings.parquet'").fetchall()
    return [(i, v, l) for i, v, l in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def check_whitening(got, rows, k=32):
    ids = [r[0] for r in rows]
    x = np.floor(np.array([r[1] for r in rows], np.float64) * 64).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    c = (x * n - s) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    want = c @ vectors / np.sqrt(values)
    of = {(r.vec_id, r.component): r for r in got}
    assert len(of) == len(got) == n * min(k, x.shape[1])
    w = np.array([[of[i, j + 1].whitened for j in range(len(values))] for i in ids])
    assert np.allclose(w * np.sign((w * want).sum(axis=0)), want, atol=1e-6)
    deviation = ((x * n - s).astype(object) ** 2).sum(axis=1)
    trace = float((c * c).sum() / n)
    for i, d in zip(ids, deviation):
        r = of[i, 1]
        assert r.n == n and r.deviation == d and r.identity_error < 1e-9
    assert all(math.isclose(of[ids[0], j + 1].explained, v / trace, rel_tol=1e-9) for j, v in enumerate(values))


def test_whitening(spark, sf_dir):
    check_whitening(queries.QUERIES["op12_whitening"](spark, sf_dir).collect(), vectors_of(sf_dir))


@pytest.mark.parametrize("gap", [1.0, 1e-6])
def test_eigenpairs(gap):
    """Far more dimensions than the search space holds, with and without clustered values."""
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((600, 600)))[0]
    values = np.sort(np.concatenate((50 + gap * rng.random(40), rng.random(560) * 30)))[::-1]
    a = (q * values) @ q.T
    a, calls = (a + a.T) / 2, []
    got, vectors, residual = op12_whitening.eigenpairs(lambda b: calls.append(b.shape[1]) or a @ b, 600, 32)
    assert np.allclose(got, values[:32], rtol=0, atol=1e-10) and residual < 1e-9
    assert np.abs(vectors.T @ vectors - np.eye(32)).max() < 1e-12 and np.linalg.norm(a @ vectors - vectors * got) < 1e-9
    assert len(calls) < 150


def test_minres_solves():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((40, 40))
    a, right = a + a.T, rng.standard_normal((40, 3))
    assert np.allclose(a @ op12_whitening.minres(lambda t: a @ t, right, 200), right, atol=1e-6)


def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(3, [1.0, 2.0, -3.5]), (1, [0.5, -2.25, 0.0]), (None, [4.0, 1.0, 1.0]), (2, None), (4, [1.0, None, 2.0]), (5, [nan, 1.0, 1.0]), (6, [inf, 0.0, 0.0]), (7, []),
            (3, [1.0, 2.0, -3.5]), (8, [1.0, 2.0]), (9, [-1.0, 7.5, 2.0])]
    return spark.createDataFrame([(i, v, None if i == 9 else 1, 5, "t", "t", "t") for i, v in rows], VECTORS)


def test_whitening_of_odd_tables(spark):
    rows = odd_vectors(spark)
    got = op12_whitening.whiten(rows).collect()
    assert len(got) == 5 * 3 and sum(r.vec_id is None for r in got) == 3
    assert all(r.whitened is not None and r.identity_error < 1e-9 for r in got)
    assert op12_whitening.whiten(rows.limit(0)).count() == 0
    one = op12_whitening.whiten(spark.createDataFrame([(1, [2.0, 3.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    far = op12_whitening.whiten(spark.createDataFrame([(k, [float(k % 2) * 1e15, 1.0 * k]) for k in range(4)], "vec_id long, embedding array<double>")).collect()
    assert all(r.deviation is None for r in far)


def plain_codes(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    x = np.floor(np.array([r[1] for r in rows], np.float64) * 4096).astype(np.int64).reshape(len(rows), 8, -1)
    books = x[:16].transpose(1, 0, 2).copy()

    def assign():
        return np.stack([((x[:, p, None] - books[p][None]) ** 2).sum(axis=2).argmin(axis=1) for p in range(8)], axis=1)

    for _ in range(6):
        codes = assign()
        for p in range(8):
            for e in range(books.shape[1]):
                own = x[codes[:, p] == e, p]
                if len(own):
                    books[p, e] = own.sum(axis=0) // len(own)
    codes = assign()
    errors = [sum(int(((x[k, p] - books[p][codes[k, p]]) ** 2).sum()) for p in range(8)) for k in range(len(x))]
    by_label = defaultdict(int)
    for r, e in zip(rows, errors):
        by_label[r[2]] += e
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return [(r[0], "".join(f"{c:02x}" for c in k), e, by_label[r[2]], sha) for r, k, e in zip(rows, codes.tolist(), errors)]


def test_vector_codes(spark, sf_dir):
    got = queries.QUERIES["op13_vector_codes"](spark, sf_dir).collect()
    assert sorted(tuple(r) for r in got) == sorted(plain_codes(vectors_of(sf_dir)))


def test_orchard_finds_the_nearest():
    rng = np.random.default_rng(4)
    for width, spread in ((1, 4), (3, 3), (8, 1 << 23), (4, 1 << 40)):
        queries_, entries = (rng.integers(-spread, spread + 1, (n, width)) for n in (400, 16))
        at, best = op13_codes.orchard(queries_, entries) if spread < 1 << 24 else op13_codes.orchard(queries_.astype(object), entries)
        d = ((queries_.astype(object)[:, None] - entries.astype(object)[None]) ** 2).sum(axis=2)
        assert at.tolist() == [min(range(16), key=lambda j: (r[j], j)) for r in d] and list(best) == d.min(axis=1).tolist()


def test_codes_of_odd_tables(spark):
    rows = odd_vectors(spark)
    got = op13_codes.compress(rows).collect()
    assert sorted(str(r.vec_id) for r in got) == ["1", "3", "3", "9", "None"]
    assert len({r.codebooks_sha256 for r in got}) == 1 and all(len(r.code) == 16 for r in got)
    assert {r.label_error for r in got if r.vec_id != 9} == {sum(r.error for r in got if r.vec_id != 9)}
    assert op13_codes.compress(rows.limit(0)).count() == 0
    books = op13_codes.fit(op13_codes.kept(rows))
    back = op13_codes.decode(op13_codes.encode(op13_codes.kept(rows), books), books).collect()
    assert {r.vec_id: r.approximation[:3] for r in back}[1] == [0.5, -2.25, 0.0]
    none = op13_codes.compress(spark.createDataFrame([(1, [], 1), (2, [], 1)], "vec_id long, embedding array<double>, label int")).collect()
    assert [(r.code, r.error) for r in none] == [("00" * 8, 0)] * 2
    far = spark.createDataFrame([(k, [1e13 * k] + [0.5] * 15, None) for k in range(40)], "vec_id long, embedding array<double>, label int")
    assert op13_codes.compress(far).where("error IS NULL").count() > 0
