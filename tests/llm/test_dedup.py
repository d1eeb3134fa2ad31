"""Near-duplicates of texts and vectors against brute force."""

import numpy as np
import pytest

from keyflux.llm import embedding, minhash


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_texts(rows, k, percent=80):
    rows = [(d, shingle_set(t, k)) for d, t in rows if d is not None]
    links = [(a, b) for i, (a, x) in enumerate(rows) for b, y in rows[:i] if x and y and (a == b or 100 * len(x & y) >= percent * len(x | y))]
    return components({d for d, _ in rows}, links)


@pytest.mark.parametrize("k", [2, 5])
def test_odd_documents(spark, odd_docs, k):
    got = minhash.near_duplicates(odd_docs, k).collect()
    want = brute_texts([(r["doc_id"], r["text"]) for r in odd_docs.collect()], k)
    assert len(got) == odd_docs.count()
    for r in got:
        assert r["component_id"] == want.get(r["doc_id"]) and r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"])
    assert {r["doc_id"]: r["n_shingles"] for r in got if r["doc_id"] in (3, 4, 5, 8)} == {3: 0, 4: 0, 5: 0, 8: 1}
    kept = minhash.deduplicated(odd_docs, k)
    assert kept.columns == odd_docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, c in want.items() if d == c} | {None}


def test_no_documents(no_docs):
    assert minhash.near_duplicates(no_docs, 2).count() == 0


def test_a_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rnd = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):  # similarities around the threshold, and chains
        words = list(base)
        for j in rnd.choice(60, rnd.integers(1, 9), replace=False):
            words[j] = f"x{rnd.integers(0, 40)}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, " ".join([f"y{i}-{j}" for j in range(40)] + base[:30])) for i in range(40)]  # a shared passage
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, 2).collect()}
    assert got == brute_texts(rows, 2)


def test_block_links_span_all_links():
    rnd = np.random.default_rng(5)
    sets = [np.unique(np.concatenate([rnd.choice(60, 50, replace=False), [1000 + i]])).astype(np.uint64) for i in range(90)]
    for comps in (np.arange(90), np.arange(90) // 4):
        pairs = [(i, j) for i in range(90) for j in range(i) if 100 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - c)]
        base = [(i, int(comps[i]) * 4 if comps[1] == 0 else i) for i in range(90)]
        got = minhash.block_links(np.arange(90), comps, sets, 80)
        assert set(got) <= {(max(p), min(p)) for p in pairs} | {(min(p), max(p)) for p in pairs}
        assert components(range(90), base + got) == components(range(90), base + pairs)


def test_signatures_agree_as_often_as_sets_do():
    rnd = np.random.default_rng(1)
    both, a, b = (rnd.integers(0, 2**63, n, dtype=np.uint64) for n in (800, 100, 100))
    hits = np.mean([(minhash.bands(np.unique(np.concatenate([both + np.uint64(i), a])) ) == minhash.bands(np.unique(np.concatenate([both + np.uint64(i), b])))).mean() for i in range(20)])
    assert abs(hits - 0.8**4) < 0.1


def brute_vectors(vs, threshold=0.9):
    ok = [v is not None and len(v) > 0 and None not in v and bool(np.isfinite(v).all()) and any(v) for v in vs]
    unit = [np.array(v) / np.linalg.norm(v) if g else None for v, g in zip(vs, ok)]
    n = len(vs)
    return [[j for j in range(n) if j != i and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(n)]


@pytest.mark.parametrize("block,per_hash", [(2048, 1 << 16), (16, 64)])
def test_vectors(spark, monkeypatch, block, per_hash):
    monkeypatch.setattr(embedding, "BLOCK", block)
    monkeypatch.setattr(embedding, "PER_HASH", per_hash)
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(12, 48))
    vs = [list(map(float, centres[i % 12] + rnd.normal(size=48) * rnd.choice([0.1, 0.3, 0.35]))) for i in range(240)]
    vs += [vs[0], vs[0], [2 * x for x in vs[1]], None, [], [0.0] * 48, [float("nan")] * 48, [None] + [1.0] * 47, [float("inf")] * 48, [1.0], [3.0], [-1.0], [1.0, 0.0], [1.0, 0.1]]
    ids = list(range(len(vs)))
    df = spark.createDataFrame([(i, v, 1, 5) for i, v in zip(ids, vs)], "vec_id long, embedding array<double>, label int, key int")
    links = brute_vectors(vs)
    comp = components(ids, [(i, j) for i in ids for j in links[i]])
    got = {r["vec_id"]: r for r in embedding.near_duplicates(df).collect()}
    assert len(got) == len(vs)
    for i in ids:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(links[i]), comp[i], comp[i] == i), i


def test_odd_vector_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert embedding.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (5, [1.0, 0.0], None), (5, [1.0, 0.0], 1), (7, None, None)], schema)
    got = sorted(((r["vec_id"] or -1), r["n_links"], r["component_id"], r["kept"]) for r in embedding.near_duplicates(df).collect())
    assert got == [(-1, 2, None, False), (5, 2, 5, True), (5, 2, 5, True), (7, 0, 7, True)]


def test_hadamard_keeps_angles():
    x = np.random.default_rng(0).normal(size=(5, 16))
    y = embedding.hadamard(x)
    assert np.allclose(y @ y.T, 16 * x @ x.T)
