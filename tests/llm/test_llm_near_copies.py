"""SimHash, lattice hashing and components against brute force."""

import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from panelforge.llm import lattice, queries, simhash
from panelforge.llm.common import table
from panelforge.llm.components import connected_components
from panelforge.llm.runs import local_roots


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def check_documents(docs, rows):
    """rows: (doc_id, fingerprint, component_id) in any order."""
    prints = {}
    for i, t in docs:
        prints.setdefault(brute_fingerprint(t), []).append(i)
    linked = [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3]
    roots = brute_roots(prints, linked)
    low = {}
    for f, ids in prints.items():
        low.setdefault(roots[f], []).extend(i for i in ids if i is not None)
    want = sorted(((i, f"{brute_fingerprint(t):016x}", min(low[roots[brute_fingerprint(t)]], default=None)) for i, t in docs), key=str)
    assert sorted(map(tuple, rows), key=str) == want


def test_simhash_query_equals_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    check_documents(docs, queries.op5_simhash(spark, sf).collect())


BASE = " ".join(f"word{i * 7 % 97}" for i in range(400))
ODD = [
    (5, BASE), (9, BASE), (9, BASE), (3, BASE.upper()), (7, BASE + " tail"), (None, BASE + " tail"), (11, None), (12, ""), (13, "  \n"), (None, None), (14, "one"), (15, "two words"), (None, "nameless text"),
    (16, "x" * 5_000 + " y" * 70_000), (20, BASE.replace("word49", "word50")), (21, "É é"),
]


@pytest.mark.parametrize("chunk", [1024, 2])
def test_simhash_of_odd_rows_whatever_the_part_size(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    docs = spark.createDataFrame([(i, t, "v", 1) for i, t in ODD], "doc_id long, text string, Fingerprint string, component_id int")
    check_documents(ODD, simhash.simhash_components(docs).collect())
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_one_document_of_each_component_stays(spark):
    docs = spark.createDataFrame([(i, t, i) for i, t in ODD], "doc_id long, text string, extra long")
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    named = {r["doc_id"]: r["component_id"] for r in simhash.simhash_components(docs).where("doc_id is not null").collect()}
    assert sorted(i for i, _ in rows if i is not None) == sorted({c for c in named.values()})
    assert [t for i, t in rows if i is None] == ["nameless text"]
    assert simhash.drop_near_copies(docs.limit(0)).count() == 0


def test_linked_fingerprints_share_a_key_and_pass_its_chain(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**64, size=400, dtype=np.uint64)
    b = a.copy()
    for k in range(len(b)):
        for bit in rng.choice(64, size=k % 6, replace=False):
            b[k] ^= np.uint64(1) << np.uint64(bit)
    rows = spark.createDataFrame([(k, int(x.astype(np.int64))) for k, x in enumerate(a)] + [(k, int(x.astype(np.int64))) for k, x in enumerate(b)], "pair int, fp long")
    keys = {}
    for r in rows.select("pair", "fp", simhash._keys().alias("keys")).collect():
        keys.setdefault(r["pair"], []).append(set(r["keys"]))
    for k in range(len(a)):
        shared = keys[k][0] & keys[k][1]
        found = any(simhash.chain_passes(a[k : k + 1] ^ b[k : k + 1], (key >> 32) // 3)[0] for key in shared)
        assert found == (int(a[k] ^ b[k]).bit_count() <= 3)


def test_dense_cloud_of_fingerprints_is_split_and_whole(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 16)
    rng = np.random.default_rng(2)
    cloud = {0x0123456789ABCDEF}
    for _ in range(300):
        v = 0x0123456789ABCDEF
        for bit in rng.choice(20, size=rng.integers(1, 6), replace=False):
            v ^= 1 << int(bit)
        cloud.add(v)
    cloud = sorted(cloud)
    rows = simhash.link_fingerprints(spark.createDataFrame([(v,) for v in cloud], "fp long")).collect()
    want = brute_roots(cloud, [(a, b) for a in cloud for b in cloud if a < b and (a ^ b).bit_count() <= 3])
    alone = {v for v in cloud if all((v ^ u).bit_count() > 3 for u in cloud if u != v)}
    assert {r["node"]: r["root"] for r in rows} == {v: r for v, r in want.items() if v not in alone}


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 12).flatmap(lambda n: st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)), max_size=20).map(lambda e: (n, e))))
def test_local_roots(graph):
    n, edges = graph
    m = np.zeros((n, n), dtype=bool)
    for a, b in edges:
        m[a, b] = True
    want = brute_roots(range(n), edges)
    assert local_roots(m).tolist() == [want[i] for i in range(n)]


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, k) for k in range(100, 140)] + [(int(a), int(b)) for a, b in rng.integers(300, 360, size=(50, 2))] + [(7, 7), (-5, 400), (400, -9)] * 2
    rows = connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert {r["node"]: r["root"] for r in rows} == brute_roots(nodes, [e for e in edges if e[0] != e[1]]) and len(rows) == len(nodes)
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


# Vectors


def brute_links(rows, threshold=0.98):
    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, dtype=float)
        return v / np.linalg.norm(v)

    units = [unit(v) if lab is not None else None for _, v, lab in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold]
    degree = np.zeros(len(rows), dtype=int)
    for i, j in pairs:
        degree[i] += 1
        degree[j] += 1
    return degree.tolist(), pairs


def test_vector_query_reaches_brute_force(spark, sf):
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in table(spark, sf, "embeddings").collect()]
    degree, _ = brute_links(rows)
    got = {r["vec_id"]: r for r in queries.op8_embedding_dedup(spark, sf).collect()}
    assert len(got) == len(rows)
    found = [got[i]["n_links"] for i, _, _ in rows]
    assert all(f <= d for f, d in zip(found, degree)) and sum(found) >= 0.9 * sum(degree)


@pytest.mark.parametrize("chunk", [1024, 8])
def test_clouds_copies_and_odd_vectors(spark, monkeypatch, chunk):
    monkeypatch.setattr(lattice, "CHUNK", chunk)
    rng = np.random.default_rng(4)
    rows, k = [], 0
    for cloud in range(6):
        centre = rng.standard_normal(64)
        for _ in range(30):
            rows.append((k, [float(x) for x in centre + rng.standard_normal(64) * 0.12], cloud % 3))
            k += 1
    rows += [(k + i, rows[0][1], 0) for i in range(3)] + [(k + 3, rows[0][1], 1), (k + 4, rows[0][1], None), (k + 5, [5 * x for x in rows[0][1]], 0), (k + 5, rows[0][1], 0)]
    odd = [None, [], [0.0] * 64, [float("nan")] + [1.0] * 63, [None] + [1.0] * 63, [float("inf")] + [0.0] * 63, [1.0, 0.0], [2.0, 0.0], [1e200] * 64]
    rows += [(1000 + i, v, 0) for i, v in enumerate(odd)] + [(None, rows[0][1], 0)]
    table = spark.createDataFrame([(*r, True) for r in rows], "vec_id long, embedding array<double>, label int, kept boolean")
    got = lattice.embedding_links(table).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"vec_id", "n_links", "component_id", "kept"}
    degree, pairs = brute_links(rows)
    assert sum(r["n_links"] for r in got) >= 0.97 * sum(degree)
    most = {}
    for (i, _, _), d in zip(rows, degree):
        most.setdefault(i, []).append(d)
    assert all(r["n_links"] <= max(most[r["vec_id"]]) for r in got)
    roots = brute_roots(range(len(rows)), pairs)
    low = {}
    for p, (i, _, _) in enumerate(rows):
        low.setdefault(roots[p], []).append(i)
    want = sorted((str(rows[p][0]), str(min((x for x in low[roots[p]] if x is not None), default=None))) for p in range(len(rows)))
    assert sorted((str(r["vec_id"]), str(r["component_id"])) for r in got) == want
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)
    assert lattice.embedding_links(table.limit(0)).count() == 0


def test_nearest_lattice_point():
    rng = np.random.default_rng(5)
    steps = lattice.minimal_vectors()
    assert len(np.unique(steps, axis=0)) == 240 and np.allclose((steps**2).sum(axis=1), 2)
    x = rng.standard_normal((500, 8)) * 3
    p = lattice.nearest_e8(x)
    whole, half = np.allclose(2 * p, np.rint(2 * p)), np.abs(p - np.rint(p)).sum(axis=1)
    assert whole and set(np.round(half, 6)) <= {0.0, 4.0} and (np.round(p.sum(axis=1), 6) % 2 == 0).all()
    own = ((x - p) ** 2).sum(axis=1)
    assert (own <= 1 + 1e-9).all() and all((own <= ((x - p - s) ** 2).sum(axis=1) + 1e-9).all() for s in steps)
