"""Whitening and hard negatives against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm.hard_negatives import Residues, mine, op12_hard_negatives, products
from fleetlens.llm.whitening import op11_embedding_whitening, steps, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, n int, steps string, copies string, g int, score double, number string"
EXTRA = (1, "x", "y", 0, 0.5, "z")


def frame(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, non-finite and huge entries, other lengths, repeated rows and vectors, null ids."""
    rng = np.random.default_rng(5)
    base = [[float(np.float32(v)) for v in r] for r in rng.normal(0, 0.3, (60, 6))]
    rows = [(i, base[i % 60], i % 3) for i in range(0, 400)]
    rows += [(100, base[3], 0), (7, base[1], 1), (None, base[2], 2), (None, base[2], 2), (500, base[5], None)]
    rows += [(900, None, 1), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (902, [float("nan")] * 6, 1), (903, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0], 0)]
    rows += [(904, [1.0, 2.0], 1), (905, [], 1), (906, [-1e30, 0.0, 0.0, 0.0, 0.0, 0.0], 1)]
    return rows


def whole(rows, scale):
    return [(i, [int(np.floor(scale * float(c))) for c in v], lab) for i, v, lab in rows if v and len(v) == 6 and all(c is not None and np.isfinite(c) and abs(c) < 1e9 for c in v)]


def check_whitening(found, kept, k):
    x = np.array([[c + 1_000_000 for c in v] for _, v, _ in kept], object)
    n, s = len(x), x.sum(0)
    centred = ((n * x - s) / n).astype(float)
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    expected = centred @ vectors / np.sqrt(values)
    deviation = ((n * x - s) ** 2).sum(1)
    by_row = {}
    for r in found:
        assert r["n"] == n and r["identity_error"] < 1e-4
        by_row.setdefault((r["vec_id"], r["deviation"]), []).append((r["component"], r["whitened"]))
        assert abs(r["explained"] / (values[r["component"] - 1] / np.trace(cov)) - 1) < 1e-9
    signs = np.zeros(k)
    wanted = {}
    for (i, _, _), dev, z in zip(kept, deviation, expected, strict=True):
        wanted.setdefault((i, int(dev)), []).append(z)
    assert set(by_row) == set(wanted)
    for key, zs in wanted.items():
        assert len(by_row[key]) == k * len(zs)
        for c, value in by_row[key]:
            near = [z[c - 1] for z in zs]
            sign = signs[c - 1] or np.sign(value * near[0])
            signs[c - 1] = sign
            assert min(abs(value - sign * v) for v in near) < 1e-8


def test_whitening_of_odd_rows(spark, odd):
    out = whiten(frame(spark, odd), components=4)
    each = out.select("vec_id", "n", F.col("deviation").cast("long"), F.posexplode("whitened").alias("p", "whitened"), "explained", "identity_error")
    found = each.select("vec_id", "n", "deviation", (F.col("p") + 1).alias("component"), "whitened", F.get("explained", "p").alias("explained"), "identity_error").collect()
    check_whitening(found, whole(odd, 64), 4)


def test_whitening_of_the_table(spark):
    rows = [(r[0], r[1], r[2]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    x = [(i, [int(np.floor(64 * float(c))) for c in v], lab) for i, v, lab in rows]
    check_whitening(op11_embedding_whitening(spark, "/root/testdata/sf0.001").collect(), x, 32)


def test_whitening_without_variance(spark, odd):
    assert whiten(frame(spark, odd).limit(0)).count() == 0
    assert whiten(frame(spark, odd).filter("vec_id > 899")).filter("size(whitened) > 0").count() == 0
    equal = whiten(frame(spark, [(i, [0.5, 1.0], 0) for i in range(5)])).collect()
    assert len(equal) == 5 and all(r["whitened"] == [] and r["deviation"] == 0 for r in equal)
    line = whiten(frame(spark, [(i, [float(i), 2.0 * i, 1.0], 0) for i in range(20)]), components=3).collect()
    assert {len(r["whitened"]) for r in line} == {1}


def test_exact_beyond_64_bits(spark):
    rows = [(i, [float(2**45 * (i - 2)), 1.0], 0) for i in range(5)]
    x = [2**51 * (i - 2) + 1_000_000 for i in range(5)]
    found = {r["vec_id"]: int(r["deviation"]) for r in whiten(frame(spark, rows), components=1).collect()}
    assert found == {i: (5 * x[i] - sum(x)) ** 2 for i in range(5)}


def test_double_and_float_steps(spark):
    for kind in ("float", "double"):
        df = spark.createDataFrame([(1, [-0.001, 0.999, 1 / 64, 0.0])], f"vec_id long, v array<{kind}>")
        assert steps(df, "v", 64).first()["steps"] == [-1.0, 63.0, 1.0, 0.0]


@pytest.mark.parametrize("d,most", [(1, 2**30), (5, 300), (64, 256), (300, 40_000), (700, 2**24)])
def test_residue_products(d, most):
    rng = np.random.default_rng(d)
    a, b = rng.integers(-most, most + 1, (17, d)), rng.integers(-most, most + 1, (23, d))
    a[0], b[0], a[1] = most, most, -most
    exact = a.astype(object) @ b.astype(object).T
    assert (products(Residues(a.astype(np.int32)), Residues(b.astype(np.int32))).astype(object) == exact).all()
    assert (products(Residues(a * 0), Residues(b)) == 0).all()


def mined(rows, k=5, low=80):
    last = (1, 0)
    name = lambda i: last if i is None else (0, i)
    out = []
    for a, av, al in rows:
        if a is None or a % 100:
            continue
        scores = [(sum(p * q for p, q in zip(av, v, strict=True)), name(i), lab) for i, v, lab in rows if i != a]
        scores.sort(key=lambda s: (-s[0], s[1]))
        for ps, p, _ in [s for s in scores if s[2] == al][:k]:
            for rank, (ns, n, _) in enumerate([s for s in scores if s[2] != al and low * ps <= 100 * s[0] <= 100 * ps][:k], 1):
                out.append((a, None if p == last else p[1], rank, None if n == last else n[1], ps, ns))
    return sorted(out, key=str)


def test_mining_of_odd_rows(spark, odd):
    rows = [r for r in whole(odd, 256) if r[2] is not None]
    found = mine(frame(spark, odd), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, found.collect()), key=str) == mined(rows)
    assert mine(frame(spark, odd).limit(0), F.lit(True)).count() == 0


def test_mining_in_small_blocks(spark, monkeypatch):
    from fleetlens.llm import hard_negatives

    for name in ("BLOCK_CELLS", "HELD_CELLS", "SCORE_CELLS"):
        monkeypatch.setattr(hard_negatives, name, 640)
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").filter("vec_id < 300").select("vec_id", "embedding", "label")
    plain = [(r[0], [int(np.floor(256 * float(c))) for c in r[1]], r[2]) for r in rows.collect()]
    assert sorted(map(tuple, mine(rows, F.col("vec_id") % 100 == 0).collect()), key=str) == mined(plain)
    assert op12_hard_negatives(spark, "/root/testdata/sf0.001").columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
