"""Merkle proofs, whitening and the kernel classifier against brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerlens.llm import kernel_quality, merkle, whitening
from tests.llm.conftest import SF


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(digests):
    """The root of a list and, for each of it, the siblings (left, right) level by level."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        runs = [level[i : i + 8] for i in range(0, len(level), 8)]
        for k, place in enumerate(at):
            run, slot = runs[place // 8], place % 8
            paths[k].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
            at[k] = place // 8
        level = [h("".join(run)) for run in runs]
    return level[0], paths


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""

    def leaf(row):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(row), row))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    subroots, found = [], []
    for lang in langs:
        ordered = sorted(groups[lang], key=lambda x: x[:3])
        subroot, paths = plain_tree([x[2] for x in ordered])
        subroots.append(subroot)
        found.append((ordered, subroot, paths))
    root, tops = plain_tree(subroots)
    out = []
    for (ordered, subroot, paths), top in zip(found, tops, strict=True):
        for (_, _, own, row), path in zip(ordered, paths, strict=True):
            doc, source, lang, n, text = row
            changed = text
            if doc is not None and text is not None and zlib.crc32(str(doc).encode()) % 3 == 0:
                changed = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf((doc, source, lang, n, changed))
            for left, right in path + top:
                node = h(left + node + right)
            proof = h("".join(a + b for a, b in path + top))
            out.append((doc, own, subroot, root, proof, node, node == root))
    return sorted(out, key=repr)


MERKLE = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def manifest(spark, rows, tmp_path, schema="doc_id long, source string, lang string, n_chars long, text string, path string, tree int"):
    spark.createDataFrame([(*r, "clash", 1) for r in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op12_merkle_manifest(spark, str(tmp_path))
    return sorted((tuple(r[c] for c in MERKLE) for r in got.collect()), key=repr)


def test_manifest_equals_brute_force(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, f"s{i % 3}", rng.choice(["en", "en", "en", "de", None, "É", "zz", ""]), i, f"Text Ä {i} " * rng.randint(0, 4)) for i in range(700)]
    rows += [(None, None, None, None, None)] * 3 + [(5, "s", "en", 1, "Twice")] * 2 + [(5, "s", "en", 2, "other"), (900, "s", "one", None, None), (901, None, "en", 3, "")]
    rng.shuffle(rows)
    assert manifest(spark, rows, tmp_path) == plain_manifest(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 65])
def test_small_trees(spark, tmp_path, n):
    rows = [(i, "s", "en", i, f"Text {i}") for i in range(n)]
    assert manifest(spark, rows, tmp_path) == (plain_manifest(rows) if rows else [])


def test_tampering_is_seen(spark, texts):
    for r in merkle.op12_merkle_manifest(spark, SF).collect():
        tampered = zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and any("A" <= c <= "Z" for c in texts[r["doc_id"]])
        assert r["verified"] == (not tampered)


def spectra():
    rng = np.random.default_rng(0)
    x = rng.integers(-60, 60, (400, 48)) * np.linspace(1, 3, 48)
    yield np.cov(x.T)
    q, _ = np.linalg.qr(rng.standard_normal((32, 32)))
    for values in (np.r_[np.arange(9.0, 0, -1), np.zeros(23)], 10.0 ** -np.linspace(0, 13, 32), np.r_[[5.0] * 3, [2.0] * 29], np.ones(32)):
        yield q @ np.diag(values) @ q.T
    yield np.zeros((3, 3))
    yield np.diag([3.0, 1.0])


def test_divide_and_conquer_gives_eigenvectors():
    for a in spectra():
        a = (a + a.T) / 2
        values, vectors = whitening.eigenvectors(a)
        size = max(1e-300, np.linalg.norm(a))
        assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-13 * size
        assert np.linalg.norm(a @ vectors - vectors * values) <= 1e-13 * size
        assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-13


def test_polar_factor_is_the_sign_of_a_symmetric_matrix():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.standard_normal((20, 20)))
    for values in (rng.uniform(-1, 1, 20), np.r_[1e-9, -1e-9, np.ones(18)]):
        u = whitening.polar_factor(q @ np.diag(values) @ q.T)
        assert np.abs(u - q @ np.diag(np.sign(values)) @ q.T).max() < 1e-6


def plain_whitening(vectors):
    x = {i: [math.floor(256 * c) for c in v] for i, v in vectors}
    distinct = np.array(sorted(set(map(tuple, x.values()))), dtype=object)
    n, sums = len(distinct), distinct.sum(axis=0)
    centred = (distinct * n - sums).astype(float) / n
    cov = centred.T @ centred / n
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    mean = np.array([s / n for s in sums])
    out = {}
    for i, v in x.items():
        w = (np.array(v, float) - mean) @ basis[:, :4] / np.sqrt(values[:4])
        out[i] = (n, sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)), w, values[:4] / np.trace(cov))
    return out


def check_whitening(got, want):
    signs = {}
    assert len(got) == 4 * len(want)
    for r in got:
        n, deviation, w, share = want[r["vec_id"]]
        k = r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert r["explained"] == pytest.approx(share[k], rel=1e-9) and r["identity_error"] < 1e-9
        if abs(w[k]) > 1e-6:
            signs.setdefault(k, set()).add(np.sign(w[k] * r["whitened"]))
        assert abs(abs(r["whitened"]) - abs(w[k])) < 1e-8
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_query_equals_brute_force(spark):
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(whitening.op13_whitening(spark, SF).collect(), plain_whitening(vectors))


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = [(i, [float(v) for v in rng.normal(0, 1, 6)]) for i in range(60)]
    bad = [(100, None), (101, [1.0] * 5 + [None]), (102, [1.0] * 5 + [float("nan")]), (103, [float("-inf")] + [0.0] * 5), (104, []), (105, [1.0])]
    rows = good + [(200, good[0][1])] * 3 + bad
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, x string, row int")
    got = whitening.whiten(frame).collect()
    assert {r["row"]["vec_id"] for r in got} == {*range(60), 200} and len(got) == 63 and got[0]["row"]["x"] == "x"
    want = plain_whitening(good)
    flat = [
        {"vec_id": r["row"]["vec_id"], "component": k + 1, "n": r["n"], "deviation": r["deviation"], "whitened": r["whitened"][k],
         "explained": r["explained"][k], "identity_error": r["identity_error"]}
        for r in got if r["row"]["vec_id"] != 200 for k in range(4)
    ]
    check_whitening(flat, want)
    assert whitening.whiten(frame.limit(0)).count() == 0
    # One vector, however often, and vectors on a line: as many components as there are directions.
    one = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3)], "vec_id long, embedding array<float>")
    assert [(r["n"], r["deviation"], r["whitened"]) for r in whitening.whiten(one).collect()] == [(1, 0, [])] * 3
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)], "vec_id long, embedding array<float>")
    assert {len(r["whitened"]) for r in whitening.whiten(line).collect()} == {1}


def test_isotonic_is_the_least_squares_rising_curve():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = rng.integers(1, 12)
        counts = rng.integers(1, 5, n).astype(float)
        positives = np.array([rng.integers(0, c + 1) for c in counts], float)
        at, share = kernel_quality.isotonic(np.arange(n, dtype=float), positives, counts)
        assert (np.diff(share) > 0).all() and (np.diff(at) > 0).all()
        # The rising curve is the largest, over starts, of the least means that end there or later.
        means = [[positives[i : j + 1].sum() / counts[i : j + 1].sum() for j in range(i, n)] for i in range(n)]
        want = [max(min(means[i][k - i :]) for i in range(k + 1)) for k in range(n)]
        assert sorted(set(np.round(want, 12))) == pytest.approx(sorted(share))


def test_fourier_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (40, 20))
    made = kernel_quality.Features(np.zeros(20), np.ones(20), n=20_000)
    z = made(x)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * 20 * kernel_quality.BANDWIDTH**2))
    assert np.abs(z @ z.T - want).max() < 0.05


def test_normal_equations_over_partitions_equal_one_matrix(spark):
    rng = np.random.default_rng(6)
    size = len(kernel_quality.STATISTICS)
    x = rng.normal(0, 1, (300, size))
    y = (x[:, 0] + 0.3 * rng.normal(0, 1, 300) > 0).astype(float)
    rows = [(list(map(float, a)), float(b), i % 4) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    frame = spark.createDataFrame(rows, "x array<double>, y double, fold int")
    one, many = (kernel_quality.fit(frame.repartition(n)) for n in (1, 7))
    assert np.abs(one(x) - many(x)).max() < 1e-6
    assert ((one(x) > 0.5) == (y > 0.5)).mean() > 0.9


def auc(rows):
    ranked = sorted(rows)
    good = [s for s, y in rows if y]
    bad = [s for s, y in rows if not y]
    assert good and bad and ranked
    return sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))


def test_quality_is_told_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = kernel_quality.op11_kernel_quality(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [(r["score"], labels[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert auc([x[:2] for x in held]) > 0.9
    assert sum(p for _, y, p in held if y) / sum(y for _, y, _ in held) > 0.97


def test_scores_of_odd_and_empty_tables(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (6, 0), (6, 1), (7, 0), (9, None), (None, 1), (77, 0)], "doc_id long, quality int")
    got = kernel_quality.scores(odd.withColumn("x", F.lit(1)).withColumn("score", F.lit("s")), labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in kernel_quality.scores(odd, labels.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in kernel_quality.scores(odd, labels.where("quality = 1")).collect()} == {1.0}
    assert kernel_quality.scores(none, labels).count() == 0
