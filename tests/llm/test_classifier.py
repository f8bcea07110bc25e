import numpy as np
import zlib

from palimpsest.llm import classifier, queries


def test_held_out_accuracy(spark, middle):
    got = {r.doc_id: r for r in queries.op10_classifier(spark, middle).collect()}
    labels = spark.read.parquet(f"{middle}/labels.parquet").collect()
    assert len(got) == spark.read.parquet(f"{middle}/documents.parquet").count()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(got[x.doc_id].predicted, x.quality) for x in labels if got[x.doc_id].held_out]
    assert np.mean([p == q for p, q in held]) > 0.95


def test_query_is_brute_force(spark, middle):
    """Features one by one, ridge by least squares over penalty rows, the calibration by greatest least averages."""
    docs = {r.doc_id: classifier.statistics(r.text) for r in spark.read.parquet(f"{middle}/documents.parquet").select("doc_id", "text").collect()}
    labels = [r for r in spark.read.parquet(f"{middle}/labels.parquet").collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.doc_id in docs]
    x, y = np.array([docs[r.doc_id] for r in labels]), np.array([float(r.quality) for r in labels])
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale < 1e-5, 1.0, scale)
    directions, phases = classifier.draw_features(x.shape[1])

    def features(rows):
        z = np.clip((rows - mean) / scale, -classifier.CLIP, classifier.CLIP)
        waves = [np.sqrt(2 / len(phases)) * np.cos(z @ d + p) for d, p in zip(directions.T, phases, strict=True)]
        return np.stack([np.ones(len(rows)), *waves], axis=1)

    f = features(x)
    penalty = np.sqrt(classifier.RIDGE * len(x) / len(phases)) * np.eye(f.shape[1])[1:]
    weights = np.linalg.lstsq(np.r_[f, penalty], np.r_[y, np.zeros(len(penalty))], rcond=None)[0]
    raw = np.clip(f @ weights, -0.5, 1.5)
    bins = np.minimum(((raw + 0.5) / 2 * classifier.BINS).astype(int), classifier.BINS - 1)
    used = sorted(set(bins))
    n, ones, at = (np.array([v[bins == b].sum() for b in used]) for v in (np.ones(len(x)), y, raw))
    fit = [max(min(ones[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, len(used))) for a in range(i + 1)) for i in range(len(used))]
    ids = sorted(docs)
    want = dict(zip(ids, np.interp(features(np.array([docs[i] for i in ids])) @ weights, at / n, fit), strict=True))
    got = {r.doc_id: r.score for r in queries.op10_classifier(spark, middle).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in ids) < 1e-6


def test_isotonic():
    assert classifier.isotonic(np.array([1.0, 0.0, 2.0]), np.array([1.0, 3.0, 1.0])).tolist() == [0.25, 0.25, 2.0]
    rng = np.random.default_rng(0)
    v, w = rng.normal(size=200), rng.uniform(0.1, 2, 200)
    fit = classifier.isotonic(v, w)
    assert (np.diff(fit) >= 0).all() and abs((fit * w).sum() - (v * w).sum()) < 1e-9


def test_kernel_is_approximated():
    directions, phases = classifier.draw_features(5, 20000)
    x = np.random.default_rng(3).normal(size=(6, 5))
    f = np.sqrt(2 / 20000) * np.cos(x @ directions + phases)
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * 5))
    assert np.abs(f @ f.T - exact).max() < 0.03


def test_normal_equations_match_one_partition(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, len(classifier.STATISTICS)))
    y = (x[:, 0] > 0).astype(float)
    rows = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y, strict=True)], "x array<double>, y double")
    many, one = (classifier.fit(rows.repartition(n)) for n in (7, 1))
    assert np.allclose(many.weights, one.weights)
    assert ((many.score(x) >= 0.5) == (y == 1)).mean() > 0.9


def test_edges(spark):
    texts = [None, "", " ", "one", "퟿ é🙂 " * 3, "w" * 300000, "a b\n" * 30000]
    assert all(np.isfinite(classifier.statistics(t)).all() and len(classifier.statistics(t)) == len(classifier.STATISTICS) for t in texts)
    docs = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(texts * 2)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 0), (3, 1), (None, 1)], "doc_id long, quality int")
    rows = classifier.quality(docs, labels).collect()
    assert len(rows) == 14 and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in classifier.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert classifier.quality(docs.limit(0), labels).count() == 0
