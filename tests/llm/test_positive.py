"""The positive-unlabelled classifier: its risk against a plain minimiser, held-out accuracy, and what it may not read."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from latticework.llm import positive
from latticework.llm.queries import LLM_QUERIES


def _risk(w, x_u, x_p, prior):
    f_u, f_p = x_u @ w, x_p @ w
    bracket = ((1 + f_u) ** 2).mean() / 4 - prior * ((1 + f_p) ** 2).mean() / 4
    return prior * ((1 - f_p) ** 2).mean() / 4 + max(0.0, bracket), bracket


@pytest.mark.parametrize("prior", [0.4, 0.9])
def test_risk_is_least(prior):
    # the second prior is far too high: without the bound the bracket would fall below zero
    rng = np.random.default_rng(2)
    good, bad = rng.normal(1, 1, (60, 6)), rng.normal(-1, 1, (140, 6))
    x_p, x_u = (np.hstack([np.ones((len(x), 1)), x]) for x in (good, np.vstack([rng.normal(1, 1, (90, 6)), bad])))
    w = positive.least_risk(x_u.T @ x_u / len(x_u), x_p.T @ x_p / len(x_p), prior)
    least, bracket = _risk(w, x_u, x_p, prior)
    assert bracket > -1e-6 and (prior < 0.5 or abs(bracket) < 1e-6)
    for _ in range(3_000):
        assert _risk(w + rng.normal(0, rng.choice([1e-3, 1e-2, 0.1, 0.5]), 7), x_u, x_p, prior)[0] >= least - 1e-4


def test_posterior_never_falls():
    p, u = np.array([0, 0, 1, 5, 4, 9, 0]), np.array([0, 5, 4, 8, 6, 9, 0])
    got = positive.posterior(p.astype(float), u.astype(float), 0.6)
    assert (np.diff(got) >= 0).all() and got[1] == 0 and got.max() <= 1 and len(got) == 7


def test_features_do_not_depend_on_neighbours():
    texts = ["One two two.\nOne two two.\n", None, "", " \n", "ÉÈ äö 1234 $$$", "x" * 3_000_000, "a b c d e f " * 50]
    together = positive.features(pa.array(texts, pa.string()))
    alone = np.vstack([positive.features(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(together, alone) and together.shape == (7, positive.WIDTH)
    assert np.isfinite(together).all() and together.min() >= 0 and (together[1] == together[2]).all()


def _text(rng, good):
    words = ["river", "stone", "and", "the", "of", "green", "walked", "house", "never", "light", "morning", "with"]
    told = [rng.choice(words) for _ in range(rng.randint(15, 120))]
    if good:
        return " ".join(told).capitalize() + "."
    return rng.choice([" | ".join(told), " ".join([told[0]] * len(told)), "!! ".join(told).upper(), " ".join(w + "$$" for w in told)])


def _tables(spark, path, rows, labels):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    found = LLM_QUERIES["op13_quality_classifier"](spark, str(path))
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    return found.collect()


def test_held_out_quality(spark, tmp_path):
    rng = random.Random(6)
    good = [rng.random() < 0.7 for _ in range(1_500)]
    rows = [(i, _text(rng, g), "en", "a") for i, g in enumerate(good)]
    labels = [(i, int(g), 0) for i, g in enumerate(good) if rng.random() < 0.5]
    got = _tables(spark, tmp_path / "a", rows, labels)
    held = {i for i in range(1_500) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert len(got) == 1_500 and {r.doc_id for r in got if r.held_out} == held
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    right = [r.predicted == good[r.doc_id] for r in got if r.held_out]
    assert sum(right) / len(right) > 0.97
    # labels of held-out rows, and everything but the text, leave the scores alone
    turned = [(i, 1 - q if i in held else q, 1) for i, q, _ in labels]
    again = _tables(spark, tmp_path / "b", [(i, t, "xx", "other") for i, t, _, _ in rows], turned)
    assert np.allclose([r.score for r in sorted(got)], [r.score for r in sorted(again)])


def test_odd_rows(spark, tmp_path, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (3, 1, 0), (7, 0, 1), (None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    got = positive.score_quality(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (4, 5)}) == 1 and len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert positive.score_quality(none, labels).count() == 0
    unlabelled = positive.score_quality(odd, labels.where("false")).collect()
    assert len({r.score for r in unlabelled}) == 1
