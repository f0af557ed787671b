"""The learned embedding against a dense singular value decomposition."""

import numpy as np
from conftest import SF_SMALL
from pyspark.sql import functions as F

from kbspark.operators.lsa import LsaParams, embed_lsa, fit_lsa, weighted
from kbspark.sources.tables import load


def test_lsa_equals_dense_svd(spark):
    p = LsaParams(dim=8, over=20, terms=512, rounds=8)
    docs = load(spark, SF_SMALL, "documents").select("doc_id", "text").repartition(4)
    model = fit_lsa(docs, p=p)
    rows = docs.orderBy("doc_id").collect()
    a = weighted([r.text for r in rows], model.idf)
    _, values, right = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(model.values, values[:8], rtol=1e-3)
    # Directions whose value stands apart agree up to the sign.
    apart = [i for i in range(7) if i == 0 or values[i - 1] / values[i] > 1.02 and values[i] / values[i + 1] > 1.02]
    assert len(apart) >= 3
    assert all(abs(model.vectors[:, i] @ right[i]) > 0.99 for i in apart)
    got = {r.doc_id: np.array(r.embedding) for r in embed_lsa(docs, model).collect()}
    want = a @ right[:8].T
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-12)
    # The space is the same, so the cosines between texts are.
    own = np.stack([got[r.doc_id] for r in rows])
    assert np.abs(own @ own.T - want @ want.T).max() < 0.05


def test_lsa_of_nulls_and_nothing(spark):
    p = LsaParams(dim=2, over=2, terms=16, rounds=1)
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (4, "a c")], "doc_id long, text string")
    got = {r.doc_id: np.linalg.norm(r.embedding) for r in embed_lsa(df, fit_lsa(df, p=p)).collect()}
    assert got[1] == got[2] == 0 and abs(got[3] - 1) < 1e-6 and abs(got[4] - 1) < 1e-6
    none = df.filter(F.lit(False))
    assert embed_lsa(none, fit_lsa(none, p=p)).count() == 0
