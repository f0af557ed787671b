"""The learned embedding reads its texts once."""

import numpy as np

from kbspark.operators.lsa import LsaParams, fit_lsa


def test_texts_are_read_once(spark):
    """F8: every round tokenized all texts again."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    df = spark.createDataFrame([(i, f"a b{i % 7} c{i % 3}" if i % 5 else None) for i in range(300)], "doc_id long, text string")
    once = df.mapInPandas(seen, df.schema)
    a, b = fit_lsa(once, p=LsaParams(dim=2, over=2, terms=64)), fit_lsa(df, p=LsaParams(dim=2, over=2, terms=64))
    assert read.value == 300
    assert np.allclose(a.idf, b.idf) and np.allclose(a.values, b.values)
