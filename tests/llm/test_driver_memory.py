"""What reaches the driver."""

import numpy as np
import pyarrow as pa

from ledgerloom.llm import quality


def test_word_vectors_are_collected_in_single_precision(spark, monkeypatch):  # pipeline, of round 3
    docs = spark.createDataFrame([(k, f"some words {k} and more words {k % 3}") for k in range(50)], "doc_id long, text string")
    collected, real = [], type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda self: collected.append(real(self)) or collected[-1])
    words, shapes = quality.word_vectors(docs)
    [table] = collected
    assert table.schema.field("unit").type.value_type == pa.float32() and table.num_columns == 2
    lengths = np.sqrt((np.concatenate([words, shapes]).astype(float) ** 2).sum(1))
    assert table.num_rows == (lengths > 0).sum() > 0 and np.allclose(lengths[lengths > 0], 1, atol=1e-6)
