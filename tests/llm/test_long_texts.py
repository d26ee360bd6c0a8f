"""Packing and the pipeline on very long texts of one kind of character."""

import numpy as np
import pytest

LONG = [" " * 2_000_000, "\n" * 2_000_000, "a" * 2_000_000, ("x" + " " * 300) * 2000]


@pytest.fixture(scope="module")
def long_docs(spark):
    return spark.createDataFrame([(i, t, "xx", "s", len(t)) for i, t in enumerate(LONG)],
                                 "doc_id long, text string, lang string, source string, n_chars long")


def test_packing_of_long_runs(long_docs):
    import zlib

    from flowforge.llm.packing import ByteBpeEncoder, best_fit_packing
    library = ByteBpeEncoder()._library()
    got = {(r["doc_id"], r["start"]): (r["length"], r["ids_crc32"]) for r in best_fit_packing(long_docs).collect()}
    for i, t in enumerate(LONG):
        ids = np.append(library.encode(t, add_special_tokens=False).ids, 0).astype("<u4")
        own = sorted((a, *v) for (d, a), v in got.items() if d == i)
        assert [a for a, *_ in own] == np.cumsum([0] + [n for _, n, _ in own[:-1]]).tolist()
        assert sum(n for _, n, _ in own) == len(ids)
        assert all(zlib.crc32(ids[a:a + n].tobytes()) == c for a, n, c in own)


def test_pipeline_on_long_runs(spark, long_docs, tmp_path):
    import corpus_pipeline
    prose = " ".join(f"word{k}" for k in range(3000))
    long_docs.union(spark.createDataFrame([(9, prose, "xx", "s", len(prose))], long_docs.schema)) \
        .write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == {9}  # the others have too few words


def test_chat_with_very_long_turns(spark):
    import hashlib

    from flowforge.llm.chat import conversation_digests, format_conversations
    rows = [(1, 0, "user", " " * 1_000_000), (1, 1, "assistant", "é " * 500_000), (1, 2, "assistant", "\n" * 300_000)]
    got = conversation_digests(format_conversations(spark.createDataFrame(
        rows, "conv_id long, turn long, role string, text string")), in_order=True).collect()
    loss = "é " * 500_000 + "\n" * 300_000
    assert [(r["n_turns"], r["loss_chars"], r["loss_sha256"]) for r in got] == [
        (3, len(loss), hashlib.sha256(loss.encode()).hexdigest())]
