"""Tasks leave no freed memory in the reused Python workers."""

from __future__ import annotations

import pyarrow as pa

from retentia.llm import common


def test_task_gives_memory_back_at_its_end(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "release", lambda: calls.append(1))
    batch = pa.RecordBatch.from_pydict({"text": ["a"]})

    def run(batches):
        for b in batches:
            assert not calls
            yield b

    assert list(common.released(run)(iter([batch, batch]))) == [batch, batch]
    assert calls == [1]
    stopped = common.released(run)
    calls.clear()
    task = stopped(iter([batch, batch]))
    next(task)
    task.close()  # a task that is given up
    assert calls == [1]


def test_map_blocks_gives_memory_back(monkeypatch):
    seen = []

    class Docs:
        def mapInArrow(self, f, schema):
            seen.append(f)

    calls = []
    monkeypatch.setattr(common, "release", lambda: calls.append(1))
    common.map_blocks(Docs(), "text string", lambda batch: batch)
    out = list(seen[0](iter([pa.RecordBatch.from_pydict({"text": ["a", None]})])))
    assert [b.num_rows for b in out] == [2] and calls == [1]


def test_release_is_harmless_with_arrays_alive():
    kept = pa.array(range(1000))
    common.release()
    assert kept.sum().as_py() == 499500


def test_packing_keeps_no_encoder(monkeypatch):
    """The encoder's cache of chunks, 70 MB after 8000 texts, used to stay in every worker."""
    import public_tokenizers
    from retentia.llm import packing

    seen = []

    class Docs:
        def mapInArrow(self, f, schema):
            seen.append(f)

    monkeypatch.setattr(packing, "id_and_text", lambda docs: docs)
    packing.pieces(Docs(), public_tokenizers.path("byte_bpe_50k.json"))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["some words"]})
    assert sum(b.num_rows for b in seen[0](iter([batch]))) == 1
    assert packing.encoder.cache_info().currsize == 0


def test_redact_needs_no_pandas(spark):
    """Pandas took 44 MB of every worker; values, order of columns and other columns stay."""
    from retentia.llm import secrets

    text = "a password=abcdefgh12 b"
    df = spark.createDataFrame([(1, text, "x", len(text)), (2, None, None, None), (3, "", "y", 0)], "doc_id long, text string, lang string, n_chars long")
    out = secrets.redact(df, secrets.train(df))
    assert "ArrowEvalPython" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.columns == df.columns and out.schema["text"].dataType == df.schema["text"].dataType
    got = {r.doc_id: tuple(r)[1:] for r in out.collect()}
    assert got == {1: ("a [SECRET] b", "x", 12), 2: (None, None, None), 3: ("", "y", 0)}
