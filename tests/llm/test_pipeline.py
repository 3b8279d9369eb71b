"""The pipeline's stages, each against its own contract on its own input."""

import shutil
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from sonagrid.llm import pieces
from sonagrid.llm.common import table
from sonagrid.llm.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DIR).exists(), reason="no tables")


def jaccard(a, b):
    cut = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").lower().split()] for i in range(max(1, len(w) - 4)) if w}
    x, y = cut(a), cut(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_stages_in_order(spark, tmp_path):
    docs = table(spark, DIR, "documents")
    columns = docs.columns
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = {r["doc_id"]: r for r in table(spark, DIR, "labels").collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DIR)
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i == 4:
            assert all(r["round_trip"] for r in docs.collect())
            assert {r["doc_id"] for r in docs.collect()} == set(before)
            break
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(after) <= set(before) and (docs.count() == len(after) or name == "mixing")  # rates over 1 draw copies
        gone = set(before) - set(after)
        if name == "toxicity":
            assert all(not (labels[d]["toxic"] == 0) for d in gone if d in labels)
            assert after == {d: before[d] for d in after}
        if name == "line_dedup":
            seen = set()
            for d in sorted(after):
                own = {ln for ln in (after[d] or "").split("\n") if len(ln.split()) >= 8}
                assert not own & seen
                seen |= own
        if name == "near_dedup":
            assert all(max((jaccard(before[d], t) for e, t in before.items() if e != d), default=0) >= 0.8 for d in gone)
            ids = sorted(after)
            assert sum(jaccard(after[a], after[b]) >= 0.8 for x, a in enumerate(ids) for b in ids[:x]) <= len(ids) // 50
        if name == "mixing":
            assert all(labels[d]["quality"] == 0 for d in gone if d in labels)
        before = after


@pytest.mark.parametrize("name", ["op2_pieces", "pieces"])
def test_pieces_return_their_ids(spark, name):
    import zlib

    import numpy as np
    import public_tokenizers

    from sonagrid.llm.pieces import SPACE, decode, vocabulary

    vocab = vocabulary(public_tokenizers.path("piece_bpe_32k.model"), 1.0)
    docs = table(spark, DIR, "documents")
    out = QUERIES[name](spark, DIR) if name in QUERIES else corpus_pipeline.pieces(spark, docs, DIR)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.limit(20).collect()}
    rows = [r for r in out.collect() if r["doc_id"] in texts]
    assert rows
    for r in rows:
        ids = np.array(r["ids"], np.int64)
        assert len(ids) == r["n_pieces"] and zlib.crc32(ids.astype("<u4").tobytes()) == r["ids_crc32"]
        assert decode(ids, vocab) == texts[r["doc_id"]].replace(SPACE, " ")


def test_run_gives_rows(spark):
    assert corpus_pipeline.run(spark, DIR).count() > 0
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df, expected = QUERIES[name](spark, DIR), c.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    got = sorted(repr([r[k] for k in columns]) for r in df.collect())
    assert got == sorted(repr([r[expected.columns.index(k)] for k in columns]) for r in expected.fetchall())


def test_library_stands_alone(tmp_path):
    """The rest imports and registers its queries when this subpackage and the pipeline are gone."""
    import subprocess
    import sys

    root = Path(corpus_pipeline.__file__).parent
    shutil.copytree(root / "sonagrid", tmp_path / "sonagrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q) and not any(k.startswith('op1_') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


@pytest.mark.parametrize("rows", ["some", "none"])
def test_pipeline_edges(spark, tmp_path, rows):
    """Nulls, empty and very long texts, ties, repeated rows and clashing columns through the whole pipeline; and empty tables."""
    texts = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "no id here at all"), (4, "word " * 50_000 + "end"), (5, "\n\n"), (6, "one two three four five six seven eight nine"), (7, "one two three four five six seven eight nine"), (8, "Ünï 漢字 ☃")]
    extra = ["lang", "source", "n_chars", "sample", "ids", "copies", "root", "drops", "hash", "own_id", "SHA"]
    docs = spark.createDataFrame([(i, t, *(f"{c}{k}" for c in extra)) for k, (i, t) in enumerate(texts if rows == "some" else [])], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in extra))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, 1), (6, 1, 0), (None, 1, 0), (6, 0, 0)] if rows == "some" else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r["round_trip"] for r in got)
    if rows == "none":
        assert not got and frame.count() == 0
        return
    kept = {r["doc_id"] for r in got}
    assert {1, 3, 4, None, 8} <= kept | {2, 5} and len({6, 7} & kept) <= 1
    with pytest.raises(ValueError):
        pieces.sampled_segmentations(docs.withColumnRenamed("doc_id", "Sample_").withColumnRenamed("sample", "s").withColumnRenamed("Sample_", "sample"), "model", id_col="sample")
