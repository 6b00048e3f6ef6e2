import subprocess
import sys
from pathlib import Path

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from probelake.llm import exact_dedup, minhash, mixing, queries

ROOT = Path(__file__).resolve().parents[2]
PROSE = "The {0} ran slowly past the old mill and the children watched it from the bridge near {0} town while {0} evening came."


def test_every_operator_has_one_query():
    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and set(queries.SQL) <= set(queries.QUERIES)


def test_entry_works_without_the_subpackage():
    code = ("import sys\nsys.modules['probelake.llm'] = sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\n"
            "q = e.queries()\nassert len(q) > 100 and not any(n.startswith('op1_') or n == 'pipeline' for n in q)\ne.oracle_sql()")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "probelake").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm import" not in path.read_text() and "probelake.llm" not in path.read_text(), path


def test_pipeline_stages_decide_as_their_operators(make, spark, tmp_path):
    names = [f"river{i}" for i in range(40)]
    rows = [(i, PROSE.format(n), "en", f"src{i % 4}") for i, n in enumerate(names)]
    rows += [(100 + i, PROSE.format(n) + "\nHome | News | Shop", "en", "src1") for i, n in enumerate(names[:5])]  # copies once cleaned
    long = " ".join(f"Word{i} stands before thing{i} and so does number{i} here." for i in range(40))  # no window of five words twice
    rows += [(200, long, "de", "src2"), (201, long + " It was late.", "de", "src2"), (300, "too short", "en", "src1"), (301, None, None, None), (302, "", "en", "src1")]
    make(rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "mixing", "pieces"]
    step = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == before.columns
        step.append({r["doc_id"] for r in docs.collect()})
    assert {300, 301, 302}.isdisjoint(step[0]) and set(range(40)) <= step[0] and 200 in step[0]
    assert step[1] == step[0] - set(range(5))  # the copy with the largest id stays
    assert 200 in step[2] and 201 not in step[2] and step[2] <= step[1]
    assert step[3] <= step[2] and len(step[3]) >= 0.6 * len(step[2])
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    kept = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "3")).collect()}
    assert {r["doc_id"]: r["ids"] for r in docs.collect()} == {i: sp.encode(t) for i, t in kept.items()}


def test_stages_take_an_empty_table(make, spark, tmp_path):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, make([]), str(tmp_path))
        assert out.isEmpty(), name
        assert name == "pieces" or out.columns == make([]).columns
    assert exact_dedup.mark_copies(make([])).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert minhash.near_groups(make([])).columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert mixing.mix(make([]), F.lit("d"), F.lit(1), 50, {}).count() == 0
