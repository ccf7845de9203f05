"""A collection is parsed, indexed step by step, searched, documented and talked about."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import architecture, context, embedding, pipeline, symbols

API = "import fastapi\n\n@app.get('/health')\ndef health():\n    return 'ok'\n\nclass Service:\n    def helper(self):\n        return 1\n"
WORKER = "import os\nimport sys\n\ndef run_worker():\n    return 2\n"


def embed():
    return embedding.embedder(lambda batch: [[float(len(t)), float(t.count("e")), 1.0] for t in batch])


def files(spark, rows):
    return spark.createDataFrame(rows, "path string, text string").withColumn("hash", F.sha2("text", 256))


FIRST = [("api/main.py", API), ("worker/run.py", WORKER), ("node_modules/x.js", "f()"), ("README.md", "# hi")]


@pytest.fixture(scope="module")
def first(spark):
    found = pipeline.index_collection(files(spark, FIRST), "acme/repo", embed())
    found.state, found.points = found.state.cache(), found.points.cache()
    return found


def test_first_run(first):
    assert {r["path"]: r["status"] for r in first.changes.collect()} == {"api/main.py": "changed", "worker/run.py": "changed"}
    row = first.stats.first()
    assert (row["file_count"], row["function_count"], row["class_count"], row["api_count"]) == (2, 3, 1, 1)
    summary = first.summary.first()
    assert summary["chunk_count"] == first.points.count() > 4 and summary["vector_dimensions"] == 3 and summary["changed_files"] == 2
    assert {r["chunk_type"] for r in first.points.collect()} == {"module", "class", "function", "route"}


def test_second_run_touches_only_what_changed(spark, first):
    second = files(spark, [("api/main.py", API + "\ndef extra():\n    return 3\n"), ("lib/new.py", "def fresh():\n    pass\n")])
    found = pipeline.index_collection(second, "acme/repo", embed(), first.state, first.points)
    assert {r["path"]: r["status"] for r in found.changes.collect()} == {"api/main.py": "changed", "worker/run.py": "removed", "lib/new.py": "changed"}
    rebuilt = pipeline.index_collection(second, "acme/repo", embed())
    assert {(r["id"], r["text"]) for r in found.points.collect()} == {(r["id"], r["text"]) for r in rebuilt.points.collect()}
    assert {r["path"] for r in found.state.collect()} == {"api/main.py", "lib/new.py"}
    same = pipeline.index_collection(second, "acme/repo", embed(), rebuilt.state, rebuilt.points)
    assert same.summary.first()["chunk_count"] == 0 and same.points.count() == rebuilt.points.count()


def test_documents_and_job(spark, first):
    indexed, described, documents, progress = pipeline.run_job(spark, files(spark, FIRST), "acme/repo", embed(), lambda prompt: F.concat(F.lit(" answer to "), F.substring(prompt, 1, 21)), ["readme", "api"])
    rows = {r["doc_type"]: r for r in documents.collect()}
    assert set(rows) == {"readme", "api"} and rows["api"]["markdown"] == "answer to Repository: acme/repo" and rows["api"]["retrieved"] > 3
    assert len(set(rows["api"]["references"])) == len(rows["api"]["references"]) > 2
    row = described.first()
    assert row["summary"] == "Generated AI summary for acme/repo. Estimated indexed files: 2." and row["languages"] == ["Python"]
    assert progress.count() == 7
    with pytest.raises(ValueError, match="poem"):
        pipeline.run_job(spark, files(spark, FIRST), "acme/repo", embed(), F.upper, ["poem"])
    nothing = context.documentation_prompts(pipeline.search_index(spark, first.points.limit(0), embed()), spark, "r", ["readme"]).first()
    assert context.NO_CONTEXT in nothing["prompt"] and nothing["references"] == [] and nothing["retrieved"] == 0


def test_chat_turn(spark, first):
    turns = spark.createDataFrame([(1, n, "user" if n % 2 == 0 else "assistant", f"message {n}") for n in range(8)], "conv_id long, turn long, role string, text string")
    asked = spark.createDataFrame([(1, "where is health"), (2, "what runs")], "conv_id long, question string")
    answers, kept = context.chat_turn(turns, asked, pipeline.search_index(spark, first.points, embed(), limit=4, language="Python"), lambda p: F.concat(F.lit("A "), F.length(p)), "acme/repo")
    rows = {r["conv_id"]: r for r in answers.collect()}
    assert rows[1]["retrieved"] == 4 and len(rows[1]["snippets"]) == 3 and rows[1]["snippets"][0]["language"] == "python" and rows[1]["answer"].startswith("A ")
    assert context.NO_HISTORY in rows[2]["prompt"] and "User: message 0" in rows[1]["prompt"]
    messages = {(r["conv_id"], r["turn"]): r["text"] for r in kept.collect()}
    assert len([k for k in messages if k[0] == 1]) == 8 and messages[(1, 8)] == "where is health" and messages[(1, 9)] == rows[1]["answer"] and messages[(2, 0)] == "what runs"


def test_architecture_of_a_collection(spark):
    made = files(spark, [*FIRST, ("web/a.ts", "import e from 'express'\nimport n from 'next'\nimport f from 'fastapi'\nrouter.get('/x', e)\n")])
    parsed = symbols.parse_files(made)
    row = architecture.architecture(parsed, made.select("path"), "repo").first()
    assert row["architecture_type"] == "microservices" and row["detected_services"] == ["api", "web", "worker"]
    assert '    n_web_framework["Express, FastAPI, Next.js"]' in row["service_diagram"] and "n_web --> n_web_framework" in row["service_diagram"]
    assert row["api_flow_diagram"].startswith('```mermaid\nflowchart TD\n    client["Client"]\n    n_api_main_py["api/main.py"]\n')
    assert "No API flows detected" in architecture.api_flow_diagram(parsed.select("path", "apis").limit(0)).first()["diagram"]


def test_parse_collection_reads_files(spark, tmp_path):
    for path, text in FIRST:
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    rows = {r["path"]: r for r in pipeline.parse_collection(spark, str(tmp_path)).collect()}
    assert set(rows) == {"api/main.py", "worker/run.py"} and rows["worker/run.py"]["dependencies"] == ["os", "sys"] and len(rows["api/main.py"]["hash"]) == 64
