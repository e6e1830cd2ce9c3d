"""The registered queries: contract, and a sample of whole-table comparisons with SQL."""

import pytest

import __spark_entry__ as entry
from oracle import compare, duck

FOLDER = "/root/testdata/sf0.001"

# One or two per section; tests/oracle.py compares all of them.
SAMPLE = [
    "S01_load_documents", "S08_load_notes_dir", "P05_filter_texts", "P11_schema_check", "X01_period_ordinals",
    "X13_bibliography", "J04_metadata_lookup", "J09_run_matrix", "A08_describe", "A16_set_overlap", "W03_sentence_window",
    "W09_moving_average", "O02_mixed_sort", "U01_dedup_by_title", "D01_doc_collection", "D02_recursive_chunks", "D06_book_toc", "R01_bm25",
    "R02_dense", "R05_hybrid_sum", "R09_fuzzy_terms", "M01_tf_idf", "M02_lda", "M08_topics_over_time", "M10_text_clusters", "M20_feature_difference", "G06_pagerank",
    "G10_induced_subgraph", "G18_distance_pca", "E01_hits_at_k", "E03_map_ndcg", "E04_kendall", "L04_item_map", "L05_group_function",
]


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 180


@pytest.mark.parametrize("missing", ["public_tokenizers", "tokenizers", "textloom.llm", "textloom.llm.plans"])
def test_other_queries_without_the_training_data_operators(missing):
    """Whatever the optional operators need may be absent: all other queries are still there."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    code = (
        "import sys\n"
        f"sys.modules[{missing!r}] = None\n"
        "import __spark_entry__ as e\n"
        "print('queries', len(e.queries()), sum(n.startswith('op') for n in e.queries()), set(e.oracle_sql()) <= set(e.queries()))\n"
    )
    env = {**os.environ, "PYTHONPATH": str(Path(entry.__file__).parent)}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120)
    from textloom.plans import registered

    assert f"queries {len(registered.QUERIES)} 0 True" in done.stdout, done.stderr[-2000:]


def test_flagship_query(spark):
    df = entry.entry(spark)
    assert df.columns == ["query", "group", "doc", "score", "rank"] and df.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    out = compare(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name])
    assert out[0] is None, out


@pytest.mark.parametrize("name", ["A10_flatten_lists", "R07_grouped_search", "M07_class_words"])
def test_input_order_does_not_matter(spark, con, name, monkeypatch):
    from pyspark.sql import functions as F

    from textloom.plans import registry

    plain = registry.Tables.__getattr__
    monkeypatch.setattr(registry.Tables, "__getattr__", lambda self, n: plain(self, n).repartition(7, F.rand(3)) if not n.startswith("_") else plain(self, n))
    out = compare(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name])
    assert out[0] is None, out


def test_python_workers_find_the_package(tmp_path):
    """A session started elsewhere, with the repository on the driver's path only."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    code = (
        f"import sys; sys.path.insert(0, {str(Path(entry.__file__).parent)!r})\n"
        "from textloom.session import local_session\n"
        f"spark = local_session(2, 'elsewhere', '1g', {str(tmp_path / 'scratch')!r})\n"
        "from textloom.operators import chunks\n"
        "docs = spark.createDataFrame([('d', 'one two three')], 'name string, text string')\n"
        "print('chunks', chunks.chunk_rows(docs, 'name', 'text').count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "chunks 1" in done.stdout, done.stderr[-2000:]
