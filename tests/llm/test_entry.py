"""The driver's names."""

import re


def test_all_eleven_queries_are_registered():
    import __spark_entry__ as entry

    found = entry.queries()
    numbers = sorted(int(m[1]) for x in found if (m := re.match(r"op(\d+)_", x)))
    assert numbers == list(range(1, 11)) and "pipeline" in found
    assert "op2_exact_dedup" in entry.oracle_sql() and "pipeline" not in entry.oracle_sql()


def test_nothing_else_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[2]
    for path in [*(root / "loomlog").rglob("*.py"), *root.glob("*.py"), *(root / "tests").glob("*.py")]:
        if "llm" not in path.parent.name and path.name not in ("__spark_entry__.py", "corpus_pipeline.py"):
            assert not re.search(r"import.*\bllm\b|from.*\bllm\b", path.read_text()), path


def test_further_columns_do_not_clash(spark, tmp_path, clashing):
    from pyspark.sql import functions as F

    from loomlog.llm import queries

    d = f"file://{tmp_path}/sf"
    more = [x for x in ("match", "start", "end", "kind", "seed", "context", "digest", "at", "words", "first", "host", "license", "hash") if x not in clashing.columns]
    clashing.withColumns({x: F.lit("7") for x in more}).write.parquet(f"{d}/documents.parquet")
    clashing.select("doc_id", "text").write.parquet(f"{tmp_path}/plain/documents.parquet")
    for name in ("op6_pii", "op8_license_scan", "op10_chunk_dedup"):
        got, want = (sorted(map(repr, queries.QUERIES[name](spark, x).collect())) for x in (d, f"file://{tmp_path}/plain"))
        assert got == want, name
