"""All queries over tables of nulls, of copies under one id, of one row, of a very long text, and without rows."""

import pytest

from tests.llm.conftest import DOCS, odd_rows
from tests.llm.test_spelling import plain_counts, plain_variants
from tidemark.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<float>, id string, cluster string, x int"
PAGES = "page_id long, url string, html string, digest string, id string"
SAME = [(10 + i, "http://x.com/de/", "same", None, None) for i in range(200)]
TABLES = {
    "nulls": ([(None,) * 8] * 20, [(None,) * 5] * 20),
    "copies": ([(i, "a b c d e f g h", None, None, None, None, None, None) for i in range(300)] + [(7, "a b c d e f g h", "en", "s", 1, "", "", "")] * 300, SAME + SAME[:1] * 200),
    "one": (odd_rows()[:1], SAME[:1]),
    "long": ([(1, "word " * 400_000, "en", "s", 1, "", "", ""), (2, "x" * 1_000_000, "en", "s", 1, "", "", ""), (3, "é" * 50_000, "fr", "s", None, None, None, None)], [(1, "http://a/" + "b" * 100_000, "h" * 2_000_000, "", "")]),
    "empty": ([], []),
}


@pytest.mark.parametrize("name", TABLES)
def test_every_row_has_its_result(spark, tmp_path, name):
    docs, pages = TABLES[name]
    spark.createDataFrame(docs, DOCS).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(pages, PAGES).repartition(2).write.parquet(f"{tmp_path}/pages.parquet")
    vectors = [(i, None if i % 3 == 0 else [float(i % 7)] * 64, None, "c", 0) for i in range(len(docs) // 2)]
    spark.createDataFrame(vectors, VECTORS).repartition(2).write.parquet(f"{tmp_path}/embeddings.parquet")
    for query, run in QUERIES.items():
        rows = run(spark, str(tmp_path)).collect()
        if query == "op13_spelling":
            assert sorted(map(tuple, rows), key=repr) == plain_variants(plain_counts([r[:2] for r in docs])), query
        elif query == "op11_clustering":
            assert len(rows) == sum(v[1] is not None for v in vectors), query
        else:
            want = len(pages if query in ("op5_url_filter", "op10_warc") else docs)
            assert len(rows) == want or query == "op2_packing" and len(rows) >= want, query
