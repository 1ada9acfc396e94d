"""Every operator and the pipeline are registered; the check SQL belongs to registered queries."""

import __spark_entry__ as entry
import corpus_pipeline
from panelwise.llm import catalog


def test_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in catalog.QUERIES} == {f"op{i}" for i in range(1, 11)} | {"op11", "op12", "op13"}
    assert set(catalog.QUERIES) | {"pipeline"} <= set(names) and set(catalog.SQL) <= set(catalog.QUERIES)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and set(entry.oracle_sql()) <= set(names)
