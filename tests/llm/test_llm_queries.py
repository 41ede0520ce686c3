import importlib.util
import os

import pytest

from plenaria.llm import queries

spec = importlib.util.spec_from_file_location("compare", os.path.join(os.path.dirname(__file__), "..", "compare.py"))
compare = importlib.util.module_from_spec(spec)
spec.loader.exec_module(compare)

COLUMNS = {
    "p1_found": ["tabel", "sleutel", "fractie_id"],
    "p2_found": ["verslag_id", "start_volgnr", "persoon_id"],
    "p5_found": ["besluit_id", "zaak_id"],
    "p6_found": ["speech_id", "activiteit_id"],
    "p8_ids": ["doc_id", "ids"],
    "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_distinct_rows(spark, data, name):
    got = queries.QUERIES[name](spark, data)
    assert got.columns == COLUMNS[name]
    assert got.count() == got.distinct().count() > 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, data, name):
    compare.same(queries.QUERIES[name](spark, data), compare.connection(data), queries.SQL[name])
