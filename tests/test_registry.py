import re

from __spark_entry__ import oracle_sql, queries
from checks.registry import all_oracles, all_queries


def test_every_oracle_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_every_query_has_an_oracle():
    assert set(all_queries()) == set(all_oracles())  # the library's own; trained and randomised operators have none
    assert set(all_queries()) <= set(queries()) and set(oracle_sql()) <= set(queries())


def test_oracles_name_only_known_relations():
    for name, sql in oracle_sql().items():
        assert not re.search(r"\{[a-z_]+\}", re.sub(r"'[^']*'", "", sql)) or "to_json" in sql, name
