from waymark.llm import queries


def test_every_oracle_is_sql():
    assert all(isinstance(sql, str) for sql in queries.ORACLES.values())
