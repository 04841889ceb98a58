from pathlib import Path

import pytest

from waymark.session import discard, materialise


def test_tables_are_removed_when_asked(spark):
    table = materialise(spark.range(5), "some")
    folder = Path(table.inputFiles()[0].removeprefix("file://")).parent
    assert folder.is_dir() and table.count() == 5
    discard(table)
    assert not folder.exists()
    with pytest.raises(KeyError):
        discard(table)
