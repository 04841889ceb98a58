import hashlib
from pathlib import Path

from waymark.session import application_dir
from waymark.sources.trips import derived_trips


def test_a_folder_left_by_a_failed_write_is_not_read_as_whole(spark, sf):
    folder = f"{sf}/."  # a path of its own, so that no other test has written its table
    Path(application_dir(spark), f"trips-{hashlib.md5(folder.encode()).hexdigest()}").mkdir(parents=True)
    trips = derived_trips(spark, folder)
    assert trips.count() > 0 and derived_trips(spark, folder).count() == trips.count()
