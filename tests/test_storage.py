import glob

from leafmill import storage


def test_settled_tables_are_shared_and_can_be_discarded(spark):
    before = storage.discard(spark)
    df = storage.settled(spark.range(5), "five")
    assert before >= 0 and df.count() == 5
    at = storage.shared_dir(spark).removeprefix("file://")
    assert glob.glob(f"{at}/leafmill-five-*")
    assert storage.discard(spark) == 1 and not glob.glob(f"{at}/leafmill-five-*")


def test_a_table_can_be_removed(spark):
    storage.discard(spark)
    a, b = storage.settled(spark.range(3), "a"), storage.settled(spark.range(4), "b")
    storage.remove(a)
    at = storage.shared_dir(spark).removeprefix("file://")
    assert not glob.glob(f"{at}/leafmill-a-*") and b.count() == 4 and storage.discard(spark) == 1
