"""Lines of git's output longer than a MiB stay whole."""

from recbench.sources import readers


def test_blamed_line_stays_whole(spark):
    long = "x" * ((1 << 20) + 5)
    lines = ["abc 1 1 1", "author A", "filename f.py", "\t" + long]
    df = spark.createDataFrame([("p", i, v) for i, v in enumerate(lines)], "path string, number int, value string")
    assert len(readers.git_blame(df).first()["line"]) == len(long)
    log = [f"@@{long}\ta@b.c", "f.py"]
    df = spark.createDataFrame([("p", i, v) for i, v in enumerate(log)], "path string, number int, value string")
    assert len(readers.git_log(df).first()["author"]) == len(long)
