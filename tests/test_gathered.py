"""Blocks of lines are put together where their lines are read; only what may go on elsewhere is shuffled."""

from recbench.sources import readers


def test_only_torn_blocks_are_shuffled(spark, tmp_path, monkeypatch):
    path = tmp_path / "blame.txt"
    path.write_text("".join(f"c{i} 1 {i} 1\nauthor A{i}\n\nfilename f.py\n\t{'x' * (i % 7)}\n" for i in range(3000)) + "c9 1 1 1\nauthor not ended\n")
    lines, seen, blocks = readers.numbered_lines(spark, str(path)), [], readers._blocks
    monkeypatch.setattr(readers, "_blocks", lambda rows, starts: seen.append(rows.count()) or blocks(rows, starts))
    got = sorted(map(repr, readers.git_blame(lines).collect()))
    assert len(got) == 3000 and seen == [2]
    monkeypatch.undo()
    assert sorted(map(repr, readers.git_blame(lines.repartition(8)).collect())) == got


def test_blocks_behind_their_first_line_and_no_line_at_all(spark):
    lines = spark.createDataFrame([("p", i, v) for i, v in enumerate(["1:", "a", "", "2:", "b"])] + [("q", 0, "3:"), ("q", 1, "c")], "path string, number int, value string")
    for rows in (lines.coalesce(1), lines.repartition(5)):
        assert sorted(tuple(r["lines"]) for r in readers._gathered(rows, rows["value"] == "", False).collect()) == [("", "2:", "b"), ("1:", "a"), ("3:", "c")]
    assert readers.git_blame(lines.limit(0)).count() == 0
