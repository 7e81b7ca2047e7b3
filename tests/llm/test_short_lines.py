"""Short lines are deduplicated too."""

from marlpit.llm import lines


def test_short_lines_repeat(spark):
    rows = [(1, "All rights reserved.\nread me\nagain.\n\nno"), (2, "all  rights reserved.\nREAD ME\nother words\nagain.\n\nno"), (3, "\u4eca\u5929\u5929\u6c14\u5f88\u597d\u3002\nlast"), (4, "\u4eca\u5929\u5929\u6c14\u5f88\u597d\u3002\nlast")]
    got = {r["doc_id"]: r["dropped"] for r in lines.dropped_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [0, 1, 3], 3: [], 4: [0]}
