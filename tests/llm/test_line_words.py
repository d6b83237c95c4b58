"""Line dedup: words between any white space, and lines of a text that are cut once."""

import time

import pytest
from pyspark.sql import functions as F

from tidegauge.llm import line_dedup


@pytest.mark.parametrize("said", ["a b c", " a b", "a b ", "a  b", "a\tb", "\x0ba b\x0c", "a\r", "a\x1fb c", "　a b", "a b c\r "])
def test_words_of_a_line(llm, said):
    want = [w for w in said.translate({i: " " for i in range(9, 14)}).split(" ") if w]
    assert llm.createDataFrame([(said,)], "line string").select(line_dedup.words(F.col("line")).alias("w")).first()["w"] == want


def test_lines_of_one_text_are_cut_once(llm):
    """A text is not cut again for each of its lines: one of 40,000 takes about as long as 800 of 50."""

    def seconds(size):
        rows = [(k, "\n".join(f"w{(k + i) // 2} said" for i in range(size))) for k in range(0, 40_000, size)]
        docs = llm.createDataFrame(rows, "doc_id long, text string").repartition(1)
        start = time.perf_counter()
        got = line_dedup.dedup_lines(docs).agg(F.sum("n_exact"), F.sum(F.size(F.split("text", "\n")))).first()
        return time.perf_counter() - start, tuple(got)

    seconds(50)
    many, one = seconds(50), seconds(40_000)
    assert many[1] == one[1] == (20_000, 20_000)
    assert one[0] < 2 * many[0] + 3
