"""Line dedup: the bound that keeps lines from being compared."""

import random

from lorefold.llm import line_dedup


def test_line_parities_leave_out_what_cannot_be_near_and_nothing_else(spark):
    r = random.Random(31)
    make = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    # one band of 200 lines: one beginning, ends of their own; every fifth line is near the one before
    start, text = make(150), []
    for k in range(200):
        text.append(text[-1][:-9] + make(9) if k % 5 == 4 else start + make(80) * (1 + k % 2))
    table = spark.createDataFrame([(k, t) for k, t in enumerate(text)], "node long, t string")
    at = table.selectExpr("1L AS key", "node", "node AS c")
    got = {(x["u"], x["v"]) for x in line_dedup._apart(at, line_dedup.parities(table), 0.75).collect()}
    sets = [{t[i : i + 8] for i in range(len(t) - 7)} for t in text]
    alike = {(a, b) for a in range(200) for b in range(a + 1, 200) if len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b])}
    assert alike <= got and len(alike) == 40 and len(got) <= 60
