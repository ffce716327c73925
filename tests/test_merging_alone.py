from kinscribe.operators import merging as M

SCHEMA = "focus string, pub long, partners array<string>"


def test_papers_that_share_no_partner_need_no_evidence(spark):
    rows = [("f", 1, ["a", "b"]), ("f", 2, ["b", "c"]), ("f", 3, ["d"]), ("f", 4, None), ("g", 5, ["a"]), (None, 6, ["x"]), (None, 7, ["x", None]), ("f", None, ["d"])]
    asked = []

    def evidence(pairs):
        asked.extend(sorted({(r.focus or "", r.partner or "") for r in pairs.collect()}))
        return spark.createDataFrame([("f", "b", 0.0, True)], "focus string, partner string, error double, counts boolean")

    out = M.merge_in_order(spark.createDataFrame(rows, SCHEMA), M.EvidenceRule(), evidence)
    got = {(r.focus, r.pub): r.cluster for r in out.collect()}
    assert got == {("f", 1): 1, ("f", 2): 1, ("f", None): None, ("f", 3): None, ("f", 4): 4, ("g", 5): 5, (None, 6): 6, (None, 7): 6}
    assert asked == [("", ""), ("", "x"), ("f", "a"), ("f", "b"), ("f", "c"), ("f", "d")]
