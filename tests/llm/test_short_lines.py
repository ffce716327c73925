"""Line dedup over every line: short ones, and single edits in lines of ordinary length."""

from test_near_duplicates import components, line_docs

import corpus_pipeline
from kinscribe.llm.queries import op9_line_dedup

SHINGLE = 5  # not that of the operator, so that a longer one shows


def rows_of():
    line = "the quick brown fox jumps over a lazy dog by the river bank"
    edited = line[:30] + "X" + line[31:]
    short = ["les.", "un.", "a", "é", " ", "\t\r", "", "un.", "LES.", "wh the.", "wh the."]
    assert 49 <= len(line) < 79
    return [*line_docs(), (200, "\n".join(short)), (201, "\n".join(short)), (202, "les"), (203, line), (204, edited)]


def test_every_line_against_brute_force(spark, tmp_path):
    rows = rows_of()
    low = {c: c + 32 for c in range(65, 91)}
    lines = {(i, k): x.translate(low) for i, t in rows if t is not None for k, x in enumerate(t.split("\n")) if x.strip()}
    s = {p: {x[k : k + SHINGLE] for k in range(max(len(x) - SHINGLE, 0) + 1)} for p, x in lines.items()}
    want = components(s, [(a, b) for a in s for b in s if a < b and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])])
    docs = corpus_pipeline.measured(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"))
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {(x.doc_id, x.line_no): (x.first_doc_id, x.first_line_no) for x in op9_line_dedup(spark, str(tmp_path)).collect()}
    assert got == want
    assert want[201, 0] == want[200, 8] == (200, 0) and want[200, 7] == (200, 1) and want[204, 0] == (203, 0) and want[202, 0] == (202, 0)
    text = {x.doc_id: x.text for x in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    for i, t in rows:
        assert text[i] == (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if want.get((i, k), (i, k)) == (i, k)))
    assert text[201] == " \n\t\r\n"
