import hashlib
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from kinscribe.llm import token_alignment as T
from kinscribe.llm.queries import op12_token_alignment, table
from kinscribe.llm.tokens import byte_of_letter

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


def brute(rows):
    """Straight from the definition, with the tokenizers' own libraries; rows: (doc_id, text)."""
    a_side, b_side, letters = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_of_letter()
    a_side.encode_special_tokens = True

    def spans(tokens):
        at, out = 0, []
        for i, data in tokens:
            out.append((i, at, at + len(data)))
            at += len(data)
        return out

    docs, holders = [], Counter()
    for doc_id, text in rows:
        a = [(i, bytes(letters[c] for c in a_side.id_to_token(i))) for i in a_side.encode(" " + (text or ""), add_special_tokens=False).ids]
        b = []
        for i in b_side.encode(text or ""):
            piece = b_side.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if b_side.is_byte(i) else piece.replace("▁", " ").encode()))
        data = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in a) != data or b"".join(x for _, x in b) != data:
            docs.append((doc_id, [], [], [], ""))
            continue
        a, b = spans(a), spans(b)
        links, k = [], 0
        for i, start, end in a:
            while k and b[k - 1][2] > start:
                k -= 1
            while k < len(b) and b[k][2] <= start:
                k += 1
            m = k
            while m < len(b) and b[m][1] < end:
                links.append((i, b[m][0]))
                m += 1
        ends = sorted({x[2] for x in a} & {x[2] for x in b})
        groups, x, y = [], 0, 0
        for e in ends:
            ga, gb = [], []
            while x < len(a) and a[x][2] <= e:
                ga.append(str(a[x][0]))
                x += 1
            while y < len(b) and b[y][2] <= e:
                gb.append(str(b[y][0]))
                y += 1
            groups.append(",".join(ga) + "|" + ",".join(gb))
        holders.update(set(links))
        docs.append((doc_id, a, b, links, ";".join(groups)))
    top = {}
    for (i, _), n in holders.items():
        top[i] = max(top.get(i, 0), n)
    for doc_id, a, b, links, groups in docs:
        yield doc_id, len(a), len(b), groups.count("|"), len(links), sum(holders[p] == top[p[0]] for p in links), sum(holders[p] for p in links), groups


ODD = ["", None, " ", "a", "  two  blanks ", "<|endoftext|> as plain text </s>", "tab\tline\n\nend ", "▁ looks like a blank", "naïve café ﬁ 𝄞 日本語のテキスト", "\x00\x01 controls \x7f", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "é ​ ", "don't won't I'll 12345 3.14", "x" * 3000, "same again", "same again", "the the the the"]


@pytest.mark.parametrize("bounds", [T.Bounds(), T.Bounds(cells=1 << 20, block_docs=3, held_pairs=5, slot_bytes=100)])
def test_equals_definition(spark, bounds):
    rows = [*enumerate(ODD), (3, "a repeated id"), (None, "no id"), (None, "no id"), (77, "long " + "wörter und words " * 4000)]
    docs = spark.createDataFrame([(i, t, 1, "block", -1) for i, t in rows], "doc_id long, text string, part int, block string, stripe int").repartition(3)
    want = sorted(brute(rows), key=repr)
    got = sorted((tuple(r) for r in T.align_tokens(docs, A, B, bounds=bounds).collect()), key=repr)
    assert got == want and sum(x[4] for x in got) > 10_000
    digests = sorted((r[-1] for r in T.align_tokens(docs, A, B, digest=True, bounds=bounds).collect()))
    assert digests == sorted(hashlib.sha256(x[-1].encode()).hexdigest() if x[-1] else "" for x in want)
    assert T.align_tokens(docs.limit(0), A, B).count() == 0


def test_whole_table_equals_definition(spark):
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    want = sorted((*x[:-1], hashlib.sha256(x[-1].encode()).hexdigest() if x[-1] else "") for x in brute(rows))
    assert sorted(tuple(r) for r in op12_token_alignment(spark, SF).collect()) == want
