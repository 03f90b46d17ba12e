import hashlib
import random
from collections import Counter

import public_tokenizers
import sentencepiece
from conftest import SF_DIR
from llm_cases import LONG, ROWS, docs
from tokenizers import Tokenizer

import __spark_entry__ as driver
from inkscore.llm import encoding
from inkscore.llm.alignment import PieceEncoder, align_tokens

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = [
    "", " ", "a", "  two  blanks ", "tab\there\n\nand there ", "<|endoftext|> is <s>plain</s> text", "日本語 über naïve",
    "▁mark of ▁ a blank", "ﬁ ligature and blanks", "don't we'll 12345 x=y+z;", "\x00\x01\x7f", "é é",
    "a" * 3000, "\n".join("line %d" % i for i in range(300)), "🙂🙃 🙂", "\r\n\r\n", " \n \t x", "<0x41> A",
]


def slow_rows(texts):
    """By the libraries, whole texts, and offsets in plain Python."""
    a_lib = Tokenizer.from_file(A)
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=B)
    back = {c: i for i, c in enumerate(encoding.byte_characters())}

    def bytes_a(i):
        return bytes(back[c] for c in a_lib.id_to_token(i))

    def bytes_b(i):
        piece = b_lib.id_to_piece(i)
        if len(piece) == 6 and piece.startswith("<0x"):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    made = []
    for text in texts:
        groups = []
        if text:
            want = (" " + text).encode()
            a = a_lib.encode(" " + text, add_special_tokens=False).ids
            b = b_lib.encode(text)
            if b"".join(map(bytes_a, a)) == want == b"".join(map(bytes_b, b)):
                at_a = at_b = i = j = 0
                own = ([], [])
                while i < len(a) or j < len(b):
                    if at_a <= at_b and i < len(a):
                        at_a += len(bytes_a(a[i]))
                        own[0].append(a[i])
                        i += 1
                    else:
                        at_b += len(bytes_b(b[j]))
                        own[1].append(b[j])
                        j += 1
                    if at_a == at_b:
                        groups.append(own)
                        own = ([], [])
        made.append(groups)
    counts = Counter((g[0][-1], g[1][-1]) for groups in made for g in groups)
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    rows = []
    for groups in made:
        links = [(g[0][-1], g[1][-1]) for g in groups]
        shown = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        rows.append(
            (
                sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links),
                sum(counts[x, y] == best[y] for x, y in links), sum(counts[p] for p in links),
                hashlib.sha256(shown.encode()).hexdigest() if groups else "",
            )
        )
    return rows


def same(found, rows):
    wanted = [(d, *r) for (d, _), r in zip(rows, slow_rows([t for _, t in rows]))]
    assert sorted(map(tuple, found), key=repr) == sorted(wanted, key=repr)


def test_pieces_are_those_of_the_library():
    lib, own = sentencepiece.SentencePieceProcessor(model_file=B), PieceEncoder(B, remembered=50)
    assert own.may_cut
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "a", "the", "über", "<0x0A>", "日", "\r", " ", "x1", "'s", "▁", "."]
    texts = ODD + ["".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(2000)] + [LONG]
    for text in texts:
        assert own.one(text).tolist() == lib.encode(text), repr(text)


def test_rows_are_those_of_the_libraries(spark):
    rng = random.Random(8)
    words = ["over", "heard", " the", "tok", "eniz", "ation", "Über", "12", "9", "\n", " ", "ß", "'ll", "_x"]
    rows = list(enumerate(ODD + ["".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(80)]))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = align_tokens(table, A, B)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    same(found.collect(), rows)
    # More pairs than may be broadcast.
    same(align_tokens(table, A, B, pairs_at_once=1).collect(), rows)


def test_odd_documents(spark):
    rows = [(r[0], r[1]) for r in ROWS]
    same(align_tokens(docs(spark), A, B).collect(), rows)
    assert align_tokens(docs(spark, []), A, B).collect() == []
    assert align_tokens(docs(spark, [(1, None, None, None, None)]), A, B).collect()[0][1:] == (0, 0, 0, 0, 0, 0, "")


def test_query(spark):
    table = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    found = driver.queries()["op13_token_alignment"](spark, SF_DIR).collect()
    same(found, [(r["doc_id"], r["text"]) for r in table])
