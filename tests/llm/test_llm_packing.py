import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import SF_DIR
from llm_cases import ROWS, docs
from tokenizers import Tokenizer

import __spark_entry__ as driver
from inkscore.llm.encoding import Encoder
from inkscore.llm.packing import OpenBins, best_fit_ranges, pack_documents
from inkscore.llm.shared import shared_folder
from inkscore.llm.token_files import TokenFile, read_tokens, token_files, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_library():
    rng = random.Random(5)
    parts = ["the", "Fuchs", "é", "ñ", " ", "  ", "\n", "\t", " ", "\x1c", "12", "²", "'s", "!?"]
    parts += ["<|endoftext|>", "日本", "\r\n", "ǅ", "_", "a.b", " "]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(1500)]
    small = Encoder(PATH, remembered=20)
    for encoder in (Encoder(PATH), small):
        for text in texts:
            assert np.frombuffer(encoder.one(text), np.uint32).tolist() == ids_of(text), repr(text)


def test_open_bins_finds_the_tightest():
    rng = random.Random(1)
    for capacity in (1, 5, 64, 100):
        tree, held = OpenBins(capacity), set()
        for _ in range(300):
            remaining = rng.randint(1, capacity)
            held ^= {remaining}
            tree.mark(remaining, remaining in held)
            length = rng.randint(1, capacity)
            assert tree.tightest(length) == min((h for h in held if h >= length), default=None)


def slow_best_fit(lengths, capacity):
    bins = []
    for length in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(bins) if room >= length]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= length
        else:
            bins.append(capacity - length)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(6))
def test_ranges_are_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 20, 64])
    lengths = [rng.randint(1, capacity) for _ in range(rng.choice([1, 30, 400]))]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    used, placed = {}, {n: [] for n in histogram}
    for length, rank, count, first, offset, per in best_fit_ranges(histogram, capacity):
        for i in range(count):
            placed[length].append(rank + i)
            at = offset + i % per * length
            used.setdefault(first + i // per, []).append((at, at + length))
    for length, count in histogram.items():
        assert sorted(placed[length]) == list(range(count))
    for spans in used.values():
        spans.sort()
        assert [a for a, _ in spans] == [0] + [b for _, b in spans[:-1]]
    assert sorted(capacity - max(b for _, b in s) for s in used.values()) == slow_best_fit(
        lengths, capacity
    )


def check_packed(rows, found, capacity, end_id):
    wanted = sorted(
        (repr(doc_id), piece, low, high - low, crc(ids[low:high]))
        for doc_id, text in rows
        for ids in [ids_of(text) + [end_id]]
        for piece, (low, high) in enumerate(cuts(len(ids), capacity))
    )
    plain = [tuple(r) for r in found]
    assert sorted((repr(r[0]), *r[1:5]) for r in plain) == wanted
    bins = {}
    for r in plain:
        bins.setdefault(r[5], []).append((r[6], r[6] + r[3]))
    for spans in bins.values():
        spans.sort()
        assert [a for a, _ in spans] == [0] + [b for _, b in spans[:-1]]
        assert spans[-1][1] <= capacity
    assert len(bins) == len(slow_best_fit([r[3] for r in plain], capacity))


def cuts(n, capacity):
    first = n % capacity or min(n, capacity)
    edges = [0, *range(first, n + 1, capacity)]
    return list(zip(edges, edges[1:]))


def test_packing_of_odd_documents(spark):
    found = pack_documents(docs(spark), PATH, capacity=64, end_id=2).collect()
    check_packed([r[:2] for r in ROWS], found, 64, 2)
    assert pack_documents(docs(spark, []), PATH).collect() == []


def test_packing_query(spark):
    found = driver.queries()["op9_best_fit_packing"](spark, SF_DIR).collect()
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    check_packed([tuple(r) for r in rows], found, 1024, 2)


def check_read(rows, found):
    start, wanted = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = ids_of(text) + [0]
        wanted.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    return wanted, sorted(map(tuple, found), key=lambda r: r[1])


def test_token_files_of_odd_documents(spark):
    rows = [r[:2] for r in ROWS if r[0] is not None or r[1]]
    table = docs(spark, [r for r in ROWS if r[0] is not None or r[1]])
    folder = shared_folder(spark, "files")
    index = write_tokens(table, PATH, folder, sequence=16, in_batch=4, files=3)
    wanted, found = check_read(rows, read_tokens(index, folder).collect())
    assert found == wanted
    assert token_files(docs(spark, []), PATH).collect() == []
    # Zero-copy sequences: views of the mapped file, padding only at its end.
    number = index.first()["file"]
    file = TokenFile(folder, number)
    total = index.where(f"file = {number}").groupBy().sum("n_tokens").first()[0]
    masks = []
    for batch in range(len(file.batches)):
        ids, mask = file.sequences(batch)
        assert ids.shape[1] == 16 and not ids.flags.owndata and ids.dtype == np.uint16
        assert len(ids) == 4 or batch == len(file.batches) - 1
        masks.append(mask.reshape(-1))
    joined = np.concatenate(masks)
    assert joined.sum() == total and joined[:total].all()
    with pytest.raises(ValueError):
        file.tokens(total, 1)


def test_token_files_query(spark):
    found = driver.queries()["op7_token_files"](spark, SF_DIR).collect()
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    wanted, found = check_read([tuple(r) for r in rows], found)
    assert found == wanted


def test_a_word_is_asked_for_once_and_kept_once():
    """A piece that is one word takes one place, so twice as many words are remembered."""
    encode = Encoder(PATH, remembered=50)
    asked, ask = [], encode.pieces.tokenize

    def tokenize(shown):
        asked.append(shown)
        return ask(shown)

    encode.pieces.tokenize = tokenize
    words = [chr(97 + i % 26) + chr(97 + i // 26) + "qx" for i in range(90)]
    text = " " + " ".join(words)
    first, again = encode.encode([text, text])
    assert first == again and len(asked) == len(set(asked)) == 90
    for odd in ["\n\n x  y\n", "don't 's 'll, (a1) 12.5", "a\x00b\x1f", "é\tß 　", "<|x|> 中", "  ", " ,", "\x7f ~", ""]:
        assert np.frombuffer(encode.one(odd), np.uint32).tolist() == ids_of(odd), repr(odd)
