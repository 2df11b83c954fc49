import os
import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from conftest import SF_DIR
from folioseek.llm import alignment
from folioseek.llm.common import table
from folioseek.llm.perfect_hash import PerfectHash, build
from folioseek.llm.queries import QUERIES

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def tokenizers():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    a = Tokenizer.from_file(f"{alignment.TOKENIZERS}/{alignment.BYTE_VOCABULARY}")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{alignment.TOKENIZERS}/{alignment.PIECE_MODEL}")


def brute_tokens(tokenizers, text):
    """Whole texts encoded at once by the libraries that the files are made for: (id, bytes) of both."""
    if not text:
        return None
    a, b = tokenizers
    alphabet = alignment.byte_alphabet()
    whole = f" {text}"
    left = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in a.encode(whole, add_special_tokens=False).ids]
    right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    if any(b"".join(piece for _, piece in side) != whole.encode() for side in (left, right)):
        return None
    return left, right


def brute(tokenizers, rows):
    found = []
    for doc_id, text in rows:
        tokens = brute_tokens(tokenizers, text)
        if tokens is None:
            found.append((doc_id, None, None))
            continue
        spans = []
        for side in tokens:
            end, own = 0, []
            for i, piece in side:
                own.append((i, end, end := end + len(piece)))
            spans.append(own)
        links, j = [], 0
        for i, start, end in spans[0]:
            while spans[1][j][2] <= start:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][1] < end:
                links.append((i, spans[1][k][0]))
                k += 1
        shared = sorted({end for *_, end in spans[0]} & {end for *_, end in spans[1]})
        place = {end: number for number, end in enumerate(shared)}
        parts = [([], []) for _ in shared]
        for side, own in enumerate(spans):
            number = 0
            for i, _, end in own:
                parts[number][side].append(str(i))
                number += place.get(end) == number
        groups = ["|".join(map(",".join, part)) for part in parts]
        found.append((doc_id, (len(spans[0]), len(spans[1]), len(groups)), (links, ";".join(groups))))
    counts = Counter(link for _, _, more in found if more for link in more[0])
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    result = []
    for doc_id, sizes, more in found:
        if more is None:
            result.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        links, groups = more
        result.append((doc_id, *sizes, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), sha256(groups.encode()).hexdigest()))
    return sorted(result, key=str)


def found(frame):
    return sorted((tuple(r) for r in frame.select(*COLUMNS).collect()), key=str)


def edge_texts():
    return [
        None, "", " ", "  ", "\n", "a", "a ", " a", "a  b", "a\tb  \n c", "Hello, world! It's 2024.", "Hello, world! It's 2024.", "▁ x", "x▁y and more",
        "déjà vu ñandú ", "日本語 の テキスト", "emoji 👍🏽 ok", "nbsp here 　wide ", "</s> <s> <unk> <|endoftext|> <0x41>", "x" * 3000, "- " * 2000,
        "tab\there\r\nnew \x0b line \x1c sep", "don't can't we've I'm", "ﬁne ﬀ", "1234567890 12 345", "a​b zero \u0000 nul", "  lead and trail  ", "  x  ",
    ]


def edge_rows():
    draw = random.Random(4)
    signs = "ab é \n\t 日.,'1▁ ß\u0085 "
    noise = ["".join(draw.choice(signs) for _ in range(draw.randrange(1, 40))) for _ in range(150)]
    rows = list(enumerate(edge_texts() + noise))
    return [*rows, (None, "no id"), (None, None), (3, "a repeated id"), (3, "a repeated id"), (-1, "a " * 30000 + "b" * 500)]


@pytest.mark.parametrize("slice_bytes", [300, alignment.SLICE_BYTES])
def test_edge_cases_equal_brute_force(spark, tokenizers, slice_bytes):
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in edge_rows()], "doc_id long, text string, slice int, keys string").repartition(3)
    result = alignment.alignments(frame, slice_bytes=slice_bytes, shards=5, fan_in=4)
    assert found(result) == brute(tokenizers, edge_rows())


def test_query_equals_brute_force_on_the_whole_table(spark, tokenizers):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF_DIR, "documents").collect()]
    assert found(QUERIES["op13_token_alignment"](spark, SF_DIR)) == brute(tokenizers, rows)


def test_empty_table(spark):
    assert found(alignment.alignments(spark.createDataFrame([], "doc_id long, text string"))) == []


def test_only_texts_without_tokens(spark):
    frame = spark.createDataFrame([("x", None), ("y", "▁")], "doc_id string, text string")
    assert found(alignment.alignments(frame)) == [("x", 0, 0, 0, 0, 0, 0, ""), ("y", 0, 0, 0, 0, 0, 0, "")]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50000])
def test_hash_is_perfect_and_minimal(n):
    keys = np.unique(np.random.default_rng(n).integers(-(2**62), 2**62, n))
    levels = build(keys)
    hashed = PerfectHash(levels)
    assert hashed.size == len(keys)
    assert sorted(hashed.numbers(keys)) == list(range(len(keys)))
    assert sum(map(len, levels)) * 8 <= 5 * len(keys) + 64 * len(levels)


def test_unknown_keys_do_not_verify():
    keys = np.arange(0, 1000, 2)
    hashed = PerfectHash(build(keys))
    stored = np.empty_like(keys)
    stored[hashed.numbers(keys)] = keys
    others = hashed.numbers(keys + 1)
    assert ((others < 0) | (stored[others] != keys + 1)).all()
