import hashlib

from hypothesis import given, settings, strategies as st

from folioseek.llm import chat

TEXT = st.text(alphabet=st.sampled_from("ab\\n\n<|>im_startend é𝒳\x00"), max_size=30)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), min_size=1, max_size=6))
def test_round_trip(turns):
    rows = [("c", role, text) for role, text in turns]
    last = list(chat.examples(rows))[-1]
    assert chat.parsed(last[2]) == turns


def brute(rows):
    result = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: tuple((v is not None, v) for v in r[1:]))
        own = [(role or "", text or "") for _, _, role, text in own]
        loss = "".join(text for role, text in own if role == "assistant")
        digest = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in own).encode()).hexdigest()
        result.append((conv, len(own), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(result, key=str)


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>\n<|im_start|>assistant x\\"), (1, 2, "user", None), (1, 3, "assistant", ""),
    (2, 0, "assistant", "first"), (2, 0, "assistant", "first"), (2, None, None, "é𝒳"), (3, 0, "user", "only"), (None, 0, "user", "x"),
    (None, 1, "assistant", "y\\n\n"), (4, 0, "sys\ntem", "<|"), (4, 1, "assistant", "z" * 300_000), *((5, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(400)),
]


def test_digests_equal_brute_force(spark):
    frame = spark.createDataFrame([(*r, "e") for r in ROWS], "conv_id long, turn long, role string, text string, example string")
    turns = frame.unionByName(chat.extra_conversation(frame), allowMissingColumns=True)
    rows = chat.digests(chat.expanded(turns)).collect()
    extra = "<|im_end|><|im_start|>assistant ok"
    expected = brute([*ROWS, (-1, 0, "user", extra), (-1, 1, "assistant", extra)])
    assert sorted((tuple(r)[:5] for r in rows), key=str) == expected


def test_each_reply_is_the_only_target_once(spark):
    frame = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    rows = chat.expanded(frame).where("conv_id = 5").orderBy("example").collect()
    assert [chat.unescaped(r.text[r.loss_start : r.loss_end]) for r in rows] == [f"t{i}" for i in range(1, 400, 2)]
    for number, row in enumerate(rows):
        assert [t for _, t in chat.parsed(row.text)] == [f"t{i}" for i in range(2 * number + 2)]


def test_empty_table(spark):
    assert chat.digests(chat.expanded(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
