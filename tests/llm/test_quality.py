import re
import unicodedata

from folioseek.llm import quality

TEXTS = [
    None, "", "  \n ", "a " * 40, "one two three four five six seven eight " * 3 + "end", " ".join(f"word{i}" for i in range(30)),
    "\n".join(["same line of words"] * 4 + ["other"] + [" "] * 3), "## ** $ " + " ".join(f"w{i}" for i in range(25)),
    " ".join(f"WORD{i}" for i in range(30)), "\x0b".join(f"é{i}x" for i in range(25)), " ".join(f"{i}" for i in range(1000, 1040)),
    " ".join(f"w{i % 23}x{i}" for i in range(20000)), "Ment Ment Ment Ment oueau oueau oueau oueau " + " ".join(f"x{i} x{i}" for i in range(9)),
    "a\x1cb " * 3 + " ".join(f"𝒳{i}" for i in range(22)),
]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(8)}
    n, chars = len(words), sum(map(len, words))
    symbols = sum(c in "#*$%&|<>" for c in text)
    base = n < 20 or 100 * len(covered) > 30 * n
    letters = sum(unicodedata.category(c)[0] == "L" for c in text)
    capitals = sum(unicodedata.category(c) == "Lu" for c in text)
    dup = len(lines) - len(set(lines))
    stutters = sum(a == b for a, b in zip(words, words[1:], strict=False))
    bad = 10 * symbols > n or 100 * dup > 40 * len(lines) or 2 * chars < 5 * n or chars > 14 * n
    bad = bad or 2 * capitals > letters or 2 * letters < chars or 5 * stutters > n
    return n, chars, symbols, dup, len(covered), base, not (base or bad)


def test_equals_brute_force(spark):
    frame = spark.createDataFrame([(i, t, "w", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, words string, n_words int")
    rows = quality.judged(frame).orderBy("doc_id").collect()
    got = [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in rows]
    assert got == [brute(t) for t in TEXTS]
    assert all((r.rejected_by is None) == r.kept for r in rows)


def test_order_follows_rejections_per_cost(spark):
    texts = [" ".join(f"words{i}x{k}" for k in range(30)) for i in range(20)] + [" ".join(f"CAPITALS{i}x{k}" for k in range(30)) for i in range(20)]
    order = quality.ordered_rules(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert order[0].name == "capitals" and {r.name for r in order} == {r.name for r in quality.RULES}


def test_empty_table(spark):
    assert quality.judged(spark.createDataFrame([], "doc_id long, text string")).count() == 0
