from clauseloom.llm import chat_format as cf

SCHEMA = "conv_id long, turn long, role string, text string, n_turns string"


def run(spark, rows):
    return {r.conv_id: (r.n_turns, r.rendered) for r in cf.formatted(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()}


def line(role, text):
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


def test_prefixes_and_copies_go(spark):
    a, b, c = ("user", "hi"), ("assistant", "hello"), ("user", "more")
    rows = [(1, 0, *a), (2, 0, *a), (2, 1, *b), (3, 0, *a), (3, 1, *b), (3, 2, *c), (4, 0, *a), (4, 1, *b), (4, 2, *c), (5, 0, *c), (6, 7, *a), (6, 9, "user", "hello")]
    got = run(spark, rows)
    assert set(got) == {3, 5, 6}
    assert got[3] == (3, line(*a) + line(*b) + line(*c))


def test_edges(spark):
    rows = [(None, 0, "user", "lost"), (1, None, "user", "z"), (1, 0, None, None), (1, 0, None, None), (2, 0, "user", "b"), (2, 0, "user", "a"), (3, 0, "", "")]
    got = run(spark, rows)
    assert got == {1: (2, line("user", "z") + line("", "")), 2: (2, line("user", "a") + line("user", "b")), 3: (1, line("", ""))}
    assert run(spark, []) == {}
    long = "x" * 300_000
    assert run(spark, [(1, 0, "user", long)])[1][1] == line("user", long)


def test_same_words_in_another_order_or_place_are_another_conversation(spark):
    rows = [(1, 0, "u", "a"), (1, 1, "u", "b"), (2, 0, "u", "b"), (2, 1, "u", "a"), (2, 2, "u", "c"), (3, 0, "u", "b"), (4, 0, "ub", ""), (5, 0, "u", "bb")]
    assert set(run(spark, rows)) == {1, 2, 4, 5}


def test_many_turns(spark):
    """A conversation of 20,000 turns, logged three times: once whole, once from its start, once changed in the middle."""
    turns = [("user" if k % 2 else "assistant", f"t{k % 50}") for k in range(20_000)]
    rows = [(1, k, *t) for k, t in enumerate(turns)] + [(2, k, *t) for k, t in enumerate(turns[:15_000])]
    rows += [(3, k, *t) if k != 7000 else (3, k, "user", "else") for k, t in enumerate(turns[:15_000])]
    got = run(spark, rows)
    assert {i: n for i, (n, _) in got.items()} == {1: 20_000, 3: 15_000}
    assert got[1][1] == "".join(line(*t) for t in turns)
