import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from remedex.llm import op8_chat_formatting as op

BITS = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "\\", "<", "/", "s>", "\n", "é", "a b", "<|im_end|>", "\\<", "n"]), max_size=12).map("".join)


@given(BITS)
@settings(max_examples=300, deadline=None)
def test_escape_is_reversible_and_hides_control_strings(t):
    assert op.unescape(op.escape(t)) == t
    assert not op.CONTROL.search(op.escape(t))
    assert op.parse(op._head(t) + op.escape(t) + op.CLOSE) == [(t, t)]


def brute(turns):
    turns = [(r or "", t or "") for _, r, t in sorted(turns, key=lambda x: (x[0], x[1] or "", x[2] or ""))]
    loss = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_windows_give_every_turn_back_and_each_target_once(spark):
    data = {
        1: [(0, "system", "be brief"), *[(i, "user" if i % 2 else "assistant", f"turn {i} " + "word " * (i * 7 % 40)) for i in range(1, 60)]],
        2: [(0, "user", None), (1, "assistant", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")],
        3: [(0, "assistant", "long " * 500), (1, "user", ""), (2, None, "x"), (3, "assistant", "y")],
        4: [(0, "system", "only")],
    }
    rows = [(c, t, r, x, "clash") for c, v in data.items() for t, r, x in v]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string")
    made = op.windows(df, budget=100, history_turns=3, history_tokens=40)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in op.digests(made).collect()}
    assert got == {c: brute(v) for c, v in data.items()}
    first = [r for r in made.collect() if r.conv_id == 1]
    assert len(first) > 3
    for r in first:
        turns = op.parse(r.text)
        assert turns[0] == ("system", "be brief") and r.first_fresh <= 4
        assert sum(op.tokens(t) for _, t in turns) <= 100 or len(turns) - r.first_fresh == 1
    assert op.digests(op.windows(df.limit(0))).count() == 0


def test_query(spark):
    rows = {r.conv_id: r for r in op.query(spark, "/root/testdata/sf0.001").collect()}
    source = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()
    want: dict = {-7: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for r in source:
        want.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in rows.items()} == {c: brute(v) for c, v in want.items()}


def test_null_and_large_ids(spark):
    big = 9007199254740993
    rows = [(big, 0, "user", "a"), (big, 1, "assistant", "b"), (None, 0, "user", "c"), (None, 1, "assistant", "d"), (big + 2, 0, "assistant", "e")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, loss string, first_fresh int")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in op.digests(op.windows(df)).collect()}
    assert got == {c: brute([r[1:] for r in rows if r[0] == c]) for c in (big, None, big + 2)}
