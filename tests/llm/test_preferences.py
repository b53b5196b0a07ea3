"""Preference pairs on literal conversations."""

from floorloom.llm import preferences

TURNS = "conv_id long, turn int, role string, text string"
ROWS = [
    (0, 0, "user", "hi"), (0, 1, "assistant", "hello"), (0, 2, "user", "more"), (0, 3, "assistant", "good"),
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "more"), (1, 3, "assistant", "bad"), (1, 4, "user", "why"),
    (2, 0, "user", "x"), (3, 0, "user", "x"),
    (4, 0, "user", None), (4, 1, None, "a"), (4, 1, None, "b"), (5, 0, "user", ""), (5, 1, None, "b"), (5, 1, None, "a"), (5, None, "system", "s"),
    (6, 0, "user", "alone"), (None, 0, "user", "n"),
]


def test_segments(spark):
    turns = spark.createDataFrame(ROWS, TURNS).repartition(3)
    rows = preferences.segments(turns, preferences.adjacent(turns)).collect()
    got = sorted((r["pair_id"], r["part"], r["turn"], r["content"], r["mask"], r["n_prefix"]) for r in rows)
    seg = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"
    assert [g for g in got if g[0] == 0] == sorted([
        (0, "prompt", 0, seg("user", "hi"), 0, 3), (0, "prompt", 1, seg("assistant", "hello"), 0, 3), (0, "prompt", 2, seg("user", "more"), 0, 3),
        (0, "chosen", 3, seg("assistant", "good"), 1, 3), (0, "rejected", 3, seg("assistant", "bad"), 1, 3), (0, "rejected", 4, seg("user", "why"), 0, 3),
    ])
    assert [g[1] for g in got if g[0] == 1] == ["prompt"]  # identical conversations
    assert {g[1] for g in got if g[0] == 2} == {"chosen", "rejected"} and {g[5] for g in got if g[0] == 2} == {0}  # a turn before all others differs
    assert {g[0] for g in got} == {0, 1, 2}


def test_paired(spark):
    turns = spark.createDataFrame([(*r, 0) for r in ROWS], TURNS + ", piece int")
    rows = {r["pair_id"]: r for r in preferences.paired(preferences.segments(turns, preferences.adjacent(turns))).collect() if r["piece"] == 0}
    assert rows[0]["prompt"].endswith("<|user|>\nmore<|end|>\n") and rows[0]["chosen"] == "<|assistant|>\ngood<|end|>\n"
    assert rows[0]["rejected_mask"] == "1:25,0:20" and len(rows[0]["rejected"]) == 45 and rows[1]["chosen"] == "" and rows[1]["chosen_mask"] == ""


def test_long_conversations_are_several_rows(spark):
    said = [(c, k, "assistant" if k % 2 else "user", f"t{k}" if k < 300 or c == 0 else f"other {k}") for c in (0, 1) for k in range(700)]
    turns = spark.createDataFrame(said, TURNS)
    rows = sorted(preferences.paired(preferences.segments(turns, preferences.adjacent(turns))).collect(), key=lambda r: r["piece"])
    assert [r["piece"] for r in rows] == [0, 1, 2] and {r["n_prefix"] for r in rows} == {300}
    seg = lambda k, t: f"<|{'assistant' if k % 2 else 'user'}|>\n{t}<|end|>\n"
    assert "".join(r["prompt"] for r in rows) == "".join(seg(k, f"t{k}") for k in range(300))
    assert "".join(r["rejected"] for r in rows) == "".join(seg(k, f"other {k}") for k in range(300, 700))


def test_no_turns(spark):
    turns = spark.createDataFrame([], TURNS)
    assert preferences.segments(turns, preferences.adjacent(turns)).count() == 0
