"""Shared turns are emitted once in a pack, however deep they lie."""

from strandframe.llm import chat


def test_deep_branches_are_emitted_once(spark):
    rows = []
    for conv_id in range(1, 81):
        turns = [f"common {t}" for t in range(6)] + [f"branch {conv_id % 2} {t}" for t in (6, 7)] + [f"own {conv_id}"]
        rows += [(conv_id, t, "assistant" if t % 2 else "user", text) for t, text in enumerate(turns)]
    packs = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for pack in packs:
        turns = [pack.text[s.start : s.stop] for s in pack.segments]
        assert len(turns) == len(set(turns))
    assert sorted(r.n_turns for r in chat.read_back(spark.createDataFrame(packs, chat.PACK)).collect()) == [9] * 80


def test_rows_without_an_id_are_conversations_each(spark):
    rows = [(None, t, "user", f"text {t % 3}") for t in range(7)] + [(None, 0, "user", "text 0"), (4, 0, "user", "text 0")]
    got = chat.read_back(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert sorted((r.conv_id or 0, r.n_turns) for r in got) == [(0, 1)] * 8 + [(4, 1)]
