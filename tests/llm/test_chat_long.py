"""Long conversations: blocks of prefixes say the same as whole prefixes, and a wrong statement of reach is found out."""

from __future__ import annotations

import time

import pytest

from plantpulse.llm import chat

TURNS = [("user" if i % 2 == 0 else "assistant", f"<|end|> text \\ {i}" * (i % 3)) for i in range(3 * chat.BLOCK + 7)]


def with_last(turns):
    """Each turn repeats the role of the one before: a reach of one."""
    return "<s>" + "".join(f"[{before}>{role}]{text}\n" for (before, _), (role, text) in zip([("", ""), *turns], turns))


def numbered(turns):
    """The place of a turn is written: no reach is enough."""
    return "".join(f"{i}:{role}:{text}\n" for i, (role, text) in enumerate(turns))


def shortened(turns):
    """Texts of all turns but the last ten are left out: history is rewritten."""
    return "".join(f"{role}:{text if len(turns) - i <= 10 else ''}\n" for i, (role, text) in enumerate(turns))


@pytest.mark.parametrize("template, written, reach", [
    (chat.render, chat.escape, 0), (chat.render, chat.escape, 5), (with_last, str, 1), (with_last, str, 0), (numbered, str, 0), (numbered, str, 3), (shortened, str, 0), (shortened, str, 12),
])
@pytest.mark.parametrize("n", [0, 1, chat.BLOCK, chat.BLOCK + 1, len(TURNS)])
def test_blocks_say_what_whole_prefixes_say(template, written, reach, n):
    whole = chat.locate(TURNS[:n], template, written)
    assert chat.locate(TURNS[:n], template, written, reach) == whole
    assert whole.output == template(TURNS[:n])


def test_time_grows_with_the_turns():
    def seconds(n):
        turns = [("assistant", f"text {i} of a turn" * 8) for i in range(n)]
        begun = time.process_time()
        assert len(chat.locate(turns, reach=0).places) == n
        return time.process_time() - begun

    seconds(200)
    assert seconds(6_400) < 30 * seconds(800)  # 64 times if it grew with the square


def test_hot_conversation_and_other_columns(spark):
    rows = [(None, i, "assistant", f"</s> {i}", i) for i in range(2_000)] + [(1, None, None, None, 0)] * 2
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted long")
    got = {r["conv"]: r for r in chat.read_back(chat.format_conversations(given)).collect()}
    assert got[None]["turns_sha256"] == chat.digest([(who, text) for _, _, who, text, _ in rows[:2_000]])
    assert got[None]["loss_chars"] == sum(len(r[3]) for r in rows[:2_000])
    assert got[1]["n_turns"] == 2 and got[1]["loss_chars"] == 0
