"""Quotations that keep an introducing line, are rewrapped, or are a part of a line."""

from barloom.llm import quotes

MESSAGES = [
    (1, 0, "A", "A text here."), (1, 1, "B", "Reply of B.\nOn Mon A wrote:\n> A text here."),
    (1, 2, "C", "> Reply of B.\n> On Mon A wrote:\n>> A text here.\nC says."), (1, 3, "D", "> > B wrote:\n>>> A text here.\nD says."),
    (2, 0, "A", "First sentence here. Second one goes on. Third ends."), (2, 1, "B", "other talk"), (2, 2, "C", "> Second one goes on.\nYes"),
    (3, 0, "A", "aa bb cc dd ee\nff gg hh"), (3, 1, "B", "ee"), (3, 2, "C", "> bb cc dd\n> ee ff gg\nok"), (3, 3, "D", "> cc dd\nno"),
    (3, 4, "E", "> ee\nwhole before part"), (3, 5, "F", "> dd bb\nnowhere"), (3, 6, "G", "> cc dd ee ff gg hh ii\ntoo long"),
]


def test_parts_of_messages_link(spark):
    rows = spark.createDataFrame(MESSAGES, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.text, r.n_quoted, r.n_linked, r.reply_to, r.thread_turn, r.depth) for r in quotes.reply_order(rows).collect()}
    assert got[1, 1] == ("Reply of B.", 1, 1, 0, 0, 1)
    assert got[1, 2] == ("C says.", 2, 2, 1, 0, 2)
    assert got[1, 3] == ("D says.", 1, 1, 0, 0, 1)
    assert got[2, 2] == ("Yes", 1, 1, 0, 0, 1)
    assert got[3, 2] == ("ok", 1, 1, 0, 0, 1)
    assert got[3, 3] == ("no", 1, 1, 0, 0, 1)
    assert got[3, 4] == ("whole before part", 1, 1, 1, 0, 2)
    assert got[3, 5][1:4] == (1, 0, 4) and got[3, 6][1:4] == (1, 0, 5)
