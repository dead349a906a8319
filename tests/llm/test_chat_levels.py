from tests.llm.test_chat import talk
from tidewire.llm.chat import link_quotations

LONG = "The harbour office opens at nine in the morning and closes at four on every working day of the week."


def replies(spark, rows):
    return {(r.conv_id, r.turn): (r.reply_to, r.position) for r in link_quotations(talk(spark, rows)).collect()}


def test_deeper_levels_decide_where_the_first_has_none(spark):
    rows = [
        (1, 0, "user", "First question?"),
        (1, 1, "user", "Another thread."),
        (1, 2, "user", "> Lost answer.\n>> First question?\nI agree."),
        # Nobody wrote the passage; turn 2 of this conversation quotes it one level lower.
        (2, 0, "user", "Hello"),
        (2, 1, "user", "Other"),
        (2, 2, "user", "> Known from elsewhere.\nyes"),
        (2, 3, "user", "Between"),
        (2, 4, "user", "> gone\n>> Known from elsewhere."),
    ]
    got = replies(spark, rows)
    assert got[1, 2] == (0, 2) and got[1, 1] == (None, 3)
    assert got[2, 4] == (2, 4) and got[2, 2] == (None, 3)


def test_quotes_wrapped_anew(spark):
    words = LONG.split()
    wrapped = "\n".join("> " + " ".join(words[i : i + 7]) for i in range(0, len(words), 7))
    rows = [
        (1, 0, "user", LONG),
        (1, 1, "user", "Something else that is longer than a few words."),
        (1, 2, "user", f"On Monday the clerk wrote:\n{wrapped}\nThanks."),
        # Two short lines of one, a nested one, and words in another order.
        (2, 0, "user", "Come at noon"),
        (2, 1, "user", "x"),
        (2, 2, "user", "> come at\n> noon\nok"),
        (3, 0, "user", LONG),
        (3, 1, "user", "y"),
        (3, 2, "user", "> lost line\n" + wrapped.replace("> ", ">> ") + "\nok"),
        (4, 0, "user", LONG),
        (4, 1, "user", "> " + " ".join(words[::-1])),
    ]
    got = replies(spark, rows)
    assert got[1, 2] == (0, 2) and got[2, 2] == (0, 2) and got[3, 2] == (0, 2) and got[4, 1][0] is None
