import re
from collections import defaultdict

from tidewire.llm.chat import link_quotations


def talk(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def plain(rows):
    """The same by loops over each conversation."""
    out = []
    byconv = defaultdict(list)
    for r in rows:
        byconv[r[0]].append(r)
    norm = lambda s: re.sub(r"\s+", " ", s.lower()).strip()
    for conv, ms in byconv.items():
        ms = sorted(ms, key=lambda m: m[1])
        parsed = []
        for _, turn, role, text in ms:
            lines = []
            for x in (text or "").replace("\r\n", "\n").split("\n"):
                m = re.match(r"[ \t]*(?:>[ \t]?)+", x)
                lines.append((m[0].count(">") if m else 0, x[m.end() :] if m else x))
            own = {norm(b) for lv, b in lines if lv == 0 and re.search(r"\w", b)}
            quoted = [(lv, norm(b)) for lv, b in lines if lv and re.search(r"\w", b)]
            least = min([lv for lv, _ in quoted], default=0)
            parsed.append((turn, own, {q for lv, q in quoted if lv == least}, len(quoted)))
        reply, root = {}, {}
        for i, (turn, _, quotes, _) in enumerate(parsed):
            votes = defaultdict(int)
            for q in quotes:
                who = [j for j in range(i) if q in parsed[j][1] and parsed[j][0] < turn]
                if who:
                    votes[max(who)] += 1
            if votes:
                reply[i] = max(votes, key=lambda j: (votes[j], j))
            root[i] = root[reply[i]] if i in reply else i
        order = sorted(range(len(parsed)), key=lambda i: (parsed[root[i]][0], parsed[i][0]))
        for at, i in enumerate(order, 1):
            out.append((conv, parsed[i][0], at, parsed[reply[i]][0] if i in reply else None, parsed[i][3]))
    return sorted(out)


ROWS = [
    (1, 0, "user", "How do I boil an egg?\nAnd rice?"),
    (1, 1, "assistant", "Boil water.\nWait six minutes."),
    (1, 2, "user", "Thanks!"),
    (1, 3, "user", "On Monday the cook wrote:\n> Boil   WATER.\n> > How do I boil an egg?\nHow much water?"),
    (1, 4, "user", "> And rice?\nNo answer to this?"),
    (1, 5, "assistant", "> How much water?\n> never said\nA litre."),
    (1, 6, "user", "Thanks!"),
    (1, 7, "user", "> Thanks!\nYou are welcome."),
    (2, 0, "user", "> quote of nothing\nonly this"),
    (2, 1, "user", ">"),
    (2, 2, "user", ">> >\n>> only this\nagain"),
]


def test_links_and_order(spark):
    got = link_quotations(talk(spark, ROWS)).collect()
    assert sorted((r.conv_id, r.turn, r.position, r.reply_to, r.n_quoted) for r in got) == plain(ROWS)
    by = {(r.conv_id, r.turn): r for r in got}
    assert by[1, 3].text == "How much water?" and by[1, 3].reply_to == 1
    assert by[1, 7].reply_to == 6 and by[1, 4].reply_to == 0
    assert by[1, 5].formatted == "<|assistant|>\nA litre.\n<|end|>\n"
    assert by[2, 2].reply_to == 0 and by[2, 2].text == "again"


def test_a_hot_conversation_with_a_common_line(spark):
    rows = [(9, t, "user", "> yes\nyes" if t % 3 else "yes") for t in range(2600)] + [(10, 0, "user", "yes")]
    got = link_quotations(talk(spark, rows)).collect()
    assert sorted((r.conv_id, r.turn, r.position, r.reply_to, r.n_quoted) for r in got) == plain(rows)


def test_nulls_repeats_and_nothing(spark):
    rows = [(None, None, None, None), (None, 1, "user", "a"), (3, None, "user", "b"), (3, None, "user", "b"), (3, 2, "user", "> b\nc"), (4, 0, "user", "")]
    frame = talk(spark, rows).selectExpr("*", "1 as row", "2 as position")
    got = sorted([(r.conv_id, r.turn, r.role, r.position, r.reply_to, r.text) for r in link_quotations(frame).collect()], key=str)
    assert len(got) == 6 and (3, 2, "user", 3, -1, "c") in got and (None, None, "unknown", 1, None, "") in got
    assert link_quotations(talk(spark, [])).count() == 0


def test_conversations_table(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table.collect()]
    got = link_quotations(table).collect()
    assert sorted((r.conv_id, r.turn, r.position, r.reply_to, r.n_quoted) for r in got) == plain(rows)
