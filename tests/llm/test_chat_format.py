import random
import re

import duckdb
import pytest

from millrace.llm.chat_format import OP9_SQL, link_quotations

COLUMNS = ["conv_id", "turn", "role", "text", "n_quotes", "reply_to", "thread_root", "depth", "formatted"]
THREAD = [
    (1, 0, "user", "How do I  open it?\nIt is stuck."),
    (1, 1, "assistant", "> how do i open it?\nTurn the key."),
    (1, 2, "user", "> Turn the key.\n>> How do I open it?\nWhich key?\n> It is stuck."),
    (1, 3, "assistant", ">> turn the key.\n> which key?\n\nThe red one."),
    (1, 4, "user", "> never said\nNothing known."),
    (2, 0, "user", "Which key?"),
    (2, 1, "user", "> The red one.\nOther conversation."),
]
ODD = [
    (None, 0, "user", "alone"), (None, 1, None, "> alone\n ok"), (3, None, "user", "> x"), (3, 1, "user", None), (3, 2, "user", ""),
    (3, 3, "user", ">"), (3, 4, "user", ">>> \n> > > deep"), (4, 0, "a", "hi"), (4, 0, "a", "hi"), (4, 1, "a", "> hi"), (4, 1, "a", "> hi"),
    (5, 0, "u", "ü Word\r\nline"), (5, 1, "u", "  > > ü word\r\n>line\nend  "),
]


def _brute(rows):
    def runs(text):
        out = []
        for line in (text or "").split("\n"):
            m = re.match(r"[ \t]*((?:>[ \t]*)+)", line)
            level, words = (m[1].count(">"), line[m.end() :]) if m else (0, line)
            if not out or out[-1][0] != level:
                out.append((level, []))
            out[-1][1].append(words)
        return out

    def norm(x):
        return " ".join(re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in x)))

    quoting = {c for c, _, _, t in rows if re.search(r"(?m)^[ \t]*>", t or "")}
    units = [(c, t, level, n) for c, t, _, x in rows if x is not None and c in quoting for level, ls in runs(x) for n in {norm(" ".join(ls)), *map(norm, ls)} if n]
    first = {}
    for c, t, level, n in units:
        if not level and t is not None:
            first[c, n] = min(t, first.get((c, n), t))
    reply = {}
    for c, t, level, n in units:
        if level and t is not None and first.get((c, n), t) < t:
            reply.setdefault((c, t), []).append((level, -len(n.split(" ")), -first[c, n]))
    reply = {k: -min(v)[2] for k, v in reply.items()}
    out = []
    for c, t, role, x in rows:
        to = root = reply.get((c, t))
        depth = 0 if to is None else 1
        while (c, root) in reply:
            root, depth = reply[c, root], depth + 1
        own = x
        if x is not None and re.search(r"(?m)^[ \t]*>", x):
            own = re.sub(r"(?m)^[ \t]*>.*(?:\n|$)", "", x).strip(" \t\r\n")
        n = sum(level > 0 and any(map(norm, ls)) for level, ls in runs(x)) if x is not None else 0
        out.append((c, t, role, own, n, to, t if root is None else root, depth, f"<|{role or ''}|>\n{own or ''}\n"))
    return out


def _random(seed):
    r, rows = random.Random(seed), []
    for t in range(60):
        own = [" ".join(r.choices(["a", "B", "c d"], k=r.randint(1, 3))) for _ in range(r.randint(1, 3))]
        old = [line for _, _, _, x in rows[-6:] for line in x.split("\n")]
        rows.append((r.choice([1, 2]), t, r.choice("ua"), "\n".join(r.sample([*own, *(f"> {x}" for x in r.sample(old, min(len(old), 2)))], k=min(3, len(own) + min(len(old), 2))))))
    return rows


@pytest.mark.parametrize("rows", [THREAD, ODD, _random(1), [], [(1, 0, "u", "no quotes"), (None, None, None, None)], [(1, t, "u", f"> m{t - 1}\nm{t}") for t in range(40)]])
def test_links_equal_brute_force_and_sql(spark, rows):
    table = spark.createDataFrame([(*x, "extra", 7) for x in rows], "conv_id bigint, turn bigint, role string, text string, formatted string, h int")
    key = lambda r: [(x is not None, x) if not isinstance(x, str) else (True, 0, x) for x in r]
    key = lambda r: repr(r)
    got = sorted((tuple(r) for r in link_quotations(table).select(COLUMNS).collect()), key=key)
    assert got == sorted(_brute(rows), key=key)
    c = duckdb.connect()
    c.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    if rows:
        c.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert sorted(c.execute(OP9_SQL).fetchall(), key=key) == got


def test_thread_is_in_reply_order(spark):
    table = spark.createDataFrame(THREAD, "conv_id bigint, turn bigint, role string, text string")
    got = {(r.conv_id, r.turn): (r.reply_to, r.thread_root, r.depth, r.text) for r in link_quotations(table).collect()}
    assert got[1, 1] == (0, 0, 1, "Turn the key.")
    assert got[1, 2] == (1, 0, 2, "Which key?")
    assert got[1, 3] == (2, 0, 3, "The red one.")
    assert got[1, 4][:3] == (None, 4, 0) and got[2, 1][:3] == (None, 1, 0)
