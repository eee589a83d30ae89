import random
import re

from friction.llm.quotes import link_conversations, passages

M = "conv_id long, turn long, role string, text string, run string, unit string, level string, mid string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, None, None, None) for r in rows], M)


ROWS = [
    (1, 0, "user", "How do I pack bins?\n\nI tried first fit."),
    (1, 1, "assistant", "On Monday user wrote:\n> I tried  first FIT.\nUse best fit."),
    (1, 2, "user", "assistant wrote:\n> Use best fit.\n>> I tried first fit.\nThanks"),
    (1, 3, "other", "> How do I pack bins?\nSame question"),
    (1, 4, "other", "> never said\nhello"),
    (2, 0, "user", "Use best fit."),
    (2, 1, "user", None),
    (2, 2, "user", ""),
    (2, 3, "user", "> Use best fit."),
    (None, 1, "user", "> Use best fit.\nx"),
    (1, 1, "assistant", "On Monday user wrote:\n> I tried  first FIT.\nUse best fit."),
]


def test_links_threads_and_own_text(spark):
    got = sorted((tuple(r) for r in link_conversations(frame(spark, ROWS)).collect()), key=str)
    want = [
        (1, 0, "user", "How do I pack bins?\n\nI tried first fit.", 0, None, 0, 0, 0),
        (1, 1, "assistant", "Use best fit.", 1, 0, 0, 1, 1),
        (1, 1, "assistant", "Use best fit.", 1, 0, 0, 1, 1),
        (1, 2, "user", "Thanks", 2, 1, 0, 2, 2),
        (1, 3, "other", "Same question", 1, 0, 0, 1, 3),
        (1, 4, "other", "hello", 1, None, 4, 0, 0),
        (2, 0, "user", "Use best fit.", 0, None, 0, 0, 0),
        (2, 1, "user", None, 0, None, 1, 0, 0),
        (2, 2, "user", "", 0, None, 2, 0, 0),
        (2, 3, "user", "", 1, 0, 0, 1, 1),
        (None, 1, "user", "x", 1, None, 1, 0, 0),
    ]
    assert got == sorted(want, key=str)


def test_passages_by_level(spark):
    got = {(r.turn, r.level, r.body) for r in passages(frame(spark, ROWS[2:3])).collect()}
    assert got == {(2, 1, "Use best fit."), (2, 2, "I tried first fit."), (2, 0, ""), (2, 0, "Thanks")}


def test_a_long_chain_and_a_common_first_turn(spark):
    rows = [(c, 0, "user", "hello all") for c in range(50)] + [(c, 1, "a", "> hello all\nyes") for c in range(50)]
    rows += [(99, 0, "u", "m0")] + [(99, i, "u", f"> m{i - 1}\nm{i}") for i in range(1, 40)]
    got = {(r.conv_id, r.turn): r for r in link_conversations(frame(spark, rows)).collect()}
    assert all(got[c, 1].parent_turn == 0 for c in range(50))
    assert all((got[99, i].depth, got[99, i].thread_turn, got[99, i].own_text) == (i, 0, f"m{i}") for i in range(40))


def test_empty_and_long(spark):
    assert link_conversations(frame(spark, [])).count() == 0
    rows = [(1, 0, "u", "line\n" * 30_000), (1, 1, "u", "> line\n" * 30_000 + "so")]
    got = {r.turn: r for r in link_conversations(frame(spark, rows)).collect()}
    assert got[1].parent_turn == 0 and got[1].own_text == "so"


def slow(rows):
    """Message by message, line by line."""
    def parsed(text):
        lines = re.split(r"\r?\n", text)
        level = [m.group(0).count(">") if (m := re.match(r"(?:[ \t]*>)+", x)) else 0 for x in lines]
        runs = []
        for i, (x, n) in enumerate(zip(lines, level)):
            if i == 0 or level[i - 1] != n:
                runs.append((n, []))
            if not (n == 0 and re.search(r"(?i)\bwrote:\s*$", x) and i + 1 < len(lines) and level[i + 1] > 0):
                runs[-1][1].append(re.sub(r"^(?:[ \t]*>)+ ?", "", x))
        return [(n, "\n".join(x)) for n, x in runs]

    def normal(t):
        return re.sub(r"\s+", " ", t).strip(" ").lower()

    def units(t):
        return {normal(u) for u in [t, *re.split(r"\n[ \t]*\n", t), *t.split("\n")]} - {""}

    quoting = {k: parsed(t) for *k, _, t in [(c, n, r, t) for c, n, r, t in rows] if t and re.search(r"(?m)^[ \t]*>", t) for k in [tuple(k)]}
    own = {(c, n): t if (c, n) not in quoting else "\n".join(b for k, b in quoting[c, n] if k == 0).strip() for c, n, _, t in rows}
    first = {}
    for (c, n), t in sorted(own.items()):
        for u in units(t or ""):
            first.setdefault((c, u), n)
    parent = {}
    for (c, n), runs in quoting.items():
        links = []
        for level, body in runs:
            found = [(len(u), -first[c, u]) for u in units(body) if level and first.get((c, u), n) < n]
            if found:
                links.append((-level, -max(found)[1]))
        if links:
            parent[c, n] = max(links)[1]
    out = []
    for c, n, role, _ in rows:
        at, depth = n, 0
        while (c, at) in parent:
            at, depth = parent[c, at], depth + 1
        order = sum(1 for d, m in parent if d == c and m <= n and root(parent, c, m) == at) if depth else 0
        out.append((c, n, role, own[c, n], max((k for k, _ in quoting.get((c, n), [])), default=0), parent.get((c, n)), at, depth, order))
    return sorted(out, key=str)


def root(parent, c, n):
    while (c, n) in parent:
        n = parent[c, n]
    return n


def threads_of(rnd, conv, turns):
    """Messages that quote earlier ones: whole with their own quotes one level deeper, a paragraph, a line, or nothing known."""
    rows, texts = [], []
    for n in range(turns):
        own = [" ".join(rnd.choices("pack the bins best fit first long short tokens".split(), k=rnd.randint(1, 4))) for _ in range(rnd.randint(0, 3))]
        lines = []
        for _ in range(rnd.randint(0, 2) if texts else 0):
            t = rnd.choice(texts)
            t = rnd.choice([t, rnd.choice(t.split("\n")), t.upper(), "never said this"])
            if rnd.random() < 0.5:
                lines.append(rnd.choice(["On Monday x wrote:", "x WROTE: "]))
            lines += [rnd.choice(["> ", ">", " > "]) + x for x in t.split("\n")]
            lines += rnd.choice([[], [""], ["a word between"]])
        lines = lines + own if rnd.random() < 0.8 else own + lines
        texts.append(rnd.choice(["\n", "\n\n"]).join(lines) if rnd.random() < 0.3 else "\n".join(lines))
        rows.append((conv, n, rnd.choice(["user", "assistant"]), texts[-1]))
    return rows


def test_generated_threads_against_a_slow_version(spark):
    """One conversation holds a third of all messages."""
    rnd = random.Random(8)
    rows = [r for c in range(40) for r in threads_of(rnd, c, rnd.randint(1, 9))]
    rows += threads_of(rnd, 99, len(rows) // 2)
    got = sorted((tuple(r) for r in link_conversations(frame(spark, rows)).collect()), key=str)
    want = slow(rows)
    assert sum(r[5] is not None for r in want) > 60 and max(r[7] for r in want) > 3
    assert got == want
