"""Quotation linking against brute force over made-up threads."""

import random
import re

from barloom.llm import quotes

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron pi".split()


def plain(text):
    return " ".join(re.sub("[A-Z]", lambda m: m[0].lower(), text).split(" ")).strip()


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text)).strip(" ")


def thread(rng, conv, n):
    """Messages with nested quotations of lines of earlier ones, some of them rewrapped or cut."""
    out = []
    for turn in range(n):
        lines = []
        if turn and rng.random() < 0.7:
            own = [x for x in out[rng.randrange(turn)][3].split("\n")]
            a = rng.randrange(len(own))
            some = own[a : a + rng.randrange(1, 4)]
            if rng.random() < 0.2:
                some = [" ".join(" ".join(some).split()[:5])] if not any(x.startswith(">") for x in some) else some
            lines += ([f"On day {turn} X wrote:"] if rng.random() < 0.3 else []) + [">" + ("" if x.startswith(">") else " ") + x for x in some]
        lines += [" ".join(rng.choices(WORDS, k=rng.randrange(2, 9))) for _ in range(rng.randrange(1, 5))]
        out.append((conv, turn * rng.choice((1, 1)), "u", "\n".join(lines)))
    return out


def model(rows):
    parsed = {}
    for conv, turn, _, text in rows:
        lines = []
        for raw in re.split("\r\n?|\n", text):
            mark = re.match(r"(?:[\x20\x09]*>)+", raw)
            lines.append((mark[0].count(">") if mark else 0, raw[mark.end() :] if mark else raw))
        lines = [x for i, x in enumerate(lines) if not (x[1].rstrip(" ").endswith("wrote:") and i + 1 < len(lines) and lines[i + 1][0] > x[0])]
        runs = []
        for level, body in lines:
            if runs and runs[-1][0] == level:
                runs[-1][1].append(body)
            else:
                runs.append((level, [body]))
        own = [b for level, b in lines if level == 0]
        quoted = [(level, norm(" ".join(b))) for level, b in runs if level]
        parsed[conv, turn] = own, [(level, t) for level, t in quoted if t]
    out = {}
    for (conv, turn), (own, passages) in parsed.items():
        before = sorted(t for c, t in parsed if c == conv and t < turn)
        best, n = None, 0
        seen = set()
        for level, text in passages:
            if (level, text) in seen:
                continue
            seen.add((level, text))
            exact, inside = None, None
            for t in before:
                mine = [norm(x) for x in parsed[conv, t][0]]
                mine = [x for x in mine if x]
                spans = {" ".join(mine[i:j]) for i in range(len(mine)) for j in range(i + 1, len(mine) + 1)}
                if text in spans:
                    exact = t
                if f" {text} " in f" {' '.join(mine)} ":
                    inside = t
            found = exact if exact is not None else inside
            if found is not None:
                n += 1
                best = max(best or (-level, found), (-level, found))
        out[conv, turn] = (best[1] if best else before[-1] if before else None), n
    places = {}
    for conv in {c for c, _ in out}:
        children = {}
        for (c, t), (parent, _) in sorted(out.items()):
            if c == conv:
                children.setdefault(parent, []).append(t)
        walk = [iter(children.get(None, []))]
        while walk:
            t = next(walk[-1], None)
            if t is None:
                walk.pop()
            else:
                places[conv, t] = sum(c == conv for c, _ in places)
                walk.append(iter(children.get(t, [])))
    return {k: (*v, places[k]) for k, v in out.items()}


def test_threads(spark):
    rng = random.Random(12)
    rows = [m for conv in range(12) for m in thread(rng, conv, rng.randrange(1, 14))]
    found = quotes.reply_order(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, place int"))
    got = {(r.conv_id, r.turn): (r.reply_to, r.n_linked, r.place) for r in found.collect()}
    want = model(rows)
    assert got == want
    assert sum(n for _, n, _ in want.values()) > 20


def test_long_messages(spark):
    long = "\n".join(f"line number {i} of it" for i in range(20_000))
    rows = [(1, 0, "u", long), (1, 1, "u", "other"), (1, 2, "u", "\n".join("> " + x for x in long.split("\n")[100:15_000]) + "\nok")]
    got = {r.turn: (r.text if r.turn else None, r.reply_to, r.n_linked) for r in quotes.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {0: (None, None, 0), 1: ("other", 0, 0), 2: ("ok", 0, 1)}
