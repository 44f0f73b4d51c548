from __future__ import annotations

import random

from sieveworks.llm import lines

SCHEMA = "doc_id long, text string, n_lines string, lines string"


def brute(rows):
    order = sorted({(i is not None, i or 0, t) for i, t in rows if t is not None})
    seen, gone = set(), {}
    for has, i, t in order:
        parts = t.split("\n")
        for at in range(len(parts) - 2):
            window = tuple(parts[at:at + 3])
            if all(not x.strip(" ") for x in window):
                continue
            if window in seen:
                gone.setdefault((has, i, t), set()).update((at, at + 1, at + 2))
            seen.add(window)
    out = []
    for i, t in rows:
        parts = t.split("\n") if t is not None else []
        cut = gone.get((i is not None, i or 0, t), set())
        text = "\n".join(x for k, x in enumerate(parts) if k not in cut) if t is not None else None
        out.append((i, text, len(parts), len(cut)))
    return sorted(out, key=repr)


def run(session, rows):
    df = session.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    out = lines.remove_repeated_windows(df)
    assert "lines" in out.columns
    return sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in out.collect()), key=repr)


def test_against_brute_force(session):
    rng = random.Random(5)
    rows = []
    for i in range(120):
        parts = [rng.choice("abcdefg") for _ in range(rng.randint(0, 12))]
        rows.append((i, "\n".join(parts)))
    rows += [(200 + i, "s1\ns2\ns3\ns4\nown" + str(i)) for i in range(150)]   # a passage that many share
    assert run(session, rows) == brute(rows)


def test_odd_rows(session):
    rows = [(1, "a\nb\nc\nd"), (None, "a\nb\nc"), (2, None), (3, ""), (4, "\n\n\n\n\n"), (5, "\n\n\n\n\n"),
            (6, "x\nb\nc\nd\r\ny"), (7, "b\nc\nd\nb\nc\nd"), (7, "b\nc\nd\nb\nc\nd"), (8, "a\nb"), (9, "a\nb")]
    assert run(session, rows) == brute(rows)
    assert run(session, [(1, "long\n" * 5000 + "end"), (2, "long\nlong\nlong")]) == brute(
        [(1, "long\n" * 5000 + "end"), (2, "long\nlong\nlong")])
    assert lines.remove_repeated_windows(session.createDataFrame([], SCHEMA)).count() == 0


def test_main_path_is_native(session):
    df = session.createDataFrame([(1, "a\nb\nc", "x", "y")], SCHEMA)
    plan = lines.remove_repeated_windows(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
