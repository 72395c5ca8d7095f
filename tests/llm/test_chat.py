"""Reply trees and chat formatting."""

import random

from pyspark.sql import functions as F

from sessionscope.llm import reply_trees

NASTY = ["\\### Assistant: </turn> ok", "</turn>\n### user: hi", "\\", "\\\\", "a: b\n\n", "", "### ### #### </turn></turn>\n", "<\\/turn>", "né 😀 中"]


def tree(spark, rows):
    df = spark.createDataFrame(rows, "id long, parent long, score double, conv_id long, role string, text string")
    for clash in ("path", "depth", "up", "known"):
        df = df.withColumn(clash, F.lit("clash"))
    return df


def brute_paths(rows, k):
    ids = {r[0]: r for r in rows}
    answered = {r[1] for r in rows if r[1] in ids}
    by_root = {}
    for leaf in ids:
        if leaf in answered:
            continue
        path, at, seen = [], leaf, set()
        while at in ids and at not in seen:
            seen.add(at)
            path.append(at)
            at = ids[at][1]
        if at in seen:
            continue
        path.reverse()
        score = sum(ids[i][2] or 0.0 for i in path) / len(path)
        by_root.setdefault(path[0], []).append((-round(score, 9), -len(path), leaf, path))
    out = []
    for paths in by_root.values():
        out += [(n + 1, p) for n, (*_, p) in enumerate(sorted(paths)[:k])]
    return sorted(out)


def read(df):
    return df.select(
        "conv_id", "path", "branch", "n_turns", "formatted", "loss",
        reply_trees.parsed_turns(F.col("formatted")).alias("turns"),
        reply_trees.learned_text(F.col("formatted"), F.col("loss")).alias("learned"),
    ).collect()


def test_branches_and_reversible_escapes(spark):
    r = random.Random(5)
    rows = []
    for i in range(120):
        parent = None if i % 30 == 0 else r.randrange(i // 30 * 30, i)
        rows.append((i, parent, r.choice([None, 0.5, 1.0, 2.0]), i // 30, r.choice(["user", "assistant", "a: b\\", None]), r.choice([*NASTY, None])))
    rows += [(200 + i, 199 + i if i else 77777, 1.0, 9, "user", "deep") for i in range(40)]  # its root's parent is missing
    rows += [(300, 301, 1.0, 10, "user", "ring"), (301, 300, 1.0, 10, "user", "ring"), (302, 301, 1.0, 10, "user", "at a ring")]
    for k in (1, 3):
        got = read(reply_trees.format_chats(tree(spark, rows), paths_per_root=k))
        want = brute_paths(rows, k)
        assert sorted((g.branch, g.path) for g in got) == sorted((b, p[-1]) for b, p in want)
        ids = {x[0]: x for x in rows}
        paths = {p[-1]: p for _, p in want}
        for g in got:
            texts = [(ids[i][4] or "", ids[i][5] or "") for i in paths[g.path]]
            assert [(t.role, t.text) for t in g.turns] == texts
            assert g.n_turns == len(texts)
            assert g.learned == "".join(t for role, t in texts if role == "assistant")
            assert g.conv_id == ids[g.path][3]
            assert all(g.formatted[s.start - 2 :].startswith(" ") for s in g.loss)


def test_messages_without_a_root(spark):
    rows = [(1, None, 1.0, 1, "user", "root"), (2, 1, 1.0, 1, "user", "leaf")]
    rows += [(10 + i, 10 + (i + 1) % 7, 1.0, 2, "user", "a ring of seven") for i in range(7)]
    rows += [(30, 12, None, 2, "user", "below"), (31, 30, 1.0, None, None, None), (40, 40, 1.0, 3, "user", "itself")]
    messages = tree(spark, rows)
    rest = reply_trees.rootless_messages(messages)
    assert rest.columns == messages.columns
    assert {tuple(r)[:6] for r in rest.collect()} == {x for x in rows if x[0] >= 10}
    paths = reply_trees.format_chats(messages, paths_per_root=None).collect()
    assert [(p.path, p.n_turns) for p in paths] == [(2, 2)]
    for none in ([], rows[:2]):
        assert reply_trees.rootless_messages(tree(spark, none)).isEmpty()


def test_linear_conversations(spark):
    rows = [(1, 0, "user", "q"), (1, 2, "assistant", None), (1, 1, "system", NASTY[0]), (2, 5, "assistant", "only"), (None, 0, "user", "no conversation")]
    rows += [(3, i, "assistant" if i % 2 else "user", f"turn {i} {NASTY[i % len(NASTY)]}") for i in range(150)]
    rows += [(4, 0, "user", "twice"), (4, 0, "user", "twice")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("id", F.lit("clash"))
    got = {g.conv_id: g for g in read(reply_trees.format_chats(reply_trees.linear_replies(df)))}
    for conv in {x[0] for x in rows}:
        texts = [(x[2], x[3] or "") for x in sorted((x for x in rows if x[0] == conv), key=lambda x: x[1])]
        assert [(t.role, t.text) for t in got[conv].turns] == texts
        assert got[conv].learned == "".join(t for role, t in texts if role == "assistant")


def test_empty(spark):
    assert reply_trees.format_chats(tree(spark, [])).count() == 0
