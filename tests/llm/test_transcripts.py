import random

import numpy as np

from ferrule.llm import transcripts as t


def model():
    rng = np.random.default_rng(1)
    draw = lambda *s: rng.integers(1, 50, s).astype(float)
    return t.Model(draw(t.STATES), draw(t.STATES, t.STATES), draw(t.STATES, len(t.KINDS)), draw(t.STATES, t.SHAPES))


def score(m, e, path):
    return m.start[path[0]] + e[0, path[0]] + sum(m.moves[a, b] + e[i, b] for i, (a, b) in enumerate(zip(path, path[1:]), 1))


def test_path_is_the_best_of_all():
    m, rng = model(), np.random.default_rng(2)
    e = rng.normal(size=(5, t.STATES))
    every = np.stack(np.meshgrid(*[range(t.STATES)] * 5), -1).reshape(-1, 5)
    best = max(score(m, e, p) for p in every)
    last = int(m.from_start(e)[0].argmax())
    assert np.isclose(score(m, e, m.path(e, -1, last)), best)


def test_blocks_give_the_path_of_the_whole(spark, monkeypatch):
    rng = random.Random(3)
    lines = [rng.choice(["User: hi", "A: " + "long " * 50, "what?", "- item", "x", "[sys]: be kind", ""]) for _ in range(400)]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "conv_id long, turn long, text string")
    m = model()
    got = sorted(t.parsed(t.blocks(df), m).collect(), key=lambda r: r.block)
    assert len(got) == 7
    e = m.emissions([t.observed(x, i == 0) for i, x in enumerate(lines)])
    whole = m.path(e, -1, int(m.from_start(e)[0].argmax()))
    states = [2 * t.ROLES.index(r) + (not b) for g in got for r, b in zip(g.roles, g.begins)]
    assert np.isclose(score(m, e, states), score(m, e, whole))


def test_roles_are_recovered(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    out = t.parse_conversations(df).collect()
    lines, right = sum(r.n_lines for r in out), sum(r.n_right for r in out)
    assert right / lines > 0.9, right / lines


def test_held_out_accuracy_with_markers(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    raw = t.raw_transcripts(df)
    m = t.fit(t.blocks(raw.filter("conv_id % 2 = 0"), role_col="role"))
    rest = raw.filter("conv_id % 2 = 1 and pmod(xxhash64(conv_id), 4) < 2")
    got = {(r.conv, r.block): r for r in t.parsed(t.blocks(rest), m).collect()}
    right = total = 0
    for p in t.blocks(rest, role_col="role").collect():
        truth = [i.role for i in p["items"] for _ in i.text.split("\n")]
        roles = got[p.conv, p.block].roles
        right += sum(a == b for a, b in zip(truth, roles, strict=True))
        total += len(truth)
    assert right / total > 0.97, right / total


def test_rendering_and_odd_rows(spark):
    rows = [(1, 0, "user", "hi\nthere"), (1, 1, "assistant", "yes"), (1, 1, "assistant", "yes"), (None, None, None, None), (2, None, "USER", ""), (2, 0, "robot", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("block", t.F.lit("clash"))
    out = t.parse_conversations(df).collect()
    assert sorted((r.conv_id or 0, r.n_lines) for r in out) == [(0, 1), (1, 3), (2, 1), (2, 1)]
    decoded = spark.createDataFrame([(1, 0, ["user", "user", "assistant"], [True, False, True], ["hi", "there", "yes"])], "conv long, block long, roles array<string>, begins array<boolean>, lines array<string>")
    assert t.rendered(decoded).collect()[0].text == "<|user|>\nhi\nthere\n<|assistant|>\nyes"
    assert t.parse_conversations(df.limit(0)).count() == 0


def test_rows_without_a_turn_all_stay_in_bounded_blocks(spark):
    rows = [(1, 0, "user", "hi"), *[(1, None, "assistant", "ok")] * 200, *[(1, None, "user", f"t{i}") for i in range(100)], *[(None, None, "user", "ok")] * 70, (2, 3, "user", "x"), (2, 3, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    held = t.blocks(df, role_col="role").collect()
    assert max(len(b["items"]) for b in held) <= t.BLOCK
    inside = lambda conv: [i.text for b in sorted(held, key=lambda b: b.block) if b.conv == conv for i in b["items"]]
    assert inside(1) == ["hi", *["ok"] * 200, *sorted(f"t{i}" for i in range(100))]
    assert inside(None) == ["ok"] * 70 and inside(2) == ["x"]
    assert sum(r.n_lines for r in t.parse_conversations(df).collect()) == 1 + 200 + 100 + 70 + 1
