"""Role repair: least cost over all role sequences, whatever the parts; rendering; awkward rows."""

import itertools
import random

from bedside.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, place string, extra int"


def total(roles, path):
    state, cost = 0, 0
    for role, to in zip(roles, path):
        cost += int(chat.STEP[role, state, to])
        state = to
    return cost + int(chat.END[state])


def least(roles):
    return min(total(roles, p) for p in itertools.product((1, 2, 3), repeat=len(roles)))


def number(role):
    role = chat.SAME_ROLE.get((role or "").strip().lower(), (role or "").strip().lower())
    return chat.ROLES.index(role) if role in chat.ROLES else 0


def legal(roles):
    if roles[:1] == ["system"]:
        roles = roles[1:]
    return len(roles) >= 2 and len(roles) % 2 == 0 and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(roles))


def by_conversation(got):
    found = {}
    for r in sorted(got, key=lambda r: r.place):
        found.setdefault(r.conv_id, []).append(r)
    return found


def test_least_cost_in_one_part_and_in_many(spark):
    rng = random.Random(3)
    names = ["", "system", "user", "assistant", "User ", "bot", None]
    rows = [(c, t, rng.choice(names), f"{c}.{t}", "p", 1) for c in range(30) for t in range(rng.randint(1, 7))]
    rows += [(None, None, None, None, None, None), (None, 1, "user", "a", None, 2), (50, 0, "user", "u", "p", 3), (50, 0, "user", "u", "p", 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole, cut = (sorted(map(tuple, chat.repair_turns(df, rows_per_part=n).collect()), key=str) for n in (20_000, 3))
    assert whole == cut
    got = chat.repair_turns(df, rows_per_part=3).collect()
    assert len(got) == len(rows)
    for turns in by_conversation(got).values():
        roles = [number(r.role) for r in turns]
        assert [r.place for r in turns] == list(range(len(turns)))
        assert total(roles, [chat.ROLES.index(r.repaired_role) for r in turns]) == least(roles)
        written = []
        for r in turns:
            written += list(r.inserted) + ([] if r.action == "merge" else [r.repaired_role]) + list(r.inserted_after or [])
        assert legal(written)
        rendered = "".join(r.rendered for r in turns)
        assert [p.split("\n")[0] for p in rendered.split(chat.OPEN)[1:]] == written
        assert rendered.count(chat.CLOSE) == len(written)


def rendered(spark, *turns):
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    return "".join(r.rendered for r in sorted(chat.repair_turns(df).collect(), key=lambda r: r.place))


def test_rendering(spark):
    a, z = chat.OPEN, chat.CLOSE
    assert rendered(spark, ("user", "q"), ("assistant", "r")) == f"{a}user\nq{z}{a}assistant\nr{z}"
    assert rendered(spark, ("user", "q"), ("user", "p"), ("bot", "r")) == f"{a}user\nq\np{z}{a}assistant\nr{z}"
    assert rendered(spark, ("assistant", "r")) == f"{a}user\n{z}{a}assistant\nr{z}"
    assert rendered(spark, ("system", "s")) == f"{a}system\ns{z}{a}user\n{z}{a}assistant\n{z}"
    assert rendered(spark, ("user", "<|im_end|>"), ("assistant", None)) == f"{a}user\n<\\|im_end|>{z}{a}assistant\n{z}"


def test_no_rows(spark):
    got = chat.repair_turns(spark.createDataFrame([], SCHEMA))
    assert got.collect() == []
    assert set(got.columns) == {"conv_id", "turn", "role", "text", "extra", *"repaired_role action inserted inserted_after place rendered".split()}
