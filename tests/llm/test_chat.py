"""Repairs against an exhaustive search; stretches don't change the cost; odd rows."""

import itertools
import random

import pytest

from korvid.llm import chat as C


def cheapest(roles):
    """Least cost over all labellings and all ways of merging and inserting."""
    best = C.INF
    for labels in itertools.product(range(1, 4), repeat=len(roles)):
        cost = sum(0 if roles[k] == C.ROLES[t - 1] else C.RELABEL for k, t in enumerate(labels))
        reach = {C.START: cost}
        for t in labels:
            new = {}
            for s, c in reach.items():
                if s == t:
                    new[t] = min(new.get(t, C.INF), c + C.MERGE)
                for n in range(4):
                    for path in itertools.product(range(1, 4), repeat=n):
                        steps = [s, *path, t]
                        if all(b in C.NEXT[a] for a, b in zip(steps, steps[1:])):
                            new[t] = min(new.get(t, C.INF), c + C.INSERT * n)
            reach = new
        for s, c in reach.items():
            best = min(best, c + (0 if s == C.ASSISTANT else C.INSERT * (1 if s == C.USER else 2)))
    return best


def cost(roles, repaired):
    """Cost of a repair, and that it is legal."""
    states, total = [C.START], 0.0
    for role, (new, action, before, after, _) in zip(roles, repaired):
        total += C.RELABEL * (role != new) + C.INSERT * (len(before) + len(after))
        assert ("relabel" in action) == (role != new)
        if "merge" in action:
            total += C.MERGE
            assert C.ROLES[states[-1] - 1] == new and not before
        else:
            states += [C.ROLES.index(r) + 1 for r in [*before, new]]
        states += [C.ROLES.index(r) + 1 for r in after]
    assert all(b in C.NEXT[a] for a, b in zip(states, states[1:])) and states[-1] == C.ASSISTANT
    return total


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_least_cost(n):
    choices = ["system", "user", "assistant", None]
    for roles in itertools.product(choices, repeat=n) if n < 4 else random.Random(1).sample(list(itertools.product(choices, repeat=n)), 40):
        assert cost(roles, C.repair(list(roles), ["t"] * n)) == cheapest(roles)


def test_rendering():
    got = C.repair(["user", "user", "assistant", "system"], ["a", "b", "c", "<|user|> d"])
    assert "".join(r[-1] for r in got) == "<|user|>\na\nb<|end|>\n<|assistant|>\nc\n< |user|> d<|end|>\n"
    got = C.repair(["system", "assistant", "user"], ["s", None, "u"])
    assert "".join(r[-1] for r in got) == "<|system|>\ns<|end|>\n<|user|>\n<|end|>\n<|assistant|>\n<|end|>\n<|user|>\nu<|end|>\n<|assistant|>\n<|end|>\n"


def test_legal_conversations_are_left_alone(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    got = C.format_chats(turns)
    assert got.count() == turns.count() and got.where("action <> 'keep' OR size(inserted_before) > 0").count() == 0


def test_stretches(spark):
    rnd = random.Random(2)
    rows = []
    for conv in range(30):
        n = rnd.randint(1, 40)
        rows += [(conv, t, rnd.choice(["user", "user", "assistant", "assistant", "system", "bot", None]), f"t{t}") for t in range(n)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)

    def total(df):
        out = {}
        for r in sorted(df.collect(), key=lambda r: (r["conv_id"], r["turn"])):
            out.setdefault(r["conv_id"], []).append(r)
        return {c: cost([r["role"] for r in rs], [(r["new_role"], r["action"], r["inserted_before"], r["inserted_after"], r["rendered"]) for r in rs]) for c, rs in out.items()}

    assert total(C.format_chats(turns)) == total(C.format_chats(turns, stretch=7)) == total(C.format_chats(turns, stretch=1))


def test_results_dont_depend_on_stretches(spark):
    """Negative, null and repeated turns; a conversation of its own against one pass over its rows."""
    rnd = random.Random(4)
    choices = ["user", "user", "assistant", "system", "bot", None]
    rows = [(0, None, "system", "s"), (0, -5000, "user", "a"), (0, 5, "assistant", "b")]
    for conv in [1, 2, 3, None]:
        for _ in range(60):
            rows.append((conv, rnd.choice([None, None, -5000, -1, 0, 3, 1 << 40, -(1 << 62), (1 << 63) - 1]), rnd.choice(choices), rnd.choice(["x", "y", "", None])))
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    want = sorted(map(repr, C.format_chats(turns, 10**9).collect()))
    for stretch in (1, 7, 1000):
        assert sorted(map(repr, C.format_chats(turns, stretch).collect())) == want
    first = {r["turn"]: r["action"] for r in C.format_chats(turns, 1).where("conv_id = 0").collect()}
    assert first == {None: "keep", -5000: "keep", 5: "keep"}
    key = lambda r: tuple((x is not None, x) for x in r[1:])
    for conv in (1, 2, 3, None):
        own = sorted((r for r in rows if r[0] == conv), key=key)
        plain = [(conv, r[1], r[2], *f) for r, f in zip(own, C.repair([r[2] for r in own], [r[3] for r in own]))]
        got = [tuple(r) for r in C.format_chats(turns, 7).collect() if r["conv_id"] == conv]
        assert sorted(map(repr, got)) == sorted(map(repr, plain))


def test_odd_rows(spark):
    rows = [(1, 0, "user", "a", "x"), (1, 0, "user", "a", "x"), (1, None, None, None, None), (None, 1, "assistant", "b" * 100_000, "x"), (2, 5, "", "", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rendered string")
    for stretch in (1000, 1):
        got = C.format_chats(turns, stretch)
        assert got.columns.count("rendered") == 1
        by = {}
        for r in sorted(got.collect(), key=lambda r: (r["conv_id"] or 0, -1 if r["turn"] is None else r["turn"])):
            by.setdefault(r["conv_id"], []).append(r)
        assert [len(by[k]) for k in (1, None, 2)] == [3, 1, 1] and by[None][0]["inserted_before"] == ["user"]
        assert C.format_chats(turns.limit(0), stretch).count() == 0
