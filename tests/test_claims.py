"""Updates and renames that take effect one after the other, against a plain loop."""

import random

import pytest

from answerlens.operators import claims
from answerlens.operators import dimensions as dims
from tests.test_maintenance import batch, brands, prompts, reasons, state


def plain_updates(entries, updates):
    rows, why = {i: (t, s) for i, t, s in entries}, {}
    for seq, (target, text, stage) in enumerate(updates):
        clean, key = text.strip(), text.strip().lower()
        if any(i != target and t.strip().lower() == key for i, (t, _) in rows.items()):
            why[seq] = "duplicate"
        elif target not in rows:
            why[seq] = "not_found"
        else:
            rows[target] = (clean, stage)
    return sorted((i, t, s) for i, (t, s) in rows.items()), why


def plain_renames(names, renames):
    names, why = list(names), {}
    for seq, (old, new) in enumerate(renames):
        a, b = old.strip().lower(), new.strip().lower()
        held = {n.strip().lower() for n in names}
        if not b:
            why[seq] = "empty_name"
        elif a not in held:
            why[seq] = "not_found"
        elif b != a and b in held:
            why[seq] = "duplicate"
        else:
            names = [new.strip() if n.strip().lower() == a else n for n in names]
    return list(enumerate(names)), why


@pytest.fixture(params=[0, claims.FEW], ids=["rounds", "few"])
def few(request, monkeypatch):
    """Both ways of settling."""
    for f in (claims.settle_claims, claims.settle_renames):
        monkeypatch.setattr(f, "__defaults__", (request.param,))


def test_a_later_update_replaces_a_rejected_one(spark):
    existing = prompts(spark, (1, "one", "research"), (2, "two", "research"))
    change = dims.update_prompts(existing, batch(spark, [(1, "TWO", "research"), (1, "new", "comparison")], "id long, text string, stage string"))
    assert state(change.result) == [(1, "new", "comparison"), (2, "two", "research")]
    assert reasons(change) == {0: "duplicate"}


def test_freed_texts_may_be_taken(spark, few):
    existing = prompts(spark, (1, "a", "research"), (2, "b", "research"))
    change = dims.update_prompts(existing, batch(spark, [(1, "c", "research"), (2, "a", "research"), (1, "b", "research")], "id long, text string, stage string"))
    assert state(change.result) == [(1, "b", "research"), (2, "a", "research")] and reasons(change) == {}


def test_freed_names_may_be_taken(spark, few):
    change = dims.rename_brands(brands(spark, "a", "b"), batch(spark, [("a", "c"), ("b", "a"), ("c", "B")], "old_name string, new_name string"))
    assert state(change.result) == [(0, "B"), (1, "a")] and reasons(change) == {}


def test_updates_equal_a_loop(spark, few):
    rng = random.Random(7)
    for trial in (0, 1, 3):
        texts = [f"t{i}" for i in range(rng.choice([4, 10]))]
        entries = [(i, rng.choice(texts) if trial == 3 else f"t{i}", "research") for i in range(rng.choice([3, 8]))]
        spell = lambda t: rng.choice([t, t.upper(), f" {t} "])
        ids = [0] * 6 + list(range(-1, 8)) if trial % 2 else list(range(-1, 8))
        updates = [(rng.choice(ids), spell(rng.choice(texts)), rng.choice(["research", "comparison"])) for _ in range(24)]
        change = dims.update_prompts(prompts(spark, *entries), batch(spark, updates, "id long, text string, stage string"))
        want, why = plain_updates(entries, updates)
        assert state(change.result) == want and reasons(change) == why


def test_renames_equal_a_loop(spark, few):
    rng = random.Random(8)
    for trial in range(2):
        names = [f"n{i}" for i in range(rng.choice([3, 7]))]
        held = [rng.choice(names) for _ in range(4)]
        spell = lambda t: rng.choice([t, t.upper(), f" {t} "])
        common = names + names[:1] * 5 if trial % 2 else names
        renames = [(spell(rng.choice(common)), rng.choice([" ", *map(spell, common)])) for _ in range(24)]
        change = dims.rename_brands(brands(spark, *held), batch(spark, renames, "old_name string, new_name string"))
        want, why = plain_renames(held, renames)
        assert state(change.result) == want and reasons(change) == why


def test_empty_batches_and_dimensions(spark, few):
    none = batch(spark, [], "id long, text string, stage string")
    assert state(dims.update_prompts(prompts(spark, (1, "a", "research")), none).result) == [(1, "a", "research")]
    one = batch(spark, [(1, "x", "research"), (2, "x", "research")], "id long, text string, stage string")
    assert reasons(dims.update_prompts(prompts(spark), one)) == {0: "not_found", 1: "not_found"}
    assert reasons(dims.rename_brands(brands(spark), batch(spark, [("a", "b"), ("b", "b")], "old_name string, new_name string"))) == {0: "not_found", 1: "not_found"}
