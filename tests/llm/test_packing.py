import random
from collections import Counter, defaultdict

import pytest

from statelake.llm.packing import pack, plan_containers, slot_table


def check_plan(histogram, capacity):
    classes = plan_containers(histogram, capacity)
    held = Counter()
    for count, content in classes:
        assert count > 0 and 0 < sum(n * k for n, k in content.items()) <= capacity
        for length, k in content.items():
            held[length] += count * k
    slots = slot_table(classes)
    planned = defaultdict(int)
    for s in slots:
        assert s.start == planned[s.length] and (s.stop - s.start) % s.per == 0
        planned[s.length] = s.stop
    assert held == Counter({k: v for k, v in histogram.items() if v}) == Counter(planned)
    return sum(c for c, _ in classes)


@pytest.mark.parametrize("seed", range(8))
def test_plans_are_complete_and_tight(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 64, 256])
    histogram = Counter(rng.randrange(1, capacity + 1) if rng.random() < 0.7 else 3 for _ in range(2000))
    used = check_plan(histogram, capacity)
    total = sum(n * c for n, c in histogram.items())
    assert used >= -(-total // capacity)
    # best fit decreasing item by item
    rooms = []
    for n in sorted(histogram.elements(), reverse=True):
        fit = min((r for r in rooms if r >= n), default=None)
        if fit is None:
            rooms.append(capacity - n)
        else:
            rooms.remove(fit)
            rooms.append(fit - n)
    assert used == len(rooms)


def test_plan_edges():
    assert plan_containers({}, 10) == []
    assert check_plan({10: 3}, 10) == 3 and check_plan({1: 25}, 10) == 3
    with pytest.raises(ValueError):
        plan_containers({11: 1}, 10)


def test_documents_take_planned_slots(spark):
    rng = random.Random(4)
    sizes = [5 if rng.random() < 0.4 else rng.randrange(0, 90) for _ in range(1500)] + [None, 1000, 96, 32, 33]
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)], "doc_id bigint, n_tokens bigint, rank string")
    rows = pack(df, 32).collect()
    fill, whole = Counter(), defaultdict(list)
    for r in rows:
        fill[r["container_no"]] += r["n_tokens"]
        whole[r["item"]].append((r["piece_no"], r["token_from"], r["n_tokens"]))
    assert max(fill.values()) <= 32 and sorted(fill) == list(range(len(fill)))
    for i, n in enumerate(sizes):
        parts = sorted(whole.get(i, []))
        assert sum(p[2] for p in parts) == (n or 0) and len(parts) == -(-(n or 0) // 32)
        assert [p[1] for p in parts] == [32 * k for k in range(len(parts))]
    assert len(fill) <= 1.02 * -(-sum(n or 0 for n in sizes) // 32) + 1
    assert pack(df.limit(0), 32).count() == 0
