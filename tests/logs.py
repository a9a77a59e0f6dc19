"""Small random change-logs, and what they must come to in plain Python."""

import random
from datetime import datetime, timedelta, timezone

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
LOG = "op string, change_seq long, part_no int, offset_no long, ts timestamp, arrived_at timestamp"


def random_log(rng, keys, values, n, live_bias=0.8):
    """Rows (key..., value..., op, change_seq, part_no, offset_no, ts, arrived_at), repeated and disordered."""
    out = []
    for seq in rng.sample(range(1, 10 * n + 1), n):
        op = rng.choice(["c", " U", "insert", "upsert"]) if rng.random() < live_bias else rng.choice(["d", " Delete", None, "D"])
        ts = None if rng.random() < 0.1 else START + timedelta(hours=rng.randrange(3000))
        row = (*keys(rng), *values(rng), op, seq, 0, None, ts)
        for _ in range(rng.choice([1, 1, 1, 2, 3])):
            out.append((*row, START + timedelta(seconds=rng.randrange(10_000_000))))
    rng.shuffle(out)
    return out


def dead(op):
    return op is None or op.strip().lower().startswith("d")


def decide(log, n_keys):
    """key -> deciding row with the first arrival of its change."""
    best = {}
    for row in log:
        key, seq = row[:n_keys], row[-5]
        old = best.get(key)
        if old is None or seq > old[-5] or (seq == old[-5] and row[-1] < old[-1]):
            best[key] = row
    return best


def rng(seed):
    return random.Random(seed)
