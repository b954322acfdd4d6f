import random

import pytest

from lumenspan.operators import similar
from lumenspan.schemas import COMMENTS

WORDS = "alpha beta gamma delta rename column index null join shuffle token secret retry deploy cache window".split()


def made():
    rng = random.Random(3)
    bases = [" ".join(rng.sample(WORDS, 9)) for _ in range(25)] + ["please do not drop table here", "a breaking change for downstream consumers", "we truncate table and drop table"]
    rows = []
    for n in range(420):
        text = rng.choice(bases)
        if rng.random() < 0.5:
            words = text.split()
            words[rng.randrange(len(words))] = rng.choice(WORDS)
            text = " ".join(words)
        rows.append(("big" if n % 6 else f"r{n % 4}", n, f"f{n}.py", rng.choice([None, "", "7"]), rng.choice(["high", "HIGH"]), None, text if n % 50 else None, None))
    return rows


def brute(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: r[1]):
        groups.setdefault((r[0], r[4].lower(), r[5] or ""), []).append(r)
    out = []
    for own in groups.values():
        heads, also = [], {}
        for r in own:
            c = similar._Comment(r[6] or "")
            head = next((h for h, other in heads if c.like(other)), None)
            if head is None:
                heads.append((r[1], c))
                head = r[1]
            else:
                also.setdefault(head, []).append(f"{r[2]}:{r[3]}" if r[3] else r[2])
            out.append((r[0], r[1], head))
        out = [(*x[:3], also.get(x[1], [])) if len(x) == 3 else x for x in out]
    return sorted(out)


@pytest.mark.parametrize(("group", "first"), [(2_000, 500), (50, 7), (10, 200)])
def test_groups_of_any_size_have_the_same_leaders(spark, monkeypatch, group, first):
    monkeypatch.setattr(similar, "PART", 60)
    rows = made()
    random.Random(1).shuffle(rows)
    got = similar.group_similar(spark.createDataFrame(rows, COMMENTS), group, first)
    assert sorted(map(tuple, got.collect())) == brute(rows)
    assert similar.group_similar(spark.createDataFrame([], COMMENTS)).collect() == []
