"""Exact top-k search against brute force."""

import random

import pytest

from ledgerline.llm import hamming

SCHEMA = "vec_id bigint, embedding array<float>, id int, q string, rank int"


def brute_nearest(codes, k, every):
    out = []
    for q, c in codes.items():
        if q % every == 0:
            near = sorted(((c ^ d).bit_count(), i) for i, d in codes.items() if i != q)[:k]
            out += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    return sorted(out)


def vectors(codes, bits):
    return [(i, [1.0 if c >> b & 1 else -1.0 for b in range(bits)], 7, "x", 1) for i, c in codes.items()]


def rows(found):
    return sorted((r["query_id"], r["rank"], r["id"], r["distance"]) for r in found.collect())


def crowd(n, bits, seed=6):
    """A third of one code, a third near it, a third anywhere."""
    rng = random.Random(seed)
    hot = rng.getrandbits(bits)
    near = lambda: hot ^ (1 << rng.randrange(bits)) ^ (1 << rng.randrange(bits)) ^ (1 << rng.randrange(bits))
    return {i: (hot, rng.getrandbits(bits), near())[i % 3] for i in range(n)}


@pytest.mark.parametrize(("n", "bits", "chunk"), [(300, 64, hamming.CHUNK), (3000, 64, 50), (300, 200, hamming.CHUNK), (40, 10, 3)])
def test_topk_equals_brute_force(spark, n, bits, chunk):
    codes = crowd(n, bits)
    df = spark.createDataFrame(vectors(codes, bits), SCHEMA)
    assert rows(hamming.nearest(df, 7, chunk=chunk)) == brute_nearest(codes, 7, 20)


def test_random_codes_need_several_rounds(spark):
    rng = random.Random(8)
    codes = {i: rng.getrandbits(64) for i in range(4000)}
    df = spark.createDataFrame(vectors(codes, 64), SCHEMA)
    assert rows(hamming.nearest(df, 10)) == brute_nearest(codes, 10, 20)


def test_odd_inputs(spark):
    given = [(0, [1.0, -1.0]), (1, [1.0, None]), (2, None), (3, []), (3, []), (None, [1.0]), (20, [-1.0] * 80), (40, [1.0] * 80), (41, [0.0] * 64 + [1.0] * 16)]
    df = spark.createDataFrame([(*r, 7, "x", 1) for r in given], SCHEMA)
    codes = {0: 1, 1: 1, 2: 0, 3: 0, 20: 0, 40: 2**80 - 1, 41: (2**16 - 1) << 64}
    assert rows(hamming.nearest(df, 3)) == brute_nearest(codes, 3, 20)
    assert hamming.nearest(df, 50).count() == 18
    assert hamming.nearest(df.limit(0), 3).count() == 0
    assert hamming.nearest(df.filter("vec_id is null"), 3).count() == 0
    with pytest.raises(TypeError):
        hamming.nearest(df.selectExpr("cast(vec_id as string) as vec_id", "embedding"))
