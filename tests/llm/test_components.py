import random

from tarnwerk.llm.components import connected_components


def brute(edges):
    of = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            of.setdefault(a, a), of.setdefault(b, b)
    for _ in of:
        for a, b in edges:
            if a in of and b in of:
                of[a] = of[b] = min(of[a], of[b])
    return of


def check(spark, edges):
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len({r[0] for r in got})
    assert {r[0]: r[1] for r in got} == brute(edges)


def test_shapes(spark):
    rnd = random.Random(1)
    chain = [(k, k + 1) for k in range(-20, 20)]
    star = [(1000 + k, 1000) for k in range(50)] + [(2000, 1000 + k) for k in range(50)]
    loose = [(rnd.randrange(5000, 5200), rnd.randrange(5000, 5200)) for _ in range(90)]
    odd = [(7, 7), (None, 3), (3, None), (None, None), (3, 4), (3, 4), (4, 3), (-(2**63), 2**63 - 1)]
    check(spark, chain + star + loose + odd)


def test_empty(spark):
    assert connected_components(spark.createDataFrame([(5, 5), (None, 1)], "a long, b long")).collect() == []


def test_the_guess_of_a_size_stays_a_small_number_over_rounds(spark):
    from tarnwerk.llm import components
    from tarnwerk.llm.common import cut

    e = spark.createDataFrame([(k + 1, k) for k in range(30)], "u long, v long")
    for _ in range(3):
        e = cut(components._small_star(components._large_star(e)))
    assert e._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 64
