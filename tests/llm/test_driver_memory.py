from tarnwerk.llm import common


def test_free_memory_outside_the_heap_is_given_back(spark):
    assert common.trim(spark)
