"""What an action costs, by Spark's own count."""


def shuffled_bytes(spark, act):
    """Bytes of shuffle files that an action writes."""
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    before = written()
    act()
    return written() - before
