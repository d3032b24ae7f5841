"""The interval overlap join against a pairwise brute force."""

import random
import zlib
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from paperloom.llm import interval_overlap as io

ZERO = datetime(2024, 1, 1)


def relation(a, b, c, d):
    return io.RELATIONS[(0 if a < c else 3 if a == c else 6) + (0 if b < d else 1 if b == d else 2)]


def brute(sales, visits):
    out = {}
    for row, (sale, client, a, b) in enumerate(sales):
        for other, c, d, w in visits:
            if client is None or client != other or a is None or c is None:
                continue
            b_, d_ = max(a, b), max(c, d)
            if c <= b_ and a <= d_:
                got = out.setdefault((row, sale, relation(a, b_, c, d_)), [0, 0, 0])
                got[0] += 1
                got[1] = None if b_ == d_ == io.OPEN else got[1] + min(b_, d_) - max(a, c) + 1
                got[2] += w
    return Counter((k[1], k[2], *v) for k, v in out.items())


def made(seed, n=160, clients=5, slots=40, hot=0.5):
    rnd = random.Random(seed)

    def one():
        client = 7 if rnd.random() < hot else rnd.choice([None, *range(clients)])
        start = rnd.choice([None, -3]) if rnd.random() < 0.05 else rnd.randrange(slots)
        end = io.OPEN if rnd.random() < 0.2 else (start or 0) + rnd.choice([-2, 0, 0, 1, 3, 20])
        return client, start, end

    sales = [(i if i % 9 else 9, *one()) for i in range(n)]
    return sales, [(*one(), rnd.randrange(1000)) for _ in range(n)]


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_pairs_of_random_intervals(spark, parts):
    sales, visits = made(parts)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        left = spark.createDataFrame(sales, "sale_id long, client long, start long, end long")
        right = spark.createDataFrame(visits, "client long, start long, end long, w long")
        got = io.overlaps(left, right, F.col("w")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert Counter(map(tuple, got)) == brute(sales, visits)


def test_clients_may_be_strings(spark):
    sales, visits = made(5)
    sales, visits = [(s, c and f"c{c}", *x) for s, c, *x in sales], [(c and f"c{c}", *x) for c, *x in visits]
    left = spark.createDataFrame(sales, "sale_id long, client string, start long, end long")
    right = spark.createDataFrame(visits, "client string, start long, end long, w long")
    assert Counter(map(tuple, io.overlaps(left, right, F.col("w")).collect())) == brute(sales, visits)


def sessions_brute(clicks):
    by, out = {}, []
    for client, at, kind in clicks:
        if client is not None and at is not None:
            by.setdefault(client, []).append((at, kind == "error"))
    for client, all_of in by.items():
        now = []
        for at in sorted(all_of):
            if now and (at[0] - now[-1][0]) > timedelta(minutes=15):
                out.append((client, now))
                now = []
            now.append(at)
        out.append((client, now))
    return sorted((c, s[0][0], s[-1][0], any(e for at, e in s if at == s[-1][0])) for c, s in out)


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_sessions(spark, kind):
    rnd = random.Random(3)
    clicks = [(rnd.choice([None, 1, 2, 2]), None if i % 50 == 7 else ZERO + timedelta(minutes=rnd.randrange(3000) * 5, microseconds=i % 2), rnd.choice([None, "error", "view"])) for i in range(700)]
    clicks += [(9, ZERO + timedelta(minutes=15 * i), "view") for i in range(200)] + [(9, ZERO + timedelta(minutes=15 * 199), "error")]  # over many stretches
    clicks += clicks[:90]
    table = spark.createDataFrame(clicks, "client_id long, ts timestamp_ntz, kind string").withColumn("ts", F.col("ts").cast(kind))
    got = io.sessions(table).collect()
    assert len([r for r in got if r.client == 9]) == 1
    micro = lambda t: (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    assert sorted(map(tuple, got)) == [(c, micro(a), micro(b), o) for c, a, b, o in sessions_brute(clicks)]


SALES = "sale_id long, client_id long, status string, sold_at timestamp_ntz"
LINES = "sale_id long, shipped_at timestamp_ntz"
CLICKS = "client_id long, ts timestamp_ntz, kind string"


def test_sales_with_nulls_ties_and_clashing_names(spark):
    sales = [(1, 5, "open", ZERO), (2, 5, "done", ZERO), (2, 5, "done", ZERO), (None, 5, None, ZERO + timedelta(hours=7)), (4, None, "open", ZERO), (5, 5, "held", None)]
    lines = [(2, ZERO + timedelta(days=2)), (2, None), (None, ZERO + timedelta(days=90)), (77, ZERO)]
    clicks = [(5, ZERO + timedelta(hours=13), "error"), (5, ZERO + timedelta(hours=13), "error"), (5, ZERO + timedelta(days=1), None), (None, ZERO, "error"), (5, None, "error")]
    left = spark.createDataFrame(sales, SALES)
    for name in ("client", "first", "last", "start", "end", "n", "crc", "_sale", "shipped", "open", "relation"):
        left = left.withColumn(name, F.array(F.lit(name)))
    right = spark.createDataFrame(clicks, CLICKS)
    for name in ("client", "at", "error", "stretch", "piece", "begins", "session", "first", "last", "open", "start"):
        right = right.withColumn(name, F.lit(name))
    shipped = spark.createDataFrame(lines, LINES).withColumn("at", F.lit("x")).withColumn("shipped", F.lit(1)).withColumn("_sale", F.lit(3))
    got = Counter((r.sale_id, r.relation, r.n_pairs, r.overlap_slots, r.sessions_crc) for r in io.sales_in_sessions(left, shipped, right).collect())
    crc = [zlib.crc32(str((ZERO + d - datetime(1970, 1, 1)) // timedelta(microseconds=1)).encode()) for d in (timedelta(hours=13), timedelta(days=1))]
    assert got == Counter({
        (1, "finished_by", 1, None, crc[0]): 1, (1, "contains", 1, 1, crc[1]): 1,
        (2, "overlaps", 1, 7, crc[0]): 2, (2, "contains", 1, 1, crc[1]): 2,
    })


def test_sales_of_nothing(spark):
    none = [spark.createDataFrame([], s) for s in (SALES, LINES, CLICKS)]
    assert io.sales_in_sessions(*none).count() == 0
    some = spark.createDataFrame([(1, 5, "open", ZERO)], SALES)
    assert io.sales_in_sessions(some, none[1], none[2]).count() == 0
