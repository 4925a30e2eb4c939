from collections import defaultdict
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from lumenscribe.llm import mixing, sharding
from lumenscribe.session import run_dir


def test_slots_do_not_change_and_shards_are_even(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    sizes = sharding.slot_bytes(docs).persist()
    first = sharding.initial_map(spark)
    second = sharding.rebalance(first, sizes)
    loads = [r[1] for r in second.join(sizes, "slot", "left").groupBy("shard").agg(F.sum(F.coalesce("bytes", F.lit(0)))).collect()]
    heaviest = sizes.agg(F.max("bytes")).first()[0]
    assert len(loads) == sharding.SHARDS and max(loads) <= sum(loads) / len(loads) + 2 * heaviest
    assert second.count() == sharding.SLOTS == second.select("slot").distinct().count()
    moved = second.alias("b").join(first.alias("a"), "slot").where("a.shard <> b.shard").count()
    assert moved < sharding.SLOTS / 4


def test_drained_shards_lose_every_slot_and_new_ones_gain(spark):
    sizes = spark.range(sharding.SLOTS).select(F.col("id").cast("int").alias("slot"), F.lit(10).cast("bigint").alias("bytes"))
    start = sharding.initial_map(spark, shards=8)
    fewer = sharding.rebalance(start, sizes, 6)
    assert {r[0] for r in fewer.select("shard").distinct().collect()} == set(range(6))
    more = sharding.rebalance(start, sizes, 16).groupBy("shard").count().collect()
    assert len(more) == 16 and max(r[1] for r in more) <= 1.1 * sharding.SLOTS / 16


def test_versions_are_kept(spark):
    maps = sharding.SlotMaps(spark, run_dir(spark, "test-maps"))
    assert maps.versions() == []
    maps.commit(sharding.initial_map(spark, 16, 4), 1)
    maps.commit(sharding.initial_map(spark, 16, 2), 2)
    assert maps.versions() == [1, 2] and maps.latest().agg(F.max("shard")).first()[0] == 1
    assert maps.get(1).agg(F.max("shard")).first()[0] == 3
    with pytest.raises(Exception):
        maps.commit(sharding.initial_map(spark, 16, 2), 2)


def test_new_data_edit_the_stored_map(spark):
    path = run_dir(spark, "test-maps")
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"))
    sharding.shard_documents(docs, 64, 4, path)
    maps = sharding.SlotMaps(spark, path)
    assert maps.versions() == [1, 2]
    before = {r["slot"]: r["shard"] for r in maps.latest().collect()}
    grown = docs.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.repeat("text", F.lit(9))).otherwise(F.col("text")))
    out = sharding.shard_documents(grown, 64, 4, path)
    assert maps.versions() == [1, 2, 3]
    after = {r["slot"]: r["shard"] for r in maps.latest().collect()}
    assert 0 < sum(before[s] != after[s] for s in after) < 32
    assert {(r[0], r[1]) for r in out.select("slot", "shard").distinct().collect()} == set(after.items())
    with_more = {r["slot"]: r["shard"] for r in sharding.shard_documents(grown, 64, 5, path).select("slot", "shard").distinct().collect()}
    assert maps.versions()[-1] == 4 and set(with_more.values()) == set(range(5))


def test_equal_hashes_stay_or_go_together_and_long_texts_count_whole(spark):
    rows = [(7, "s", "w " * 5)] * 3 + [(k, "s", "w " * 5) for k in range(20, 40)] + [(50, "t", "w " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    for share in range(5, 100, 10):
        assert mixing.mix_documents(docs, share_pct=share, weights={}).where("doc_id = 7").count() in (0, 3)
    weighed = {r["key"]: r["tokens"] for r in mixing.weighed(docs).collect()}
    assert weighed[50] == 300_000
    sizes = sharding.slot_bytes(docs).agg(F.sum("bytes")).first()[0]
    assert sizes == sum(len(t) for *_, t in rows)


def test_sharding_odd_rows(spark, odd_docs, no_docs):
    out = sharding.shard_documents(odd_docs)
    assert out.count() == odd_docs.count() and out.columns == ["doc_id", "text", "lang", "source", "n_chars", "tier", "a.b", "slot", "shard"]
    assert out.where("slot is null or shard is null").count() == 0
    assert out.where("doc_id = 2").select("slot").distinct().count() == 1
    assert sharding.shard_documents(no_docs).count() == 0


def by_hand(rows, weights, share, tiers):
    total, sums = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for key, source, tokens in rows:
        h = int(md5(str("" if key is None else key).encode()).hexdigest()[:9], 16)
        total[source] += tokens
        sums[source][h] += tokens
    whole, ws = sum(total.values()) * share // 100, sum(weights.get(s, 1) for s in total)
    ends = {}
    for s in total:
        quota = whole * weights.get(s, 1) // ws
        for k, p in reversed(list(enumerate(tiers, 1))):
            run = 0
            for h in sorted(sums[s]):
                run += sums[s][h]
                if run <= quota * p // 100:
                    ends[s, h] = k
    return ends


@pytest.mark.parametrize("share,tiers", [(60, (25, 50, 100)), (100, (10,)), (5, (1, 50, 100)), (0, (100,))])
def test_mixing_is_the_sorted_prefix(spark, odd_docs, share, tiers):
    rows = mixing.weighed(odd_docs)
    ends = mixing.cutoffs(rows, {"a": 3}, 1, share, tiers)
    got = {(r["key"], r["source"], r["tokens"], r["tier"]) for r in mixing.select_tiers(rows, ends, F.col("source"), F.col("h")).collect()}
    plain = [(r["key"], r["source"], r["tokens"]) for r in rows.collect()]
    want, hand = set(), by_hand(plain, {"a": 3}, share, tiers)
    for key, source, tokens in plain:
        h = int(md5(str("" if key is None else key).encode()).hexdigest()[:9], 16)
        if (source, h) in hand:
            want.add((key, source, tokens, hand[source, h]))
    assert got == want


def test_mixing_odd_rows(odd_docs, no_docs):
    out = mixing.mix_documents(odd_docs, share_pct=100)
    assert out.columns == odd_docs.columns and 0 < out.count() <= odd_docs.count()
    assert mixing.mix_documents(no_docs).count() == 0
    twice = out.where("doc_id = 2").count()
    assert twice in (0, 2)
