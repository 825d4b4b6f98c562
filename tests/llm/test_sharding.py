from __future__ import annotations

from collections import defaultdict

from pyspark.sql import functions as F

from brute import crc, shard_of
from freightlens.llm.common import table
from freightlens.llm.queries import op5_rendezvous
from freightlens.llm.sharding import rendezvous_shard, with_shards, with_slots


def gapless(rows):
    slots = defaultdict(list)
    for shard, slot in rows:
        slots[shard].append(slot)
    return all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_query_matches_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    got = op5_rendezvous(spark, sf_dir).collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == sorted(
        (d, len(t.encode()) + 1, crc(t), "key", shard_of(d, 16), shard_of(d, 17)) for d, t in docs
    )
    assert gapless((r.shard, r.slot) for r in got)
    assert all(r.grown_shard in (r.shard, 16) for r in got)


def test_weights(spark):
    rows = spark.range(20_000).select(rendezvous_shard(F.col("id"), [1, 2, 5]).alias("s"))
    share = {r.s: r["count"] / 20_000 for r in rows.groupBy("s").count().collect()}
    assert abs(share[0] - 1 / 8) < 0.02 and abs(share[2] - 5 / 8) < 0.02


def test_few_records_move(spark):
    keys = spark.range(5_000)
    moved = keys.select(
        rendezvous_shard(F.col("id"), [1] * 9).alias("a"), rendezvous_shard(F.col("id"), [1] * 10).alias("b")
    ).where("a != b")
    assert moved.where("b != 9").count() == 0 and 300 < moved.count() < 700


def test_nulls_repeats_and_names(spark):
    """A third of all rows are one record, which must not break the numbering."""
    rows = [(None, 1)] * 3 + [(7, 2)] * 25_000 + [(k, k) for k in range(1000)]
    df = spark.createDataFrame(rows, "key long, Shard long")
    out = with_slots(with_shards(df, "key", [1.0] * 4), column="slot").collect()
    assert len(out) == len(rows) and gapless((r.shard, r.slot) for r in out)
    other = with_slots(with_shards(df.repartition(5), "key", [1.0] * 4)).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, other))
    assert with_slots(with_shards(df.limit(0), "key", [1.0])).count() == 0
