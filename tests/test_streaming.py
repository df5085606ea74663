from __future__ import annotations

import json

from evalanvil.streaming.shards import arrivals, first_deliveries, shard_stream


def test_shards(spark, tmp_path):
    def put(name, rows):
        keys = ("eval_id", "dataset", "model", "id", "completion", "received_at")
        (tmp_path / name).write_text("".join(json.dumps(dict(zip(keys, r))) + "\n" for r in rows))

    put("a.jsonl", [("e", "d", "o--m", "X#1 ", "hi", "2025-01-01T00:00:00Z"), ("e", "d", "o/m", "y#0", " ", "2025-01-01T00:01:00Z")])
    query = first_deliveries(shard_stream(spark, str(tmp_path))).writeStream.format("memory").queryName("firsts").outputMode("append").start()
    query.processAllAvailable()
    put("b.jsonl", [("e", "d", "o/m", "x#1", "again", "2025-01-01T00:02:00Z"), ("e", "d", "o/m", "z", "new", "2025-01-01T00:03:00Z")])
    query.processAllAvailable()
    query.stop()
    assert sorted(r["id"] for r in spark.table("firsts").collect()) == ["x#1", "y#0", "z"]
    counted = arrivals(shard_stream(spark, str(tmp_path))).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    counted.processAllAvailable()
    counted.stop()
    row = spark.table("counts").first()
    assert (row["lines"], row["empty"], row["model"]) == (4, 1, "o/m")
