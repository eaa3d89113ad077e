"""The stream of corrections against the batch log."""

from datetime import datetime, timedelta

import numpy as np

from docsift.operators.feedback import apply_corrections
from docsift.streaming.corrections import correction_stream

SCHEMA = "record_id string, filename string, decision string, predicted_score double, reviewer string, at timestamp"


def test_stream_equals_batch_also_after_restarts(spark, tmp_path):
    rng = np.random.default_rng(3)
    start = datetime(2026, 1, 1)
    rows = []
    for i in range(300):
        name = f"{int(rng.integers(40)):05d}.txt" if i % 3 else "00001.txt"  # one file has a third of all
        decision = str(rng.choice(["useful", "not_useful", "maybe"], p=[0.45, 0.45, 0.1]))
        rows.append((f"{i:04d}", name, decision, float(rng.random()), "r1", start + timedelta(minutes=i // 2)))
    files = [(f"{i:05d}.txt", ["useful", "not_useful", "manual_check"][i % 3]) for i in range(30)]
    files = spark.createDataFrame(files, "filename string, dir string")
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in range(5):
        own = rows[60 * part : 60 * part + 60]
        rng.shuffle(own)
        spark.createDataFrame(own, SCHEMA).repartition(3).write.mode("append").parquet(f"{source}/p={part}")
        stream = spark.readStream.schema(SCHEMA + ", p int").parquet(source).drop("p")
        correction_stream(stream, files, out, state, once=True).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    batch = apply_corrections(files, spark.createDataFrame(rows, SCHEMA))[1]
    assert got == sorted(map(tuple, batch.select(*spark.read.parquet(out).columns).collect())) and len(got) > 60
    correction_stream(stream, files, out, state, once=True).awaitTermination()  # finds nothing new
    assert spark.read.parquet(out).count() == len(got)
