"""Streams over tables that are one file or a folder of files."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from docsift.plans.catalogue import QUERIES
from docsift.plans.tables import arriving

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "events": "event_id long, user_id long, event_type string, value double, ts timestamp",
}


def rows():
    rng = np.random.default_rng(3)
    shared, good, bad = ([f"{p}{c}{d}" for c in "abcdef" for d in "abc"] for p in ("share", "good", "bad"))
    texts = [" ".join(rng.choice(shared + (good if i % 2 else bad), 40)) for i in range(80)]
    kinds = ["purchase", "signup", "error", "click", "view"]
    return {
        "documents": [(i, t, "en", "web", len(t)) for i, t in enumerate(texts)],
        "labels": [(i, i % 2, int(i % 9 == 0)) for i in range(60)],
        "embeddings": [(i, [float(x) for x in rng.normal(size=64)], i % 10) for i in range(0, 80, 2)],
        "events": [(i, int(rng.integers(80)), kinds[i % 5], float(i % 97), datetime(2024, 1, 1) + timedelta(minutes=i)) for i in range(300)],
    }


@pytest.fixture(scope="module")
def layouts(spark, tmp_path_factory):
    """The same tables with a folder of parts for each, and with one file for each, beside a folder of a similar name."""
    parts, single = tmp_path_factory.mktemp("parts"), tmp_path_factory.mktemp("single")
    for name, own in rows().items():
        frame = spark.createDataFrame(own, SCHEMAS[name])
        frame.repartition(3).write.parquet(str(parts / f"{name}.parquet"))
        frame.coalesce(1).write.parquet(str(single / "made" / name))
        (file,) = (single / "made" / name).glob("part-*.parquet")
        (single / f"{name}.parquet").write_bytes(file.read_bytes())
        for folder in (parts, single):
            frame.write.parquet(str(folder / f"{name}.parquet.before"))
    return str(parts), str(single)


def test_only_the_named_table_arrives(spark, layouts, tmp_path):
    for i, folder in enumerate(layouts):
        out, state = str(tmp_path / f"out{i}"), str(tmp_path / f"state{i}")
        frame = spark.readStream.schema("doc_id long").parquet(arriving(folder, "documents"))
        writer = frame.writeStream.format("parquet").option("checkpointLocation", state).option("path", out)
        writer.trigger(availableNow=True).start().awaitTermination()
        assert sorted(r.doc_id for r in spark.read.parquet(out).collect()) == list(range(80))


@pytest.mark.parametrize("name", ["stream_score", "stream_combined", "stream_corrections", "stream_labels"])
def test_streams_read_both_layouts(spark, layouts, name):
    first, second = (sorted(map(tuple, QUERIES[name](spark, folder).collect()), key=repr) for folder in layouts)
    assert first == second and first
