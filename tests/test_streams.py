import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tests.conftest import rows
from twinlens.streaming import ingest


def _files(spark, path, n=4):
    r = random.Random(1)
    start = datetime(2023, 3, 1)
    data = []
    for k in range(n):
        part = []
        for _ in range(40):
            t = start + timedelta(days=k, seconds=r.randrange(86_400))
            part.append((r.randrange(60) + 40 * k, f"https://h{r.randrange(9)}.example/x?{k}", r.choice(["a", "b"]), "r1", r.random(), t, t))
        spark.createDataFrame(part, "seq bigint, url string, engine string, run_id string, engine_score double, found_at timestamp, loaded_at timestamp").coalesce(1).write.parquet(f"{path}/{k}")
        data += part
    return data


def test_batches_replace_their_windows(spark, tmp_path):
    data = _files(spark, tmp_path)
    got = ingest.run_to_end(ingest.windowed_counts(_stream(spark, tmp_path)), "update", ["start", "engine"])
    want = {}
    for _, _, e, _, _, t, _ in data:
        key = t.replace(hour=0, minute=0, second=0, microsecond=0), e
        want[key] = want.get(key, 0) + 1
    assert {(r["start"], r["engine"]): r["hits"] for r in got.collect()} == want


def _stream(spark, path):
    schema = spark.read.parquet(f"{path}/0").schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    return s.withColumn("event_time", F.coalesce("found_at", "loaded_at"))


def test_addresses_are_counted_over_batches(spark, tmp_path):
    data = _files(spark, tmp_path)
    want = {}
    for seq, url, *_ in data:
        key = url.split("?")[0]
        n, first = want.get(key, (0, 10**9))
        want[key] = n + 1, min(first, seq)
    got = ingest.count_addresses(_stream(spark, tmp_path))
    assert rows(got, "canon", "hits", "first_seq") == sorted((k, *v) for k, v in want.items())
