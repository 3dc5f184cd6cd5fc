import random
from datetime import datetime, timedelta

from spanforge.streaming import requests

EVENTS = "uri string, version long, kind string, text string, ts timestamp"


def test_late_changes_end_in_the_batch_table(spark, tmp_path):
    """Events out of order over several batches, with a restart from the checkpoint in between."""
    r = random.Random(7)
    events = [(f"d{k % 9}" if k % 31 else None, r.randrange(12) if k % 17 else None, r.choice(["open", "change", "change", "close"]), r.choice([None, "é", f"t{k}"]), datetime(2024, 1, 1) + timedelta(minutes=k)) for k in range(160)]
    events += events[:10]
    r.shuffle(events)

    def run(parts):
        for part in parts:
            spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        sink = lambda df, n: df.write.mode("append").parquet(f"{tmp_path}/out")
        query = requests.document_changes(stream).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        try:
            assert query.awaitTermination(90)
        finally:
            query.stop()

    run([events[:40], events[40:80]])
    run([events[80:120], events[120:]])
    changes = spark.read.parquet(f"{tmp_path}/out")
    usable = spark.createDataFrame([e for e in events if e[0] is not None and e[1] is not None], EVENTS)
    want = {x.uri: (x.version, x.text) for x in requests.latest_documents(usable).collect()}
    assert {x.uri: (x.version, x.text) for x in requests.open_documents(changes).collect()} == want and want
    # a document is written only when it changes
    assert changes.count() < len(events) / 2
