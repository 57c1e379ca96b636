"""The gates give a stream the same verdicts as a batch."""

from vouchline.operators import gates
from vouchline.streaming.verify import verify_stream


def test_stream_equals_batch(spark, tmp_path):
    names = ["has_front", "has_back", "has_selfie", "feature_error", "feature_front", "feature_back", "align_error", "photo_present", "face_error", "face_passed", "ocr_error", "liveness_error", "liveness_passed"]
    rows = [(i, *((i * (k + 3)) % 5 != 0 for k in range(len(names))), 13 + i % 2) for i in range(60)]
    schema = "case_id long, " + ", ".join(f"{n} boolean" for n in names) + ", id_digits int"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    stream = verify_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).select("case_id", "stage", "overall")
    query = stream.writeStream.format("memory").queryName("verdicts").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    batch = gates.pipeline_gate(gates.web_gate(spark.read.parquet(f"{tmp_path}/in"))).select("case_id", "stage", "overall")
    assert sorted(map(tuple, spark.table("verdicts").collect())) == sorted(map(tuple, batch.collect()))
