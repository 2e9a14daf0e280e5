from pyspark.sql import functions as F

from quillspark.operators.answer import ask
from quillspark.streaming.questions import answer_stream


def test_stream_gives_what_a_batch_gives(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("parent"))
    items = spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text")
    items.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(items.schema).parquet(str(tmp_path / "in"))
    answer_stream(stream, docs, str(tmp_path / "out"), str(tmp_path / "at")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch").select("qid", "mode", "refusal_reason").collect()
    want = ask(docs, items).select("qid", "mode", "refusal_reason").collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
