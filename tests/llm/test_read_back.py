"""The round trip of op8 reads each text's ids once."""

from hashlib import sha256

import public_tokenizers
from pyspark.sql import functions as F

from flowgauge.llm import pieces, queries, token_orc


def test_a_text_is_cut_into_pieces_once(spark, tmp_path):
    texts = ["a b  c", None, "", "x" * 70_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.QUERIES["op8_pieces_round_trip"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    called = [line for line in plan.split("\n") if "ArrowEvalPython" in line and "coalesce(text" in line]
    assert len(called) == 1 and called[0].count("coalesce(text") == 1
    assert [r.decoded_sha256 for r in found.orderBy("doc_id").collect()] == [
        sha256((t or "").encode()).hexdigest() for t in texts]
    ids = pieces.encode(rows, public_tokenizers.path("piece_bpe_32k.model")).localCheckpoint()
    plain = ids.select("doc_id", F.size("ids").alias("n"), token_orc.ids_crc32(F.col("ids")).alias("crc"))
    assert [(r.n, r.crc) for r in plain.orderBy("doc_id").collect()] == [
        (r.n_ids, r.ids_crc32) for r in found.orderBy("doc_id").collect()]
