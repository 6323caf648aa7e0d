import json

from factloom.streaming.facts import facts_of_stream, profiles_of_batches

SOURCES = "candidate_key string, source_id string, source_kind string, source_order int, ingested_at string, text string"


def test_profiles_follow_the_stream(spark, tmp_path):
    seen = {}

    def sink(profiles, number):
        seen[number] = {r.candidate_key: (r.fullName, list(r.emails)) for r in profiles.collect()}

    def arrive(*rows):
        spark.createDataFrame(rows, SOURCES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SOURCES).parquet(str(tmp_path / "in"))
        q = profiles_of_batches(facts_of_stream(stream), str(tmp_path / "facts"), sink).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()

    arrive(("a", "r", "resume_pdf", 2, "t", "Jane A. Doe\nj@x.org"), ("b", "r2", "resume_pdf", 2, "t", "Bo Li\nb@x.org"))
    arrive(("a", "ats", "ats_json", 1, "t", json.dumps({"name": "Jane Doe", "email": "J@x.org"})))
    assert seen == {0: {"a": ("Jane A. Doe", ["j@x.org"]), "b": ("Bo Li", ["b@x.org"])}, 1: {"a": ("Jane Doe", ["J@x.org"])}}
