import json

import pytest
from pyspark.sql import functions as F

from factloom.operators import confidence, extract, merge, validate
from factloom.operators.paths import PathError, parse, resolve
from factloom.operators.project import ProjectionConfig, ProjectionField, config_issues, project, read_config
from factloom.plans import pipeline
from factloom.sources import records

# The sample candidate.
RECORD = {"id": "cand-001", "name": "Jane Doe", "email": "jane.doe@acme.com", "phone": "+1 (415) 555-2671", "title": "Senior Software Engineer", "current_company": "Acme Corporation", "location": {"city": "San Francisco"}}
SUMMARY = "Nimbus Labs - Engineer (Mar 2021 - Present)\nBuilt pipelines.\nAcme Corporation - Engineer (Jan 2018 - Feb 2021)"
RESUME = f"Jane A. Doe\njane.doe@acme.com\n+1 415-555-2671\n\nExperience\n{SUMMARY}\n\nEducation\nUniversity of California, Berkeley\nB.S., 2018\n\nSkills\nJS, TS, Node, Postgres\n"
# End of fixed values.
SOURCES = "candidate_key string, source_id string, source_kind string, source_order int, ingested_at string, text string"
MAPPED = {
    "fields": [
        {"path": "candidate.id", "type": "string", "required": True, "from": "candidateId"},
        {"path": "contact.primaryPhone", "type": "string", "required": True, "normalize": ["e164"], "from": "phones[0]"},
        {"path": "profile.skills", "type": "string[]", "normalize": ["canonical"], "from": "skills[].name"},
        {"path": "profile.latest", "type": "string", "from": "experience[0].summary"},
    ],
    "include_confidence": True,
    "on_missing": "null",
}


def sources(spark, *more):
    rows = [("c", "ats:sample.json", "ats_json", 1, "2026-06-30T10:00:00.000Z", json.dumps(RECORD)), ("c", "resume:sample.txt", "resume_pdf", 2, "2026-06-30T10:00:01.000Z", RESUME), *more]
    return spark.createDataFrame(rows, SOURCES)


@pytest.fixture(scope="module")
def result(spark):
    run = pipeline.run(sources(spark), read_config(MAPPED))
    return {"profile": run.profiles.collect()[0].asDict(True), "outputs": [json.loads(r.output) for r in run.outputs.collect()], "stages": [s.name for s in run.stages]}


def test_sample_candidate_end_to_end(result):
    assert result["outputs"] == [{"candidate": {"id": "ats:sample.json"}, "contact": {"primaryPhone": "+14155552671"}, "profile": {"skills": ["JavaScript", "TypeScript", "Node.js", "PostgreSQL"], "latest": SUMMARY}, "overallConfidence": 0.7539}]
    assert set(result["stages"]) <= set(pipeline.STAGES)


# Scores of the sample candidate.
def test_sample_scores(result):
    p = result["profile"]
    scores = {f["fieldPath"]: f["score"] for f in p["fieldConfidence"]}
    assert {k: v["value"] for k, v in scores.items()} == {
        "education[0].institution": 0.7075, "emails[0]": 0.8175, "experience[0].company": 0.8275, "experience[0].summary": 0.7075, "experience[0].title": 0.8275, "full_name": 0.8175, "phones[0]": 0.8175,
        "skills[0].name": 0.6775, "skills[1].name": 0.6775, "skills[2].name": 0.6775, "skills[3].name": 0.6775,
    }
    assert [p["overallConfidence"][k] for k in ("value", "sourceWeight", "methodWeight", "agreementWeight")] == [0.7539, 0.7467, 0.7967, 0.6952]
    assert len(p["provenance"]) == 14
    assert list(scores) == sorted(scores)


def test_batch_equals_single_runs_and_bad_records_do_not_stop_it(spark):
    bad = [("b1", "ats:b1.json", "ats_json", 1, "2026-06-30T10:00:00Z", "{"), ("b2", "ats:b2.json", "ats_json", 1, "2026-06-30T10:00:00Z", '{"id": null}'), ("b3", "ats:b3.json", "ats_json", 1, "2026-06-30T10:00:00Z", '{"email": 7}'), ("b4", "r", "resume_pdf", 2, "2026-06-30T10:00:00Z", None)]
    facts, errors = pipeline.facts_of(sources(spark, *bad))
    assert facts.select("candidate_key").distinct().count() == 1
    codes = sorted((r.candidate_key, r.code) for r in errors.collect())
    assert codes == sorted([("b1", "ATS_JSON_PARSE_FAILED"), ("b2", "ATS_JSON_PARSE_FAILED"), ("b3", "ATS_JSON_PARSE_FAILED"), ("b4", "RESUME_PDF_PARSE_FAILED"), *((b, "PIPELINE_SOURCES_EMPTY") for b in ("b1", "b2", "b3", "b4"))])


def test_sources_that_are_not_described_give_errors_not_facts(spark):
    rows = [("d1", "", "ats_json", 1, "t", '{"name": "A B"}'), ("d2", "r", "resume_pdf", None, "t", "Jane Doe"), ("d3", "x", "odd", 1, "t", "z")]
    facts, errors = pipeline.facts_of(sources(spark, *rows))
    assert {r.candidate_key for r in facts.collect()} == {"c"}
    assert sorted((r.candidate_key, r.code) for r in errors.collect()) == [("d1", "ATS_EXTRACTION_FAILED"), ("d2", "RESUME_EXTRACTION_FAILED"), ("d3", "PIPELINE_SOURCES_EMPTY")]


def test_stages_can_be_replaced(spark):
    only = {"ats_json": extract.structured_facts}
    run = pipeline.run(sources(spark), read_config({"fields": [{"path": "n", "type": "string", "from": "fullName"}, {"path": "s", "type": "string[]", "from": "skills[].name"}], "onMissing": "omit"}), extractors=only, synonyms={})
    assert [json.loads(r.output) for r in run.outputs.collect()] == [{"n": "Jane Doe"}]
    assert {s.name for s in run.stages} == set(pipeline.STAGES) and run.counters()["profiles"] == 1


def test_resume_sections(spark):
    text = "resume\nJane Doe\nSkills:\nnot a section\nskills\n• Go;  Rust |go\nx\nReferences\nz9"
    row = spark.createDataFrame([(text,)], "t string").select(extract.lines_of(F.col("t")).alias("l")).select(extract.name_of(F.col("l")), extract.skills_of(F.col("l")), extract.experience_of(F.col("l"))).collect()[0]
    assert list(row) == ["Jane Doe", ["Go", "Rust", "References", "z9"], []]


FACTS = "candidate_key string, fact_id string, field_path string, source_kind string, source_id string, extraction_method string, original_value string, value string, value_kind string, confidence double, source_order int, extraction_order int, extracted_at string, evidence string"


def fact(path, value, kind="ats_json", conf=0.6, order=1, key="c", value_kind="primitive"):
    method = "structured_field_map" if kind == "ats_json" else "regex_match"
    return (key, f"{kind}:{path}:{order:04d}", path, kind, f"{kind}-1", method, value, value, value_kind, conf, 1 if kind == "ats_json" else 2, order, "2026-01-01T00:00:00Z", "e")


def merged(spark, *facts):
    return merge.merge_facts(spark.createDataFrame(list(facts), FACTS)).collect()[0].asDict(True)


def test_precedence_beats_confidence_and_null_competes(spark):
    p = merged(spark, fact("full_name", "Jane Doe", conf=0.2), fact("full_name", "Jane A. Doe", "resume_pdf", 0.95), fact("headline", None), fact("headline", "x", "resume_pdf"))
    assert p["fullName"] == "Jane Doe" and p["headline"] is None
    assert [x["sourceId"] for x in p["provenance"] if x["fieldPath"] == "full_name"] == ["ats_json-1", "resume_pdf-1"]


def test_collections_first_spelling_and_sources(spark):
    p = merged(spark, fact("skills[0].name", "TypeScript"), fact("skills[1].name", "typescript", "resume_pdf"), fact("emails[]", "A@x.org"), fact("emails[1]", "a@X.org ", order=2), fact("emails[]", " ", order=3), fact("links.other[]", "http://x.org//"), fact("links.other[]", "HTTP://x.org", order=2), fact("emails[]", "[1]", order=9, value_kind="array"))
    assert [(s["name"], len(s["sources"])) for s in p["skills"]] == [("TypeScript", 2)]
    assert p["emails"] == ["A@x.org"] and p["links"]["other"] == ["http://x.org//"]


def test_sparse_lists_close_their_gaps(spark):
    p = merged(spark, fact("experience[5].company", "A"), fact("experience[12].title", "T", order=2), fact("experience[].company", "no", order=3), fact("Education[2].END_YEAR", "2018", order=4), fact("years_experience", " ", order=5))
    assert [(e["company"], e["title"]) for e in p["experience"]] == [("A", None), (None, "T")]
    assert p["education"][0]["endYear"] == 2018.0 and p["yearsExperience"] == 0.0
    assert {s["path"] for s in p["seeds"]} >= {"experience[5].company", "experience[12].title"}


def test_agreement_ladder(spark):
    rows = [(0, 0, 0), (1, 1, 1), (2, 2, 2), (3, 1, 1), (3, 2, 1), (3, 3, 3)]
    got = spark.createDataFrame(rows, "n int, s int, m int").select(confidence.agreement(F.col("n"), F.col("s"), F.col("m"))).collect()
    assert [r[0] for r in got] == [0.65, 0.65, 0.9, 0.5, 0.35, 0.35]


def test_path_parser():
    assert parse(" a.b ") == ["a", "b"] and parse("skills[].name") == ["skills", "*", "name"] and parse("a[0][].b") == ["a", 0, "*", "b"]
    for path, code in {"": "PATH_EMPTY", "a..b": "PATH_INVALID_IDENTIFIER", "a[*]": "PATH_INVALID_INDEX", "a[1": "PATH_UNTERMINATED_BRACKET", "a-b": "PATH_INVALID_CHARACTER", "a.": "PATH_INVALID_IDENTIFIER"}.items():
        with pytest.raises(PathError) as e:
            parse(path)
        assert e.value.code == code


def test_path_resolution(spark):
    d = spark.createDataFrame([([("a", ["x", "y"]), ("b", None)],)], "skills array<struct<name:string,tags:array<string>>>")
    get = lambda path: d.select(resolve(path, d.schema).column).collect()[0][0]
    assert get("skills[1].name") == "b" and get("skills[].name") == ["a", "b"] and get("skills[].tags[]") == ["x", "y"] and get("skills[7].name") is None
    assert resolve("skills[0].no", d.schema).column is None
    with pytest.raises(PathError):
        resolve("skills[0].name[1]", d.schema)


def test_policies(spark):
    d = spark.createDataFrame([(1, "x", None)], "candidate_key int, a string, b string")
    fields = lambda required=False: [ProjectionField("o.a", "string", source="a"), ProjectionField("o.p[1].b", "string", required, source="b"), ProjectionField("n", "number", source="a")]
    out = {p: project(d, ProjectionConfig(fields(), on_missing=p)).collect()[0] for p in ("null", "omit", "error")}
    assert json.loads(out["null"].output) == {"o": {"a": "x", "p": [None, {"b": None}]}, "n": None}
    assert json.loads(out["omit"].output) == {"o": {"a": "x"}}
    assert [(e.code, e.path) for e in out["error"].errors] == [("PROJECTION_FIELD_MISSING", "o.p[1].b"), ("PROJECTION_FIELD_MISSING", "n")]
    required = project(d, ProjectionConfig(fields(True), on_missing="omit")).collect()[0]
    assert [e.code for e in required.errors] == ["PROJECTION_REQUIRED_FIELD_MISSING"]


def test_config_is_checked():
    assert not config_issues(read_config(MAPPED))
    bad = {"fields": [{"path": "a[]", "type": "text"}, {"path": "b", "type": "string", "mapping": "mapped"}, {"path": "b", "type": "string", "normalize": ["canonical", "canonical", "odd"]}], "onMissing": "never"}
    places = [p for p, _ in config_issues(read_config(bad))]
    assert sorted(set(places)) == ["fields.0.path", "fields.0.type", "fields.1.from", "fields.2.normalize", "fields.2.path", "onMissing"]
    assert config_issues(read_config({})) == [("fields", "At least one projection field is required.")]


def test_output_validation_and_strict_null(spark):
    config = ProjectionConfig([ProjectionField("a", "string"), ProjectionField("b", "number[]"), ProjectionField("c", "object", True)])
    rows = ['{"a":null,"b":[1,2],"c":{}}', '{"a":"x","b":["y"]}']
    d = spark.createDataFrame([(r,) for r in rows], "o string")
    strict = [[i.path for i in r[0]] for r in d.select(validate.output_issues(F.col("o"), config)).collect()]
    loose = [[i.path for i in r[0]] for r in d.select(validate.output_issues(F.col("o"), config, strict_null=False)).collect()]
    assert strict == [["a"], ["b", "c"]] and loose == [[], ["b", "c"]]


def test_provenance_of_an_output_is_validated(spark):
    config = ProjectionConfig([ProjectionField("a", "string")], include_provenance=True)
    entry = {"fieldPath": "emails[0]", "sourceKind": "ats_json", "sourceId": "s", "method": "regex_match", "sourceOrder": 1, "recordedAt": "2026-01-01T00:00:00Z", "evidence": None}
    rows = [json.dumps({"a": "x", "provenance": p}) for p in ([entry], [], [entry | {"method": "guess"}], [{}], 7)] + ['{"a":"x"}']
    got = [[i.path for i in r[0]] for r in spark.createDataFrame([(r,) for r in rows], "o string").select(validate.output_issues(F.col("o"), config)).collect()]
    assert got == [[], [], ["provenance"], ["provenance"], ["provenance"], ["provenance"]]
    with pytest.raises(ValueError):
        validate.output_issues(F.col("o"), ProjectionConfig([]))


def test_a_pdf_without_a_parser_is_an_error(spark, tmp_path):
    (tmp_path / "r.pdf").write_bytes(b"%PDF-1.4 ...")
    _, bad = records.parse_resumes(records.read_resumes(spark, str(tmp_path / "r.pdf"), "t"))
    assert [r.code for r in bad.collect()] == ["RESUME_PDF_PARSE_FAILED"]


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(RECORD))
    (tmp_path / "b.txt").write_bytes(b"\xef\xbb\xbfJane Doe\r\nx\x00@y.org")
    good, bad = records.parse_structured(records.read_structured(spark, str(tmp_path / "a.json"), "t"))
    assert good.select("candidate_key", "source_id", "email", "candidate_reference").collect()[0] == ("a", "ats:a.json", "jane.doe@acme.com", "cand-001") and bad.count() == 0
    texts, _ = records.parse_resumes(records.read_resumes(spark, str(tmp_path / "b.txt"), "t"))
    assert texts.select("text").collect()[0][0] == "Jane Doe\nx@y.org"
    pdf = records.read_pdf_resumes(spark, str(tmp_path / "b.txt"), "t", lambda raw: raw.decode("utf-8-sig"))
    assert pdf.select("text").collect()[0][0] == "Jane Doe\nx@y.org"
