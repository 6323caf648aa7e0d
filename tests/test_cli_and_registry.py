import json

import __spark_entry__ as entry
from factloom import cli


def test_cli(spark, tmp_path, capsys):
    assert cli.main([]) == 1
    assert cli.main(["transform", "--ats", " "]) == 1 and "CLI_OPTION_ATS_MISSING" in capsys.readouterr().err
    ats, resume, config, out = (tmp_path / n for n in ("a.json", "r.txt", "c.json", "o.json"))
    ats.write_text('{"name": "Jane Doe", "email": "j@x.org"}')
    resume.write_text("Jane A. Doe\nj@x.org\n")
    config.write_text('{"fields": [{"path": "name", "type": "string", "required": true, "from": "fullName"}], "onMissing": "omit"}')
    assert cli.main(["transform", "--ats", str(ats), "--resume", str(resume), "--config", str(config), "--output", str(out)]) == 0
    assert json.loads(out.read_text()) == {"name": "Jane Doe"}
    config.write_text("{")
    assert cli.main(["transform", "--ats", str(ats), "--resume", str(resume), "--config", str(config)]) == 1


def test_registry_names_and_sql():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and "full_pipeline" in queries


def test_every_event_type_is_a_field(spark, tmp_path):
    rows = [(1, i, f"type{i:04d}") for i in range(1100)] + [(2, 5000, "type1099")]
    spark.createDataFrame(rows, "user_id long, event_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = entry.queries()["field_provenance_lookup"](spark, str(tmp_path)).collect()
    assert len(got) == 2 * 1100 and sum(r.n for r in got) == 1101
