import pytest
from pyspark.sql import functions as F

from clinrisk.schema import PATIENT_COLUMNS, PATIENT_SCHEMA
from clinrisk.scratch import scratch_path
from clinrisk.sources import derived, patients, requests, splits

ROWS = [
    (63, 1, 3, 145, 233, 1, 0, 150, 0, 2.3, 0, 0, 1, 1),
    (37, 1, 2, 130, 250, 0, 1, 187, 0, 3.5, 0, 0, 2, 1),
    (41, 0, 1, 130, 204, 0, 0, 172, 0, 1.4, 2, 0, 2, 0),
]


def write_csv(path, header, lines):
    path.write_text("\n".join([",".join(header), *lines]) + "\n")


def test_read_patients_has_declared_types(spark, tmp_path):
    write_csv(tmp_path / "p.csv", PATIENT_COLUMNS, [",".join(map(str, r)) for r in ROWS])
    df = patients.read_patients(spark, str(tmp_path / "p.csv"))
    assert len(df.columns) == 14 and df.schema == PATIENT_SCHEMA
    assert [tuple(r) for r in df.orderBy("age").collect()] == sorted(ROWS)
    assert patients.validate_schema(df)


def test_columns_are_matched_by_name_and_extras_kept(spark, tmp_path):
    header = ["note", *reversed(PATIENT_COLUMNS)]
    write_csv(tmp_path / "p.csv", header, ["x," + ",".join(map(str, reversed(ROWS[0])))])
    df = patients.read_patients(spark, str(tmp_path / "p.csv"))
    row = df.first()
    assert row["age"] == 63 and row["oldpeak"] == 2.3 and row["note"] == "x"
    assert patients.validate_schema(df)


def test_malformed_fields_and_nan_become_null(spark, tmp_path):
    bad = ["abc" if c == "age" else "NaN" if c == "oldpeak" else "1" for c in PATIENT_COLUMNS]
    write_csv(tmp_path / "p.csv", PATIENT_COLUMNS, [",".join(bad)])
    row = patients.read_patients(spark, str(tmp_path / "p.csv")).first()
    assert row["age"] is None and row["oldpeak"] is None and row["sex"] == 1


def test_missing_path_and_missing_columns(spark):
    with pytest.raises(FileNotFoundError):
        patients.read_patients(spark, "/tmp/no/such/file.csv")
    with pytest.raises(ValueError, match="Missing columns"):
        patients.validate_schema(spark.createDataFrame([(1,)], "age int"))


def test_type_report(spark):
    df = spark.createDataFrame([("1", 2)], "age string, sex int")
    assert patients.type_report(df) == {"age": ("int", "string")}


def test_profile(spark):
    df = spark.createDataFrame([*ROWS, (None, *ROWS[0][1:])], PATIENT_SCHEMA)
    rows = {r["column"]: r for r in patients.profile(df).collect()}
    assert rows["age"]["n_missing"] == 1 and rows["sex"]["n_missing"] == 0
    assert rows["age"]["n_rows"] == 4 and rows["age"]["n_columns"] == 14 and rows["oldpeak"]["dtype"] == "double"
    assert patients.estimated_megabytes(df) > 0


def test_split_tables_prune_partitions(spark):
    df = spark.createDataFrame([(i, "train" if i < 6 else "val") for i in range(8)], "k int, split string")
    path = scratch_path(spark, "splits")
    splits.save_splits(df, path)
    assert {r["k"] for r in splits.load_splits(spark, path, "val").collect()} == {6, 7}
    assert splits.load_splits(spark, path, "test").count() == 0
    plan = splits.load_splits(spark, path, "val")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_parse_requests(spark):
    bodies = ['{"age": 55, "sex": 1}', "{bad", '"text"', '{"age": null, "oldpeak": "x"}', None]
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    rows = {r["id"]: r for r in requests.parse_requests(df).collect()}
    assert rows[0]["age"] == 55 and rows[0]["missing"][0] == "cp" and len(rows[0]["missing"]) == 11
    assert not rows[1]["valid_json"] and rows[1]["missing"] is None
    assert not rows[2]["valid_json"] and not rows[4]["valid_json"]
    assert "age" not in rows[3]["missing"] and rows[3]["age"] is None


def test_derived_tables_are_row_local(spark, sf):
    for build in (derived.patients, derived.patients_raw, derived.predictions, derived.payloads, derived.batch_requests,
                  derived.model_versions):
        plan = build(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
    sizes = {r[0] for r in derived.batch_requests(spark, sf).select(F.size("patients")).distinct().collect()}
    assert sizes == {0, 1, 2, 3, 4, 101}


def test_numbers_in_payloads(spark):
    from clinrisk.schema import REQUEST_COLUMNS
    from clinrisk.sources.requests import parse_requests

    def body(age):
        return "{" + ", ".join(f'"{c}": {age if c == "age" else 1}' for c in REQUEST_COLUMNS) + "}"

    bodies = [body(a) for a in ("55", "55.0", "5.5e1", "55.5", '"x"', '"NaN"', "null", "3000000000", "true")]
    rows = parse_requests(spark.createDataFrame(list(enumerate(bodies)), "i int, body string")).orderBy("i").collect()
    assert [r.age for r in rows] == [55, 55, 55, None, None, None, None, None, None]
    assert [r.invalid for r in rows] == [[], [], [], ["age"], ["age"], ["age"], [], ["age"], ["age"]]
    assert all(r.missing == [] and r.valid_json and r.oldpeak == 1.0 for r in rows)


def test_csv_files_with_different_headers_and_bad_lines(spark, tmp_path):
    from clinrisk.sources.patients import malformed, read_patients

    (tmp_path / "a.csv").write_text("age,sex,note\n50,1,x\n60,0,\"y, z\"\n")
    (tmp_path / "b.csv").write_text("sex,age\n1,70\n0\n1,80,9\n1,old\n")
    df = read_patients(spark, str(tmp_path), corrupt=True)
    rows = {(r.age, r.sex, r.note) for r in df.where("_corrupt_record IS NULL").collect()}
    assert rows == {(50, 1, "x"), (60, 0, "y, z"), (70, 1, None)}
    assert malformed(df).first().asDict() == {"n_rows": 6, "n_malformed": 3, "n_age": 4, "n_sex": 6, "n_note": 2}
