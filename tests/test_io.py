"""Sources with awkward inputs."""

import json
import os
import tempfile

from lingualens.sources import io


def test_missing_table_loads_empty(spark):
    df = io.load(spark, "/nonexistent/lingualens/table", io.RESULTS)
    assert df.count() == 0
    assert df.columns == ["model", "bcp_47", "task", "metric", "score", "origin"]


def test_json_array_with_mixed_types(spark):
    d = tempfile.mkdtemp(prefix="ll-io-")
    path = os.path.join(d, "datasets.json")
    rows = [{"name": "a", "n_languages": 14, "tasks": ["mmlu"]},
            {"name": "b", "n_languages": "14", "tasks": ["arc", "mgsm"]},
            {"name": "c", "n_languages": None, "tasks": []}]
    with open(path, "w") as f:
        json.dump(rows, f)
    out = {r.name: r.n_languages for r in io.read_json_array(spark, path).collect()}
    assert out == {"a": 14, "b": 14, "c": None}


def test_csv_only_empty_is_missing(spark):
    d = tempfile.mkdtemp(prefix="ll-io-")
    path = os.path.join(d, "languoid.csv")
    with open(path, "w") as f:
        f.write("id,family_id,name,iso639P3code\nx1,,Nan,nan\nx2,f1,NA,\n")
    out = io.read_csv_na_empty_only(spark, path, io.LANGUOID).orderBy("id").collect()
    assert out[0].name == "Nan" and out[0].family_id is None
    assert out[1].name == "NA" and out[1].iso639P3code is None


def test_tsv_without_header(spark):
    d = tempfile.mkdtemp(prefix="ll-io-")
    path = os.path.join(d, "dev.tsv")
    with open(path, "w") as f:
        f.write("1\ta.wav\tHello\thello\th e l l o\t1\tF\n")
    r = io.read_tsv(spark, path).first()
    assert (r.id, r.fname, r.transcription, r.gender) == ("1", "a.wav", "hello", "F")
