import io
import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scenelake.sources import jsonlist

SCHEMA = "token STRING, n INT, deep ARRAY<ARRAY<DOUBLE>>, own STRUCT<a: STRING>"


def made(n, seed=0):
    draw = random.Random(seed)
    nasty = ['"', "\\", "{", "}", "[", "]", "é", "\n", "\\\"", "a", "]}", " ", "\U0001f600", "\\" * 5]
    text = lambda: "".join(draw.choices(nasty, k=draw.randrange(12)))
    return [
        {"token": text(), "n": i, "deep": [[0.5] * draw.randrange(3)] * draw.randrange(3), "own": {"a": text()}, "unread": [{"x": text()}]}
        for i in range(n)
    ]


@pytest.mark.parametrize("indent,ascii", [(None, True), (None, False), (1, False)])
def test_every_cut_gives_the_same_objects(indent, ascii):
    rows = made(12)
    data = json.dumps(rows, indent=indent, ensure_ascii=ascii).encode()
    file = pa.PythonFile(io.BytesIO(data), mode="r")
    for width in (1, 2, 3, 7, 50, 333, len(data), len(data) + 9):
        found, inside, depth = [], False, 0
        for start in range(0, len(data), width):
            end = min(start + width, len(data))
            found += jsonlist.objects(file, start, end, inside, depth)
            part = jsonlist._bytes(file, start, end)
            outside = jsonlist._outside(part, inside)
            depth += int(jsonlist._steps(part)[outside].sum())
            inside ^= len(jsonlist._quotes(part)) % 2 == 1
        assert [json.loads(x) for x in found] == rows, width
        assert (inside, depth) == (False, 0)


def test_one_list_by_many_tasks(spark, tmp_path):
    rows = made(400, 3)
    folder = tmp_path / "a folder with % 20"
    folder.mkdir()
    (folder / "t.json").write_text(json.dumps(rows, indent=0, ensure_ascii=False))
    got = jsonlist.read_json_list(spark, str(folder), SCHEMA, range_bytes=1000)
    assert sorted((r.n, r.token, r.own.a, r.deep) for r in got.collect()) == [
        (r["n"], r["token"], r["own"]["a"], r["deep"]) for r in rows
    ]
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 5


def test_empty_and_broken_lists(spark, tmp_path):
    for name, text in (("empty", ""), ("none", "[]"), ("blank", " \n")):
        (tmp_path / f"{name}.json").write_text(text)
        assert jsonlist.read_json_list(spark, str(tmp_path / f"{name}.json"), SCHEMA).count() == 0
    (tmp_path / "cut.json").write_text('[{"n": 1}, {"n": 2')
    with pytest.raises(Exception, match="ends inside an object"):
        jsonlist.read_json_list(spark, str(tmp_path / "cut.json"), SCHEMA).collect()
    (tmp_path / "bad.json").write_text('[{"n": 1}, {"n": oops}]')
    with pytest.raises(Exception, match="(?i)malformed"):
        jsonlist.read_json_list(spark, str(tmp_path / "bad.json"), SCHEMA).collect()
