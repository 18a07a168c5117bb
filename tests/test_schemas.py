"""Shards of different stages read together; conflicts name field and files."""

import itertools
import json

import pytest
from pyspark.sql import types as T

from tidewell.sources import schemas


def written(folder, name, rows):
    path = f"{folder}/{name}.jsonl"
    with open(path, "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)
    return path


ONE = {"id": 0, "pre_query_template": "t", "instruction": "i", "response": None, "created": 1, "gen_input_configs": {"temperature": 1, "top_p": 1.0, "input_generator": "m", "seed": None}, "gen_response_configs": None}
TWO = ONE | {"response": "r", "gen_response_configs": {"prompt": "p", "temperature": 0, "top_p": 1, "repetition_penalty": 1, "max_tokens": 5, "stop_tokens": [], "output_generator": "m", "engine": "e"}}
STAGES = [
    ONE,
    TWO,
    TWO | {"instruction_2": "i2", "response_2": "r2"},
    TWO | {"intent": "x", "knowledge": None, "difficulty": "easy", "difficulty_generator": "g"},
    TWO | {"input_quality": "good", "quality_explanation": "q", "quality_generator": "g"},
    TWO | {"task_category": "Math", "other_task_category": ["a"], "task_category_generator": "g"},
    TWO | {"llama_guard_2": "safe"},
    TWO | {"instruct_reward": 3, "reward_model": "rm"},
    TWO | {"instruct_reward": 2.5, "reward_model": "rm", "language": "EN"},
]


@pytest.mark.parametrize("backwards", [False, True])
def test_shards_of_nine_stages(spark, tmp_path, backwards):
    order = STAGES[::-1] if backwards else STAGES
    paths = [written(tmp_path, i, [s]) for i, s in enumerate(order)]
    got = sorted(schemas.read_stages(spark, paths).collect(), key=lambda r: r.file_idx)
    names = {n for s in STAGES for n in s}
    for r, s in zip(got, order, strict=True):
        row = r.asDict(True)
        assert set(row) == names | {"file_idx"}
        for n in names:
            assert row[n] == s.get(n), n
    for stage in schemas.STAGES:
        assert schemas.missing(T.StructType.fromJson(json.loads(schemas.read_stages(spark, paths).schema.json())), stage) == []
    assert schemas.missing(schemas.stage_schema("instructions"), "reward") == ["instruct_reward", "reward_model"]


def test_empty_everywhere_stays(spark, tmp_path):
    paths = [written(tmp_path, n, rows) for n, rows in (("a", [{"x": None, "y": []}]), ("b", [{"x": None}, {"z": {"k": None}}]), ("c", []))]
    got = schemas.read_stages(spark, paths)
    assert set(got.columns) >= {"x", "y"} and got.count() == 3 and all(r.x is None for r in got.collect())


def test_late_types_count(spark, tmp_path):
    """Null in one file, a struct in the second, an array of structs in both but empty in one."""
    a = written(tmp_path, "a", [{"s": None, "l": []}, {"s": None, "l": []}])
    b = written(tmp_path, "b", [{"s": {"k": 1}, "l": [{"score": 1}]}])
    c = written(tmp_path, "c", [{"s": {"k": 1.5, "m": "x"}, "l": [{"score": 0.5}]}])
    for order in itertools.permutations([a, b, c]):
        got = {order[r.file_idx]: (r.s and (r.s.k, r.s.m), [x.score for x in r.l]) for r in schemas.read_stages(spark, list(order)).where("file_idx is not null").dropDuplicates(["file_idx"]).collect()}
        assert got == {a: (None, []), b: ((1.0, None), [1.0]), c: ((1.5, "x"), [0.5])}


def test_conflicts_name_field_and_files(spark, tmp_path):
    a, b, c = written(tmp_path, "a", [{"s": {"k": [{"v": "text"}]}}]), written(tmp_path, "b", [{"t": 1}]), written(tmp_path, "c", [{"s": {"k": [{"v": 1}]}}])
    with pytest.raises(ValueError, match=r"s\.k\[\]\.v: string and bigint.*a\.jsonl and .*c\.jsonl disagree"):
        schemas.read_stages(spark, [a, b, c])
    with pytest.raises(ValueError, match=r"field S \(also s\)"):
        schemas.read_stages(spark, [a, written(tmp_path, "d", [{"S": {"k": None}}])])


PARTS = [T.NullType(), T.StringType(), T.LongType(), T.DoubleType(), T.DecimalType(22, 0), T.ArrayType(T.LongType()), T.ArrayType(T.NullType()), T.StructType().add("a", "long"), T.StructType().add("b", "string").add("a", "double"), T.MapType(T.StringType(), T.LongType())]


def test_upper_bounds_form_a_lattice():
    def up(*of):
        try:
            out = of[0]
            for t in of:
                out = schemas.upper(out, t)
            return sorted(out.fieldNames()) + [{f.name: f.dataType for f in out}] if isinstance(out, T.StructType) else out
        except schemas.Conflict:
            return None

    for x, y in itertools.product(PARTS, PARTS):
        assert up(x, y) == up(y, x)
        assert up(x, x, y) == up(x, y, y)
    for x, y, z in itertools.product(PARTS, PARTS, PARTS):
        assert up(x, y, z) == up(z, x, y)
    assert up(T.LongType(), T.DecimalType(22, 2)) == T.DecimalType(22, 2) and up(T.DecimalType(38, 0), T.DecimalType(20, 10)) == T.DoubleType()
