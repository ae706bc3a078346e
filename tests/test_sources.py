import json

from mathloom.sources import files
from mathloom.sources import records as R


def test_file_layouts(spark, tmp_path):
    cm = tmp_path / "cm.json"
    cm.write_text(json.dumps([{"id": "f1", "original_text": "一 次 函 数 的 图 象 经 过 4 点", "equation": "x=2*4+3", "ans": "11", "type": "nonlinear"}, {"id": "a1", "original_text": "小 明 有 3 本", "equation": "x=3", "ans": 3, "type": "arithmetic"}], ensure_ascii=False))
    ape = tmp_path / "x.jsonl"
    ape.write_text('{"id": "7", "original_text": "有5个", "equation": "x=5"}\n{"pid": 9, "text": "有6个"}\n{"id": "8", "origi\n')
    math = tmp_path / "m" / "train" / "algebra"
    math.mkdir(parents=True)
    (math / "1.json").write_text(json.dumps({"problem": "Let $f(x)=2x$. [asy]draw();[/asy]", "level": "Level 2", "type": "Algebra", "solution": "so \\boxed{30}"}))
    geo = tmp_path / "g" / "12"
    geo.mkdir(parents=True)
    (geo / "data.json").write_text(json.dumps({"id": 12, "problem_text": "Find x.", "annotat_text": "Find $x$.", "choices": ["1", "2", "3", "4"], "answer": "B", "problem_type_graph": ["Triangle"], "problem_type_goal": ["Length"], "data_type": "train", "logic_form": {"text_logic_form": ["Find(x)"], "diagram_logic_form": []}}))
    assert [files.detect_source(p) for p in (cm, ape, tmp_path / "m", tmp_path / "g")] == ["cm17k", "ape", "math", "geometry3k"]
    got = {r.id: r for p in (cm, ape, tmp_path / "m") for r in files.read_source(spark, str(p)).collect()}
    assert got["cm17k-f1"].kind == "function" and got["cm17k-a1"].kind == "algebra" and "一次函数" in got["cm17k-f1"].original_text
    assert {"7", "9"} <= got.keys() and "8" not in got
    m = got["math-train-algebra-1"]
    assert m.kind == "function" and m.ans == "30" and "asy" not in m.original_text
    g = files.read_source(spark, str(tmp_path / "g")).first()
    assert (g.id, g.original_text, g.ans, g.split) == ("g3k-12", "Find x.", "2", "train") and "Triangle" in g.normalized_text


def test_first_of_each(spark):
    raw = spark.createDataFrame([(1, "ape", '{"id":"a","original_text":"有1个"}'), (2, "ape", '{"id":"a","original_text":"有2个"}'), (3, "ape", '{"id":"b","original_text":"有3个"}')], "line_no long, source string, record string")
    items = R.word_problems(raw)
    rows = R.first_of_each([items, items]).select("id", "pos").orderBy("pos").collect()
    assert [tuple(r) for r in rows] == [("a", 1), ("b", 3)]
    assert R.first_of_each([items, items], 1).count() == 1


def test_json_files_with_one_object_a_line(spark, tmp_path):
    ape = tmp_path / "x.ape.json"
    ape.write_text('{"id": "1", "original_text": "有5个"}\n\n{"id": "2", "original_text": "有6个"}\r\n{"id": "3", "original_text": "有7个"}\n{"id": "4", "origi\n')
    got = files.read_source(spark, str(ape)).select("id", "original_text").orderBy("pos").collect()
    assert [tuple(r) for r in got] == [("1", "有5个"), ("2", "有6个"), ("3", "有7个")]
    math = tmp_path / "m" / "train" / "algebra"
    math.mkdir(parents=True)
    two = "".join(json.dumps({"problem": f"Find {n}.", "level": "Level 1", "type": "Algebra", "solution": f"\\boxed{{{n}}}"}) + "\n" for n in (1, 2))
    (math / "all.json").write_text(two)
    (math / "geometry_test.json").write_text(two)
    got = files.read_source(spark, str(tmp_path / "m")).select("id", "ans").collect()
    want = {("math-train-algebra-0", "1"), ("math-train-algebra-1", "2"), ("math-test-geometry-0", "1"), ("math-test-geometry-1", "2")}
    assert {tuple(r) for r in got} == want
