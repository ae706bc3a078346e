"""Page texts, reports, evaluation folders, fetching, serving."""

import json
import tarfile
import threading
import urllib.error
import urllib.parse
import urllib.request
import zipfile

import pytest
from pyspark.sql import functions as F

from mathloom import cli
from mathloom.functions import text as T
from mathloom.functions import typeset as P
from mathloom.operators import report
from mathloom.operators.index import Index
from mathloom.serve import server
from mathloom.sources import fetch, files, layout


def one(spark, make, *values):
    names = "abc"[: len(values)]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(make(*map(F.col, names))).first()[0]


@pytest.mark.parametrize("text,want", [
    (r"Find $\frac{1}{2}$ of \[x^{10}\].", "Find (1)/(2) of x^10 ."), ("a\r\n\r\n  b  c", "a\nb c"), (r"\begin{cases}x\\y\end{cases}", "x\ny"), (r"\sqrt{4} \leq \log_{2} 8", "sqrt(4) <= log_2 8"),
    (r"90^\circ \angle", "90 degrees"), (r"\frac{\frac{a}{b}}{c}", "((a)/(b))/(c)"), (None, ""), ("", ""), (r"\left(\text{so }x\right)", "(so x)"),
])
def test_plain_text_of_latex(spark, text, want):
    assert one(spark, P.latex_to_plain, text) == want


def test_page_bodies(spark):
    assert one(spark, P.page_body, "5% [asy]draw();[/asy]\n\n\n\n$$x$$ 6\\%", "math") == "5\\% \n\n\\[x\\] 6\\%"
    assert one(spark, P.page_body, r"\angle A is \frac{1}{2}", "geometry3k") == r"$\angle$ A is $\frac{1}{2}$"
    assert one(spark, P.page_body, r"\angle A is $x$", "geometry3k") == r"\angle A is $x$" == one(spark, P.page_body, r"\angle A is $x$", "math")
    assert one(spark, P.page_body, None, None) == ""
    assert [one(spark, P.shown_text, t, s, "id7") for t, s in [(r"\sin x", "ape"), (r"求\sin x", "ape"), (r"求\sin x", "math"), ("  ", "ape"), (None, None)]] == ["sin x", r"求\sin x", "求sin x", "id7", "id7"]
    assert one(spark, lambda a, b: P.competition_id(a, b), "number_theory_test", "4") == "math-test-number-theory-4"


LOG = "row_id long, id string, source string, kind string, phase string, hit boolean, first boolean, gold_original boolean, empty boolean, extra_originals int, returned int, query_text string, results array<struct<id:string,relation:string,final:double>>, error string, elapsed_s double"


def test_reports_and_reruns(spark, tmp_path):
    rows = [(i, f"i{i}", "ape" if i % 2 else "math", "algebra", "text", i > 2, i > 3, i > 2, False, int(i == 5), 1, "q\nq", [("x", "original", 1.25)], "bad" if i == 1 else None, 0.5) for i in range(8)]
    log = spark.createDataFrame(rows, LOG)
    made = report.write_report(log, str(tmp_path))
    assert made == json.loads((tmp_path / "report.json").read_text()) == report.load_report(str(tmp_path))
    assert made["text"]["all"]["samples"] == 8 and list(made["text"]["by"]["source"]) == ["ape", "math"] and made["text"]["failures"]["miss"]["n"] == 3
    page = (tmp_path / "report.md").read_text()
    assert "| ape | 4 |" in page and "error: bad" in page and "x:original/1.250" in page and "q q" in page
    again = log.where("source = 'ape'").withColumn("hit", F.lit(True))
    new = report.write_report(again, str(tmp_path), ["ape"])
    assert new["text"]["by"]["source"]["math"] == made["text"]["by"]["source"]["math"]
    assert new["text"]["all"]["samples"] == 8 and new["text"]["all"]["hit"] == 4 + made["text"]["by"]["source"]["math"]["hit"]
    (tmp_path / "report.json").write_text("{cut")
    assert report.load_report(str(tmp_path)) is None
    assert report.write_report(log.limit(0), str(tmp_path / "none")) == {}


def test_evaluation_folders(spark, tmp_path):
    base = str(tmp_path / "e")
    assert layout.parse_sources(" math, APE ") == ("ape", "math") and layout.parse_sources(None) == ("ape", "cm17k", "geometry3k", "math")
    with pytest.raises(ValueError):
        layout.parse_sources("ape,else")
    flat = spark.createDataFrame([("a", "ape"), ("b", None), ("c", None)], "id string, source string")
    flat.write.parquet(str(tmp_path / "flat"))
    tasks = spark.createDataFrame([("b", "math")], "id string, source string")
    assert layout.split_flat(spark, str(tmp_path / "flat"), base, tasks, "text") == {"ape": 1, "math": 1, "unknown": 1}
    assert layout.split_flat(spark, str(tmp_path / "flat"), base, tasks, "text") == {}
    layout.append_results(flat.where("id = 'a'"), base, "ape", "text")
    assert spark.read.parquet(layout.results_path(base, "ape", "text")).count() == 2
    layout.clear_results(base, "text", ("ape",))
    assert layout.split_flat(spark, str(tmp_path / "flat"), base, tasks, "text") == {"ape": 1}
    assert layout.image_paths(spark.createDataFrame([("t/a", "math")], "id string, source string"), "/x").first().image_path == "/x/math/images/t_a.png"


def test_fetching(tmp_path):
    box = tmp_path / "from"
    box.mkdir()
    (box / "a.json").write_text('{"id": 1}')
    with zipfile.ZipFile(box / "z.zip", "w") as z:
        z.write(box / "a.json", "in/a.json")
    with tarfile.open(box / "t.tar.gz", "w:gz") as t:
        t.add(box / "a.json", "tar/a.json")
    to = tmp_path / "to"
    addresses = {n: (box / n).as_uri() for n in ("a.json", "z.zip", "t.tar.gz")}
    for _ in range(2):
        fetch.fetch(addresses, to)
        assert (to / "in/a.json").exists() and (to / "tar/a.json").exists() and not list(to.glob("*.part"))
        (box / "a.json").unlink(missing_ok=True)  # nothing is fetched twice
    with pytest.raises(urllib.error.URLError):
        fetch.download((box / "none").as_uri(), to / "none")
    assert not (to / "none").exists()
    assert not fetch.math_is_whole(to) and not fetch.math_is_whole(tmp_path / "nowhere")
    for p in fetch.math_files(to, ("train", "test")):
        p.write_text('\n {"problem": "x"}')
    assert fetch.math_is_whole(to)
    bad = fetch.math_files(to, ("test",))[0]
    bad.write_text("<html>")
    assert not fetch.math_is_whole(to) and fetch.clear_cut_files(to) == [bad] and not bad.exists()
    assert cli.main(["fetch", str(tmp_path / "c"), "a.json=" + (to / "a.json").as_uri()]) == 0 and (tmp_path / "c/a.json").exists()


def test_lines_of_split_files_keep_their_place(spark, tmp_path):
    """A file that Spark cuts into many splits gives the numbers that its lines have in the file."""
    for name, n in (("b.jsonl", 500), ("a.jsonl", 30)):
        (tmp_path / name).write_text("".join(f'{{"id": "{name}{i}", "original_text": "有{i}个"}}\n' + ("\n" if i % 7 == 0 else "") for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = files.numbered(files.raw_records(spark, str(tmp_path))).orderBy("pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.pos for r in rows] == list(range(530))
    assert [json.loads(r.record)["id"] for r in rows] == [f"a.jsonl{i}" for i in range(30)] + [f"b.jsonl{i}" for i in range(500)]
    assert files.read_source(spark, str(tmp_path / "b.jsonl"), limit=3).count() == 3


def test_serving(spark, tmp_path):
    image = tmp_path / "f.png"
    image.write_bytes(b"png")
    rows = [(0, "s", "学校买来15个足球，每个45元，一共要付多少元？", str(image)), (1, "t", "一辆汽车3小时行驶180千米，5小时行驶多少千米？", None)]
    items = spark.createDataFrame(rows, "pos long, id string, original_text string, image string").withColumn("normalized_text", T.normalize(F.col("original_text")))
    items = items.withColumn("structure_text", T.structure(F.col("normalized_text"))).withColumn("source", F.lit("ape"))
    Index.build(items).save(str(tmp_path / "i"))
    web = server(spark, Index.load(spark, str(tmp_path / "i")), port=0)
    thread = threading.Thread(target=web.serve_forever, daemon=True)
    thread.start()
    at = f"http://127.0.0.1:{web.server_port}"
    get = lambda p: urllib.request.urlopen(at + p).read()
    ask = lambda **form: json.loads(urllib.request.urlopen(at + "/v1/search", urllib.parse.urlencode(form).encode()).read())
    try:
        assert json.loads(get("/health")) == {"status": "ok", "items": 2, "sources": {"ape": 2}}
        assert json.loads(get("/item?id=t"))["source"] == "ape" and get("/image?id=s") == b"png"
        found = ask(text=rows[0][2])
        assert [r["id"] for r in found["results"]] == ["s"] and found["originals"] == 1 and found["recalled"] == 2
        assert ask(text=rows[0][2], math_ocr="off")["results"][0]["formula"] is None
        for bad, code in ((lambda: get("/image?id=t"), 404), (lambda: get("/item?id=zz"), 404), (lambda: ask(text=" "), 400)):
            with pytest.raises(urllib.error.HTTPError) as e:
                bad()
            assert e.value.code == code
    finally:
        web.shutdown()
        web.server_close()
