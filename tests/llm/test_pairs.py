"""Problems 3, 5, 7 and 10 against brute force on small tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mathloom.llm import near, spans, vectors
from mathloom.llm import shingles as S


def edited(rng, text, n):
    t = list(text)
    for _ in range(n):
        k = rng.randrange(len(t))
        t[k] = rng.choice("abcdefgh")
    return "".join(t)


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(4)
    rows = []
    for g in range(40):
        base = "".join(rng.choice("abcdefghijklmnop     ") for _ in range(rng.randint(30, 200)))
        for k in range(rng.randint(1, 4)):
            rows.append((edited(rng, base, k * 3), rng.choice(["train", "Test ", "dev", None]), rng.choice(["math", "ape", "geometry3k", None])))
    hot = "the same question of a hot group, asked again and again"
    rows += [(hot.upper() if i % 2 else hot, "train" if i % 3 else "test", "math") for i in range(60)]
    rows += [(None, "train", "math"), ("", "test", "math"), ("short", "test", "ape"), ("short", "train", "ape"), ("苔" * 5000, "train", "ape"), ("苔" * 5000 + "b", "test", "ape")]
    data = [(i * 3, t, (t or "").replace("a", "NUM") if t is not None else None, s, src, "extra") for i, (t, s, src) in enumerate(rows)]
    return spark.createDataFrame(data, "pos long, original_text string, structure_text string, split string, source string, rep string").cache()


def similar(a, b):
    x, y = S.gram_set(a), S.gram_set(b)
    return bool(x and y) and len(x & y) / len(x | y) >= 0.7


def test_groups_equal_brute_force(items):
    rows = items.collect()
    parent = {r.pos: r.pos for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(rows):
        for b in rows[:i]:
            free = a.source != "geometry3k" and b.source != "geometry3k"
            if similar(a.original_text, b.original_text) or (free and similar(a.structure_text, b.structure_text)):
                x, y = root(a.pos), root(b.pos)
                parent[max(x, y)] = min(x, y)
    want = {(root(p), p) for p in parent if root(p) != p}
    assert {tuple(r) for r in near.found_groups(items).collect()} == want
    every = near.near_duplicate_groups(items).collect()
    assert {(r.group_pos, r.pos) for r in every if r.group_pos != r.pos} == want and len(every) == len(rows)


def test_overlaps_equal_brute_force(items):
    rows = [r for r in items.collect() if r.split]
    want = set()
    for i, a in enumerate(rows):
        for b in rows[:i]:
            if (a.split == "train") != (b.split == "train") and similar(a.original_text, b.original_text):
                want.add((min(a.pos, b.pos), max(a.pos, b.pos)))
    assert {tuple(r) for r in near.found_overlaps(items).collect()} == want
    report = near.overlap_report(items).collect()
    assert sum(r.train_rows for r in report) == len(want) and {r.split for r in report} == {"test", "dev"}


def templated(rng, n):
    """Texts of one template: the same sentences with other names and numbers, about 0.3 similar."""
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    return [f"{word()} hires {word()} for {rng.randint(10, 99)} days to mend the broken baskets of {word()}. How many baskets does {word()} mend?" for _ in range(n)]


@pytest.fixture
def tested(monkeypatch):
    """Numbers of pairs that came to the verification."""
    seen, real = [], near.verified
    monkeypatch.setattr(near, "verified", lambda pairs, *a: (seen.append(pairs.count()), real(pairs, *a))[1])
    return seen


def test_overlaps_verify_few_texts_of_one_template(spark, tested):
    texts = templated(random.Random(3), 300)
    sims = [len(S.gram_set(a) & S.gram_set(b)) / len(S.gram_set(a) | S.gram_set(b)) for a, b in zip(texts, texts[1:])]
    assert 0.25 < np.mean(sims) < 0.35
    rows = [(i, t, "train" if i % 2 else "test", "math") for i, t in enumerate([*texts, texts[7] + " again"])]
    df = spark.createDataFrame(rows, "pos long, original_text string, split string, source string")
    assert [tuple(r) for r in near.found_overlaps(df).collect()] == [(7, 300)]
    assert tested[0] < 0.1 * 150 * 151


def test_groups_verify_few_texts_of_one_template_and_leave_no_shuffle(spark, tested, monkeypatch):
    """Also the disk: the signatures are joined in several writes, each of which deletes what it shuffled."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {n for f in disk.getAllFiles().mkString("\n").split("\n") if (n := f.rpartition("/")[2]).startswith("shuffle_") and n.endswith(".data")}
    left, real, before = [], near.materialize, shuffled()

    def watched(df, tag):
        made = real(df, tag)
        left.append(shuffled() - before)
        before.update(left[-1])
        return made

    monkeypatch.setattr(near, "materialize", watched)
    texts = templated(random.Random(3), 300)
    rows = [(i, t, None, "math") for i, t in enumerate([*texts, texts[7] + " again"])]
    df = spark.createDataFrame(rows, "pos long, original_text string, structure_text string, source string")
    _, _, links = near.similarity_links(near.near_duplicate_rows(df), ["original_text", "structure_text"])
    assert [tuple(r) for r in links.collect()] == [(0, 7, 300)]
    assert tested[0] < 0.1 * 300 * 301 / 2
    assert sum(map(len, left)) <= 2 * len(left)  # what counts on the way shuffled stays: a row or two each


def test_empty_tables(items):
    none = items.limit(0)
    assert near.found_groups(none).count() == 0 and near.found_overlaps(none).count() == 0 and near.overlap_report(none).count() == 0


def test_figures_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = (rng.random((30, 256)) < 0.2) * 1.0
    rows = []
    for i in range(160):
        v = base[i % 30].copy()
        v[rng.integers(0, 256, rng.integers(0, 6))] += rng.random()
        h = f"{int(rng.integers(0, 3)) * 0x1111111111111111 ^ (1 << int(rng.integers(0, 6))):016x}"
        rows.append((i, [float(x) for x in v * rng.choice([1.0, 255.0])], h.upper() if i % 2 else h))
    rows += [(500 + i, [float(x) for x in base[0]], "0" * 16) for i in range(9)]
    rows += [(600, None, None), (601, [0.0] * 256, "n/a"), (602, [float("nan")] * 256, ""), (603, [1.0] * 255, "12345"), (604, [float("inf")] + [1.0] * 255, "g" * 16)]
    df = spark.createDataFrame(rows, "pos long, diagram_vector array<float>, phash string").withColumn("other", F.lit(1))
    got = {}
    for r in vectors.nearest_figures(df).collect():
        got.setdefault((r.field, r.pos), []).append((r.rank, r.other))
    ok = [(p, np.array(v, np.float32).astype(float)) for p, v, _ in rows if v and len(v) == 256 and np.isfinite(v).all() and np.any(v)]
    pos = np.array([p for p, _ in ok])
    u = np.array([v / np.linalg.norm(v) for _, v in ok])
    sim = np.round(u @ u.T, 6)
    for i, p in enumerate(pos):
        order = [j for j in np.lexsort((pos, -sim[i])) if j != i and sim[i, j] >= 0.9][:5]
        assert [o for _, o in sorted(got.get(("diagram_vector", p), []))] == [pos[j] for j in order]
    hs = [(p, int(h, 16)) for p, _, h in rows if h and len(h) == 16 and h[0] != "g"]
    for p, h in hs:
        order = sorted((bin(h ^ g).count("1"), q) for q, g in hs if q != p and bin(h ^ g).count("1") <= 4)[:5]
        assert [o for _, o in sorted(got.get(("phash", p), []))] == [q for _, q in order]
    assert vectors.nearest_figures(df.limit(0)).count() == 0


def test_spans_equal_brute_force(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefgh 苔岚") for _ in range(n))
    shared = [word(n) for n in (149, 150, 151, 400, 170)]
    texts = [word(rng.randint(0, 300)) + (s := rng.choice(shared)) + word(rng.randint(0, 300)) + (rng.choice(shared) if rng.random() < 0.3 else s[:0]) for _ in range(60)]
    texts += [shared[3]] * 5 + [None, "", "short", "x" * 3000, "x" * 500 + "y", word(4000) + shared[1]]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, rep string")
    windows = [{t[k : k + 150] for k in range(len(t) - 149)} if t else set() for t in texts]
    want = {(j, i) for i in range(len(texts)) for j in range(i) if windows[i] & windows[j]}
    assert {tuple(r) for r in spans.found_pairs(df).collect()} == want
    amounts = {r.doc_id: r for r in spans.shared_amounts(df).collect()}
    for i, t in enumerate(texts):
        others = set().union(*(w for j, w in enumerate(windows) if j != i)) if t else set()
        inside = {p for k in range(len(t or "") - 149) if t[k : k + 150] in others for p in range(k, k + 150)}
        assert amounts[i].shared_chars == len(inside), i
    assert spans.found_pairs(df.limit(0)).count() == 0


@pytest.mark.parametrize("strip", [7, 512])
@pytest.mark.parametrize("same", [True, False])
def test_tiles_of_near_equal_figures(monkeypatch, strip, same):
    """A cluster in which every pair is close, with ties, beside scattered rows."""
    monkeypatch.setattr(vectors, "STRIP", strip)
    rng = np.random.default_rng(5)
    base = rng.random(256)
    x = np.concatenate([base + 1e-4 * rng.random((120, 256)), rng.random((30, 256)) < 0.1, np.repeat(base[None] + 0.1, 9, 0)]).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(len(x)) * 3
    a, b = (x, x) if same else (x[::2], x[1::2])
    ia, ib = (ids, ids) if same else (ids[::2], ids[1::2])
    got: dict = {}
    for rows, others, scores in vectors._tile(a, b, ia, ib, vectors.VECTOR, 5, same):
        for r, o, s in zip(rows.tolist(), others.tolist(), scores.tolist()):
            got.setdefault(r, []).append((-s, o))
    for p, q, ip, iq in [(a, b, ia, ib)] if same else [(a, b, ia, ib), (b, a, ib, ia)]:
        sim = np.round(p @ q.T, vectors.DECIMALS)
        for i in range(len(p)):
            want = sorted((-sim[i, j], iq[j]) for j in range(len(q)) if iq[j] != ip[i] and sim[i, j] >= 0.9)[:5]
            assert [o for _, o in sorted(got.get(ip[i], []))] == [o for _, o in want]
