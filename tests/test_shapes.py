"""Boxes, inputs of unknown form, versions and the recomputed dashboard against plain versions and after failures."""

import csv
import io
import json
import random
import re
import shutil
import statistics
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from tessera.operators import records as R
from tessera.operators.adhoc import profiles
from tessera.operators.layout import CELL, smallest_rows
from tessera.sources import history as H
from tessera.sources import readers
from tessera.streaming.recompute import latest, recomputed

r = random.Random(20)


def plain_rows(boxes):
    kept_of = {}
    for page, box, x, y, w, h, key in sorted(boxes, key=lambda b: (b[3] or 0, b[2] or 0, (b[4] or 0) * max(1, b[5] or 0), b[1])):
        x, y, w, h = x or 0, y or 0, w or 0, max(1, h or 0)
        kept, seen = kept_of.setdefault(page, ([], set()))
        if key in seen:
            continue
        like = [k for k in kept if min(y + h, k[2] + k[4]) - max(y, k[2]) >= max(10, min(h, k[4]) // 2) and min(w, k[3]) >= max(120, int(max(w, k[3]) * 0.55)) and abs(x - k[1]) <= max(40, min(h, k[4]))]
        if any(w * h >= k[3] * k[4] for k in like):
            continue
        kept[:] = [k for k in kept if k not in like] + [(box, x, y, w, h)]
        seen.add(key)
    return sorted(k[0] for kept, _ in kept_of.values() for k in kept)


def test_smallest_rows(spark):
    edges = [0, CELL - 1, CELL, CELL + 1, 2 * CELL - 10, 2 * CELL, 3 * CELL]
    boxes = [(p, 1000 * p + i, r.choice([0, 10, 40, 41, 200]), r.choice([*edges, r.randrange(400)]), r.choice([100, 120, 200, 218, 400, None]), r.choice([0, 9, 10, 20, 63, 64, 65, 200, None]), r.choice(["a", "b", "c", "d", *map(str, range(40))])) for p in range(6) for i in range(60)]
    boxes += [(None, 9000, 5, -70, 300, 50, "z"), (None, 9001, 5, -66, 300, 40, None), (None, 9002, 5, -66, 290, 40, "y"), (7, 9003, None, None, None, None, None)]
    df = spark.createDataFrame(boxes, "page long, box long, x int, y int, width int, height int, identity string").withColumn("id", F.lit(1)).withColumn("label", F.lit("l"))
    got = smallest_rows(df, "page", "box", "identity")
    want = plain_rows(boxes)
    assert sorted(x.box for x in got.collect()) == want and got.columns == df.columns and 20 < len(want) < 300


def test_no_boxes(spark):
    assert smallest_rows(spark.createDataFrame([], "page long, box long, x int, y int, width int, height int, identity string"), "page", "box", "identity").collect() == []


def figures(values):
    two = lambda v: float(Decimal(str(v)).quantize(Decimal("0.01"), ROUND_HALF_UP))
    return ("number", len(values), two(min(values)), two(max(values)), two(statistics.mean(values)), two(statistics.stdev(values)) if len(values) > 1 else None, two(sum(values)), None)


def plain_profile(text):
    text = text or ""
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    try:
        found = json.loads(text)
    except ValueError:
        found = None
    if isinstance(found, list) and len(found) >= 2 and all(map(number, found)):
        return {("numbers", len(found), "value", *figures(found))}
    if isinstance(found, list) and found and isinstance(found[0], dict):
        columns = {c: [row.get(c) for row in found if isinstance(row, dict)] for c in found[0]}
        kind, n = "objects", len(found)
    else:
        rows = list(csv.reader(io.StringIO("\n".join(x for x in text.strip().splitlines() if x.strip()))))
        if len(rows) < 2:
            return {("text", 0, *[None] * 9)}
        columns = {c: [row[i] if i < len(row) else "" for row in rows[1:]] for i, c in enumerate(rows[0])}
        kind, n = "csv", len(rows) - 1

    def value(v):
        if number(v):
            return v
        try:
            return float(v) if kind == "csv" else None
        except ValueError:
            return None

    out = set()
    for c, own in columns.items():
        numbers = [x for v in own if (x := value(v)) is not None]
        out.add((kind, n, c, *(figures(numbers) if numbers else ("category", 0, *[None] * 5, len({str(v).lower() if isinstance(v, bool) else str(v) for v in own if v is not None})))))
    return out


def test_profiles(spark):
    texts = [
        None, "", "  ", "just words", "[1, 2.5, -3]", "[7]", "[]", "[1, \"2\"]", "[1, 2", "[true, false]", '{"a": 1}', '[{"a": 1, "b": "x"}, {"a": 2.25, "b": "x"}, {"b": "y", "c": 5}]', '[{"a": null, "t": true}, 5, {"a": 3}]', '[5, {"a": 1}]',
        "k,v\n1,a\n2.5,b\n\n,c", 'n,"q, r"\n"1","x ""y"" z"\n2,"p, q"\n3', "one line, of text", "two lines\nof text", "h\n1e3\n -2 \nx", "a,b\r\n1,2\r\n3,4,5\r\n", "[" + ", ".join(str(i) for i in range(20_000)) + "]",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, data string").withColumn("n", F.lit(3)).withColumn("form", F.lit("f"))
    got = {}
    for x in profiles(df, "id", "data").collect():
        got.setdefault(x.id, set()).add(tuple(x)[1:])
    assert got == {i: plain_profile(t) for i, t in enumerate(texts)}


HISTORY = [("a", 1, "x"), ("a", 2, "x"), ("a", 3, None), ("a", 5, "x"), ("a", 5, "y"), ("b", 4, None), ("b", None, "lost"), (None, 2, "n")]


def test_intervals_and_as_of(spark):
    df = spark.createDataFrame([(k, t, v, i) for i, (k, t, v) in enumerate(HISTORY)], "k string, at int, v string, i int")
    versions = H.intervals(df, ["k"], "at", "i", ["v"])
    rows = {tuple(x) for x in versions.collect()}
    assert rows == {("a", "x", 1, 3, False, 1), ("a", None, 3, 5, False, 2), ("a", "y", 5, None, True, 3), ("b", None, 4, None, True, 1), (None, "n", 2, None, True, 1)}
    state = lambda t: {(x.k, x.v) for x in H.as_of(versions, F.lit(t)).collect()}
    assert state(0) == set() and state(2) == {("a", "x"), (None, "n")} and state(3) == {("a", None), (None, "n")} and state(9) == {("a", "y"), ("b", None), (None, "n")}


def test_a_failure_between_the_writes(spark, tmp_path):
    path, schema = str(tmp_path), "k string, at int, v string"
    batch = lambda rows: spark.createDataFrame(rows, schema)
    state = lambda: {tuple(x)[:3] for x in H.current(spark, path, ["k"], "at").select("k", "at", "v").collect()}
    with pytest.raises(FileNotFoundError):
        H.current(spark, path, ["k"], "at")
    H.save(batch([("a", 1, "one"), ("b", 1, "one")]), path, 0, ["k"], "at")
    H.save(batch([("a", 2, "two"), ("b", 0, "late")]), path, 1, ["k"], "at")
    want = {("a", 2, "two"), ("b", 1, "one")}
    assert state() == want
    shutil.rmtree(f"{path}/current/batch=1")  # the job ended after the history was written
    assert state() == want
    (tmp_path / "current/batch=1").mkdir()  # or while the state was
    assert state() == want
    H.save(batch([("a", 2, "two"), ("b", 0, "late")]), path, 1, ["k"], "at")  # run again
    assert state() == want and H.history(spark, path).count() == 4
    shutil.rmtree(f"{path}/history/batch=1")  # a batch that was never completed doesn't count, nor does a state of it
    (tmp_path / "history/batch=1").mkdir()
    assert state() == {("a", 1, "one"), ("b", 1, "one")}


def test_dashboard_goes_on_where_it_was(spark, tmp_path):
    log, board, schema = tmp_path / "log", str(tmp_path / "board"), "k string, v long"
    log.mkdir()

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(log))

    def run():
        recomputed(spark.readStream.schema(schema).json(str(log)), lambda df: df.groupBy("k").agg(F.sum("v").alias("v")), board).awaitTermination()
        return {(x.k, x.v) for x in latest(spark, board).collect()}

    with pytest.raises(FileNotFoundError):
        latest(spark, board)
    add([("a", 1), ("b", 2)])
    assert run() == {("a", 1), ("b", 2)}
    assert run() == {("a", 1), ("b", 2)}
    add([("a", 10), ("c", 5)])
    assert run() == {("a", 11), ("b", 2), ("c", 5)}
    add([("a", 100)])
    assert run() == {("a", 111), ("b", 2), ("c", 5)}
    done = sorted((tmp_path / "board/checkpoint/commits").glob("[0-9]*"))
    (done[-1].parent / f".{done[-1].name}.crc").unlink()
    done[-1].unlink()  # the last batch was written, its end wasn't noted
    assert run() == {("a", 111), ("b", 2), ("c", 5)}
    assert len(list((tmp_path / "board/results").iterdir())) == len(done)


def test_places_and_turns(spark):
    rows = [(r.choice(["a", "b", "b", "b", "c", None]), i) for i in range(500)]
    want, turns = [], {}
    for g, p in rows:
        turns.setdefault(g, []).append(p)
    for n in range(500):
        want += [turns[g][n] for g in sorted(turns, key=lambda g: (g is not None, g or "")) if n < len(turns[g])]
    got = R.interleaved(spark.createDataFrame(rows, "g string, p int"), "g", "p").orderBy("turn").collect()
    assert [x.p for x in got] == want and [x.turn for x in got] == list(range(1, 501))


def test_attach_earlier(spark):
    nodes = [(i, r.choice(["a", "b", None]), r.choice(["a", "b", "c", None]), r.randrange(30)) for i in range(200)]
    got = R.attach_earlier(spark.createDataFrame(nodes, "id int, k string, up string, at int"), F.col("k"), F.col("up"), "at", "id").collect()
    at = {n[0]: n[3] for n in nodes}
    for x in got:
        _, _, up, own = nodes[x.child]
        before = [m for m in nodes if m[1] == up and up is not None and m[3] < own]
        assert (x.parent is None) == (not before) and (not before or (nodes[x.parent][1] == up and at[x.parent] == max(m[3] for m in before)))
    assert len(got) == 200


def test_no_private_folder_on_a_cluster(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf, sparkContext = Conf(), type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        R.shared_folder(Session())


def plain_nodes(value):
    """Objects of a parsed text in its order: lists, and what stands in an object's graph, at any depth."""
    if isinstance(value, list):
        return [n for item in value for n in plain_nodes(item)]
    return [value, *plain_nodes(g if isinstance(g := value.get("@graph"), list) else [])] if isinstance(value, dict) else []


def test_job_postings(spark):
    job = lambda i: {"@type": r.choice(["JobPosting", ["A", "jobposting"], [["JOBPOSTING"]]]), "i": i}
    other = lambda i: {"@type": r.choice(["Thing", None, 5, {"x": "JobPosting"}, []]), "i": i, "jobs": [{"@type": "JobPosting"}]}
    deep = {"@type": "JobPosting", "i": 99}
    for _ in range(12):
        deep = [{"@graph": [deep, other(0)]}]
    texts = ["{}", "[]", "5", "null", "{broken", json.dumps(deep), json.dumps({"@graph": {"@type": "JobPosting"}})]
    for i in range(60):
        nest = [r.choice([job, other])(j) for j in range(r.randrange(4))]
        texts.append(json.dumps(r.choice([nest, {"@graph": [nest, job(7)]}, [[nest], other(8)], {"@type": "Thing", "@graph": nest}])))
    pages = [(i, "".join(f"<script type='application/ld+json' id=x>{t}</script><p>" for t in r.sample(texts, r.randrange(4))) + '<script type="text/x">{"@type": "JobPosting"}</script>') for i in range(80)] + [(900, None)]
    pages.append((901, f"<SCRIPT TYPE=application/ld+json>{texts[5]}</SCRIPT>"))

    def strings(t):
        return [s for x in t for s in strings(x)] if isinstance(t, list) else [t.lower()] if isinstance(t, str) else []

    want = {}
    for i, html in pages:
        for raw in re.findall("(?is)<script[^>]*ld.json[^>]*>(.*?)</script>", html or ""):
            try:
                found = [n for n in plain_nodes(json.loads(raw)) if "jobposting" in strings(n.get("@type"))]
            except ValueError:
                continue
            if found:
                want.setdefault(i, found[0]["i"])
    got = readers.job_postings(spark.createDataFrame(pages, "id int, html string"))
    assert {x.id: json.loads(x.posting)["i"] for x in got.collect()} == want and want[901] == 99


def test_runtime_policies(spark):
    day, now = 86400, 1_000_000
    texts = ["", "{broken", "[1]", "{}", json.dumps({"a": {"promoted": [{"strategy": "s", "confidence": 0.5}, "t", {"strategy": "u"}]}, "b": {}, "c": 5}), json.dumps({"version": "v2", "generated_ts": now - 7 * day, "categories": {"a": {"promoted": [{"strategy": "s", "confidence": 0.5}, "t"]}}}),
             json.dumps({"categories": {"a": {"promoted": [{"strategy": "s"}]}, "b": {"promoted": []}}})]
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "f int, text string")
    got = {tuple(x) for x in readers.runtime_policies(df, "f", "text", F.lit(now)).collect()}
    assert got == {(4, "legacy", "a", 0, "s", 0.5), (4, "legacy", "a", 1, "t", 1.0), (4, "legacy", "a", 2, "u", 1.0), (5, "v2", "a", 0, "s", 0.184), (5, "v2", "a", 1, "t", 1.0), (6, "unknown", "a", 0, "s", 1.0)}
