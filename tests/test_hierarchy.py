"""Components, sums over subtrees, pruning, like siblings and the tree to show, against plain loops and recursion."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import hierarchy as H
from tessera.operators.graphs import components, linked_by_keys
from tessera.operators.skew import lookup

SCHEMA = "node_id long, parent_id long, kind string, title string, description string, subtitle string, preview_url string, download_url string, redirect_url string, mime_type string, canonical_url string, url string, badges array<string>, n_meta int"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def classes(rows):
    """Least member by node, of rows (node, keys), by a plain union of sets."""
    sets = []
    for node, keys in rows:
        keys = {k for k in keys or [] if k is not None}
        hit = [x for x in sets if x[1] & keys]
        sets = [x for x in sets if not x[1] & keys] + [({node}.union(*(x[0] for x in hit)), keys.union(*(x[1] for x in hit)))]
    return {n: min(x[0]) for x in sets for n in x[0]}


def test_linked_by_keys(spark):
    r = random.Random(4)
    rows = [(i, [f"{c}{r.randrange(300)}" for c in "abcd"[: r.randrange(5)]] + [None] * r.randrange(2)) for i in range(300)]
    rows += [(1000 + i, [f"chain{i}", f"chain{i + 1}"]) for i in range(150)] + [(2000 + i, ["hot", f"own{i}"]) for i in range(700)] + [(2999, ["own3", "a1"]), (5000, None), (5001, []), (5002, [None])]
    df = spark.createDataFrame(rows, "node long, keys array<string>")
    want = classes(rows)
    assert {x.node: x.label for x in linked_by_keys(df, "node", "keys", salts=8).collect()} == want
    assert want[1149] == 1000 and want[2500] == want[2999]


def test_components_of_edges(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(500, i) for i in range(501, 600)] + [(7, 7), (900, 901), (901, 900)]
    got = {x.node: x.label for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(500, 600), 500), 900: 900, 901: 900}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_lookup_of_a_hot_key(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 3 == 0, F.concat(F.lit("k"), F.col("id") % 6)).alias("k"))
    rows = rows.union(spark.sql("select 9999L, cast(null as string)"))
    table = spark.createDataFrame([("hot", 1), ("k0", 2)], "k string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got, want = lookup(rows, table, "k", "id", how), rows.join(table, "k", how)
        assert sorted(map(str, got.select(*sorted(got.columns)).collect())) == sorted(map(str, want.select(*sorted(want.columns)).collect()))


def forest():
    r = random.Random(6)
    deep = [(i, i - 1 if i else None, 1) for i in range(400)]
    wide = [(1000, None, 2)] + [(1001 + i, 1000, i % 5) for i in range(600)]
    mixed = [(3000, None, 1)] + [(3000 + i, 3000 + r.randrange(i), r.randrange(4)) for i in range(1, 300)]
    cycle = [(5000, 5001, 9), (5001, 5002, 9), (5002, 5000, 9), (5003, 5000, 9), (5004, 5004, 9), (6000, 777777, 9), (6001, 6000, 9)]
    rows = deep + wide + mixed + cycle
    r.shuffle(rows)
    return rows


def plain_walk(rows, dead):
    children, out, stack = {}, {}, []
    for n, p, _ in rows:
        children.setdefault(p, []).append(n)
    value = {n: v for n, _, v in rows}
    order, stack = [], [(n, 0, dead(value[n])) for n in children[None]]
    while stack:
        n, d, gone = stack.pop()
        order.append(n)
        out[n] = [d, gone, value[n]]
        stack += [(c, d + 1, gone or dead(value[c])) for c in children.get(n, [])]
    for n in reversed(order):
        out[n][2] += sum(out[c][2] for c in children.get(n, []))
    return out


def test_walks(spark):
    rows = forest()
    df, want = spark.createDataFrame(rows, "n long, p long, v int"), plain_walk(rows, lambda v: v == 3)
    assert {x.n: x.depth for x in H.depths(df, "n", "p").collect()} == {n: d for n, (d, _, _) in want.items()}
    assert {x.n: x.s for x in H.subtree_sums(df, "n", "p", {"s": F.col("v")}).collect()} == {n: s for n, (_, _, s) in want.items()}
    assert {x.n for x in H.pruned(df, "n", "p", F.col("v") == 3).collect()} == {n for n, (_, gone, _) in want.items() if not gone}


def test_empty_and_only_cycles(spark):
    empty, cycle = spark.createDataFrame([], "n long, p long, v int"), spark.createDataFrame([(1, 2, 1), (2, 1, 1)], "n long, p long, v int")
    for df in (empty, cycle):
        assert H.depths(df, "n", "p").collect() == [] and H.subtree_sums(df, "n", "p", {"s": F.col("v")}).collect() == []


def key(url):
    url = (url or "").strip()
    return url.removeprefix("https://").removeprefix("http://").removeprefix("www.")


class Plain:
    """The tree to show, by plain recursion over nested nodes, pass after pass."""

    def __init__(self, rows, noise):
        self.rows = {r["node_id"]: dict(r, badges=list(r["badges"] or [])) for r in rows}
        self.noise = noise

    def tree(self, parent):
        return [n for n in sorted(self.rows) if self.rows[n]["parent_id"] == parent]

    def drop(self, n):
        for c in self.tree(n):
            self.drop(c)
        del self.rows[n]

    def target(self, n):
        r = self.rows[n]
        return key((r["canonical_url"] or "").strip() or r["url"])

    def keys(self, n):
        r = self.rows[n]
        if r["kind"] == "external_redirect":
            return {("signature", r["kind"], key(r["url"]), key(r["redirect_url"]))}
        own = ("signature", r["kind"], self.target(n)) if self.target(n) else ("title", r["kind"], (r["title"] or "").lower())
        return {own} | {("url", key(r[c])) for c in ("canonical_url", "url", "redirect_url", "download_url") if (r[c] or "").strip()}

    def score(self, n):
        r = self.rows[n]
        full = sum(p for c, p in (("description", 8), ("download_url", 8), ("preview_url", 6), ("mime_type", 4)) if (r[c] or "").strip())
        return H.PRIORITY.get(r["kind"], 0) + 4 * len(self.tree(n)) + 2 * len(r["badges"]) + full + min(r["n_meta"] or 0, 8)

    def rules(self, n, found):
        r, first = self.rows[n], {}
        for c in self.tree(n):
            x, t = self.rows[c], self.target(c)
            same = bool(t) and t == self.target(n)
            twin = same and x["kind"] == r["kind"]
            again = x["kind"] == "external_redirect" and bool(self.target(n)) and bool(key(r["redirect_url"])) and key(x["url"]) == key(r["url"]) and key(x["redirect_url"]) == key(r["redirect_url"])
            image = x["kind"] == "image" and bool(t) and t in (key(r["preview_url"]), self.target(n))
            if not (same or again or image):
                continue
            first[twin, again] = i = first.get((twin, again), 0) + 1
            if twin and r["kind"] in H.ASSETS and i == 1:
                found.append((c, n, "promoted"))
            elif twin and r["kind"] in H.LIFTED and i == 2:
                found.append((c, n, "collapsed"))
            elif same and (twin or x["kind"] in H.REPEATING):
                found.append((c, n, "repeated"))
            elif image:
                found.append((c, n, "preview"))
            elif again and i > 1:
                found.append((c, n, "redirect"))
        for c in self.tree(n):
            self.rules(c, found)

    def apply(self, found):
        for c, n, rule in sorted(found, key=lambda f: f[2], reverse=True):  # promoted before collapsed
            r, x = self.rows[n], found and self.before[c]
            if rule in ("promoted", "collapsed"):
                for f in H.FIELDS:
                    r[f] = (r[f] or "").strip() or (x[f] or "").strip() or None
                r["badges"] = list(dict.fromkeys([*r["badges"], *x["badges"]]))
                r["n_meta"] = max([v for v in (r["n_meta"], x["n_meta"]) if v is not None], default=None)
        lifted = {c: n for c, n, rule in found if rule == "collapsed"}
        for r in self.rows.values():
            r["parent_id"] = lifted.get(r["parent_id"], r["parent_id"])
        for c, _, _ in found:
            if c in self.rows:
                self.drop(c)

    def merge(self, n, to):
        own = self.tree(n)
        label = classes([(c, self.keys(c)) for c in own])
        for first in set(label.values()):
            group = sorted((c for c in own if label[c] == first), key=lambda c: (-self.score(c), c))
            best = dict(self.rows[group[0]])
            for f in H.FIELDS:
                best[f] = next((self.rows[c][f] for c in group if (self.rows[c][f] or "").strip()), None)
            if best["kind"] in ("page", "section"):
                best["title"] = next((self.rows[c]["title"] for c in group if self.rows[c]["kind"] in ("link", "course_section") and (self.rows[c]["title"] or "").strip()), best["title"])
            best["badges"] = list(dict.fromkeys(b for c in group for b in self.rows[c]["badges"]))
            best["n_meta"] = max([v for c in group if (v := self.rows[c]["n_meta"]) is not None], default=None)
            to[group[0]] = (best, group)
        for c in own:
            self.merge(c, to)

    def run(self):
        for n in list(self.rows):
            if n in self.rows and self.noise(self.rows[n]):
                self.drop(n)
        size = None
        while size != len(self.rows):
            size = len(self.rows)
            found, to = [], {}
            self.before = {n: dict(r) for n, r in self.rows.items()}
            for root in self.tree(None):
                self.rules(root, found)
            self.apply(found)
            self.merge(None, to)
            keep = {c: best for best, (_, group) in to.items() for c in group}
            self.rows = {n: dict(row, parent_id=keep.get(row["parent_id"], row["parent_id"])) for n, (row, _) in to.items()}
        for n in list(self.rows):
            if n in self.rows and self.noise(self.rows[n]):
                self.drop(n)
        return {tuple(tuple(r[c]) if c == "badges" else r[c] for c in NAMES) for r in self.rows.values()}


def site(seed, size, chain=False):
    r = random.Random(seed)
    url = lambda n: r.choice([None, "", "https://www.s.example/", "http://s.example/", " https://s.example/"]) or ""
    rows = []
    for i in range(size):
        made = [f"{u}v/{r.randrange(n)}" if (u := url(0)) else r.choice([None, ""]) for n in (9, 9, 25, 25, 12)]
        parent = None if i == 0 else (i - 1 if chain else r.randrange(max(0, i - 25), i))
        rows.append((i, parent, r.choice([*H.PRIORITY, "course_section", None]), r.choice(["Title", "title", "Noise", "x", None, " "]) if i else "Root", r.choice([None, "", "text", f"text {i}"]), None,
                     made[4], made[3], made[2], r.choice([None, "a/b"]), made[0], made[1], r.choice([None, [], ["new"], ["old", "new"]]), r.choice([None, 0, 3, 12])))
    return [dict(zip(NAMES, x)) for x in rows]


@pytest.mark.parametrize(("seed", "size", "chain"), [(1, 160, False), (3, 60, True)])
def test_tree_to_show(spark, seed, size, chain):
    rows = site(seed, size, chain)
    df = spark.createDataFrame([tuple(r[c] for c in NAMES) for r in rows], SCHEMA)
    want = Plain(rows, lambda r: (r["title"] or "").lower() == "noise").run()
    got = H.presentable(df, lambda: F.lower("title") == "noise")
    clean = lambda r: tuple((v or "").strip() if c in (*H.FIELDS, "title") else v for c, v in zip(NAMES, r))
    assert {clean(tuple(tuple(x[c]) if c == "badges" else x[c] for c in NAMES)) for x in got.collect()} == set(map(clean, want))
    assert 2 < len(want) < size


def test_two_like_branches_become_one(spark):
    rows = [(0, None, "section", 0)] + [(100 * b + d, 0 if d == 1 else 100 * b + d - 1, "page", d) for b in (1, 2, 3) for d in range(1, 4)]
    full = [dict.fromkeys(NAMES) | {"node_id": n, "parent_id": p, "kind": k, "title": str(d), "url": f"https://s.example/{d}", "badges": [str(n)]} for n, p, k, d in rows]
    got = H.presentable(spark.createDataFrame([tuple(r[c] for c in NAMES) for r in full], SCHEMA), lambda: F.lit(False)).collect()
    assert {(r.node_id, r.parent_id) for r in got} == {(0, None), (101, 0), (102, 101), (103, 102)}
    assert {tuple(sorted(r.badges)) for r in got} == {("0",), *((str(100 + d), str(200 + d), str(300 + d)) for d in range(1, 4))}


def test_each_rule(spark):
    base = {"kind": "google_drive", "url": "https://s.example/a", "redirect_url": "https://t.example/z", "preview_url": "https://s.example/p"}
    rows = [(0, None, "section", {}), (1, 0, "google_drive", base)]
    rows += [(10, 1, "google_drive", {"url": "http://www.s.example/a", "description": "d"}), (11, 1, "google_drive", {"url": "https://s.example/a", "mime_type": "m", "description": "e"}), (12, 1, "google_drive", {"url": "https://s.example/a"})]
    rows += [(13, 1, "image", {"url": "https://s.example/p"}), (14, 1, "link", {"url": "https://s.example/a"}), (15, 1, "forum", {"url": "https://s.example/a"})]
    rows += [(16, 1, "external_redirect", {"url": "https://s.example/a", "redirect_url": "https://t.example/z"}), (17, 1, "external_redirect", {"url": "https://s.example/a", "redirect_url": "https://t.example/z"})]
    rows += [(20, 10, "page", {"url": "https://s.example/20"}), (21, 11, "page", {"url": "https://s.example/21"})]
    full = [dict.fromkeys(NAMES) | {"node_id": n, "parent_id": p, "kind": k, **x} for n, p, k, x in rows]
    df = spark.createDataFrame([tuple(r[c] for c in NAMES) for r in full], SCHEMA)
    rules = H.child_rules(df)
    assert {(r.node_id, r.rule) for r in rules.collect()} == {(10, "promoted"), (11, "collapsed"), (12, "repeated"), (13, "preview"), (14, "repeated"), (17, "redirect")}
    left = {r.node_id: r for r in H.apply_rules(df, rules).collect()}
    assert set(left) == {0, 1, 15, 16, 21} and left[21].parent_id == 1
    assert (left[1].description, left[1].mime_type) == ("d", "m")


def test_no_table_of_the_tree_is_gathered_on_the_driver(spark):
    rows = site(5, 30)
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    begun = max((store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())), default=-1)
    H.presentable(spark.createDataFrame([tuple(r[c] for c in NAMES) for r in rows], SCHEMA), lambda: F.lower("title") == "noise").collect()
    bus.waitUntilEmpty()
    ran = store.executionsList()
    plans = [x.physicalPlanDescription() for i in range(ran.size()) if (x := ran.apply(i)).executionId() > begun]
    assert len(plans) > 20 and any("SortMergeJoin" in p for p in plans)
    assert not [p for p in plans if "Broadcast" in p]
