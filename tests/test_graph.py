"""Graph building, pruning, spreading and scope merging against plain Python."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from knotwork.dims import TYPE
from knotwork.operators import features as X
from knotwork.operators import graph as G
from knotwork.operators import spread as A
from knotwork.plans import lattice
from knotwork.sources import store

FEATURE = "a_type short, a_name string, b_type short, b_name string, weight10 long"
W, E = TYPE["Word"], TYPE["Entity"]


def features(spark, rows):
    return spark.createDataFrame(rows, FEATURE)


def as_dict(graph):
    return {(r.src_name, r.dst_name): r.mass10 for r in graph.collect()}


def test_order_by_mass(spark):
    root = (TYPE["ScriptureVerse"], "1-ne|1|1")
    g = G.edges(features(spark, [(*root, W, f"{c}|en", 10 + c) for c in range(10)]))
    assert [r.dst_name for r in G.lookup(g, *root).collect()] == [f"{c}|en" for c in reversed(range(10))]


def test_self_pairs_and_both_directions(spark):
    assert as_dict(G.edges(features(spark, [(W, "a", W, "b", 1), (W, "b", W, "a", 2), (W, "a", W, "a", 5)]))) == {("a", "b"): 3, ("b", "a"): 3, ("a", "a"): 10}
    full = {(r.src_type, r.src_name, r.dst_type, r.dst_name): r.mass10 for r in G.edges(features(spark, [(W, "a", W, "a", 5), (E, "a", W, "a", 7)])).collect()}
    assert full == {(W, "a", W, "a"): 10, (E, "a", W, "a"): 7, (W, "a", E, "a"): 7}
    assert G.edges(features(spark, [])).count() == 0


def test_save_load_continue(spark, tmp_path):
    first = G.edges(features(spark, [(E, "r", W, f"{c}", 10 + c) for c in range(5)]))
    store.save_graph(first, str(tmp_path / "g"))
    g = G.merge(store.load_graph(spark, str(tmp_path / "g")), G.edges(features(spark, [(E, "r", W, f"{c}", 10 + c) for c in range(5, 10)])))
    assert [r.dst_name for r in G.lookup(g, E, "r").collect()] == [str(c) for c in reversed(range(10))]


def test_prune(spark):
    g = G.prune(G.edges(features(spark, [(E, "r", W, f"{c:03}", 10) for c in range(200)])), 96)
    assert sorted(r.dst_name for r in g.where("src_name = 'r'").collect()) == [f"{c:03}" for c in range(96)]
    n = {r.src_name: r for r in G.nodes(g).collect()}
    assert n["r"].num_edges == 96 and n["r"].total10 == 960


class Node:
    """A list that grows by insertion and forgets its lightest quarter when full."""

    def __init__(self, capacity):
        self.capacity, self.edges = max(4, capacity), []

    def add(self, other, w):
        k = next((i for i, e in enumerate(self.edges) if e[0] == other), None)
        if k is None:
            if len(self.edges) == self.capacity:
                self.edges = self.edges[: -max(1, self.capacity // 4)]
            self.edges.append([other, w])
            k = len(self.edges) - 1
        else:
            self.edges[k][1] += w
        while k and self.edges[k - 1][1] < self.edges[k][1]:
            self.edges[k - 1], self.edges[k] = self.edges[k], self.edges[k - 1]
            k -= 1


@pytest.mark.parametrize("capacity", [2, 8, 96])
def test_replay(spark, capacity):
    g = random.Random(capacity)
    rows = [(E, f"e{g.randrange(6)}", W, f"w{int(g.paretovariate(0.7))}", g.choice([1, 7, 30])) for _ in range(800)]
    nodes = defaultdict(lambda: Node(capacity))
    for at, an, bt, bn, w in rows:
        nodes[at, an].add((bt, bn), w)
        nodes[bt, bn].add((at, an), w)
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], FEATURE + ", seq long")
    got = defaultdict(list)
    for r in G.prune_by_replay(df, capacity).orderBy("rank").collect():
        got[r.src_type, r.src_name].append([(r.dst_type, r.dst_name), r.mass10])
    assert dict(got) == {k: n.edges for k, n in nodes.items()}


def test_features_same_as_plain(spark):
    docs = [(1, "One two three. Two four!"), (2, None), (3, ""), (4, "one")]
    want = defaultdict(int)
    for i, t in docs:
        for s in (t or "").lower().replace("!", ".").split("."):
            ws = [w + "|en" for w in s.split()]
            bare = s.split()
            for k, w in enumerate(ws):
                want[E, str(i), W, w, 1] += 1
                for v in ws[k + 1 : k + 8]:
                    want[W, w, W, v, 1] += 1
            for n in (2, 3):
                for k in range(len(bare) - n + 1):
                    name = "|".join(bare[k : k + n]) + "|en"
                    want[E, str(i), TYPE["NGram"], name, 7] += 1
                    for w in ws[k : k + n]:
                        want[W, w, TYPE["NGram"], name, 1] += 1
    got = X.text_features(spark.createDataFrame(docs, "doc_id long, text string")).groupBy("a_type", "a_name", "b_type", "b_name", "weight10").count().collect()
    assert {tuple(r)[:5]: r["count"] for r in got} == dict(want)


# spreading, replayed in plain Python


class Plain:
    def __init__(self, rows):
        mass = defaultdict(int)
        for at, an, bt, bn, w in rows:
            mass[(at, an), (bt, bn)] += w
            mass[(bt, bn), (at, an)] += w
        self.edges = defaultdict(list)
        for (a, b), m in mass.items():
            self.edges[a].append((b, m))
        for e in self.edges.values():
            e.sort(key=lambda x: (-x[1], x[0]))

    def spread(self, start, least, hops):
        cumulative, active = defaultdict(float, start), dict(start)
        for _ in range(hops):
            nxt = defaultdict(float)
            for node, v in active.items():
                if v < least or node not in self.edges:
                    continue
                e = self.edges[node]
                n, total = len(e), sum(m for _, m in e)
                for other, m in e:
                    act = v / n / (1 + math.exp(-((m * n / total - 1) * 0.5)))
                    nxt[other] += act
                    if act < least:
                        break
            if not nxt:
                break
            for k, v in nxt.items():
                cumulative[k] += v
            active = nxt
        return dict(cumulative)

    def query(self, scopes, least, hops, factor):
        masks = {1 << k: dict(s) for k, s in enumerate(scopes)}
        seen, spread, final = set(masks), set(), defaultdict(float)
        while True:
            todo = [m for m in masks if m not in spread]
            if not todo:
                break
            for m in todo:
                masks[m] = self.spread(masks[m], least, hops)
                spread.add(m)
                for k, v in masks[m].items():
                    final[k] += v
            merging = True
            while merging:
                fresh = {}
                for a in list(masks):
                    for b in list(masks):
                        if a != b and a | b not in seen:
                            seen.add(a | b)
                            both = masks[a].keys() & masks[b].keys()
                            if both:
                                new = defaultdict(float, {k: factor * (masks[a][k] + masks[b][k]) for k in both})
                                for p in (a, b):
                                    if p not in spread:
                                        spread.add(p)
                                        for k, v in masks[p].items():
                                            new[k] += v
                                fresh[a | b] = dict(new)
                merging = bool(fresh)
                masks = fresh | {m: s for m, s in masks.items() if m not in spread}
        for s in scopes:
            for k in s:
                final.pop(k, None)
        return dict(final)


@pytest.fixture(scope="module")
def world():
    g = random.Random(9)
    return [(E, f"d{g.randrange(8)}", W, f"w{g.randrange(14)}", g.choice([1, 7, 30])) for _ in range(90)]


@pytest.mark.parametrize("scopes", [[["w1"]], [["w1", "w2"]], [["w1"], ["w2"]], [["w1"], ["w5"], ["w9"]], [["w0"], ["nowhere"]]])
def test_query_same_as_plain(spark, world, scopes):
    prepared = A.prepare(G.edges(features(spark, world)))
    q = A.Query(min_activation=1e-3, max_hops=6)
    for k, names in enumerate(scopes):
        for n in names:
            q.add_root(W, n, k)
    want = Plain(world).query([{(W, n): 1.0 for n in names} for names in scopes], 1e-3, 6, 4.0)
    got = {(r.type, r.name): r.score for r in A.run(q, prepared).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_lattice():
    assert lattice.order(1) == [1] and lattice.order(2) == [1, 2, 3] and lattice.order(3) == [1, 2, 4, 7, 6]
    assert lattice.order(4) == [1, 2, 4, 8, 7, 11, 15, 13, 14]
    with pytest.raises(ValueError, match="32"):
        lattice.order(33)


def test_query_settings(spark, world):
    q = A.Query().add_root(W, "a").add_root(W, "a", weight=2.0)
    assert q.scopes == {0: {(W, "a"): 3.0}}
    for bad in ({"min_activation": 2}, {"overlap": -1}):
        with pytest.raises(ValueError):
            A.Query(**bad)
    assert A.run(A.Query(), A.prepare(G.edges(features(spark, world)))).count() == 0
    large = A.hop(spark.createDataFrame([(W, "w1", 1.0)], "type short, name string, v double"), A.prepare(G.edges(features(spark, world))), 1e-3, small=False)
    assert large.count() > 0


def read_folders(df):
    """Folders that a query's scans read when it runs, of all that the table has."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    seen = []

    def walk(p):
        if p.nodeName() == "AdaptiveSparkPlan":
            return walk(p.executedPlan())
        if p.nodeName().startswith("Scan parquet"):
            seen.append((p.metrics().apply("numPartitions").value() if p.metrics().contains("numPartitions") else None, p.metrics().apply("numFiles").value()))
        kids = p.children()
        for k in range(kids.size()):
            walk(kids.apply(k))
        if hasattr(p, "plan") and "QueryStage" in p.nodeName():
            walk(p.plan())

    walk(plan)
    return seen


def test_hop_and_lookup_read_the_buckets_of_active_nodes(spark, world):
    g = G.edges(features(spark, world))
    store = A.prepare(g, buckets=16)
    active = spark.createDataFrame([(W, "w1", 1.0), (W, "w2", 0.5), (E, "nothing", 1.0)], "type short, name string, v double")
    found = sorted(r[0] for r in active.select(store.bucket(F.col("type"), F.col("name"))).distinct().collect())
    pruned, whole = A.hop(active, store, 1e-3, buckets=found), A.hop(active, store, 1e-3)
    rows = lambda d: {(r.type, r.name): round(r.v, 12) for r in d.collect()}
    assert rows(pruned) == rows(whole) != {}
    assert "PartitionFilters: [bucket" in pruned._jdf.queryExecution().toString()
    assert max(f for _, f in read_folders(pruned)) <= len(found) < min(f for _, f in read_folders(whole))
    assert [tuple(r)[1:] for r in store.lookup(W, "w1").select("src_type", "dst_type", "dst_name", "mass10").collect()] == [tuple(r)[1:] for r in G.lookup(g, W, "w1").select("src_type", "dst_type", "dst_name", "mass10").collect()]
    assert [f for _, f in read_folders(store.lookup(W, "w1"))] == [1]
    assert store.of_nodes(active).count() == g.where("src_name in ('w1', 'w2')").count()
    assert "PushedFilters" in store.lookup(W, "w1")._jdf.queryExecution().toString()


@pytest.mark.parametrize("most", [1 << 20, 5, 2], ids=["plain", "some hubs", "hubs"])
def test_edges_know_the_one_before(spark, world, tmp_path, monkeypatch, most):
    from knotwork.sources import edges as S

    monkeypatch.setattr(S, "NODE_EDGES", most)  # nodes of more edges are ordered by their masses only
    g = G.edges(features(spark, world))
    S.EdgeStore.write(g, str(tmp_path / "g"), 4)
    again = S.EdgeStore.open(spark, str(tmp_path / "g"))
    assert again.buckets == 4 and as_dict(again.edges) == as_dict(g)
    by = defaultdict(list)
    for r in again.edges.collect():
        by[r.src_type, r.src_name].append(r)
    for rs in by.values():
        rs.sort(key=lambda r: (-r.mass10, r.dst_type, r.dst_name))
        assert [r.before10 for r in rs] == [None, *[r.mass10 for r in rs[:-1]]]
        assert {(r.num_edges, r.total10) for r in rs} == {(len(rs), sum(r.mass10 for r in rs))}
    none = S.EdgeStore.write(g.limit(0), str(tmp_path / "none"), 4)
    assert A.run(A.Query().add_root(W, "w1"), none).count() == 0


@pytest.mark.parametrize("most", [1 << 20, 2], ids=["plain", "hubs"])
def test_words_at_rest_are_their_features_at_rest(spark, tmp_path, monkeypatch, most):
    from knotwork.sources import edges as S

    monkeypatch.setattr(S, "NODE_EDGES", most)
    docs = spark.createDataFrame([(1, "the Light the hill"), (2, "a light of a hill"), (2, "light, a light"), (3, None), (4, ""), (5, "the hill, the light")], "doc_id int, text string")
    words = X.Words(docs)
    rows = lambda st: sorted(map(str, st.edges.select(*S.COLUMNS, "bucket").collect()))
    want = S.EdgeStore.write(G.edges(words.features()), str(tmp_path / "all"))
    got = words.stored(str(tmp_path / "sides"))
    assert got.buckets == want.buckets and rows(got) == rows(want) != []
    assert rows(S.EdgeStore.open(spark, str(tmp_path / "sides"))) == rows(want)
    with pytest.raises(Exception, match="exist"):
        S.EdgeStore.write(G.edges(words.features()), str(tmp_path / "all"))
    assert X.Words(docs.limit(0)).stored(str(tmp_path / "none")).edges.count() == 0


@pytest.mark.parametrize("query", ["graph_lookup", "budgeted_spread"])
def test_stored_edges_are_shuffled_once(spark, sf_dir, monkeypatch, query):
    """Texts are dealt once, the edges of words once, and those of texts never; nothing is joined by shuffle for totals."""
    from pyspark.sql.readwriter import DataFrameWriter

    from knotwork import queries as core

    shuffles, real = [], DataFrameWriter.parquet

    def parquet(self, path, *a, **k):
        if "/edges-" in path:
            shuffles.append(self._df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return real(self, path, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    core.queries()[query](spark, sf_dir).collect()
    assert shuffles == [1, 1]


def test_scopes_share_jobs(spark, world):
    """Three scopes take no more hops than one: all are spread together."""
    store = A.prepare(G.edges(features(spark, world)))
    calls = []
    real = A.hop
    try:
        A.hop = lambda *a, **k: calls.append(1) or real(*a, **k)
        for scopes in (1, 3):
            q = A.Query(min_activation=1e-3, max_hops=2, overlap=0.0)
            for k in range(scopes):
                q.add_root(W, f"w{k}", k)
            before = len(calls)
            A.run(q, store)
            assert len(calls) - before <= 2 * (1 if scopes == 1 else 2)
    finally:
        A.hop = real


def test_percentiles(spark):
    g = G.edges(features(spark, [(E, f"e{k}", W, f"w{j}", 1) for k in range(10) for j in range(k + 1)]))
    p = {r.pct: r.num_edges for r in G.degree_percentiles(g).collect()}
    assert len(p) == 99 and p[1] < p[50] < p[99]


def test_stream(spark, tmp_path):
    from knotwork.streaming import train

    docs = spark.createDataFrame([(k, f"word{k % 3} common text {k}") for k in range(12)], "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    train.train_stream(stream, str(tmp_path / "graph"), str(tmp_path / "state")).awaitTermination(120)
    assert as_dict(train.current(spark, str(tmp_path / "graph"))) == as_dict(G.edges(X.text_features(docs)))
    train.add_batch(X.text_features(docs), str(tmp_path / "graph"), 0)  # a batch run again replaces itself
    assert train.current(spark, str(tmp_path / "graph")).where(F.col("mass10") <= 0).count() == 0


def test_batches_replayed_during_compaction_count_once(spark, tmp_path, monkeypatch):
    from knotwork.sources.generations import GraphLog

    log = GraphLog(spark, str(tmp_path / "log"))
    part = lambda *rows: features(spark, list(rows))
    a, b, c = (E, "d1", W, "x", 3), (E, "d1", W, "y", 5), (E, "d2", W, "x", 7)
    assert log.current().count() == 0 and log.compact().number == 0
    log.add(part(a), 0)
    log.add(part(b), 1)
    real = GraphLog._publish

    def replay_first(self, m):
        log.add(part(b), 1)  # while the new generation is written but not named
        assert as_dict(log.current()) == as_dict(G.edges(part(a, b)))
        log.add(part(c), 2)
        return real(self, m)

    monkeypatch.setattr(GraphLog, "_publish", replay_first)
    m = log.compact()
    monkeypatch.undo()
    assert m.batches == {0, 1} and log.deltas(m) == [2]
    log.add(part(b), 1)  # and after it was named
    assert as_dict(log.current()) == as_dict(G.edges(part(a, b, c)))
    # a compaction that another one overtook is not named
    old = log.manifest
    late = GraphLog(spark, str(tmp_path / "log"))
    monkeypatch.setattr(late, "manifest", lambda found=old(): found)
    log.compact()
    late.compact()
    assert log.manifest().number == 2 and as_dict(log.current()) == as_dict(G.edges(part(a, b, c)))
    gone = log.clean()
    assert "deltas/1" in gone and as_dict(log.current()) == as_dict(G.edges(part(a, b, c)))
    (tmp_path / "log" / "deltas" / "9").mkdir()  # a delta whose writer died
    assert as_dict(log.current()) == as_dict(G.edges(part(a, b, c)))


def test_stream_compacts(spark, tmp_path):
    from knotwork.streaming import train

    docs = spark.createDataFrame([(k, f"word{k % 3} common text {k}") for k in range(12)], "doc_id long, text string")
    docs.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    train.train_stream(stream, str(tmp_path / "graph"), str(tmp_path / "state"), compact_every=2).awaitTermination(120)
    assert as_dict(train.current(spark, str(tmp_path / "graph"))) == as_dict(G.edges(X.text_features(docs)))


def test_spreading_over_features_sums_only_what_is_active(spark, world):
    """The same as over the stored graph, whatever the threshold; ties and a hub go by the order of edges, as there."""
    W_ = TYPE["Word"]
    rows = [(W_, "hub", W_, f"n{k:03d}", 10 + k % 3) for k in range(90)] + [(W_, "hub", W_, "hub", 10), (W_, f"n{5:03d}", W_, "far", 10), (W_, "n005", W_, "hub", 40)]
    f = spark.createDataFrame(rows, "a_type short, a_name string, b_type short, b_name string, weight10 long")
    store = A.prepare(G.edges(f))
    rounded = lambda d: sorted((r.type, r.name, round(r.score, 9)) for r in d.collect())
    for least in (1e-4, 6e-3, 0.5):
        q = A.Query(min_activation=least, max_hops=3).add_root(W_, "hub", 0).add_root(W_, "far", 1)
        assert rounded(A.run(q, A.Unsummed(f))) == rounded(A.run(q, store)) != []
    active = spark.createDataFrame([(1, W_, "far", 1.0)], "mask long, type short, name string, v double")
    for small in (True, False):
        assert {(r.name, round(r.v, 9)) for r in A.Unsummed(f).hop(active, 1e-4, small).collect()} == {(r.name, round(r.v, 9)) for r in A.hop(active, store, 1e-4).collect()}


def test_one_generation_is_not_summed_again(spark, tmp_path):
    from knotwork.sources.generations import GraphLog

    log = GraphLog(spark, str(tmp_path))
    rows = [(W, "a", W, "b", 10), (W, "b", W, "a", 5), (W, "a", W, "a", 1)]
    f = spark.createDataFrame(rows, "a_type short, a_name string, b_type short, b_name string, weight10 long")
    log.add(f, 0)
    log.add(f, 1)
    assert "Aggregate" in log.current()._jdf.queryExecution().optimizedPlan().toString()
    log.compact()
    assert "Aggregate" not in log.current()._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.src_name, r.dst_name, r.mass10) for r in log.current().collect()} == {("a", "b", 30), ("b", "a", 30), ("a", "a", 4)}


def test_deltas_and_generations_hold_a_pair_once(spark, tmp_path):
    """Half of the edges are at rest, and the words of texts aren't shuffled to be summed; entities may be of a type behind words."""
    from knotwork.sources.generations import GraphLog

    log = GraphLog(spark, str(tmp_path))
    docs = spark.createDataFrame([(1, "the Light the hill"), (2, "a light of a hill"), (2, "light, a light"), (3, None), (None, "hill")], "doc_id int, text string")
    for k, d in enumerate((docs.where("doc_id = 1"), docs.where("doc_id = 2 OR doc_id IS NULL"), docs.where("doc_id = 3"))):
        log.add(X.text_features(d, kinds=("word",)), k)
    want = G.edges(X.text_features(docs, kinds=("word",)))
    at_rest = lambda of: spark.read.parquet(*[str(x) for x in (tmp_path / of).iterdir()])
    log.compact()
    assert 2 * at_rest("deltas").count() == 2 * at_rest("generations").count() == want.count() and as_dict(log.current()) == as_dict(want)
    words = X.Words(docs.where("doc_id = 2"))
    assert words.pairs()._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    log.add_pairs(words.pairs(), 3)
    assert as_dict(log.current()) == as_dict(G.merge(want, G.edges(words.features())))
    for kind in ("Entity", "ScriptureVerse"):
        w = X.Words(docs, entity=kind)
        rows = lambda p: sorted(map(str, p.select(*G.PAIR, "mass10").collect()))
        assert rows(w.pairs()) == rows(G.pairs(w.features())) and as_dict(G.both(w.pairs())) == as_dict(w.edges())


def test_rows_that_grow_are_dealt(spark):
    """Few bytes in one file are more tasks, and equal keys stay together."""
    from knotwork.plans.session import dealt

    got = dealt(spark.range(0, 100, 1, 1), "id")
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and got.count() == 100


def test_words_of_some_nodes_only(spark):
    """The edges of some nodes are those of all features: repeated and null ids and texts, marks within words, few words and many."""
    odd = "Of a mind-set; o'er the’ sea.’The end.)Of…of x-'y' ...a.b!?-c"
    docs = spark.createDataFrame([(1, odd), (1, "of of The SEA"), (2, None), (None, "of sea"), (3, ""), (4, "minds " + " ".join(f"w{k}" for k in range(99)))], "doc_id long, text string")
    words = X.Words(docs)
    rows = lambda d: sorted(map(repr, d.select("src_type", "src_name", "dst_type", "dst_name", "mass10").collect()))
    sentences = X.text_features(docs, kinds=("word", "bigram")).where(F.col("b_type") == W)  # these are cut by sentences
    sentences = sentences.where(F.col("a_type") != W)
    assert rows(G.edges(words.features())) == rows(G.edges(sentences))
    few = [(TYPE["Entity"], "1"), (W, "of|en"), (W, "mind|en"), (W, "sea|de"), (TYPE["NGram"], "of|of|en")]
    for names in (few, [*few, *[(W, f"w{k}|en") for k in range(80)]], few[:1], few[1:2], few[3:]):
        wanted = spark.createDataFrame(names, "src_type short, src_name string")
        for small in (True, False):
            assert rows(words.edges_of(wanted, small)) == rows(A.Unsummed(words.features()).of_nodes(wanted, small))


def test_sums_of_graphs_are_stored_with_edges_dealt_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the Light the hill"), (2, "a light"), (2, "light, a light"), (3, None), (None, "hill")], "doc_id int, text string")
    one, two = X.Words(docs).edges(), X.Words(docs.where("doc_id > 1")).edges()
    rows = lambda d: sorted(map(str, d.select(*G.EDGE, "mass10").collect()))
    assert rows(one) == rows(G.edges(X.text_features(docs, kinds=("word",))))
    store.save_graph(one, str(tmp_path / "one"))
    store.save_sum([store.load_graph(spark, str(tmp_path / "one")), two], str(tmp_path / "sum"))
    assert rows(store.load_graph(spark, str(tmp_path / "sum"))) == rows(G.merge(one, two))
    assert two._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
