"""The Merkle manifest, the licence scan and the conversation trie against plain versions and SQL."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from knotwork.llm import licenses, merkle, ranks, trie, twins

SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()


def same_as_sql(spark, tmp_path, name, df, got, sql):
    df.write.parquet(f"{tmp_path}/{name}.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    rel = c.execute(sql)
    columns = [d[0] for d in rel.description]
    key = lambda r: tuple((v is None, v) for v in r)
    want = sorted(rel.fetchall(), key=key)
    assert sorted((tuple(r) for r in got.select(columns).collect()), key=key) == want


@pytest.fixture
def many(spark):
    """Many partitions, however little there is in each."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "41")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


# ranks


def test_ranks_of_a_large_group(spark, many):
    g = random.Random(1)
    rows = [("a" if n % 3 else f"b{n % 7}", g.choice([None, *range(40)]), n) for n in range(3000)]
    got = ranks.ranked(spark.createDataFrame(rows, "g string, o int, n int"), ["g"], ["o", "n"]).collect()
    assert len({r.part for r in got if r.g == "a"}) > 1
    for name in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == name), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [r.n for r in sorted((r for r in got if r.g == name), key=lambda r: r.pos)] == [r[2] for r in mine]
        assert {r.size for r in got if r.g == name} == {len(mine)}


# Merkle


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: SHA("".join(map(field, r)))
    low = lambda r: (*r[:4], r[4] and re.sub("[A-Z]", lambda m: m[0].lower(), r[4]))

    def up(level):
        """Levels of a tree, and for each leaf its path of (before, after)."""
        paths, at = [[] for _ in level], list(range(len(level)))
        while len(level) > 1:
            for n, k in enumerate(at):
                run = level[k // 16 * 16 : k // 16 * 16 + 16]
                paths[n].append(("".join(run[: k % 16]), "".join(run[k % 16 + 1 :])))
                at[n] = k // 16
            level = [SHA("".join(level[k : k + 16])) for k in range(0, len(level), 16)]
        return level[0], paths

    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append(r)
    sources = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    grown = {}
    for s in sources:
        trees[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        grown[s] = up([leaf(r) for r in trees[s]])
    root, over = up([grown[s][0] for s in sources]) if sources else (None, [])
    out = []
    for s, above in zip(sources, over, strict=True):
        for r, path in zip(trees[s], grown[s][1], strict=True):
            used = low(r) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r
            fold = leaf(used)
            for a, b in path + above:
                fold = SHA(a + fold + b)
            out.append((r[0], leaf(r), grown[s][0], root, SHA("".join(a + b for a, b in path + above)), fold, fold == root))
    return sorted(out, key=str)


COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def documents(sizes):
    """Rows of sources of given sizes, with nulls, repeated rows and equal ids."""
    g, n, out = random.Random(2), 0, []
    for source, size in sizes.items():
        for _ in range(size):
            out.append((n, source, g.choice([None, "en"]), g.choice([None, n]), g.choice([None, "", "Größe A", f"Text {n} ABC"])))
            n += 1
    return out + [out[0], out[0], (out[0][0], *out[0][1:4], "another"), (None, None, None, None, None), (None, "x", None, None, "A"), (None, "x", None, None, "A")]


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 700, "b": 16, "c": 17, None: 3, "": 2, "é": 1, "Z": 256}, {f"s{k}": 1 + k % 3 for k in range(300)}], ids=["one", "sizes", "sources"])
def test_manifest_same_as_plain(spark, sizes):
    rows = documents(sizes)
    df = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "1 AS root", "'x' AS tree", "2 AS idx").repartition(7)
    assert sorted((tuple(r) for r in merkle.manifest(df).collect()), key=str) == plain_manifest(rows)


def test_manifest_frontiers_meet_over_rounds(spark, many):
    """Many partitions with a few rows each leave most parents open, so that they meet in later rounds."""
    rows = documents({"a": 600, "b": 30})
    assert sorted((tuple(r) for r in merkle.manifest(spark.createDataFrame(rows, COLUMNS)).collect()), key=str) == plain_manifest(rows)


def test_manifest_of_nothing_and_sql(spark, tmp_path):
    df = spark.createDataFrame(documents({"a": 300, None: 4, "b": 1}), COLUMNS)
    assert merkle.manifest(df.limit(0)).collect() == []
    same_as_sql(spark, tmp_path, "documents", df, merkle.manifest(df), twins.merkle_sql())


# licences


LICENSED = [
    (1, "Released under the MIT License. mit-license; Mit LICENSE! mitlicense"), (2, None), (3, ""), (4, "the General Public\n license, Lesser General Public License"), (5, "general public mit general public license license"),
    (6, "Apache\x1fLicense and apache licenses; élicense apache license"), (None, "mit license without an id"), (7, "mit license"), (7, "mit license"), (7, "another apache license"), (8, "x " * 70_000 + "mit license " * 3 + "y " * 70_000),
    (9, "Licensed under CC BY-NC 4.0."), (10, "mit"), (11, "!!! ---"), (12, "mit license mit license"),
]


def notice(label):
    return next(t.text for t in licenses.TEMPLATES if t.label == label)


def test_licenses_same_as_plain_and_sql(spark, tmp_path):
    g = random.Random(4)
    some = [(100 + n, " ".join(g.choices("mit apache general public license GPL lesser cc by nc bsd".split(), k=g.randint(0, 60)))) for n in range(200)]
    cut = notice("mit-notice").split()
    some += [(500, notice("gpl-notice")), (501, " ".join(cut[:20] + ["some", "more"] + cut[20:50] + cut[52:])), (502, " ".join(cut[: len(cut) // 2])), (503, "x ".join(cut)), (504, notice("bsd-notice") + " and " + notice("bsd-notice").upper())]
    df = spark.createDataFrame(LICENSED + some, "doc_id long, text string").selectExpr("*", "1 AS template", "'q' AS label", "0.5 AS score", "3 AS n_words")
    got = licenses.scan(df)
    rows = got.collect()
    assert len(rows) == len(LICENSED + some)
    plain = []
    for i, t in LICENSED + some:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        at = sorted((k, label) for p, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        plain.append((i, len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))))
    assert sorted((tuple(r)[:6] for r in rows), key=str) == sorted(plain, key=str)
    by = {r.doc_id: r for r in rows}
    assert by[4].labels == "gpl,lgpl" and by[9].labels == "cc-by,cc-by-nc" and by[12].n_base == 2
    assert by[500].labels == "gpl,gpl-notice" and by[501].labels == "mit-notice" and by[504].labels == "bsd-notice"
    assert by[502].labels == "" and 0.3 < by[502].score < 0.8 and by[503].labels == ""
    assert licenses.scan(df.limit(0)).collect() == []
    same_as_sql(spark, tmp_path, "documents", df.where("doc_id is null or doc_id <> 8"), got.where("doc_id is null or doc_id <> 8"), twins.license_sql())


def test_license_templates_are_bounded(monkeypatch):
    monkeypatch.setattr(licenses, "MOST_GRAMS", 10)
    with pytest.raises(ValueError):
        licenses.template_grams(licenses.TEMPLATES)


# conversations


def plain_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, SHA(f"{len((role or '').encode())}:{role or ''}{text or ''}"), role or "", text or ""))
    own = {c: [(r, x) for _, _, _, r, x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + t[h:]
    nodes = {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            nodes.setdefault(tuple(t[:d]), []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = []
    for p, members in nodes.items():
        under = [q for q in nodes if q[: len(p)] == p]
        ends = sorted(c for c in members if len(built[c]) == len(p))
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in under if q)
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids.get(p, [])), sum(q not in kids for q in under), saved, SHA(",".join(map(str, ends)))))
    return sorted(out, key=str)


def talks():
    g = random.Random(5)
    rows = [(c, g.choice([None, k, k, k + 10]), g.choice(["user", "assistant", None]), g.choice(["a", "b", "", None, "größe"])) for c in [*range(120), 400, 403, 901, -3, -7] for k in range(g.randint(1, 11))]
    rows += [(c, 0, "user", "same") for c in range(1000, 1040)] + rows[:5] + [(None, 1, "user", "nobody's"), (77777, 1, "user", "far away")]
    return rows


@pytest.mark.parametrize("block", [4096, 3], ids=["whole", "blocks"])
def test_trie_same_as_plain(spark, monkeypatch, block):
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "CHUNK", 4)
    rows = talks()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS depth", "'x' AS p1", "2 AS rank", "3 AS size").repartition(5)
    assert sorted((tuple(r) for r in trie.tries(df).collect()), key=str) == plain_trie(rows)


def test_trie_of_nothing_and_sql(spark, tmp_path):
    df = spark.createDataFrame(talks(), "conv_id long, turn long, role string, text string")
    assert trie.tries(df.limit(0)).collect() == []
    same_as_sql(spark, tmp_path, "conversations", df, trie.tries(df), twins.trie_sql())
