"""URL filter, dataset manifest and whitening against plain computations, and on odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lineseek.llm import manifest, queries, urls, whitening
from lineseek.llm.common import join_counted

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.sql(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    got = queries.QUERIES[name](spark, SF_DIR)
    names = sorted(got.columns)
    want = con.sql(f"select {', '.join(f'"{n}"' for n in names)} from ({queries.ORACLES[name]})")
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))


# URLs


def plain_cut(url):
    url = url or ""
    at = url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    tail = rest[end:]
    stop = min((tail.find(c) for c in "?#" if c in tail), default=len(tail))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    return host, tail[:stop]


def plain_rule(host, path):
    best = None
    for verdict, rule in urls.RULES:
        domain, _, rest = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + rest):
            if best is None or len(rule) > len(best[1]):
                best = verdict, rule
    return best


def plain_urls(values):
    """verdicts and scores by definition, one URL at a time."""
    known = sorted({u or "" for u in values})
    rules = {u: plain_rule(*plain_cut(u)) for u in known}
    held = {u for u in known if hashlib.md5(u.encode()).hexdigest()[0] in urls.CALIBRATION}
    counts = {side: defaultdict(Counter) for side in ("allow", "block")}
    size = urls.ORDER + 1
    pieces = lambda u: [(b"\0" * urls.ORDER + u.encode() + b"\0")[i : i + size] for i in range(len(u.encode()) + 1)]
    for u in known:
        if rules[u] and u not in held:
            for piece in pieces(u):
                for length in range(1, size + 1):
                    counts[rules[u][0]][piece[-length:-1]][piece[-1]] += 1

    def p(side, piece):
        value = 1 / 256
        for length in range(1, size + 1):
            seen = counts[side][piece[-length:-1]]
            if seen:
                value = (seen[piece[-1]] + len(seen) * value) / (sum(seen.values()) + len(seen))
        return value

    totals = {u: [math.floor((math.log(p("allow", g)) - math.log(p("block", g))) * urls.SCALE + 0.5) for g in pieces(u)] for u in known}
    bins = {u: math.floor(sum(t) / (len(t) * (urls.SCALE // urls.PER_NAT))) for u, t in totals.items()}
    tried = [(bins[u], rules[u][0]) for u in held if rules[u]]
    n = Counter(v for _, v in tried)
    least = -math.inf
    if n["allow"] and n["block"]:
        places = sorted({b for b, _ in tried})
        cost = lambda t: sum(b < t and v == "allow" for b, v in tried) * n["block"] + sum(b >= t and v == "block" for b, v in tried) * n["allow"]
        least = min([*places, places[-1] + 1], key=lambda t: (cost(t), t))
    return {u: (rules[u][0] if rules[u] else "allow" if bins[u] >= least else "block", sum(totals[u]) / len(totals[u]) / urls.SCALE) for u in known}


def some_urls():
    rng = random.Random(4)
    hosts = ["example.com", "www.example.com", "WWW.Example.COM", "a.www.example.com", "xexample.com", "b.net", "net", "c.org", "com", "spam-x.net", "é.com"]
    out = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}/{rng.choice(['en', 'es', 'fr', 'de'])}/{rng.randint(1, 999)}{rng.choice(['', '?a=1', '#t'])}" for _ in range(150)]
    out += [None, "", "no scheme", "://", "a:///en/", "x://net", "x://net?/es/", "x://net/es", "http://example.com/en/\n1", "http://u:p@b.net:80/es/", "http://b.net/a://c.com/en/"]
    return out + ["http://c.org/copies"] * 70 + [None, None]


@pytest.mark.parametrize("broadcast_rows", [0, 1_000_000])
def test_urls_by_definition(spark, broadcast_rows):
    rows = [(k, u, "h", None, 1) for k, u in enumerate(some_urls())] + [(None, "http://net/fr/1", None, None, 2)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, _url int").repartition(3)
    want = plain_urls([r[1] for r in rows])
    got = urls.judge(pages, [F.col("page_id"), F.col("url").alias("given")], broadcast_rows=broadcast_rows).rows.collect()
    assert Counter((r["page_id"], r["given"]) for r in got) == Counter(r[:2] for r in rows)
    for r in got:
        assert (r["host"], r["path"]) == plain_cut(r["given"])
        rule = plain_rule(r["host"], r["path"])
        assert r["rule"] == (rule and rule[1])
        assert r["verdict"] == want[r["given"] or ""][0]
        assert r["score"] == pytest.approx(want[r["given"] or ""][1], abs=1e-6)
    assert {v for v, _ in want.values()} == {"allow", "block"}


def test_a_hot_url_and_hot_grams_are_joined_once(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), "id")
    table = rows.groupBy("k").agg(F.count("*").alias("uses"), F.max("id").alias("most"))
    for limit in (0, 10**6):
        met = join_counted(rows, table, "k", "uses", limit)
        assert met.count() == 5000 and met.columns == ["k", "id", "most"]


def test_odd_pages(spark):
    schema = "page_id long, url string, html string, verdict string, _page string"
    none = spark.createDataFrame([], schema)
    assert urls.filter_urls(none).count() == 0
    assert urls.keep_allowed(none).columns == none.columns
    # One kind of decided URLs only: what no rule decides is allowed.
    one = spark.createDataFrame([(1, "http://a.com/x", None, "v", "p"), (2, "http://a.org/", None, None, None), (3, None, None, None, None)], schema)
    assert {r["verdict"] for r in urls.filter_urls(one).collect()} == {"allow"}
    kept = urls.keep_allowed(one)
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(map(tuple, one.collect()), key=str)
    long = spark.createDataFrame([(1, "http://a.com/" + "ab/" * 200_000, None, None, None), (2, "http://a.net/es/", None, None, None)], schema)
    assert {r["page_id"]: r["verdict"] for r in urls.filter_urls(long).collect()} == {1: "allow", 2: "block"}


# Manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    values = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    """The root, and per leaf the (before, after) digests of each level."""
    steps, owner = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, at in enumerate(owner):
            first = at - at % 3
            steps[leaf].append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + 3])))
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        owner = [at // 3 for at in owner]
    return nodes[0], steps


def plain_manifest(rows):
    sources = defaultdict(list)
    for row in rows:
        sources[row["source"]].append((row["doc_id"] is not None, row["doc_id"] or 0, plain_leaf(row, row["text"]), row))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        sources[name].sort(key=lambda t: t[:3])
        trees[name] = plain_tree([t[2] for t in sources[name]])
    root, above = plain_tree([trees[name][0] for name in names])
    out = []
    for place, name in enumerate(names):
        subroot, steps = trees[name]
        for (_, _, leaf, row), own in zip(sources[name], steps):
            way = own + above[place]
            odd = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0
            text = row["text"].replace("\n", "") if odd and row["text"] is not None else row["text"]
            folded = plain_leaf(row, text)
            for before, after in way:
                folded = h(before, folded, after)
            out.append((row["doc_id"], leaf, subroot, root, h(*(b + a for b, a in way)), folded, folded == root))
    return Counter(out)


def manifest_rows(n=130):
    rng = random.Random(9)
    rows = []
    for k in range(n):
        source = rng.choice(["a", "a", "a", "a", "é", "Z", None, "z" * 40]) if k else "lonely"
        text = rng.choice([None, "", "plain", "two\nlines", "日本\n語\n", "\n" * 5, "x" * 2000])
        rows.append((k * 7 % 1000, text, rng.choice(["en", None]), source, rng.choice([None, k]), "row", "other"))
    rows += [rows[n // 2]] * 4 + [(None, "t\n", "en", "a", 3, None, None)] * 2 + [(None, None, None, None, None, None, None)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, g string"


@pytest.mark.parametrize("n", [1, 130])
def test_manifest_by_definition(spark, n):
    docs = spark.createDataFrame(manifest_rows()[:n] if n == 1 else manifest_rows(), SCHEMA)
    got = Counter(map(tuple, manifest.check_tampering(docs.repartition(3)).collect()))
    assert got == plain_manifest(docs.collect())
    assert n == 1 or {True, False} == {r[-1] for r in got}


def test_sources_beyond_the_broadcast_limit_meet_alike(spark):
    docs = spark.createDataFrame(manifest_rows(), SCHEMA)
    one, two = (manifest.Manifest.of(docs, broadcast_rows=limit).proofs().select("doc_id", "leaf", "steps", "root") for limit in (0, 10**6))
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))


def test_manifest_nodes(spark):
    built = manifest.Manifest.of(spark.createDataFrame(manifest_rows(), SCHEMA))
    nodes = built.nodes().collect()
    by_key = {(r["tree"], r["source"], r["level"], r["lo"]): r for r in nodes}
    assert len(by_key) == len(nodes)
    for (tree, source, level, lo), r in by_key.items():
        if level:
            below = [by_key[tree, source, level - 1, at] for at in range(lo, r["hi"], 3 ** (level - 1))]
            assert r["digest"] == h(*(b["digest"] for b in below))
            assert (below[0]["lo"], below[-1]["hi"]) == (r["lo"], r["hi"])


def test_manifest_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert manifest.check_tampering(none).count() == 0
    assert manifest.Manifest.of(none).nodes().count() == 0


# Whitening


def plain_whitening(vectors, size=8):
    x = [[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    total = [sum(r[i] for r in x) for i in range(d)]
    off = [[n * r[i] - total[i] for i in range(d)] for r in x]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in off), n**3)) for j in range(d)] for i in range(d)])
    values, columns = np.linalg.eigh(cov)
    order = np.argsort(-values)[:size]
    white = (np.array(off, float) / n) @ columns[:, order] / np.sqrt(values[order])
    return [sum(v * v for v in r) for r in off], white, values[order] / np.trace(cov)


def test_whitening_by_definition(spark):
    rng = np.random.default_rng(1)
    base = (rng.normal(size=(90, 3)) @ rng.normal(size=(3, 11)) + 0.1 * rng.normal(size=(90, 11))).astype(np.float32)
    good = [[float(c) for c in v] for v in [*base, *base[:5]]]
    rows = [(k if k else None, v, 3, "n") for k, v in enumerate(good)]
    bad = [None, [1.0] * 10 + [None], [math.nan] + [0.0] * 10, [math.inf] + [0.0] * 10, [0.0] * 10, [], [1e30] + [0.0] * 10]
    rows += [(1000 + k, v, None, None) for k, v in enumerate(bad)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component int, _v string").repartition(4)
    deviation, white, explained = plain_whitening(good)
    out = whitening.whiten(table, [F.col("vec_id")])
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    got = out.collect()
    assert len(got) == 8 * len(good) and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] <= 1e-6
    signs = {}
    for r in got:
        at, c = r["vec_id"] or 0, r["component"] - 1
        assert (r["n"], r["deviation"]) == (len(good), deviation[at])
        assert r["explained"] == pytest.approx(explained[c], rel=1e-9)
        assert abs(r["whitened"]) == pytest.approx(abs(white[at, c]), abs=1e-7)
        if abs(r["whitened"]) > 1e-3:
            assert signs.setdefault(c, r["whitened"] * white[at, c] > 0) == (r["whitened"] * white[at, c] > 0)


def test_polarised_covariance_is_exact_for_large_entries(spark):
    rng = random.Random(2)
    vectors = [[rng.choice([-1, 1]) * rng.random() * 2.0**e for e in (41, 41, 0, 30)] for _ in range(40)]
    table = spark.createDataFrame([(k, v) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    rows, d = whitening.usable(table, [F.col("vec_id")], "embedding")
    model = whitening.fit(rows, d)
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for v in vectors], object)
    assert model.total == list(x.sum(axis=0)) and model.n == 40
    exact = sum(Fraction(sum((40 * v - t) ** 2 for v in x[:, i]), 40**3) for i, t in enumerate(model.total))
    assert model.trace == pytest.approx(float(exact), rel=1e-12)
    assert {r["deviation"] for r in whitening.whiten(table, [F.col("vec_id")]).collect()} == {None}


def test_odd_vectors(spark):
    schema = "vec_id long, embedding array<float>, n long"
    for rows in ([], [(1, None, 2)], [(1, [], 2), (2, [], 2)]):
        assert whitening.whiten(spark.createDataFrame(rows, schema), [F.col("vec_id")]).collect() == []
    # A flat table has no variance; two dimensions of which one varies have one component.
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 3)] * 3, schema), [F.col("vec_id")]).collect()
    assert len(flat) == 6 and {(r["whitened"], r["explained"], r["deviation"], r["identity_error"]) for r in flat} == {(None, 0.0, 0, 0.0)}
    line = whitening.whiten(spark.createDataFrame([(k, [float(k), 2.0], 3) for k in range(5)], schema), [F.col("vec_id")]).collect()
    assert {r["whitened"] is None for r in line if r["component"] == 1} == {False}
    assert {r["whitened"] is None for r in line if r["component"] == 2} == {True}
    # The row's own columns stay, also under names the operator returns.
    kept = whitening.whiten(spark.createDataFrame([(None, [1.0], 3), (2, [2.0], 4)], schema), [F.struct("vec_id", "n").alias("row")])
    assert sorted((str(r["row"]["vec_id"]), r["row"]["n"]) for r in kept.collect()) == [("2", 4), ("None", 3)]
