"""URL filters, license scans, token files, nearest neighbours, pipeline and registration."""

import collections
import random
import re

import numpy as np
import pytest
from compare import compare, duck
from conftest import SF_SMALL
from pyspark.sql import functions as F

import corpus_pipeline
from kbspark.llm import byte_bpe, license_scan, lsh_search, queries, token_files, url_filter
from kbspark.llm.oracle import ORACLE
from kbspark.session import ensure_checkpoint_dir


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    r = compare(queries.QUERIES[name](spark, SF_SMALL), duck(SF_SMALL), ORACLE[name])
    assert r["cols_equal"] and r["values_equal"], r


def test_registered_beside_the_others():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} == {x.split("_")[0] for x in names if re.match(r"op\d+_", x)}
    assert "pipeline" in names and set(ORACLE) <= set(entry.oracle_sql())


PAGES = "page_id long, url string, html string, host string, kind string"


def test_url_rules_and_propagation(spark):
    pages = [(1, "http://A.net/x?y", ""), (2, "https://example.net/en/a#b", ""), (3, "http://example.net/de/", ""),
             (4, "https://sub.example.com/de/x", '<a href="http://bad.io/">'), (5, "ftp://x.org/fr/", '<a href="//Good.io/z">'),
             (6, "http://bad.io/1", ""), (7, "http://good.io/1", '<a href=\'https://better.io/\'>'), (8, None, None),
             (9, "no scheme", "<a href='http://net.net/'>"), (10, "http://notnet/", ""), (11, "http://q.net", ""),
             (12, "http://links-bad.io/", '<a href="http://spam.net/a">'), (13, "http://spam.net/", ""),
             (14, "http://better.io/", ""), (14, "http://better.io/", "")]
    df = spark.createDataFrame([(*p, "h", "k") for p in pages], PAGES)
    got = collections.defaultdict(set)
    for r in url_filter.judge(df, queries.URL_RULES).collect():
        got[r.page_id].add((r.host, r.path, r.rule, r.verdict))
    assert got[1] == {("a.net", "/x", "net/", "block")}
    assert got[2] == {("example.net", "/en/a", "example.net/en/", "allow")}
    assert got[3] == {("example.net", "/de/", "net/", "block")}
    assert got[4] == {("sub.example.com", "/de/x", "example.com/de/", "block")}
    assert got[5] == {("x.org", "/fr/", "org/fr/", "allow")}
    assert got[8] == got[9] == {("", "", None, "allow")}
    assert got[10] == {("notnet", "/", None, "allow")} and got[11] == {("q.net", "", None, "allow")}
    assert got[12] == {("links-bad.io", "/", None, "block")}        # links to a blocked host
    assert got[7] == got[7] and {v for *_, v in got[7] | got[14]} == {"allow"}
    assert url_filter.judge(df.limit(0), queries.URL_RULES).count() == 0


def dense_ranks(hosts, seeds, links, damping):
    """Converged ranks by solving the linear system."""
    at, m = {h: i for i, h in enumerate(hosts)}, np.zeros((len(hosts), len(hosts)))
    for a, b, n in links:
        m[at[b], at[a]] += n
    m /= np.maximum(m.sum(0), 1)
    s = np.array([seeds.get(h, 0) for h in hosts], float)
    return np.linalg.solve(np.eye(len(hosts)) - damping * m, (1 - damping) * s / s.sum())


@pytest.mark.parametrize("damping,loops", [(0.85, []), (0.3, [("c3", "c1", 2.0), ("t2", "t1", 1.0)])])
def test_link_ranks_converge_on_long_paths(spark, damping, loops):
    chain = [(f"c{i}", f"c{i + 1}", 1.0) for i in range(13)] + [("c13", "bad", 3.0), ("c5", "side", 1.0)]
    # Two hops after a trusted seed, eight before a blocked one.
    trusted = [("good", "t1", 1.0), ("t1", "t2", 1.0)] + [(f"t{i}", f"t{i + 1}", 1.0) for i in range(2, 9)] + [("t9", "bad", 1.0)]
    links = chain + trusted + loops
    hosts = sorted({h for a, b, _ in links for h in (a, b)})
    seeds = spark.createDataFrame([("good", 1, 0), ("bad", 0, 1)], "host string, allowed long, blocked long")
    edges = spark.createDataFrame(links, "src string, dst string, n double")
    got = {r.host: r for r in url_filter.host_verdicts(seeds, edges, url_filter.LinkParams(damping=damping)).collect()}
    trust = dense_ranks(hosts, {"good": 1}, links, damping)
    distrust = dense_ranks(hosts, {"bad": 1}, [(b, a, n) for a, b, n in links], damping)
    assert set(got) == {h for h, t, d in zip(hosts, trust, distrust) if t + d > 0}
    for h, t, d in zip(hosts, trust, distrust):
        if t + d > 0:
            assert got[h].trust == pytest.approx(t, rel=1e-8) and got[h].distrust == pytest.approx(d, rel=1e-8)
            assert got[h].verdict == ("block" if d / (t + d) >= 0.5 else "allow")
    assert got["c0"].verdict == "block" and got["t2"].verdict == "allow"


def brute_scan(text, p):
    def split(s):
        return [w for w in re.split(r"[\W_]+", s.lower()) if w]

    out, w = {}, split(text or "")
    own = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    for name, body in license_scan.TEMPLATES:
        t = split(body)
        if len(t) < 5:
            continue
        parts = {tuple(t[i:i + 5]) for i in range(len(t) - 4)}
        _, window, step = license_scan.band_count(p, len(t))
        shares = {s: len(parts & set(own[s:s + window])) / len(parts) for s in range(0, len(own), step)}
        if hits := [s for s, v in shares.items() if v >= p.threshold]:
            out[name] = (max(shares.values()), min(hits))
    return out


def test_license_scan_equals_brute_force(spark):
    filler = " ".join(f"word{i}" for i in range(60))
    grant = dict(license_scan.TEMPLATES)["mit-grant"]
    texts = [None, "", "MIT", filler, f"{filler} Released under the MIT license. {filler}", filler + " " + grant,
             grant.replace("free of charge", "gratis") + filler, " ".join(grant.split()[:12]),
             "\n".join(b for _, b in license_scan.TEMPLATES), "Licensed under the Apache License, Version 3.1"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(9, texts[9])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("parts", F.lit(1)).withColumn("row", F.lit(2))
    got = {(r.doc_id, r.license_id): (r.containment, r.first_word) for r in license_scan.scan(df).collect()}
    p = license_scan.ScanParams()
    assert got == {(i, k): v for i, t in enumerate(texts) for k, v in brute_scan(t, p).items()}
    assert license_scan.scan(df.limit(0)).count() == 0
    assert license_scan.scan(df, templates=[("short", "three word notice")]).count() == 0


def test_license_scan_finds_reworded_notices_and_whole_texts(spark):
    filler = " ".join(f"word{i}" for i in range(40))
    notices = ["Licensed under the MIT License", "distributed under the MIT license", "Licensed under the Apache License v2",
               "licensed under Apache-2.0", "under the terms of the GNU Lesser General Public License",
               "under the GNU Affero General Public License", "Licensed under the ISC license",
               "Licensed under CC BY-SA 4.0", "dedicated to the public domain under CC0 1.0"]
    texts = [f"{filler}\n{x}.\n{filler}" for x in notices]
    for name in ("unlicense", "isc", "mit-text"):                       # a changed word is admitted
        body = dict(license_scan.TEMPLATES)[name].split()
        texts.append(" ".join([*body[:9], "changed", *body[10:]]))
    want = ["mit-licensed", "mit-distributed", "apache-2.0-short", "apache-2.0-brief", "lgpl-terms", "agpl", "isc-licensed",
            "cc-by-sa-4.0-short", "cc0-1.0", "unlicense", "isc", "mit-text"]
    texts += ["Licensed under CC BY-XY 4.0", "Released under the Foo License"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = collections.defaultdict(set)
    for r in license_scan.scan(df).collect():
        got[r.doc_id].add(r.license_id)
    assert all(w in got[i] for i, w in enumerate(want)) and set(got) == set(range(len(want)))
    assert got[7] == {"cc-by-sa-4.0-short"} and got[0] == {"mit-licensed"}


def test_token_counts(spark, tmp_path):
    got = queries.op9_token_counts(spark, SF_SMALL).collect()
    want = byte_bpe.round_trip(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), queries.rank_file()).collect()
    assert sorted(r.n_tokens for r in got) == sorted(r.n_tokens for r in want) and all(r.closed for r in got)
    got.sort(key=lambda r: r.doc_no)
    assert [r.doc_no for r in got] == list(range(len(got)))
    assert all(a.start + a.n_tokens + 1 == b.start for a, b in zip(got, got[1:]))


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_separator_scan_across_blocks_and_files(spark, tmp_path, block):
    files = [[5, 0, 0, 7, 7, 7], [7, 7, 7, 7], [], [7, 0, 1], [0, 9, 9]]
    for i, ids in enumerate(files):
        (tmp_path / f"part-{i}").write_bytes(np.array(ids, "<u2").tobytes())
    got = sorted(tuple(r) for r in token_files.scan(spark, f"file://{tmp_path}", block=block).collect())
    assert got == [(0, 0, 1, True), (1, 2, 0, True), (2, 3, 8, True), (3, 12, 1, True), (4, 14, 2, False)]


def test_token_files_of_odd_texts(spark):
    df = spark.createDataFrame([(None,), ("",), ("a b",)], "text string")
    folder = token_files.new_folder(ensure_checkpoint_dir(spark))
    token_files.write(df.coalesce(1), folder, queries.rank_file())
    assert [r.n_tokens for r in token_files.scan(spark, folder).orderBy("doc_no").collect()] == [0, 0, 2]


def brute_nearest(rows, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for q in ids[ids % 20 == 0]:
        s = (x * x[ids == q][0]).sum(1)
        s[ids == q] = -np.inf
        out[int(q)] = [(int(ids[i]), float(s[i])) for i in np.lexsort((ids, -s))[:k] if np.isfinite(s[i])]
    return out


def test_search_recall_and_scores(spark):
    got = collections.defaultdict(list)
    for r in queries.op10_lsh_search(spark, SF_SMALL).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    want = brute_nearest(rows, 20)
    found = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert found >= 0.9 * sum(map(len, want.values())) and set(got) == set(want)
    exact = {(q, i): s for q in want for i, s in brute_nearest(rows, len(rows))[q]}
    assert all(exact[q, i] == s for q in got for i, s in got[q])


def test_search_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 9.0]), (20, [0.0, 2.0]), (5, None), (40, [0.0, 0.0]),
            (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [float("inf"), 1.0]), (9, [1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("bucket", F.lit("x"))
    got = collections.defaultdict(list)
    for r in lsh_search.search(df, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert dict(got) == brute_nearest([rows[i] for i in range(5)], 20)
    assert lsh_search.search(df.limit(0), F.col("id") % 20 == 0).count() == 0
    many = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(90)], "vec_id long, embedding array<float>")
    small = lsh_search.search(many, F.col("id") % 20 == 0, lsh_search.LshParams(block=16, queries=2)).collect()
    firsts = sorted((r.rank, r.vec_id) for r in small if r.query_id == 20)
    assert [v for _, v in firsts] == [v for v in range(21) if v != 20] and len(small) == 5 * 20


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "ngram_jaccard_join", "source_mix", "byte_bpe"]
    held = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = stage(spark, held, SF_SMALL)
        assert held.columns == docs.columns, name
        held = held.checkpoint()
        assert held.count() > 0
    rows = corpus_pipeline.run(spark, SF_SMALL)
    assert rows.count() == held.count()
    kept = queries.op2_line_quality(spark, SF_SMALL).filter("kept").select("doc_id")
    assert rows.join(kept, "doc_id", "left_anti").count() == 0


def test_pipeline_near_copies_equal_brute_force(spark):
    rng = random.Random(4)
    vocab, docs = [f"w{i}" for i in range(2000)], []
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice([9, 30, 80, 120]))]
        docs.append(" ".join(base))
        for _ in range(5):
            x = list(base)
            for _ in range(rng.randint(0, max(1, len(x) // 30))):
                x[rng.randrange(len(x))] = rng.choice(vocab)
            docs.append(" ".join(x))
    # Two changed words of 100: five-word similarity 0.811, four-word 0.848.
    base = [f"v{i}" for i in range(100)]
    docs += [" ".join(base), " ".join(w if i not in (20, 50) else "new" for i, w in enumerate(base))]
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in map(str.split, docs)]
    assert len(sets[-1] & sets[-2]) / len(sets[-1] | sets[-2]) >= 0.8
    fours = [{tuple(w[i:i + 4]) for i in range(len(w) - 3)} for w in (docs[-1].split(), docs[-2].split())]
    assert len(fours[0] & fours[1]) / len(fours[0] | fours[1]) < 0.85
    first = list(range(len(docs)))
    for _ in docs:                                               # the smallest document reachable by links
        for i in range(len(docs)):
            for j in range(i):
                if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                    first[i] = first[j] = min(first[i], first[j])
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    kept = dict(corpus_pipeline.STAGES)["ngram_jaccard_join"](spark, df, SF_SMALL)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(first))
