"""Line dedup, n-gram join, embeddings, repeated passages."""

import random

import numpy as np
import pytest

import brute
from stockmill.llm import embedding_dedup, line_dedup, ngram_join, suffix_dedup
from stockmill.llm.components import components


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(1001, 1200)]
    got = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.id: r.component for r in got} == {
        **{i: 0 for i in range(61)}, **{i: 1000 for i in range(1000, 1200)}}


@pytest.fixture(scope="module")
def lines():
    rng = random.Random(5)
    base = [[f"v{rng.randrange(9)}" for _ in range(rng.randrange(1, 14))] for _ in range(25)]
    docs = []
    for d in range(40):
        rows = []
        for _ in range(rng.randrange(6)):
            w = list(rng.choice(base))
            kind = rng.randrange(4)
            if kind == 1:
                w[rng.randrange(len(w))] = f"z{rng.randrange(3)}"
            elif kind == 2:
                w.insert(rng.randrange(len(w) + 1), f"z{rng.randrange(3)}")
            elif kind == 3:
                del w[rng.randrange(len(w))]
            rows.append(" ".join(w).upper() if rng.random() < .5 else ", ".join(w) + ".")
        docs.append((d, "\n".join(rows)))
    return docs


def test_line_dedup_equals_comparison(make_docs, lines):
    got = line_dedup.dedupe_lines(make_docs(lines)).collect()
    want = brute.repeated_lines(lines)
    assert {r.row.doc_id: list(r.out.dropped) for r in got} == want
    for r in got:
        kept = [x for i, x in enumerate((r.row.text or "").split("\n")) if i not in
                want[r.row.doc_id]]
        assert r.out.text == "\n".join(kept)


def test_line_dedup_of_odd_rows(make_docs, odd_rows, clashing):
    got = line_dedup.dedupe_lines(make_docs(odd_rows, clashing)).collect()
    assert len(got) == len(odd_rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.row.doc_id, []).append(r.out)
    assert [o.text for o in by_id[4]] == ["the same short line here"]
    assert [o.text for o in by_id[5]] == ["", ""]
    assert by_id[1][0].text is None and by_id[2][0].text == ""
    assert line_dedup.dedupe_lines(make_docs([])).count() == 0


def near_copies(rng, n, base=6):
    texts = [[f"w{rng.randrange(5000)}" for _ in range(rng.randrange(2, 120))]
             for _ in range(base)]
    docs = []
    for d in range(n):
        w = list(rng.choice(texts))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        docs.append((d, " ".join(w)))
    return docs


@pytest.mark.parametrize("block", [96, 4])
def test_ngram_join_equals_comparison(make_docs, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    docs = near_copies(random.Random(block), 90)
    got = {r.doc_id: r for r in ngram_join.similar(make_docs(docs)).collect()}
    names, counts = brute.similar(docs)
    assert {d: r.component_id for d, r in got.items()} == names
    assert {d: r.n_links for d, r in got.items()} == counts


def test_ngram_join_of_odd_rows(make_docs, odd_rows, clashing):
    got = ngram_join.similar(make_docs(odd_rows, clashing)).collect()
    assert len(got) == len(odd_rows)
    assert sorted((r.doc_id, r.component_id, r.n_links) for r in got if r.doc_id in (4, 5)) == [
        (4, 4, 2), (5, 4, 2), (5, 4, 2)]
    assert all(r.n_links == 0 for r in got if r.doc_id not in (4, 5))
    assert ngram_join.similar(make_docs([])).count() == 0


def test_classes_do_not_depend_on_ids(make_docs):
    """Rows that share an id, and rows without one, link as if each had its own."""
    docs = near_copies(random.Random(11), 60)
    docs += [(60, docs[7][1]), (61, docs[7][1].upper()), (62, ""), (63, None)]
    names, counts = brute.similar(docs)
    shared = ngram_join.similar(make_docs([(d // 8, f"{t or ''}") for d, t in docs])).collect()
    assert sorted(r.n_links for r in shared) == sorted(counts.values())
    for low in range(8):
        want = sorted(min(x // 8 for x in names if names[x] == names[d])
                      for d, _ in docs if d // 8 == low)
        assert sorted(r.component_id for r in shared if r.doc_id == low) == want
    without = ngram_join.similar(make_docs([(None, t) for _, t in docs])).collect()
    assert sorted(r.n_links for r in without) == sorted(counts.values())
    assert all(r.class_id is None and r.component_id is None for r in without)
    half = ngram_join.similar(make_docs([(d if d % 2 else None, t) for d, t in docs])).collect()
    assert sorted(r.n_links for r in half) == sorted(counts.values())
    odd = {d: min((x for x in names if x % 2 and names[x] == names[d]), default=None)
           for d, _ in docs}
    assert {r.doc_id: r.component_id for r in half if r.doc_id is not None} == {
        d: c for d, c in odd.items() if d % 2}


def test_bands_reach_the_recall():
    bands = ngram_join.bands_for(0.8, 0.9999, 5)
    assert 1 - (1 - 0.8 ** 5) ** bands >= 0.9999 > 1 - (1 - 0.8 ** 5) ** (bands - 1)


def test_embeddings_equal_comparison(spark):
    rng = np.random.default_rng(4)
    rows, centers = [], rng.standard_normal((12, 24))
    for i in range(260):
        x = centers[i % 12] + rng.standard_normal(24) * (0.12 if i % 3 else 1.5)
        rows.append((i * 7, [float(v) for v in x]))
    rows += [(10_000, rows[5][1]), (10_001, rows[5][1]), (10_002, None), (10_003, []),
             (10_004, [0.0] * 24), (10_005, [float("nan")] * 24), (10_006, [None] * 24),
             (10_007, [1.0, 2.0]), (10_008, [2.0, 4.0]), (None, rows[6][1])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows],
                               "vec_id bigint, embedding array<double>, name int").repartition(3)
    found, recall = embedding_dedup.near_duplicates(df)
    got = {r.vec_id: r for r in found.collect() if r.vec_id is not None}
    units = {i: embedding_dedup.unit(v) for i, v in rows if i is not None}

    def linked(a, b):
        a, b = units[a], units[b]
        return a is not None and b is not None and len(a) == len(b) and a @ b >= 0.9

    names, counts = brute.groups(list(units), linked)
    null_links = {i: linked(i, rows[6][0]) for i in units if units[i] is not None}
    assert recall >= 0.99
    assert {i: r.component_id for i, r in got.items()} == names
    for i, n in counts.items():
        assert got[i].n_links == n + (null_links.get(i, False) or (i == rows[6][0]))


def test_no_embeddings(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    found, recall = embedding_dedup.near_duplicates(empty)
    assert found.count() == 0 and recall == 1.0


@pytest.mark.parametrize("limit", [1000, 2])
def test_repeated_passages_equal_comparison(make_docs, limit):
    rng = random.Random(8)
    passages = ["".join(rng.choice("abcé ") for _ in range(60)) for _ in range(4)]
    docs = []
    for d in range(60):
        body = "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(50)))
        p = rng.choice(passages)
        cut = rng.randrange(30)
        docs.append((d, body + (p[cut:] if d % 2 else p[:len(p) - cut]) + body[:10]))
    docs += [(60, docs[3][1]), (61, "ab" * 70), (62, None), (63, ""), (64, "a" * 200)]
    got = {r.row.doc_id: r.out for r in suffix_dedup.dedupe(
        make_docs(docs), window=24, core=8, limit=limit).collect()}
    want = brute.repeated_spans(docs, 24)
    assert {d: [list(s) for s in o.spans] for d, o in got.items()} == want
    for d, text in docs:
        data, kept = (text or "").encode(), b""
        end = 0
        for a, b in want[d]:
            kept, end = kept + data[end:a], b
        assert bytes(got[d].kept) == kept + data[end:] and got[d].n_bytes == len(data)


def test_repeated_passages_of_odd_rows(make_docs, odd_rows, clashing):
    got = suffix_dedup.dedupe(make_docs(odd_rows, clashing)).collect()
    assert len(got) == len(odd_rows)
    assert {r.row.doc_id for r in got if r.out.spans} == {6}
    assert suffix_dedup.dedupe(make_docs([])).count() == 0


def test_one_crowded_core_goes_to_many_tasks(make_docs, monkeypatch):
    """A passage among 1,200 different surroundings, some of them equal for a window."""
    rng = random.Random(15)

    def some(letters, n):
        return "".join(rng.choice(letters) for _ in range(n))

    far, near, passage = "abcdefghijklm", "no", some("pqrst", 17)
    docs = [(d, some(far, 16) + some(near, 4) + passage + some(near, 4) + some(far, 16))
            for d in range(1200)]
    docs += [(1200, docs[4][1]), (1201, passage), (1202, docs[5][1][8:50])]
    kept, stored = {}, suffix_dedup.stored

    def seen(df, label):
        held = stored(df, label)
        kept.setdefault(label, []).append(held)
        return held

    monkeypatch.setattr(suffix_dedup, "stored", seen)
    got = {r.row.doc_id: r.out for r in suffix_dedup.dedupe(
        make_docs(docs), window=24, core=8).collect()}
    kinds = [r.kinds for r in kept["mixed-cores"][0].collect()]
    most = max(suffix_dedup.LEAST, sum(kinds) // 4)
    assert max(kinds) > most
    rounds = [r.groupBy("core", "kinds").agg({"low": "count", "context": "count"}).toDF(
        "core", "kinds", "rows", "contexts").collect() for r in kept["piece-rest"]]
    assert all(r.rows == r.kinds for found in rounds for r in found)  # copies do not go on
    assert any(r.contexts < r.rows for found in rounds for r in found)
    assert not any(r.kinds > most for r in rounds[-1])
    want = brute.repeated_spans(docs, 24)
    assert {d: [list(s) for s in o.spans] for d, o in got.items()} == want
    assert 0 < sum(map(bool, want.values())) < len(want)


def clumps(rng, sizes, inside=0.99, across=0.93, dims=64):
    """Tight clumps of distinct vectors, in pairs whose centres are apart by ``across``."""
    rows = []
    for pair in sizes:
        base, side = np.linalg.qr(rng.standard_normal((dims, 2)))[0].T
        half = np.arccos(across) / 2
        for n, turn in zip(pair, (-half, half)):
            center = np.cos(turn) * base + np.sin(turn) * side
            for _ in range(n):
                x = center + rng.standard_normal(dims) * np.sqrt((1 / inside - 1) / dims)
                rows.append(x / np.linalg.norm(x))
    return np.stack(rows)


def links_of(vectors):
    links = vectors @ vectors.T >= 0.9
    np.fill_diagonal(links, False)
    return links.sum(1)


def test_links_between_tight_clumps(spark):
    """The ten best of every point are in its own clump; its links to the other one count too."""
    x = clumps(np.random.default_rng(6), [(20, 20), (60, 15)])
    want = links_of(x)
    assert want[:40].min() > 19  # more than the own clump
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)],
                               "vec_id bigint, embedding array<double>").repartition(3)
    found, recall = embedding_dedup.near_duplicates(df)
    got = {r.vec_id: (r.n_links, r.component_id) for r in found.collect()}
    assert got == {i: (n, 0 if i < 40 else 40) for i, n in enumerate(want)}
    assert recall == 1.0


def test_audit_sees_small_groups_beside_a_large_one(spark):
    """A third of the points is one group; the links of all pairs are missed."""
    rng = np.random.default_rng(9)
    center = rng.standard_normal(32)
    hot = center + 0.05 * rng.standard_normal((300, 32))
    pairs = np.repeat(rng.standard_normal((300, 32)), 2, 0) + 0.05 * rng.standard_normal((600, 32))
    x = np.concatenate([hot, pairs])
    x /= np.linalg.norm(x, axis=1)[:, None]
    points = spark.createDataFrame([(i, i, 1, bytearray(v.tobytes())) for i, v in enumerate(x)],
                                   "id bigint, part bigint, copies bigint, unit binary")
    parts = spark.createDataFrame([(i, 0) for i in range(300)], "id bigint, part bigint")
    links = spark.createDataFrame([(i, 299) for i in range(300)], "id bigint, links bigint")
    assert embedding_dedup._audit(points, parts, links, 0.9, 64) < 0.1
    found = parts.union(spark.createDataFrame(
        [(i, i - i % 2) for i in range(300, 900)], "id bigint, part bigint"))
    links = links.union(spark.createDataFrame(
        [(i, 1) for i in range(300, 900)], "id bigint, links bigint"))
    assert embedding_dedup._audit(points, found, links, 0.9, 64) == 1.0


def test_rounds_go_on_while_small_groups_gain(spark):
    """1,000 full lists do not hide that lists with room gain links."""
    def lists(n):
        return spark.range(1000).selectExpr("id", "10 AS links").union(
            spark.range(1000, 1020).selectExpr("id", f"IF(id < {n}, 1, 0) AS links"))

    assert not embedding_dedup._settled(lists(1000), lists(1010), 10)
    assert embedding_dedup._settled(lists(1010), lists(1010), 10)


def test_short_recall_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "_audit", lambda *_: 0.5)
    monkeypatch.setattr(embedding_dedup, "ATTEMPTS", 1)
    df = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(RuntimeError, match="0.5"):
        embedding_dedup.near_duplicates(df)
