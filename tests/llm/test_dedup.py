"""Near-dedup, substring dedup and union-find against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from meterkit.llm import near_dedup, substring_dedup, unionfind
from meterkit.llm import words as W

from . import cases

SPACE = re.compile("[ \t\n\v\f\r]+")


def split(text):
    return [w for w in SPACE.split(text or "") if w]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_near(rows, k, threshold):
    sets = []
    for _, text in rows:
        w = split(lower(text))
        sets.append({tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        r = root(i)
        least[r] = min(least.get(r, doc_id), doc_id, key=cases.key)
    return Counter((doc_id, len(sets[i]), least[root(i)]) for i, (doc_id, _) in enumerate(rows))


@pytest.mark.parametrize("k,threshold", [(3, 85), (5, 80)])
def test_near_groups_match_brute_force(spark, k, threshold):
    rows = cases.texts()
    got = near_dedup.near_groups(cases.documents(spark, rows), shingle=k, threshold=threshold).collect()
    assert Counter((r.id, r.n_shingles, r.component_id) for r in got) == brute_near(rows, k, threshold)
    parts = Counter((r.component_id, r.n_shingles if not r.n_shingles else 1) for r in got if r.kept and r.n_shingles)
    assert set(parts.values()) == {1}


def test_near_copies_of_a_base_that_link_only_over_it(spark):
    """A chain cluster: copies are near the base, not near each other."""
    base = cases.words(80, 9, 5000)
    r = random.Random(4)
    rows = [(500, " ".join(base))]
    for i in range(60):
        own = list(base)
        for p in r.sample(range(80), 2):
            own[p] = f"new{i}x{p}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join(cases.words(50, 50 + i, 5000))) for i in range(20)]
    got = near_dedup.near_groups(cases.documents(spark, rows), shingle=3, threshold=85).collect()
    assert Counter((x.id, x.n_shingles, x.component_id) for x in got) == brute_near(rows, 3, 85)


def test_near_dedup_of_nothing_and_with_other_columns(spark):
    assert near_dedup.near_groups(cases.documents(spark, [])).collect() == []
    df = cases.with_clashes(cases.documents(spark))
    out = near_dedup.drop_near_copies(df)
    assert out.columns == df.columns
    kept = {r.id for r in near_dedup.near_groups(df).where("kept").collect()}
    assert {r.doc_id for r in out.collect()} == kept
    assert "LeftSemi" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_signatures_estimate_similarity():
    r = np.random.default_rng(1)
    a = W.mix64(r.integers(0, 2**63, 300).astype(np.uint64))
    b = np.concatenate((a[:240], W.mix64(r.integers(0, 2**63, 60).astype(np.uint64))))
    h = near_dedup.super_minhash(np.concatenate((a, b)), np.repeat([0, 1], 300), 2, 2000)
    assert abs((h[0] == h[1]).mean() - 240 / 360) < 0.05


def test_signature_is_that_of_the_element_by_element_walk():
    """Early stopping changes nothing: all ranks of all elements give the same."""
    m, elements = 24, W.mix64(np.arange(1, 8, dtype=np.uint64))
    want = np.full(m, np.inf)
    for e in elements:
        order = list(range(m))
        for rank in range(m):
            x = W.mix64(e + np.uint64((rank + 1) * 0x9E3779B97F4A7C15 % 2**64))
            pick = rank + (int(W.mix64(x ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)) * (m - rank) >> 32)
            order[rank], order[pick] = order[pick], order[rank]
            want[order[rank]] = min(want[order[rank]], float(x >> np.uint64(11)) * 2.0 ** -53 + rank)
    got = near_dedup.super_minhash(elements, np.zeros(7, dtype=np.int64), 1, m)[0]
    assert np.array_equal(got, want)


def test_components_of_random_links(spark):
    r = random.Random(5)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(50)] + [(7, 7)]
    got = {x.node: x.comp for x in unionfind.components(spark.createDataFrame(links, "u long, v long").repartition(4)).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in links:
        if u != v:
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    assert got == {x: root(x) for x in list(parent)}
    assert unionfind.components(spark.createDataFrame([], "u long, v long")).collect() == []


def brute_repeats(rows, n=20):
    import zlib

    docs = sorted({(-(2**63) if i is None else i, zlib.crc32((t or "").encode()), t or "") for i, t in rows})
    seen, out = set(), {}
    for d in docs:
        w = split(d[2])
        gone = set()
        for i in range(len(w) - n + 1):
            g = tuple(w[i:i + n])
            if g in seen:
                gone.update(range(i, i + n))
            seen.add(g)
        out[d] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    return Counter((i, *out[-(2**63) if i is None else i, zlib.crc32((t or "").encode()), t or ""]) for i, t in rows)


def test_repeats_match_brute_force(spark, monkeypatch):
    rows = cases.texts() + [(300 + i, " ".join(cases.words(40, i % 7, 4))) for i in range(30)]
    for block in (substring_dedup.BLOCK_BYTES, 500):
        monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", block)
        out = substring_dedup.remove_repeats(cases.with_clashes(cases.documents(spark, rows, 4)))
        assert Counter((r.id, r.n_words, r.n_removed, r.kept_text) for r in out.collect()) == brute_repeats(rows)


def test_repeats_of_nothing(spark):
    assert substring_dedup.remove_repeats(cases.documents(spark, [])).collect() == []
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(cases.documents(spark), window=5)


def test_settling_carries_an_anchor_over_batches(spark):
    """Many rows of one anchor, more than an Arrow batch holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        passage = " ".join(cases.words(26, 77))
        rows = [(i, f"own{i} {passage} tail{i % 3}") for i in range(60)]
        out = substring_dedup.remove_repeats(cases.documents(spark, rows, 30))
        assert Counter((r.id, r.n_words, r.n_removed, r.kept_text) for r in out.collect()) == brute_repeats(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_frequent_phrase_is_spread(spark, monkeypatch):
    """A short phrase with new words around it each time: its anchor's windows
    do not all go to one task."""
    monkeypatch.setattr(substring_dedup, "LEAST", 200, raising=False)
    dealt, settle = [], substring_dedup.settle
    monkeypatch.setattr(substring_dedup, "settle", lambda rows, window: dealt.append(rows) or settle(rows, window))
    phrase, twice = " ".join(cases.words(8, 70)), " ".join(cases.words(15, 71, 9999))
    rows = [(i, f"{' '.join(cases.words(14, 1000 + i, 9999))} {phrase} {' '.join(cases.words(14, 2000 + i, 9999))}") for i in range(300)]
    rows += [(500 + i, f"own{i} {phrase} {twice} end{i}") for i in range(40)]
    out = substring_dedup.remove_repeats(cases.documents(spark, rows, 4)).collect()
    assert Counter((r.id, r.n_words, r.n_removed, r.kept_text) for r in out) == brute_repeats(rows)
    held = dealt[0].where("words is not null").groupBy("anchor").agg({"length": "sum"}).collect()
    assert sum(n for _, n in held) > 300 and len(held) > 300
    assert max(n for _, n in held) < 200


@pytest.mark.parametrize("block", [500, 4 << 20])
def test_words_decide_where_all_hashes_collide(spark, monkeypatch, block):
    """Every window has one of four hashes: within a block and across blocks
    only the words tell windows apart. (Tasks run with what is patched here.)"""
    rows = cases.texts()[3:16] + [(300 + i, " ".join(cases.words(40, i % 7, 4))) for i in range(30)]

    def one_block(part):
        hashes = W.window_hashes
        with monkeypatch.context() as m:
            m.setattr(W, "window_hashes", lambda h, n: hashes(h, n) & np.uint64(3) if n == 20 else hashes(h, n) * np.uint64(0))
            return substring_dedup.stretches(part, 20, 6, np.zeros(0, dtype=np.uint64))

    import zlib

    import pyarrow as pa
    docs = pa.RecordBatch.from_pydict({"id": [i for i, _ in rows], "check": [zlib.crc32((t or "").encode()) for _, t in rows],
                                       "text": [t or "" for _, t in rows]})
    table = pa.Table.from_batches([b for part in W.slices(docs, "text", block, 1 << 30) for b in one_block(part)])
    assert len(set(table.column("anchor").to_pylist())) < len(rows) * 5
    table = table.sort_by([(c, "ascending") for c in ("anchor", "id", "check", "start")])
    plain = spark.createDataFrame(table.to_pandas(), "anchor long, id long, check long, start int, length int, words binary").coalesce(1)
    gone = {}
    for r in substring_dedup.settle(plain.sortWithinPartitions("anchor", "id", "check", "start"), 20).collect():
        gone.setdefault((r.id, r.check), set()).update(range(r.start, r.start + r.length + 19))
    want = {}
    for (i, n, removed, kept), _ in brute_repeats(rows).items():
        want.setdefault(i, []).append(removed)
    got = {}
    for i, t in rows:
        got.setdefault(i, []).append(len(gone.get((i, zlib.crc32((t or "").encode())), ())))
    assert {i: sorted(set(v)) for i, v in got.items()} == {i: sorted(set(v)) for i, v in want.items()}


def test_greedy_factors_end_at_their_border():
    reference = substring_dedup.Reference(3)
    assert reference.parse((1, 0, 0), b"a b c d e f") == []
    assert reference.parse((2, 0, 0), b"x b c d e y c d e f") == [(1, 2), (6, 2)]
    assert reference.parse((1, 0, 0), b"a b c d e f") == []  # the same document again
    assert reference.parse((3, 0, 4), b"b c d e f") == [(0, 3)]


def test_word_spans_match_a_plain_split():
    import pyarrow as pa

    rows = [t for _, t in cases.texts()]
    column = pa.array(rows[2:], pa.string())
    data, offsets = W.text_bytes(column)
    starts, ends, first = W.spans(data, offsets, W.NOT_SPACE)
    for i, text in enumerate(rows[2:]):
        got = [data[a:b].tobytes().decode() for a, b in zip(starts[first[i]:first[i + 1]], ends[first[i]:first[i + 1]])]
        assert got == split(text)
    hashed = W.word_hashes(data, starts, ends)
    said = [data[a:b].tobytes() for a, b in zip(starts, ends)]
    assert len(set(hashed.tolist())) == len(set(said)) == len(set(zip(said, hashed.tolist())))
