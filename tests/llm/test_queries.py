"""Registered queries against their SQL twins and a whole pipeline run."""

from __future__ import annotations

import hashlib
import math
import os
import re
import sys
import zlib
from collections import Counter

import pyarrow as pa
import pytest
import tokenizers
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from meterkit.checks.compare import compare  # noqa: E402
from meterkit.llm import quality  # noqa: E402
from meterkit.llm import queries as Q  # noqa: E402

from .test_dedup import brute_near  # noqa: E402
from .test_text import brute_hits  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    result = compare(Q.queries()[name](spark, SMALL), Q.oracle_sql()[name], SMALL)
    assert result["columns_match"] and result["values_match"], result


def test_every_operator_has_one_query():
    numbers = [int(n[2:].split("_")[0]) for n in Q.queries()]
    assert sorted(numbers) == list(range(1, 14))


def test_sharding_query(spark):
    rows = Q.op3_sharding(spark, SMALL).collect()
    sizes = [sum(r.shard == s for r in rows) for s in range(16)]
    assert len(rows) == 200 and max(sizes) - min(sizes) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s])) for s in range(16))


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """A folder of tables with the awkward documents."""
    from . import cases

    folder = str(tmp_path_factory.mktemp("awkward"))
    rows = [*cases.texts(), *((400 + i, " ".join(cases.words(30, i))) for i in range(40))]
    cases.documents(spark, rows).selectExpr("*", "'en' as lang", "'web' as source", "cast(length(text) as bigint) as n_chars").write.parquet(
        f"{folder}/documents.parquet")
    spark.createDataFrame([("i1", " ".join(cases.words(30, 2))), ("i2", None), ("i3", "one two")], "item_id string, text string").write.parquet(
        f"{folder}/benchmark.parquet")
    labels = [(i, int(i % 3 > 0), 0) for i in range(400, 440)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def _crc(i):
    return None if i is None else zlib.crc32(str(i).encode())


def _library():
    return tokenizers.Tokenizer.from_file(Q.tokenizer_file())


def test_scoring_query_against_brute_force(spark, awkward):
    folder, rows = awkward

    def tokens(text):
        return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").encode().lower().decode()), None]

    counts = Counter(w for i, t in rows if i is not None and _crc(i) % 5 != 1 for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w)
        want[i, i is None or _crc(i) % 5 == 1, len(w), sum(counts[x] > 0 for x in w), total, round(base, 4)] += 1
    out = Q.op1_ctw_scoring(spark, folder).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out) == want
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in out)


def test_shard_query_against_brute_force(spark, awkward):
    folder, rows = awkward
    out = Q.op3_sharding(spark, folder).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)


def test_token_queries_against_the_library(spark, awkward):
    folder, rows = awkward
    library, sha = _library(), lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = [library.encode(t or "", add_special_tokens=False).ids for _, t in rows]
    assert Counter(tuple(r) for r in Q.op6_token_counts(spark, folder).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()) == Counter(
        (i, len((t or "").encode()), len(x), len(x) > 512) for (i, t), x in zip(rows, ids))
    want = Counter((i, len(x), sha(",".join(map(str, x))), sha(library.decode(x, skip_special_tokens=False))) for (i, _), x in zip(rows, ids))
    assert Counter(tuple(r) for r in Q.op7_bpe_round_trip(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == want


def test_quality_query_rows(spark, awkward):
    folder, rows = awkward
    out = Q.op8_quality(spark, folder).collect()
    assert Counter((r.doc_id, r.held_out) for r in out) == Counter((i, i is not None and _crc(i) % 4 == 2) for i, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)


def test_pipeline_run_against_an_independent_chain(spark):
    """run()'s rows: scores cut at 0.7, largest id of equal texts, smallest of
    near copies, hits under 5 %, the library's ids and text."""
    docs = {r.doc_id: r.text for r in Q.table(spark, SMALL, "documents").collect()}
    model = Q.quality_model(spark, Q.table(spark, SMALL, "documents").select("doc_id", "text"), SMALL)
    part = pa.RecordBatch.from_pydict({"text": pa.array(list(docs.values()), pa.string())})
    kept = [(i, t) for (i, t), s in zip(docs.items(), model.score(quality.features(part, "text"))) if s >= 0.7]
    best = {}
    for i, t in kept:
        best[t] = max(i, best.get(t, i))
    kept = [(i, t) for i, t in kept if best[t] == i]
    near = {d for d, _, c in brute_near(kept, 5, 80) if d == c} | {d for d, t in kept if not (t or "").split()}
    kept = [(i, t) for i, t in kept if i in near]
    benchmark = [(r.item_id, r.text) for r in Q.table(spark, SMALL, "benchmark").collect()]
    clean = {d for d, n, h, _ in brute_hits(kept, benchmark) if not (h and 20 * h >= n)}
    library, want = _library(), Counter()
    for i, t in kept:
        if i in clean:
            ids = library.encode(t or "", add_special_tokens=False).ids
            want[i, t, tuple(ids), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    got = Counter((r.doc_id, r.text, tuple(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, SMALL).collect())
    assert got == want and len(got) > 50


def test_quality_query_on_held_out_rows(spark):
    out = Q.op8_quality(spark, "/root/testdata/sf0.01").join(Q.table(spark, "/root/testdata/sf0.01", "labels"), "doc_id")
    held = out.where("held_out").select("predicted", "quality").collect()
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.9


def test_pipeline_stages_follow_their_operators(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    benchmark = [(r.item_id, r.text) for r in Q.table(spark, SMALL, "benchmark").collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, SMALL).cache()
        after = {r.doc_id for r in out.collect()}
        if i < 4:
            assert out.columns == columns
        if i == 1:
            best = {}
            for d, t in before:
                best[t] = max(d, best.get(t, d))
            assert after == set(best.values())
        elif i == 2:
            assert after == {d for d, _, c in brute_near(before, 5, 80) if d == c} | {d for d, t in before if not (t or "").split()}
        elif i == 3:
            assert after == {d for d, n, h, _ in brute_hits(before, benchmark) if not (h and 20 * h >= n)}
        elif i == 4:
            assert after == {d for d, _ in before}
        docs = out.select(*columns)
    assert corpus_pipeline.run(spark, SMALL).select(F.count("ids")).first()[0] == len(after)


def test_stages_take_awkward_rows_and_clashing_columns(spark):
    from . import cases

    extra = [*cases.CLASHING, "__score", "ids", "n_tokens", "items", "__near_id", "__copy_key", "__own_items", "__n"]
    rows = cases.texts()
    docs = cases.documents(spark, rows).select("*", *(F.lit(c).alias(c) for c in extra))
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.columns[:len(docs.columns)] == docs.columns
        assert len({c.lower() for c in out.columns}) == len(out.columns)
        assert out.select("doc_id").collect() is not None
        assert stage(spark, docs.limit(0), SMALL).collect() == []
