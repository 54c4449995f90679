"""Tokens, scores, quality, decontamination and preferences."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meterkit.llm import bpe, ctw, decontaminate, preferences, pretokens, quality, token_counts
from meterkit.llm.queries import tokenizer_file

from . import cases
from .test_dedup import lower, split

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(tokenizer_file())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_counts_match_the_library(spark, library):
    rows = cases.texts()
    df = cases.with_clashes(cases.documents(spark, rows))
    out = token_counts.count_tokens(df, tokenizer_file())
    assert out.columns == [*(c for c in df.columns if c != "text"), "n_tokens"]
    want = Counter((i, len(ids_of(library, t))) for i, t in rows)
    assert Counter((r.doc_id, r.n_tokens) for r in out.collect()) == want


@pytest.mark.parametrize("chunk,overlap", [(40, 8), (100, 40), (200, 4)])
def test_counts_of_chunks_match_the_library(spark, library, chunk, overlap):
    """Tiny chunks: runs longer than the overlap force it to widen."""
    r = random.Random(chunk)
    odd = ["<|endoftext|>", " ", "  ", "\n\n", "'s", "word", "é漢", "123", "!?", "x" * 90, "\t", " " * 70, "\U0001f600"]
    rows = [(i, "".join(r.choice(odd) for _ in range(r.randrange(1, 120)))) for i in range(60)]
    rows += [(99, None), (99, ""), (None, "a" * 3000), (98, "<|endoftext|>" * 50)]
    out = token_counts.count_tokens(cases.documents(spark, rows), tokenizer_file(), chunk=chunk, overlap=overlap).collect()
    assert Counter((x.doc_id, x.n_tokens) for x in out) == Counter((i, len(ids_of(library, t))) for i, t in rows)


def test_counting_nothing_and_clashes(spark):
    assert token_counts.count_tokens(cases.documents(spark, []), tokenizer_file()).collect() == []
    clash = token_counts.count_tokens(cases.documents(spark).withColumn("N_tokens", F.lit(1)), tokenizer_file())
    assert clash.columns == ["doc_id", "N_tokens", "n_tokens_1"] and clash.count() == len(cases.texts())


def test_ids_and_round_trip_match_the_library(spark, library):
    rows = cases.texts()
    df = cases.with_clashes(cases.documents(spark, rows))
    encoded = bpe.encode(df, tokenizer_file())
    got = bpe.decode(encoded, tokenizer_file()).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == Counter(
        (i, tuple(ids_of(library, t)), library.decode(ids_of(library, t), skip_special_tokens=False)) for i, t in rows)
    digests = bpe.round_trip(df, tokenizer_file()).collect()
    want = Counter((i, hashlib.sha256(",".join(map(str, ids_of(library, t))).encode()).hexdigest(),
                    hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert Counter((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in digests) == want
    kept = bpe.round_trip(df, tokenizer_file(), keep_ids=True).collect()
    assert Counter((r.doc_id, r.text, tuple(r.ids), r.n_tokens) for r in kept) == Counter(
        (i, t, tuple(ids_of(library, t)), len(ids_of(library, t))) for i, t in rows)
    assert bpe.encode(cases.documents(spark, []), tokenizer_file()).collect() == []
    for clash in (bpe.encode, bpe.round_trip):
        out = clash(df.withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit("x")), tokenizer_file())
        assert out.count() == len(rows) and len(set(out.columns)) == len(out.columns)


def test_prefix_program_matches_the_library_on_random_text(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 300)  # caches turn over
    with open(tokenizer_file(), encoding="utf-8") as f:
        own = bpe.Encoder(f.read())
    r = random.Random(1)
    letters = "ab '  \n\t\r1é²漢\U0001f600ZñŒ\x00\x1c\x85  ՘ⓐ!?.,_" + "aaaa"
    newer = sorted(pretokens.newer_letters()[0])
    for i in range(1500):
        text = "".join(r.choice(letters) for _ in range(r.randrange(60)))
        if i % 5 == 0:
            text += "<|endoftext|>" + text
        if i % 7 == 0:
            text += r.choice(newer) + "b1 " + r.choice(newer)
        want = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ",".join(map(str, want)), text
        assert own.decode(own.encode(text)) == library.decode(want, skip_special_tokens=False)


def test_short_pieces_of_many_texts_are_settled_together(library, monkeypatch):
    with open(tokenizer_file(), encoding="utf-8") as f:
        own = bpe.Encoder(f.read())
    one_by_one = []
    plain = bpe.Encoder.encode_bytes
    monkeypatch.setattr(bpe.Encoder, "encode_bytes", lambda self, data: one_by_one.append(data) or plain(self, data))
    monkeypatch.setattr(bpe, "REMEMBERED", 500)  # caches turn over
    monkeypatch.setattr(bpe, "TOGETHER", 70)
    r = random.Random(3)
    letters = "aeinrst ehth  \n1é²漢\U0001f600Zñ!?.,_"
    for _ in range(6):
        texts = [None, "", "<|endoftext|>", "x" * 300, *("".join(r.choice(letters) for _ in range(r.randrange(200))) for _ in range(60))]
        for text, ids in zip(texts, own.encode_all(texts), strict=True):
            assert ids == ",".join(map(str, ids_of(library, text))), text
    assert one_by_one and all(len(data) > bpe.SHORT for data in one_by_one)


def test_compatible_pairs_are_those_that_merging_leaves_alone():
    with open(tokenizer_file(), encoding="utf-8") as f:
        own = bpe.Encoder(f.read())
    r = random.Random(2)
    common = sorted(own.token)[:3000]
    for _ in range(4000):
        a, b = r.choice(common), r.choice(common)
        assert own.compatible(a, b) == (bpe.merge_by_rank(own.tables, own.token[a] + own.token[b]) == [a, b])


def test_other_tokenizer_kinds_are_refused():
    with open(tokenizer_file("word_bpe_49k.json"), encoding="utf-8") as f:
        content = f.read()
    with pytest.raises(ValueError):
        pretokens.load(content)


# --- context-tree weighting

def brute_scores(rows, train, depth):
    tokens = [split(lower(t)) for _, t in rows]
    streams = [b"\n" * depth + (" ".join(w) + "\n").encode() for w in tokens]
    counts, words = {}, Counter()
    for s, w, t in zip(streams, tokens, train):
        if t:
            words.update([*w, "\n"])
            for p in range(depth, len(s)):
                for b in range(8):
                    for k in range(depth + 1):
                        e = counts.setdefault(((1 << b) | (s[p] >> (8 - b)), s[p - k:p]), [0, 0])
                        e[(s[p] >> (7 - b)) & 1] += 1
    kt = lambda a, b: math.lgamma(a + .5) + math.lgamma(b + .5) - 2 * math.lgamma(.5) - math.lgamma(a + b + 1)
    below, pw = defaultdict(float), {}
    for size in range(depth, -1, -1):
        for (node, context), (a, b) in counts.items():
            if len(context) == size:
                x = kt(a, b)
                if size < depth:
                    x = np.logaddexp(x, below[node, context]) - math.log(2)
                pw[node, context] = x
                if size:
                    below[node, context[1:]] += x

    def one(node, context, k):
        c = context[depth - k:]
        if (node, c) not in counts:
            return 0.5
        a, b = counts[node, c]
        own = (b + .5) / (a + b + 1)
        if k == depth:
            return own
        w = math.exp(kt(a, b) - pw[node, c]) / 2
        return w * own + (1 - w) * one(node, context, k + 1)

    n, v = sum(words.values()), len(words)
    out = []
    for s, w in zip(streams, tokens):
        score = 0.0
        for p in range(depth, len(s)):
            for b in range(8):
                q = one((1 << b) | (s[p] >> (8 - b)), s[p - depth:p], 0)
                score += math.log10(q if (s[p] >> (7 - b)) & 1 else 1 - q)
        base = sum(math.log10((words[x] + .5) / (n + .5 * (v + 1))) for x in [*w, "\n"])
        out.append((len(w) + 1, sum(words[x] > 0 for x in [*w, "\n"]), n, base, score))
    return out


@pytest.mark.parametrize("depth,hot", [(5, 1 << 20), (4, 40), (6, 0)])
def test_scores_match_brute_force(spark, depth, hot):
    rows = [r for r in cases.texts() if len(r[1] or "") < 2000][:40]
    train = [zlib.crc32(str(i).encode()) % 5 != 1 if i is not None else False for i, _ in rows]
    want = defaultdict(list)
    for (i, t), flag, values in zip(rows, train, brute_scores(rows, train, depth), strict=True):
        want[i, flag].append(values)
    flag = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1
    got = defaultdict(list)
    for r in ctw.score_texts(cases.with_clashes(cases.documents(spark, rows)), flag, depth=depth, hot=hot).collect():
        got[r.id, r.trained].append((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score))
    assert got.keys() == want.keys()
    for k in want:
        assert np.allclose(sorted(got[k]), sorted(want[k]), rtol=1e-9)


def test_scores_of_nothing_and_without_training(spark):
    assert ctw.score_texts(cases.documents(spark, []), F.lit(True)).collect() == []
    got = ctw.score_texts(cases.documents(spark, [(1, "ab"), (2, None)]), F.lit(False)).collect()
    for r, n in zip(sorted(got, key=lambda r: r.id), (3, 1)):
        assert r.train_tokens == 0 and math.isclose(r.score, 8 * n * math.log10(0.5))


def test_a_byte_is_distributed():
    """Mixed predictions of all 256 bytes in a context sum to one."""
    r = np.random.default_rng(3)
    keys = np.unique(r.integers(0, 3, (4000, 6)).astype(np.uint64) @ (np.uint64(1) << np.arange(40, -8, -8, dtype=np.uint64)))
    counts = r.integers(0, 9, len(keys))
    tree = ctw.levels(keys, counts, 5, 3)
    for d in (3, 4, 5):
        assert sum(tree[d, 0]["ones"] + tree[d, 0]["zeros"]) == counts.sum()
        assert np.all(tree[d, 7]["pw"] <= 1e-9)


# --- quality

def test_quality_learns_from_positives_and_unlabelled_text(spark):
    r = random.Random(6)
    vocabulary = cases.words(300, 8, 999)
    good = [" ".join(r.choice(vocabulary) for _ in range(80)) + "." for _ in range(1500)]
    bad = [(r.choice(vocabulary) + " ") * 60 if i % 2 else " ".join(r.choice(vocabulary).upper() + "!!" for _ in range(60)) for i in range(500)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(9000, None), (9001, ""), (None, "x")]
    docs = cases.documents(spark, rows)
    positive = spark.createDataFrame([(i,) for i in range(0, 1000)], "doc_id long")
    model = quality.train(docs, positive, F.col("doc_id") % 4 != 2)
    assert abs(model.prior - 0.75) < 0.12
    got = quality.score(cases.with_clashes(docs).drop("score"), model).collect()
    assert len(got) == len(rows)
    held = [(x.doc_id, x.score) for x in got if x.doc_id is not None and x.doc_id < 2000 and x.doc_id % 4 == 2 and x.doc_id >= 1000]
    right = sum((s >= 0.7) == (i < 1500) for i, s in held)
    assert right / len(held) > 0.93
    assert all(0 <= x.score <= 1 for x in got)
    by = {x.doc_id: x.score for x in got}
    assert by[9000] == by[9001]


def test_scores_do_not_depend_on_neighbours():
    rows = [t for _, t in cases.texts()]
    together = quality.features(pa.RecordBatch.from_pydict({"t": pa.array(rows, pa.string())}), "t")
    for i, text in enumerate(rows):
        alone = quality.features(pa.RecordBatch.from_pydict({"t": pa.array([text], pa.string())}), "t")
        assert np.allclose(together[i], alone[0], atol=1e-6)


def test_quality_without_positives_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long")
    model = quality.train(cases.documents(spark), none, F.lit(True))
    assert {r.score for r in quality.score(cases.documents(spark), model).collect()} == {0.5}
    assert quality.score(cases.documents(spark, []), model).collect() == []
    clash = quality.score(cases.with_clashes(cases.documents(spark)), model)
    assert clash.columns[-1] == "score_1" and clash.first().score == "own score"


def test_prior_estimate():
    r = np.random.default_rng(0)
    for prior in (0.3, 0.6, 0.9):
        u = np.where(r.random(20_000) < prior, r.normal(2, 1, 20_000), r.normal(-2, 1, 20_000))
        bins = (np.bincount(quality.bin_of(z), minlength=quality.BINS) for z in (r.normal(2, 1, 10_000), u))
        assert abs(quality.estimate_prior(*bins) - prior) < 0.05


# --- decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(rows, items, window=13):
    grams = defaultdict(set)
    for item, text in items:
        w = WORD.findall(lower(text))
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            grams[tuple(w[i:i + k])].add("" if item is None else str(item))
    out = Counter()
    for doc_id, text in rows:
        w = WORD.findall(lower(text))
        hit, found = set(), set()
        for k in {len(g) for g in grams}:
            for i in range(len(w) - k + 1):
                if tuple(w[i:i + k]) in grams:
                    hit.update(range(i, i + k))
                    found |= grams[tuple(w[i:i + k])]
        out[doc_id, len(w), len(hit), tuple(sorted(found))] += 1
    return out


def bench_rows():
    rows = cases.texts()
    items = [(2, " ".join(cases.words(16, 2))), (10, "start"), (1, "It's 12; O'CLOCK"), (3, None), (4, " .. "), (None, "middle"),
             (5, " ".join(cases.words(60, 1)[20:40])), (5, "one"), (2, " ".join(cases.words(16, 2)))]
    return rows, items


@pytest.mark.parametrize("block", [8 << 20, 60, 1])
def test_hits_match_brute_force(spark, block):
    rows, items = bench_rows()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = cases.documents(spark, rows).withColumn("score", F.lit(1))
    found = decontaminate.find_contamination(df, bench, block_bytes=block)
    got = found.collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.items)) for r in got) == brute_hits(rows, items)
    assert all(sum(s.last - s.first + 1 for s in r.hit_spans) == r.n_hit for r in got)


def test_documents_and_spans_are_removed(spark):
    rows, items = bench_rows()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = cases.with_clashes(cases.documents(spark, rows))
    hits = brute_hits(rows, items)
    clean = Counter()
    for (i, n, h, _), c in hits.items():
        if not (h > 0 and 20 * h >= n):
            clean[i] += c
    out = decontaminate.drop_documents(df, bench)
    assert out.columns == df.columns
    assert Counter(r.doc_id for r in out.collect()) == clean
    cut = decontaminate.drop_spans(df, bench)
    assert cut.columns == df.columns
    got = {r.doc_id: r.text for r in cut.collect() if r.doc_id in (1, 4, 7, 14, 20)}
    assert got[1] is None and got[4] == "" and "o'clock" not in got[14] and "ok" in got[14]
    assert got[20] == dict(rows)[20]
    assert [w for w in got[7].split()] == cases.words(60, 1)[:20] + cases.words(60, 1)[40:]


def test_clashing_result_names(spark):
    rows, items = bench_rows()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = cases.documents(spark, rows).withColumns({"items": F.lit("own"), "N_hit": F.lit(7)})
    out = decontaminate.find_contamination(df, bench)
    assert out.columns == ["doc_id", "text", "items", "N_hit", "n_words", "n_hit_1", "hit_spans", "items_1"]
    got = out.collect()
    assert {(r["items"], r["N_hit"]) for r in got} == {("own", 7)}
    assert Counter((r.doc_id, r.n_words, r.n_hit_1, tuple(r.items_1)) for r in got) == brute_hits(rows, items)
    assert decontaminate.drop_documents(df, bench).columns == df.columns


def test_no_benchmark_and_no_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate.find_contamination(cases.documents(spark), none).collect()} == {0}
    assert decontaminate.find_contamination(cases.documents(spark, []), none).collect() == []


# --- preferences

def brute_pair(chosen, rejected):
    def order(turns):
        return [(r or "", t or "") for _, r, t in sorted(turns, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "", x[2] or ""))]

    def render(turns):
        text, mask = "", []
        for role, body in turns:
            body = body.replace("<|", "< |")
            head = f"<|{role}|>\n"
            if role == "assistant":
                mask.append((len(text) + len(head), len(body) + 7))
            text += f"{head}{body}<|end|>\n"
        return text, mask

    c, r = order(chosen), order(rejected)
    k = 0
    while k < min(len(c), len(r)) and c[k] == r[k]:
        k += 1
    return (render(c[:k])[0], *render(c[k:]), *render(r[k:]), k, len(c) - k, len(r) - k)


def test_pairs_match_brute_force(spark):
    sides = {
        1: ([(0, "user", "hi"), (1, "assistant", "yes")], [(0, "user", "hi"), (1, "assistant", "no")]),
        2: ([(0, "system", "s"), (1, "user", "q"), (2, "assistant", "a"), (3, "user", "more"), (4, "assistant", "b")],
            [(0, "system", "s"), (5, "user", "q"), (6, "assistant", "<|user|>\nfake")]),
        3: ([(0, "user", "same")], [(0, "user", "same")]),
        4: ([], [(0, "user", None), (1, None, "x")]),
        5: ([(0, "user", "é漢\U0001f600"), (0, "user", "b"), (None, "assistant", "")], []),
        6: ([(0, "assistant", "x")] * 3, [(0, "assistant", "x")] * 2 + [(9, "assistant", "y")]),
    }
    rows = [(p, side == 0, *t) for p, both in sides.items() for side in (0, 1) for t in both[side]]
    rows += [(None, True, 0, "user", "lost"), (1, None, 0, "user", "lost")]
    df = spark.createDataFrame(rows, "pair_id long, is_chosen boolean, turn long, role string, text string").withColumn("k", F.lit(9))
    got = {r.pair_id: (r.prompt, r.chosen, [tuple(s) for s in r.chosen_mask], r.rejected, [tuple(s) for s in r.rejected_mask],
                       r.prompt_turns, r.chosen_turns, r.rejected_turns) for r in preferences.format_pairs(df).collect()}
    assert got == {p: brute_pair(*both) for p, both in sides.items()}
    assert preferences.format_pairs(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        preferences.format_pairs(df, trained_role="a'b")


def test_swapped_answers(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a0"), (1, 0, "user", "r"), (1, 1, "assistant", "a1"), (1, 2, "user", "t"),
            (2, 0, "user", "alone"), (2, 1, "assistant", None), (None, 0, "user", "lost"), (4, 0, "user", "no answer")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.pair_id, r.is_chosen): set() for r in preferences.swapped_answers(df).collect()}
    for r in preferences.swapped_answers(df).collect():
        got[r.pair_id, r.is_chosen].add((r.turn, r.role, r.text))
    assert got[0, False] == {(0, "user", "q"), (1, "assistant", "a1")}
    assert got[1, False] == {(0, "user", "r"), (1, "assistant", "a0"), (2, "user", "t")}
    assert got[1, True] == {(0, "user", "r"), (1, "assistant", "a1"), (2, "user", "t")}
    assert got[2, False] == {(0, "user", "alone")} and got[4, True] == got[4, False]
    assert {p for p, _ in got} == {0, 1, 2, 4}


def test_bytes_without_a_token_are_left_out(spark, tmp_path):
    """A vocabulary that lacks most bytes: they go before merges, as in the library."""
    import json
    path = str(tmp_path / "small.json")
    model = {"type": "BPE", "vocab": {"a": 0, "b": 1, "ab": 2, "aab": 3}, "merges": [["a", "b"], ["a", "ab"]]}
    with open(path, "w") as f:
        json.dump({"version": "1.0", "added_tokens": [], "normalizer": None, "model": model, "post_processor": None, "truncation": None,
                   "padding": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
                   "decoder": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}, f)
    own = tokenizers.Tokenizer.from_file(path)
    texts = ["ac", "acb", "c", "", "aacb", "xaab b", "é", "ababab"]
    df = cases.documents(spark, list(enumerate(texts)))
    got = {r.doc_id: list(r.ids) for r in bpe.encode(df, path).collect()}
    assert got == {i: own.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    counted = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, path).collect()}
    assert counted == {i: len(v) for i, v in got.items()}


def test_quality_statistics_cover_all_rows(spark):
    """Means and scales are those of all usable rows, whatever the samples."""
    docs = cases.documents(spark, [(i, t) for i, (_, t) in enumerate(cases.texts())])
    n, mean, scale = quality.moments(docs, "text")
    part = pa.RecordBatch.from_pydict({"text": pa.array([t for _, t in cases.texts()], pa.string())})
    x = quality.features(part, "text").astype(np.float64)
    assert n == len(x) and np.allclose(mean, x.mean(axis=0), atol=1e-5) and np.allclose(scale, x.std(axis=0) + 1e-3, atol=1e-4)
    w = np.linspace(-1, 1, len(mean))
    spread = quality.histogram(docs, "text", mean, scale, w, 0.5)
    assert spread.sum() == n and (spread > 0).sum() > 3
    few = quality.train(docs, docs.select("doc_id").where("doc_id < 8"), F.lit(True), positives=5, unlabelled=6)
    assert np.allclose(few.mean, mean)


def test_code_length_per_byte(spark):
    rows = [(i, " ".join(cases.words(50, i))) for i in range(30)] + [(99, None), (98, "")]
    for r in ctw.score_texts(cases.documents(spark, rows), F.col("doc_id") % 2 == 0).collect():
        text = " ".join((dict(rows)[r.id] or "").lower().split())
        size = len(text.encode()) + 1  # the end is a byte too
        assert math.isclose(r.bits_per_byte, -r.score * math.log2(10) / (size if text else 1), rel_tol=1e-9) and r.bits_per_byte > 0
