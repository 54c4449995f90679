"""Importance resampling, secret scans and collocations against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterkit.llm import collocations, credentials, importance
from meterkit.llm import queries as Q

from . import cases

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return (text or "").encode().lower().decode()


# -- importance resampling -------------------------------------------------------


def brute_resample(rows, target, shortest, longest, buckets, least_words, per_cent):
    def feats(text):
        w = WORD.findall(lower(text))
        return len(w), [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(shortest, longest + 1) for i in range(len(w) - n + 1)]

    own = [(i, *feats(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in feats(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    out = []
    for i, n, f in own:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((x for x in out if x[1] >= least_words), key=lambda x: (-x[4], cases.key(x[0])))
    ranks = {id(x): r for r, x in enumerate(able[:per_cent * len(able) // 100], 1)}
    return Counter((x[0], x[2], x[3], x[4], ranks.get(id(x))) for x in out)


@pytest.mark.parametrize("shortest,longest,least,per_cent", [(1, 1, 20, 10), (1, 2, 2, 55), (2, 3, 0, 100)])
def test_resampling_matches_brute_force(spark, shortest, longest, least, per_cent):
    rows = cases.texts()
    target = [" ".join(cases.words(40, 1)), None, "", "One two"]
    docs = cases.with_clashes(cases.documents(spark, rows)).withColumn("a.b", F.lit(1)).withColumn("c0", F.lit(2))
    aim = spark.createDataFrame([(x,) for x in target], "text string")
    out = importance.resample(docs, aim, shortest=shortest, longest=longest, buckets=97, least_words=least, per_cent=per_cent)
    assert out.columns == [*(c for c in docs.columns if c != "text"), "n_features", "weight", "score_1", "rank"]
    got = Counter((r.doc_id, r.n_features, r.weight, r.score_1, r["rank"]) for r in out.collect())
    assert got == brute_resample(rows, target, shortest, longest, 97, least, per_cent)


def test_offsets_of_cut_texts(monkeypatch):
    features = importance.Features(1, 1, 10)
    text = lower(" ".join(cases.words(200, 5)) + "  x" * 20 + "é" * 90)
    whole = features.offsets(text)
    monkeypatch.setattr(importance, "CHUNK", 7)
    assert features.offsets(text) == whole
    assert [text[a:b] for a, b in whole[1]] == whole[0] == WORD.findall(text)


def test_drawn_documents_and_empty_tables(spark):
    docs, aim = cases.documents(spark), cases.documents(spark, [(1, "one two")])
    drawn = importance.drawn_documents(docs, aim)
    assert drawn.columns == docs.columns
    assert drawn.count() == importance.resample(docs, aim).where("rank is not null").count() > 0
    nothing = cases.documents(spark, [])
    assert importance.resample(nothing, aim).collect() == []
    assert importance.resample(docs, nothing).count() == len(cases.texts())


# -- secrets ---------------------------------------------------------------------


def planted(seed=3):
    """Texts with labelled and bare tokens of one format among ordinary words."""
    r = random.Random(seed)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def token():
        return "ghx_" + "".join(r.choice(alphabet) for _ in range(32))

    rows = [(i, f"some words then token = \"{token()}\" and more") for i in range(400)]
    rows += [(1000 + i, f"Kéy é {token()}. internationalisation-of-everything/else") for i in range(30)]
    rows += [(2000 + i, "AKIA" + "".join(r.choice("ABCDEFGHIJ234567") for _ in range(16)) + " PASSWORD: short token=" + "z" * 12) for i in range(40)]
    return rows


def brute_base(text):
    text = text or ""
    spans = [("assign", m.start(), m.end()) for m in credentials.ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
    return sorted(spans, key=lambda s: (s[1], credentials.KINDS.index(s[0])))


def test_base_spans_and_learnt_format(spark):
    odd = [(3000, "secret=token-:abcdefghijklmnop"), (3001, "api-key 'x' apikey\":  \"0123456789abcdef0123 tokeN=ſecret secret"),
           (3002, "AKIAAKIA AKIA" + "Q" * 40 + "é" + "a" * 15 + " " + "b" * 16), (3003, "pasſword=abcdefghijklmnopq toKen=abcdefghijklmnopq")]
    rows = [*planted(), *cases.texts(), *odd]
    docs = cases.with_clashes(cases.documents(spark, rows)).withColumn("base", F.lit(1)).withColumn("a.b", F.lit(1))
    out = credentials.find_secrets(docs)
    assert out.columns == [*(c for c in docs.columns if c != "text"), "base_1", "found"]
    got = out.collect()
    want = Counter((i, tuple(brute_base(t))) for i, t in rows)
    assert Counter((r.doc_id, tuple(tuple(s) for s in r.base_1)) for r in got) == want
    text = dict(rows)
    added = [text[r.doc_id][s.start:s.end] for r in got for s in r.found]
    bare = [t.split()[2].rstrip(".") for i, t in planted() if 1000 <= i < 2000]
    assert len(set(added) & set(bare)) >= 0.9 * len(bare)
    assert all(a.startswith("ghx_") for a in added)


def test_secret_query_columns(spark, tmp_path):
    rows = [*planted(), *cases.texts()]
    cases.documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    for r in Q.op12_secrets(spark, str(tmp_path)).collect():
        spans = [s.split(":") for s in r.spans.split(",") if s]
        base = [s for s in spans if not s[0].startswith("like_")]
        assert r.base_sha256 == hashlib.sha256(",".join(":".join(s) for s in base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in base) for k in credentials.KINDS)
        assert [int(s[1]) for s in spans] == sorted(int(s[1]) for s in spans)


def test_nothing_to_learn_from(spark):
    assert credentials.find_secrets(cases.documents(spark, [])).collect() == []
    few = credentials.find_secrets(cases.documents(spark, [(1, "token=abcdefghijklmnop"), (2, "x" * 40)])).collect()
    assert [len(r.found) for r in few] == [0, 0]


def test_automaton_is_a_distribution():
    r = random.Random(1)
    values = ["k" + "".join(r.choice("01") for _ in range(r.randrange(1, 6))) for _ in range(3000)]
    states = credentials.infer(values)
    assert 2 <= len(states) < 20
    assert all(s.visits == s.ends + sum(s.by.values()) and set(s.by) == set(s.next) for s in states)
    assert states[0].visits == len(values)
    form = credentials.Format.of(states)
    assert form.bits("k0110") > form.bits("0110") and form.bits("k0110") > form.bits("k0120")


# -- collocations ----------------------------------------------------------------


def brute_mine(rows, top, least):
    count, total = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            count.update((lang, *w[i:i + n]) for n in range(1, 5) for i in range(len(w) - n + 1))
    found = {g: a for g, a in count.items() if len(g) > 2 and a >= least}
    around = {}
    for g, a in found.items():
        for n in range(2, len(g) - 1):
            for i in range(1, len(g) - n + 1):
                key = (g[0], *g[i:i + n])
                around[key] = max(a, around.get(key, 0))
    by_lang = {}
    for g, a in found.items():
        score, k = min((2_000_000 * a // (count[(g[0], *g[1:1 + k])] + count[(g[0], *g[1 + k:])]), k) for k in range(1, len(g) - 1))
        if 100 * around.get(g, 0) < 80 * a or g not in around:
            by_lang.setdefault(g[0], []).append((-score, -a, " ".join(g[1:]).encode(), count[(g[0], *g[1:1 + k])], count[(g[0], *g[1 + k:])]))
    return {(lang, rank, p.decode(), -a, l, r, total[lang], -s)
            for lang, own in by_lang.items() for rank, (s, a, p, l, r) in enumerate(sorted(own)[:top], 1)}


def prose(seed, n, vocabulary):
    r = random.Random(seed)
    fixed = [" ".join(cases.words(4, k, 9)) for k in range(12)]
    out = []
    for i in range(n):
        parts = [r.choice(fixed) if r.random() < 0.4 else "".join(r.choice("ab") for _ in range(1 + int(r.paretovariate(1) * 2) % vocabulary)) for _ in range(60)]
        out.append((r.choice(["en", "de", None, "und"]), "".join(p + r.choice([" ", " ", "  ", "\t", ", ", ".\n"]) for p in parts)))
    return out


@pytest.mark.parametrize("top,least,reach", [(3, 4, 1), (40, 3, 1), (2000, 3, 3)])
def test_collocations_match_brute_force(spark, top, least, reach):
    """A small report over many candidates: rounds have to widen the frontier."""
    rows = [*prose(1, 60, 7), ("en", None), (None, ""), ("en", "One  one one, one one " * 30), ("xx", "é\x00 b " * 50)]
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("phrase", F.lit(1)).withColumn("f", F.lit(1)).repartition(3)
    got = {tuple(r) for r in collocations.mine(docs, top=top, least=least, reach=reach)
           .select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}
    assert got == brute_mine(rows, top, least)


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.mine(empty).collect() == []
    assert collocations.mine(spark.createDataFrame([("en", "a b c")], "lang string, text string")).collect() == []


def test_bit_set_holds_its_members(spark):
    rows = [("en", f"a{i} b{i % 7}") for i in range(3000)]
    known = collocations.bit_set(spark.createDataFrame(rows, "lang string, phrase string"), 2).value
    reader = collocations.Reader(__import__("pyarrow").RecordBatch.from_pydict({"lang": ["en", "de"], "text": [" ".join(p for _, p in rows)] * 2}))
    fake = type("B", (), {"value": known})
    inside = reader.inside(2, fake)
    half = len(reader.number) // 2
    assert inside[:half:2].all() and np.mean(inside[half:]) < 0.2
