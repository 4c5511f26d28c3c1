"""The pipeline against a plain version of its five stages."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from kvspark.llm import hashed_text as ht, mixing, quality_classifier, quality_rules, sentencepiece_codec as sp
from kvspark.llm.queries import MIX_SEED, ORACLE_SQL, OTHER, QUERIES, TARGETS

from .test_operators import plain_components, plain_counts, plain_fingerprint, plain_uniform, quantile

SF = "/root/testdata/sf0.001"
M64 = (1 << 64) - 1


def mix64(h):
    h &= M64
    for _ in range(2):
        h ^= h >> 32
        h = h * 0xD6E8FEB86659FD93 & M64
    return h ^ (h >> 32)


def plain_encoding(text, doc_id, p, seed, copy=1):
    """Merge-dropout by looking over the whole text for the next merge, again and again; a piece at a time."""
    v = sp.vocabulary(sp.MODEL_PATH)
    if not text:
        return []
    chars = ["▁", *("▁" if c == " " else "literal" if c == "▁" else c for c in text)]
    bar = min(int(p * 2.0**64), M64)
    key = mix64(doc_id + 1)
    if copy > 1:
        key = mix64(key ^ (copy - 1) * sp._B & M64)
    salt = mix64(key ^ mix64(seed))
    out = []
    starts = [i for i, c in enumerate(chars) if i == 0 or c == "▁" and chars[i - 1] != "▁"] + [len(chars)]
    for a, b in zip(starts, starts[1:]):
        syms = [(int(v.char[ord(c)]) if len(c) == 1 else -1, i, i + 1) for i, c in enumerate(chars[a:b], a)]
        while True:
            found = []
            for k in range(len(syms) - 1):
                (x, s, m), (y, _, e) = syms[k], syms[k + 1]
                code = v.pairs.get((x, y))
                if code is None or mix64(salt + s * sp._A + m * sp._B + e * sp._C) < bar:
                    continue
                found.append((code >> sp._RANK_AT, k, code & sp._ID))
            if not found:
                break
            _, k, new = min(found)
            syms[k : k + 2] = [(new, syms[k][1], syms[k + 1][2])]
        for x, s, _ in syms:
            c = "▁" if len(chars[s]) > 1 else chars[s]
            out += [x] if x >= 0 else [v.byte0 + byte for byte in c.encode()]
    return out


def score_of(text, weights):
    ((cols, vals),) = list(ht.sparse_rows(pa.array([text], pa.string())))
    return float((weights[np.frombuffer(cols, np.int32)].astype(float) * np.frombuffer(vals, np.float32)).sum())


def plain_copies(rows):
    n = Counter(r.source if r.source in TARGETS else None for r in rows)
    w = {g: TARGETS.get(g, OTHER) for g in n}
    out = []
    for r in rows:
        g = r.source if r.source in TARGETS else None
        rate = w[g] / sum(w.values()) * len(rows) / n[g]
        parts = max(1, math.ceil(rate / mixing.MOST_MEAN))
        out.append(sum(quantile(plain_uniform(MIX_SEED, r.doc_id, k + 1), rate / parts) for k in range(parts)))
    return out


@pytest.fixture(scope="module")
def stages(spark):
    """(documents that each stage gave) of a run stage by stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = []
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
        given.append(docs)
    return given


def test_every_stage(spark, stages):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = docs.collect()
    rules, grades = quality_rules.fit(docs, labels), quality_classifier.fit(docs, labels)

    def passes(r):
        n = plain_counts(r.text)
        if n[0] < 10 or 100 * n[4] > 20 * n[0]:
            return False
        return rules.weights is None or float(rules.probability(np.array([score_of(r.text, rules.weights)]))[0]) >= quality_rules.KEEP_FROM

    rows = [r for r in rows if passes(r)]
    assert sorted(stages[0].collect()) == sorted(rows) and stages[0].columns == docs.columns
    if grades.weights is not None:
        rows = [r for r in rows if float(ht.sigmoid(np.array([score_of(r.text, grades.weights) - grades.thresholds[0]]))[0]) >= 0.5]
    assert sorted(stages[1].collect()) == sorted(rows) and stages[1].columns == docs.columns
    components = plain_components([plain_fingerprint(r.text) for r in rows], [r.doc_id for r in rows])
    rows = [r for r in rows if components[r.doc_id] == r.doc_id]
    assert sorted(stages[2].collect()) == sorted(rows) and stages[2].columns == docs.columns
    rows = [r for r, n in zip(rows, plain_copies(rows)) for _ in range(n)]
    assert sorted(stages[3].collect()) == sorted(rows) and stages[3].columns == docs.columns
    text, n, got = {r.doc_id: r.text for r in rows}, Counter(r.doc_id for r in rows), {}
    for r in stages[4].collect():
        assert r.lossless
        got.setdefault(r.doc_id, []).append(r.ids)
    assert {k: len(x) for k, x in got.items()} == n
    short = sorted((k for k in n if len(text[k]) < 1500), key=lambda k: -n[k])
    assert len(short) > 10 and n[short[0]] > 1
    for k in short[:30]:
        assert sorted(got[k]) == sorted(plain_encoding(text[k], k, sp.DROPOUT, sp.SEED, c + 1) for c in range(n[k]))


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(corpus_pipeline.run(spark, SF).collect(), key=repr) == sorted(stages[4].collect(), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = con.execute(ORACLE_SQL[name])
    cols = [d[0] for d in got.description]
    df = QUERIES[name](spark, SF)
    assert sorted(cols) == sorted(df.columns)
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(map(repr, got.fetchall()))


def test_registered():
    import __spark_entry__ as e

    names = list(e.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
