import random

import numpy as np
import pytest

from foliograph.llm import mixing, packing
from foliograph.llm.tokens import encode, encoder, with_tokens

DOCS = "doc_id bigint, text string, source string, container int"


def docs(spark, n=120):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("cell lens rod iris map light".split()) for _ in range(int(rng.lognormvariate(5, 1)))), rng.choice("aaab"), 0) for i in range(n)]
    rows += [(n, None, "a", 0), (n + 1, "", "a", 0), (n + 2, "lens " * 5000, "b", 0), (n + 3, "x", None, 0), (n + 4, "x", "c", 0)]
    return spark.createDataFrame(rows, DOCS), rows


def test_packing_holds_every_token_once(spark):
    df, rows = docs(spark)
    got = packing.pack(df).collect()
    size = {i: len(encode(t)) for i, t, _, _ in rows if t}
    by_doc, by_bin = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append((r["start_token"], r["n_tokens"]))
        by_bin.setdefault(r["container"], []).append((r["position"], r["n_tokens"], r["capacity"]))
    assert set(by_doc) == {i for i, n in size.items() if n}
    for i, parts in by_doc.items():
        at = 0
        for s, n in sorted(parts):
            assert s == at
            at += n
        assert at == size[i] and (len(parts) == 1 or size[i] > 2048)
    for parts in by_bin.values():
        at = 0
        for p, n, cap in sorted(parts):
            assert p == at
            at += n
        assert at <= cap <= 2048 and cap in packing.PERMITTED
    full = -(-sum(size.values()) // 2048)
    assert len(by_bin) <= full + 1
    text = next(t for i, t, _, _ in rows if i == 122)
    ids = encode(text)
    assert encoder("/opt/tokenizers/byte_bpe_50k.tiktoken").decode([x for s, n in sorted(by_doc[122]) for x in ids[s : s + n]]) == text


def test_plan_is_close_to_the_bound():
    rng = random.Random(1)
    counts = {}
    for _ in range(20_000):
        s = min(2048, max(1, int(rng.lognormvariate(5.5, 1))))
        counts[s] = counts.get(s, 0) + 1
    plan = packing.plan(counts)
    for s, n in counts.items():
        spans = sorted((p.lo, p.hi) for p in plan if p.size == s)
        assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    total = sum(s * n for s, n in counts.items())
    assert max(p.bin_lo + p.hi - p.lo for p in plan) <= 1.005 * total / 2048 + 1
    assert packing.plan({}) == []
    with pytest.raises(ValueError):
        packing.plan({4096: 1})


def test_quotas():
    assert mixing.quotas(100, {"a": 0.5, "b": 0.5}, {"a": 10, "b": 500}) == {"a": 10, "b": 90}
    assert mixing.quotas(100, {"a": 0.5, "b": 0.5}, {"a": 10, "b": 20}) == {"a": 10, "b": 20}
    assert mixing.quotas(10, {}, {}) == {}


def test_draws_meet_quotas():
    d = mixing.draw({"a": 1000, "b": 37}, 16, 4)
    assert d.sum(0).tolist() == [1000, 37] and d.shape == (16, 2) and max(d.sum(1)) - min(d.sum(1)) <= 1


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_permutation(n):
    assert sorted(mixing.permute(np.arange(n), n, 99)) == list(range(n))


def test_mix(spark):
    df, rows = docs(spark)
    targets = spark.createDataFrame([("a", 0.3, 2), ("b", 0.7, 1), ("zzz", 0.0, 3)], "source string, target_share double, max_repeats int")
    got = mixing.mix(df, targets, block=64, shards=8).collect()
    used = {}
    for r in got:
        used.setdefault((r["source"], r["block"]), set()).add(r["repeat"])
        assert r["n_tokens"] > 0
    assert max(len(v) for (s, _), v in used.items() if s == "a") <= 2 and all(len(v) == 1 for (s, _), v in used.items() if s == "b")
    total = sum(r["_n"] for r in with_tokens(df, "doc_id", "text").collect())
    assert sum(r["n_tokens"] for r in got) == total
    assert len({(r["slot"], r["doc_id"], r["start_token"]) for r in got}) == len(got)
    whole = mixing.mix(df, spark.createDataFrame([("a", 1.0, 2)], targets.schema), block=64)  # every pass over a source holds all its tokens
    a = sum(r["_n"] for r in with_tokens(df.where("source = 'a'"), "doc_id", "text").collect())
    assert sum(r["n_tokens"] for r in whole.collect()) == min(total, 2 * a)
    assert {r["source"] for r in mixing.shares(mixing.mix(df, targets, block=64, shards=8), targets).collect()} == {"a", "b", "zzz"}
    assert mixing.mix(df.limit(0), targets).count() == 0 and mixing.mix(df, targets.limit(0)).count() == 0
