"""The pipeline's stages in turn: columns stay, decisions take effect, each stage works on what the one before kept."""

import os
import random
import re
from collections import Counter

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_stages(spark):
    import corpus_pipeline
    from fieldglass.llm import quality
    from fieldglass.llm.common import stored

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"] for r in quality.quality(docs).where("kept").collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SF), "stage")
        if name != "tokenize":
            assert sorted(out.columns) == ["doc_id", "lang", "n_chars", "source", "text"]
        rows = out.collect()
        if name == "quality":
            assert {r["doc_id"] for r in rows} == kept
        elif name == "exact_dedup":
            texts = Counter(r["text"] for r in docs.collect())
            assert set(Counter(r["text"] for r in rows).values()) == {1} and {r["text"] for r in rows} == set(texts)
        elif name == "near_dedup":
            sets = {r["doc_id"]: set(zip(*[r["text"].lower().split()[i:] for i in range(5)])) for r in rows}
            ids = sorted(sets)
            assert not any(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for k, a in enumerate(ids) for b in ids[:k])
        seen.append({r["doc_id"] for r in rows})
        docs = out
    assert all(later <= earlier for earlier, later in zip(seen, seen[1:], strict=False)) and seen[-1] == seen[-2]


def roots(sets):
    """Smallest id reachable over links of 0.8, by brute force."""
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in sets}


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_later_stages_against_brute_force(spark):
    """Near copies, mixing and encoding of documents with nulls, empty and long texts, repeats and columns of odd names."""
    import public_tokenizers
    import sentencepiece

    import corpus_pipeline

    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 400)) for _ in range(n))
    base = [prose(rng.randint(60, 200)) for _ in range(50)]
    near = [" ".join("new" if k == 40 else w for k, w in enumerate(t.split())) for t in base[:12]]
    texts = [*base, *near, "", None, " ", "one", "two words", prose(4000)]
    rows = [(i, t, None if i % 9 == 0 else "en", None if i % 10 == 0 else f"s{i % 3}", i, i, 0.5) for i, t in enumerate(texts)] + [(None, "no id", "en", "s1", 1, 1, 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, gone_id long, p double")
    stages = dict(corpus_pipeline.STAGES)
    left = stages["near_dedup"](spark, docs, SF)
    assert left.columns == docs.columns
    sets = {}
    for i, t in enumerate(texts):
        w = words(lower(t))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    due = {i for i, r in roots(sets).items() if i == r}
    assert Counter(r["doc_id"] for r in left.collect()) == Counter({**{i: 1 for i in due}, None: 1}) and len(due) < len(texts) - 8
    mixed = stages["mix"](spark, docs, SF)
    assert mixed.columns == docs.columns
    taken = Counter(r["doc_id"] for r in mixed.collect())
    source = {r[0]: r[3] for r in rows}
    size = {r[0]: len(words(r[1])) for r in rows}
    total = {s: sum(size[i] for i in size if source[i] == s) for s in set(source.values())}
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = dict(zip(names, (5, 2, 1, 5), strict=True))
    open_, target = set(names), {}
    while True:
        rest = sum(total.values()) - sum(3 * total[s] for s in names if s not in open_)
        target = {s: rest * weight[s] / sum(weight[x] for x in open_) if s in open_ else 3 * total[s] for s in names}
        if not (over := {s for s in open_ if target[s] > 3 * total[s]}):
            break
        open_ -= over
    assert max(taken.values()) <= 3
    for s in names:
        small = sorted(size[i] for i in size if source[i] == s and size[i])
        # the last fraction is one of a document, and one from the smaller half
        assert abs(sum(size[i] * n for i, n in taken.items() if source[i] == s) - target[s]) <= small[len(small) // 2]
    encoded = stages["tokenize"](spark, mixed, SF)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = {r[0]: r[1] or "" for r in rows}
    got = encoded.collect()
    assert Counter(r["doc_id"] for r in got) == taken and all(list(r["ids"]) == sp.encode(text[r["doc_id"]]) and r["round_trip"] and r["parity"] for r in got)


def test_stages_without_rows(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0 and (name == "tokenize" or out.columns == docs.columns)
