"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldglass.llm import binary_output, chat, exact_dedup, html_extract, licences, minhash, mixing, quality, sentencepiece_codec, suffix_dedup

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gone_id long, label string"
WORDS = ["the", "of", "and", "River", "mountain", "Éclair", "walks", "slowly", "green", "house", "9", "x,", "end."]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 300)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    near = []
    for t in base[:12]:
        w = t.split()
        for _ in range(3):
            v = list(w)
            for _ in range(max(0, len(v) // 25)):
                v[rng.randrange(len(v))] = "changed" + str(rng.randint(0, 9))
            near.append(" ".join(v))
    out = base + near + base[:10] + [base[3].upper(), None, "", None, "", " ", "one", "One", "two words", "line\n\nline\nline\n x", "a  b\n c\t d", prose(rng, 6000), base[5] + "\n" + base[7], "▁ ß 日本語"]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None if i % 11 == 0 else "en" if i % 2 else "fr", None if i % 13 == 0 else f"s{i % 3}", None, i, "x") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_exact_dedup(spark, docs, texts, none):
    groups = {}
    for i, t in texts:
        groups.setdefault(lower(t), []).append(i)
    got = by_id(exact_dedup.exact_dedup(docs, capacity=4))
    assert len(got) == len(texts)
    for i, t in texts:
        g, r = groups[lower(t)], got[i]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(g), len(g), i == max(g), hashlib.sha256(lower(t).encode()).hexdigest())
    assert exact_dedup.exact_dedup(none).count() == 0
    assert sorted(r["doc_id"] for r in exact_dedup.drop_copies(docs).collect()) == sorted(max(g) for g in groups.values())
    again = spark.createDataFrame([(1, "a", None, None, None, 1, "x")] * 3 + [(None, "a", None, None, None, 1, "x"), (None, "b", None, None, None, 1, "x")], SCHEMA)
    assert sorted((r["doc_id"] is None, r["text"]) for r in exact_dedup.drop_copies(again).collect()) == [(False, "a"), (True, "b")]


def test_directory_covers_each_cell_once(spark):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    table, depth = exact_dedup.directory(keys, 20_000, capacity=500)
    rows = table.collect()
    assert len({r["cell"] for r in rows}) == len(rows) == 1 << depth
    sizes = Counter()
    bucket = {r["cell"]: r["bucket"] for r in rows}
    for r in keys.select(F.shiftrightunsigned("h", 64 - depth).alias("c")).collect():
        sizes[bucket[r["c"]]] += 1
    assert max(sizes.values()) <= 500


def test_mixing(spark, docs, texts, none):
    got = by_id(mixing.mix(docs))
    sources = sorted({r["source"] for r in docs.collect()}, key=lambda s: (s is None, s or ""))
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    size = {i: len(words(t)) for i, t in texts}
    total = {s: sum(size[i] for i in size if source[i] == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    target, open_ = {}, set(sources)
    while True:
        left = sum(total.values()) - sum(3 * total[s] for s in sources if s not in open_)
        target = {s: left * weight[s] / sum(weight[x] for x in open_) if s in open_ else 3 * total[s] for s in sources}
        over = {s for s in open_ if target[s] > 3 * total[s]}
        if not over:
            break
        open_ -= over
    for i, r in got.items():
        assert r["size"] == size[i] and r["source_size"] == total[source[i]] and r["target"] == pytest.approx(target[source[i]])
        assert r["taken"] % max(1, size[i]) == 0 and r["taken"] <= 3 * size[i]
    for s in sources:
        assert abs(sum(r["taken"] for i, r in got.items() if source[i] == s) - target[s]) <= 6000
    assert {i: r["taken"] for i, r in by_id(mixing.mix(docs.repartition(2))).items()} == {i: r["taken"] for i, r in got.items()}
    assert mixing.mix(none).count() == 0
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and Counter(r["doc_id"] for r in out.collect()) == Counter({i: r["copies"] for i, r in got.items() if r["copies"]})


def test_quality(docs, texts, none):
    got = by_id(quality.quality(docs))
    for i, t in texts:
        w = words(t)
        seen = Counter(zip(w, w[1:], w[2:]))
        covered = {j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(k, k + 3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    assert quality.quality(none).count() == 0
    assert {r["doc_id"] for r in quality.keep_good(docs).collect()} == {i for i, r in got.items() if r["kept"]}


def test_quality_writes_one_table_a_step(spark, docs, monkeypatch):
    names = []
    monkeypatch.setattr(quality, "stored", lambda df, what, stored=quality.stored: names.append(what) or stored(df, what))
    quality.quality(docs).count()
    steps = names[names.index("estimates-0") : names.index("estimates-raw")]
    assert len(steps) > 2 and steps == [f"estimates-{i}" for i in range(len(steps))]


def test_quality_rejects_outliers_and_keeps_clean(spark):
    rng = random.Random(3)
    clean = [(i, prose(rng, rng.randint(60, 400)), "en", "s", None, 0, "x") for i in range(300)]
    junk = [(1000 + i, " ".join(w + "$$%" for w in prose(rng, 200).split()), "en", "s", None, 0, "x") for i in range(15)]
    got = by_id(quality.quality(spark.createDataFrame(clean + junk, SCHEMA)))
    assert all(r["kept"] == (i < 1000) for i, r in got.items())


@pytest.mark.parametrize("share", [30, 45])
def test_quality_rejects_junk_up_to_half(spark, share):
    rng = random.Random(share)
    clean = [(i, prose(rng, rng.randint(60, 400)), "en", "s", None, 0, "x") for i in range(300)]
    junk = [(1000 + i, " ".join(w + rng.choice(["$$%", "###", "***"]) for w in prose(rng, rng.randint(60, 400)).split()), "en", "s", None, 0, "x") for i in range(300 * share // (100 - share))]
    got = by_id(quality.quality(spark.createDataFrame(clean + junk, SCHEMA)))
    assert all(r["kept"] == (i < 1000) for i, r in got.items() if not r["base_failed"])


def test_quality_rejects_lines_or_repeats_alone(spark):
    rng = random.Random(9)
    clean = [(i, prose(rng, rng.randint(60, 400)), "en", "s", None, 0, "x") for i in range(300)]
    lines = "\n".join(["Read more"] * 90 + [prose(rng, 200) for _ in range(10)])
    phrase = prose(rng, 98)
    repeats = f"{phrase} {prose(rng, 204)} {phrase}"  # 49 % of the words in repeated windows, no duplicate line
    got = by_id(quality.quality(spark.createDataFrame([*clean, (1000, lines, "en", "s", None, 0, "x"), (1001, repeats, "en", "s", None, 0, "x")], SCHEMA)))
    assert not got[1000]["base_failed"] and got[1000]["n_dup_lines"] == 89 and not got[1001]["base_failed"] and got[1001]["n_repeat_words"] == 196
    assert all(r["kept"] == (i < 1000) for i, r in got.items())


def test_windows_that_share_a_hash(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice("abc") for _ in range(rng.randint(3, 40))]) for i in range(40)]
    table = spark.createDataFrame(rows, "i int, words array<string>").withColumn("h", F.expr("transform(sequence(1, size(words) - 2), k -> 7L)"))
    for r in table.select("i", "words", quality.repeat_words().alias("n")).collect():
        w = r["words"]
        seen = Counter(zip(w, w[1:], w[2:]))
        assert r["n"] == len({j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(k, k + 3)})


def test_long_text_repeats(spark):
    text = " ".join(str(i % 70_000) for i in range(140_000))  # over the packed limit, half of it repeats
    row = quality.quality(spark.createDataFrame([(1, text, None, None, None, 0, "x")], SCHEMA)).head()
    assert (row["n_words"], row["n_repeat_words"]) == (140_000, 140_000)


@pytest.mark.parametrize("k", [2, 5])
def test_near_dedup(docs, texts, none, k):
    sets = {}
    for i, t in texts:
        w = words(lower(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
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
    got = by_id(minhash.near_dedup(docs, k=k))
    for i in sets:
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), root(i), root(i) == i)
    assert minhash.near_dedup(none, k=k).count() == 0
    assert {r["doc_id"] for r in minhash.keep_one(docs, k=k).collect()} == {i for i in sets if root(i) == i}


def test_cells_hold_every_pair_of_like_sizes_once(spark):
    rng = random.Random(4)
    rows = [(k, i, rng.choice([rng.randint(1, 12), rng.randint(90, 130)])) for k, m in ((1, 120), (2, 9), (3, 40)) for i in range(m)]
    got = minhash.in_cells(spark.createDataFrame(rows, "key long, rep long, n long"), 80, most=16)
    met, sizes = Counter(), Counter()
    cells: dict = {}
    for r in got.collect():
        cells.setdefault((r["key"], r["cell"]), []).append(r)
        sizes[r["key"], r["cell"]] += 1
    for (key, cell), rs in cells.items():
        for x in rs:
            for y in rs:
                if x["rep"] < y["rep"] and (x["own"] is None or x["own"] != y["own"] or (cell["a"], cell["i"]) == (cell["b"], cell["j"])):
                    met[key, x["rep"], y["rep"]] += 1
    assert set(met.values()) == {1} and max(sizes.values()) < 80
    n = {(k, i): s for k, i, s in rows}
    due = {(k, i, j) for k, i in n for j in range(i + 1, 120) if (k, j) in n and 100 * min(n[k, i], n[k, j]) >= 80 * max(n[k, i], n[k, j])}
    assert due <= set(met)


def test_pairs_of_cells_are_those_of_brute_force():
    rng = np.random.default_rng(6)
    n = 1500
    base = np.unique(rng.integers(0, 1 << 62, 400, dtype="u8"))
    sets = [np.unique(np.concatenate((rng.permutation(base)[: rng.integers(320, 401)], rng.integers(0, 1 << 62, rng.integers(1, 30), dtype="u8")))) for _ in range(n)]
    bits, keys = np.array([minhash.bitmap(x) for x in sets]).view("u8"), rng.integers(0, 60, (n, minhash.BANDS))
    rows = {c: np.zeros(n, "i8") for c in ("key", "ca", "ci", "cb", "cj", "oa", "oi")} | {"rep": rng.permutation(n).astype("i8"), "n": np.array([len(x) for x in sets]), "label": rng.integers(0, 900, n), "place": np.full(n, 7)}
    rows["key"] = np.repeat([3, 4, 5], [1, n - 300, 299])
    split = rows["key"] == 4  # a cell of two parts: members of one part meet elsewhere
    rows["cj"][split], rows["oi"][split] = 1, rng.integers(0, 2, split.sum())
    began = time.process_time()
    got = [tuple(map(int, p)) for a, b in minhash.met_in_cells(rows, bits, keys, 80) for p in zip(a, b, strict=True)]
    assert time.process_time() - began < 5  # 800,000 pairs: a join of rows with columns of bits took some microseconds a pair
    due = set()
    for x in range(n):
        y = np.arange(x + 1, n)
        y = y[(rows["key"][y] == rows["key"][x]) & (rows["label"][y] != rows["label"][x]) & (~split[x] | (rows["oi"][y] != rows["oi"][x]))]
        small, large = np.minimum(rows["n"][x], rows["n"][y]), np.maximum(rows["n"][x], rows["n"][y])
        ok = (100 * small >= 80 * large) & (180 * np.bitwise_count(bits[y] ^ bits[x]).sum(1, dtype="i8") <= 20 * (small + large)) & ~(keys[y, :7] == keys[x, :7]).any(1)
        due |= {tuple(sorted((int(rows["rep"][x]), int(rows["rep"][j])))) for j in y[ok]}
    assert due and len(got) == len(set(got)) and set(got) == due


def test_bitmaps_bound_differences():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 1 << 62, 300, dtype="u8")) for _ in "ab")
        b = np.unique(np.concatenate((a[: rng.integers(0, 300)], b[:50])))
        x = np.bitwise_xor(minhash.bitmap(a), minhash.bitmap(b))
        assert sum(int(v).bit_count() for v in x.view("u8")) <= len(np.setxor1d(a, b))


def test_memory_of_an_owner():
    rng = np.random.default_rng(7)
    lengths = rng.integers(50, 90, 14_000)
    starts = np.cumsum(lengths + 1) - lengths - 1
    data = np.zeros(int((lengths + 1).sum()), "u2")
    words = rng.integers(98, 124, (300, 10)).astype("u2")
    for at, size in zip(starts, lengths, strict=True):
        data[at : at + size] = words[rng.integers(0, 300, 9)].ravel()[:size]
    tracemalloc.start()
    suffix_dedup.first_holders(data, starts, lengths, rng.integers(0, 1000, len(lengths)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * len(data)  # bytes; with every number in eight bytes it was over 100


def test_suffix_order():
    rng = random.Random(5)
    for _ in range(200):
        s = np.array([rng.randint(0, 3) for _ in range(rng.randint(0, 70))], "u2")
        depth = rng.choice([1, 3, 10, 50])
        order = suffix_dedup.suffix_order(s, depth).tolist()
        plain = s.tolist()
        assert sorted(order) == list(range(len(s))) and all(plain[a : a + depth] <= plain[b : b + depth] for a, b in zip(order, order[1:]))


def test_names_tell_strings_with_one_hash_apart():
    raw = np.frombuffer(b"abcabdabcabdxx", "u1")
    begin, size = np.array([0, 3, 6, 9, 0, 12]), np.array([3, 3, 3, 3, 2, 2])
    names = suffix_dedup.Names(raw)
    got, new = names.of(np.full(6, 7, "u8"), begin, size)
    assert got[0] == got[2] and got[1] == got[3] and len(set(got.tolist())) == 4 and new.tolist() == [True, True, False, False, True, True]
    again, new = names.of(np.full(3, 7, "u8"), np.array([9, 6, 12]), np.array([3, 3, 2]))
    assert again.tolist() == [got[1], got[0], got[5]] and not new.any()


@pytest.mark.parametrize("hot_docs", [suffix_dedup.HOT_DOCS, 3])
def test_suffix_dedup(spark, docs, texts, none, hot_docs):
    line = "a line of over fifty bytes that every one of them holds, in other surroundings each time"
    extra = [(950 + i, f"{texts[i][1]} {line[: 60 + i]} {texts[i + 20][1]}", None, None, None, 0, "x") for i in range(12)]
    extra += [(900 + i, ("q" * 60 + str(i)) * 3 + (texts[2][1] or "")[:80], None, None, None, 0, "x") for i in range(4)]
    table = docs.unionByName(spark.createDataFrame(extra, SCHEMA))
    data = {r["doc_id"]: (r["text"] or "").encode() for r in table.collect()}
    first = {}
    for i in sorted(data):
        for p in range(len(data[i]) - 49):
            first.setdefault(data[i][p : p + 50], i)
    got = by_id(suffix_dedup.remove_repeats(table, hot_docs=hot_docs))
    for i, b in data.items():
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        spans = int(np.count_nonzero(gone & ~np.concatenate(([False], gone[:-1])))) if len(b) else 0
        kept = hashlib.sha256(bytes(np.frombuffer(b, "u1")[~gone])).hexdigest()
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), int(gone.sum()), spans, kept)
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_sentencepiece(docs, texts, none):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = by_id(sentencepiece_codec.encode_documents(docs, path))
    for i, t in texts:
        r = got[i]
        assert list(r["ids"]) == sp.encode(t or "") and r["n_tokens"] == len(r["ids"]) and r["parity"]
        assert r["round_trip"] == ("▁" not in (t or ""))
        assert sentencepiece_codec.codec(path).tokenizer.decode(list(r["ids"])) == sentencepiece_codec.codec(path).decode(np.array(r["ids"], "i4"))
    assert sentencepiece_codec.encode_documents(none, path).count() == 0


def test_binary_output(spark, docs, texts, none):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    texts = [*texts, *[(1000 + i, t) for i, t in enumerate(["a <|endoftext|> b<|endoftext|>", "<|endoftext|>", " x\n<|endoftext|>\ny z"])]]
    docs = spark.createDataFrame([(i, t, None, None, None, i, "x") for i, t in texts], SCHEMA).repartition(5)
    shards = binary_output.write_shards(docs, path)
    got = by_id(binary_output.read_shards(shards))
    start = 0
    for i, t in texts:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    uri = shards.head()["uri"]
    null, doc, offset, n = binary_output.read_index(uri)[-1]
    assert binary_output.read_record(uri, offset)[0] == doc and len(binary_output.read_record(uri, offset)[1]) == n
    assert binary_output.tokens_on_disk(none, path).count() == 0
    nulls = spark.createDataFrame([(None, "b", None, None, None, 0, "x"), (1, "a", None, None, None, 0, "x")], SCHEMA)
    assert [r["doc_id"] for r in sorted(binary_output.tokens_on_disk(nulls, path).collect(), key=lambda r: r["start"])] == [None, 1]


def test_damage_is_seen():
    import io

    data = bytearray(binary_output.frame(b"payload"))
    data[14] ^= 1
    with pytest.raises(OSError, match="payload"):
        list(binary_output.frames(io.BytesIO(bytes(data)).read))


@pytest.mark.parametrize("text", ["", "\\", "</s>", "<\\/s>", "[[INST]", "a\\</s>[INST] \\\\ <|im_end|>", "\n[TURN]"])
def test_escape_is_reversible(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text and not any(c in hidden for c in chat.CONTROL)


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST]"), (1, 2, None, None), (1, 3, "assistant", None), (1, 4, "assistant", "a\\b"), (None, 0, "user", "x"), (2, 0, "assistant", "x"), (2, 0, "assistant", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digest(chat.format_conversations(table)).collect()}
    said = "user\nhi\nassistant\n</s>[INST]\n\n\nassistant\n\nassistant\na\\b\n"
    assert got[1]["n_turns"] == 5 and got[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert got[1]["loss_sha256"] == hashlib.sha256(b"</s>[INST]a\\b").hexdigest() and got[1]["loss_chars"] == 13
    assert got[2]["loss_chars"] == 2 and got[None]["loss_chars"] == 0 and not any(r["rewrote"] for r in got.values())
    assert chat.format_conversations(table.limit(0)).count() == 0


def test_rewriting_template_is_detected():
    render = lambda turns: f"<{len(turns)} turns>" + "".join(f"|{r}:{t}" for r, t in turns)
    text, _, loss, rewrote = chat.locate([("user", "a"), ("assistant", "bc"), ("user", "d"), ("assistant", "ef")], render)
    assert rewrote and [text[a:b] for a, b in loss] == ["ef"]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="ad">Buy</div><div class="cookie-notice">Cookies</div><article><h1>Title {n}</h1><p>One &amp; <b>two<br>three {n}<p>Four&nbsp;five   <i>six</i></p><form><p>Name</p><input></form></article>
<aside>Side</aside><section id="comments"><article class="comment"><p>Nice</p></article></section><footer>Foot</footer>"""


def test_html(spark):
    rows = [(i, f"http://Host{i % 2}.org/a", PAGE.format(n=i)) for i in range(24)] + [(30, None, None), (31, "", ""), (32, "http://x", "plain text"), (33, "http://x", "<p>a<p>b<!-- c"), (34, "http://x", "<div>a</div><nav>b</nav><main><p>c</main>")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(table).collect()}
    assert all(got[i] == f"Title {i}\n\nOne & two three {i}\n\nFour five six" for i in range(24))
    assert (got[30], got[31], got[32], got[33], got[34]) == ("", "", "plain text", "a\n\nb", "c")
    assert html_extract.extract(table.limit(0)).count() == 0


def test_template_text_is_dropped(spark):
    page = "<html><body><div><p>Welcome to the site</p></div><div><p>Story {n}</p></div><div><p>All rights</p></div></body></html>"
    table = spark.createDataFrame([(i, "http://h/", page.format(n=i)) for i in range(12)], "page_id long, url string, html string")
    assert {r["text"] for r in html_extract.extract(table).collect()} == {f"Story {i}" for i in range(12)}


def test_template_outlasts_pages_without_it(spark):
    page = "<html><body><div><p>Welcome to the site</p></div><div><p>Story {n}</p></div><div><p>All rights</p></div><div><p>All rights</p></div></body></html>"
    rows = [(i, "http://h/", page.format(n=i)) for i in range(12)] + [(20, "http://h/", ""), (21, "http://h/", "<p>404</p>")]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story {i}" for i in range(12)} | {20: "", 21: "404"}


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<main><h1>Title</h1><p>The whole body stands here</p><article class='card'>Teaser</article></main>", "Title\n\nThe whole body stands here\n\nTeaser"),
        ("<main><h1>Title</h1><article><p>Body</p></article><p>Closing</p></main>", "Title\n\nBody\n\nClosing"),
        ("<div><p>The whole body stands here</p></div><div class='content'>Box</div>", "The whole body stands here\n\nBox"),
        ("<div>Frame</div><article><p>The whole body stands here</p></article>", "The whole body stands here"),
    ],
)
def test_regions_around_an_article_stay(page, text):
    assert "\n\n".join(html_extract.choose(html_extract.scan(page)[1], set())) == text


def test_licences(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License.\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software"), (2, "a/b/c.py", "print(1)"), (3, "a/b/d.py", "x\nLicensed under the Apache License, Version 2.0\n" + "y " * 50),
        (4, "e/f.py", None), (5, None, ""), (6, "a/g/COPYING", "This work is licensed under the GNU General Public License, version 3."), (7, "a/g/h/i.py", "code"), (7, "a/g/h/i.py", "code"),
    ]
    got = {r["doc_id"]: (r["licence"], r["via"], r["from_path"]) for r in licences.licences(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("MIT", "own", "a/LICENSE"), 2: ("MIT", "inherited", "a/LICENSE"), 3: ("Apache-2.0", "own", "a/b/d.py"), 4: (None, None, None), 5: (None, None, None), 6: ("GPL-3.0", "own", "a/g/COPYING"), 7: ("GPL-3.0", "inherited", "a/g/COPYING")}
    assert licences.licences(spark.createDataFrame([], "doc_id long, path string, text string")).count() == 0


def test_strong_terms_lose_no_match():
    index = licences.Index({"the": 50, "of": 40, "is": 30, "under": 5}, 60)
    every = licences.Index({"the": 50, "of": 40, "is": 30, "under": 5}, 60)
    every.strong = frozenset(every.idf)
    for name, lines in licences.TEMPLATES.items():
        for line in lines:
            assert index.line(licences.terms(line)) == every.line(licences.terms(line))
    assert index.line(licences.terms("the of is to this")) is None and every.line(licences.terms("the of is to this")) is None


def test_licence_stretches_against_brute_force():
    rng = random.Random(11)
    df = {t: rng.randint(0, 300) for t in licences.vocabulary()}
    index = licences.Index(df, 400)
    words_of = [licences.terms(text) for _, texts in sorted(licences.TEMPLATES.items()) for text in texts]
    filler = ["alpha", "beta", "the", "of", "license", "software", "version", "public"]
    for turn in range(6):
        words = [rng.choice(filler) for _ in range(rng.randint(5, 60))]
        for _ in range(2):
            part = list(rng.choice(words_of))[: rng.randint(6, 60)]
            part[rng.randrange(len(part))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = part
        due = set()
        for k, own in enumerate(words_of):
            size, best = min(len(own), len(words)), None
            for start in range(len(words) - size + 1):
                counts = Counter(words[start : start + size])
                norm = math.sqrt(sum((c * index.idf.get(t, index.unknown)) ** 2 for t, c in counts.items()))
                cosine = sum(c * index.idf.get(t, 0) * index.vectors[k].get(t, 0) for t, c in counts.items()) / norm
                best = max(best or 0, round(cosine, 6))
            if best >= licences.THRESHOLD:
                due.add((index.names[k], best))
        got = {(name, cosine) for cosine, name, _, _ in index.stretches(words)}
        assert {n for n, _ in got} == {n for n, _ in due} and all(any(n == m and abs(a - b) < 2e-6 for m, b in got) for n, a in due)


def test_licences_across_lines_and_whole_texts(spark):
    wrap = lambda text, n: "\n".join(" ".join(text.split()[i : i + n]) for i in range(0, len(text.split()), n))
    long_line = "Here is my project. " + "It does many things well. " * 3 + "This work is licensed under the GNU General Public License, version 3. " + "Enjoy it as you like and tell others. " * 3
    rows = [(1, "a/x", wrap(licences.TEXTS["MIT"], 9)), (2, "b/x", "Copyright 2020 Some Body\n\n" + wrap(licences.TEXTS["BSD-3-Clause"], 11)), (3, "c/x", long_line), (4, "d/x", "This work is licensed under\nthe GNU General Public\nLicense, version 3."), (5, "e/x", "word " * 30_000), (5, "e/x", "word " * 30_000), (6, "f/x", wrap(licences.TEXTS["Zlib"], 7))]
    table = spark.createDataFrame([(*r, "clash", 0.5) for r in rows], "doc_id long, path string, text string, licence string, score double")
    got = {r["doc_id"]: r for r in licences.licences(table).collect()}
    assert {i: r["licence"] for i, r in got.items()} == {1: "MIT", 2: "BSD-3-Clause", 3: "GPL-3.0", 4: "GPL-3.0", 5: None, 6: "Zlib"}


def test_classes_against_brute_force(spark):
    rng = random.Random(6)
    box = "<div><h3>Sign up</h3><p>All the news</p><p>Every week</p></div>"
    rows = []
    for i in range(120):
        host = f"h{i % 2}"
        parts = ["<p>Hello there</p>"] + [f"<p>Story {i} {k}</p>" for k in range(rng.randint(1, 4))] + ([box] if i % 5 == 0 else []) + (["<p>Now and then</p>"] if i % 5 in (1, 2) else []) + ["<ul><li>a</li><li>a</li></ul>", f"<p>Bye {host}</p>"]
        rows.append((i, f"http://{host}/{i}", f"<html><body>{''.join(parts)}</body></html>"))
    rows += [(200, "http://h0/x", ""), (201, "http://h1/x", "<p>404</p>"), (202, "http://small/", "<p>one</p>"), (203, "http://h0/0", rows[0][2])]
    table = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, host long")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(table.drop("host").withColumn("template", F.lit("clash"))).collect()}
    due = {}
    for host in ("h0", "h1", "small"):
        own = {h: html_extract.scan(h) for _, u, h in rows if u.startswith(f"http://{host}/")}  # copies once
        seen = {h: Counter([html_extract._token("tag ", p) for p in structure] + [html_extract.text_token(b) for b in blocks]) for h, (structure, blocks) in own.items() if structure or blocks}
        vectors = {}
        for h, count in seen.items():
            for t, n in count.items():
                vectors.setdefault(t, []).append((h, n))
        by_class = {}
        for t, v in vectors.items():
            by_class.setdefault(tuple(sorted(v)), []).append(t)
        template = set()
        for v, ts in by_class.items():
            if len(seen) >= 10 and (len(v) >= 0.5 * len(seen) or len(v) >= 10 and len(ts) >= 3) and len(v) >= 5:
                template |= set(ts)
        if host != "small":
            assert {b for b in ("Hello there", "a", f"Bye {host}")} <= {b.text for _, blocks in own.values() for b in blocks if html_extract.text_token(b) in template}
        for i, u, h in rows:
            if u.startswith(f"http://{host}/"):
                due[i] = "\n\n".join(html_extract.choose(html_extract.scan(h)[1], template))
    assert got == due
    assert not any("Every week" in t for i, t in got.items()) and any("Now and then" in t for t in got.values()) and got[201] == "404" and got[202] == "one"


def test_classes_are_cut_to_be_ordered_and_nested():
    owner = {t: (c, i) for c, ts in enumerate([(7, 8), (4, 5, 6), (1, 2, 3)]) for i, t in enumerate(ts)}
    cut = lambda *page: html_extract.faults(list(page), owner, [2, 3, 3])
    assert cut(1, 4, 7, 0, 8, 5, 6, 2, 3) == cut(1, 2, 3, 1, 2, 3, 4, 5, 6, 4, 5, 6) == cut() == set()
    assert cut(1, 3, 2) == {(2, 2)} and cut(2, 1, 3) == {(2, 1)}
    assert cut(1, 2, 1, 2, 3, 3) == {(2, 2)}
    # the lesser of two classes that cross is cut, whichever opens first
    assert cut(1, 4, 2, 5, 6, 3) == {(1, 1)} and cut(4, 5, 1, 6, 2, 3) == {(1, 2)} and cut(1, 7, 4, 8, 5, 6, 2, 3) == {(0, 1)}


def test_text_out_of_order_is_no_template(spark):
    """Three lines that a third of the pages have are a box only if they come in one order."""
    lines = ["<p>Alpha says so</p>", "<p>Beta agrees now</p>", "<p>Gamma does not</p>"]
    page = "<html><body><div><p>Welcome to the site</p></div><div><p>Story {n}</p></div>{box}<div><p>All rights</p></div></body></html>"
    turned = [lines, [lines[1], lines[0], lines[2]], [lines[0], lines[2], lines[1]]]
    box = lambda host, n: "".join(turned[n // 3 % 3 if host == "b" else 0]) if n % 3 == 0 else ""
    rows = [(n + 100 * (host == "b"), f"http://{host}/", page.format(n=n, box=box(host, n))) for host in "ab" for n in range(36)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[n] == f"Story {n}" for n in range(36))
    said = lambda n: [x[3:-4] for x in turned[n // 3 % 3]] if n % 3 == 0 else []
    assert all(got[100 + n] == "\n\n".join([f"Story {n}", *said(n)]) for n in range(36))
