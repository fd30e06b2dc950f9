"""Each corpus operator against brute force, on small tables with every odd case."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webloom.llm import bpe, jaccard, maxent, mixing, mixing_sql, neighbours, pii, quality, sharding, suffix, toxicity
from webloom.llm import queries as q
from webloom.llm.common import id_crc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows():
    long_ = " ".join(f"w{i % 997} x{i}" for i in range(30_000))
    near = [f"a{i}" for i in range(100)]
    rows = [None, "", " \n\t ", "one", "one two three four", "One TWO three four", "a b c d e", long_, long_, " ".join(near), " ".join([*near[:-1], "z"]), " ".join([*near, "y", "x"]), "é" * 300, " x ", "ab " * 200, "0123456789" * 40]
    rows += ["passage " + " ".join(f"p{i}" for i in range(40)) + f" tail{k} " + " ".join(f"t{k}_{i}" for i in range(30)) for k in range(6)]
    rows += ["mail a@b.com or a@b@c.org, +1 (555) 010-9999, 10.0.0.1 4111 1111 1111 1111"]
    return [(i, t, ("en", "de", None)[i % 3], ("src0", "src5", None, "src9")[i % 4], None if t is None else len(t)) for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    # Columns whose names the operators use themselves must not disturb them.
    return spark.createDataFrame(odd_rows(), SCHEMA).withColumns({c: F.lit(7) for c in ("node", "n", "ord", "id", "row", "token", "slot", "key", "place", "spans", "range")}).repartition(3)


@pytest.fixture(scope="module")
def texts():
    return {r[0]: r[1] or "" for r in odd_rows()}


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return t.encode().lower().split()


# ------------------------------------------------------------ 1


def _fill(budget, kids):
    """kids: name -> (weight, cap); water filling in exact steps, then whole tokens by cumulative shares."""
    rows = sorted(kids, key=lambda k: (kids[k][1] / kids[k][0] if kids[k][0] > 0 else 0.0, k is not None, k or ""))
    out, left = {}, budget
    while rows:
        w = sum(kids[k][0] for k in rows)
        k = rows[0]
        if kids[k][1] * w <= left * kids[k][0]:
            out[k] = kids[k][1]
            left -= out[k]
            rows.pop(0)
            continue
        upto = 0
        for k in rows:
            out[k] = left * (upto + kids[k][0]) // w - left * upto // w
            upto += kids[k][0]
        break
    return out


@pytest.mark.parametrize("share", [0.3, 0.9, 1.6, 5.0])
def test_mixing_budgets(spark, share):
    stock = {("a", "x"): 100, ("a", "y"): 7, ("b", "x"): 50, ("b", "z"): 3, ("c", "x"): 11, (None, "x"): 5}
    rows = [(i, " ".join(["w"] * n), a, b) for i, ((a, b), total) in enumerate(stock.items()) for n in [1] * total]
    rows = [(k, t, a, b) for k, (_, t, a, b) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    weight = {"a": 5, "b": 3, "c": 0, None: 1}
    inner = {"x": 2, "y": 9, "z": 1}
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    weights = {"lang": F.expr("CASE lang WHEN 'a' THEN 5 WHEN 'b' THEN 3 WHEN 'c' THEN 0 ELSE 1 END"), "source": F.expr("CASE source WHEN 'x' THEN 2 WHEN 'y' THEN 9 ELSE 1 END")}
    got = mixing.chosen(df, levels, weights, share=share, epochs=2)
    taken = {(r.lang, r.source): r.t for r in got.groupBy("lang", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("t")).collect()}
    caps = {a: sum(2 * n for (x, _), n in stock.items() if x == a) if weight[a] else 0 for a in weight}
    top = _fill(min(int(sum(stock.values()) * share), sum(caps.values())), {a: (weight[a], caps[a]) for a in weight})
    want = {}
    for a, b in top.items():
        want |= {(a, s): n for s, n in _fill(b, {s: (inner[s], 2 * n) for (x, s), n in stock.items() if x == a}).items()}
    assert taken == {k: n for k, n in want.items() if n}


def test_mixing_odd(spark, docs, empty):
    p = mixing_sql
    got = mixing.mixed(docs, p.levels(), p.weights(), epochs=2)
    assert got.columns == docs.columns
    picked = {r.doc_id: r.copies for r in mixing.chosen(docs, p.levels(), p.weights(), epochs=2).collect()}
    assert Counter(r.doc_id for r in got.select("doc_id").collect()) == picked
    assert mixing.mixed(empty, p.levels(), p.weights()).count() == 0


def test_mixing_is_a_prefix_of_the_epoch(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 3)
    df = spark.createDataFrame([(i, "w " * (i % 5), "en", "s") for i in range(200)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.copies for r in mixing.chosen(df, {"lang": F.col("lang")}, {"lang": F.lit(1)}, share=1.4, epochs=3, seed=4).collect()}
    left, total = int(400 * 1.4) - 400, 0
    for place, i in sorted((hashlib.md5(f"4|1|{i}".encode()).hexdigest(), i) for i in range(200)):
        total += i % 5
        assert got.get(i, 0) == 1 + (total <= left), place


# ------------------------------------------------------------ 2


def test_sharding(spark, docs, texts, empty):
    rows = sharding.shuffle(docs, 8, bucket_bytes=20_000).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    again = sharding.shuffle(docs.repartition(7), 8, bucket_bytes=20_000).select("doc_id", "shard", "slot").collect()
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {tuple(r) for r in again}
    assert sharding.shuffle(empty, 8).count() == 0
    same = spark.range(1).select(F.explode(F.sequence(F.lit(1), F.lit(100)))).select(F.lit(None).cast("long").alias("doc_id"), F.lit("t").alias("text"))
    assert Counter(r.shard for r in sharding.shuffle(same, 3).collect()) == {0: 34, 1: 33, 2: 33} or sorted(Counter(r.shard for r in sharding.shuffle(same, 3).collect()).values()) == [33, 33, 34]


def test_shard_files(spark, docs, tmp_path):
    sharding.write_shards(docs.select("doc_id", "text"), f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 4


# ------------------------------------------------------------ 3


def test_language_model(spark, docs, texts, empty):
    df = docs.select("doc_id", "text").withColumn("held_out", maxent.held_out())
    rows = maxent.score(df, df.where("NOT held_out"), extra=("held_out",), top=500).collect()
    c = Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10 for w in [*words(t), b""])
    n, v = sum(c.values()), len(c)
    for r in rows:
        ws = [*words(texts[r.doc_id]), b""]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert r.base_score == pytest.approx(base) and r.n_tokens == len(ws) and r.n_known == sum(c[w] > 0 for w in ws) and r.train_tokens == n
        assert r.score < 0 and math.isfinite(r.score)
    assert sum(r.score for r in rows if r.n_tokens > 1000) > sum(r.base_score for r in rows if r.n_tokens > 1000)
    blank = empty.withColumn("held_out", F.lit(True))
    assert maxent.score(blank, blank, extra=("held_out",)).count() == 0


def test_weights_grow_with_training_tokens():
    few, many = (maxent.Vocabulary([], np.zeros(0), n, n, np.ones((maxent.CLASSES, maxent.PARTS))) for n in (1000, 10**10))
    assert few.rows == maxent.ROWS and many.rows == 1 << 17 and many.lookup().rows == many.rows
    assert maxent.CLASSES == 128 and maxent.FEATURES == 4
    code = np.array([0, 5 << 8 | 1, 70_000 << 8 | 2, 9 << 8 | 3, 0])
    at = maxent._context(code, np.arange(5) == 0, many.rows)
    assert (at // many.rows == np.arange(4)[:, None]).all() and at[0, 3] == 70_000
    other = maxent._context(code + [0, 7, 0, 0, 0], np.arange(5) == 0, many.rows)
    assert (at[:, 4] != other[:, 4]).tolist() == [False, False, False, True]  # the class three back


def test_context_decides_within_a_class(spark):
    """Words of one ending, so of one class: the word before says which follows."""
    rng = np.random.default_rng(5)
    common = [f"{chr(97 + i // 8)}{i % 8}" for i in range(maxent.SINGLES)] * 1000
    texts = [" ".join(common)] + [" ".join(f"{a}ka {b}zing" for a, b in zip("abcd" * 10, "pqrs" * 10, strict=True)) for _ in range(60)]
    df = spark.createDataFrame(enumerate([*texts, *[" ".join(rng.permutation(t.split())) for t in texts[1:4]]]), "doc_id long, text string").coalesce(1)
    train = df.where(f"doc_id < {len(texts)}")
    vocab = maxent.vocabulary(maxent.count_words(train), 1000)
    table = vocab.lookup()
    codes = [table[f"{x}zing".encode()] for x in "pqrs"]
    assert len({c & 0xFF for c in codes}) == 1 and len({c >> 36 & 0xFF for c in codes}) == 4
    w, bias = maxent.fit(train, vocab)
    half, cls = len(w) // 2, codes[0] & 0xFF
    for a, c in zip("abcd", codes, strict=True):
        code = np.array([table[f"{x}".encode()] for x in ("sring", f"{a}ka")] + [c])
        at = maxent._context(code, np.arange(3) == 0, vocab.rows)[:, 2:]
        z = maxent._scores(w[half:], vocab.log_share()[[cls]], at)[0]
        p = np.exp(z) / np.exp(z).sum()
        assert p.sum() == pytest.approx(1, abs=1e-5) and p[c >> 36 & 0xFF] > 2 * np.exp(vocab.log_share()[cls, c >> 36 & 0xFF])


def test_class_probabilities_add_up():
    rng = np.random.default_rng(0)
    w = rng.normal(size=(maxent.FEATURES * maxent.ROWS, maxent.CLASSES)).astype(np.float32)
    at = np.stack([rng.integers(f * maxent.ROWS, (f + 1) * maxent.ROWS, 9) for f in range(maxent.FEATURES)])
    z = maxent._scores(w, np.zeros(maxent.CLASSES, np.float32), at)
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    assert p.sum(1) == pytest.approx(np.ones(9), abs=1e-5)


def test_gradient_step_raises_likelihood():
    rng = np.random.default_rng(1)
    code = rng.integers(0, 4, 4000) << 8 | rng.integers(0, 4, 4000)
    code[1::2] = code[::2] & ~0xFF | (code[::2] >> 8 & 3)
    begins = np.arange(4000) == 0
    at, cls = maxent._context(code, begins), code & 0xFF
    w, sq, n = np.zeros((maxent.FEATURES * maxent.ROWS, maxent.CLASSES), np.float32), np.ones(maxent.FEATURES * maxent.ROWS, np.float32), np.zeros(maxent.FEATURES * maxent.ROWS, np.int64)
    bias = np.zeros(maxent.CLASSES, np.float32)
    loss = []
    for _ in range(5):
        z = maxent._scores(w, bias, at)
        loss.append(float((np.log(np.exp(z).sum(1)) - z[np.arange(4000), cls]).mean()))
        maxent._descend(w, sq, n, bias, at, cls)
    assert loss[1] < loss[0] and min(loss[1:]) < 0.5 * loss[0] and loss[-1] < 0.6 * loss[0]


# ------------------------------------------------------------ 4


@pytest.fixture(scope="module")
def encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, texts, encoding, empty):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    for size in (bpe.PIECE, 50):
        coded = bpe.encode(docs, path, public_tokenizers.PATTERN, size=size)
        for r in bpe.decode(coded, path, public_tokenizers.PATTERN).collect():
            want = encoding.encode_ordinary(texts[r.doc_id])
            assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want) and bytes(r.decoded) == texts[r.doc_id].encode()
    assert bpe.encode(empty, path, public_tokenizers.PATTERN).count() == 0


def test_bpe_pieces(encoding):
    text = "it's  a test,\n\n of 12abc pieces 日本 語 'll   end . " * 300 + "x" * 500 + "   "
    parts = list(bpe.pieces(text, 40))
    assert "".join(parts) == text and len(parts) > 100
    assert [i for p in parts for i in encoding.encode_ordinary(p)] == encoding.encode_ordinary(text)


# ------------------------------------------------------------ 5


def test_quality(docs, texts, empty):
    for r in quality.measure(docs).collect():
        t = texts[r.doc_id]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, cover, lines, dup = {}, set(), set(), 0
        for i in range(len(w) - 4):
            seen.setdefault(tuple(w[i : i + 5]), []).append(i)
        for at in seen.values():
            if len(at) > 1:
                cover.update(i + k for i in at for k in range(5))
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in lines
                lines.add(line)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover))
        assert r.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w)) and r.kept == (r.in_band and not r.base_failed)
    assert quality.measure(empty).count() == 0


def test_bands_reject_repetition_and_noise(spark, small):
    import random

    rng = random.Random(2)
    noise = "".join(chr(rng.randrange(33, 0x2FFF)) for _ in range(3000))
    clean = max((r.text for r in spark.read.parquet(f"{small}/documents.parquet").limit(40).collect()), key=lambda t: len(set(t.split())))
    df = spark.createDataFrame([(0, "spam and eggs are here again, " * 200), (1, noise), (2, clean), (3, clean + " lorem" * 3000)], "doc_id long, text string")
    assert {r.doc_id: r.in_band for r in quality.measure(df).collect()} == {0: False, 1: False, 2: True, 3: False}


@pytest.mark.parametrize("rest", [1500, 3000])
@pytest.mark.parametrize("chunks", [1, 3])
def test_last_chunks_are_judged(spark, small, rest, chunks):
    import random

    text = " ".join(r.text for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").limit(40).collect()).encode("ascii", "ignore").decode()
    rng = random.Random(3)
    w = sorted(set(text.split()))
    clean = " ".join(rng.choice(w) for _ in range(6000))[: quality.CHUNK * chunks + rest]
    at = quality.CHUNK * (chunks - 1)
    wide = tuple((n, 0.0, 9.0) if n >= quality.CHUNK else (n, low, high) for n, low, high in quality.BANDS)
    full = clean[:at] + "all of this again " * 300
    full = full[: at + quality.CHUNK] + clean[at + quality.CHUNK :]
    tail = (clean[: at + quality.CHUNK] + "all of this again " * 300)[: len(clean)]
    df = spark.createDataFrame(enumerate([clean, full, tail]), "doc_id long, text string")
    got = {r.doc_id: r.in_band for r in quality.measure(df, bands=wide).collect()}
    assert got == {0: True, 1: False, 2: 2 * rest < quality.CHUNK}


# ------------------------------------------------------------ 6


def _components(texts, ids):
    sets = {}
    for i in ids:
        w = words(texts[i])
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def _near(seed, groups=12):
    import random

    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        base = [f"v{rng.randrange(400)}" for _ in range(rng.randrange(5, 120))]
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"u{rng.randrange(50)}"
            out.append(" ".join(w[: rng.randrange(max(4, len(w) - 12), len(w) + 1)]))
    return out


@pytest.mark.parametrize("tight", [False, True])
def test_jaccard(spark, docs, texts, monkeypatch, tight):
    if tight:  # small blocks, deals and signatures take every other path
        for name, value in (("BLOCK", 3), ("SMALL", 1), ("TOGETHER", 1), ("TILE", 2), ("SIGNATURE_BITS", (64, 64)), ("FILTER_BITS", 64)):
            monkeypatch.setattr(jaccard, name, value)
    every = dict(texts) | {100 + i: t for i, t in enumerate(_near(1))}
    df = spark.createDataFrame([(i, t) for i, t in every.items()], "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(df).collect()}
    assert got == _components(every, sorted(every))
    kept = jaccard.dedupe(df.withColumn("extra", F.lit(1)))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in got.values()}) and kept.columns == ["doc_id", "text", "extra"]


def test_jaccard_many_copies(spark, monkeypatch):
    """Copies make a token frequent, but its few nodes must still meet."""
    monkeypatch.setattr(jaccard, "TILE", 2)
    every = {}
    for g in range(4):
        base = [f"g{g}w{k}" for k in range(60)]
        every |= {100 * g + i: " ".join(base) for i in range(20)} | {100 * g + 50: " ".join([*base[:-1], "z"])}
    df = spark.createDataFrame(list(every.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(df).collect()}
    assert got == _components(every, sorted(every))


def test_jaccard_dealt_tiles_keep_lone_rows(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 1)
    rows = [(i, 10, [7, 100 + i], [9, 1]) for i in range(4)] + [(4, 10, [8], [9])]
    nodes = spark.createDataFrame(rows, "node long, n long, prefix array<long>, splits array<int>")
    assert sorted((r.token, r.node, r["head"]) for r in jaccard._tiles(nodes, 80).collect()) == [(7, i, True) for i in range(4)]


def test_jaccard_odd(spark, docs, empty):
    assert jaccard.classes(empty).count() == 0 and jaccard.dedupe(empty).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id) for r in jaccard.classes(df).collect())
    assert got == {(None, 5): 1, (5, 5): 2, (None, None): 1}
    assert jaccard.dedupe(df).count() == 3
    assert set(jaccard.classes(docs).columns) == {"doc_id", "n_shingles", "component_id"}


def test_dedupe_keeps_unlinked_texts_of_a_repeated_id(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(3, a), (5, a), (5, b), (5, b), (6, c), (6, d), (7, None), (7, ""), (7, a), (None, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.text) for r in jaccard.dedupe(df).collect())
    assert got == Counter([(3, a), (5, b), (6, c), (6, d), (7, None), (7, ""), (None, b)])


# ------------------------------------------------------------ 7


def _removed(rows, length=100):
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        cover = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            x = b[s : s + length]
            if x in seen:
                cover[s : s + length] = True
            seen.add(x)
        out[i] = bytes(np.frombuffer(b, np.uint8)[~cover])
    return out


@pytest.mark.parametrize("tight", [False, True])
def test_suffix(spark, docs, texts, monkeypatch, tight):
    if tight:
        for name, value in (("DEAL", 400), ("LONGEST", 40), ("BATCH", 300)):
            monkeypatch.setattr(suffix, name, value)
    few = {i: t for i, t in texts.items() if len(t) < 5000}
    few |= {200: "y" * 700, 201: "ab" * 300, 202: few[17][20:190] + "q" * 150, 203: few[17], 204: few[17]}
    df = spark.createDataFrame(sorted(few.items()), "doc_id long, text string").repartition(3)
    want = _removed(sorted(few.items()))
    for r in suffix.remove(df.withColumn("ord", F.lit(1))).collect():
        assert bytes(r.kept) == want[r.doc_id], r.doc_id
        assert len(few[r.doc_id].encode()) - sum(s.end - s.start for s in r.spans) == len(want[r.doc_id])


def test_suffix_odd(spark, docs, empty):
    assert suffix.remove(empty).count() == 0
    t = hashlib.sha512(b"a").hexdigest() + hashlib.md5(b"b").hexdigest()[:22]
    df = spark.createDataFrame([(None, t), (3, t), (3, t), (None, None)], "doc_id long, text string")
    assert sorted(len(r.kept) for r in suffix.remove(df).collect()) == [0, 0, 0, 150]
    assert suffix.remove(docs).count() == docs.count()


def test_refinement_orders_windows():
    rng = np.random.default_rng(4)
    segs = [bytes(rng.integers(97, 99, n).tolist()) + b"k" * 60 for n in (100, 130, 160)] * 2
    starts, later = suffix.repeats(segs, 100)
    joined, seen = b"".join(segs), set()
    for s, x in zip(starts.tolist(), later.tolist(), strict=True):
        w = joined[s : s + 100]
        assert x == (w in seen)
        seen.add(w)


# ------------------------------------------------------------ 8


def test_neighbours(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[100:140] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(900, None), (920, []), (940, [0.0] * 16), (960, [1.0] * 8), (980, [float("nan")] * 16), (1000, [float("inf")] * 16), (1020, [None] + [1.0] * 15), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.search(df, df.where("vec_id % 20 = 0"), leaf=60, share=1.2, sample=300).collect()
    z = x.astype(float)
    hits = 0
    for i in range(0, 900, 20):
        s = (z * z[i]).sum(1)
        s[i] = -np.inf
        best = np.lexsort((np.arange(900), -s))[:20]
        mine = sorted((r.rank, r.id, r.score) for r in got if r.query_id == i)
        assert [r for r, _, _ in mine] == list(range(1, 21))
        assert all(c == pytest.approx(s[k], rel=1e-12) for _, k, c in mine) and sorted(mine, key=lambda m: (-m[2], m[1])) == mine
        hits += len(set(best.tolist()) & {k for _, k, _ in mine})
    assert {r.query_id for r in got} == set(range(0, 900, 20)) and hits >= 0.9 * 20 * 45
    assert neighbours.search(df.where("false"), df.where("false")).count() == 0
    two = df.where("vec_id IN (0, 1)")
    assert [(r.query_id, r.id) for r in neighbours.search(two, two).orderBy("query_id").collect()] == [(0, 1), (1, 0)]


def test_neighbours_repeated_rows(spark):
    rows = [(0, [1.0, 2.0])] * 40 + [(1, [1.0, 2.0]), (2, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.search(df, df.where("vec_id = 2"))
    assert [(r.rank, r.id) for r in got.orderBy("rank").collect()] == [(1, 0), (2, 1)]


# ------------------------------------------------------------ 9

_PII = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def _plain(text):
    out = []
    for k, (kind, p) in enumerate(_PII):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            odd = [sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])]
            if {"email": True, "ip": kind == "ip" and all(int(x) < 256 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and sum(odd) % 10 == 0, "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def test_pii_base(spark, docs, texts, empty):
    import random

    rng = random.Random(8)
    more = {300 + i: "".join(rng.choice(["1", "2", "45", ".", " ", "-", "@", "a", "b.c", "+", "(", ")", "4111111111111111", "é", "1.2.3.4", "x@y.z"]) for _ in range(120)) for i in range(60)}
    df = spark.createDataFrame([*texts.items(), *more.items()], "doc_id long, text string")
    for r in pii.find(df).collect():
        assert [f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.base] == _plain((texts | more)[r.doc_id])
    assert pii.find(empty).count() == 0 and pii.mask(docs).columns == docs.columns


def test_pii_method():
    found = lambda t: [(s["kind"], t[s["start"] : s["end"]]) for s in pii.spans(t) if not s["base"]]
    assert found("IBAN GB82 WEST 1234 5698 7654 32 ok") == [("iban", "GB82 WEST 1234 5698 7654 32")]
    assert found("IBAN GB83 WEST 1234 5698 7654 32 ok") == []
    assert found("call (555) 010-9999") == [("phone", "(555) 010-9999")] and found("sum (555) 010-9999") == []
    assert found("my ssn: 123-45-6789") == [("ssn", "123-45-6789")] and found("no 123-45-6789") == []
    assert pii.masked("a@b.com and 10.0.0.1!") == "[EMAIL] and [IP]!" and pii.masked("clean") == "clean"


# ------------------------------------------------------------ 10


def test_toxicity(spark, empty):
    import random

    rng = random.Random(9)
    plain = ["green", "river", "stone", "paper", "window", "lamp", "clown", "fish", "seven"]
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        w = [rng.choice(plain[:6]) for _ in range(30)]
        if bad:
            for _ in range(2):
                w[rng.randrange(30)] = rng.choice(["grobnik", "grobnak", "zlunt", "idiot"])
        elif i % 7 == 0:
            w += ["clown", "fish"]
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    lex = toxicity.learn(toxicity.labelled(docs, toxicity.training_ids(known)))
    got = {r.doc_id: r for r in toxicity.score(docs, lex).collect()}
    assert all(got[i].predicted == y for i, y in labels)
    odd = spark.createDataFrame([(0, None), (1, ""), (2, "you gr0bnik"), (3, "a zlu​nt"), (4, "an іdiot"), (5, "clown fish"), (6, "stone " * 40_000)], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in toxicity.score(odd, lex).collect()} == {0: 0, 1: 0, 2: 1, 3: 1, 4: 1, 5: 0, 6: 0}
    assert toxicity.reject(odd.withColumn("score", F.lit(1)), lex).count() == 4
    assert all(0 <= r.score <= 1 for r in got.values()) and toxicity.score(empty, lex).count() == 0
    bare = toxicity.learn(toxicity.labelled(docs, known.where("false")))
    assert {r.predicted for r in toxicity.score(odd.where("doc_id IN (1, 4)"), bare).collect()} == {0, 1}


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    rows = q.op10_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows)
    assert right >= 0.93 * len(rows)


def test_ids_without_value_have_a_crc(spark):
    df = spark.createDataFrame([(None,), (17,)], "doc_id long")
    assert [r[0] for r in df.select(id_crc()).collect()] == [0, zlib.crc32(b"17")]


# ------------------------------------------------------------ hot and odd inputs


def test_shuffle_spreads_identical_rows(spark):
    """Equal rows fill no bucket of their own, and the result doesn't depend on the partitioning."""
    rows = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same text").alias("text")).union(spark.range(500).select("id", F.concat(F.lit("t"), F.col("id"))))
    found = []
    for parts in (2, 5):
        done = sharding.shuffle(rows.repartition(parts), 8, bucket_bytes=20_000)
        table = done.withColumn("p", F.spark_partition_id()).collect()
        held = Counter(r.p for r in table if r.text == "same text")
        assert sum(held.values()) == 3000 and max(held.values()) < 1000
        sizes = Counter(r["shard"] for r in table)
        assert len(table) == 3500 and max(sizes.values()) - min(sizes.values()) <= 1
        for k in range(8):
            assert sorted(r.slot for r in table if r["shard"] == k) == list(range(sizes[k]))
        found.append(sorted((r["shard"], r.slot, r.doc_id, r.text) for r in table))
    assert found[0] == found[1]


def test_pii_overlaps_match_a_plain_check():
    """Added spans: best first, none over a base span or a better one."""
    text = "iban DE89 3704 0044 0532 0130 00 ssn 123-45-6789 call (555) 010-9999 token " + "a1" * 20 + " 10.0.0.1 x@y.org " * 3
    base = pii.base_spans(text)
    kept = pii.extra_spans(text, base)
    assert {k for k, *_ in kept} >= {"iban", "secret"}
    every = [(a, b) for _, a, b in base]
    for _, a, b, _ in kept:
        assert all(b <= c or d <= a for c, d in every)
        every.append((a, b))


def test_neighbours_of_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 9.0]), (2, [2.0, 1.0]), (3, [0.5, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.id): r.score for r in neighbours.search(df, df).collect()}
    for q, x in ((1, [0.0, 9.0]), (2, [2.0, 1.0]), (3, [0.5, 3.0])):
        for other in {1, 2, 3} - {q}:
            assert got[q, other] == max(a * c + b * d for i, (c, d) in rows if i == other for a, b in [x])


def test_jaccard_blocks_lose_no_link(spark, monkeypatch):
    """Blocks of a few rows and of few shingles, by bands and hashes, give what brute force gives."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        words_ = list(base[: rng.randint(40, 60)])
        for _ in range(rng.randint(0, 4)):
            words_[rng.randrange(len(words_))] = f"x{rng.randint(0, 30)}"
        rows.append((i, " ".join(words_)))
    sets = {i: set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    for name, value in (("BLOCK", 8), ("WEIGHT", 200), ("SMALL", 4), ("FIRST", 1)):
        monkeypatch.setattr(jaccard, name, value)
    got = {r.doc_id: r.component_id for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: root(i) for i in sets}


def test_texts_split_as_bytes_do():
    rng = random.Random(3)
    texts = [None, "", " ", "  A b\ta ", "É x\x85 y\x1cZ  ", "\x0b\x0c\r\n q Q", "a" * 300_000 + " B"]
    texts += ["".join(rng.choice("aB \t\nçx  ") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    for skip in (0, 4):
        own = texts[skip:]
        got = maxent._Texts.of(pa.array(texts, pa.string())[skip:])
        assert list(got.size) == [len((t or "").encode().split()) + 1 for t in own]
        words = [w for t in own for w in [*(t or "").encode().lower().split(), b""]]
        distinct = got.distinct.to_pylist()
        assert [distinct[k] for k in got.which] == words
        at = np.arange(0, len(words), 3)
        of = np.repeat(np.arange(len(own)), got.size)
        for i, found in enumerate(got.counted(at).to_pylist()):
            assert {r["token"]: r["tf"] for r in found} == Counter(words[k] for k in at if of[k] == i)
    none = maxent._Texts.of(pa.array([], pa.string()))
    assert not len(none.which) and not len(none.size)


def test_a_step_serves_all_features_at_once():
    rng = np.random.default_rng(5)
    for n in (0, 1, 8, 13, 4096):
        flags = rng.random(n) < 0.03
        assert maxent._set(flags).tolist() == np.flatnonzero(flags).tolist()
    k, n, size = maxent.CLASSES, 300, maxent.FEATURES * maxent.ROWS
    at = np.stack([f * maxent.ROWS + rng.integers(0, 40, n) for f in range(maxent.FEATURES)])
    cls, bias = rng.integers(0, k, n), rng.normal(size=k).astype(np.float32)
    w, sq, met = rng.normal(size=(size, k)).astype(np.float32), np.ones(size, np.float32), np.zeros(size, np.int64)
    assert np.array_equal(maxent._gathered(w, at), w[at[0]] + w[at[1]] + w[at[2]] + w[at[3]])
    p = np.exp(w[at].sum(0) + bias)
    p *= (maxent.DRAWS / p.sum(1))[:, None]
    miss = 1 - p[np.arange(n), cls] / maxent.DRAWS
    token, column = np.nonzero(p > maxent._noise()[: n * k].reshape(n, k))
    want = w.copy()
    for rows in at:  # one feature after the other
        total = np.bincount(rows, miss, size)
        rate = maxent.RATE / np.sqrt(1 + np.bincount(rows, miss * total[rows] * 2 / k, size))[rows]
        np.subtract.at(want, (rows[token], column), np.maximum(p[token, column], 1) / maxent.DRAWS * rate[token])
        np.add.at(want, (rows, cls), rate)
    maxent._descend(w, sq, met, bias, at, cls)
    assert np.allclose(w, want, atol=1e-3) and met.sum() == maxent.FEATURES * n
