"""The operators against brute force on small tables, with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import inspect
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fieldglass.llm import bm25, bpe, bpe_coding, chat, classify, decontaminate, fingerprints, lm_score, minhash_dedup, nbsvm, ngram_trie, queries, shingles, suffix_dedup, suffixes, token_counts
from fieldglass.llm.common import chunks, shared_dir
from tests.oracle import agree

PATH = queries.tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls in every column, an empty and a blank text, a long text, repeated rows and ids, near copies, clashing names."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 7))) for _ in range(200)]
    base = [rnd.choice(words) for _ in range(120)]
    near = base.copy()
    near[60] = "CHANGED"
    long = " ".join(rnd.choice(words) for _ in range(6000))
    rows = [(0, " ".join(base)), (1, " ".join(near)), (2, " ".join(base)), (3, None), (4, ""), (5, " \n\t "), (6, "one Two"), (6, "one Two"), (None, "a null id text"), (None, None), (7, long), (8, long[:9000] + " other end"), (9, "é漢字😀 <|endoftext|> it's  x"), (10, "ONE two"), (11, "x" * 1000)]
    return spark.createDataFrame([(i, t, "z", "q", 1.5, "s") for i, t in rows], "doc_id long, text string, ids string, node string, score double, __extra string")


@pytest.fixture(scope="module")
def empty(edge):
    return edge.limit(0)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# 2 and 10


def test_bpe_equals_the_library_on_random_texts():
    from tokenizers import Tokenizer

    lib, own, rnd = Tokenizer.from_file(PATH), bpe.RankedBpe(open(PATH, "rb").read()), random.Random(1)
    texts = ["", "a", "ab" * 1500, "<|endoftext|>", "՘Ⱟ \U000323b0 x"]
    texts += ["".join(rnd.choice("aabbe  \n\t'stred09é漢字😀\x85\x1c_-ß½<|endoftext|>") for _ in range(rnd.choice([3, 20, 80]))) for _ in range(800)]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and own.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    assert own.count_each(texts).tolist() == [len(own.encode(t)) for t in texts]
    assert own.decode([220, 10**7, -3]) == " "


def test_bpe_query_on_odd_rows(edge, empty):
    coded = bpe_coding.encode(edge, PATH)
    assert dict(coded.dtypes)["ids"] == "array<int>" and coded.columns.count("ids") == 1 and "__extra" in coded.columns
    back = bpe_coding.decode(coded, PATH)
    assert all(r.decoded == (r.text or "") for r in back.collect()) and back.count() == edge.count()
    assert bpe_coding.decode(bpe_coding.encode(empty, PATH), PATH).collect() == []
    assert "<|endoftext|>" not in {r.decoded for r in bpe_coding.decode(coded.filter("doc_id = 9"), PATH, special=False).collect()}.pop()


def test_token_counts_encode_misses_once(spark, edge, empty):
    cache = token_counts.DigestCache(spark, f"{shared_dir(spark)}/cache-test")
    own = bpe.RankedBpe(open(PATH, "rb").read())
    got = token_counts.count_tokens(edge, PATH, cache)
    assert got.count() == edge.count()
    assert all(r.n_tokens == len(own.encode(r.text or "")) and r.n_bytes == len((r.text or "").encode()) for r in got.collect())
    stored = spark.read.parquet(cache.path)
    n = edge.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert stored.count() == n == stored.select("digest").distinct().count()
    more = edge.select("doc_id", "text").union(spark.sql("select 99L, 'fresh text'"))
    assert token_counts.count_tokens(more, PATH, cache).count() == more.count()
    assert spark.read.parquet(cache.path).count() == n + 1
    assert token_counts.count_tokens(empty, PATH, cache).collect() == []
    piece = queries.tokenizer_path("piece_bpe_32k.model")
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=piece)
    assert all(r.n_tokens == len(lib.encode(r.text or "")) for r in token_counts.count_tokens(edge, piece, cache).collect())
    word = queries.tokenizer_path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(word)
    assert all(r.n_tokens == len(lib.encode(r.text or "", add_special_tokens=False).ids) for r in token_counts.count_tokens(edge, word, cache).collect())


# 3


def _components(rows):
    sets = [(i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := shingles.words(t or "")) else frozenset()) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(s), least.get(find(k)) if s else i) for k, (i, s) in enumerate(sets)]


def test_near_duplicates_equal_brute_force(spark, sf, edge, empty):
    for df in (spark.read.parquet(f"{sf}/documents.parquet"), edge):
        want = sorted(((i, n, c, i == c) for i, n, c in _components([(r.doc_id, r.text) for r in df.collect()])), key=repr)
        assert rows_of(minhash_dedup.linked(df)) == want
    assert minhash_dedup.linked(empty).collect() == []


def test_a_large_group_of_near_copies_is_linked_exactly(spark):
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(160):
        t = base.copy()
        for _ in range(rnd.randint(0, 8)):
            t[rnd.randrange(len(t))] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    few = minhash_dedup.FEW
    try:
        minhash_dedup.FEW = 1  # all open buckets go through the prefix filter
        got = minhash_dedup.linked(spark.createDataFrame(rows, "doc_id long, text string"))
        assert rows_of(got) == sorted(((i, n, c, i == c) for i, n, c in _components(rows)), key=repr)
    finally:
        minhash_dedup.FEW = few


def test_sketch_estimates_resemblance():
    rnd = np.random.default_rng(0)
    pool = rnd.integers(0, 2**63, 3000).astype(np.uint64)
    for n, shared in ((5, 4), (40, 30), (1000, 600)):
        a, b = pool[:n], np.concatenate([pool[:shared], pool[-(n - shared) :]])
        same = (shingles.sketch(a) == shingles.sketch(b)).mean()
        assert abs(same - shared / (2 * n - shared)) < 0.2
        assert (shingles.sketch(a) > 0).all()


# 7


def _repeats(rows, width, keep):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen, count = {}, Counter()
    for i, b in sorted(texts, key=lambda x: (x[0] is None, x[0] or 0)):
        for k in range(len(b) - width + 1):
            count[b[k : k + width]] += 1
            seen.setdefault(b[k : k + width], (i, k))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - width + 1):
            w = b[k : k + width]
            if (seen[w] != (i, k)) if keep else count[w] > 1:
                gone[k : k + width] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + (len(gone) > 0 and gone[0]))
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("divide", [1000, 2, 1])  # whole contexts, then pieces too, then single windows too
@pytest.mark.parametrize("keep", [False, True])
def test_repeats_equal_brute_force(spark, edge, divide, keep, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "DIVIDE", divide)
    df = edge.filter("doc_id IS NULL OR doc_id != 6") if keep else edge
    got = suffix_dedup.remove_repeats(df, keep_first=keep).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert rows_of(got) == _repeats([(r.doc_id, r.text) for r in df.collect()], 400, keep)


def test_repeats_in_documents_and_empty_tables(spark, sf, empty):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = suffix_dedup.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert rows_of(got) == _repeats([tuple(r) for r in df.collect()], 400, False)
    assert suffix_dedup.remove_repeats(empty).collect() == []


def test_prefix_ranks_order_suffixes():
    data = np.frombuffer(b"abracadabra" * 5 + b"bra", np.uint8)
    for width in (8, 16, 20):
        rank = suffixes.prefix_ranks(data, width)[-1][1]
        keys = [bytes(data[i : i + width]).ljust(width, b"\0") for i in range(len(data))]
        assert all((rank[i] < rank[j]) == (keys[i] < keys[j]) for i in range(len(data)) for j in range(0, len(data), 3))


def test_previous_and_next_factors_equal_brute_force():
    rnd = np.random.default_rng(3)
    for width in (8, 12, 16):
        for n in (17, 60, 200):
            data = np.tile(rnd.integers(0, 2, n).astype(np.uint8), 2)
            text, starts = data.tobytes(), np.sort(rnd.choice(len(data) - width + 1, n, replace=False))
            common = lambda i, j: next((k for k in range(width) if text[i + k] != text[j + k]), width)
            before, after = suffixes.previous_factors(data, starts, width)
            for x, i in enumerate(starts.tolist()):
                for got, others in ((before[x], starts[:x]), (after[x], starts[x + 1 :])):
                    want = max((common(i, j) for j in others.tolist()), default=0)
                    assert got == (width if want == width else want // 8 * 8)
    values = rnd.permutation(500)
    assert suffixes.previous_smaller(values).tolist() == [max((j for j in range(i) if values[j] < values[i]), default=-1) for i in range(500)]


def test_repeats_pass_columns_through_whatever_their_names(spark):
    df = spark.createDataFrame([(1, "ab" * 300, "x", 5), (2, None, None, None)], "doc_id long, text string, __text string, n_bytes long").withColumn("__DIGEST", F.lit(b"k")).withColumn("__all", F.lit(True))
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(df).collect()}
    assert (got[1].n_bytes, got[1].n_removed, got[1]["__text"], got[1]["__all"]) == (600, 600, "x", True)
    assert (got[2].n_bytes, got[2].n_removed, got[2].kept) == (0, 0, b"")


def test_every_window_has_an_anchor_of_its_own_content():
    rnd = np.random.default_rng(1)
    data = rnd.integers(97, 100, 3000).astype(np.uint8)
    h, place, first, last = suffixes.anchors(data, 400)
    assert first[0] == 0 and last[-1] == len(data) - 400 and (first[1:] == last[:-1] + 1).all()
    assert (place >= last).all() and (place + suffixes.GRAM <= first + 400).all()


# 5 and 6


def test_classifiers_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    for name, k, least in (("op5_quality", 0, 0.97), ("op6_toxicity", 1, 0.95)):
        rows = queries.QUERIES[name](spark, d).collect()
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= (0.3, 0.5)[k]) for r in rows)
        held = [(labels[r.doc_id][k], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
        assert sum(a == b for a, b in held) / len(held) > least


def test_weights_are_those_of_the_descent():
    rnd = np.random.default_rng(4)
    labels = np.where(rnd.random(60) < 0.5, 1, -1)
    rows = [np.unique(rnd.integers(0, 500, 30) + (y > 0) * 200).astype(np.int32) for y in labels]
    ratio = nbsvm.ratios(rows, labels)
    w, b = nbsvm.dual_descent(rows, labels, ratio, 1.0)
    model = nbsvm.fit(rows, labels, 0.5)
    assert (model.weights == (w * ratio).astype(np.float32)).all() and model.bias == b
    assert "beta" not in inspect.signature(nbsvm.fit).parameters  # no step that never runs


def test_classifier_edge_cases(spark, edge, empty):
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, None), (2, 0, 1), (2, 1, 1), (None, 0, 1), (777, 0, 0)], "doc_id long, quality int, toxic int")
    for label, features in (("quality", nbsvm.word_features), ("toxic", nbsvm.char_features)):
        out = classify.classified(edge, labels, label, features, 0.5)
        assert out.count() == edge.count() and out.columns.count("score") == 1 and "__extra" in out.columns
        assert all(0 <= r.score <= 1 for r in out.collect())
        none = classify.classified(edge, labels.limit(0), label, features, 0.5).collect()
        assert {round(r.score, 6) for r in none} == {0.5}
        assert classify.classified(empty, labels, label, features, 0.5).collect() == []


# 4


def test_block_max_wand_finds_all_above_the_threshold(spark, sf):
    index = bm25.ItemIndex(dict(spark.read.parquet(f"{sf}/benchmark.parquet").collect()))
    rnd = random.Random(0)
    for _ in range(100):
        picked = rnd.sample(range(len(index.ids)), 3)
        terms = sorted({t for i in picked for t in rnd.sample([v for v in range(len(index.items)) if i in index.items[v]], 6)})
        scores = defaultdict(float)
        for t in terms:
            for i, v in zip(index.items[t], index.impacts[t], strict=True):
                scores[i] += v
        for least in (0.1, 0.25, 0.5):
            assert dict(index.search(terms, least)) == pytest.approx({i: s for i, s in scores.items() if s >= least})


def test_leaks_are_found_and_clean_texts_left(spark, sf, edge, empty, monkeypatch):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = dict(items.collect())
    want = {(r.doc_id, i) for r in docs.collect() for i, t in texts.items() if t in (r.text or "")}
    planted = docs.union(spark.createDataFrame([(10**6 + i, "Some words before it " * 9 + t.upper() + " and after" * 30) for i, t in texts.items()], "doc_id long, text string"))
    want |= {(10**6 + i, i) for i in texts}
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(planted, items).collect()}
    assert got == want
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 3000)
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(planted, items).collect()} == want
    assert {r.doc_id for r in decontaminate.clean(planted, items).collect()} == {r.doc_id for r in planted.collect()} - {d for d, _ in want}
    assert decontaminate.matches(edge, items).collect() == [] and decontaminate.clean(edge, items).count() == edge.count()
    odd = spark.createDataFrame([(None, "x y"), (1, None), (2, " ")], "item_id long, text string")
    assert decontaminate.matches(edge, odd).collect() == [] and decontaminate.matches(edge, odd.limit(0)).collect() == []
    assert decontaminate.matches(empty, items).collect() == [] and decontaminate.clean(empty, items).collect() == []


@pytest.mark.parametrize("size", [200, 600, 1000, 3000])
def test_long_items_are_found(spark, sf, size):
    rnd = random.Random(size)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(3, 8))) for _ in range(4000)]
    common = words[:60]
    prose = lambda n: " ".join(rnd.choice(common if rnd.random() < 0.4 else words) for _ in range(n))
    long = {10**6 + i: prose(size - 20) + ". " + prose(20) + "." for i in range(3)}
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    short = items.orderBy("item_id").first()
    held = [(i, prose(700) + " " + t + " " + prose(900)) for i, t in long.items()] + [(1, prose(300) + " " + short.text + " " + prose(300))]
    others = [(2, prose(2500)), (3, " ".join(t[: len(t) // 5] for t in long.values())), (4, " ".join(sorted(long[10**6].split())))]
    docs = spark.createDataFrame(held + others, "doc_id long, text string")
    items = items.union(spark.createDataFrame(list(long.items()), items.schema))
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, items).collect()} == {(i, i) for i in long} | {(1, short.item_id)}
    assert {r.doc_id for r in decontaminate.clean(docs, items).collect()} == {2, 3, 4}


def test_a_copy_behind_a_shuffled_one_is_found(spark):
    rnd = random.Random(3)
    item = [f"q{i}" for i in range(40)]
    text, mixed, filler = " ".join(item), " ".join(rnd.sample(item, 40)), " other" * 600
    docs = spark.createDataFrame([(1, mixed + filler + " " + text), (2, mixed + filler), (3, text + filler + " " + mixed)], "doc_id long, text string")
    items = spark.createDataFrame([(5, text), (6, "quite another item")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, items).collect()} == {(1, 5), (3, 5)}
    assert [r.doc_id for r in decontaminate.clean(docs, items).collect()] == [2]


def test_items_without_an_id_or_with_a_shared_one_are_found(spark, monkeypatch):
    texts = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcd"]
    items = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (None, None)], "item_id long, text string")
    docs = spark.createDataFrame([(k, "before it " + t + " after it") for k, t in enumerate([*texts, "nothing"])], "doc_id long, text string")
    for size in (decontaminate.SHARD_BYTES, 150):
        monkeypatch.setattr(decontaminate, "SHARD_BYTES", size)
        assert rows_of(decontaminate.matches(docs, items).select("doc_id", "item_id")) == [(0, 1), (1, 1), (2, None), (3, None)]
        assert [r.doc_id for r in decontaminate.clean(docs, items).collect()] == [4]


# 8


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_agree_with_sql(spark, sf, name):
    assert agree(queries.QUERIES[name](spark, sf), queries.ORACLES[name], sf)


def test_chat_round_trip_of_hostile_texts(spark):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(["\\", "<", "#", ":", "/turn>", "\n", "### ", "</turn>\n", "<|image 1|>", "é", "b", "h", "l", " "]) for _ in range(12)) for _ in range(200)] + [None, ""]
    rows = [(i // 4, i % 4, rnd.choice(["user", "assistant", "ro:le#<", None]), t) for i, t in enumerate(texts)]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    back = {r.conv_id: r for r in chat.read_back(made).collect()}
    for c in {r[0] for r in rows}:
        own = [(r[2] or "", r[3] or "") for r in rows if r[0] == c]
        assert [(t.role, t.text) for t in back[c].turns] == own
        assert back[c].loss_text == "".join(t for r, t in own if r == "assistant")


def test_typed_parts_become_placeholders(spark):
    parts = '[{"type":"text","text":"see <1>"},{"type":"image","ref":"a.png","width":28,"height":15},{"type":"document","ref":"d.pdf","pages":2,"parts":["in it",{"type":"audio","ref":"s.wav","seconds":1.5}]},{"type":"video","ref":"v"}]'
    df = spark.createDataFrame([(1, 0, "assistant", parts, 5)], "conv_id int, turn int, role string, text string, extra int")
    r = chat.format_conversations(df, typed=True).first()
    assert r.formatted == "### assistant: see \\l1><|image 1|><|document 2|>in it<|audio 3|><|video 4|></turn>\n"
    assert [(a.ordinal, a.kind, a.reference, a.tokens) for a in r.attachments] == [(1, "image", "a.png", 4), (2, "document", "d.pdf", 512), (3, "audio", "s.wav", 38), (4, "video", "v", 0)]
    assert r.expanded_tokens == 554 and [r.formatted[s.start : s.end] for s in r.loss_spans] == ["see \\l1>", "in it"]
    assert chat.format_conversations(df.limit(0)).collect() == []
    odd = spark.createDataFrame([(1, 0, "user", "not json"), (1, 1, "user", '{"a":1}'), (1, 2, "user", '[5,{"type":"image","width":"wide","height":2},{"type":["x"]},{"text":3,"type":"text"},{"type":"document","parts":7,"ref":9},null]'), (1, 3, "assistant", "x" * 3_000_000)], "conv_id int, turn int, role string, text string")
    r = chat.format_conversations(odd.withColumn("formatted", F.lit("clash")).withColumn("turns", F.lit(1)), typed=True).first()
    assert r.formatted.startswith("### user: not json</turn>\n### user: {\"a\":1}</turn>\n### user: 5<|image 1|><|") and r.expanded_tokens == 0 and r.attachments[2].reference == "9"
    assert [(s.end - s.start) for s in r.loss_spans] == [3_000_000]
    nulls = spark.createDataFrame([(None, None, None, None), (None, 1, "user", "x")], "conv_id int, turn int, role string, text string")
    assert chat.format_conversations(nulls).first().formatted == "### : </turn>\n### user: x</turn>\n"


# 9


def test_scores_equal_a_plain_model(spark, sf, edge, empty):
    for df in (spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), edge):
        docs = [(r.doc_id, shingles.words(r.text or "") + [b"\n"]) for r in df.collect()]
        train = [w for i, w in docs if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
        c, pairs = Counter(w for ws in train for w in ws), Counter(p for ws in train for p in zip([b"\n"] + ws[:-1], ws))
        n, v = sum(c.values()), len(c)
        n1, n2 = (sum(x == k for x in c.values()) for k in (1, 2))
        discount = min(max(n1 / max(1, n1 + 2 * n2), 0.1), 0.95)
        p = lambda w: (c[w] - discount) / n if c[w] else discount * v / n
        want = defaultdict(list)
        for i, ws in docs:
            s = sum(math.log10((pairs[a, w] + 20 * p(w)) / (c[a] + 20)) for a, w in zip([b"\n"] + ws[:-1], ws))
            want[i].append((len(ws), sum(c[w] > 0 for w in ws), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), s))
        got = lm_score.score(df).collect()
        assert len(got) == len(docs)
        for r in got:
            assert r.train_tokens == n
            assert any((r.n_tokens, r.n_known) == w[:2] and r.base_score == pytest.approx(w[2]) and abs(r.score - w[3]) <= 0.021 * w[0] for w in want[r.doc_id])
    assert lm_score.score(empty).collect() == []


def test_pairs_of_words_seen_once_are_learnt(spark):
    train = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    texts = [(train[0], "rare once odd"), (train[1], "rare twice"), (train[2], "twice odd one"), (held, "rare once odd"), (held + 1000, "odd odd once")]
    docs = [(i, shingles.words(t) + [b"\n"]) for i, t in texts]
    learnt = [ws for i, ws in docs if zlib.crc32(str(i).encode()) % 7 != 2]
    c, pairs = Counter(w for ws in learnt for w in ws), Counter(p for ws in learnt for p in zip([b"\n"] + ws[:-1], ws))
    n, v = sum(c.values()), len(c)
    n1, n2 = (sum(x == k for x in c.values()) for k in (1, 2))
    discount = min(max(n1 / max(1, n1 + 2 * n2), 0.1), 0.95)
    p = lambda w: (c[w] - discount) / n if c[w] else discount * v / n
    want = {i: sum(math.log10((pairs[a, w] + 20 * p(w)) / (c[a] + 20)) for a, w in zip([b"\n"] + ws[:-1], ws)) for i, ws in docs}
    assert any(c[a] == 1 for a, _ in pairs) and any(c[w] == 1 for _, w in pairs)
    for parts in (1, 5):  # one batch, and pairs seen in another batch only
        got = {r.doc_id: r for r in lm_score.score(spark.createDataFrame(texts, "doc_id long, text string").repartition(parts)).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[i].score - want[i]) <= 0.021 * got[i].n_tokens for i in want)


@pytest.mark.parametrize("top", [50, 1 << 31])
def test_trie_finds_exactly_its_pairs(top):
    rnd = np.random.default_rng(0)
    pairs = np.unique(np.stack([rnd.integers(0, top, 300)[rnd.integers(0, 300, 4000)], rnd.integers(0, top, 4000)]), axis=1)
    codes = rnd.integers(1, 256, pairs.shape[1]).astype(np.uint8)
    trie = ngram_trie.Trie.mapped(ngram_trie.Trie.build(*pairs, codes).to_bytes())
    assert (trie.search(*pairs) == codes).all()
    there = {(a, b): c for a, b, c in zip(*pairs.tolist(), codes.tolist())}
    asked = np.concatenate([pairs[:, rnd.permutation(pairs.shape[1])] + [[0], [1]], pairs + [[1], [0]], rnd.integers(0, 2 * top, (2, 3000))], axis=1)
    assert trie.search(*asked).tolist() == [there.get((a, b), 0) for a, b in zip(*asked.tolist())]
    none = ngram_trie.Trie.mapped(ngram_trie.Trie.build(pairs[0, :0], pairs[1, :0], codes[:0]).to_bytes())
    assert not none.search(*asked).any()


def test_sequences_and_words_are_found():
    rnd = np.random.default_rng(0)
    for universe in (10**6, 1 << 63):
        values = np.sort(rnd.integers(0, universe, 1000).astype(np.uint64))
        ef = ngram_trie.EliasFano.build(values, universe)
        assert (ef.get(np.arange(1000)) == values).all()
        x = np.concatenate([values, rnd.integers(0, universe, 2000).astype(np.uint64)])
        at, found = ef.find(x)
        assert (at == np.searchsorted(values, x)).all() and (found == np.isin(x, values)).all()
    words = np.unique(rnd.integers(0, 1 << 59, 500).astype(np.uint64))
    level = ngram_trie.Words.mapped(ngram_trie.Words.build(words, np.arange(1, len(words) + 1), 1 << 59).to_bytes())
    number, count = level.search(np.append(words, words[:5] + np.uint64(1)))
    assert number.tolist() == [*range(len(words)), *[-1] * 5] and count.tolist() == [*range(1, len(words) + 1), *[0] * 5]


def test_a_frequent_context_is_dealt_over_shards(spark, monkeypatch):
    texts = [(i, " ".join(f"the w{i}x{j % 7}" for j in range(40))) for i in range(30)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    plain = rows_of(lm_score.score(df))
    monkeypatch.setattr(lm_score, "SHARD_TOKENS", 200)
    assert rows_of(lm_score.score(df)) == plain


# 1


def test_fingerprints(spark, edge, empty):
    rows = fingerprints.with_edit(fingerprints.with_next(edge)).collect()
    given = sorted(((r.doc_id, r.text or "") for r in edge.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert len(rows) == len(given) and Counter((r.doc_id, r.text) for r in rows) == Counter(given)
    unique = [i for i, n in Counter(i for i, _ in given).items() if n == 1]
    at = {i: k for k, (i, _) in enumerate(given)}
    for r in rows:
        if r.doc_id in unique:
            following = given[(at[r.doc_id] + 1) % len(given)]
            cut = len(r.text) // 4
            if Counter(i for i, _ in given)[following[0]] == 1 or len({t for i, t in given if i == following[0]}) == 1:
                assert r.next_text == following[1] and r.edited == r.text[: len(r.text) - cut] + following[1][:cut]
    by = {r.doc_id: r.sketch for r in rows}
    assert by[0] == by[2] and by[3] == by[4] == by[5] == [] and by[6] != by[10][:0] and len(by[7]) == fingerprints.K
    assert fingerprints.with_next(empty).collect() == []


def test_sketches_equal_plain_hashing(spark, sf):
    def plain(text):
        words = [w for w in re.split("[ \t-\r]+", text.lower()) if w]
        found = set()
        for i in range(max(1, len(words) - 4) if words else 0):
            h = 42
            for w in words[i : i + 5]:
                h = xxhash.xxh64_intdigest(w.encode(), h)
            found.add(h - (1 << 64) if h >> 63 else h)
        return sorted(found)[:128]

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(texts)
    near = lambda a, b: (lambda union: 1.0 if not a and not b else 0.0 if not a or not b else len(set(union) & set(a) & set(b)) / len(union))(sorted({*a, *b})[:128])
    got = queries.QUERIES["op1_fingerprints"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == ids
    for r in got:
        text, following = texts[r.doc_id], texts[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        own, other, after = plain(text), plain(edited), plain(following)
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == ",".join(f"{h & (2**64 - 1):X}" for h in own) and r.edited_fingerprint == ",".join(f"{h & (2**64 - 1):X}" for h in other)
        assert r.near_edited == pytest.approx(near(own, other)) and r.near_next == pytest.approx(near(own, after))


def test_registered_queries_equal_the_library_and_brute_force(spark, sf):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = {i: lib.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    coded = {tuple(r) for r in queries.QUERIES["op2_bpe_coding"](spark, sf).collect()}
    assert coded == {(i, len(k), digest(",".join(map(str, k))), digest(lib.decode(k, skip_special_tokens=False))) for i, k in ids.items()}
    assert {tuple(r) for r in queries.QUERIES["op10_token_counts"](spark, sf).collect()} == {(i, len(t.encode()), len(ids[i]), len(ids[i]) > 512) for i, t in texts.items()}
    removed = queries.QUERIES["op7_suffix_dedup"](spark, sf)
    assert removed.filter("removed != (n_removed > 0)").isEmpty() and rows_of(removed.drop("removed")) == _repeats(list(texts.items()), 400, False)
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    found = {(r.doc_id, r.item_id) for r in queries.QUERIES["op4_decontaminate"](spark, sf).collect()}
    assert {(i, b.item_id) for i, t in texts.items() for b in items if b.text in t} <= found and found


def test_weights_equal_a_plain_model():
    rnd = np.random.default_rng(2)
    rows = [np.unique(rnd.integers(0, 64, 6)).astype(np.int32) for _ in range(60)]
    labels = np.where([5 in r or 9 in r for r in rows], 1, -1)
    r = nbsvm.ratios(rows, labels, 6)
    n1, n0 = (labels > 0).sum(), (labels < 0).sum()
    for b in range(64):
        p, q = (sum(b in x for x, y in zip(rows, labels) if y == s) for s in (1, -1))
        assert r[b] == pytest.approx(math.log(((p + 20 * n1 / 60) / n1) / ((q + 20 * n0 / 60) / n0)))
    w, b = nbsvm.dual_descent(rows, labels, r, 1.0, epochs=400)
    x = np.zeros((60, 65))
    for i, row in enumerate(rows):
        x[i, row], x[i, 64] = r.astype(np.float32)[row] / nbsvm.norm(r.astype(np.float32)[row]), 1.0
    cost = np.where(labels > 0, 30 / n1, 30 / n0)
    plain, best = np.zeros(65), None
    loss = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - labels * (x @ v))).sum()
    for k in range(1, 40_001):  # subgradient descent on the primal
        plain -= (plain - ((cost * labels * (labels * (x @ plain) < 1)) @ x)) / (k + 50)
        if k % 200 == 0:
            best = min(loss(plain), best or loss(plain))
    assert loss(np.append(w, b)) <= best * 1.005


def test_one_document_follows_itself(spark):
    r = fingerprints.with_edit(fingerprints.with_next(spark.sql("select 5L as doc_id, 'abcdefgh' as text"))).first()
    assert r.next_text == "abcdefgh" and r.edited == "abcdefab"


def test_many_documents_in_runs(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RUN", 7)
    monkeypatch.setattr(fingerprints, "RUNS", 5)
    ids = random.Random(4).sample(range(10**9), 500)
    got = {r.doc_id: r.next_text for r in fingerprints.with_next(spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")).collect()}
    order = sorted(ids)
    assert got == {i: f"t{j}" for i, j in zip(order, order[1:] + order[:1])}


def test_sketches_merge_and_estimate(spark):
    df = spark.createDataFrame([(g, " ".join(f"w{j}" for j in range(s, s + 700))) for g, s in ((1, 0), (1, 500), (2, 350))], "g int, text string")
    sk = fingerprints.with_fingerprint(df, "text", "sketch")
    whole = fingerprints.with_fingerprint(spark.createDataFrame([(" ".join(f"w{j}" for j in range(1200)),)], "text string"), "text", "s").first().s
    by = {r.g: r.sketch for r in fingerprints.merged_by(sk, "g", "sketch").collect()}
    assert by[1] == whole
    a, b = (r.sketch for r in sk.orderBy("text").limit(2).collect())
    pair = spark.createDataFrame([(a, b)], "a array<long>, b array<long>")
    r = pair.select(fingerprints.resemblance(F.col("a"), F.col("b")).alias("j"), fingerprints.containment(F.col("a"), F.col("b")).alias("c"), fingerprints.distinct_shingles(F.col("a")).alias("n")).first()
    assert abs(r.j - 196 / 1196) < 0.12 and abs(r.c - 196 / 696) < 0.15 and 450 < r.n < 1000


def test_chunks_bound_the_text():
    import pyarrow as pa

    b = pa.RecordBatch.from_arrays([pa.array(["a" * 10] * 7 + ["b" * 100, None, "c"])], names=["text"])
    parts = list(chunks([b, b.slice(0, 0)], limit=25))
    assert sum(p.num_rows for p in parts) == 10 and all(sum(len(x or "") for x in p.column(0).to_pylist()) <= 25 or p.num_rows == 1 for p in parts)


def test_no_pair_of_classes_is_tried_twice(spark, monkeypatch):
    """Near texts under the threshold share buckets in every round; before, their pairs were tried in each of them."""
    words = [f"w{i}" for i in range(200)]
    rows = [(g * 10 + k, " ".join(f"{w}g{g}" for w in [*words[: 150 + 2 * k], *(f"x{k}y{i}" for i in range(40))])) for g in range(6) for k in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tried, plain = [], minhash_dedup._Links.likely
    monkeypatch.setattr(minhash_dedup._Links, "likely", lambda self, pairs: (tried.extend(tuple(r) for r in pairs.select("a", "b").collect()), plain(self, pairs))[1])
    got = {r.doc_id: r.component_id for r in minhash_dedup.linked(df).collect()}
    sets = {i: set(zip(*(t.split()[k:] for k in range(5)))) for i, t in rows}
    root = {i: i for i in sets}
    for a, b in sorted((a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])):
        low, high = sorted((root[a], root[b]))
        root = {i: low if r == high else r for i, r in root.items()}
    assert got == root and tried and len(tried) == len(set(tried))


def test_counting_buckets_holds_a_part_of_the_rows_at_once():
    """the fit's counts held all features three times in the driver, as one array and as 64-bit numbers."""
    import tracemalloc

    rnd = np.random.default_rng(5)
    rows = [np.sort(rnd.choice(1 << 18, 10_000, replace=False)).astype(np.int32) for _ in range(300)]
    labels = np.array([1 if i % 3 else -1 for i in range(300)])
    tracemalloc.start()
    got = nbsvm.ratios(rows, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    pos, neg = (np.bincount(np.concatenate([r for r, y in zip(rows, labels, strict=True) if y == s]), minlength=1 << 18) for s in (1, -1))
    share = 20.0 * np.array([200, 100]) / 300
    assert (got == np.log(((pos + share[0]) / 200) / ((neg + share[1]) / 100))).all()
    assert peak < 4 * 10_000 * 400  # before, 24 MB for the larger class alone


def test_pairs_of_classes_that_differ_too_much_in_size_are_never_made(spark):
    """such pairs were joined with their sketches before their sizes were looked at."""
    rows = spark.createDataFrame([("x", 1, 1, 100, 1), ("x", 2, 1, 60, 1), ("x", 3, 3, 76, 1), ("x", 4, 4, 75, 1), ("x", 5, 5, 40, 1)], "bucket string, node long, component long, n long, main long")
    assert sorted(tuple(r) for r in minhash_dedup._across(rows, "bucket", 75).collect()) == [(1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]
