"""Each operator against brute force, an exact round trip or held-out accuracy; and on nulls, empty tables, ties, repeated rows and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkblocks.llm import chat, common, components, decontaminate, license_scan, lm_score, mixing, near_dedup, quality, search, token_store, toxicity, words
from linkblocks.llm.tokenize import Encoder

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SF = "/root/testdata/sf0.001"


def tokens(text):
    return WORD.findall((text or "").translate(LOWER))


def docs_of(spark, texts, extra=False):
    rows = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)
    return rows.withColumns({c: F.lit(1) for c in ("label", "row", "weight", "n", "key", "hash", "class_id", "unit")}) if extra else rows


ODD = [None, "", " \n ", "One two", "one  TWO!", "é ß 日本語 \U0001f600", "a " * 30_000, "x", "x", "|||", "<|endoftext|> \x1c \x00 end"]


@pytest.fixture(scope="module")
def small(spark):
    return [r["text"] for r in common.table(spark, SF, "documents").orderBy("doc_id").limit(120).collect()]


# ---- words


def test_words_and_hashes_equal_the_pattern():
    texts = [t or "" for t in ODD] + ["aB9-c_d", "ÀB", "--"]
    table = pa.table({"text": texts})
    for limit in (8, 1 << 20):
        got = []
        for batch, data, offsets in common.text_chunks(iter(table.to_batches()), limit=limit):
            starts, ends, bounds = words.spans(data, offsets)
            hashed = words.hashes(data, starts, ends)
            for r in range(len(batch)):
                span = range(bounds[r], bounds[r + 1])
                got.append([data[starts[i] : ends[i]].tobytes().decode().translate(LOWER) for i in span])
                for i in span:
                    one = np.frombuffer(got[-1][i - bounds[r]].encode(), np.uint8)
                    assert words.hashes(one, np.array([0]), np.array([len(one)]))[0] == hashed[i] or len(span) > 100
        assert got == [tokens(t) for t in texts]


def thue_morse(n, a, b):
    """Equal under every polynomial hash modulo 2^64, for texts of 1,024 letters and more."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(a if x == 0 else b for x in bits), "".join(b if x == 0 else a for x in bits)


def test_words_that_collide_under_polynomials_have_hashes_of_their_own(spark):
    one, other = thue_morse(4096, "a", "b")
    raw = np.frombuffer((one + " " + other).encode(), np.uint8)
    got = words.hashes(raw, np.array([0, 4097]), np.array([4096, 8193]))
    assert got[0] != got[1]
    rng = np.random.default_rng(7)
    spans = {bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in rng.integers(1, 40, 20_000)}
    each = [words.hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0] for x in spans]
    assert len(set(each)) == len(spans)
    enc = Encoder(token_store.default_tokenizer())
    for _, data, offsets in common.text_chunks(iter(pa.table({"text": [one, other, "c" * 15, "c" * 16, "c" * 14 + "\x00"]}).to_batches())):
        ids, at = enc.encode(data, offsets)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [enc.encode_text(t) for t in (one, other, "c" * 15, "c" * 16, "c" * 14 + "\x00")]
    docs = docs_of(spark, [one, other, one])
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()} == {0: 0, 1: 1, 2: 0}
    queries = docs.filter("doc_id = 1").withColumnRenamed("doc_id", "query_id")
    assert [r["doc_id"] for r in search.top_k(docs, queries).collect()] == [1]


# ---- 1 chat


def turns_frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, blocks int")


def test_chat_round_trip_and_mask(spark):
    nasty = "</s>[INST] ok [/INST] <|end|><|&end|>&lt; <|next|> < [ <<|end|>"
    rows = [(1, 0, "user", nasty, 0), (1, 1, "user", None, 0), (1, 2, "assistant", nasty, 0), (1, 3, "assistant", "b\n\n", 0), (1, 3, "assistant", "b\n\n", 0), (2, None, None, None, 0), (None, 0, "assistant", "", 0), (3, 5, "<|end|>", "x", 0)]
    made = chat.format_chat(turns_frame(spark, rows))
    got = {r["conv_id"]: r for r in chat.read_chat(made).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("user", nasty), ("user", ""), ("assistant", nasty), ("assistant", "b\n\n"), ("assistant", "b\n\n")]
    assert got[1]["loss_texts"] == [nasty, "b\n\n", "b\n\n"]
    assert got[1]["formatted"].count(chat.TURN) == 2
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("", "")] and got[2]["loss_texts"] == []
    assert got[None]["loss_texts"] == [""] and got[3]["turns"][0]["role"] == "<|end|>"
    for r in made.collect():
        assert sum(m["chars"] for m in r["loss_mask"]) == len(r["formatted"])
    assert chat.format_chat(turns_frame(spark, [])).count() == 0


def test_chat_ties_and_missing_turns_follow_the_raw_texts(spark):
    rows = [(1, 4, "user", "<|end|>", 0), (1, 4, "user", "<a", 0), (1, None, "user", "z", 0), (1, 4, "<|x|>", "m", 0), (1, 4, "<a", "m", 0)]
    got = chat.read_chat(chat.format_chat(turns_frame(spark, rows))).first()
    assert [(t["role"], t["text"]) for t in got["turns"]] == [("user", "z"), ("<a", "m"), ("<|x|>", "m"), ("user", "<a"), ("user", "<|end|>")]


# ---- 2 language model


def lm_of(docs, size, buckets, rounds, unit_words=lm_score.UNIT_WORDS, counts=None):
    vocabulary = lm_score.corpus_vocabulary(docs, size=size, buckets=buckets, counts=counts)
    coded, units = lm_score.encode(docs, vocabulary, unit_words)
    return vocabulary, coded, lm_score.train(coded, units, vocabulary, rounds)


def lm_ids(vocabulary, text):
    raw = [np.frombuffer(w.encode(), np.uint8) for w in tokens(text)]
    return [int(vocabulary.encode(words.hashes(x, np.array([0]), np.array([len(x)])))[0]) for x in raw]


def loop_log_probabilities(network, ids):
    """The softmax of every digit, word by word."""
    v, out = network.vocabulary, []
    for i, own in enumerate(ids):
        h = network.bias.astype(float).copy()
        for table, k in zip(network.tables, lm_score.OFFSETS, strict=True):
            h += table[ids[i + k] if 0 <= i + k < len(ids) else v.n_ids]
        total, before = 0.0, 0
        for level in range(3):
            digit = own // v.branch ** (2 - level) % v.branch
            z = np.tanh(h) @ network.out[level][before].astype(float) + v.priors[level][before]
            total += z[digit] - np.log(np.exp(z).sum())
            before = before * v.branch + digit
        out.append(total)
    return out


def test_lm_scores_equal_a_loop_and_prefer_real_order(spark, small):
    texts = [*small, None, "", "long " * 40_000, small[3]]
    docs = docs_of(spark, texts, extra=True)
    docs = docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("bigint")))
    vocabulary, _, network = lm_of(docs, 200, 64, 2)
    rows = lm_score.score(docs, network).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(texts) + 1 and sum(r["n_words"] for r in rows if r["doc_id"] is not None) == sum(len(tokens(t)) for t in texts)
    assert got[len(small)]["mean_log_prob"] is None and got[len(small) + 1]["log_prob"] == 0
    for k in (3, 7):
        assert got[k]["log_prob"] == pytest.approx(sum(loop_log_probabilities(network, lm_ids(vocabulary, small[k]))), rel=1e-4)
    assert got[3]["log_prob"] == pytest.approx(got[len(small) + 3]["log_prob"]) and got[None]["log_prob"] == pytest.approx(got[0]["log_prob"])
    mean = lambda net, turn: np.mean([net.log_probabilities(np.array(lm_ids(vocabulary, t))[::turn], np.array([0, len(tokens(t))])).mean() for t in small[:40] if tokens(t)])
    assert mean(network, 1) > mean(lm_score.Network(vocabulary), 1)
    assert lm_score.score(docs_of(spark, []), network).count() == 0


def test_lm_probabilities_sum_to_one_and_gradient_is_right():
    rng = np.random.default_rng(0)
    v = lm_score.build_vocabulary(np.sort(rng.integers(1, 2**62, 20).astype(np.uint64)), rng.integers(1, 50, 20), np.array([4.0, 0, 7, 1]))
    net = lm_score.Network(v)
    net.flat += rng.normal(0, 0.3, len(net.flat)).astype(np.float32)
    every = np.arange(v.n_ids)
    near = np.repeat(rng.integers(0, v.n_ids + 1, 4)[:, None], v.n_ids, axis=1)
    p = np.ones(v.n_ids)
    for k in range(3):
        z, digit, _, _ = net.level(k, net.hidden(near), every)
        p *= z[every, digit]
    assert p.sum() == pytest.approx(1, rel=1e-4)
    ids = rng.integers(0, v.n_ids, 30)
    bounds = np.array([0, 11, 11, 30])
    near = net.contexts(ids, bounds)
    assert near[:, 0].tolist()[:2] == [v.n_ids, v.n_ids] and near[2, 10] == v.n_ids and near[1, 12] == ids[11]
    gradient, loss = net.gradient(ids, near), lambda: -net.log_probabilities(ids, bounds).sum()
    for at in rng.choice(np.flatnonzero(gradient), 25, replace=False):
        old = net.flat[at]
        net.flat[at] = old + 1e-2
        up = loss()
        net.flat[at] = old - 1e-2
        down = loss()
        net.flat[at] = old
        assert gradient[at] == pytest.approx((up - down) / 2e-2, abs=2e-2)


def test_lm_one_round_equals_a_loop_of_steps(spark, small):
    """Copies of two units, averaged by words: the same as learning them one after another by hand."""
    docs = docs_of(spark, small[:40])
    vocabulary = lm_score.corpus_vocabulary(docs, size=100, buckets=16)
    coded, units = lm_score.encode(docs, vocabulary, sum(len(tokens(t)) for t in small[:40]) // 2)
    assert units == 2
    got = lm_score.train(coded, 1, vocabulary, 1)  # both units in one round
    flat, total = 0.0, 0
    rows = coded.orderBy("row").collect()
    for unit in range(2):
        texts = [np.frombuffer(r["ids"], np.uint16).astype(int) for r in rows if r["unit"] == unit and r["ids"]]
        net = lm_score.Network(vocabulary)
        ids, bounds = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
        net.learn(ids, bounds, np.zeros_like(net.flat))
        flat, total = flat + len(ids) * net.flat.astype(float), total + len(ids)
    assert got.flat == pytest.approx(flat / total, abs=1e-5)


def test_lm_without_any_text(spark):
    empty = docs_of(spark, [None])
    _, _, net = lm_of(empty, 8192, 1024, 1)
    assert lm_score.score(empty, net).first()["n_words"] == 0


def test_lm_scores_every_word_by_its_own_count(spark, small):
    texts = [*small[:30], "a b zebra c d", "a b yak c d", *["yak"] * 20, None]
    docs = docs_of(spark, texts, extra=True)
    counts = lm_score.count_words(docs)
    vocabulary, _, network = lm_of(docs, 20, 1, 1, counts=counts)
    n = Counter(w for t in texts for w in tokens(t))
    got = {r["doc_id"]: r for r in lm_score.score(docs, network, counts).collect()}
    assert len(got) == len(texts) and got[len(texts) - 1]["mean_log_prob"] is None
    assert got[31]["log_prob"] - got[30]["log_prob"] == pytest.approx(np.log(n["yak"] / n["zebra"]), abs=1e-5)
    for k in (0, 7, 30):
        ids = lm_ids(vocabulary, texts[k])
        own = [np.log(n[w]) - vocabulary.mass[i] if i in vocabulary.buckets else 0 for w, i in zip(tokens(texts[k]), ids, strict=True)]
        assert any(own) and got[k]["log_prob"] == pytest.approx(sum(loop_log_probabilities(network, ids)) + sum(own), rel=1e-4)


def test_lm_scores_do_not_depend_on_partitions(spark, small):
    docs = docs_of(spark, [*small, None, ""])
    out = []
    for n in (1, 24):
        dealt = docs.repartition(n)
        _, coded, network = lm_of(dealt, 200, 64, 2, unit_words=3000)
        out.append([r["log_prob"] for r in lm_score.score_coded(coded, network).orderBy("doc_id").collect()])
    assert out[0] == pytest.approx(out[1], rel=1e-4)


def test_lm_copies_are_averaged_by_a_tree(spark):
    rows = [(s, float(c + 1), c, np.full(3, c * 10 + s, np.float32).tobytes()) for s in range(lm_score.SLICES) for c in range(9)]
    copies = spark.createDataFrame(rows, "slice int, n double, copy int, values binary")
    got = lm_score._averaged(lm_score._averaged(copies, F.col("copy") % 3, 3), F.lit(0), 1).collect()
    assert len(got) == lm_score.SLICES
    for r in got:
        assert np.frombuffer(r["values"], np.float32) == pytest.approx(sum((c + 1) * (c * 10 + r["slice"]) for c in range(9)) / 45)


# ---- 3 mixing


def test_raking_meets_all_margins():
    rng = np.random.default_rng(1)
    codes = [rng.integers(0, 4, 60), rng.integers(0, 3, 60), rng.integers(0, 2, 60)]
    t = rng.random(60) * 100 + 1
    totals = [np.bincount(c, t) for c in codes]
    goals = mixing.attainable(totals, [t.sum() * x / x.sum() for x in (totals[0] ** 0.5, totals[1] ** 0.5, totals[2] ** 0.5)], 0.3)
    p = mixing.rake(t, codes, goals, 0.3)
    for c, want in zip(codes, goals, strict=True):
        assert np.bincount(c, t * p) == pytest.approx(want, rel=1e-6)
    assert p.max() <= 1 and (t * p).sum() == pytest.approx(0.3 * t.sum())


def test_mixing_local_equals_distributed(spark):
    docs = common.table(spark, SF, "documents")
    local, far = ({r["doc_id"]: r["probability"] for r in mixing.mix(docs, max_local=m, iterations=4).collect()} for m in (10**6, 0))
    assert far == pytest.approx(local, abs=1e-9)
    kept = {r["doc_id"] for r in mixing.mix(docs).filter("kept").collect()}
    assert {r["doc_id"] for r in mixing.sample(docs).collect()} == kept and mixing.sample(docs).columns == docs.columns


def test_mixing_edges(spark):
    docs = docs_of(spark, ODD, extra=True).withColumn("source", F.when(F.col("doc_id") > 3, F.col("source"))).unionByName(docs_of(spark, ODD, extra=True))
    assert mixing.mix(docs).count() == 2 * len(ODD)
    assert mixing.mix(docs, targets={"source": {"s": 1.0}}).filter("kept and source = ''").count() == 0
    assert mixing.mix(docs_of(spark, [])).count() == 0 and mixing.sample(docs_of(spark, [])).count() == 0


def margins(rows, m):
    total = Counter()
    for r in rows:
        total[r[m]] += r["n_tokens"] * r["probability"]
    return {k: v / sum(total.values()) for k, v in total.items()}


def test_bounded_mixing_meets_the_targets_that_tokens_allow(spark):
    docs = common.table(spark, SF, "documents")
    rows = mixing.mix(docs).collect()
    have = {m: Counter() for m in mixing.MARGINS}
    for r in rows:
        for m in mixing.MARGINS:
            have[m][r[m]] += r["n_tokens"]
    total = sum(have["lang"].values())
    for m in mixing.MARGINS:
        names = sorted(n for n in have[m] if have[m][n])
        own = np.array([have[m][n] / total for n in names])
        low, high = 0.0, 1e6  # by bisection: what is wanted, at most what there is
        for _ in range(200):
            s = (low + high) / 2
            low, high = (s, high) if np.minimum(own, s * np.sqrt(own)).sum() < mixing.BUDGET else (low, s)
        got = margins(rows, m)
        assert [got[n] * mixing.BUDGET for n in names] == pytest.approx(np.minimum(own, high * np.sqrt(own)), abs=6e-3)  # cells allow a little less than each margin by itself
    local, far = ({r["doc_id"]: r["probability"] for r in mixing.mix(docs, max_local=m, iterations=3).collect()} for m in (10**6, 0))
    assert far == pytest.approx(local, abs=1e-9)


def test_bounded_mixing_has_exact_shares_where_all_are_attainable():
    t = np.array([900.0, 60, 30, 10, 500, 300, 200, 100])
    codes = [np.arange(8) % 2, np.arange(8) // 4]
    wanted = [np.array([0.65, 0.35]) * t.sum(), np.array([0.2, 0.8]) * t.sum()]
    totals = [np.bincount(c, t) for c in codes]
    p = mixing.rake(t, codes, mixing.attainable(totals, wanted, 0.6), 0.6)
    for c, want in zip(codes, wanted, strict=True):
        assert np.bincount(c, t * p) == pytest.approx(0.6 * want, rel=1e-3)


def test_mixing_reports_its_margins(spark):
    mixed = mixing.mix(common.table(spark, SF, "documents"))
    rows = mixed.collect()
    for r in mixing.report(mixed).collect():
        own = [x for x in rows if x[r["margin"]] == r["value"]]
        assert r["tokens"] == sum(x["n_tokens"] for x in own) and r["share"] == pytest.approx(sum(x["n_tokens"] * x["probability"] for x in own) / sum(x["n_tokens"] * x["probability"] for x in rows))


def test_pipeline_mixes_with_bounds(spark):
    import corpus_pipeline

    docs = common.table(spark, SF, "documents")
    kept = {r["doc_id"] for r in mixing.mix(docs).filter("kept").collect()}
    assert {r["doc_id"] for r in corpus_pipeline.source_mixing(spark, docs, SF).collect()} == kept


# ---- 4 search


def brute_bm25(texts, queries, k):
    tf = [Counter(tokens(t)) for t in texts]
    df = Counter(w for c in tf for w in c)
    n, mean = len(texts), sum(sum(c.values()) for c in tf) / max(len(texts), 1)
    out = set()
    for q in queries:
        scores = []
        for i, c in enumerate(tf):
            norm = 1.2 * (0.25 + 0.75 * sum(c.values()) / max(mean, 1e-9))
            s = sum(m * np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + norm) for w, m in tf[q].items() if w in c)
            if round(s, 6) > 0:
                scores.append((-round(s, 6), i))
        out |= {(q, r + 1, i) for r, (_, i) in enumerate(sorted(scores)[:k])}
    return out


@pytest.mark.parametrize("shard, group", [(1 << 14, 3), (1 << 25, 1)])
def test_search_equals_brute_force(spark, small, shard, group):
    texts = [*small, *ODD]
    docs = docs_of(spark, texts, extra=True)
    asked = [0, 7, 50, 100, len(small) + 3, len(small) + 7, len(small)]
    queries = docs.filter(F.col("doc_id").isin(asked)).withColumnRenamed("doc_id", "query_id")
    got = {(r["query_id"], r["rank"], r["doc_id"]) for r in search.top_k(docs, queries, 5, shard, group).collect()}
    assert got == brute_bm25(texts, asked, 5)


def test_search_repeated_and_missing_ids(spark):
    rows = [(1, "x y"), (1, "x z"), (None, "x"), (2, "z z q")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    queries = spark.createDataFrame([(5, "x"), (5, "z"), (None, "x"), (6, "nothing"), (7, None)], "query_id bigint, text string")
    got = search.top_k(docs, queries, 3).collect()
    assert sorted((r["query_id"], r["rank"], r["doc_id"]) for r in got) == [(5, 1, 1), (5, 2, 2), (5, 3, 1)]  # two rows of doc 1, each by itself


def test_search_skips_and_stays_exact(small):
    """Block-max WAND reads a part of the postings and finds what a full scan finds, with a threshold from other shards too."""
    rng = np.random.default_rng(3)
    texts = [" ".join([f"t{i % 16}"] * 6 + [f"t{i % 16}w{x}" for x in rng.zipf(1.3, 30) % 300] + [f"w{x}" for x in rng.zipf(1.3, 30) % 3000]) for i in range(4000)]
    made = []
    for part in (texts[:2500], texts[2500:]):
        for batch, data, offsets in common.text_chunks(iter(pa.table({"text": part}).to_batches()), limit=1 << 30):
            word, n, row, length = search.terms(data, offsets)
            made.append(search.Shard(search.Shard.dump(np.arange(len(batch)) + 2500 * len(made), word, n, row, length), 60.0))
    df = Counter(w for t in texts for w in set(t.split()))
    total = 0
    for q in range(6):
        some = sorted(set(texts[q].split()), key=df.get)[:: 1 if q < 2 else 4]
        raw = np.frombuffer(" ".join(some).encode(), np.uint8)
        term, _, _, _ = search.terms(raw, np.array([0, len(raw)]))
        idf = {int(search.terms(x := np.frombuffer(w.encode(), np.uint8), np.array([0, len(x)]))[0][0]): np.log(1 + 4000 / df[w]) for w in some}
        weight = np.array([idf[int(t)] for t in term])
        best, read, scores = search.Best(10), 0, []
        for shard in made:
            read += shard.search(term, weight, best)
            at = np.searchsorted(shard.vocabulary, term)
            w = np.zeros(len(shard.vocabulary))
            known = (at < len(w)) & (shard.vocabulary[np.minimum(at, len(w) - 1)] == term)
            w[at[known]] = weight[known]
            of = np.repeat(np.arange(len(w)), np.add.reduceat(np.diff(shard.first), shard.enter[:-1]))
            scores.append((np.bincount(shard.doc, w[of] * shard.impact, len(shard.doc_ids)), shard.doc_ids, int((w[of] > 0).sum())))
        all_scores, ids = np.round(np.concatenate([s for s, _, _ in scores]), 6), np.concatenate([i for _, i, _ in scores])
        want = np.lexsort((ids, -all_scores))[:10]
        assert best.ids.tolist() == ids[want].tolist() and best.scores == pytest.approx(all_scores[want])
        total += read / sum(n for _, _, n in scores)
    assert total / 6 < 0.8


def test_search_shuffles_neither_queries_nor_shards(spark, small, monkeypatch):
    """Answers are of so many groups, however many shards there are; packs of one query or few, too."""
    made = {}

    def keep(df, name, **options):
        made[name] = df._jdf.queryExecution().toString(), common.materialize(df, name, **options)
        return made[name][1]

    monkeypatch.setattr(search, "materialize", keep)
    monkeypatch.setattr(search, "PACK_BYTES", 1 << 12)
    texts = [*small, *reversed(small)]
    docs, asked = docs_of(spark, texts).repartition(24), list(range(0, len(texts), 20))
    queries = docs.filter(F.col("doc_id").isin(asked)).withColumnRenamed("doc_id", "query_id")
    got = {(r["query_id"], r["rank"], r["doc_id"]) for r in search.top_k(docs, queries, 3, 1 << 12, 2).collect()}
    assert got == brute_bm25(texts, asked, 3)
    assert made["shards"][1].count() > 10 and made["packs"][1].count() > 1
    assert "Exchange" not in made["found"][0] and made["found"][1].count() <= 2 * 3 * len(asked)


def test_search_passes_a_shard_with_many_queries_at_once(monkeypatch):
    """Queries of a pack go through a shard in batches, which leaves their answers as they are."""
    rng, passes, one_pass = np.random.default_rng(5), [], search.Shard._pass
    monkeypatch.setattr(search.Shard, "_pass", lambda self, *a: passes.append(1) or one_pass(self, *a))
    texts = [" ".join(f"t{i % 3}w{x}" for x in rng.zipf(1.2, 1 + i % 90) % 400) for i in range(1500)] + ["t0w1"] * 20 + ["", "alone"]
    word, n, row, length = search.terms(raw := np.frombuffer("".join(texts).encode(), np.uint8), np.append(0, np.cumsum([len(t) for t in texts])))
    vocabulary, df = np.unique(word, return_counts=True)
    bounds = np.searchsorted(row, np.arange(len(texts) + 1))
    idf = dict(zip(vocabulary.tolist(), np.log(1 + (len(texts) - df + 0.5) / (df + 0.5)).tolist(), strict=True))
    asked = [*range(200), 1500, 1521]
    terms = [word[bounds[q] : bounds[q + 1]] for q in asked]
    weights = [n[bounds[q] : bounds[q + 1]] * [idf[int(t)] for t in term] for q, term in zip(asked, terms, strict=True)]
    terms, weights, asked = [*terms, np.array([1, 2], np.uint64)], [*weights, np.ones(2)], [*asked, 9999]  # words that no document has
    pack, impact = search.Pack(search.Pack.dump(asked, terms, weights), 10), n * 2.2 / (n + 1.2 * (0.25 + 0.75 * (length / length.mean())[row]))
    for a, b in ((0, 900), (900, len(texts))):
        own = slice(bounds[a], bounds[b])
        pack.visit(search.Shard(search.Shard.dump(np.arange(a, b), word[own], n[own], row[own] - a, length[a:b]), length.mean()))
    got = pack.answers().to_pandas().groupby("query_id")
    assert len(raw) and set(got.groups) == set(asked) - {9999}
    for q, term, weight in zip(asked[:-1], terms, weights, strict=False):
        at = np.searchsorted(term, word)
        of = np.where(term[np.minimum(at, len(term) - 1)] == word, weight[np.minimum(at, len(term) - 1)], 0)
        scores = np.round(np.bincount(row, of * impact, len(texts)), 6)
        want = [i for i in np.lexsort((np.arange(len(texts)), -scores))[:10].tolist() if scores[i] > 0]
        found = got.get_group(q).sort_values(["score", "doc_id"], ascending=[False, True])
        assert found["doc_id"].tolist() == want and found["score"].tolist() == pytest.approx(scores[want].tolist(), abs=2e-6)
    assert len(passes) < len(asked) / 4


def test_search_bounds_the_matrix_of_a_shard_of_long_texts():
    """A few documents of many words: every word is frequent, and a batch's weights are cells of queries by rows."""
    word = np.sort(words.mix(np.arange(1, 20_001).astype(np.uint64)))
    shard = search.Shard(search.Shard.dump(np.arange(2), np.tile(word, 2), np.repeat([1, 3], len(word)), np.repeat([0, 1], len(word)), np.array([20_000, 60_000])), 40_000.0)
    assert len(shard.rows) <= 4096
    best = search.Best(1)
    shard.search(word, np.ones(len(word)), best)
    norm = 1.2 * (0.25 + 0.75 * 1.5)
    assert best.ids.tolist() == [1] and best.scores == pytest.approx([20_000 * 3 * 2.2 / (3 + norm)])


def test_search_of_nothing(spark):
    none = docs_of(spark, [])
    assert search.top_k(none, none.withColumnRenamed("doc_id", "query_id")).count() == 0


# ---- 5 near duplicates


def brute_classes(texts, threshold=0.8):
    bags = []
    for t in texts:
        w = tokens(t)
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            whole = sum((bags[i] | bags[j]).values())
            if (whole and both >= threshold * whole) or (not whole and (texts[i] or "") == (texts[j] or "")):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(len(texts))}


def edited(text, rng, share):
    w = text.split(" ")
    for i in range(len(w)):
        if rng.random() < share:
            w[i] = f"new{rng.integers(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("block", [near_dedup.BLOCK_SHINGLES, 500])
def test_near_duplicates_equal_brute_force(spark, small, block):
    rng = np.random.default_rng(5)
    base = next(t for t in small if 150 < len(tokens(t)) < 400)
    family = [edited(base, rng, s) for s in np.linspace(0.0, 0.06, 25)]
    texts = [*small[:60], *family, *ODD, base, base]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs_of(spark, texts, extra=True), block=block).collect()}
    assert got == brute_classes(texts)


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    e = rng.integers(0, 2**63, 300).astype(np.uint64)
    a = rng.integers(1, 4, 300) * rng.choice([1, 0.5, 0.7], 300)
    b = a * rng.choice([1, 1, 1, 2, 0.3], 300)
    s = near_dedup.signatures(np.concatenate([e, e]), np.concatenate([a, b]), np.repeat([0, 1], 300), 2, 4000)
    assert (s[0] == s[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.03)


def test_keep_one_edges(spark):
    docs = docs_of(spark, ["a b c d e f", "a b c d e f", None, "", "z"], extra=True)
    nulls = docs.withColumn("doc_id", F.lit(None).cast("bigint"))
    kept = near_dedup.keep_one(docs.unionByName(nulls))
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [0, 2, 4]
    assert kept.filter("doc_id is null").count() == 5 and kept.columns == docs.columns
    assert near_dedup.near_duplicates(docs_of(spark, [])).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(None, 3), (7, 7), (0, 1)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(rows, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 0), **dict.fromkeys(range(101, 160), 100)}


# ---- 6 decontamination


def brute_matches(texts, items, window=10):
    grams = defaultdict(set)
    for item, text in items:
        w = tokens(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            grams[tuple(w[i : i + n])].add(item)
    sizes = {len(g) for g in grams}
    out = {}
    for d, t in enumerate(texts):
        w, hit, found = tokens(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    found |= grams[tuple(w[i : i + n])]
        out[d] = (len(w), len(hit), sorted("null" if x is None else str(x) for x in found))
    return out


@pytest.mark.parametrize("alphabet, window", [(3, 4), (8, 3), (2, 10)])
def test_matches_equal_brute_force(spark, alphabet, window):
    rng = np.random.default_rng(alphabet)
    draw = lambda n: " ".join(f"w{x}" for x in rng.integers(0, alphabet, n))
    items = [(i, draw(int(rng.integers(0, 14)))) for i in range(8)] + [(8, None), (None, "w0 w1"), (2, "w1 w1 w1")]
    texts = [draw(int(rng.integers(0, 60))) for _ in range(60)] + ODD
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.match_benchmark(docs_of(spark, texts, extra=True), bench, window).collect()}
    assert got == brute_matches(texts, items, window)


def test_single_words_and_empty_benchmarks(spark):
    texts = ["b a", "A", "ab", None]
    one = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert [r["n_hit"] for r in decontaminate.match_benchmark(docs_of(spark, texts), one).orderBy("doc_id").collect()] == [1, 1, 0, 0]
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.match_benchmark(docs_of(spark, texts), none).filter("n_hit > 0").count() == 0
    assert decontaminate.remove_spans(docs_of(spark, texts), none).count() == 4
    assert decontaminate.match_benchmark(docs_of(spark, []), one).count() == 0


def test_removed_passages_leave_no_match(spark):
    item = " ".join(f"t{i}" for i in range(12))
    text = "Clean é start, " + item + ". And the end stays; " + "more words here " * 10
    docs = docs_of(spark, [text, item, "clean", None], extra=True)
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    got = {r["doc_id"]: r for r in decontaminate.remove_spans(docs, bench).collect()}
    assert set(got) == {0, 2, 3} and got[0]["text"].startswith("Clean é start, .") and got[0]["n_chars"] == len(got[0]["text"])
    assert decontaminate.match_benchmark(spark.createDataFrame([tuple(r) for r in got.values()], docs.schema), bench).filter("n_hit > 0").count() == 0


def test_long_repetitive_items_are_matched_in_one_pass(spark):
    """Runs of a period match at every shift; an item of 90,000 words would take 4e9 steps if each word climbed all links."""
    bench = spark.createDataFrame([(1, "a b c " * 30_000), (2, "b c"), (3, "c a b c")], "item_id bigint, text string")
    got = {r["doc_id"]: r for r in decontaminate.match_benchmark(docs_of(spark, ["x " + "c a b " * 30_000 + "y", "a b", "b c x"]), bench).collect()}
    assert (got[0]["n_words"], got[0]["n_hit"], got[0]["items"]) == (90_002, 90_000, ["1", "2", "3"])
    assert (got[1]["n_hit"], got[1]["items"], got[2]["n_hit"], got[2]["items"]) == (0, [], 2, ["2"])


@pytest.mark.parametrize("group_bytes", [40, 150])
def test_large_benchmarks_are_matched_group_by_group(spark, group_bytes):
    rng = np.random.default_rng(8)
    draw = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 3, n))
    items = [(i, draw(int(rng.integers(0, 14)))) for i in range(12)] + [(20, None), (None, "w0 w1 w2 w2")]
    texts = [draw(int(rng.integers(0, 60))) for _ in range(40)] + ["clean é one", *ODD]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = docs_of(spark, texts, extra=True)
    assert decontaminate.groups_of(bench, group_bytes) > 1
    got = decontaminate.match_benchmark(docs, bench, 4, group_bytes).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in got} == brute_matches(texts, items, 4)
    keyed = lambda df: {r["doc_id"]: (r["text"], r["n_chars"]) for r in df.collect()}
    one, many = decontaminate.remove_spans(docs, bench, 4), decontaminate.remove_spans(docs, bench, 4, group_bytes=group_bytes)
    assert keyed(one) == keyed(many) and many.columns == docs.columns


# ---- 7 quality


def loop_passages(text):
    """Features of each passage of 64 words, letter by letter and word by word."""
    raw, found = (text or "").encode(), []
    for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw):
        found.append((m.start(), m.group().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))))
    bags = [found[i : i + 64] for i in range(0, max(len(found), 1), 64)]
    begins = [0, *(b[0][0] for b in bags[1:]), len(raw)]
    for k, bag in enumerate(bags):
        part, n = raw[begins[k] : begins[k + 1]], max(len(bag), 1)
        kinds = [0] * 8
        for c in part:
            x = chr(c) if c < 128 else "é"
            kinds[0 if x.islower() else 1 if x.isupper() else 2 if x.isdigit() else 3 if x == " " else 4 if x == "\n" else 5 if x in ".,;:!?'\"-" else 6 if x.isprintable() else 7] += 1
        sizes = [len(w) for _, w in bag]
        codes = [int(words.hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) for _, w in bag]
        mean = sum(sizes) / n
        share = [sum(x % quality.BUCKETS == b for x in codes) / n for b in range(quality.BUCKETS)]
        more = [np.log1p(len(bag)), np.log1p(len(part)), mean, max(0, sum(x * x for x in sizes) / n - mean**2) ** 0.5, sum(x <= 3 for x in sizes) / n, sum(a == b for a, b in zip(codes[1:], codes, strict=False)) / n, len(set(codes)) / n, sum(x <= 1 for x in sizes) / n]
        yield [x / max(len(part), 1) for x in kinds] + more + share


def test_quality_passages_and_scores_equal_a_loop(spark, small):
    texts = [*small[:25], "word " * 129, *ODD[:6], *ODD[7:]]
    for limit in (50, 1 << 20):
        got = []
        for batch, data, offsets in common.text_chunks(iter(pa.table({"text": texts}).to_batches()), limit=limit):
            x, first = quality.passages(data, offsets)
            got += [x[first[i] : first[i + 1]] for i in range(len(batch))]
        assert len(got) == len(texts)
        for own, t in zip(got, texts, strict=True):
            assert own == pytest.approx(np.array(list(loop_passages(t))), abs=2e-4)
    rng = np.random.default_rng(0)
    net = quality.Network(rng.random(quality.N_FEATURES), rng.random(quality.N_FEATURES) + 0.5)
    p, scores = net.p, {r["doc_id"]: r["score"] for r in quality.score(docs_of(spark, texts, extra=True), net).collect()}
    for i, t in enumerate(texts):
        hidden = [np.tanh(np.clip((np.array(f) - net.mean) / net.scale, -8, 8) @ p["w"] + p["b"]) for f in loop_passages(t)]
        gate = np.array([(np.tanh(h @ p["v"]) / (1 + np.exp(-(h @ p["u"])))) @ p["g"] for h in hidden])
        a = np.exp(gate) / np.exp(gate).sum()
        assert scores[i] == pytest.approx(1 / (1 + np.exp(-(sum(w * h for w, h in zip(a, hidden, strict=True)) @ p["c"] + p["d"][0]))), abs=1e-3)


def test_quality_held_out(spark):
    docs, labels = common.table(spark, "/root/testdata/sf0.01", "documents"), common.table(spark, "/root/testdata/sf0.01", "labels")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    net = quality.fit(docs, labels, where=~out)
    rows = quality.score(docs, net).join(labels, "doc_id").filter(out).collect()
    assert np.mean([(r["score"] >= 0.5) == (r["quality"] == 1) for r in rows]) > 0.9
    odd = quality.score(docs_of(spark, ODD, extra=True), net).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    assert quality.score(docs_of(spark, []), net).count() == 0


def test_quality_gradient_and_absent_labels(spark):
    rng = np.random.default_rng(2)
    x, first = rng.random((9, quality.N_FEATURES)).astype(np.float32), np.array([0, 2, 3, 9])
    label, weight = np.array([1.0, 0, 1], np.float32), np.ones(3, np.float32)
    net = quality.Network(x.mean(0), x.std(0) + 1)
    g = net.gradient(x, first, label, weight)
    loss = lambda: -np.mean(label * np.log(net.forward(x, first)["y"]) + (1 - label) * np.log(1 - net.forward(x, first)["y"]))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    for k in "wbvugc":
        at = tuple(0 for _ in net.p[k].shape)
        old = net.p[k][at]
        net.p[k][at] = old + 1e-4
        up = loss()
        net.p[k][at] = old - 1e-4
        down = loss()
        net.p[k][at] = old
        assert g[k][at] == pytest.approx((up - down) / 2e-4, abs=2e-4)
    nothing = spark.createDataFrame([(1, None)], "doc_id bigint, quality int")
    assert quality.score(docs_of(spark, ["a"]), quality.fit(docs_of(spark, ["a"]), nothing)).first()["score"] == 0.5


# ---- 8 licences


def brute_dice(texts, notices, threshold=0.8):
    """All runs of all lengths; those that begin with a bigram of the template are counted."""
    grams = lambda w: list(zip(w[:-1], w[1:], strict=True))
    split = lambda t: [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) if x]
    out = {}
    for d, t in enumerate(texts):
        own = grams(split(t))
        for k, v in notices:
            template = Counter(grams(split(v)))
            m = sum(template.values())
            if not m or not set(own) & set(template):
                continue
            best = {}
            for a in range(len(own)):
                here, shared = Counter(), 0
                for b in range(a, min(len(own), a + 2 * m)):
                    here[own[b]] += 1
                    shared += here[own[b]] <= template[own[b]]
                    best[a] = max(best.get(a, 0), 2 * shared / (b + 1 - a + m))
            if best and max(best.values()) >= threshold:
                out[d, k] = (sum(x >= threshold and own[a] in template for a, x in best.items()), max(best.values()))
    return out


def test_license_scan_equals_brute_force(spark):
    notices = [*license_scan.TEMPLATES, ("word", "Copyleft"), ("none", "!!"), ("twice", "a b a b a b"), (None, "null id notice"), ("null", None)]
    mit, apache = dict(license_scan.TEXTS)["mit-text"], dict(license_scan.TEXTS)["apache-2.0-header"]
    odd = [t if t is None or len(t) < 1000 else t[:900] for t in ODD]
    texts = [
        *odd,
        "Licensed under the Apache License, Version 2.0.",
        "x\nReleased under  the MIT License!\n\nRELEASED UNDER THE MIT LICENSE",
        "copyleft\na b a b a b a b c",
        "Licensed under\nCC BY-NC 4.0.",
        "This work is licensed under the GNU General Public License, version 9. or",
        "This module was written by the team. Released under the MIT License. And more words follow it here.",
        "Some code\n" + "\n# ".join(mit[i : i + 60] for i in range(0, len(mit), 60)) + "\nend of it",
        "# " + apache.replace(" ", "\n# ", 40) + " more",
        "null id\nnotice " + mit[:200],
    ]
    frame = spark.createDataFrame(notices, "license_id string, text string")
    got = {(r["doc_id"], r["license_id"]): (r["n_starts"], pytest.approx(r["dice"])) for r in license_scan.scan(docs_of(spark, texts, extra=True), frame).collect()}
    want = brute_dice(texts, notices)
    assert got == want and {(len(odd) + 5, "mit"), (len(odd) + 6, "mit-text"), (len(odd) + 6, "mit-grant"), (len(odd) + 3, "cc-by-nc-4.0"), (len(odd) + 7, "apache-2.0-header")} <= set(want)
    assert license_scan.scan(docs_of(spark, []), frame).count() == 0
    assert license_scan.scan(docs_of(spark, texts), frame.filter("license_id = 'none'")).count() == 0


def test_license_scan_finds_whole_texts(spark):
    """With the texts of licences/, a document that is a licence is found as that licence; the list of the SQL stays as it is."""
    known = {r["license_id"]: r["text"] for r in license_scan.templates(spark, full=True).collect()}
    assert {r["license_id"] for r in license_scan.templates(spark).collect()} == {k for k, _ in license_scan.TEMPLATES}
    assert {k for k in known if k.endswith("-full")} == {f"{k}-full" for k in ("apache-2.0", "bsd-3-clause", "cc0-1.0", "gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "mpl-2.0")}
    ids = ["bsd-3-clause-full", "cc0-1.0-full", "lgpl-3.0-full"]
    docs = docs_of(spark, [*("Some words.\n# " + known[k].upper().replace("\n", "\n# ") + "\nand code" for k in ids), "the license of this work"])
    got = {(r["doc_id"], r["license_id"]): r["dice"] for r in license_scan.scan(docs, license_scan.templates(spark, full=True)).collect()}
    assert [got.get((i, k)) for i, k in enumerate(ids)] == [1, 1, 1] and not any(d == 3 for d, _ in got)


def test_license_scan_is_native(spark):
    plan = license_scan.scan(docs_of(spark, ["a"]), license_scan.templates(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- 9 toxicity


def test_toxicity_held_out(spark):
    docs, labels = common.table(spark, "/root/testdata/sf0.1", "documents"), common.table(spark, "/root/testdata/sf0.1", "labels")
    model = toxicity.fit(docs, labels.filter("doc_id % 4 <> 0"))
    rows = toxicity.score(docs, model).withColumnRenamed("toxic", "said").join(labels, "doc_id").filter("doc_id % 4 = 0").collect()
    toxic = [r for r in rows if r["toxic"]]
    assert np.mean([r["said"] for r in toxic]) > 0.9 and np.mean([r["said"] for r in rows if not r["toxic"]]) < 0.02
    assert list(model.thresholds) == sorted(model.thresholds)
    assert all(r["severity"] >= r["p_toxic"] for r in rows)
    odd = docs_of(spark, ODD, extra=True)
    assert toxicity.score(odd, model).count() == len(ODD) and toxicity.drop_toxic(odd, model).columns == odd.columns
    assert toxicity.score(docs_of(spark, []), model).count() == 0


def test_toxicity_likelihood_and_gradient():
    rng = np.random.default_rng(4)
    n, f, k = 40, 6, toxicity.GRADES
    grade, scale = rng.integers(0, k + 1, n), rng.random(n)
    row, feature = np.repeat(np.arange(n), 3), rng.integers(0, f, 3 * n)
    x, w, theta = rng.random(3 * n), rng.normal(0, 1, f), rng.normal(0, 0.5, k)
    loss, by_w, by_theta = toxicity.loss_and_gradient(w, theta, grade, scale, row, feature, x)
    cuts, brute = [-np.inf, theta[0], *(theta[0] + np.cumsum(np.exp(theta[1:]))), np.inf], 0.0
    for i in range(n):
        z = sum(w[g] * v for r, g, v in zip(row, feature, x, strict=True) if r == i)
        at_most = lambda c, z=z: 1 / (1 + np.exp(z - c))
        brute -= scale[i] * np.log(at_most(cuts[grade[i] + 1]) - at_most(cuts[grade[i]]))
    assert loss == pytest.approx(brute + toxicity.RIDGE / 2 * (w**2).sum())
    call = lambda w, t: toxicity.loss_and_gradient(w, t, grade, scale, row, feature, x)[0]
    for i in range(f):
        d = np.eye(f)[i] * 1e-5
        assert by_w[i] == pytest.approx((call(w + d, theta) - call(w - d, theta)) / 2e-5, abs=1e-5)
    for i in range(k):
        d = np.eye(k)[i] * 1e-5
        assert by_theta[i] == pytest.approx((call(w, theta + d) - call(w, theta - d)) / 2e-5, abs=1e-5)


def test_toxicity_words_doses_and_scores_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join([f"w{x}" for x in rng.integers(0, 60, 25)] + (["venom"] * int(rng.integers(1, 4)) if i % 3 == 0 and rng.random() < 0.9 else [])) for i in range(90)]
    docs = docs_of(spark, texts, extra=True)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(95, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)

    def keys(text):  # words, and the first 4, 5, 6 letters of longer ones
        return Counter(k for w in tokens(text) for k in [w, *((w[:n], n) for n in (4, 5, 6) if len(w) > n)])

    def code(k):
        w, n = (k, 0) if isinstance(k, str) else k
        raw = np.frombuffer(w.encode(), np.uint8)
        return int(words.hashes(raw, np.array([0]), np.array([len(raw)]))[0]) ^ n

    every = Counter(k for t in texts for k in keys(t))
    a = {k: sum(k in keys(texts[i]) for i in range(0, 90, 3)) for k in every}
    m = {k: sum(k in keys(t) for t in texts) for k in every}
    gain = {}
    for k in every:
        p, q, both, b = (a[k] + 0.5) / 31, (m[k] - a[k] + 0.5) / 61, (m[k] + 1) / 92, m[k] - a[k]
        gain[k] = a[k] * np.log(p / both) + (30 - a[k]) * np.log((1 - p) / (1 - both)) + b * np.log(q / both) + (60 - b) * np.log((1 - q) / (1 - both))
    assert sorted(model.features.tolist()) == sorted(code(k) for k in every if m[k] >= toxicity.MIN_DOCUMENTS and gain[k] > 6)
    weight = dict(zip(model.features.tolist(), model.weights, strict=True))
    for r in toxicity.score(docs, model).collect():
        z = sum(weight.get(code(k), 0) * np.log1p(c) for k, c in keys(texts[r["doc_id"]]).items())
        above = [1 / (1 + np.exp(t - z)) for t in model.thresholds]
        assert r["severity"] == pytest.approx(sum(above)) and r["p_toxic"] == pytest.approx(above[0])


def test_toxicity_doses_come_from_the_other_half(spark):
    """Words that mark toxic rows only in one half count in the other half alone."""
    rows = [(i, int(i % 2), [1000 + i, *([7] if i % 2 else [])], [1, *([1 + i % 3] if i % 2 else [])]) for i in range(80)]
    frame = spark.createDataFrame(rows, "row bigint, label int, words array<bigint>, counts array<int>")
    half = {r["row"]: r["h"] for r in frame.select("row", F.pmod(F.xxhash64("words"), F.lit(2)).alias("h")).collect()}
    assert set(half.values()) == {0, 1}
    assert {r["row"]: r["dose"] for r in toxicity.doses(frame).collect()} == {i: 1 + i % 3 for i in range(1, 80, 2)}
    assert toxicity.grades_of(np.array([0, 1, 1, 1]), np.array([9, 1, 2, 3])).tolist() == [0, 1, 2, 3]


def test_toxicity_without_labels_calls_all_clean(spark):
    docs = docs_of(spark, ["scum", None])
    for rows in ([], [(0, None)], [(0, 1)], [(0, 1), (0, 0), (None, 1)]):
        model = toxicity.fit(docs, spark.createDataFrame(rows, "doc_id bigint, toxic int"))
        assert toxicity.drop_toxic(docs, model).count() == 2


# ---- 10 tokens


def test_encoder_equals_the_library():
    import random

    draw = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "a", "bé", "ß", "1", "2²", "½", "-", "..", "<|endoftext|>", " ", "日本", "\U0001f600", "\r\n", "I'm", "''s", "\x1c", "Ā", "ʰ", "Hello"]
    texts = ["".join(draw.choices(parts, k=draw.randrange(0, 14))) for _ in range(3000)] + [""]
    enc, got = Encoder(token_store.default_tokenizer()), []
    for batch, data, offsets in common.text_chunks(iter(pa.table({"text": texts}).to_batches()), limit=5000):
        ids, at = enc.encode(data, offsets, 0)
        got += [ids[at[i] : at[i + 1]].tolist() for i in range(len(batch))]
    assert got == [[*enc.encode_text(t), 0] for t in texts]


def test_token_files_round_trip(spark, small, tmp_path):
    texts = [*small[:40], *ODD]
    docs = docs_of(spark, texts, extra=True).unionByName(docs_of(spark, texts[:3], extra=True))
    path = token_store.write_tokens(docs, str(tmp_path / "t"), files=3)
    enc = Encoder(token_store.default_tokenizer())
    want, start = [], 0
    for i, t in sorted([*enumerate(texts), *enumerate(texts[:3])], key=lambda x: (x[0], x[1] is not None, x[1] or "")):
        ids = [*enc.encode_text(t or ""), 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in token_store.token_index(spark, path).collect()) == sorted(want)
    some = token_store.read_tokens(spark, path, 5, 9).collect()
    assert sorted({r["doc_id"] for r in some}) == [5, 6, 7, 8, 9]
    assert token_store.read_metadata(spark, path).agg(F.sum("n_tokens")).first()[0] == start
    empty = token_store.write_tokens(docs_of(spark, []), str(tmp_path / "e"))
    assert token_store.token_index(spark, empty).count() == 0


def test_token_files_have_dictionaries_bounded_pages_and_indexes(spark, small, tmp_path):
    import pyarrow.parquet as pq

    docs = docs_of(spark, small * 30)
    path = token_store.write_tokens(docs, str(tmp_path / "t"), files=2)
    seen = 0
    for file in sorted((tmp_path / "t").glob("*.parquet")):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            assert group.total_byte_size <= 1.5 * token_store.ROW_GROUP_BYTES
            columns = {group.column(c).path_in_schema: group.column(c) for c in range(group.num_columns)}
            ids = next(c for name, c in columns.items() if name.startswith("ids"))
            assert "RLE_DICTIONARY" in ids.encodings or "PLAIN_DICTIONARY" in ids.encodings
            assert all(c.has_offset_index and c.has_column_index for c in columns.values())
            assert all(not {"PLAIN"} >= set(c.encodings) for c in columns.values())  # dictionary or delta
            seen += group.num_rows
    assert seen == len(small) * 30
    assert token_store.read_tokens(spark, path, 100, 120).count() == 21


# ---- pipeline


def test_pipeline_stages_each_do_their_work(spark):
    import corpus_pipeline

    docs = common.table(spark, SF, "documents")
    frame, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = frame
        frame = common.materialize(stage(spark, frame, SF), f"test-{name}")
        assert frame.columns == columns
        kept = {r["doc_id"] for r in frame.select("doc_id").collect()}
        assert kept <= {r["doc_id"] for r in before.select("doc_id").collect()}
        if name == "near_dedup":
            texts = [r["text"] for r in before.orderBy("doc_id").collect()]
            ids = [r["doc_id"] for r in before.orderBy("doc_id").collect()]
            assert kept == {ids[c] for c in brute_classes(texts).values()}
        if name == "decontamination":
            assert decontaminate.match_benchmark(frame, common.table(spark, SF, "benchmark")).filter("n_hit > 0").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, frame, SF)
    out = sorted(tuple(r) for r in last.collect())
    assert out == sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect())
    assert [r[0] for r in out] == sorted(r["doc_id"] for r in frame.collect())


def test_pipeline_stages_take_nulls_repeats_long_texts_and_clashing_columns(spark):
    import corpus_pipeline

    clash = ("gone", "_gone", "cell_source", "probability", "_probability", "__probability", "topic", "tokens", "items", "class_id", "root", "kept", "shard", "ids")
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 2 + [(11, None, None, "s", 0), (None, "one two", "en", None, 7)], DOCS)
    docs = docs_of(spark, ODD).unionByName(docs_of(spark, ODD).filter("doc_id between 3 and 5")).unionByName(nulls).withColumns({c: F.lit("z") for c in clash})
    docs = common.materialize(docs, "odd")
    none = common.materialize(docs.filter("false"), "none")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert stage(spark, none, SF).count() == 0
        if name == "token_output":
            assert out.count() == docs.count() and out.filter("doc_id is null").count() == 3
            continue
        assert out.columns == docs.columns and {r[c] for r in out.collect() for c in clash} <= {"z"}
        gone = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in out.collect()}
        assert gone == {"toxicity": set(), "near_dedup": {1, 4, 8, 11}, "decontamination": set()}.get(name, gone)
        if name == "source_mixing":
            kept = Counter(r["doc_id"] for r in mixing.mix(docs).filter("kept").collect())
            assert Counter(r["doc_id"] for r in out.collect()) == kept


def test_digest_of_items():
    assert decontaminate.items_digest(["1", "10", "2"]) == hashlib.sha256(b"1,10,2").hexdigest()
