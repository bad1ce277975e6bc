"""The operators against brute force, on odd rows and on the driver's tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from somatlas.llm import chat, decontam, langid, learning, ogg, packing, queries, revisit, sharding, simhash, tokens, toxicity, zframes
from somatlas.runtime import Scratch, ordered_rank, table
from tests.conftest import DATA
from tests.llm.common import LOWER, WORD, check_packing, contamination, groups, odd_documents
from tests.llm.common import simhash as brute_simhash

PATH = queries.tokenizer_path()


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


def empty(df):
    return df.where("1 = 0")


# ---- 1 sharding


def test_rendezvous_moves_rows_only_into_the_new_shard(spark):
    keys = spark.range(4000)
    for weights in ([1.0] * 7, [1.0, 2.0, 0.0, 5.0]):
        got = keys.select("id", sharding.rendezvous(F.col("id"), weights).alias("a"), sharding.rendezvous(F.col("id"), [*weights, 1.0]).alias("b")).toPandas()
        moved = got[got.a != got.b]
        assert set(moved.b) == {len(weights)}
        share = got.a.value_counts(normalize=True)
        for i, w in enumerate(weights):
            assert abs(share.get(i, 0) - w / sum(weights)) < 0.04
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("id"), [0.0])


def test_sharding_odd_rows(spark, scratch):
    df, rows = odd_documents(spark)
    got = sharding.shard_records(df, scratch, 3).toPandas()
    assert Counter(zip(got.text_crc32, got["size"])) == Counter((zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 1) for r in rows)
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert got[got.doc_id == 1].shard.nunique() == 1 and got.doc_id.isna().sum() == 2
    assert sharding.shard_records(empty(df), scratch, 3).count() == 0


def test_ordered_rank_with_a_hot_key(spark, scratch):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("k"), "id")
    got = ordered_rank(scratch, scratch.save(df.repartition(5)), [F.col("k")], "r").orderBy("__rank").toPandas()
    assert got["__rank"].tolist() == list(range(3000)) and got["k"].is_monotonic_increasing


# ---- 2 chat


def chats(spark, scratch, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    nodes, turns = chat.chain_nodes(df, scratch)
    return chat.read_back(chat.format_paths(chat.reply_paths(nodes, scratch), turns))


def test_chat_round_trip_of_control_strings(spark, scratch):
    pieces = ["### ", "</turn>", "\\", "\\b", "\\e", "\\h", "\\c", ": ", "\n", "assistant", "</turn", ">", "#", "é\U0001f600", ""]
    rng = random.Random(1)
    want, rows = defaultdict(list), []
    for conv in range(30):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "system", "a: b", "### ", "\\", ""])
            text = "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 8)))
            rows.append((conv, turn, role, text))
            want[conv].append((role, text))
    rng.shuffle(rows)
    got = chats(spark, scratch, rows).collect()
    assert len(got) == 30
    for r in got:
        assert [(t["role"], t["text"]) for t in r["turns"]] == want[r["tree_id"]]
        assert r["loss_text"] == "".join(t for role, t in want[r["tree_id"]] if role == "assistant")
        assert r["formatted"].count("</turn>") == len(want[r["tree_id"]])


def test_chat_odd_rows(spark, scratch):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "first"), (None, 2, "assistant", "b"), (None, 1, "user", "a"), (2, 0, "assistant", "x" * 200_000)]
    got = {r["tree_id"]: r for r in chats(spark, scratch, rows).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("", "first"), ("user", ""), ("user", "")]
    assert [t["text"] for t in got[None]["turns"]] == ["a", "b"] and got[None]["loss_text"] == "b"
    assert got[2]["loss_text"] == "x" * 200_000
    assert chats(spark, scratch, [(1, 0, "a", "b")]).where("tree_id = 2").count() == 0
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    nodes, _ = chat.chain_nodes(none, scratch)
    assert chat.reply_paths(nodes, scratch).count() == 0


def test_reply_paths_against_a_walk(spark, scratch):
    rng = random.Random(3)
    nodes, by_tree = [], defaultdict(list)
    for n in range(400):
        tree = n % 5
        parent = rng.choice(by_tree[tree]) if by_tree[tree] and rng.random() < 0.97 else (None if rng.random() < 0.5 else 10**6 + n)
        nodes.append((tree, n, parent, rng.choice([None, 0.0, 1.0, 2.5])))
        by_tree[tree].append(n)
    nodes += [(9, 900, 901, 1.0), (9, 901, 900, 1.0), (9, 902, 901, 5.0)]  # a cycle with a tail
    chain = [(7, 1000 + i, 999 + i if i else None, 0.0) for i in range(130)]
    df = scratch.save(spark.createDataFrame(nodes + chain, "tree_id long, node_id long, parent_id long, score double"))
    parent = {n: p for _, n, p, _ in nodes + chain}
    score = {n: s or 0.0 for _, n, _, s in nodes + chain}
    tree = {n: t for t, n, _, _ in nodes + chain}
    leaves = set(parent) - {p for p in parent.values()}
    want = defaultdict(list)
    for leaf in leaves:
        path, n = [], leaf
        while n in parent and n not in path:
            path.append(n)
            n = parent[n]
        if n not in path:
            want[tree[leaf]].append((-sum(score[x] for x in path), -len(path), leaf, path[::-1]))
    got = defaultdict(list)
    for r in chat.reply_paths(df, scratch, top=3).collect():
        got[r["tree_id"], r["branch_rank"]].append((r["position"], r["node_id"]))
    assert set(got) == {(t, k + 1) for t, ps in want.items() for k in range(min(3, len(ps)))}
    for (t, k), path in got.items():
        path = [n for _, n in sorted(path)]
        s = -sum(score[x] for x in path)
        assert path in [p for *_, p in want[t]]
        assert np.isclose(s, sorted(want[t])[k - 1][0])


def test_the_query_depends_on_the_ranking(spark, scratch):
    rows = [(c, t, "user", f"{c} {t}") for c in (1, 2, 3, None) for t in range({1: 1, 2: 2, 3: 9}.get(c, 4))]
    nodes, turns = chat.chain_nodes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), scratch)
    replies, texts = chat.rejected_replies(nodes, "no")
    assert replies.count() == 3
    paths = chat.reply_paths(nodes.unionByName(replies), scratch, top=2)
    got = {(r["tree_id"], r["branch_rank"]): [t["text"] for t in r["turns"]] for r in chat.read_back(chat.format_paths(paths, turns.unionByName(texts))).collect()}
    want = {(c, 1): [r[3] for r in rows if r[0] == c] for c in (1, 2, 3, None)} | {(c, 2): [f"{c} 0", "no"] for c in (2, 3, None)}
    assert got == want


def test_repeated_nodes_count_once(spark, scratch):
    nodes = [(1, 0, None, 1.0), (1, 1, 0, 2.0), (1, 1, 0, 1.0), (1, 1, 0, 1.0), (1, 2, 1, 0.0), (2, 2, 1, 0.0), (1, None, 0, 9.0)]
    got = chat.reply_paths(spark.createDataFrame(nodes, "tree_id long, node_id long, parent_id long, score double"), scratch).collect()
    assert sorted((r["position"], r["node_id"], r["branch_score"]) for r in got) == [(0, 0, 2.0), (1, 1, 2.0), (2, 2, 2.0)]


# ---- 3 and 9 trained operators


def test_neighbours_are_the_exact_ones():
    rng = np.random.default_rng(0)
    for trial in range(20):
        n_terms, n = 40, 300
        vectors = []
        for _ in range(n):
            at = np.sort(rng.choice(n_terms, rng.integers(0, 8), replace=False))
            vectors.append((at, rng.integers(1, 4, len(at)).astype(float)))
        vectors[7] = vectors[3]
        index = toxicity.NearestExamples(vectors, rng.uniform(1, 5, n_terms))
        dense = np.zeros((n, n_terms))
        for i, v in enumerate(vectors):
            at, w = index.unit(*v)
            dense[i, at] = w
        for i in range(0, n, 11):
            sims = np.round(dense @ dense[i], 9)
            sims[i] = 0
            order = [j for j in np.lexsort((np.arange(n), -sims)) if sims[j] > 0][:15]
            ids, got = index.nearest(*vectors[i], but=i)
            assert ids.tolist() == order and np.allclose(got, sims[order])


def test_postings_are_sparse():
    rng = np.random.default_rng(2)
    vectors = [(np.sort(rng.choice(900, 6, replace=False)), np.ones(6)) for _ in range(500)]
    index = toxicity.NearestExamples(vectors, np.ones(900))
    assert len(index.slot) == len(index.impact) == 3000 and index.largest.shape == (900, 8)


def test_scores_against_a_plain_vote():
    rng = random.Random(4)
    words = ["vile", "nasty", "cruel", *(f"calm{i}" for i in range(12))]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 9))) for _ in range(90)]
    texts += texts[:20]
    y = np.array([int(any(w in t for w in words[:3]) and rng.random() < 0.9) for t in texts])
    vectors = toxicity.Vectors([f"<{w}>" for w in words])
    idf = np.linspace(1, 3, len(words) + 1)
    totals = {0: 700, 1: 50}
    scorer = toxicity.Scorer(list(range(len(texts))), texts, y, totals, vectors, idf)

    def unit(t):
        at, tf = vectors(t)
        v = np.zeros(len(idf))
        v[at] = tf * idf[at]
        return v / np.linalg.norm(v)

    share = np.array([totals[k] / (y == k).sum() for k in y])
    share /= share.sum()
    units = [unit(t) for t in texts]
    for t in [*texts[:30], "calm1 vile unknown", "", "nasty nasty nasty"]:
        groups_ = {}
        for i, u in enumerate(units):  # examples with one vector are one entry
            groups_.setdefault(tuple(np.round(u, 9)), []).append(i)
        ranked = sorted(groups_.values(), key=lambda g: (-round(float(units[g[0]] @ unit(t)), 9), g[0]))
        left, top, total = toxicity.NEIGHBOURS, 0.0, 0.0
        for g in ranked:
            sim = float(units[g[0]] @ unit(t))
            if left <= 0 or sim <= 0:
                break
            use = min(left, len(g)) / len(g)
            near = use / (toxicity.NEAR + max(0.0, 1 - sim))
            top += near * sum(share[i] * y[i] for i in g)
            total += near * sum(share[i] for i in g)
            left -= len(g)
        vote = top / total if total else 0.0
        a, b = scorer.curve
        assert np.isclose(scorer.score(t)[0], 1 / (1 + np.exp(-(a * vote + b))), atol=1e-9), t


def test_calibration_is_safe():
    rng = np.random.default_rng(0)
    for votes, y in ((np.full(60, 0.1), np.arange(60) % 10 == 0), (np.where(np.arange(60) % 10 == 0, 0.09, 0.11), np.arange(60) % 10 == 0), (rng.random(60), np.arange(60) % 10 == 0)):
        a, b = toxicity.calibrate(votes, y.astype(float), np.ones(60))
        p = 1 / (1 + np.exp(-(a * votes + b)))
        assert a >= 1 and abs(p.mean() - 0.1) < 0.05 and p.max() < 0.5
    y = (np.arange(60) % 10 == 0).astype(float)
    a, b = toxicity.calibrate(y, y, np.ones(60))
    assert np.isfinite([a, b]).all() and 1 / (1 + np.exp(-(a + b))) > 0.7 and 1 / (1 + np.exp(-b)) < 0.1


def test_terms_are_counted_as_they_occur():
    v = toxicity.Vectors(["<bad>", "ad>", "bad", "<ba"])
    at, tf = v("Bad, badly. unbad BAD_bad 9")
    assert dict(zip(at.tolist(), tf.tolist())) == {0: 3.0, 1: 4.0, 2: 5.0, 3: 4.0, 4: 0.1 * (5 + 50)}
    assert toxicity.Vectors([])("a b")[0].tolist() == [0]


@pytest.fixture(scope="module")
def labelled(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return docs, labels


def test_toxicity_on_held_out_rows(labelled):
    docs, labels = labelled
    out = toxicity.score_documents(docs, labels)
    got = out.join(labels, "doc_id").where("held_out").toPandas()
    assert out.count() == docs.count() and got.score.between(0, 1).all()
    hit = (got.predicted == 1) & (got.toxic == 1)
    assert hit.sum() / (got.toxic == 1).sum() > 0.9
    assert ((got.predicted == 1) & (got.toxic == 0)).sum() <= 0.01 * len(got)
    assert ((got.score - got.toxic) ** 2).mean() < 0.03
    assert (got.predicted == (got.score >= 0.7)).all()


def test_language_on_held_out_rows(labelled):
    docs, _ = labelled
    got = langid.predict_documents(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()


def test_held_out_is_the_checksum_of_the_number(spark):
    got = spark.range(200).select("id", learning.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in got)


def test_trained_operators_on_odd_rows(spark):
    df, rows = odd_documents(spark)
    labels = spark.createDataFrame([(0, 1, 0), (-9, 0, 1), (5, 1, 0), (77, 0, 1), (None, 0, 1), (6, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(df, labels).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    assert toxicity.score_documents(df, empty(labels)).where("score = 0 and predicted = 0").count() == len(rows)
    assert toxicity.score_documents(empty(df), labels).count() == 0
    kept = toxicity.keep_harmless(df, labels)
    assert kept.columns == df.columns
    lang = langid.predict_documents(df).toPandas()
    assert len(lang) == len(rows)
    und = {(r[0], r[1]) for r in rows if not any(c.isalpha() for c in r[1] or "")}
    assert (lang.lang_pred == "und").sum() == len([r for r in rows if (r[0], r[1]) in und])
    assert set(lang.lang_pred) - {"und"} <= {"en", "fr", "la", "xx"}
    kept = langid.keep_identified(df, 0.0)
    assert kept.columns == df.columns and kept.where("text is null or text = ''").count() == 0
    assert langid.predict_documents(empty(df)).count() == 0
    nobody = df.withColumn("lang", F.lit(None).cast("string"))
    assert langid.predict_documents(nobody).where("lang_pred = 'und'").count() == len(rows)


def test_equal_texts_have_equal_scores(labelled):
    docs, labels = labelled
    for out in (toxicity.score_documents(docs, labels), langid.predict_documents(docs)):
        per = out.join(docs.select("doc_id", "text"), "doc_id").groupBy("text").agg(F.countDistinct("score").alias("n"))
        assert per.where("n > 1").count() == 0


def test_ftrl_is_sparse_and_temperature_lowers_the_loss():
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(400):
        k = rng.integers(3)
        at = np.unique(np.append(rng.integers(6, 200, 5), k))
        rows.append((at, np.full(len(at), 1 / np.sqrt(len(at)))))
        y.append(k)
    w = langid.ftrl(rows, np.array(y), 300, 3)
    assert (w[200:] == 0).all()
    scores = np.array([x @ w[at] for at, x in rows])
    assert (scores.argmax(1) == y).mean() > 0.95
    loss = lambda t: -np.log(langid.softmax(scores / t)[np.arange(400), y]).mean()
    t = langid.temperature(scores, np.array(y))
    assert loss(t) <= min(loss(0.5), loss(1.0), loss(2.0)) + 1e-6


# ---- 4 revisits


def test_canonical_url(spark):
    cases = {
        "HTTP://WWW.Example.com:80/A/?utm_source=x&b=2&ref=y#top": "example.com/A/?b=2&ref=y", "https://example.com/": "example.com", "https://example.com:443/x/": "example.com/x", "http://example.com/p?page=2&gclid=x": "example.com/p?page=2",
        "example.com/p?fbclid": "example.com/p", "http://example.com/p?prefs=1&href=2": "example.com/p?prefs=1&href=2", "": "", None: None,
        "http://h:443": "h:443", "https://h": "h", "https://h:80/": "h:80", "h:80/a": "h/a", "https://h/x?ref=dev": "h/x?ref=dev", "https://h/x?ref=main": "h/x?ref=main",
        "http://h/%7Ea%2fb%zz%2E?x=%41%3d%": "h/~a%2Fb%zz.?x=A%3D%", "http://h/a/./b/../../c/": "h/c", "http://h/../a/..?q=/": "h/?q=/", "http://h/a/%2e%2E/b": "h/b", "http://h/a/b/.": "h/a/b", "http://h/..a/b..": "h/..a/b..",
    }
    df = spark.createDataFrame([(k,) for k in cases], "u string").select("u", revisit.canonical_url(F.col("u")).alias("c"))
    assert {r["u"]: r["c"] for r in df.collect()} == cases


def plain_headers(headers):
    out = {}
    for k, v in sorted((headers or {}).items()):
        k = k.strip().lower()
        out[k] = v if out.get(k) is None else out[k] if v is None else f"{out[k]}, {v}"
    return out


def test_revisits_against_a_scan(spark, scratch, monkeypatch):
    monkeypatch.setattr(revisit, "BLOCK", 16)
    rng = random.Random(5)
    rows = []
    for i in range(900):
        url = rng.choice(["http://hot.example/"] * 4 + [f"http://h{rng.randrange(40)}.example/{rng.randrange(2)}", None])
        kind = rng.choice(["response", "revisit"])
        v = str(rng.randrange(3))
        headers = rng.choice([{"etag": v, "date": f"d{i}", "content-type": f"t{i}"}, {"ETag": v, "LAST-Modified": f"l{i}"}, {"Last-modified": v, "vary": None}, {"x": "1", " X": "2", "Vary": "a", "vary": "b"}, {}, None])
        rows.append((i, url, rng.choice([None, *range(300)]) if i % 9 else rng.randrange(300), kind, headers, rng.choice([v, None])))
    df = spark.createDataFrame(rows, "capture_id long, url string, at long, kind string, headers map<string,string>, digest string")
    got = {r["capture_id"]: r for r in revisit.resolve_revisits(df, scratch).collect()}
    lines = defaultdict(list)
    for r in rows:
        lines[r[1]].append(r)
    n = 0
    for url, line in lines.items():
        last = None
        for i, _, _, kind, headers, digest in sorted(line, key=lambda r: (r[2] is not None, r[2], r[0])):
            headers = plain_headers(headers)
            if kind == "response":
                last = (i, headers or {}, digest)
                continue
            g, mine = got[i], headers or {}
            n += 1
            if url is None or last is None:
                assert (g["status"], g["original_id"], g["digest"]) == ("no_original", None, digest)
                continue
            assert g["original_id"] == last[0]
            ok = last[1].get("etag") == mine["etag"] if mine.get("etag") else last[1].get("last-modified") == mine["last-modified"] if mine.get("last-modified") else digest == last[2]
            assert g["status"] == ("resolved" if ok else "validator_mismatch")
            allowed = {*revisit.PERMITTED_HEADERS} | ({"last-modified"} if mine.get("etag") is None else set())
            want = last[1] | {k: v for k, v in mine.items() if k in allowed and v is not None} if ok else mine
            assert g["headers"] == want and g["digest"] == (last[2] if ok else digest)
    assert n == len(got)
    assert revisit.resolve_revisits(empty(df), scratch).count() == 0


# ---- 5 Ogg


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=3000))
def test_ogg_round_trip(text):
    payload, n = ogg.payload_of(text)
    assert len(payload) % ogg.UNIT == 0 and payload[:n].decode() == text and set(payload[n:]) <= {32}
    data = ogg.write_ogg(payload)
    assert ogg.read_ogg(data)[0] == payload and ogg.write_ogg(payload) == data


def test_ogg_checksum_bit_by_bit():
    def slow(data):
        r = 0
        for x in data:
            r ^= x << 24
            for _ in range(8):
                r = (r << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if r >> 31 else r << 1
        return r

    for data in (b"", b"a", b"OggS" + bytes(range(256)) * 3):
        assert ogg.page_checksum(data) == slow(data)


def test_ogg_damage_is_found():
    data = ogg.write_ogg(ogg.payload_of("some text " * 5000)[0])
    for at in range(0, len(data), 997):
        with pytest.raises(ValueError):
            ogg.read_ogg(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
    for end in (1, 30, len(data) - 1):
        with pytest.raises(ValueError):
            ogg.read_ogg(data[:end])


def test_ogg_packets_over_page_borders():
    """Packets that go on over pages, one of a multiple of 255 bytes, and timestamps from the granule positions."""
    a, b = b"x" * 700, b"y" * 510
    lacing = ogg._lacing(700) + ogg._lacing(510)
    body = a + b
    cut = 2  # the first page ends within the first packet
    first = ogg._page(ogg.FIRST, -1, 5, 0, lacing[:cut], body[:510])
    rest = ogg._page(ogg.CONTINUED | ogg.LAST, 1210, 5, 1, lacing[cut:], body[510:])
    s = ogg.demultiplex(first + rest)[5]
    assert s["packets"] == [a, b] and s["times"] == [(0, 700), (700, 1210)] and s["granule"] == 1210


def test_ogg_odd_rows(spark):
    df, rows = odd_documents(spark)
    got = ogg.to_ogg(df).toPandas()
    assert len(got) == len(rows)
    want = Counter(hashlib.sha256(ogg.payload_of(r[1])[0]).hexdigest() for r in rows)
    assert Counter(got.payload_sha256) == want
    assert all(hashlib.sha256(m).hexdigest() == h and len(m) == n for m, h, n in zip(got.media, got.media_sha256, got.media_bytes))
    assert got.groupby("payload_sha256").media_sha256.nunique().max() == 1
    assert ogg.to_ogg(empty(df)).count() == 0


# ---- 6 and 8 tokens


def brute_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [np.array([*e.ids, 1], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_encoder_against_the_library():
    rng = random.Random(2)
    texts = ["", "It'll 's 're foo_bar--baz 12.5€", "<|endoftext|> x", "straße İstanbul ﬁ x́ Ωσς", " ".join(map(chr, range(1, 0x250))), "é \u0085   \x1c a"]
    texts += ["".join(chr(rng.choice([rng.randrange(1, 127), rng.randrange(0xC0, 0x180), rng.randrange(0x300, 0x500), 39, 32])) for _ in range(120)) for _ in range(400)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xC0, 0x180), 39, 32])) for _ in range(120)) for _ in range(400)]
    enc = tokens.encoder(PATH)
    for t, want in zip(texts, brute_ids(texts)):
        assert np.array_equal(np.frombuffer(enc.ids(t), enc.dtype), want[:-1]), t


def test_encoder_forgets_words_when_there_are_many(monkeypatch):
    monkeypatch.setattr(tokens, "MAX_WORDS", 10)
    enc = tokens.Encoder(PATH)
    texts = [f"word{i} other thing{i}" for i in range(50)]
    assert all(np.array_equal(np.frombuffer(enc.ids(t), enc.dtype), w[:-1]) for t, w in zip(texts, brute_ids(texts)))
    assert len(enc.words) <= 15


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-(2**40), 2**40)), st.lists(st.integers(0, 65535), max_size=50)), max_size=40), st.integers(1, 100))
def test_seekable_file_round_trip(docs, frame_ids):
    import io

    import zstandard

    rows = [(k, np.array(v, "<u2").tobytes()) for k, v in docs]
    data = zframes.write_file(rows, "<u2", frame_ids=frame_ids)
    f = zframes.SeekableFile(data)
    assert len(f) == len(rows)
    for i in reversed(range(len(rows))):
        key, ids = f.document(i)
        assert key == rows[i][0] and ids.tobytes() == rows[i][1]
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert plain == b"".join(r[1] for r in rows)
    for key in {k for k, _ in rows if k is not None}:
        assert [x.tobytes() for x in f.find(key)] == [v for k, v in rows if k == key]


def test_seekable_file_reads_only_the_frames_it_needs():
    import zstandard

    data = zframes.write_file([(i, np.full(100, i, "<u2").tobytes()) for i in range(50)], "<u2", frame_ids=200)
    f = zframes.SeekableFile(data)
    bad = bytearray(data)
    bad[int(f.starts[10]) + 8] ^= 255
    g = zframes.SeekableFile(bytes(bad))
    assert g.find(3)[0].tolist() == [3] * 100
    with pytest.raises((ValueError, zstandard.ZstdError)):
        g.document(20)


def test_token_files_odd_rows(spark, scratch, monkeypatch):
    df, rows = odd_documents(spark)
    for size in (zframes.FILE_IDS, 20):
        tok = tokens.tokenize(zframes.ascending(df), PATH)
        files = zframes.write_files(tok, scratch, "<u2", file_ids=size)
        got = zframes.read_files(files).toPandas().sort_values("start")
        ids = brute_ids([r[1] for r in rows])
        assert Counter(got.ids_crc32) == Counter(zframes.crc_of_ids(x) for x in ids)
        assert got.start.tolist() == [0, *np.cumsum(got.n_tokens)[:-1]] and got.n_tokens.sum() == sum(map(len, ids))
        keys = got.doc_id.tolist()
        assert np.isnan(keys[:2]).all() and keys[2:] == sorted(keys[2:])
        picked = zframes.read_documents(files, [1, 8, 99]).collect()
        assert Counter((r["doc_id"], r["ids"]) for r in picked) == Counter((r[0], x.tobytes()) for r, x in zip(rows, ids) if r[0] in (1, 8))
    assert zframes.read_files(zframes.encode_corpus(empty(df), scratch, PATH)).count() == 0


def test_only_the_files_and_frames_asked_for_are_read(spark, scratch):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("word "), F.col("id").cast("string")), 30).alias("text"))
    files = zframes.write_files(tokens.tokenize(zframes.ascending(docs), PATH), scratch, "<u2", file_ids=20_000)
    got = zframes.read_documents(files, [17, 3990])
    plan = got._jdf.queryExecution().toString()
    assert "LessThanOrEqual(first_doc,3990)" in plan.split("PushedFilters: ")[1]
    rows = got.collect()
    ids = dict(zip((17, 3990), brute_ids(["word 17" * 30, "word 3990" * 30])))
    assert {r["doc_id"]: r["ids"] for r in rows} == {k: v[:].tobytes() for k, v in ids.items()}
    whole = files.agg(F.sum(F.octet_length("data"))).first()[0]
    may = files.where("(first_doc <= 17 and last_doc >= 17) or (first_doc <= 3990 and last_doc >= 3990)").count()
    assert files.count() > 10 and may == 2 and sum(r["frame_bytes"] for r in rows) < whole / 4
    assert zframes.read_documents(files, []).count() == 0
    assert zframes.read_documents(files, range(100, 300)).count() == 200


def test_packing_odd_rows(spark, scratch):
    df, rows = odd_documents(spark)
    lengths = defaultdict(list)
    for r, ids in zip(rows, brute_ids([r[1] for r in rows])):
        lengths[r[0]].append(len(ids))
    got = packing.pack(df, scratch, PATH, with_ids=True).collect()
    check_packing(got, lengths)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in got)
    assert packing.pack(empty(df), scratch, PATH).count() == 0


def test_packing_does_not_depend_on_the_order_of_rows(spark, scratch):
    docs = table(spark, DATA, "documents").select("doc_id", "text")
    docs = docs.unionByName(docs.where("doc_id < 20")).unionByName(docs.where("doc_id < 9").withColumn("doc_id", F.lit(3).cast("long")))
    orders = (docs, docs.orderBy(F.desc("doc_id")), docs.repartition(7, "text"), docs.orderBy(F.xxhash64("text")).coalesce(1))
    one, *others = (Counter(map(tuple, packing.pack(scratch.save(d), scratch, PATH).collect())) for d in orders)
    assert all(x == one for x in others) and sum(one.values()) > docs.count()


@pytest.mark.parametrize("seed", range(4))
def test_packing_plans(spark, scratch, seed):
    rng = np.random.default_rng(seed)
    sizes = [rng.integers(1, 700, 900), rng.geometric(0.002, 600), np.full(500, 700), np.concatenate([np.full(50, 2048), rng.integers(1, 10000, 80), np.ones(300, int)])][seed]
    df = scratch.save(spark.createDataFrame([(int(i), int(n)) for i, n in enumerate(sizes)], "uid long, n_tokens long"))
    got = packing.plan_pieces(df, scratch).select(F.col("uid").alias("doc_id"), "start", F.col("n").alias("length"), "sequence_id", "offset").collect()
    check_packing(got, {i: [int(n)] for i, n in enumerate(sizes)})
    assert len({r["sequence_id"] for r in got}) == -(-int(sizes.sum()) // 2048)
    whole = Counter(r["doc_id"] for r in got)
    cut = sum(whole[i] > -(-int(n) // 2048) for i, n in enumerate(sizes))
    assert cut <= max(20, 0.5 * len(sizes))


def test_patterns_against_small_cases():
    sizes, demand = np.array([3, 5, 7]), np.array([40, 20, 10])
    out = packing.choose_patterns(sizes, demand, 15)
    used = sum(u * c for u, c in out)
    assert (used <= demand).all() and all(c @ sizes <= 15 for _, c in out)
    assert sum(u for u, _ in out) >= (demand @ sizes) // 15 - 4
    value, counts = packing.best_pattern(np.array([1.0, 2.1, 2.9]), sizes, 15)
    best = max(a + 2.1 * b + 2.9 * c for a in range(6) for b in range(4) for c in range(3) if 3 * a + 5 * b + 7 * c <= 15)
    assert np.isclose(value, best) and counts @ sizes <= 15


# ---- 7 SimHash


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB cD\t\né\x0b\xa0.z "), max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_simhash(text)


def near_values(rng, n, spread, bits=64):
    base = rng.integers(0, 2**64, max(1, n // spread), dtype=np.uint64)
    out = base[rng.integers(0, len(base), n)]
    for _ in range(3):
        flip = np.uint64(1) << rng.integers(0, bits, n).astype(np.uint64)
        out = np.where(rng.random(n) < 0.6, out ^ flip, out)
    return np.unique(out)


def test_bucket_comparison():
    rng = np.random.default_rng(1)
    for n in (2, 30, 65, 200, 700):
        v = near_values(rng, n, 20)
        want = groups(v.tolist())
        got = simhash.bucket_roots(v, range(64))
        assert got.tolist() == [want[x] for x in v.tolist()]


@pytest.mark.parametrize("split", [simhash.SPLIT, 40])
def test_components_against_all_pairs(spark, scratch, split):
    rng = np.random.default_rng(2)
    v = np.unique(np.concatenate([near_values(rng, 900, 12), near_values(rng, 300, 300), near_values(rng, 250, 250, 12), np.array([0, 1, 3, 2**63], np.uint64)]))
    df = scratch.save(spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long").repartition(4))
    links = simhash.links_between(df, scratch, split)
    comps = {r["node"] & simhash.FULL: r["root"] & simhash.FULL for r in simhash.components(links, scratch).collect()}
    want = groups(v.tolist())
    by_want, by_got = defaultdict(set), defaultdict(set)
    for x in v.tolist():
        by_want[want[x]].add(x)
        by_got[comps.get(x, x)].add(x)
    assert sorted(map(sorted, by_want.values())) == sorted(map(sorted, by_got.values()))


def test_near_duplicates_odd_rows(spark, scratch):
    df, rows = odd_documents(spark)
    got = simhash.near_duplicates(df, scratch).toPandas()
    fps = [brute_simhash(r[1]) for r in rows]
    root = groups(fps)
    low = {}
    for r, f in zip(rows, fps):
        low.setdefault(root[f], set()).add(r[0])
    want = Counter((r[0], f, min((x for x in low[root[f]] if x is not None), default=None)) for r, f in zip(rows, fps))
    as_int = lambda x: None if x is None or np.isnan(x) else int(x)
    assert Counter((as_int(a), int(b) & simhash.FULL, as_int(c)) for a, b, c in zip(got.doc_id, got.fp, got.component_id)) == want
    assert simhash.near_duplicates(empty(df), scratch).count() == 0


# ---- 10 decontamination


def items_frame(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def random_corpus(seed, n=300):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "Ünter", "12", "a"]
    say = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    items = [(i, say(rng.choice([0, 1, 3, 12, 13, 14, 40]))) for i in range(25)] + [(3, say(30)), (None, say(20)), (77, None), (78, "...")]
    docs = []
    for _ in range(n):
        t = say(rng.randrange(0, 30))
        for _ in range(rng.randrange(0, 3)):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randrange(0, len(w) + 1)
            t += rng.choice([" ", ". ", "-"]) + " ".join(w[a : a + rng.randrange(1, 40)]).upper()
        docs.append(t)
    return docs, items


@pytest.mark.parametrize("limit", [decontam.MAX_BROADCAST, 400])
def test_decontamination_against_brute_force(spark, scratch, limit, monkeypatch):
    monkeypatch.setattr(decontam, "SHARD_WORDS", 500)
    docs, items = random_corpus(1)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontam.report(df, items_frame(spark, items), scratch, limit).collect()}
    for i, (n, hit, found) in enumerate(contamination(docs, items)):
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, hit, len(found)), i
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n)
    kept = decontam.keep_uncontaminated(df, items_frame(spark, items), scratch, limit)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["contaminated"]}


def test_suffix_array_orders_suffixes():
    rng = np.random.default_rng(0)
    for n in (0, 1, 50, 400):
        text = rng.integers(0, 4, n).astype(np.int32)
        order = decontam.suffix_array(text, 13)
        cut = [tuple(text[i : i + 13]) for i in order]
        assert cut == sorted(cut) and sorted(order.tolist()) == list(range(n))


def test_longest_matches(spark):
    item = " ".join(f"k{i}" for i in range(40))
    docs = [(0, "x " + " ".join(f"k{i}" for i in range(5, 30)) + " y"), (1, " ".join(f"k{i}" for i in range(12))), (2, item + " . " + item)]
    got = decontam.matches(spark.createDataFrame(docs, "doc_id long, text string"), items_frame(spark, [(9, item)])).collect()
    assert sorted((r["doc_id"], r["item_id"], r["doc_word"], r["n_words"]) for r in got) == [(0, "9", 1, 25), (2, "9", 0, 40), (2, "9", 40, 40)]


@pytest.mark.parametrize("limit", [decontam.MAX_BROADCAST, 1500])
def test_longest_match_against_all_places(spark, scratch, limit):
    docs, items = random_corpus(4)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r["doc_id"]: r["longest_match"] for r in decontam.report(df, items_frame(spark, items), scratch, limit).collect()}
    texts = [[w.translate(LOWER) for w in WORD.findall(t.translate(LOWER))] for _, t in items if t]
    for i, d in enumerate(docs):
        w, best = WORD.findall(d.translate(LOWER)), 0
        for t in texts:
            size = min(13, len(t))
            for p in range(len(w)):
                for q in range(len(t) - size + 1) if size else ():
                    k = 0
                    while p + k < len(w) and q + k < len(t) and w[p + k] == t[q + k]:
                        k += 1
                    best = max(best, k if k >= size else 0)
        assert got[i] == best, i


def test_a_common_line_costs_no_row_for_each_item_and_document():
    line = " ".join(f"k{i}" for i in range(30))
    bench = decontam.Benchmark([(f"{i:04d}", f"a{i} b{i} {line} c{i}") for i in range(300)])
    assert len(bench.class_items) < 2 * 300 + 2 and len(bench.first) - 1 == 18 + 300 * 3
    shard = decontam.Shard([decontam.words_of(f"x{i} {line} a{i}") for i in range(3000)], bench)
    assert (shard.longest(bench) == 30).all() and all(len(c) == 1 for c in shard.classes(bench))
    assert len(shard.place) == 3000 * 18 and len(bench.items_of(shard.classes(bench)[7])) == 300


def test_decontamination_odd_rows(spark, scratch):
    df, rows = odd_documents(spark)
    items = items_frame(spark, [(1, "quick brown fox"), (2, None), (3, ""), (None, "without a number"), (4, "lorem ipsum dolor " * 3)])
    got = decontam.report(df, items, scratch).toPandas()
    assert len(got) == len(rows)
    assert got[got.n_words == 0].contaminated.sum() == 0
    assert got.contaminated.sum() == 4
    clash = df.withColumns({n: F.lit(n) for n in ("__uid", "doc", "uid")})
    for limit in (decontam.MAX_BROADCAST, 20):
        kept = decontam.keep_uncontaminated(clash, items, scratch, limit)
        assert kept.columns == clash.columns and kept.count() == len(rows) - 4 and kept.where("__uid <> '__uid'").count() == 0
    assert decontam.report(df, empty(items), scratch).where("contaminated or n_items > 0").count() == 0
    assert decontam.report(empty(df), items, scratch).count() == 0


# ---- whole tables


def test_queries_on_the_drivers_tables(spark):
    docs = table(spark, DATA, "documents").toPandas().set_index("doc_id").text.to_dict()
    q = queries.queries()
    ids = dict(zip(docs, brute_ids(docs.values())))
    got = q["op6_zstd_seekable"](spark, DATA).toPandas().set_index("doc_id")
    at = 0
    for k in sorted(docs):
        assert tuple(got.loc[k, ["start", "n_tokens", "ids_crc32"]]) == (at, len(ids[k]), zframes.crc_of_ids(ids[k]))
        at += len(ids[k])
    rows = q["op8_pack_cutting_stock"](spark, DATA).collect()
    check_packing(rows, {k: [len(v)] for k, v in ids.items()})
    for r in rows:
        assert zframes.crc_of_ids(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
    fps = {k: brute_simhash(t) for k, t in docs.items()}
    root = groups(fps.values())
    low = {}
    for k in sorted(docs):
        low.setdefault(root[fps[k]], k)
    for r in q["op7_simhash_components"](spark, DATA).collect():
        assert r["fingerprint"] == f"{fps[r['doc_id']]:016x}" and r["component_id"] == low[root[fps[r["doc_id"]]]]
    for r in q["op5_ogg_pages"](spark, DATA).collect():
        payload, n = ogg.payload_of(docs[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


def test_few_links_are_joined_as_many_are(spark, scratch, monkeypatch):
    """The same components either way; the few need no table for each step."""
    rng = random.Random(5)
    links = [(a, rng.randrange(a - 3, a + 1) * rng.choice([1, -1])) for a in range(0, 120, 2)] + [(i + 1000, i + 1001) for i in range(40)] + [(-(2**63), 2**63 - 1)]
    links = scratch.save(spark.createDataFrame(links, "a long, b long"))
    want = sorted(map(tuple, simhash.components(links, scratch, few=0).collect()))
    assert len(want) > 90 and len({r for _, r in want}) > 2
    assert simhash.components(links.where("a = 5000"), scratch).count() == 0
    saved, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name="t", **o: (saved.append(name), save(self, df, name, **o))[1])
    assert sorted(map(tuple, simhash.components(links, scratch).collect())) == want and not saved
