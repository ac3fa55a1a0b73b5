"""Operators that SQL cannot express, against brute force, exact round trips and held-out labels."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textprov.llm import queries as Q
from textprov.llm.fingerprint import added, as_text, fingerprint, likeness, removed
from textprov.llm.jaccard_join import near_duplicates, one_of_each, runs_for
from textprov.llm.kneser_ney import classified, perplexities, trust
from textprov.llm.sentencepiece_codec import Codec, decoded, encoded, parse_model
from textprov.llm.token_files import read_metadata, read_tokens, write_tokens
from textprov.llm.toxicity import accepted, fit, scores
from textprov.llm.url_templates import host_of, judged, path_of, rule_of

from .conftest import LONG, PASSAGE, SF, WORDS, path

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text):
    return WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))


# --- n-gram Jaccard join -----------------------------------------------------------------------------------------

def brute_join(rows, threshold=0.8):
    sets = [frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else None for w in (words_of(t) for _, t in rows)]
    texts = {s: n for n, s in enumerate(dict.fromkeys(s for s in sets if s))}
    root, links, known = {s: s for s in texts}, Counter(), list(texts)

    def top(s):
        while root[s] is not s:
            s = root[s]
        return s

    for a in range(len(known)):
        for b in range(a):
            x, y = known[a], known[b]
            if len(x & y) >= threshold * len(x | y):
                links[x] += 1
                links[y] += 1
                root[top(x)] = top(y)
    least, copies = {}, Counter(s for s in sets if s)
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            least[top(s)] = min(i, least.get(top(s), i))
    return [(i, least.get(top(s)) if s else i, links[s] if s else 0, copies[s] if s else None) for (i, _), s in zip(rows, sets)]


def same_join(rows, got):
    want = Counter((a, b, c) for a, b, c, _ in brute_join(rows))
    return want == Counter((r.doc_id, r.class_id, r.n_links) for r in got)


def test_join_equals_brute_force(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert same_join(rows, near_duplicates(documents).collect())


@pytest.mark.parametrize("limit", [4000, 8])
def test_join_of_near_copies(spark, limit):
    """Groups of edited copies around the threshold; a low limit forces splits by chosen paths and by blocks."""
    rnd, rows = random.Random(3), []
    for g in range(6):
        base = [f"g{g}w{rnd.randrange(10**6)}" for _ in range(120)]
        for _ in range(120 if g == 0 else 12):
            text = list(base)
            for _ in range(rnd.randrange(5)):
                text[rnd.randrange(120)] = f"new{rnd.randrange(10**6)}"
            rows.append((len(rows), " ".join(text)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), limit=limit).collect()
    assert same_join(rows, got)


def test_join_cases(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = near_duplicates(odd).collect()
    assert same_join(rows, got) and near_duplicates(empty).count() == 0
    kept = one_of_each(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([1, 2, 3, 4, 5, 8, 9, 9, 12, 13, None, None], key=str)  # 6, 7, 10, 11 go; 9 has two texts
    assert runs_for(0.99, 0.8) < runs_for(0.999999, 0.8)


def test_one_of_each_of_ids_with_two_texts(spark):
    """The clean text of an id stays when its other text is a copy, and so does a class whose least id it has."""
    text = lambda k: " ".join(f"{w}{k}" for w in WORDS)
    rows = [(1, text(1)), (2, text(1)), (2, text(2)), (3, text(3)), (4, text(3)), (4, text(4)), (5, text(4)), (6, text(4))]
    kept = one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, text(1)), (2, text(2)), (3, text(3)), (4, text(4))]


# --- url filters -------------------------------------------------------------------------------------------------

def test_url_parts_and_rules(spark):
    urls = ["http://A.B.Net/en/x?q#f", "no scheme", None, "", "x://h", "https://u:p@Ünet.com:80/p/a?b://c/d", "a://b://c/d", "http://example.net/en/1", "http://www.example.net/de/1", "http://badexample.net/en/1", "ftp://org/fr/", "http://x.org/fr", "http://net", "http://h\n/é/\ny"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").select("page_id", host_of(F.col("url")).alias("h"), path_of(F.col("url")).alias("p"))
    rule, verdict = rule_of(F.col("h"), F.col("p"), [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")])
    got = {r.page_id: (r.h, r.p, r.rule, r.verdict) for r in df.select("*", rule.alias("rule"), verdict.alias("verdict")).collect()}
    assert got[0] == ("a.b.net", "/en/x", "net/", "block") and got[1] == got[2] == got[3] == ("", "", None, None)
    assert got[4] == ("h", "", None, None) and got[5][:2] == ("u:p@Ünet.com:80", "/p/a") and got[6][:2] == ("b:", "//c/d")
    assert got[7][2:] == ("example.net/en/", "allow") and got[8][2:] == ("net/", "block") and got[9][2:] == ("net/", "block")
    assert got[10][2:] == ("org/fr/", "allow") and got[11][2:] == (None, None) and got[12] == ("net", "", None, None) and got[13][:2] == ("h\n", "/é/\ny")


def brute_templates(pages, good, depth=6):
    parts = {i: [s for s in p.split("/") if s] for i, (_, p) in pages.items()}
    made = {i: [] for i in pages}
    for k in range(depth):
        counts = defaultdict(Counter)
        for i, (h, _) in pages.items():
            if len(parts[i]) > k:
                counts[h, tuple(made[i])][parts[i][k]] += 1
        step = {}
        for i, (h, _) in pages.items():
            if len(parts[i]) > k:
                c, s = counts[h, tuple(made[i])], parts[i][k]
                ext = re.search(r"\.[A-Za-z][A-Za-z0-9]{0,4}\Z", s)
                step[i] = s if c[s] >= 5 and c[s] >= 0.02 * sum(c.values()) else "*" + (ext[0] if ext else "")
        for i, s in step.items():
            made[i] = made[i] + [s]
    for i in pages:
        if len(parts[i]) > depth:
            made[i] = made[i] + ["**"]
    n, g = len(good), sum(good.values())
    share = {i: (g + 1) / (n + 2) for i in pages}
    for k in range(depth + 2):
        nodes = defaultdict(list)
        for i, (h, _) in pages.items():
            if len(made[i]) >= k:
                nodes[h, tuple(made[i][:k])].append(i)
        for members in nodes.values():
            known = [good[i] for i in members if i in good]
            p = share[members[0]]
            if known and abs(sum(known) / len(known) - p) >= 3 * math.sqrt(p * (1 - p) / len(known)):
                for i in members:
                    share[i] = (sum(known) + 10 * p) / (len(known) + 10)
    return {i: ("/" + "/".join(made[i]), share[i]) for i in pages}


def test_templates_equal_brute_force(spark):
    rnd, rows, labels = random.Random(5), [], []
    for i in range(900):
        host = rnd.choice(["a.com", "a.com", "a.com", "b.org", "c.net"])
        kind = rnd.choice(["news", "spam", "shop"])
        url = f"http://{host}/{kind}/{rnd.choice(['x', 'y'])}/{rnd.randrange(10**6)}" + rnd.choice(["", ".html", "/a/b/c/d/e"])
        rows.append((i, rnd.choice([url, url, url, f"http://{host}", None]) if i % 9 == 0 else url))
        if rnd.random() < 0.6:
            labels.append((i, int(rnd.random() < (0.05 if kind == "spam" else 0.9))))
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("template", F.lit(1)).withColumn("part", F.lit(1))
    got = {r.page_id: r for r in judged(pages, spark.createDataFrame(labels + [(None, 1), (5000, 0), (1, None)], "page_id long, good int")).collect()}
    want = brute_templates({i: (r.host, r.path) for i, r in got.items()}, dict(labels))
    assert len(got) == 900
    for i, r in got.items():
        assert r.template == want[i][0] and r.purity == pytest.approx(want[i][1]) and r.rejected == (want[i][1] < 0.5)
    assert any(r.rejected for r in got.values()) and not all(r.rejected for r in got.values())
    assert judged(pages.limit(0), spark.createDataFrame([], "page_id long, good int")).count() == 0


def test_small_and_deep_sections_are_judged(spark, monkeypatch):
    """A bad section with less than 2 % of its host, and one below six segments, beside good siblings."""
    from textprov.llm import query_url as one

    places = [(f"h.com/s{i}", i != 7) for i in range(80) for _ in range(30)] + [(f"d.com/a/b/c/d/e/f/{x}", x == "good") for x in ("good", "bad") for _ in range(60)]
    tables = {
        "pages": spark.createDataFrame([(n, f"http://{place}/{n}") for n, (place, _) in enumerate(places)], "page_id long, url string"),
        "labels": spark.createDataFrame([(n, int(good)) for n, (_, good) in enumerate(places)], "doc_id long, quality int"),
    }
    monkeypatch.setattr(one, "table", lambda spark, folder, name, *columns: tables[name].select(*columns))
    got = {r.page_id: r.verdict for r in one.op2_url_filter(spark, "").collect()}
    assert got == {n: "allow" if good else "block" for n, (_, good) in enumerate(places)}


# --- token files -------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_round_trip(spark, odd, empty, tmp_path, encoding):
    from tokenizers import Tokenizer

    model = path("byte_bpe_50k.json")
    rnd = random.Random(2)
    strange = ["".join(rnd.choice("ab  \n\t.é'1!\x1c\x0b 你😀") for _ in range(rnd.randrange(80))) for _ in range(300)]
    docs = odd.select("doc_id", "text", "ids", "part").union(spark.createDataFrame([(100 + i, t, "", "") for i, t in enumerate(strange)], "doc_id long, text string, ids string, part string"))
    out = f"{tmp_path}/{encoding}"
    write_tokens(docs, out, model, end_id=0, encoding=encoding, partitions=3)
    got = read_tokens(spark, out).orderBy("start").collect()
    tokenizer, start = Tokenizer.from_file(model), 0
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1].encode()))
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    for r, (_, text) in zip(got, rows):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
        assert r.ids == ids and r.n_tokens == len(ids) and r.start == start
        start += len(ids)
    meta = read_metadata(spark, out)
    assert sorted(map(tuple, meta.collect()), key=str) == sorted(((r.doc_id, r.start, r.n_tokens) for r in got), key=str)
    assert "ids" not in meta._jdf.queryExecution().executedPlan().toString()
    write_tokens(empty, f"{tmp_path}/none-{encoding}", model, encoding=encoding)
    assert read_tokens(spark, f"{tmp_path}/none-{encoding}").count() == 0


def test_token_query(spark, documents):
    from tokenizers import Tokenizer

    tokenizer, start = Tokenizer.from_file(path("byte_bpe_50k.json")), 0
    got = {r.doc_id: r for r in Q.QUERIES["op3_token_files"](spark, SF).collect()}
    for doc_id, text in sorted(map(tuple, documents.select("doc_id", "text").collect())):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
        assert tuple(got[doc_id]) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


# --- sentencepiece -----------------------------------------------------------------------------------------------

def test_sentencepiece_parity(spark, odd, empty):
    import sentencepiece

    model = path("piece_bpe_32k.model")
    library, own, rnd = sentencepiece.SentencePieceProcessor(model_file=model), Codec(model), random.Random(1)
    texts = ["".join(rnd.choice("ab  \n▁é.th!你") for _ in range(rnd.randrange(60))) for _ in range(2000)] + ["", " ", "<s> </s><unk>", "a" * 5000]
    ids = own.encode(texts)
    assert [x.tolist() for x in ids] == library.encode(texts) and own.decode(ids) == [library.decode(x.tolist()) for x in ids]
    out = encoded(odd, model, verify=True)
    rows = out.collect()
    assert len(rows) == odd.count() and all(r.parity for r in rows) and all(r.round_trip for r in rows)
    back = {r.doc_id: r.text for r in decoded(out.filter("doc_id <> 9"), model).collect()}
    assert all(back[r.doc_id] == (r.text or "") for r in odd.filter("doc_id <> 9").collect())
    assert encoded(empty, model).count() == 0


def test_unigram_model(tmp_path):
    """A unigram model with a character map is rebuilt from its protobuf, too."""
    def field(n, kind, data):
        return bytes([n << 3 | kind]) + data

    def message(n, data):
        return field(n, 2, bytes([len(data)]) + data if len(data) < 128 else bytes([len(data) & 127 | 128, len(data) >> 7]) + data)

    import struct

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(f"<0x{i:02X}>", 0.0, 6) for i in range(256)], ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.0, 1), ("ab", -2.5, 1), ("▁ab", -1.5, 1)]
    data = b"".join(message(1, message(1, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([t]))) for p, s, t in pieces)
    data += message(2, field(3, 0, b"\x01") + b"\x98\x02\x01") + message(3, field(3, 0, b"\x01") + field(4, 0, b"\x00"))
    file = tmp_path / "unigram.model"
    file.write_bytes(data)
    assert parse_model(data).kind == 1 and parse_model(data).byte_fallback
    own = Codec(str(file))
    names = [[pieces[i][0] for i in x] for x in own.encode(["ab abb", "é", ""])]
    assert names == [["▁ab", "▁ab", "b"], ["▁", "<0xC3>", "<0xA9>"], []] and own.decode(own.encode(["ab abb", "é"])) == ["ab abb", "é"]


# --- toxicity ----------------------------------------------------------------------------------------------------

def test_toxicity_on_held_out(spark):
    rnd, rows, labels = random.Random(4), [], []
    for i in range(600):
        text = [rnd.choice(WORDS) + rnd.choice(WORDS) for _ in range(rnd.randrange(5, 60))]
        bad = i % 4 == 0
        if bad:
            text[rnd.randrange(len(text))] = rnd.choice(["rotten", "horrid"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (9999, 1), (3, None), (5, 7)], "doc_id long, toxic int")
    model = fit(docs, known, train=F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r.score for r in scores(docs, model).collect()}
    right = sum((got[i] >= 0.5) == bool(b) for i, b in labels if i % 5 == 0)
    assert right >= 0.97 * 120 and all(0 <= s <= 1 for s in got.values())
    assert {r.doc_id for r in accepted(docs, model).collect()} == {i for i, s in got.items() if s < 0.5}


def test_toxicity_cases(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = fit(odd, none)
    got = scores(odd, model).collect()
    assert len(got) == odd.count() and len({r.score for r in got}) == 1 and got[0].score < 0.5
    one = fit(odd, spark.createDataFrame([(1, 0), (1, 1), (5, 1)], "doc_id long, toxic int"))
    assert scores(odd, one).filter("score is null").count() == 0 and accepted(empty, one).count() == 0 and scores(empty, one).count() == 0
    assert accepted(odd, model).columns == odd.columns and accepted(odd, model).count() == odd.count()


# --- quality -----------------------------------------------------------------------------------------------------

def brute_perplexities(texts, train, order=4):
    def grams(t, k):
        s = [0] * (order - 1) + [b + 1 for b in t.encode()]
        return [tuple(s[i - k + 1:i + 1]) for i in range(order - 1, len(s))]

    counts = {order: Counter(g for t in train for g in grams(t, order))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    contexts, cuts = {}, {}
    for k, c in counts.items():
        n = [0, *[sum(v == j for v in c.values()) for j in (1, 2, 3, 4)]]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        d = cuts[k] = [0.0, *[min(float(j), max(0.05, j - (j + 1) * y * n[j + 1] / n[j])) if n[j] else 0.5 * j for j in (1, 2, 3)]]
        contexts[k] = defaultdict(lambda: [0, 0.0])
        for g, v in c.items():
            contexts[k][g[:-1]][0] += v
            contexts[k][g[:-1]][1] += d[min(v, 3)]

    def p(g):
        if not g:
            return 1 / 256
        k = len(g)
        if g[:-1] not in contexts[k]:
            return p(g[1:])
        total, spared = contexts[k][g[:-1]]
        v = counts[k][g]
        return (max(v - cuts[k][min(v, 3)], 0) + spared * p(g[1:])) / total

    return [2 ** (-sum(math.log2(p(g)) for g in grams(t, order)) / len(t.encode())) if t else None for t in texts]


def test_perplexity_equals_brute_force(spark, documents):
    docs = documents.filter("doc_id < 60")
    trusted = spark.createDataFrame([(i, i % 3 != 0) for i in range(0, 60, 2)] + [(None, True), (10**6, True)], "id long, trains boolean")
    got = {r.id: r for r in perplexities(docs, trusted, chunk_bytes=20_000).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_perplexities([t for _, t in rows], [t for i, t in rows if i % 2 == 0 and i % 3 != 0])
    for (i, t), w in zip(rows, want):
        assert got[i].perplexity == pytest.approx(w, rel=1e-6) and got[i].n_bytes == len(t.encode())


def test_quality_knows_words_and_their_order(spark, monkeypatch):
    """Text of usual letters is not kept if its words or their order are junk, in scripts without spaces too."""
    from textprov.llm import query_quality as one

    rnd, han, rows = random.Random(3), "天地玄黄宇宙洪荒日月盈昃辰宿列张", []
    phrases = [[rnd.choice(WORDS) for _ in range(6)] for _ in range(12)]
    signs = [[rnd.choice(han) for _ in range(6)] for _ in range(12)]
    for i in range(240):
        tokens, glue = [w for _ in range(20) for w in rnd.choice(phrases if i % 2 else signs)], " " if i % 2 else ""
        if i >= 200:
            rnd.shuffle(tokens)
        if i >= 220 and i % 2:
            tokens = ["".join(rnd.sample(w, len(w))) for w in tokens]
        rows.append((i, glue.join(tokens), "en" if i % 2 else "zh"))
    tables = {"documents": spark.createDataFrame(rows, "doc_id long, text string, lang string"), "labels": spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, quality int")}
    monkeypatch.setattr(one, "table", lambda spark, folder, name, *columns: tables[name].select(*columns))
    kept = {r.doc_id: r.keep for r in one.op7_quality(spark, "").collect()}
    assert np.mean([kept[i] for i in range(200)]) > 0.95 and not any(kept[i] for i in range(200, 240))


def test_quality_of_rows_that_are_dealt_anew_when_read(spark, documents):
    place = F.udf(lambda: random.randrange(1000), "int").asNondeterministic()
    docs = documents.filter("doc_id < 60").select("text", "lang", F.when(F.col("doc_id") % 4 > 0, F.col("doc_id")).alias("doc_id")).repartition(4, place())
    trusted = spark.createDataFrame([(i, i % 3 != 0) for i in range(0, 60, 2)], "id long, trains boolean")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_perplexities([t for _, t in rows], [t for i, t in rows if i is not None and i % 2 == 0 and i % 3 != 0])
    got = perplexities(docs, trusted, chunk_bytes=20_000).collect()
    as_rows = lambda found: sorted((-1 if i is None else i, n, round(p, 4)) for i, n, p in found)
    assert as_rows((r.id, r.n_bytes, r.perplexity) for r in got) == as_rows((i, len(t.encode()), w) for (i, t), w in zip(rows, want))


def test_quality_in_turns_and_shards(spark, documents, monkeypatch):
    """Many shards and turns give the brute-force model too, and leave no table behind."""
    from textprov.llm import kneser_ney as one

    monkeypatch.setattr(one, "SHARD_BYTES", 20_000)
    docs = documents.filter("doc_id < 60").withColumn("doc_id", F.when(F.col("doc_id") % 7 > 0, F.col("doc_id")))
    trusted = spark.createDataFrame([(i, i % 3 != 0) for i in range(0, 60, 2)], "id long, trains boolean")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_perplexities([t for _, t in rows], [t for i, t in rows if i is not None and i % 2 == 0 and i % 3 != 0], 3)
    before = {t.name for t in spark.catalog.listTables()}
    got = perplexities(docs, trusted, order=3, chunk_bytes=20_000, turn_bytes=20_000)
    as_rows = lambda found: sorted((-1 if i is None else i, n, round(p, 4)) for i, n, p in found)
    assert as_rows((r.id, r.n_bytes, r.perplexity) for r in got.collect()) == as_rows((i, len(t.encode()), w) for (i, t), w in zip(rows, want))
    assert {t.name for t in spark.catalog.listTables()} == before


def test_quality_keys_travel_in_few_bytes():
    """A sorted key takes under 7 bytes (a row of the word model took six longs), and comes back as it was."""
    from textprov.llm import kneser_ney as one

    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 64, 200_000, np.uint64, endpoint=False))
    packed = one._pack(keys, True)
    assert len(packed) < 7 * len(keys) and (one._unpack(packed, True) == keys).all()
    for few in (keys[:0], keys[:1], np.array([0, 0, 5], np.uint64), np.array([255, 256], np.uint64)):
        assert one._unpack(one._pack(few, True), True).tolist() == few.tolist() and one._unpack(one._pack(few[::-1])).tolist() == few[::-1].tolist()


def test_quality_cases(spark, odd, empty):
    trusted = spark.createDataFrame([(1, True), (7, False), (5, True), (None, True)], "id long, trains boolean")
    rows = classified(odd, trusted).collect()
    assert len(rows) == odd.count()
    by = {(r.doc_id, r.n_bytes): r for r in rows}
    assert by[3, 0].perplexity is None and not by[3, 0].keep and not by[2, 0].keep and by[1, len(PASSAGE) + 8].keep
    nothing = classified(odd, trusted.limit(0)).collect()
    assert all(r.perplexity == pytest.approx(256) and r.keep for r in nothing if r.n_bytes)
    assert classified(empty, trusted).count() == 0


def test_quality_query_separates(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = Q.QUERIES["op7_quality"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").collect()
    share = lambda q: np.mean([r.keep for r in rows if r.quality == q])
    assert share(1) > 0.95 and share(0) < 0.1


def test_trust(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    rows = trust(labels, "doc_id", F.col("quality") == 1).collect()
    assert len(rows) == 50 and all(r.trains == (zlib.crc32(str(r.id).encode()) % 5 != 0) for r in rows)


# --- fingerprints ------------------------------------------------------------------------------------------------

def brute_fingerprint(text):
    import xxhash

    h = lambda k, s: xxhash.xxh64(f"{k}:{s}".encode(), seed=42).intdigest()
    paragraphs = [p for p in (text or "").split("\n") if re.search(r"[^ \t\n\x0b\f\r]", p)]
    sentences = [s for p in paragraphs for s in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+", p)]
    exact = [sum(h(k, p) >> 32 * half & 0xFFFFFFFF for p in paragraphs) & 0xFFFFFFFF for k in range(4) for half in (0, 1)]
    packed = []
    for j in range(32):
        lanes = [sum((h(10, s) if j < 21 else h(11, s)) >> (3 * j if j < 21 else 3 * (j - 21)) + k & 1 for s in sentences) for k in range(3)]
        packed.append(lanes[0] | lanes[1] << 21 | lanes[2] << 42)
    return "".join(f"{v:016x}" for v in [*exact, len(sentences), *packed])


def test_fingerprints_equal_brute_force(spark, odd, documents):
    for df in (odd, documents):
        for r in df.select("text", as_text(fingerprint(F.col("text"))).alias("f")).collect():
            assert r.f == brute_fingerprint(r.text)


def test_fingerprints_are_homomorphic(spark):
    rows = [("a. b.\nc d\ne", "c d\ne\na. b.", "x\ny")]
    a, b, c = (fingerprint(F.col(k)) for k in "abc")
    both = fingerprint(F.concat_ws("\n", "a", "c"))
    got = spark.createDataFrame(rows, "a string, b string, c string").select(
        (a == b).alias("order"), (added(a, c) == both).alias("add"), (removed(both, c) == a).alias("remove"), likeness(a, b).alias("same"), likeness(a, c).alias("other"), likeness(fingerprint(F.lit("")), a).alias("none"),
    ).first()
    assert got["order"] and got["add"] and got["remove"] and got["same"] == 1.0 and got["other"] < 0.5 and got["none"] == 0.0


def test_fingerprint_query(spark, documents):
    rows = sorted(((r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()), reverse=True)
    got = {r.doc_id: r for r in Q.QUERIES["op10_fingerprint"](spark, SF).collect()}
    for k, (i, text) in enumerate(rows):
        following, m = rows[(k + 1) % len(rows)][1], len(text) // 3
        edited = text[:len(text) - m] + following[:m]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].fingerprint == brute_fingerprint(text) and got[i].edited_fingerprint == brute_fingerprint(edited)
    assert np.mean([r.near_edited for r in got.values()]) > 0.5 > 0.1 > np.mean([r.near_next for r in got.values()])


def test_neighbours_of_odd_rows(spark, odd, empty):
    from textprov.llm.neighbours import bucket_order, in_buckets

    def following(df):
        return in_buckets(df).withColumn("next", F.lead("text").over(bucket_order())).filter("not ghost").select("id", "text", "next").collect()

    got = following(odd)
    assert len(got) == odd.count() and all(r.next is not None for r in got) and following(empty) == []
    ids = spark.createDataFrame([(i, str(i)) for i in (5, 3000, 10**12, -7, 2999, 1023, 1024)], "doc_id long, text string")
    assert {r.text: r.next for r in following(ids)} == {"1000000000000": "3000", "3000": "2999", "2999": "1024", "1024": "1023", "1023": "5", "5": "-7", "-7": "1000000000000"}
    assert [r.next for r in following(ids.filter("doc_id = 5"))] == ["5"]
    assert LONG in {r.next for r in got}
