"""Reversed search, prefix trie and speculative byte-pair encoding against brute force and the tokenizers library."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textprov.llm import queries as Q
from textprov.llm.prefix_trie import Trie, end_digests, placed, rebuilt
from textprov.llm.reversed_search import BLOCK_POSTINGS, blocks_of, item_postings, ranked
from textprov.llm.speculative_bpe import Vocabulary, decoded, encoded, encoder, load

from .conftest import LONG, PASSAGE, SF, path
from .test_python import words_of

# --- ranked lexical search ---------------------------------------------------------------------------------------


def brute_search(docs, items, k=10):
    counts = [(i, Counter(words_of(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    out = []
    for item, text in items:
        query, found = Counter(words_of(text)), []
        for i, c in counts:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // n_terms
            score = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w, r in query.items() if w in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def got_search(rows):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in rows.collect()), key=str)


ITEMS = [(1, " ".join(PASSAGE.split()[5:17])), (2, "TWO two one"), (3, None), (4, ""), (None, "alpha0 a"), (5, "..."), (2, "two"), (6, "never seen here"), (7, "Ünïcode 你好 no id"), (8, LONG)]


@pytest.mark.parametrize("limit", [BLOCK_POSTINGS, 3])
def test_search_equals_brute_force(spark, odd, limit):
    """Nulls, repeats, ties and clashing names; a low limit makes a block of every item."""
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "'x' AS item", "'y' AS terms", "1 AS rank")
    assert got_search(ranked(odd, items, k=4, block_postings=limit)) == brute_search(docs, ITEMS, 4)


def test_search_of_empty_tables(spark, odd, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked(empty, items).count() == ranked(odd, items.limit(0)).count() == 0
    assert ranked(odd, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert ranked(odd.filter("doc_id IN (2, 3, 4)"), items).count() == 0


def test_blocks_stay_within_the_limit(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(1 + i * 7 % 40))) for i in range(300)]
    postings, _ = item_postings(spark.createDataFrame(rows, "item_id long, text string").repartition(3), "item_id", "text")
    blocks = blocks_of(postings, 100)
    sizes = [(r["item"], len(r["terms"])) for r in postings.collect()]
    held = [[n for i, n in sizes if lo <= i < hi] for lo, hi in blocks]
    assert sum(map(len, held)) == 300 and all(sum(h) <= 100 for h in held) and len(blocks) < 150
    assert all(a[1] <= b[0] for a, b in zip(blocks, blocks[1:]))


# --- conversation prefix trie ------------------------------------------------------------------------------------

def brute_trie(rows):
    talk = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            talk[conv].append((turn is not None, turn or 0, digest, role, text))
    talk = {c: [t[3:] for t in sorted(ts)] for c, ts in talk.items()}
    nodes = defaultdict(list)
    made = {}
    for c, ts in talk.items():
        base, h = c - int(math.fmod(c, 20)), zlib.crc32(str(c).encode()) % 4
        made[c] = tuple(talk.get(base, [])[:h] + ts[h:])
        for d in range(len(made[c]) + 1):
            nodes[made[c][:d]].append(c)
    kids = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, members in nodes.items():
        text = p[-1][1] if p else ""
        for c in "\t\n\x0b\x0c\r":
            text = text.replace(c, " ")
        words = len([w for w in text.split(" ") if w])
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(members) - 1) * words
    ends = defaultdict(list)
    for c, p in made.items():
        ends[p].append(c)
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], digest(p)) for p, m in nodes.items()), key=str)


def got_trie(spark, rows):
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS depth", "'k' AS k0", "2 AS conv", "'w' AS words")
    trie = Trie(*rebuilt(placed(talk)))
    out = trie.nodes.join(end_digests(trie.ends), ["depth", "k0", "k1", "k2", "k3"], "left").collect()
    nothing = hashlib.sha256(b"").hexdigest()
    return sorted(((r.conv, r.depth, r.parent_conv, r.n_convs, r.n_children, r.n_leaves, r.saved_words, r.ends_sha256 or nothing) for r in out), key=str)


def test_trie_equals_brute_force(spark):
    """Nested prefixes, copies, short and absent first conversations, null turns, ties, repeated rows, negative ids."""
    rnd, rows = random.Random(5), []
    for c in [*range(0, 9), *range(20, 60), *range(107, 131), -3, -20, -41]:
        for t in range(rnd.randrange(1, 7)):
            rows.append((c, t if rnd.random() < 0.9 else None, rnd.choice(["user", "assistant", None]), rnd.choice(["", None, "a b", " one\ttwo\x0b", "x y z"])))
    rows += [(None, 1, "user", "of nobody"), (200, 1, "u", "same"), (200, 1, "u", "same"), (200, None, None, None)]
    assert got_trie(spark, rows) == brute_trie(rows)


def test_trie_of_copies_and_of_turnless_conversations(spark):
    rows = [(20 * k, t, "u", f"t {t}") for k in range(5000) for t in range(2)] + [(20 * k, 2, "u", "more") for k in range(3)]
    rows += [(c, 0, "u", "only one turn") for c in range(900_001, 900_012)]  # their family has no first conversation
    assert got_trie(spark, rows) == brute_trie(rows)
    assert any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in brute_trie(rows))


def test_trie_of_a_long_conversation(spark):
    """Running sums go over several chunks, and a conversation over several partitions."""
    long = [(t, "u" if t % 2 else "a", f"turn {t % 700} x") for t in range(2500)]
    rows = [(0, *t) for t in long] + [(1, *t) for t in long[:2200]] + [(40, *t) for t in long[:1024]] + [(60, *t) for t in long]
    got = got_trie(spark, rows)
    assert sorted(r[1] for r in got) == list(range(2501))  # one path
    root = next(r for r in got if r[1] == 0)
    deepest = next(r for r in got if r[1] == 2500)
    assert root[3:6] == (4, 1, 1) and deepest[3:6] == (2, 0, 1) and deepest[7] == hashlib.sha256(b"0,60").hexdigest()
    assert root[6] == sum(3 * ((4 if d < 1024 else 3 if d < 2200 else 2) - 1) for d in range(2500))


def test_empty_trie(spark):
    assert got_trie(spark, [(None, 0, "u", "x")]) == []


# --- byte-pair encoding with word ends ---------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def memo():
    return encoder(path("word_bpe_49k.json"))


def ids_of(memo, text):
    import numpy as np

    data = np.frombuffer(text.encode(), np.uint8)
    return memo.encode(data, np.array([0, len(data)]))[0].tolist()


def test_query_equals_the_library(spark, documents, library):
    rows = {r.doc_id: r for r in Q.QUERIES["op13_bpe"](spark, SF).collect()}
    docs = documents.select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert (rows[d.doc_id].n_tokens, rows[d.doc_id].ids_sha256, rows[d.doc_id].decoded_sha256) == want


@settings(max_examples=400, deadline=None)
@given(st.one_of(
    st.text(st.characters(exclude_categories=["Cs"]), max_size=80), st.text("abenrst'", max_size=90), st.text("aà́ AB.'st \n\u0085　!9٣", max_size=60),
    st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|endof", "text|>", "a", " ", "İ", "Σ", "'LL"]), max_size=12).map("".join),
))
def test_any_text_equals_the_library(memo, library, text):
    assert ids_of(memo, text) == library.encode(text, add_special_tokens=False).ids


def test_long_words_and_both_ways_to_merge(memo, library):
    vocabulary, _ = load(path("word_bpe_49k.json"))
    rnd = random.Random(2)
    words = [bytes(rnd.choice(b"aabeinorst") for _ in range(n)) for n in (1, 2, 3, 47, 48, 49, 50, 300, 5000) for _ in range(20)]
    base = lambda w: [vocabulary.base[b, i == len(w) - 1] for i, b in enumerate(w)]
    for w, ids in zip(words, vocabulary.words(words)):
        assert ids == vocabulary._queued(base(w)) == vocabulary._scanned(base(w)) == library.encode(w.decode(), add_special_tokens=False).ids


def test_pairs_that_pass_are_those_that_merging_leaves(memo):
    """Every pair of tokens, tested by itself, against merging its bytes."""
    vocabulary, _ = load(path("word_bpe_49k.json"))
    import json

    import numpy as np

    vocab = json.load(open(path("word_bpe_49k.json"), encoding="utf-8"))["model"]["vocab"]
    plain = {i: t for t, i in vocab.items() if t.isascii()}
    rnd = random.Random(4)
    left = [i for i, t in plain.items() if not t.endswith("</w>")]
    right = [i for i, t in plain.items() if t.endswith("</w>")]
    pairs = [(rnd.choice(left), rnd.choice(right)) for _ in range(4000)]
    passed = vocabulary.compatible(*(np.array(x) for x in zip(*pairs))).tolist()
    for (a, b), ok in zip(pairs, passed):
        assert ok == (vocabulary.exact((plain[a] + plain[b][:-4]).encode()) == [a, b])
    assert 500 < sum(passed) < 3900


def test_vocabularies_that_speculation_cannot_serve():
    with pytest.raises(ValueError, match="single bytes"):
        Vocabulary({"a": 0, "a</w>": 1, "aa": 2}, [["a", "a"]], "</w>")
    with pytest.raises(ValueError, match="made before"):
        Vocabulary({"a": 0, "b": 1, "ab": 2, "aab": 3}, [["a", "ab"], ["a", "b"]], "</w>")


def test_bpe_cases(spark, odd, empty, library):
    file = path("word_bpe_49k.json")
    rows = encoded(odd, file).collect()
    assert len(rows) == odd.count()
    texts = Counter((r.doc_id, tuple(library.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.select("doc_id", "text").collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == texts and all(r.n_tokens == len(r.ids) for r in rows)
    assert encoded(empty, file).count() == 0 and decoded(encoded(empty, file), file).count() == 0
    known = library.encode("Hello, WORLD<|endoftext|>", add_special_tokens=False).ids
    back = spark.createDataFrame([(1, known), (2, None), (3, []), (4, [-1, known[0], 49_500]), (5, known * 700)], "id int, ids array<int>").repartition(1)
    text = {r.id: r.text for r in decoded(back, file).collect()}
    assert text[1] == library.decode(known, skip_special_tokens=False) == "hello</w> ,</w> world</w> <|endoftext|>"
    assert text[2] is None and text[3] == "" and text[4] == "hello</w>" and text[5] == library.decode(known * 700, skip_special_tokens=False)
