"""Language-model scores, tokenizer alignment and the conversation trie against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorecast.llm import backoff_lm, bpe, burst_trie, queries, token_alignment
from scorecast.llm.scratch import ship_package
from tests.conftest import SF_SMALL
from tests.llm.test_text_operators import ODD, _docs, _random_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


# ---- operator 11 ----------------------------------------------------------------------------

def _brute_lm(rows):
    """Scores by plain dictionaries: an order's share of the one below is a function of the
    context's count."""
    held = lambda d: d is None or zlib.crc32(str(d).encode()) % 10 == 0
    texts = [(d, held(d), [*WORD.findall(_lower(t)), None]) for d, t in rows]
    one, two, three, known = Counter(), Counter(), Counter(), 0
    for _, out, words in texts:
        if not out:
            known += 1
            seen = ["<begin>", *words]
            one.update(words)
            two.update(zip(seen, seen[1:]))
            three.update(zip(seen, seen[1:], seen[2:]))
    n, v = sum(one.values()), len(one)
    context = one | Counter({"<begin>": known})
    share = lambda c, half: 1 / (1 + (c / half) ** backoff_lm.POWER)
    for d, out, words in texts:
        seen, base, score = ["<begin>", *words], 0.0, 0.0
        for i, w in enumerate(words):
            p = (one[w] + 0.1) / (n + 0.1 * (v + 1))
            base += math.log10(p)
            for counts, below, gram, half in ((two, context, 1, backoff_lm.HALF_ONE), (three, two, 2, backoff_lm.HALF_TWO)):
                if i + 1 >= gram:
                    h = tuple(seen[i + 1 - gram:i + 1])
                    c = below[h[0] if gram == 1 else h]
                    if c:
                        b = share(c, half)
                        p = (1 - b) * counts[(*h, w)] / c + b * p
            score += math.log10(p)
        yield d, out, len(words), sum(one[w] > 0 for w in words), n, base, score


def _check_lm(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(map(tuple, backoff_lm.score_documents(docs).collect()), key=str)
    want = sorted(_brute_lm(rows), key=str)
    key = lambda r: (str(r[0]), *r[1:5], round(r[5], 6))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and np.allclose(g[5:], w[5:], rtol=1e-11, atol=1e-11)


def test_scores_equal_plain_dictionaries(spark):
    ship_package(spark)
    _check_lm(queries.table(spark, SF_SMALL, "documents"))
    got = queries.op11_backoff_lm(spark, SF_SMALL)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    mean = got.filter("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert mean[1] > mean[0]  # contexts help on texts that were not learned from


@pytest.mark.parametrize("parts, shard", [(1, 3_000_000), (12, 2000)])
def test_scores_do_not_depend_on_blocks_and_shards(spark, monkeypatch, parts, shard):
    rng = random.Random(parts)
    texts = [None, "", " \t\n", "a", "A b\x0bC", "same same same", "same same same", "x" * 3000,
             "long " * 5000, *[" ".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 30))) for _ in range(60)]]
    docs = _docs(spark, texts, extra=True)
    docs = docs.unionByName(docs.filter("doc_id < 3")).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    monkeypatch.setattr(backoff_lm, "SHARD_KEYS", shard)
    _check_lm(docs.repartition(parts))


def test_probabilities_of_a_state_sum_to_one(spark):
    """Every word of the vocabulary and one unknown word after the same context."""
    train = [(i, t) for i, t in enumerate(["a b c", "a b d", "b c", "c a b c"] * 3) if zlib.crc32(str(i).encode()) % 10]
    out = [i for i in range(1000) if not zlib.crc32(str(i).encode()) % 10]
    words = sorted({w for _, t in train for w in t.split()})
    for context in ("", "a", "a b", "zz"):
        probe = [(out[k], f"{context} {w}".strip()) for k, w in enumerate([*words, "unknown"])]
        got = {r.doc_id: r.score for r in backoff_lm.score_documents(spark.createDataFrame(train + probe, "doc_id long, text string")).collect()}
        # log p(context) + log p(w) + log p(end): take the end's share off by brute force.
        want = {r[0]: r for r in _brute_lm(train + probe)}
        assert all(abs(got[d] - want[d][6]) < 1e-10 for d, _ in probe)
    assert backoff_lm.lower_share(np.array([0.0]), 10.0)[0] == 1.0


def test_scores_of_nothing(spark):
    assert backoff_lm.score_documents(_docs(spark, ["x"]).limit(0)).count() == 0
    out = [i for i in range(100) if not zlib.crc32(str(i).encode()) % 10][:2]
    rows = backoff_lm.score_documents(spark.createDataFrame([(d, "a b") for d in out], "doc_id long, text string")).collect()
    assert [(r.train_tokens, r.n_known, r.n_tokens, r.score) for r in rows] == [(0, 0, 3, 0.0)] * 2


def test_packed_integers_come_back():
    rng = np.random.default_rng(1)
    for kind in (np.uint8, np.uint16, np.uint32, np.uint64):
        x = rng.integers(0, np.iinfo(kind).max, 1000, dtype=kind)
        assert (backoff_lm.unpack(backoff_lm.pack(x)) == x).all()
    keys = np.sort(rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (backoff_lm.unpack_sorted(backoff_lm.pack_sorted(keys)) == keys).all()
    assert len(backoff_lm.unpack(backoff_lm.pack_counts(np.zeros(0, np.int64)))) == 0


# ---- operator 12 ----------------------------------------------------------------------------

@pytest.fixture(scope="module")
def both():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(queries.tokenizer_path())
    a.encode_special_tokens = True
    a.no_truncation()
    a.no_padding()
    return a, sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))


def _tokens(both, text):
    """(ids, ends of the byte ranges) of both tokenizers; nothing where bytes differ."""
    a, b = both
    if not text:
        return None
    raw = bpe.vocabulary(queries.tokenizer_path()).bytes
    a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
    whole = (" " + text).encode()
    if b"".join(b_bytes) != whole or b"".join(raw[i] for i in a_ids) != whole:
        return None
    return (a_ids, np.cumsum([len(raw[i]) for i in a_ids]).tolist()), (b_ids, np.cumsum([len(x) for x in b_bytes]).tolist())


def _brute_alignment(both, rows):
    found, links, groups, count = [_tokens(both, text) for _, text in rows], {}, {}, Counter()
    for k, tokens in enumerate(found):
        if tokens:
            (a_ids, a_ends), (b_ids, b_ends) = tokens
            ends_of_b = dict(zip(b_ends, b_ids))
            links[k] = [(i, ends_of_b[x]) for i, x in zip(a_ids, a_ends) if x in ends_of_b]
            inside, open_a, rest = [], [], iter(zip(b_ids, b_ends))
            for i, x in zip(a_ids, a_ends):
                open_a.append(str(i))
                if x in ends_of_b:
                    open_b = []
                    for j, y in rest:
                        open_b.append(str(j))
                        if y == x:
                            break
                    inside.append(f"{','.join(open_a)}|{','.join(open_b)}")
                    open_a = []
            groups[k] = hashlib.sha256(";".join(inside).encode()).hexdigest()
            count.update(links[k])
    most = defaultdict(int)
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    for k, (doc, _) in enumerate(rows):
        if not found[k]:
            yield doc, 0, 0, 0, 0, 0, 0, ""
            continue
        (a_ids, a_ends), (b_ids, b_ends) = found[k]
        yield (doc, len(a_ids), len(b_ids), len(set(a_ends) & set(b_ends)), len(links[k]),
               sum(count[p] == most[p[1]] for p in links[k]), sum(count[p] for p in links[k]), groups[k])


ALIGN = [*ODD, None, "▁ marks", "x ▁", "plain <|endoftext|> text </s> <s> <unk> <0x41>", "日本語 text  と　空白", "café café ﬁ",
         "a  b   c", "\x00 nul", "tab\t tab\n new\r\n", "same words", "same words", "😀 👍🏽 x", "1234567 89", "don't 're'd   'll"]


def _check_alignment(both, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [tuple(r) for r in token_alignment.alignment_statistics(
        docs, queries.tokenizer_path(), queries.tokenizer_path("piece_bpe_32k.model")).collect()]
    for g, w in zip(sorted(got, key=str), sorted(_brute_alignment(both, rows), key=str), strict=True):
        assert g == w


def test_alignment_equals_brute_force(spark, both):
    texts = ALIGN + _random_texts(300, seed=5) + [" " * 50_000 + "q", "ab" * 20_000]
    docs = _docs(spark, texts, extra=True)
    _check_alignment(both, docs.unionByName(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long"))).repartition(7))
    assert token_alignment.alignment_statistics(docs.limit(0), queries.tokenizer_path(),
                                                queries.tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_alignment_query(spark, both):
    got = {r.doc_id: tuple(r) for r in queries.op12_token_alignment(spark, SF_SMALL).collect()}
    rows = [(r.doc_id, r.text) for r in queries.table(spark, SF_SMALL, "documents").collect()]
    for w in _brute_alignment(both, rows):
        assert got[w[0]] == w


def test_links_are_sparse_products(spark, both):
    ship_package(spark)
    texts = ["café 日本語 😀 x", "plain words here", "", None, "▁"]
    rows = token_alignment.align_documents(_docs(spark, texts), queries.tokenizer_path(),
                                           queries.tokenizer_path("piece_bpe_32k.model")).orderBy("doc_id").collect()
    for r, text in zip(rows, texts):
        found = _tokens(both, text)
        if not found:
            assert not r.a_ids and not r.overlap and not r.shared_group
            continue
        (a_ids, a_ends), (b_ids, b_ends) = found
        assert (r.a_ids, r.a_ends, r.b_ids, r.b_ends) == (a_ids, a_ends, b_ids, b_ends)
        spans = lambda ends: list(zip([0, *ends], ends))
        want = [(i, j, min(e, y) - max(s, x)) for i, (s, e) in enumerate(spans(a_ends)) for j, (x, y) in enumerate(spans(b_ends))
                if max(s, x) < min(e, y)]
        assert [tuple(x) for x in r.overlap] == want
        assert [tuple(x) for x in r.shared_group] == [(i, j) for i, g in enumerate(r.a_group) for j, h in enumerate(r.b_group) if g == h]


def test_row_products_equal_dense_ones():
    rng = np.random.default_rng(2)
    for n, m, k in ((0, 3, 2), (4, 5, 6), (30, 20, 10)):
        left, right = (rng.integers(0, 3, s) * rng.integers(0, 2, s) for s in ((n, m), (m, k)))
        csr = lambda x: token_alignment.CSR(np.concatenate(([0], np.cumsum((x != 0).sum(axis=1)))).astype(int), np.nonzero(x)[1], x[x != 0], x.shape[1])
        got = token_alignment.row_products(csr(left), csr(right))
        dense = np.zeros((n, k), dtype=int)
        dense[got.rows(), got.columns] = got.values
        assert (dense == left @ right).all()
        turned = csr(right).transposed()
        back = np.zeros((k, m), dtype=int)
        back[turned.rows(), turned.columns] = turned.values
        assert (back == right.T).all()


# ---- operator 13 ----------------------------------------------------------------------------

def _brute_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16], role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    nodes = defaultdict(list)
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 4, c - int(math.fmod(c, 20))
        path = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            nodes[path[:d]].append((c, len(path)))
    children, sums = defaultdict(list), {}
    for p in nodes:
        if p:
            children[p[:-1]].append(p)
    for p in sorted(nodes, key=len, reverse=True):
        own_saved = (len(nodes[p]) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        sums[p] = (own_saved + sum(sums[k][0] for k in children[p]), sum(sums[k][1] for k in children[p]) or 1)
        ends = ",".join(str(c) for c in sorted(c for c, n in nodes[p] if n == len(p)))
        yield (min(nodes[p])[0], len(p), min(nodes[p[:-1]])[0] if p else None, len(nodes[p]), len(children[p]), sums[p][1], sums[p][0],
               hashlib.sha256(ends.encode()).hexdigest())


def _conversations(spark, rows):
    ship_package(spark)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for c in ("path", "words", "k", "d", "head", "base", "t", "turns"):  # names used inside
        df = df.withColumn(c, F.lit("x"))
    return df


def _made_conversations():
    rng, rows = random.Random(4), [(None, 1, "user", "of nobody")]
    for c in range(-30, 120):
        for t in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["u", "a", None]), rng.choice(["x y", "z", "", None, "a b c"])))
    trunk = [(t, "u", f"w{t} x") for t in range(60)]
    for c in range(1000, 1060):  # a trunk with a branch at most turns
        cut = rng.randrange(60)
        rows += [(c, *t) for t in trunk[:cut]] + [(c, cut, "a", f"end {c}")] * (c % 2)
    rows += [(c, *t) for c in range(2000, 2300) for t in trunk[:7]]  # copies
    rows += [(5000, t, "u", "one two " * 50) for t in range(700)]
    return rows + rows[:40]


@pytest.mark.parametrize("container", [3, 40, burst_trie.CONTAINER])
def test_trie_equals_brute_force(spark, container):
    rows = _made_conversations()
    got = burst_trie.prefix_trie(burst_trie.rebuilt(_conversations(spark, rows)), container)
    assert got.columns == burst_trie.RESULT
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(_brute_trie(rows), key=str)


def test_trie_query_and_empty_tables(spark):
    rows = [tuple(r) for r in queries.table(spark, SF_SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op13_burst_trie(spark, SF_SMALL).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(_brute_trie(rows), key=str)
    for few in ([], [(None, 1, "u", "x")]):
        assert burst_trie.prefix_trie(burst_trie.rebuilt(_conversations(spark, few))).count() == 0
    one = burst_trie.prefix_trie(burst_trie.rebuilt(_conversations(spark, [(7, None, None, None)]))).collect()
    assert sorted((tuple(r) for r in one), key=str) == sorted(_brute_trie([(7, None, None, None)]), key=str)
