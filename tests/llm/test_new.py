"""Token counts, the Merkle manifest and fill-in-middle against plain loops."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import common, fim, merkle, queries, tokencount

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, what int, k int, blob binary, output string"


@pytest.fixture(scope="module")
def rows():
    """Nulls in any column, empty and long texts, ties, repeated rows, odd characters and columns with clashing names."""
    draw = random.Random(5)
    signs = ["a", "B", "é", "日", "😀", " ", "  ", "\n", "\t", " ", " ", "'s", "'re", "'", "''", "!", "1", "½", "٣", "<", "<P", "<|endoftext|>", "<|endof", "é", "\u0000", "n't", "’s", "'S", "\r\n"]
    say = lambda n: "".join(draw.choice(signs) for _ in range(n))
    long = " ".join(draw.choice(["it's", "we'll", "naïve", "x1y2", "(so)", "日本"]) for _ in range(4000))
    texts = [None, "", " ", "\n\n", "word", "a<P>b", "x<S>", "<M>", "<<P>", "<P<S", "'s", " 's", "a's's", "a 's b", "it's they'll'd I'm", "  two", "end  ", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", long, long + "é" * 9000, "é" * 5000, "x" * 20_000]
    texts += [say(draw.randint(1, 60)) for _ in range(150)]
    out = [(i, t, draw.choice(["en", None]), draw.choice(["a", "a", "é", "b", None, "", "z" * draw.randint(1, 9)]), draw.choice([None, 7]), 1, 2, 3, b"x", "y") for i, t in enumerate(texts)]
    return [*out, out[4], out[4], (None, "n", None, None, None, None, None, None, None, None), (None, None, None, "a", None, None, None, None, None, None), (4, "other\ntext", "en", "a", 1, 1, 1, 1, b"", "")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- token counts -------------------------------------------------------------------------------


def plain_counts(rows, name="byte_bpe_50k.json", limit=1024):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(name))
    texts = [r[1] or "" for r in rows]
    return sorted(((r[0], len(t.encode()), len(e.ids), len(e.ids) > limit) for r, t, e in zip(rows, texts, tok.encode_batch(texts, add_special_tokens=False), strict=True)), key=str)


def test_token_counts(spark, docs, rows):
    want = plain_counts(rows)
    assert tuples(tokencount.count(docs)) == want
    for capacity in (0, 3):  # a table that lacks nearly all
        assert tuples(tokencount.count(docs, capacity=capacity)) == want
    assert tokencount.count(spark.createDataFrame([], SCHEMA)).count() == 0


def test_token_counts_of_other_files(docs, rows):
    import public_tokenizers
    import sentencepiece

    assert tuples(tokencount.count(docs, "word_bpe_49k.json")) == plain_counts(rows, "word_bpe_49k.json")
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted(((r[0], len((r[1] or "").encode()), n, n > 9) for r in rows for n in [len(model.encode(r[1] or ""))]), key=str)
    assert tuples(tokencount.count(docs, "piece_bpe_32k.model", 9)) == want


def test_pre_tokens_are_the_tokenizers():
    from tokenizers import pre_tokenizers

    pre, draw = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True), random.Random(1)
    signs = ["'", "s", "t", "r", "e", "v", "l", "d", "m", " ", " ", "\n", " ", "é", "1", "٣", "!", "́", "‍", "\x85", "\x1c", "😀", "ǅ", "ª", "²"]
    for _ in range(400):
        texts = ["".join(draw.choices(signs, k=draw.randint(0, 12))) for _ in range(draw.randint(1, 4))]
        pieces, first = tokencount.pre_tokens(texts)
        cut = [[p.decode() for p in pieces[int(a) : int(b)].to_pylist()] for a, b in zip(first[:-1], first[1:], strict=True)]
        assert cut == [[t[a:b] for _, (a, b) in pre.pre_tokenize_str(t)] for t in texts]


def test_windows_cut_where_pre_tokens_begin(monkeypatch):
    counter = tokencount.Counter("byte_bpe_50k.json")
    text = "It's a long way to go, isn't it? 12 345  and more <|endoftext|> of it all\n\nagain and again " * 20
    whole = counter.whole([text])[0]
    monkeypatch.setattr(tokencount, "WINDOW", 100)
    got, parts_seen = 0, 0
    for _, parts, special in counter.parts([text]):
        pieces, _ = tokencount.pre_tokens(parts)
        got += sum(counter.lengths(pieces.to_pylist())) + int(special.sum())
        parts_seen += len(parts)
    assert got == whole and parts_seen > 20


def test_summaries_keep_what_is_frequent_in_any_order():
    draw = random.Random(2)
    items = [b"often"] * 3000 + [b"second"] * 1500 + [str(draw.random()).encode() for _ in range(5000)]
    draw.shuffle(items)
    parts = []
    for i in range(0, len(items), 500):
        s = tokencount.Summary(10)
        for x in items[i : i + 500]:
            s.add([x], [1])
        parts.append(s.dump())
    for order in (parts, parts[::-1]):
        total = tokencount.Summary(10)
        for blob in order:
            total.merge(blob)
        total.cut()
        assert {b"often", b"second"} <= set(total.count) and len(total.count) <= 10
        assert 3000 >= total.count[b"often"] >= 3000 - len(items) / 10


def test_lengths_tell_equal_hashes_apart(monkeypatch):
    monkeypatch.setattr(common, "hash_strings", lambda s: np.array([len(x) for x in s], np.uint64))
    table = tokencount.Lengths([b"ab", b"cd", b"efg"], [1, 2, 3])
    assert table.find(pa.array([b"ab", b"cd", b"efg", b"xyz", b""], pa.binary())).tolist() == [1, -1, 3, -1, -1]


# --- Merkle manifest ----------------------------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r, text):
    return H(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (r[0], r[3], r[2], r[4], text)))


def plain_tree(leaves, arity):
    """All levels."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
    return levels


def plain_up(levels, i, x, arity):
    """Siblings, and the root that x folds to."""
    beside = []
    for level in levels[:-1]:
        lo = i // arity * arity
        run = level[lo : lo + arity]
        beside += run[: i - lo] + run[i - lo + 1 :]
        x = H(*run[: i - lo], x, *run[i - lo + 1 :])
        i //= arity
    return beside, x


def plain_manifest(rows, tamper, arity=3):
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r, r[1])))
        trees.append(plain_tree([plain_leaf(r, r[1]) for r in by[s]], arity))
    top = plain_tree([t[-1][0] for t in trees], arity)
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(by[s]):
            beside, x = plain_up(trees[k], i, plain_leaf(r, tamper(r)), arity)
            more, x = plain_up(top, k, x, arity)
            out.append((r[0], trees[k][0][i], trees[k][-1][0], top[-1][0], H(*beside, *more), x, x == top[-1][0]))
    return sorted(out, key=str)


def without_newlines(r):
    return r[1].replace("\n", "") if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[1]


def test_merkle(spark, docs, rows):
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    seen = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    want = plain_manifest(rows, without_newlines)
    assert tuples(merkle.build(docs, seen).verified()) == want and {r[-1] for r in want} == {True, False}
    for arity, size in ((3, 5), (2, 17), (4, 3)):  # many partitions, whose edges cut sources and runs anywhere
        assert tuples(merkle.build(docs, seen, arity, size).verified()) == plain_manifest(rows, without_newlines, arity)
    assert merkle.build(spark.createDataFrame([], SCHEMA)).verified().count() == 0


def test_merkle_of_few_rows_and_of_one_source(spark):
    draw = random.Random(1)
    for n in (1, 3, 10, 28):
        for names in (["a"], ["a", None, "b", "c"]):
            rows = [(i // 2, f"t{i}\n", None, draw.choice(names), i) for i in range(n)]
            df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
            assert tuples(merkle.build(df, rows=4).verified()) == plain_manifest(rows, lambda r: r[1])


def test_merkle_of_equal_rows(spark):
    rows = [(7, "same", None, "a", 1)] * 300 + [(1, "x", None, "b", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = tuples(merkle.build(df, rows=20).verified())
    assert [r[:4] + r[5:] for r in got] == [r[:4] + r[5:] for r in plain_manifest(rows, lambda r: r[1])] and sorted(r[4] for r in got) == sorted(r[4] for r in plain_manifest(rows, lambda r: r[1]))


def test_merkle_proofs_fold_to_the_root(docs, rows):
    made = merkle.build(docs, rows=11)
    got = made.proofs().collect()
    assert len(got) == len(rows) and {r["root"] for r in got} == {made.root}
    for r in got:
        x = r["leaf"]
        for level in r["siblings"]:
            x = H(*level["run"][: level["at"]], x, *level["run"][level["at"] :])
        assert x == made.root


def test_forests_merge_in_any_order():
    draw = random.Random(3)
    leaves = [H(str(i)).encode() for i in range(50)]
    for _ in range(20):
        forest, blobs = merkle.Forest(), []
        cuts = sorted({0, 50, *draw.sample(range(1, 50), 6)})
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = merkle.Forest()
            for level, i, x in merkle.edges(merkle.climb(a, leaves[a:b], 50)):
                part.add(0, 50, level, i, x)
            assert len(part.nodes) <= 4 * 5
            blobs.append(part.dump())
        draw.shuffle(blobs)
        for blob in blobs:
            forest.merge(blob).settle(1)
        assert forest.nodes == {(merkle.TOP, 0, 0): plain_tree([x.decode() for x in leaves], 3)[-1][0].encode()}


# --- fill-in-middle -----------------------------------------------------------------------------


def plain_fim(r):
    text = r[1] or ""
    d = hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest()
    h = [int(d[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return r[0], n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (r[0], n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (r[0], n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(spark, docs, rows):
    want = [plain_fim(r) for r in rows]
    assert tuples(fim.transform(docs)) == sorted(want, key=str) and {w[2] for w in want} == {"plain", "psm", "spm"}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert tuples(fim.transform(docs, digest=True)) == sorted([(*w[:5], sha(w[5]), sha(r[1] or "")) for w, r in zip(want, rows, strict=True)], key=str)
    assert fim.transform(spark.createDataFrame([], SCHEMA)).count() == 0


def test_scan_in_blocks_of_any_size():
    draw, table = random.Random(4), fim.Automaton()
    signs = ["a", "<", "P", ">", "<P>", "<S", "M", "é", "日", "😀"]
    for block in (1, 2, 3, 5, 64):
        texts = ["".join(draw.choices(signs, k=draw.randint(0, 40))) for _ in range(30)]
        data = [t.encode() for t in texts]
        first = np.concatenate(([0], np.cumsum([len(d) for d in data])))
        scan = fim.Scan(table, np.frombuffer(b"".join(data), np.uint8), first, block)
        assert scan.units.tolist() == [len(t) for t in texts]
        assert [n > 0 for n in scan.sentinels] == [any(s in t for s in fim.SENTINELS) for t in texts]
        at = [(i, u) for i, t in enumerate(texts) for u in range(len(t) + 1)]
        got = scan.offsets(np.array([i for i, _ in at]), np.array([u for _, u in at]))
        assert got.tolist() == [len(texts[i][:u].encode()) for i, u in at]


def test_restore_of_borders_that_look_like_sentinels():
    for prefix in ("", "<", "<P", "<S", "P>"):
        for suffix in ("", "S>", "<", "M>"):
            for middle in ("", "P>", "<M"):
                if any(s in prefix + middle + suffix for s in fim.SENTINELS):
                    continue
                text = (prefix + middle + suffix).encode()
                assert fim.restore(f"<P>{prefix}<S>{suffix}<M>{middle}".encode(), "psm") == text
                assert fim.restore(f"<S>{suffix}<P>{prefix}<M>{middle}".encode(), "spm") == text
    for bad in (b"x", b"<P>x<M>"):
        with pytest.raises(ValueError):
            fim.restore(bad, "psm")


def test_queries_of_the_new_operators(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert tuples(queries.op11_token_counts(spark, sf)) == plain_counts(rows)
    assert tuples(queries.op12_merkle(spark, sf)) == plain_manifest(rows, without_newlines)
    assert [r[:5] for r in tuples(queries.op13_fill_in_middle(spark, sf))] == sorted([plain_fim(r)[:5] for r in rows], key=str)
