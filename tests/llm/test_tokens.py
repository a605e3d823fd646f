import os
import random

import pytest

from skein.llm import packing, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(os.path.join(tokens.TOKENIZERS, "byte_bpe_50k.tiktoken")), reason="no vocabulary files")


def reference(texts):
    import tiktoken

    ranks = tokens.read_ranks(os.path.join(tokens.TOKENIZERS, "byte_bpe_50k.tiktoken"))
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    e = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return [e.encode_ordinary(t) if t else [] for t in texts]


def test_ids_equal_the_public_encoder(spark):
    rng = random.Random(2)
    parts = ["hello", " world", "ThIs", "'s", "'ve", "望遠鏡と弦楽四重奏", "カタカナー", "  ", "\n\n", "\t", "é", "ß", "😀👩‍🔬", "12345", "<|endoftext|>", " ", "　", "zxqv", "!!!", "Größenordnung", "​", "한국어", "עברית"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(150)]
    texts += ["", None, " ", "a", "x" * 3000, "word " * 4000, "<|endoftext|>"]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, ids long")
    got = {r["doc_id"]: list(r["ids"]) for r in tokens.encode(df).collect()}
    assert [got[i] for i in range(len(texts))] == reference(texts)
    counts = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(df).collect()}
    assert counts == {i: len(v) for i, v in got.items()}


def test_repeated_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "qwxz abc"), (1, "qwxz abc"), (None, "zzz")], "doc_id long, text string")
    assert sorted(map(str, [r["doc_id"] for r in tokens.encode(df).collect()])) == ["1", "1", "None"]
    assert tokens.encode(df.limit(0)).count() == 0


def test_decode_gives_the_text_back(spark):
    texts = ["Größenordnung 望遠鏡 😀👩‍🔬\r\n\t  x", "<|endoftext|> 'll", "한국어\u200bעברית", "", " ", "word " * 500, "\x00é\ufeff"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in tokens.decode(tokens.encode(df)).collect()} == dict(enumerate(texts))
    odd = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in tokens.decode(odd).collect()} == {1: None, 2: ""}


def test_hash_is_sparks(spark):
    words = ["", "a", "abcd", "abcde", "ÿé€", "longer text here"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").selectExpr("w", "hash(w) as h").collect()
    assert all(tokens.spark_hash(r["w"].encode()) == r["h"] for r in rows)


def test_packing_respects_every_limit(spark):
    rng = random.Random(4)
    sizes = [rng.choice([0, 1, 3, 17, 50, 64, 100, 130, 250]) for _ in range(3000)]
    made = []
    items = spark.createDataFrame([(i, i, n) for i, n in enumerate(sizes)], "id long, key long, n_tokens long")
    for kw in ({}, {"max_docs": 3}, {"max_cost": 5_000.0, "max_docs": 100}, {"max_cost": 10_000.0, "max_docs": 100}, {"rule": "dot", "max_docs": 4}):
        rows = packing.pack(items, capacity=100, shard_items=1000, **kw).collect()
        bins = {}
        seen = {}
        for r in rows:
            seen[r["id"]] = seen.get(r["id"], 0) + r["n_tokens"]
            if r["container"] is None:
                assert r["n_tokens"] == 0
            else:
                bins.setdefault(r["container"], []).append(r["n_tokens"])
        assert seen == dict(enumerate(sizes))
        cost = kw.get("max_cost", 7_500)
        assert all(sum(b) <= 100 and len(b) <= kw.get("max_docs", 32) for b in bins.values())
        assert all(sum(x * x for x in b) <= cost or len(b) == 1 for b in bins.values())
        made.append(len(bins))
        if not kw:
            report = packing.fill_report(spark.createDataFrame(rows, "id long, piece int, start_token long, n_tokens int, container long"), 100).first()
            assert (report["containers"], report["most_pieces"]) == (len(bins), max(map(len, bins.values()))) and report["most_cost"] <= 1
    free = packing.pack(items, capacity=100, max_docs=100, max_cost=10_000.0).where("container is not null").select("container").distinct().count()
    assert made[1] > free and made[2] > free == made[3]  # each limit changes the result by itself
    tiny = spark.createDataFrame([(i, i, 1) for i in range(100)], "id long, key long, n_tokens long")
    assert packing.fill_report(packing.pack(tiny, 100), 100).first()["most_pieces"] == 32


def test_containers_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, " ".join(["word"] * (i % 50))) for i in range(300)], "doc_id long, text string")
    packed = lambda x: {tuple(r) for r in packing.pack(tokens.count_tokens(x).withColumnRenamed("doc_id", "id"), 100).collect()}
    assert packed(df) == packed(df.repartition(7))


def test_packing_splits_only_oversized(spark):
    items = spark.createDataFrame([("a", 0, 250), ("b", 1, 100), ("c", 2, 0)], "id string, key long, n_tokens long")
    rows = sorted((r["id"], r["piece"], r["start_token"], r["n_tokens"]) for r in packing.pack(items, 100).collect())
    assert rows == [("a", 0, 0, 100), ("a", 1, 100, 100), ("a", 2, 200, 50), ("b", 0, 0, 100), ("c", 0, 0, 0)]
    assert packing.pack(items.limit(0), 100).count() == 0
