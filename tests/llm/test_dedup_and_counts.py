"""Exact dedup, token counts, fingerprints and line dedup against brute force, and odd input."""

import hashlib
import re
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from phonolith.llm import exact_dedup, fingerprint, line_dedup, token_counts
from phonolith.llm import queries as llm_queries

from .conftest import ODD, SF, rows

WORDS = public_tokenizers.path("word_bpe_49k.json")


# --- exact dedup ---


def brute_exact(docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    return {(i, min(m)[1], len(m), hashlib.sha256(n.encode()).hexdigest()) for n, m in groups.items() for _, i in m}


@pytest.mark.parametrize("capacity,depth", [(None, None), (3, 12), (1, 4)])
def test_exact_dedup(docs, capacity, depth):
    got = rows(exact_dedup.dedup_exact(docs, capacity=capacity, max_depth=depth))
    assert len(got) == docs.count()
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got} == brute_exact(docs.select("doc_id", "text").collect())
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)


def test_exact_dedup_odd(odd, nothing, null_id):
    got = rows(exact_dedup.dedup_exact(odd))
    assert len(got) == len(ODD)
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got} == brute_exact([(r[0], r[1]) for r in ODD])
    by = {r["doc_id"]: r for r in got}
    # Most code points first, then the smallest id; a repeated row shares its fate.
    assert by[1]["keep_id"] == 3 and by[6]["keep_id"] == 4 and by[6]["group_size"] == 3
    assert sum(r["kept"] for r in got if r["doc_id"] == 4) == 2
    assert exact_dedup.dedup_exact(nothing).count() == 0
    lone = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in rows(exact_dedup.dedup_exact(null_id))}
    assert lone == {None: (None, True), 1: (1, True)}


def test_colliding_hashes_stay_apart(docs, monkeypatch):
    """With a hash of few values the chains are told apart by their bytes."""
    real = F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.pmod(real(*c), F.lit(7)))
    want = brute_exact(docs.select("doc_id", "text").collect())
    index = exact_dedup.ExactIndex.build(docs.where("doc_id % 2 = 0"), capacity=30).insert(docs.where("doc_id % 2 = 1"))
    for got in (rows(exact_dedup.dedup_exact(docs)), rows(index.rows())):
        assert {(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got} == want
        assert max(r["chain"] for r in got) > 0


def test_directory_splits_overfull_buckets(spark):
    slots = spark.range(1000).select(F.xxhash64("id").alias("h")).groupBy(exact_dedup._slot("h", 8).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    got = rows(exact_dedup.directory(slots.withColumn("base", F.lit(0)), 50, 8))
    assert max(r["n"] for r in got) <= 50 and min(r["depth"] for r in got) > 0
    # Each slot lies in exactly one bucket.
    held = [s for r in got for s in range(r["prefix"] << 8 - r["depth"], r["prefix"] + 1 << 8 - r["depth"])]
    assert len(held) == len(set(held)) and sum(r["n"] for r in got) == 1000


def test_insertion_splits_buckets_and_keeps_others(docs, spark):
    """Documents inserted later give the same as all at once; only touched buckets get new files."""
    first, second = docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 = 0")
    index = exact_dedup.ExactIndex.build(first, capacity=20)
    more = index.insert(second)
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows(more.rows())} == brute_exact(docs.select("doc_id", "text").collect())
    assert max(r["n"] for r in rows(more.buckets)) <= 20 < more.groups().count()
    assert max(r["depth"] for r in rows(more.buckets)) >= max(r["depth"] for r in rows(index.buckets))
    one = more.insert(docs.limit(1))
    assert sum(r["generation"] == 3 for r in rows(one.buckets)) == 1 and one.buckets.count() == more.buckets.count()
    # The index from before still gives what it gave.
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows(index.rows())} == brute_exact(first.select("doc_id", "text").collect())


# --- token counts ---


def test_token_counts_equal_library(docs, odd, nothing, null_id):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    for table in (docs, odd.select("doc_id", "text"), null_id):
        want = sorted((r[0] or -1, len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in table.select("doc_id", "text").collect())
        got = rows(token_counts.token_counts(table, WORDS))
        assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in got) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got)
    assert token_counts.token_counts(odd, WORDS).count() == len(ODD)
    assert token_counts.token_counts(nothing, WORDS).count() == 0


TEXTS = [
    "It's a Test,  of  chunks\nwith wörter don't 'll <|endoftext|> " * 3,
    "nowhitespaceatallinthisverylongrunofletters" * 6 + "1234'rex''ve''s!!'s'l'v'r'",
    "中文字符" * 20 + "'re'" + "é" * 30 + " 'v e 'll 'l l",
    "'", "'r", " ' ", "a'", "x" * 600 + "'t" + "y" * 600,
    "aGVsbG8gd29ybGQ" * 40,
]


@pytest.mark.parametrize("text", TEXTS)
def test_chunk_maps_compose(monkeypatch, text):
    """Any chunk length, any number of states kept and any grouping give the library's count."""
    from tokenizers import Tokenizer

    want = len(Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids)
    own = token_counts.TextTransducer(WORDS)
    assert own.count(text) == want
    for n, kept in ((1, 256), (2, 0), (3, 5), (7, 256), (50, 1)):
        monkeypatch.setattr(token_counts, "CHUNK", n)
        monkeypatch.setattr(token_counts, "TRACE", kept)
        assert own.count(text) == want
        piece = own.pieces(text)[0]
        maps = [own.unpacked(own.packed(own.chunk_map(c))) for c in token_counts.chunks(piece)]
        left, right = maps[0], maps[-1]
        for m in maps[1:]:
            left = own.compose(left, m)
        for m in maps[-2::-1]:
            right = own.compose(m, right)
        assert own.total([left]) == own.total([right]) == own.total(maps)


def test_texts_counted_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "CHUNK", 40)
    table = spark.createDataFrame([*enumerate(TEXTS), (None, TEXTS[0]), (3, TEXTS[1])], "doc_id long, text string")
    by_one, by_many = (sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in rows(token_counts.token_counts(table, WORDS, long=n))) for n in (10**6, 30))
    assert by_one == by_many and len(by_one) == len(TEXTS) + 2


def test_transducer_equals_merging():
    own = token_counts.TextTransducer(WORDS).words
    rng = np.random.default_rng(3)
    for _ in range(3000):
        word = "".join(rng.choice(list("aeinorstlhd"), rng.integers(1, 14)))
        units = (*word[:-1], word[-1] + own.end)
        assert own.count(word) == len(own._merge(units))


# --- fingerprints ---


def brute_vote(hashes):
    bits = 0
    for b in range(64):
        if 2 * sum(h >> b & 1 for h in hashes) > len(hashes):
            bits |= 1 << b
    return f"{bits:016x}"


def test_fingerprints_by_brute_force(spark, docs):
    table = docs.limit(60).select("doc_id", "text")
    texts = {r[0]: r[1] or "" for r in table.collect()}
    order = sorted(texts, reverse=True)
    after = {i: order[(k + 1) % len(order)] for k, i in enumerate(order)}
    edited = {i: t[: len(t) - len(t) // 2] + texts[after[i]][: len(t) // 2] for i, t in texts.items()}
    both = spark.createDataFrame([(i, 0, t) for i, t in texts.items()] + [(i, 1, t) for i, t in edited.items()], "i long, e int, t string")
    hashes = {(r[0], r[1]): [h % 2**64 for h in r[2]] for r in both.select("i", "e", fingerprint.shingle_hashes(F.col("t"))).collect()}
    want = {i: (len(t), hashlib.sha256(edited[i].encode()).hexdigest(), brute_vote(hashes[i, 0]), brute_vote(hashes[i, 1])) for i, t in texts.items()}
    got = {r["doc_id"]: r for r in rows(fingerprint.fingerprints(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))}
    assert {i: (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) for i, r in got.items()} == want
    like = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 64
    distance = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    for i, r in got.items():
        near = [(distance(r["edited_fingerprint"], o["fingerprint"]), j) for j, o in got.items()]
        assert r["found_id"] == (min(near)[1] if min(near)[0] <= 3 else None)
        assert r["near_edited"] == like(r["fingerprint"], r["edited_fingerprint"])
        assert r["near_next"] == like(r["fingerprint"], got[after[i]]["fingerprint"])


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_fingerprints_over_many_ranges(spark, parts):
    """Sparse, repeated and null ids: each row's next is the one below it, after the last the first."""
    ids = [0, 1, 2, 7, 8, 30, 31, 32, 100, 5000, -(2**62), 2**62] + [9] * 40 + [None] * 40
    table = spark.createDataFrame([(i, f"text {n}" * (n % 5 + 1)) for n, i in enumerate(ids)], "doc_id long, text string")
    got = {(r["part"], r["place"]): r for r in rows(fingerprint.with_next(table, parts))}
    assert len(got) == len(ids)
    at = max(got, key=lambda k: (k[0], -k[1]))
    seen = []
    for _ in ids:
        r = got[at]
        seen.append((r["doc_id"], r["text"]))
        at = r["next_part"], r["next_place"]
        assert r["next_text"] == got[at]["text"]
    assert at == max(got, key=lambda k: (k[0], -k[1]))
    assert [i for i, _ in seen] == sorted((i for i in ids if i is not None), reverse=True) + [None] * 40
    assert sorted(map(str, seen)) == sorted(map(str, ((r["doc_id"], r["text"]) for r in rows(table))))


def test_fingerprints_odd(odd, nothing, null_id, spark):
    found = rows(fingerprint.fingerprints(odd))
    assert sorted(r["doc_id"] for r in found) == sorted(r[0] for r in ODD)  # repeated rows are documents each
    got = {r["doc_id"]: r for r in found}
    assert got[1]["fingerprint"] == got[2]["fingerprint"] == got[3]["fingerprint"] == "0" * 16
    assert got[1]["n_chars"] == 0 and got[7]["n_chars"] == len(ODD[7][1])
    assert fingerprint.fingerprints(nothing).count() == 0
    assert fingerprint.fingerprints(null_id.unionByName(null_id.limit(1))).count() == 3
    lone = rows(fingerprint.fingerprints(null_id.where("doc_id = 1")))[0]
    assert lone["near_next"] == 1.0  # a single document is its own next


def test_hot_keys_join_whole(spark):
    from phonolith.llm.shared import join_hot

    big = spark.range(30_000).selectExpr("id", "if(id % 3 = 0, 0, id) key")
    unique = big.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    got = join_hot(big, unique, ["key"], "n", ["id"])
    assert got.columns == ["key", "id", "least"]
    assert got.count() == 30_000 and got.where("least <> if(key = 0, 0, id)").isEmpty()


def test_search_finds_all(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**63), 2**63, 30, dtype=np.int64).tolist()
    fps = set(base)
    for b in base:
        for _ in range(4):
            x = b
            for bit in rng.choice(63, rng.integers(1, 6), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    index, queries = sorted(fps)[::2], sorted(fps)
    near = lambda a, b: ((a ^ b) % 2**64).bit_count()
    want = {(q, i, near(q, i)) for q in queries for i in index if near(q, i) <= 3}
    qs = spark.createDataFrame([(f,) for f in queries] + [(None,), (base[0],)], "q long")
    got = fingerprint.search_fingerprints(qs, spark.createDataFrame([(f,) for f in index] + [(None,)], "fp long"))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    with pytest.raises(ValueError):
        fingerprint.search_fingerprints(qs, qs.withColumnRenamed("q", "fp"), radius=6)


# --- line dedup ---


def brute_lines(docs):
    key = lambda l: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", l).translate({c: c + 32 for c in range(65, 91)})
    held = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                held[key(line)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        keep = [l for l in lines if len(held[key(l)]) < 2 or min(held[key(l)]) == i]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out)


def digest(df):
    return sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in rows(df))


def test_line_dedup(docs):
    want = brute_lines(docs.select("doc_id", "text").collect())
    assert digest(line_dedup.dedup_lines(docs)) == want
    assert sum(w[2] for w in want) > 0


@pytest.mark.parametrize("limit", [0, 5000])
def test_line_dedup_with_shards_in_turn(docs, monkeypatch, limit):
    """However few filters are sent at a time, the result is the same."""
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", limit)
    index = line_dedup.LineIndex.build(docs, per_shard=40)
    assert index.shards >= 4
    assert digest(index.apply(docs)) == brute_lines(docs.select("doc_id", "text").collect())


def test_line_dedup_odd(odd, nothing, null_id):
    got = line_dedup.dedup_lines(odd)
    assert digest(got) == brute_lines([(r[0], r[1]) for r in ODD])
    assert set(got.columns) == set(odd.columns) | {"n_dropped"}
    assert line_dedup.dedup_lines(nothing).count() == 0
    both = null_id.withColumn("text", F.lit("the very same line"))
    assert {r["doc_id"]: r["n_dropped"] for r in rows(line_dedup.dedup_lines(both))} == {None: 1, 1: 0}


def state(index):
    return (
        sorted(map(tuple, index.postings.collect())),
        sorted(map(tuple, index.counts.collect())),
        {r["shard"]: sorted(np.frombuffer(bytes(r["data"]), "<u2")[np.frombuffer(bytes(r["data"]), "<u2") > 0].tolist()) for r in index.filters.collect()},
    )


def test_insert_and_delete_are_reversible(docs):
    first, second = docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 = 0")
    index = line_dedup.LineIndex.build(first, per_shard=50)
    more = index.insert(second)
    assert digest(more.apply(docs)) == brute_lines(docs.select("doc_id", "text").collect())
    back = more.delete(second.select("doc_id"))
    assert state(back) == state(index)
    gone = more.delete(first.where("doc_id < 40").select("doc_id"))
    rest = docs.where("doc_id >= 40 or doc_id % 3 = 0")
    assert digest(gone.apply(rest)) == brute_lines(rest.select("doc_id", "text").collect())


def test_changes_read_and_write_touched_shards_alone(docs, spark):
    index = line_dedup.LineIndex.build(docs, per_shard=30)
    line = "a line that stands in two new documents"
    more = index.insert(spark.createDataFrame([(10**6, line), (10**6 + 1, line)], "doc_id long, text string"))
    for kind in ("_postings", "_counts", "_filters"):
        before, after = getattr(index, kind).folders, getattr(more, kind).folders
        assert sum(before.get(s) != after[s] for s in after) == 1
    assert more.counts.count() == index.counts.count() + 1
    assert state(more.delete(spark.createDataFrame([(10**6,), (10**6 + 1,)], "doc_id long"))) == state(index)


def test_shards_split(docs):
    index = line_dedup.LineIndex.build(docs.limit(5), per_shard=20)
    more = index.insert(docs.join(docs.limit(5).select("doc_id"), "doc_id", "left_anti"))
    assert more.shards > index.shards
    assert digest(more.apply(docs)) == brute_lines(docs.select("doc_id", "text").collect())


def test_cuckoo_filter():
    rng = np.random.default_rng(2)
    keys = rng.integers(-(2**63), 2**63, (5000, 2), dtype=np.int64)
    own = line_dedup.CuckooFilter.sized(5000)
    assert own.insert(keys[:, 0], keys[:, 1]) and own.contains(keys[:, 0], keys[:, 1]).all()
    other = rng.integers(-(2**63), 2**63, (20000, 2), dtype=np.int64)
    assert own.contains(other[:, 0], other[:, 1]).mean() < 0.002
    own.delete(keys[:2500, 0], keys[:2500, 1])
    assert own.contains(keys[2500:, 0], keys[2500:, 1]).all() and own.contains(keys[:2500, 0], keys[:2500, 1]).mean() < 0.01
    full = line_dedup.CuckooFilter(4)
    assert not full.insert(keys[:100, 0], keys[:100, 1])


@pytest.mark.parametrize("name", sorted(llm_queries.oracle_sql()))
def test_oracles(spark, docs, name):
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    got, want = llm_queries.queries()[name](spark, SF), duck.sql(llm_queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    pick = lambda r, c: tuple(v for _, v in sorted(zip(c, r)))
    assert sorted(pick(r, got.columns) for r in got.collect()) == sorted(pick(r, want.columns) for r in want.fetchall())
