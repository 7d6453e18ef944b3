"""Near copies, mixing, the classifier and the pipeline against brute force, and odd input."""

import ctypes
import math
import pickle
import re
import struct
import time
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from phonolith.llm import components, mixing, near_copies, quality, shared, simhash_dedup

from .conftest import ODD, SF, rows


def roots_of(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# --- components ---


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 150, (90, 2))] + [(200 + i, 201 + i) for i in range(40)] + [(300, 300)]
    nodes = {n for e in edges for n in e}
    got = {r["node"]: r["root"] for r in rows(components.connected_components(spark.createDataFrame(edges, "a long, b long")))}
    assert got == roots_of(nodes, edges)


def test_no_edges(spark):
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- SimHash near-dedup ---


def brute_simhash(text, words):
    parts = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    if not parts:
        return 0
    grams = [" ".join(parts[i : i + words]) for i in range(len(parts) - words + 1)] or [" ".join(parts)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_by_brute_force(docs):
    for r in [*docs.limit(30).collect(), *ODD]:
        for words in (1, 3, 5):
            assert simhash_dedup.simhash(r[1] or "", words) == brute_simhash(r[1], words)


def dense_fingerprints():
    """Clusters around centres, chains, the zero and the highest bit."""
    rng = np.random.default_rng(7)
    out = {0, 1, 3, 7, 2**63, 2**63 + 1}
    for centre in rng.integers(0, 2**64, 12, dtype=np.uint64).tolist():
        for _ in range(25):
            x = centre
            for bit in rng.choice(64, rng.integers(0, 6), replace=False):
                x ^= 1 << int(bit)
            out.add(x)
    base = int(rng.integers(0, 2**63))
    for bits in combinations(range(20), 2):  # a dense cluster within one segment
        out.add(base ^ 1 << bits[0] ^ 1 << bits[1])
    return sorted(out)


@pytest.mark.parametrize("hot", [1, 2, 5, 64])
def test_links_have_the_components_of_all_pairs(spark, hot):
    fps = dense_fingerprints()
    want = roots_of(fps, [(a, b) for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= 2])
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    table = spark.createDataFrame([(signed(f),) for f in fps] * 2 + [(None,)], "fp long")
    links = [(r["a"] % 2**64, r["b"] % 2**64) for r in rows(simhash_dedup.link_fingerprints(table, hot=hot))]
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    assert roots_of(fps, links) == want


def test_variants_are_dealt_out_once(spark):
    """66 rows of each fingerprint for the counts; where members are looked up, two."""
    n, sc, name = 3000, spark.sparkContext, "spark.sql.autoBroadcastJoinThreshold"
    far = np.random.default_rng(5).integers(0, 2**63, n).tolist()
    table = spark.createDataFrame([(f,) for f in far] + [(f ^ 1,) for f in far[:20]], "fp long").localCheckpoint()
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")  # as where the shared keys are too many to be sent
    sc.setJobGroup("links", "links")
    try:
        assert len(rows(simhash_dedup.link_fingerprints(table))) == 20
    finally:
        spark.conf.set(name, before)
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup("links") for s in tracker.getJobInfo(j).stageIds}
    assert 66 * n < sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages) < 90 * n


def test_members_of_a_hot_segment_join_whole(spark):
    """Over 4096 fingerprints with one segment."""
    base = 0x0123456789ABCDEF
    least = np.arange(5000) * 8 & 0xFFFFFFFF  # bits 0 to 2 are clear
    fps = sorted({base & ~0xFFFFFFFF | int(x) for x in least} | {base & ~0xFFFFFFFF | int(x) | 1 for x in least[:50]} | {1 << 62})
    found = set(fps)
    near = [1 << i for i in range(64)] + [1 << i | 1 << j for i, j in combinations(range(64), 2)]
    want = roots_of(fps, [(a, a ^ x) for a in fps for x in near if a ^ x in found])
    table = spark.createDataFrame([(f,) for f in fps], "fp long")
    assert roots_of(fps, [(r["a"], r["b"]) for r in rows(simhash_dedup.link_fingerprints(table))]) == want


def test_near_dedup_components(docs, odd, nothing, null_id):
    for table in (docs, odd):
        texts = table.select("doc_id", "text").collect()
        fps = [(i, brute_simhash(t, 3)) for i, t in texts]
        ids = roots_of({i for i, _ in fps}, [(a, b) for (a, x), (b, y) in combinations(fps, 2) if (x ^ y).bit_count() <= 2])
        got = rows(simhash_dedup.near_dedup_components(table))
        assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == sorted((i, f"{x:016x}", ids[i]) for i, x in fps)
    assert simhash_dedup.near_dedup_components(nothing).count() == 0
    assert {(r["doc_id"], r["component_id"]) for r in rows(simhash_dedup.near_dedup_components(null_id))} == {(None, None), (1, 1)}


# --- near copies by shingles ---


def edited_copies(n, edits, seed):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("aeinorst"), 7))
    base = [word() for _ in range(120)]
    out = []
    for _ in range(n):
        own = list(base)
        for at in rng.choice(len(own), edits, replace=False):
            own[at] = word()
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("hot", [64, 3])
def test_near_copies_are_found_and_others_stay(spark, hot):
    texts = edited_copies(30, 1, 1) + edited_copies(20, 2, 2) + [t for s in range(40) for t in edited_copies(1, 0, 100 + s)] + ["two words", "TWO  words", "", None]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [near_copies.shingles(near_copies.words_of(t)) for t in texts]
    links = [(a, b) for a, b in combinations(range(len(texts)), 2) if near_copies.jaccard(sets[a], sets[b]) >= 0.8]
    want = roots_of(range(len(texts)), links)
    got = {r["doc_id"]: r["first"] for r in rows(near_copies.near_copy_groups(table, hot=hot))}
    # A key beyond ``hot`` may lose a link that only members settled before could give.
    assert sum(got[a] == got[b] for a, b in links) >= (1 if hot > 3 else 0.95) * len(links)
    assert all(want[i] == want[root] for i, root in got.items())
    kept = near_copies.drop_near_copies(table, hot=hot)
    assert sorted(r["doc_id"] for r in rows(kept)) == sorted(set(got.values()))


def test_near_copies_on_documents(docs):
    """No false pair, and nearly all pairs of the brute-force join."""
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    sets = {i: near_copies.shingles(near_copies.words_of(t)) for i, t in texts.items()}
    links = [(a, b) for a, b in combinations(sorted(texts), 2) if near_copies.jaccard(sets[a], sets[b]) >= 0.8]
    want = roots_of(texts, links)
    got = {r["doc_id"]: r["first"] for r in rows(near_copies.near_copy_groups(docs))}
    assert sum(got[a] == got[b] for a, b in links) >= 0.95 * len(links) and links
    members = defaultdict(set)
    for i, root in want.items():
        members[root].add(i)
    assert all(want[i] == want[root] for i, root in got.items())


@pytest.mark.parametrize("hot", [64, 3])
def test_near_copies_around_a_base(spark, hot):
    """Copies edited apart from one base are similar to it alone, and the base has not the least id."""
    base = edited_copies(1, 0, 5)[0].split()
    rng = np.random.default_rng(6)
    texts = []
    for n in range(1500):
        own = list(base)
        for at in rng.choice(np.arange(2, len(base) - 2), 2, replace=False):
            own[at] = f"new{n}x{at}"
        texts.append(" ".join(own))
    texts.insert(700, " ".join(base))
    sets = [near_copies.shingles(near_copies.words_of(t)) for t in texts]
    assert all(near_copies.jaccard(sets[700], s) >= 0.8 for s in sets)
    assert np.mean([near_copies.jaccard(sets[0], s) >= 0.8 for s in sets[1:]]) < 0.1
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["first"] for r in rows(near_copies.near_copy_groups(table, hot=hot))}
    assert set(got.values()) == {0} and len(got) == len(texts)


def test_near_copies_by_kind_of_edit(spark):
    """Appended, cut and re-ended copies of every similarity from 0.8: all pairs of the brute-force join."""
    rng = np.random.default_rng(8)
    texts = []
    for length in (40, 100, 300, 800):
        for share in (0.81, 0.84, 0.88, 0.92):
            for kind in ("appended", "cut", "re-ended"):
                for _ in range(4):
                    base = [f"w{x}" for x in rng.integers(0, 10**9, length)]
                    more = [f"w{x}" for x in rng.integers(0, 10**9, length)]
                    n = length - 4
                    if kind == "appended":
                        other = base + more[: int(n / share) - n]
                    elif kind == "cut":
                        other = base[: math.ceil(share * n) + 4]
                    else:
                        same = math.ceil(2 * share / (1 + share) * n) + 4
                        other = base[:same] + more[same:]
                    texts += [" ".join(base), " ".join(other)]
    sets = [near_copies.shingles(near_copies.words_of(t)) for t in texts]
    pairs = [(a, a + 1) for a in range(0, len(texts), 2)]
    assert all(near_copies.jaccard(sets[a], sets[b]) >= 0.8 for a, b in pairs)
    got = {r["doc_id"]: r["first"] for r in rows(near_copies.near_copy_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))}
    assert [p for p in pairs if got[p[1]] != p[0]] == []


def near_texts(n=30, words=60):
    """Texts in pairs: one word in the middle of the second is another."""
    rng = np.random.default_rng(4)
    for _ in range(n):
        own = [f"w{k}" for k in rng.integers(0, 5000, words)]
        yield " ".join(own)
        yield " ".join([*own[: words // 2], "other", *own[words // 2 + 1 :]])


def test_near_copies_are_linked_by_simhash_first(spark, monkeypatch):
    """Without the shared shingles, the links of operator 8 are found and verified."""
    texts = [*near_texts(words=800), "a b c d e f", "a b c d e f g"]
    fps = [simhash_dedup.simhash(t, 3) for t in texts]
    sets = [near_copies.shingles(near_copies.words_of(t)) for t in texts]
    links = [(a, b) for a, b in combinations(range(len(texts)), 2) if (fps[a] ^ fps[b]).bit_count() <= 2]
    real = [(a, b) for a, b in links if near_copies.jaccard(sets[a], sets[b]) >= 0.8]
    assert len(real) > 5
    monkeypatch.setattr(near_copies, "_live", lambda *_: spark.createDataFrame([], "key long, doc_id long, size int, at int, n long"))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["first"] for r in rows(near_copies.near_copy_groups(table))}
    assert got == roots_of(range(len(texts)), real)


def test_bitmaps_never_say_too_much():
    rng = np.random.default_rng(5)
    for n, m, both in [(1, 1, 0), (1, 1, 1), (60, 64, 50), (65, 64, 60), (300, 280, 250), (1000, 3000, 900), (5, 4000, 5)]:
        x = np.unique(rng.integers(0, 1 << 63, n + m, np.uint64))
        a, b = x[:n], x[n - both : n - both + m]
        apart = len(a) + len(b) - 2 * len(np.intersect1d(a, b))
        assert near_copies.least_apart(near_copies.bitmap(a), near_copies.bitmap(b)) <= apart
        assert near_copies.least_apart(near_copies.bitmap(b), near_copies.bitmap(a)) <= apart
    far = near_copies.least_apart(near_copies.bitmap(rng.integers(0, 1 << 63, 300, np.uint64)), near_copies.bitmap(rng.integers(0, 1 << 63, 300, np.uint64)))
    assert far > 600 / 9  # such a pair goes


def test_near_copies_leave_no_shuffle_files(spark):
    def files():
        found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    table = spark.createDataFrame(list(enumerate(near_texts())), "doc_id long, text string")
    held = near_copies.near_copy_groups(table)  # keeps its plans alive
    before = files()
    again = near_copies.near_copy_groups(table)
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert held.count() == again.count() == 60


def _own_mb() -> float:
    return int(re.search(r"\nPss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024


def test_collected_memory_goes_back_to_the_system(spark):
    """The heap and what the C libraries keep of freed memory, not only what lives in them (F1: 1500 MB of the driver)."""
    run = spark._jvm.java.lang.Runtime.getRuntime()
    bean = spark._jvm.java.lang.management.ManagementFactory.getPlatformMXBean(spark._jvm.java.lang.Class.forName("com.sun.management.HotSpotDiagnosticMXBean"))
    before = bean.getVMOption("MaxHeapFreeRatio").getValue()
    held = [spark.sparkContext._gateway.new_array(spark._jvm.byte, 4 << 20) for _ in range(60)]
    del held
    libc = ctypes.CDLL(None)
    libc.malloc.restype, libc.malloc.argtypes, libc.free.argtypes = ctypes.c_void_p, [ctypes.c_size_t], [ctypes.c_void_p]
    blocks = [libc.malloc(60_000) for _ in range(1500)]
    for b in blocks:
        ctypes.memset(b, 1, 60_000)
    for b in blocks[:-1]:
        libc.free(b)  # the last one keeps the free ones below it from going back by themselves
    kept = _own_mb()
    shared.collect_garbage(spark)
    assert kept - _own_mb() > 60
    assert run.totalMemory() <= 2 * (run.totalMemory() - run.freeMemory()) + (16 << 20)
    assert bean.getVMOption("MaxHeapFreeRatio").getValue() == before  # for the others of this JVM as it was
    assert "rim native heap" in shared._diagnostic(spark, "systemTrimNativeHeap")
    libc.free(blocks[-1])


def test_each_pipeline_stage_begins_with_the_memory_given_back(spark, docs, monkeypatch):
    import corpus_pipeline

    class Begun(Exception):
        pass

    class Documents:
        def __getattr__(self, name):
            raise Begun

    called = []
    monkeypatch.setattr(corpus_pipeline, "collect_garbage", called.append)
    for _, stage in corpus_pipeline.STAGES:
        with pytest.raises(Begun):
            stage(spark, Documents(), SF)
    assert called == [spark] * 5


def test_near_copies_odd(odd, nothing, null_id):
    kept = near_copies.drop_near_copies(odd)
    assert kept.columns == odd.columns
    # 1, 2 and 3 have no words; 5 repeats 4 but for case; 8 has too many new shingles beside 7's few.
    assert Counter(r["doc_id"] for r in rows(kept)) == Counter({1: 1, 4: 2, 6: 1, 7: 1, 8: 1, 9: 1, 10: 1, 11: 1})
    assert near_copies.drop_near_copies(nothing).count() == 0
    assert near_copies.drop_near_copies(null_id).count() == 2


# --- mixing ---


def test_raking_meets_all_margins():
    rng = np.random.default_rng(4)
    cells = pd.DataFrame([(s, l, t, int(rng.integers(500, 1000))) for s in "abc" for l in "de" for t in "01"], columns=["source", "lang", "topic", "tokens"])
    goals = {"source": pd.Series({"a": 0.2, "b": 0.3, "c": 0.5}), "lang": pd.Series({"d": 0.6, "e": 0.4}), "topic": pd.Series({"0": 0.5, "1": 0.5})}
    for keep in (0.01, 0.5):
        most = cells["tokens"].to_numpy(float) / (keep * cells["tokens"].sum())
        cells["w"], gap = mixing.rake(cells, goals, most)
        assert gap < 1e-5 and (cells["w"] <= most).all()
        for m, goal in goals.items():
            assert np.allclose(cells.groupby(m)["w"].sum(), goal, atol=1e-5)
    assert mixing.rake(cells, goals, most / 10)[1] > 0.1  # too little to meet them is told


@pytest.mark.parametrize("keep", [0.1, 0.5, 0.9, 1.0])
def test_targets_stay_within_what_there_is(keep):
    tokens = pd.Series({"a": 900, "b": 90, "c": 10, "d": 0})
    goal = mixing._targets(tokens, None, 0.5, keep * 1000)
    assert goal.sum() == pytest.approx(1) and (goal <= tokens / (keep * 1000) + 1e-12).all() and goal["d"] == 0
    if keep == 1.0:
        assert np.allclose(goal, tokens / 1000)
    goal = mixing._targets(tokens, {"a": 0.25, "b": 0.75}, 0.5, keep * 990)  # of the 990 tokens that may be drawn
    assert goal.sum() == pytest.approx(1) and goal["b"] == pytest.approx(min(0.75, 90 / (keep * 990)))


def brute_mix(got, targets, keep, temper, seed):
    """Probability and draw of each row by plain loops from the rows' source, language, topic and tokens."""
    margins = ("source", "lang", "topic")
    cells = Counter()
    for r in got:
        cells[tuple(r[m] for m in margins)] += r["n_tokens"]
    usable = {c: t for c, t in cells.items() if t and all(m not in targets or targets[m].get(c[i], 0) > 0 for i, m in enumerate(margins))}
    room = keep * sum(usable.values())

    def cut(held, base):
        full = set()
        while True:
            left, free = 1 - sum(held[k] / room for k in full), sum(b for k, b in base.items() if k not in full)
            goal = {k: held[k] / room if k in full else base[k] / free * left for k in held}
            new = {k for k in held if goal[k] > held[k] / room + 1e-15 and k not in full}
            if not new or len(full | new) == len(held):
                return goal
            full |= new

    tempered, goals = cut(usable, {c: t**temper for c, t in usable.items()}), {}
    for i, m in enumerate(margins):
        held, goals[m] = Counter(), Counter()
        for c, t in usable.items():
            held[c[i]] += t
            goals[m][c[i]] += tempered[c]
        if m in targets:
            goals[m] = cut(held, {k: targets[m].get(k, 0) for k in held})
    w = {c: t / sum(usable.values()) for c, t in usable.items()}
    for _ in range(1000):
        gap = 0.0
        for i, m in enumerate(margins):
            now = Counter()
            for c, v in w.items():
                now[c[i]] += v
            gap = max([gap, *(abs(now[k] - g) for k, g in goals[m].items())])
            w = {c: min(usable[c] / room, v * goals[m][c[i]] / now[c[i]]) for c, v in w.items()}
        if gap < 1e-6:
            break
    out = []
    for r in got:
        c = tuple(r[m] for m in margins)
        p = 1.0 if not cells[c] else min(1.0, w[c] * room / usable[c]) if c in usable else 0.0
        h = xxhash.xxh64_intdigest(struct.pack("<i", seed), xxhash.xxh64_intdigest(struct.pack("<q", r["doc_id"]), 42))
        out.append((r["doc_id"], p, (h >> 11) / 2**53 < p))
    return out


@pytest.mark.parametrize("targets,keep", [({}, 0.5), ({}, 0.9), ({"lang": {"en": 0.5, "de": 0.25, "fr": 0.25}}, 0.3)])
def test_mixing_by_brute_force(docs, targets, keep):
    got = rows(mixing.mix(docs, targets=targets, keep=keep))
    assert len(got) == docs.count()
    assert all(r["n_tokens"] == len(t.split()) for r, t in zip(sorted(got, key=lambda r: r["doc_id"]), (r[0] for r in docs.orderBy("doc_id").select("text").collect())))
    for r, (i, p, drawn) in zip(got, brute_mix(got, targets, keep, 0.5, 6)):
        assert r["doc_id"] == i and r["probability"] == pytest.approx(p, abs=1e-7) and (r["sampled"] == drawn or abs(r["probability"] - p) > 0)


def test_expected_sample_has_the_target_shares(spark, docs):
    """Also where some documents are certain."""
    got = pd.DataFrame(rows(mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), keep=0.8)))
    expected = got["probability"] * got["n_tokens"]
    assert expected.sum() == pytest.approx(0.8 * got["n_tokens"].sum(), rel=1e-3) and (got["probability"] >= 1).any()
    cells = got.groupby(["source", "lang", "topic"], dropna=False)["n_tokens"].sum().reset_index()
    cells["goal"] = mixing._targets(cells["n_tokens"], None, 0.5, 0.8 * got["n_tokens"].sum())
    for m in ("source", "lang", "topic"):
        goal = cells.groupby(m)["goal"].sum()
        assert np.allclose((expected / expected.sum()).groupby(got[m]).sum().reindex(goal.index), goal, atol=1e-4)


def test_mixing_of_many_cells_is_the_same(docs):
    """Beyond ``driver_cells`` the same steps run as aggregations."""
    few, many = (rows(mixing.mix(docs, keep=0.8, rounds=6, driver_cells=n)) for n in (mixing.DRIVER_CELLS, 0))
    by = {r["doc_id"]: r for r in many}
    assert len(few) == len(by) and all(by[r["doc_id"]]["probability"] == pytest.approx(r["probability"], rel=1e-9) for r in few)
    with pytest.raises(ValueError):
        mixing.mix(docs, keep=0.8, rounds=1, strict=True)


def test_mixing_odd(odd, nothing, null_id):
    got = rows(mixing.mix(odd))
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in ODD)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["source"] is None and by[1]["lang"] is None and by[1]["topic"] is None and by[1]["n_tokens"] == 0 and by[1]["sampled"]
    assert len({(r["sampled"], r["probability"]) for r in got if r["doc_id"] == 4}) == 1
    assert mixing.mix(nothing).count() == 0
    assert mixing.mix(nothing, driver_cells=-1).count() == 0
    assert mixing.mix(null_id, keep=1.0).where("sampled").count() == 2
    kept = mixing.sample(odd.unionByName(odd.withColumn("doc_id", F.lit(None).cast("long"))), keep=1.0)
    assert kept.columns == odd.columns and kept.count() == 2 * len(ODD)


def test_topics_group_texts_of_a_kind(spark):
    """Texts on two subjects with their own words, beside words that all have, fall into clusters of one subject."""
    rng = np.random.default_rng(1)
    common, own = [f"the{n}" for n in range(20)], [[f"{k}{n}" for n in range(40)] for k in ("star", "fish")]
    texts = [" ".join([*rng.choice(common, 30), *rng.choice(own[n % 2], 30)]) for n in range(300)]
    table = spark.createDataFrame([(n, t, "en", "a") for n, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = rows(mixing.mix(table, topics=4))
    kinds = defaultdict(Counter)
    for r in got:
        kinds[r["topic"]][r["doc_id"] % 2] += 1
    assert len(kinds) > 1 and sum(max(c.values()) for c in kinds.values()) >= 0.97 * len(got)
    terms = mixing.Terms()
    assert terms.of(["Fish,", "fish"]) == terms.of(["fish"]) * 2 and terms.of(["--"]) == [0]


def test_terms_are_counted_once_and_as_they_are(spark, docs, monkeypatch):
    """The texts are split for one written table, from which frequencies and vectors come."""
    some, seen, made = docs.limit(40), {}, mixing.written

    def record(df, name, *a, **k):
        out = made(df, name, *a, **k)
        seen.setdefault(name, [r.asDict() for r in out.collect()] if name == "mixing-counts" else None)
        return out

    monkeypatch.setattr(mixing, "written", record)
    own = mixing._frequencies
    monkeypatch.setattr(mixing, "_frequencies", lambda table: seen.setdefault("frequencies", own(table)))
    got = mixing.facts(some, "doc_id", "text", 6, None, 4, ["doc_id"])
    terms = mixing.Terms()
    want = {r["doc_id"]: Counter(terms.of((r["text"] or "").split())) for r in some.collect()}
    for c in want.values():
        c.pop(0, None)
    for r in seen["mixing-counts"]:
        assert dict(zip(np.frombuffer(r["__terms"], "<u2").tolist(), np.frombuffer(r["__counts"], "<u4").tolist())) == want[r["__c0"]]
    n, frequency = seen["frequencies"]
    assert n == 40 and frequency[1:].sum() == sum(map(len, want.values()))
    assert all(frequency[t] == sum(t in c for c in want.values()) for c in want.values() for t in c)
    assert got.count() == 40


# --- quality ---


@pytest.fixture(scope="module")
def labels(spark, docs):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_accuracy(spark):
    """Trained on a part of the labels, judged on the rest."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in rows(quality.classify(docs, labels.where("doc_id % 3 <> 0")))}
    held = [(got[r["doc_id"]], r) for r in labels.where("doc_id % 3 = 0").collect()]
    right = sum((g["quality_score"] >= 0.5) == (r["quality"] == 1) for g, r in held)
    assert right >= 0.92 * len(held)
    clean = [g["keep"] for g, r in held if r["quality"] == 1 and r["toxic"] == 0]
    assert sum(clean) >= 0.97 * len(clean)
    assert sum(g["toxic_score"] for g, r in held if r["toxic"]) / sum(r["toxic"] for _, r in held) > 0.3


def test_views_teach_each_other():
    """With few labels, pseudo-labels from a view that knows better lift the other."""
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 600)
    rows_ = [quality.Row(np.zeros(0), np.array([int(v) * 5 + int(rng.integers(0, 5))]), np.array([int(v)]), float(v)) for v in y]
    none = np.zeros(0)

    def right(trainer):
        text, _ = quality.sparse_of(rows_, none, none)
        return ((text.logits(trainer.weights["text"]) > 0) == (y == 1)).mean()

    trainer = quality.CoTraining(rows_[:6], none, none)
    trainer.learn(200)
    alone = right(trainer)
    for _ in range(3):
        p = trainer.sure(*quality.sparse_of(rows_[6:], none, none))["meta"]
        best = np.argsort(-np.abs(p - 0.5), kind="stable")[:200]
        trainer.teach("meta", [quality.Row(r.shape, r.words, r.meta, float(p[i] > 0.5)) for i in best for r in [rows_[6 + i]]])
        trainer.learn(40)
    assert right(trainer) > 0.97 > alone
    assert not quality.CoTraining([], none, none).ready


def test_scores_by_brute_force(spark, docs, labels):
    """Each row's scores, recomputed one by one from the text and the fitted weights."""
    found = quality.features(docs)
    model = quality.train(found, labels)
    got = {r["doc_id"]: r for r in rows(quality.classify(docs, labels))}
    buckets, sigmoid = quality.Buckets(), lambda z: 1 / (1 + math.exp(-max(-30, min(30, z))))
    for r in docs.collect():
        x = (np.array(quality.shape(r["text"] or ""), np.float32) - model.mean) / model.scale
        words, meta = buckets.of(r["text"] or ""), quality.metadata(r["lang"], r["source"], r["n_chars"])
        for view, score in ((model.quality, "quality_score"), (model.toxic, "toxic_score")):
            a = sum(v * w for v, w in zip(x, view.text)) + sum(view.text[quality.SHAPES + w] for w in words) + view.text[-1]
            b = sum(view.meta[m] for m in meta) + view.meta[-1]
            assert got[r["doc_id"]][score] == pytest.approx(sigmoid(view.mix[0] * a + view.mix[1] * b + view.mix[2]), abs=1e-6)


def test_the_surest_of_all_unlabelled_are_found(spark, docs, labels):
    """The distributed search gives what sorting all scores gives."""
    found = quality.features(docs)
    got = found.orderBy("uid").collect()
    each = {r["doc_id"]: r for r in labels.collect()}
    known = [quality._row(r, float(each[r["id"]]["quality"])) for r in got if r["id"] in each]
    trainer = quality.CoTraining(known, np.zeros(quality.SHAPES), np.ones(quality.SHAPES))
    trainer.learn(30)
    pool = [r for r in got if r["id"] not in each]
    table = found.where(~F.col("id").isin(list(each)))
    surest = quality._surest(table, {"quality": trainer}, 5, 0.6, {pool[0]["uid"]})
    for view, p in trainer.sure(*quality.sparse_of([quality._row(r, math.nan) for r in pool], trainer.mean, trainer.scale)).items():
        want = sorted((float(s) for s, r in zip(p, pool) if s >= 0.6 and r["uid"] != pool[0]["uid"]), reverse=True)[:5]
        mine = [r["p"] for r in surest.where(F.col("list") == f"quality/{view}/1").orderBy(F.desc("p")).limit(5).collect()]
        assert mine == pytest.approx(want, abs=1e-5)


def test_marks(spark):
    rng = np.random.default_rng(3)
    marked = sorted({int(k) for k in rng.integers(0, 1000, 300)} | {0, 63, 64, 127, (5 << 33) + 63, (5 << 33) + 64})
    marks = quality.Marks.of(spark.createDataFrame([(k,) for k in marked], "uid long").repartition(3))
    every = np.array([*range(1100), *range(5 << 33, (5 << 33) + 200), 9 << 33], np.int64)
    assert every[marks.has(every)].tolist() == marked
    none = quality.Marks.of(spark.createDataFrame([], "uid long"))
    assert not none.has(every).any()


def test_features_are_written_once(docs, labels, monkeypatch):
    """But for the few surest rows; and no labelled row is among these."""
    seen, made = {}, quality.written

    def record(df, name, *a, **k):
        out = made(df, name, *a, **k)
        if "words" in df.columns:
            seen.setdefault(name, [r["uid"] for r in out.select("uid").collect()])
        if name == "quality-features":
            seen["ids"] = {r["uid"]: r["id"] for r in out.select("uid", "id").collect()}
        return out

    monkeypatch.setattr(quality, "written", record)
    quality.train(quality.features(docs), labels, most=5, sure=0.5)
    ids = seen.pop("ids")
    known = {r["doc_id"] for r in labels.where("quality is not null or toxic is not null").collect()}
    assert set(seen) == {"quality-features", "quality-surest"}
    assert seen["quality-surest"] and not {ids[u] for u in seen["quality-surest"]} & known


def test_tasks_get_the_weights_alone(spark, docs, labels, monkeypatch):
    """What is sent to tasks does not grow with the rows that were learnt from."""
    sizes, kind = [], type(spark.sparkContext)

    def record(self, value, send=kind.broadcast):
        sizes.append(len(pickle.dumps(value)))
        return send(self, value)

    monkeypatch.setattr(kind, "broadcast", record)
    quality.train(quality.features(docs), labels, most=5, sure=0.5)
    weights = 2 * 8 * (quality.SHAPES + quality.BUCKETS + 1 + quality.META + 1)
    assert sizes and max(sizes) < weights + 10_000


def test_shape():
    assert quality.shape("") == [0.0] * quality.SHAPES and len(quality.shape("a b A!! | 9")) == quality.SHAPES


def test_quality_odd(spark, odd, nothing, null_id, labels):
    none = labels.limit(0)
    got = rows(quality.classify(odd, none))
    assert len(got) == len(ODD) and all(r["keep"] and r["quality_score"] == 1.0 and r["toxic_score"] == 0.0 for r in got)
    some = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (7, 0, 1), (10, 0, None), (None, 1, 1), (9, None, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.classify(odd, some).where("quality_score is null or keep is null").count() == 0
    assert quality.classify(nothing, some).count() == 0
    assert quality.classify(null_id, labels).count() == 2


# --- pipeline ---


def test_pipeline_stages(spark, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["quality", "lines", "near copies", "mixing", "packing"]
    now, seen = docs, []
    for name, stage in pipeline.STAGES[:-1]:
        new = pipeline.written(stage(spark, now, SF), "test-stage")
        assert new.columns == pipeline.COLUMNS
        seen.append((name, now, new))
        now = new
    for name, before, after in seen:
        ids, kept = ({r["doc_id"] for r in df.select("doc_id").collect()} for df in (before, after))
        assert kept <= ids and (kept == ids if name == "lines" else len(kept) < len(ids))
    _, before, after = seen[1]
    from .test_dedup_and_counts import brute_lines

    want = {i: t for i, _, _, t in brute_lines(before.select("doc_id", "text").collect())}
    assert {r["doc_id"]: r["text"] for r in after.collect()} == want
    assert after.where(F.char_length("text") != F.col("n_chars")).count() == 0
    _, before, after = seen[2]
    texts = {r["doc_id"]: near_copies.shingles(near_copies.words_of(r["text"])) for r in before.collect()}
    kept = {r["doc_id"] for r in after.collect()}
    left = [(a, b) for a, b in combinations(sorted(kept), 2) if near_copies.jaccard(texts[a], texts[b]) >= 0.8]
    assert left == []
    pieces = pipeline.STAGES[-1][1](spark, now, SF)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == {r["doc_id"] for r in now.collect()}


def test_pipeline_stages_on_odd_rows(spark, odd, tmp_path):
    """Nulls in any column, repeated rows, rows without an id, very long texts and clashing columns, stage by stage."""
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    nameless = odd.withColumn("doc_id", F.lit(None).cast("long"))
    table, n = odd.unionByName(nameless), len(ODD)
    stage = dict(pipeline.STAGES)
    out = {name: stage[name](spark, table, str(tmp_path)) for name in ("quality", "lines", "near copies", "mixing")}
    for name, df in out.items():
        assert df.columns == pipeline.COLUMNS, name
    assert out["quality"].count() == out["lines"].count() == 2 * n
    assert out["near copies"].where("doc_id is null").count() == n and out["near copies"].where("doc_id is not null").count() == 9
    mixed = out["mixing"]
    assert 0 < mixed.count() <= 2 * n and mixed.where("text is null and doc_id = 1").count() == 1  # no tokens: kept
    pieces = stage["packing"](spark, table, str(tmp_path))
    assert pieces.where("start = 0").count() == 2 * n


def test_pipeline_of_nothing(spark, tmp_path, nothing):
    pipeline = pytest.importorskip("corpus_pipeline")
    nothing.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
