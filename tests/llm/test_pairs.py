"""N-gram join, substring dedup and components against brute force."""

import hashlib
import os
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from linewise import session
from linewise.llm import graph, ngram_join, substring_dedup
from linewise.llm.arrow import WordHashes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, n):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def plain_components(rows, rule):
    sets = [(i, shingle_set(t, rule.words)) for i, t in rows]
    label = {i: i for i, _ in rows if i is not None}
    find = lambda x: x if label[x] == x else find(label[x])
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= rule.percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                label[y] = x
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=repr)


def compare(spark_docs, rows, rule):
    got = ngram_join.similar_groups(spark_docs, rule).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect()), key=repr) == plain_components(rows, rule)


@pytest.mark.parametrize("rule", [ngram_join.JoinRule(3, 90), ngram_join.JoinRule(5, 80)])
def test_small_corpus(docs, corpus, rule):
    compare(docs, [(i, t) for i, t, _ in corpus], rule)


def test_screen_keeps_pairs_that_can_link():
    draw = np.random.default_rng(7)
    rule, sets = ngram_join.JoinRule(5, 80), []
    for _ in range(12):
        base = draw.integers(0, 2**63, 60, dtype=np.uint64)
        sets += [np.unique(np.concatenate([base[k:], draw.integers(0, 2**63, k, dtype=np.uint64)])) for k in (0, 3, 5, 8, 30)]
    rows = [
        {"id": i, "size": len(s), "component": i, "block": i % 2, "own": True, "far": True, "counts": np.bincount((s % np.uint64(64)).astype(int), minlength=64).astype("<i2").view(np.int64)}
        for i, s in enumerate(sets)
    ]
    got = set()
    for first, second in ((0, 0), (0, 1), (1, 1)):
        got |= set(zip(*(x.tolist() for x in ngram_join._screened(rows, first, second, rule)), strict=True))
    want = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert want and want <= got and len(got) < len(sets) ** 2 / 8


@pytest.mark.parametrize("block", [2, 2000])
def test_clouds_of_edits(spark, monkeypatch, block):
    """Copies at all distances around the threshold, chains of edits, and one id with two texts."""
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block)
    draw = random.Random(3)
    rows = []
    for cloud in range(6):
        base = [f"c{cloud}w{draw.randrange(400)}" for _ in range(30 + 60 * cloud)]
        for _ in range(25):
            words = base.copy()
            for _ in range(draw.randrange(len(base) // 12 + 2)):
                words[draw.randrange(len(words))] = f"e{draw.randrange(10_000)}"
            if draw.random() < 0.3:
                base = words
            rows.append((len(rows) * 7 % 1009, " ".join(words)))
    rows.append((rows[3][0], rows[100][1]))
    rule = ngram_join.JoinRule(2, 80)
    compare(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows, rule)


def test_no_rows(nothing):
    assert ngram_join.similar_groups(nothing).count() == 0
    assert ngram_join.one_of_each_group(nothing).columns == nothing.columns


@pytest.mark.parametrize("percent", [80, 90])
def test_allocation_keeps_the_pigeonhole(percent):
    """Any two sets within the bound share a signature, whatever is skipped."""
    draw = np.random.default_rng(1)
    for low, high in ngram_join.bands(percent, 400):
        differences = ngram_join.most_differences(low, high, percent)
        if not differences:
            continue
        for population in (10, 10**9):
            plan = ngram_join.allocate(low, high, percent, population)
            assert plan.segments + plan.deletions - 2 * plan.skipped > plan.differences
            for _ in range(4):
                a = np.unique(draw.integers(0, 2**63, low, dtype=np.uint64))
                drop = int(draw.integers(0, differences + 1))
                b = np.unique(np.concatenate([a[drop // 2:], draw.integers(0, 2**63, drop - drop // 2, dtype=np.uint64)]))
                assert len(np.intersect1d(ngram_join.signatures(a, plan), ngram_join.signatures(b, plan)))


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(1, k) for k in range(2, 50)] + [(7, 7), (300, 200)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {k: 1 for k in range(1, 50)} | {200: 200, 300: 200}


def plain_cut(rows, window):
    texts = [(i, WORD.findall(t or "")) for i, t in rows]
    seen = {}
    for _, words in texts:
        for s in range(len(words) - window + 1):
            seen[tuple(words[s:s + window])] = seen.get(tuple(words[s:s + window]), 0) + 1
    out = []
    for i, words in texts:
        gone = set()
        for s in range(len(words) - window + 1):
            if seen[tuple(words[s:s + window])] > 1:
                gone |= set(range(s, s + window))
        kept = " ".join(w for p, w in enumerate(words) if p not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def cut(docs, rule):
    rows = substring_dedup.cut_spans(docs, substring_dedup.duplicate_spans(docs, rule))
    return sorted((tuple(r) for r in rows.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)


@pytest.mark.parametrize("window", [35, 12])
def test_substring_dedup(docs, corpus, window):
    assert cut(docs, substring_dedup.SpanRule(window)) == plain_cut([(i, t) for i, t, _ in corpus], window)


def test_substring_dedup_of_shifted_and_edited_passages(spark):
    draw = random.Random(5)
    pool = [[f"q{draw.randrange(40)}" for _ in range(90)] for _ in range(4)]
    rows = []
    for i in range(60):
        words = [f"u{draw.randrange(50)}" for _ in range(draw.randrange(60))]
        for _ in range(draw.randrange(3)):
            part = draw.choice(pool)[draw.randrange(40):][:draw.randrange(10, 60)].copy()
            if part and draw.random() < 0.5:
                part[draw.randrange(len(part))] = "edit"
            at = draw.randrange(len(words) + 1)
            words[at:at] = part
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert cut(frame, substring_dedup.SpanRule(20)) == plain_cut(rows, 20)


def test_substring_dedup_of_nothing(nothing):
    assert cut(nothing, substring_dedup.SpanRule(35)) == []


@pytest.mark.parametrize("percent,far", [(60, False), (80, True)])
def test_far_members_are_two_links_from_the_pivot(spark, percent, far):
    """45 of 100 words are common: at 60 the member can link with one that is linked to the pivot."""
    texts = [(1, " ".join(f"w{i}" for i in range(72))), (2, " ".join(f"w{i}" for i in range(27, 100)))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    pairs = spark.createDataFrame([(1, 2)], "pivot long, other long")
    row = ngram_join._differences(docs, pairs, ngram_join.JoinRule(words=1, percent=percent)).first()
    assert (row["linked"], row["far"], len(row["delta"])) == (False, far, 0 if far else 55)


def test_members_that_share_passages_but_cannot_link_do_not_meet(spark):
    """Each member lacks 60 of the pivot's 200 words: all share rare words, and only the planted two can link."""
    draw, rule = random.Random(5), ngram_join.JoinRule(words=1, percent=80)
    words = [f"w{i}" for i in range(200)]
    kept = [draw.sample(words, 140) for _ in range(40)]
    kept[39] = kept[38][:135] + draw.sample(sorted(set(words) - set(kept[38])), 5)
    rows = [(0, " ".join(words)), *[(i, " ".join(w)) for i, w in enumerate(kept, 1)]]
    pairs = spark.createDataFrame([(0, i) for i in range(1, 41)], "pivot long, other long")
    deltas = ngram_join._differences(spark.createDataFrame(rows, "doc_id long, text string"), pairs, rule).cache()
    labels = spark.createDataFrame([], "node long, component long")
    met = ngram_join._members_that_meet(deltas, labels, rule)[1].collect()
    assert {frozenset((r["id_a"], r["id_b"])) for r in met} == {frozenset((39, 40))}
    links = ngram_join._links_between_members(deltas, labels, rule).collect()
    assert {frozenset(r) for r in links} == {frozenset((39, 40))}
    linked = spark.createDataFrame([(i, 0) for i in range(41)], "node long, component long")
    members, met = ngram_join._members_that_meet(deltas, linked, rule)
    assert (members.count(), met.count()) == (0, 0)  # all in one component already: no element is counted


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (files.apply(k).getName() for k in range(files.size())) if name.startswith("shuffle_")}


def test_shuffle_files_and_released_tables_leave_the_disk(spark):
    """Before, shuffle files stayed until the driver's next garbage collection and stored tables until its end."""
    held = _shuffle_files(spark)
    setting = spark.conf.get(session._CLEANUP)
    table = session.stored(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count())
    ends = time.time() + 20
    while _shuffle_files(spark) - held and time.time() < ends:
        time.sleep(0.2)
    assert not _shuffle_files(spark) - held
    assert table.count() == 7 and spark.conf.get(session._CLEANUP) == setting
    session.released(table)
    with pytest.raises(Exception):  # noqa: B017
        table.count()


def test_postings_and_differences_are_not_kept(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(ngram_join, "stored", lambda df: kept.setdefault(len(kept), session.stored(df)))
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[:i], f"x{i}", *words[i + 1:]])) for i in range(30)]
    groups = ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), ngram_join.JoinRule(1, 80))
    left = [table.columns for table in kept.values() if os.path.exists(table._linewise_path.removeprefix("file:"))]
    assert len(left) < len(kept) and not [c for c in left if {"signature", "delta"} & set(c) and "prefix" not in c and "blocks" not in c]
    assert {r["component_id"] for r in groups.collect()} == {0}


def test_a_text_travels_in_fewer_bytes_than_its_set():
    rng = random.Random(4)
    text = " ".join(rng.choice(["belt", "station", "camera", "defect", "carrier", "of", "the", "line"]) + str(rng.randrange(40)) for _ in range(500)).encode()
    packed = ngram_join.packed_text(text)
    assert 2 * len(packed) < ngram_join.shingles(text, 5, WordHashes()).nbytes
    assert [ngram_join.unpacked_text(ngram_join.packed_text(t)) for t in (text, b"", None, "é\n".encode())] == [text, b"", b"", "é\n".encode()]
