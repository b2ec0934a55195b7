"""Merkle manifest, conversation repair and cover-tree links against plain Python."""

import functools
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from linewise.llm import cover_tree, merkle, turn_repair


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves):
    """Root and, per leaf, its siblings level by level as (left, right)."""
    nodes, members = list(leaves), [[i] for i in range(len(leaves))]
    paths = [[] for _ in leaves]
    while len(nodes) > 1:
        above, under = [], []
        for at in range(0, len(nodes), 3):
            run = nodes[at:at + 3]
            for k in range(len(run)):
                for leaf in members[at + k]:
                    paths[leaf].append(("".join(run[:k]), "".join(run[k + 1:])))
            above.append(sha("".join(run)))
            under.append([leaf for m in members[at:at + 3] for leaf in m])
        nodes, members = above, under
    return nodes[0], paths


def plain_manifest(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda row: sha("".join(map(enc, row)))
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append(row)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for name in names:
        mine = sorted(by_source[name], key=lambda r: (r[0] is None, r[0] or 0, leaf(r)))
        trees.append((mine, *plain_tree([leaf(r) for r in mine])))
    root, root_paths = plain_tree([t[1] for t in trees])
    out = []
    for (mine, subroot, paths), above in zip(trees, root_paths):
        for row, path in zip(mine, paths):
            now = list(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                now[4] = row[4].replace("\n", "")
            digest = leaf(now)
            for left, right in path + above:
                digest = sha(left + digest + right)
            out.append((row[0], leaf(row), subroot, root, sha("".join(a + b for a, b in path + above)), digest, digest == root))
    return sorted(out, key=repr)


MERKLE_ROWS = (
    [(i, "big", "en", 3, f"text\n{i}") for i in range(800)] + [(i, "mid", None, None, "a\nb" if i % 2 else None) for i in range(9)]
    + [(1, None, "fr", 0, ""), (1, None, "fr", 0, ""), (None, None, "é", 2, "x" * 50_000 + "\ny"), (5, "lone", "en", 1, "é\n"), (7, "", "en", 1, "empty name")]
    + [(i, f"s{i % 40}", "en", i, "same") for i in range(200)]
)


def test_merkle_manifest(spark):
    extra = "left string, pos int, branch string, digest string, root string, top int"
    rows = [(*r, "l", 1, "b", "d", "r", 2) for r in MERKLE_ROWS]
    docs = spark.createDataFrame(rows, f"doc_id long, source string, lang string, n_chars long, text string, {extra}").repartition(5)
    got = merkle.verified_manifest(docs, merkle.tampered_text(F.col("doc_id"), F.col("text")))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_manifest(MERKLE_ROWS)
    assert {r["verified"] for r in got.collect()} == {True, False}
    assert merkle.verified_manifest(docs.where("false"), F.col("text")).count() == 0


@pytest.mark.parametrize("count", [1, 3, 4, 10])
def test_merkle_bands_of_one_level(spark, count):
    """More bands, the same tree."""
    rows = [(i, "s", sha(str(i))) for i in range(count)]
    leaves = spark.createDataFrame(rows, "doc_id long, source string, h string").select("doc_id", "source", F.unhex("h").alias("digest"))
    got = merkle.merkle_proofs(leaves, band=1)
    want, paths = plain_tree([r[2] for r in rows])
    for row in got.collect():
        assert row["root"].hex() == want == row["subroot"].hex()
        assert [(a.hex(), b.hex()) for a, b in zip(row["left"], row["right"])] == paths[row["doc_id"]]


def plain_repair(rows):
    """rows: (role, text) in order. Every target string, every alignment."""
    faults, seen = [], set()
    for role, text in rows:
        said = text.strip(turn_repair.SPACES)
        faults.append("b" if not said else "d" if (role, text) in seen else "t" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    targets = [""] + [s + "ua" * k for k in range(1, len(rows) // 2 + 3) for s in ("", "s")]
    best = (10**9, "", "")
    for target in targets:
        @functools.cache
        def rest(i, j):
            if i == len(rows) and j == len(target):
                return 0, ""
            options = []
            if i < len(rows):
                options.append((2, "D", rest(i + 1, j)))
            if i < len(rows) and j < len(target) and faults[i] not in ("b", "d"):
                extra = 5 * (faults[i] == "t")
                if rows[i][0][:1] == target[j]:
                    options.append((extra, "K", rest(i + 1, j + 1)))
                elif target[j] != "s":
                    options.append((1 + extra, "R", rest(i + 1, j + 1)))
            if j < len(target) and target[j] != "s":
                options.append((5, "I", rest(i, j + 1)))
            return min(((cost + more, letter + audit) for cost, letter, (more, audit) in options), default=(10**9, ""))
        cost, audit = rest(0, 0)
        best = min(best, (cost, audit, target))
    cost, audit, target = best
    out, i, j = [], 0, 0
    for letter in audit:
        role, text = ("", "") if letter == "I" else rows[i]
        i += letter != "I"
        if letter != "D":
            out.append(f"{role if letter == 'K' else {'u': 'user', 'a': 'assistant'}[target[j]]}:{text}")
            j += 1
    count = lambda kind: faults.count(kind)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return count("b"), count("d"), count("t"), illegal, cost, audit, sha("\n".join(out)), out


def plain_damage(conv, turn, role, text):
    role, text = " " if role is None else role, " " if text is None else text
    harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
    return [(turn, "user" if harm == 4 else role, text)] * {0: 0, 3: 2}.get(harm, 1)


def random_turns(seed, conversations):
    chance = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(chance.randrange(1, 9)):
            role = chance.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = chance.choice(["yes.", "no!", "why?  ", "cut off", "again.", "", " \n", None, f"{conv} {turn}.", "é" * 10 + "."])
            rows.append((conv if conv else None, chance.choice([turn, turn, turn, turn + 3, None]), role, text))
    return rows


def whole_plain_repair(rows, damage):
    by_conv = {}
    for conv, turn, role, text in rows:
        made = plain_damage(conv, turn, role, text) if damage else [(turn, " " if role is None else role, " " if text is None else text)]
        by_conv.setdefault(conv, []).extend(made)
    out = []
    for conv, made in by_conv.items():
        made.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [r[0] for r in made if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *plain_repair([r[1:] for r in made])))
    return sorted(out, key=repr)


@pytest.mark.parametrize("damage", [True, False])
def test_turn_repair(spark, damage):
    rows = random_turns(3, 120)
    turns = spark.createDataFrame([(*r, "x", 1, True) for r in rows], "conv_id long, turn long, role string, text string, audit string, copies int, duplicate boolean")
    harmed = turn_repair.damaged(turns) if damage else turns
    audits = turn_repair.repair_audits(harmed.repartition(5)).cache()
    want = whole_plain_repair(rows, damage)
    assert sorted(map(tuple, audits.collect()), key=repr) == [w[:-1] for w in want]
    texts = {}
    for row in turn_repair.repaired_turns(harmed, audits).orderBy("conv_id", "place").collect():
        texts.setdefault(row["conv_id"], []).append(f"{row['role']}:{row['text']}")
    assert texts == {w[0]: w[-1] for w in want if w[-1]}
    assert turn_repair.repair_audits(turn_repair.damaged(turns.where("false"))).count() == 0


@pytest.mark.parametrize("piece", [1, 2, 3, 5])
def test_turn_repair_in_pieces(monkeypatch, piece):
    monkeypatch.setattr(turn_repair, "PIECE", piece)
    chance = random.Random(piece)
    for _ in range(400):
        rows = [(chance.choice(["user", "assistant", "system", "tool"]), chance.choice(["a.", "b", "", "c!", "d?", f"{k}."])) for k in range(chance.randrange(12))]
        one, seen = turn_repair.Repair(0), set()
        for turn, row in enumerate(rows):
            one.add(turn, *row, row in seen)
            seen.add(row)
        assert one.result()[2:] == plain_repair(rows)[:-1]


def test_long_conversation():
    """Thousands of turns stream through pieces of the set size; a dropped, a blank and a changed one each cost their edit."""
    one = turn_repair.Repair(0)
    rows = [("user" if k % 2 == 0 else "assistant", f"{k}.") for k in range(6000)]
    rows[1001] = ("user", "1001.")
    rows[3000] = ("user", "")
    for turn, row in enumerate(rows):
        one.add(turn, *row, False)
    assert one.result()[1:7] == (0, 1, 0, 0, 2, 1 + 2 + 2)


def clustered(chance, dims, alone, groups, size, spread):
    """Vectors by themselves and in groups around a direction."""
    parts = [chance.normal(size=(alone, dims))]
    for _ in range(groups):
        middle = chance.normal(size=dims)
        parts.append(middle + chance.normal(size=(size, dims)) * spread)
    return np.concatenate(parts)


def plain_links(rows, cosine):
    """rows: vec_id, vector. All pairs."""
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    scaled = [np.array(v) / np.abs(v).max() if g else None for (_, v), g in zip(rows, good)]  # huge and tiny values neither overflow nor vanish
    unit = [v if v is None else v / np.linalg.norm(v) for v in scaled]
    links = [[j for j in range(len(rows)) if j != i and good[i] and good[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine] for i in range(len(rows))]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, near in enumerate(links):
            least = min([label[i], *(label[j] for j in near)])
            for j in [i, *near]:
                changed |= label[j] != least
                label[j] = least
    names = {}
    for (vec, _), c in zip(rows, label):
        names[c] = vec if names.get(c) is None else names[c] if vec is None else min(vec, names[c])
    return sorted(((vec, len(near), names[c], vec == names[c]) for (vec, _), near, c in zip(rows, links, label)), key=repr)


@pytest.mark.parametrize("cosine, spread, block_rows", [(0.95, 0.2, 30), (0.95, 0.3, None), (0.7, 0.6, 25)])
def test_embedding_links(spark, cosine, spread, block_rows):
    chance = np.random.default_rng(5)
    made = [v.tolist() for v in clustered(chance, 12, 60, 5, 30, spread)] + [v.tolist() for v in clustered(chance, 3, 20, 1, 10, spread)]
    odd = [None, [], [0.0] * 12, [None] + [1.0] * 11, [float("nan")] + [1.0] * 11, [float("inf")] + [1.0] * 11, [1e200] * 12, [2e200] * 12, [1e-300] * 12, [-0.0] + [1.0] * 11, [0.0] + [1.0] * 11]
    made += odd + [made[0]] * 40 + [made[70]] * 3 + [[3 * x for x in made[70]]]
    ids = [int(i) for i in chance.permutation(len(made))]
    rows = [(None if i == 7 else 5 if i == 9 else i, v) for i, v in zip(ids, made)]
    table = spark.createDataFrame([(*r, "s", 1, 2, 3) for r in rows], "vec_id long, embedding array<double>, site string, id int, copies int, label int").repartition(4)
    got = cover_tree.near_links(table, cosine, block_rows, least_hot=20)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_links(rows, cosine)
    assert cover_tree.near_links(table.where("false"), cosine).count() == 0


@pytest.mark.parametrize("spread", [0.01, 0.1, 0.17, 0.3])
def test_cover_tree(spread, monkeypatch):
    """Nested, covering, every place once; and a traversal that takes whole nodes counts as all pairs do."""
    monkeypatch.setattr(cover_tree, "TILE", 5000)
    chance = np.random.default_rng(1)
    unit = cover_tree.unit_rows(clustered(chance, 16, 300, 4, 200, spread))
    copies = chance.integers(1, 4, len(unit))
    order = chance.permutation(len(unit))
    tree = cover_tree.build_tree(order, copies[order], unit[order], 0.02)
    assert sorted(tree.ids) == list(range(len(unit)))
    for k in range(len(tree.low)):
        places = np.arange(tree.low[k], tree.high[k])
        assert cover_tree.distances(tree.unit[places] @ tree.unit[tree.point[k]]).max() <= tree.radius[k] + cover_tree.SAFE
        children = np.arange(tree.first[k], tree.first[k + 1])
        if len(children):
            assert tree.low[children[0]] == tree.low[k] and tree.high[children[-1]] == tree.high[k]
            assert (tree.low[children[1:]] == tree.high[children[:-1]]).all()
    near = (tree.unit @ tree.unit.T >= 0.95) & ~np.eye(len(unit), dtype=bool)
    found = cover_tree.Links(tree, tree, 0.95)
    assert (found.gains()[0] == near @ tree.copies).all()
    half = len(unit) // 2
    a, b = (cover_tree.build_tree(part, copies[part], unit[part], 0.02) for part in (order[:half], order[half:]))
    across = a.unit @ b.unit.T >= 0.95
    found = cover_tree.Links(a, b, 0.95)
    gains = found.gains()
    assert (gains[0] == across @ b.copies).all() and (gains[1] == across.T @ a.copies).all()
    label = cover_tree.least_labels(len(unit), *found.joined_places())
    i, j = np.nonzero(across)
    assert (label[i] == label[half + j]).all()
    assert len(np.unique(label)) == len(np.unique(cover_tree.least_labels(len(unit), i, half + j)))
