"""Groups of near copies against shingle sets: what they must hold, what they must leave apart, hot groups and odd rows."""

import collections
import pathlib
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, str(pathlib.Path(__file__).parent))
import brute  # noqa: E402

from corpusloom.llm.near_copies import CopySpec, copy_links, copy_prints, linked, near_copies, search  # noqa: E402
from corpusloom.llm.workspace import cut  # noqa: E402


def shingles(text):
    words = brute.BLANK_WORD.findall((text or "").translate(brute.LOWER))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def similar(rows, least):
    """Pairs of places whose texts have this similarity or more, by shingles that few texts share."""
    sets = [shingles(t) for _, t in rows]
    holders = collections.defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            holders[g].append(k)
    met = collections.Counter((a, b) for own in holders.values() if len(own) <= 60 for i, b in enumerate(own) for a in own[:i])
    return {(a, b) for (a, b), n in met.items() if n >= least * len(sets[a] | sets[b]) * 0.7 and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def groups(found):
    out = collections.defaultdict(set)
    for r in found:
        out[r["root"]].add(r["doc_id"])
    return list(out.values())


def mutated(words, rnd, share):
    return " ".join(rnd.choice(["changed", "other", "new"]) + str(rnd.randrange(10**6)) if rnd.random() < share else w for w in words)


@pytest.fixture(scope="module")
def copies():
    """Originals of 300 words, copies of a similarity of 0.8 to 0.97, and others of 0.3 or less."""
    rnd, rows, near = random.Random(3), [], []
    for k in range(120):
        words = [f"w{rnd.randrange(4000)}" for _ in range(300)]
        rows.append((10 * k, " ".join(words)))
        for j, share in enumerate((0.003, 0.01, 0.016)):
            rows.append((10 * k + 1 + j, mutated(words, rnd, share)))
            near.append((len(rows) - 2 - j, len(rows) - 1))
        rows.append((10 * k + 9, mutated(words, rnd, 0.3)))
    return rows, near


@pytest.mark.parametrize("spec", [CopySpec(), CopySpec(split_at=3), CopySpec(split_at=3, broadcast_rows=0)])
def test_near_copies_meet_and_others_do_not(spark, copies, spec):
    rows, near = copies
    found = {r["doc_id"]: r["root"] for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spec).collect()}
    due = [(a, b) for a, b in near if len(shingles(rows[a][1]) & shingles(rows[b][1])) >= 0.8 * len(shingles(rows[a][1]) | shingles(rows[b][1]))]
    met = sum(found[rows[a][0]] == found[rows[b][0]] for a, b in due)
    assert len(due) > 200 and met >= 0.95 * len(due)
    roots = {found[i] for i, _ in rows if i % 10 == 0}
    assert len(roots) == 120 and not roots & {found[i] for i, _ in rows if i % 10 == 9}


def test_near_copies_of_the_test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = {r["doc_id"]: r["root"] for r in near_copies(docs).collect()}
    due, loose = similar(rows, 0.8), similar(rows, 0.35)
    assert sum(found[rows[a][0]] == found[rows[b][0]] for a, b in due) >= 0.9 * len(due)
    linked = collections.defaultdict(set)
    for a, b in loose:
        linked[a].add(b), linked[b].add(a)
    place = {i: k for k, (i, _) in enumerate(rows)}
    for own in groups([{"doc_id": i, "root": r} for i, r in found.items()]):
        if len(own) > 1:  # each member resembles another one of its group
            assert all(linked[place[i]] & {place[j] for j in own} for i in own)


def test_blocks_lose_no_link(spark, copies):
    rows, _ = copies
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    distinct = cut(copy_prints(docs).select("w0", "w1", "segments").distinct())

    def parts(edges):
        parent = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for r in edges.collect():
            a, b = root(r["u"]), root(r["v"])
            parent[max(a, b)] = min(a, b)
        return {x: root(x) for x in parent}

    assert parts(copy_links(distinct, CopySpec(split_at=2))) == parts(copy_links(distinct, CopySpec()))


def test_search_emits_an_edge_a_member_at_most():
    rnd = np.random.default_rng(2)
    w0, w1 = rnd.integers(0, 1 << 8, 500).astype(np.uint64), np.zeros(500, np.uint64)
    assert sum(len(m) for m, _ in search(w0, w1, 8)) == 499


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (None, "one"), (6, "a b c d e f g"), (6, "a b c d e f g"), (7, "z " * 50_000), (8, "z " * 50_001)]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, root string, w0 int")
    found = near_copies(frame).collect()
    assert len(found) == len(rows) and near_copies(frame.limit(0)).count() == 0
    by = collections.defaultdict(set)
    for r in found:
        by[r["doc_id"]].add(r["root"])
    assert by[1] == by[2] == by[3] and by[4] == by[5] == by[None] and len(by[6]) == 1 and by[7] == by[8] and not by[1] & by[4]


def test_segment_bits_follow_the_rows():
    from corpusloom.llm.near_copies import bits_for

    assert [bits_for(n) for n in (0, 1, 2, 1_000, 213_722, 1 << 24, 1 << 40)] == [8, 8, 8, 17, 25, 31, 31]


def test_links_are_the_same_beside_any_number_of_rows(spark, copies):
    rnd, rows = random.Random(5), []
    for k in range(200):  # pairs near the limit, which long segments would miss
        words = [f"v{rnd.randrange(4000)}" for _ in range(200)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, mutated(words, rnd, 0.025))]
    few = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    others = spark.range(1 << 20, (1 << 20) + 70_000).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 9), k -> hash(id, k))) AS text")

    def found(docs):
        return sorted(sorted(g) for g in groups(r for r in near_copies(docs).collect() if r["doc_id"] < 400))

    alone = found(few)
    assert 300 > len(alone) > 200 and found(few.unionByName(others)) == alone


@pytest.mark.parametrize("compare_at", [0, 3, 1024])
def test_rows_linked_in_their_groups(compare_at):
    rnd = np.random.default_rng(4)
    for most in (1, 4, 10):
        sizes = np.concatenate((rnd.integers(1, 4, 300), [1, 60, 2, 700]))
        starts = np.cumsum(sizes) - sizes
        w0, w1 = (rnd.integers(0, 1 << 16, sizes.sum()).astype(np.uint64) for _ in range(2))
        due = np.zeros(len(w0), bool)
        for a, n in zip(starts, sizes, strict=True):
            own = np.bitwise_count(w0[a : a + n, None] ^ w0[a : a + n]).astype(int) + np.bitwise_count(w1[a : a + n, None] ^ w1[a : a + n])
            due[a : a + n] = (own <= most).sum(1) > 1 if n <= compare_at else True
        assert (linked(w0, w1, starts, most, compare_at) == due).all()
