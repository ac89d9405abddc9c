"""The banded alignment against the full matrix, and classes against all pairs of a small corpus."""

import random

import pytest

from millwright.llm import order_minhash as om


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("seed", range(4))
def test_banded_alignment(seed):
    rng = random.Random(seed)
    for _ in range(600):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 40))]
        b = [x for x in a if rng.random() > 0.1] if rng.random() < 0.6 else [rng.choice("abc") for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 4)):
            b.insert(rng.randint(0, len(b)), rng.choice("abcd"))
        d = edit(a, b)
        for most in {0, 1, d - 1, d, d + 1, 9, 20} - {-1}:
            assert om.distance_within(a, b, most) == (d <= most), (a, b, d, most)


def test_classes_equal_all_pairs(spark, docs):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    rows, passage = [], [word() for _ in range(60)]
    for g in range(25):
        base = [word() for _ in range(rng.randint(30, 160))]
        if g % 3 == 0:
            base[10:10] = passage  # shared by many, no reason to join them
        rows.append(base)
        for _ in range(rng.randint(0, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = word()
            rows.append(copy)
    texts = [" ".join(x) for x in rows] + [" ".join(rows[0])] * 4 + ["", None, " ", "one two", "one two", "one three", "x"]
    given = list(zip(rng.sample(range(1000), len(texts)), texts, strict=True))
    root = {i: i for i, _ in given}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in given:
        for j, t in given:
            if i < j and ((s or "") == (t or "") or om.near(s or "", t or "")):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: r for r in om.classes(docs([*given, (None, texts[0])])).collect()}
    assert got.pop(None).class_id is None
    assert {i: r.class_id for i, r in got.items()} == {i: find(i) for i, _ in given}
    assert got[given[len(rows)][0]].n_copies == 5


@pytest.mark.parametrize("block", [3, 512])
def test_common_line(spark, docs, monkeypatch, block):
    """Many unlike short texts share a line; the pairs among them are found all the same, in a few rounds."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    line = " ".join(word() for _ in range(14))
    rows = []
    for i in range(0, 160, 2):
        own = [word() for _ in range(16)]
        rows += [(i, f"{line} {' '.join(own)}"), (i + 1, f"{line} {' '.join(own[:-2] + [word(), word()])}")]
    rounds = []
    monkeypatch.setattr(om, "BLOCK", block)
    whole = om._shared
    monkeypatch.setattr(om, "_shared", lambda m: rounds.append(1) or whole(m))
    got = {r.doc_id: r.class_id for r in om.classes(docs(rows)).collect()}
    assert got == {i: i - i % 2 for i in range(160)}
    assert len(rounds) < 14


@pytest.mark.parametrize("block", [3, 512])
def test_pairs_that_share_common_words_only(docs, monkeypatch, block):
    """Near texts whose whole k-mers all stand in a common line are found, however large the buckets are."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    line, rows = " ".join(word() for _ in range(40)), []
    for i in range(0, 60, 2):
        own = [word() for _ in range(20)]
        rows += [(i, f"{line} {' '.join(own)}"), (i + 1, f"{line} {' '.join(word() if j % 4 == 0 else x for j, x in enumerate(own))}")]
    monkeypatch.setattr(om, "BLOCK", block)
    got = {r.doc_id: r.class_id for r in om.classes(docs(rows)).collect()}
    assert got == {i: i - i % 2 for i in range(60)}


@pytest.mark.parametrize("block", [3, 512])
def test_near_a_member_but_not_its_leader(spark, docs, monkeypatch, block):
    """Every bucket's near pairs join their texts, in large and small buckets, also through members near a leader."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    line, texts = " ".join(word() for _ in range(12)), []
    for _ in range(12):
        own = [word() for _ in range(28)]
        for _ in range(8):  # a chain: each is near the one before, not the one before that
            texts.append(f"{line} {' '.join(own)}")
            for j in rng.sample(range(28), 6):
                own[j] = word()
    monkeypatch.setattr(om, "BLOCK", block)
    given = docs(list(enumerate(texts)))
    # every text of the shared line in one bucket, whatever its keys
    sketches = spark.createDataFrame([(i, 40, [7]) for i in range(len(texts))], "doc long, n_words long, keys array<long>")
    got = {(r.a, r.b) for r in om.links(sketches, given.selectExpr("doc_id as doc", "text")).collect()}
    root = list(range(len(texts)))
    for a, b in sorted(got):
        root = [min(root[a], root[b]) if x in (root[a], root[b]) else x for x in root]
    near = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if om.near(texts[a], texts[b])}
    assert got <= near
    assert all(root[a] == root[b] for a, b in near) and len({root[a] for a, _ in near}) == 12


@pytest.mark.parametrize("block", [2, 7, 512])
def test_blocks_lose_no_near_pair(spark, monkeypatch, block):
    """Bags of one bucket in blocks: every near pair of different parts comes out once, unlike ones mostly don't."""
    rng = random.Random(block)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    texts = []
    for _ in range(12):
        own = [word() for _ in range(rng.choice([6, 25, 100, 101, 400]))]
        texts += [" ".join(word() if rng.random() < rng.choice([0.05, 0.15]) else x for x in own) + " x" * rng.randint(0, 9) for _ in range(5)]
    texts += ["", "one", "one", "a b"]
    monkeypatch.setattr(om, "BLOCK", block)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    part = [i // 2 for i in range(len(texts))]  # neighbours are joined already
    member = spark.createDataFrame([(7, i, len(t.split()), part[i]) for i, t in enumerate(texts) if t.split()], "key long, doc long, n_words long, part long")
    got = [(r.a, r.b) for r in om.candidates(member, docs, 0.8).collect()]
    near = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if part[a] != part[b] and om.near(texts[a], texts[b])}
    assert len(got) == len(set(got)) and near <= set(got) and all(part[a] != part[b] for a, b in got)
    assert len(got) < 3 * len(near) + 20


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)], "a long, b long")
    got = {r.node: r.root for r in om.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}


def test_empty_and_unlinked(spark, docs):
    assert om.classes(docs([(1, "a")]).limit(0)).count() == 0
    assert [tuple(r) for r in om.classes(docs([(1, "alpha beta gamma")])).collect()] == [(1, 1, 1, 0)]
