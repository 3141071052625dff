import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import WORDS, prose
from voxledger.llm import line_dedup, minmax_dedup
from voxledger.llm.components import components

BLANKS = " \t\n\x0b\x0c\r"


def brute_lines(pairs, least=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    absent = 1 << 63
    key = lambda x: x.strip(BLANKS).translate(lower)
    held = defaultdict(set)
    for i, t in pairs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                held[key(line)].add(absent if i is None else i)
    out = []
    for i, t in pairs:
        lines = (t or "").split("\n")
        own = absent if i is None else i
        stay = [x for x in lines if len(key(x)) < least or min(held[key(x)]) == own]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def lines_of(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in df.collect()), key=repr)


def test_lines_of_messy_rows(messy):
    pairs = [(r.doc_id, r.text) for r in messy.select("doc_id", "text").collect()]
    got = line_dedup.dedup_lines(messy)
    assert lines_of(got) == brute_lines(pairs)
    assert set(messy.columns) <= set(got.columns)


def test_a_line_of_most_documents_over_many_ranges(frame, spark):
    rng = random.Random(5)
    pairs = [(i, "\n".join(rng.choice(["the very same line", " The very SAME line\t", f"own line number {i}", "tiny"]) for _ in range(4))) for i in rng.sample(range(10_000), 900)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        assert lines_of(line_dedup.dedup_lines(frame(pairs))) == brute_lines(pairs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_lines_of_no_documents(empty):
    assert line_dedup.dedup_lines(empty).count() == 0


def test_bitmap_round_trip():
    keep = line_dedup.unpack(line_dedup.pack([1, 9, 40], 41), 41)
    assert [i for i, k in enumerate(keep) if not k] == [1, 9, 40]


def shingles(text, width):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({ord(c): " " for c in BLANKS}).split(" ")
    w = [x for x in w if x]
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute_classes(pairs, width, percent=80):
    sets = [(i, shingles(t, width)) for i, t in pairs]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, s) in enumerate(sets):
        for j, t in sets[:n]:
            if s and t and i is not None and j is not None and 100 * len(s & t) >= percent * len(s | t):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return sorted(((i, len(s), root(i) if i is not None else None) for i, s in sets), key=repr)


def classes_of(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


@pytest.mark.parametrize("width", [2, 5])
def test_classes_of_messy_rows(messy, width):
    pairs = [(r.doc_id, r.text) for r in messy.select("doc_id", "text").collect()]
    got = minmax_dedup.near_classes(messy, minmax_dedup.Parameters(width=width))
    assert classes_of(got) == brute_classes(pairs, width)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got.collect())


def test_a_large_group_of_near_copies(frame):
    """Copies edited to any degree: stars leave many apart that blocks must link."""
    rng = random.Random(9)
    base = [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(90)]
    pairs = []
    for i in range(260):
        copy = list(base)
        for _ in range(rng.randrange(14)):
            copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10_000)}"
        pairs.append((1000 - i, " ".join(copy)))
    pairs += [(2000 + i, prose(i, 50)) for i in range(60)]
    p = minmax_dedup.Parameters(width=2, block_docs=16)
    assert classes_of(minmax_dedup.near_classes(frame(pairs), p)) == brute_classes(pairs, 2)


def test_classes_of_no_documents(empty):
    assert minmax_dedup.near_classes(empty).count() == 0
    assert minmax_dedup.drop_near_copies(empty).count() == 0


def test_one_document_of_a_class_stays(messy):
    left = minmax_dedup.drop_near_copies(messy)
    assert left.columns == messy.columns
    ids = [r.doc_id for r in left.select("doc_id").collect()]
    assert 2 not in ids and 7 not in ids and ids.count(1) == 2 and ids.count(None) == 2


@pytest.mark.parametrize("links_a_task", [7, 200_000])
def test_components(spark, links_a_task):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(60)] + [(200 + rng.randrange(80), 200 + rng.randrange(80)) for _ in range(50)] + [(500, i) for i in range(501, 560)]
    rng.shuffle(chain)
    parent = {x: x for link in chain for x in link}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in chain:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    links = spark.createDataFrame(chain + [(None, 3), (9, 9)], "a long, b long")
    got = {r.node: r.component for r in components(links, links_a_task=links_a_task).collect()}
    assert got == {x: root(x) for link in chain if link[0] != link[1] for x in link}
    assert components(links.filter(F.lit(False))).count() == 0
