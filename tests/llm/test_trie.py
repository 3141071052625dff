import hashlib
import random
import zlib

import pytest

from voxledger.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, pos long, id string, n string, x int, rep string, depth double, kx int, first int"


@pytest.fixture(scope="module")
def table(spark):
    return lambda rows: spark.createDataFrame([(*r, 1, "a", "b", 2, "c", 0.5, 3, 4) for r in rows], SCHEMA)


def originals(rows):
    """Turns (role, text) by conversation; equal turn numbers in order of their digests."""
    found = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            size = len(text.encode())
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            found.setdefault(conv, []).append((turn is not None, turn or 0, digest, size, (role, text)))
    return {c: [t[-1] for t in sorted(ts)] for c, ts in found.items()}


def shared_heads(own):
    out = {}
    for c, turns in own.items():
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def nodes(sequences):
    """Every node from its members, one prefix after the other."""
    members = {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)

    rows, totals = set(), {}
    for p in sorted(members, key=len, reverse=True):
        below = [totals[q] for q in children.get(p, [])]
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        totals[p] = (sum(x[0] for x in below) or (not below), own + sum(x[1] for x in below))
        ends = ",".join(str(c) for c in sorted(members[p]) if len(sequences[c]) == len(p))
        rows.add((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below), int(totals[p][0]), totals[p][1], hashlib.sha256(ends.encode()).hexdigest()))
    return rows


def found(turns):
    out = [tuple(r)[:-1] for r in prefix_trie.trie(turns).collect()]
    assert len(out) == len(set(out))
    return set(out)


def random_rows(seed, convs, longest, letters):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-50, 400), convs):
        for t in range(rng.randrange(longest + 1)):
            role = rng.choice(["user", "assistant", None, ""]) if rng.random() < 0.2 else "user"
            rows.append((c, rng.choice([t, t, t, None, 0]), role, rng.choice([*letters, None, "é漢😀"])))
    return rows


@pytest.mark.parametrize("seed,convs,longest,letters", [(1, 120, 6, "ab"), (2, 60, 30, "a"), (3, 90, 17, "abcd"), (4, 200, 2, "a")])
def test_random_tables_against_prefix_by_prefix(table, seed, convs, longest, letters):
    rows = random_rows(seed, convs, longest, letters)
    given = prefix_trie.numbered(table(rows))
    assert found(given) == nodes(originals(rows))
    assert found(prefix_trie.with_shared_heads(given)) == nodes(shared_heads(originals(rows)))


def test_long_conversations_and_many_copies(table, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 4)
    monkeypatch.setattr(prefix_trie, "PIECE_BYTES", 50)
    long = [(1, t, "user", "x" * (t % 3)) for t in range(700)]
    twin = [(2, t, "user", "x" * (t % 3)) for t in range(650)] + [(2, 650, "user", "other")]
    copies = [(c, t, "user", f"turn {t}") for c in range(10, 700) for t in range(3)]
    rows = long + twin + copies + [(None, 0, "user", "nobody's"), (5, None, None, None)]
    given = prefix_trie.numbered(table(rows))
    assert found(given) == nodes(originals(rows))
    assert found(prefix_trie.with_shared_heads(given)) == nodes(shared_heads(originals(rows)))


def test_repeated_rows_are_repeated_turns(table):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, "user", "a")]
    assert found(prefix_trie.numbered(table(rows))) == nodes(originals(rows))


def test_empty_tables(table):
    for rows in (table([]), table([(None, 1, "user", "x")])):
        given = prefix_trie.numbered(rows)
        assert prefix_trie.trie(given).count() == 0
        assert prefix_trie.trie(prefix_trie.with_shared_heads(given)).count() == 0


def test_very_long_texts(table):
    rows = [(1, 0, "user", "long " * 400_000), (2, 0, "user", "long " * 400_000), (2, 1, "user", "b")]
    assert found(prefix_trie.numbered(table(rows))) == nodes(originals(rows))
