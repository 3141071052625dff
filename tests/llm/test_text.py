import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer, models, pre_tokenizers

from tests.llm.conftest import prose
from voxledger.llm import count_viterbi, elias_fano_ids, piece_transducer, template_decontam, units
from voxledger.llm.queries_text import PIECE_MODEL, WORD_TOKENIZER
from voxledger.session import scratch_path

ALPHABET = "abcdetho  \n\t▁é漢字😀'..,,;0123 ABĆ<s>_²"


def noise(n, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)]


# Template decontamination


def brute_template(text):
    """(kind or word, word) of each token, by regular expressions."""
    out, line_start = [], True
    lower = lambda s: re.sub("[A-ZÀ-ÖØ-Þ]", lambda m: m.group().lower(), s)
    for m in re.finditer(r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+", text or ""):
        raw = m.group()
        if raw[0] in " \t\n\x0b\x0c\r":
            line_start |= "\n" in raw
            continue
        core = re.sub(r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$", "", raw)
        if not core:
            continue
        word, kind = lower(core), None
        if re.match("[0-9]", core):
            kind = "number" if re.fullmatch("[0-9.,:/-]+", core) else "quantity"
        elif out and out[-1][0] == "number" and word in template_decontam.UNITS:
            kind = "unit"
        elif re.match("[A-ZÀ-ÖØ-Þ][a-zà-ÿ]", core) and not line_start:
            kind = "name"
        out.append((kind, word))
        line_start = raw[-1] in ".!?:;"
    return out


def brute_leaks(docs, items, p):
    out = set()
    for item, text in items:
        b = brute_template(text)
        width = min(p.width, len(b))
        least = p.literals if width == p.width else min(p.short_literals, width)
        key = lambda t, k, w: tuple(x[0] or x[1] for x in t[k : k + w])
        good = lambda t, k, w, least=least: sum(x[0] is None for x in t[k : k + w]) >= least
        spots = [k for k in range(len(b) - width + 1) if width and good(b, k, width)]
        if not spots:
            continue
        for doc, own in docs:
            d = brute_template(own)
            shifts = {}
            for i in range(len(d) - width + 1):
                for k in spots:
                    if key(d, i, width) == key(b, k, width):
                        shifts.setdefault(i - k, set()).add(k)
            found, same = set(), set()
            for shift, ks in shifts.items():
                pairs = {(b[k + j][1], d[k + shift + j][1]) for k in ks for j in range(width) if b[k + j][0]}
                if len({x for x, _ in pairs}) == len(pairs) == len({y for _, y in pairs}):
                    found |= ks
                    same |= ks if all(x == y for x, y in pairs) else set()
            if found and len(found) >= p.share * len(spots):
                out.add((doc, item, len(found), len(spots), len(same) >= p.share * len(spots)))
    return sorted(out, key=repr)


QUESTION = "If Anna buys 12 apples for 3.50 dollars and then sells 5 km of rope to Bert in May, how much does Anna have left over in the end?"


GIFT = "Then we ask again whether old Bert would ever give away what Bert had before to all the others"


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, QUESTION), (2, prose(77, 40)), (3, "four words of question"), (4, ""), (5, None), (6, "7 8 9"), (7, QUESTION), (9, GIFT), (8, "Ünder the Éclair sky of évening with all the other small clouds")]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_leaks_against_brute_force(frame, messy, benchmark):
    again = QUESTION.replace("Anna", "Carla").replace("12", "40").replace("3.50", "9").replace("Bert", "Dora")
    other, mixed = GIFT.replace("Bert", "Dora"), GIFT.replace("Bert had", "Dora had")
    pairs = [(100, "before this. " + QUESTION + " and after"), (101, again), (102, mixed), (103, other), (109, GIFT.upper()), (104, prose(77, 40)[5:]), (105, " ".join(prose(77, 40).split()[:9])), (106, "x\nfour words of question"), (107, None), (108, "THE " + "Ünder the Éclair sky of évening with all the other small clouds".upper())]
    pairs += [(i, prose(i, 60)) for i in range(200, 230)] + [(300, (QUESTION + "\n") * 40)]
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    p = template_decontam.Parameters()
    got = sorted((tuple(r) for r in template_decontam.leaks(frame(pairs), benchmark).collect()), key=repr)
    assert got == brute_leaks(pairs, items, p)
    assert {(d, i) for d, i, *_ in got} >= {(100, 1), (101, 1), (103, 9), (100, 7), (106, 3), (300, 1)} and 102 not in {d for d, *_ in got} and not any(200 <= d < 230 for d, *_ in got)
    assert [e for d, i, *_, e in got if (d, i) == (101, 1)] == [False]
    left = template_decontam.drop_leaks(frame(pairs), benchmark)
    assert left.count() == len(pairs) - len({d for d, *_ in got}) and left.columns == messy.columns


def test_leaks_of_messy_and_empty_tables(messy, empty, benchmark):
    assert template_decontam.leaks(messy, benchmark).count() == 0
    assert template_decontam.leaks(messy, messy.selectExpr("doc_id as item_id", "text").limit(0)).count() == 0
    assert template_decontam.drop_leaks(empty, benchmark).count() == 0
    assert template_decontam.drop_leaks(messy, benchmark).count() == messy.count()


def whole_leaks(spark, docs, items):
    """(doc_id, item_id) pairs of the search for all windows."""
    made = [spark.createDataFrame(rows, f"{name} long, text string") for rows, name in ((docs, "doc_id"), (items, "item_id"))]
    return {(r.doc_id, r.item_id) for r in template_decontam.leaks(*made, template_decontam.WHOLE).collect()}


def wide_template(text):
    """(kind, kind with capitals at beginnings, word) of each token."""
    out = []
    for (kind, word), core in zip(brute_template(text), cores(text), strict=True):
        capital = re.match("[A-ZÀ-ÖØ-Þ][a-zà-ÿ]", core)
        out.append((kind, kind or ("name" if capital else None), word))
    return out


def cores(text):
    marks = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))
    return [w for w in (x.strip(marks) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")) if w]


def brute_whole(docs, items, p):
    out = set()
    for item, text in items:
        b = wide_template(text)
        width = min(p.width, len(b))
        least = p.literals if width == p.width else min(p.short_literals, width)

        def readings(t, k, every, width=width, least=least):
            """(space, code, slot values) of one window."""
            cut = t[k : k + width]
            first, wide = (tuple(x[i] or "=" + x[2] for x in cut) for i in (0, 1))
            rich = sum(x[0] is None for x in cut) >= least
            found = []
            if rich or every:
                found.append(("t", first, tuple(x[2] for x in cut if x[0])))
                if wide != first:
                    found.append(("t", wide, tuple(x[2] for x in cut if x[1])))
            if not rich or every:
                found.append(("v", tuple(x[2] for x in cut), ()))
            return found

        n = len(b) - width + 1 if width else 0
        own = [(k, r) for k in range(n) for r in readings(b, k, False)]
        for doc, given in docs:
            d = wide_template(given)
            shifts = {}
            for at in range(len(d) - width + 1 if width else 0):
                for space, code, theirs in readings(d, at, True):
                    for k, (s, c, ours) in own:
                        if (s, c) == (space, code):
                            shifts.setdefault(at - k, set()).add((k, ours, theirs))
            matched, exact = set(), set()
            for found in shifts.values():
                score = Counter()
                for _, ours, theirs in found:
                    score.update(zip(ours, theirs, strict=True))
                score = {x: 2 * c + (x[0] == x[1]) for x, c in score.items()}
                known = {x for x in score if not any((y[0] == x[0]) != (y[1] == x[1]) and score[y] >= score[x] for y in score)}
                for k, ours, theirs in found:
                    if ours == theirs or set(zip(ours, theirs, strict=True)) <= known:
                        matched.add(k)
                        if ours == theirs:
                            exact.add(k)
            if n and len(matched) >= p.share * n:
                out.add((doc, item, len(matched), n, len(exact) >= p.share * n))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_whole_leaks_against_brute_force(spark, seed):
    rng = random.Random(seed)
    words = [*"the of and some more small then red".split(), "Anna", "Bert", "Tom.", "Ann", "3", "4", "5 kg", "7 km", "12th", "So", "it.", "\nNow", "?"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))

    def changed(t):
        swap = {w: rng.choice(words) for w in ("Anna", "Bert", "3", "4", "Ann")}
        return " ".join(swap.get(w, w) if rng.random() < 0.8 else w for w in t.split(" "))

    items = [(i, text(rng.choice([0, 1, 2, 5, 7, 8, 9, 15, 30]))) for i in range(25)]
    docs = [(100 + i, text(20) + " " + changed(rng.choice(items)[1]) + " " + text(rng.randrange(20))) for i in range(40)]
    docs += [(200 + i, changed(t)) for i, t in items] + [(300, None), (301, ""), (302, items[-1][1] + " " + items[-1][1])]
    made = [spark.createDataFrame(rows, f"{name} long, text string") for rows, name in ((docs, "doc_id"), (items, "item_id"))]
    got = {tuple(r) for r in template_decontam.leaks(*made, template_decontam.WHOLE).collect()}
    assert got == brute_whole(docs, items, template_decontam.WHOLE) and len(got) > 20


def test_verbatim_copies_of_slot_dense_items(spark):
    sums, names = "Solve 3 x 4 + 12 / 6 - 8 = ?", "List: Anna Bert Carla Dora Emil Fritz Gerd Hans Ida Jan"
    docs = [(1, f"before\n{sums} after"), (2, f"so we {names}, too"), (3, "it is 7 8 9 here"), (4, "Solve 5 x 4 + 12 / 6 - 8 = ?"), (5, "it is 7 8 10 here"), (6, QUESTION)]
    assert whole_leaks(spark, docs, [(1, sums), (2, names), (3, "7 8 9"), (4, QUESTION)]) == {(1, 1), (2, 2), (3, 3), (6, 4)}


def test_one_clash_costs_its_windows_only(spark):
    tale = prose(78, 27).lower() + " with Bert beside all of the others " + prose(79, 18).lower() + " then Bert once more"
    ask = "we have 3 big red boxes with some 4 small green balls inside of them and then we take out all of those that are blue or white"
    twice = ask.replace("4 small", "3 small")
    docs = [(1, "so " + tale.replace("Bert once", "Dora once")), (2, "so " + ask.replace("3", "5").replace("4", "5")), (3, "so " + twice.replace("3 big", "4 big").replace("3 small", "5 small")), (4, prose(80, 60))]
    assert whole_leaks(spark, docs, [(1, "so " + tale), (2, "so " + ask), (3, "so " + twice)]) >= {(1, 1), (2, 2), (3, 3)}
    assert not any(d == 4 for d, _ in whole_leaks(spark, docs, [(1, tale), (2, ask)]))


def test_names_that_begin_sentences_are_placeholders(spark):
    ask = "Tom has 3 apples. Ann gives him 5 more of them. Tom then eats 2 of all these. Ann takes 4 back from his bag. How many has Tom now?"
    again = ask.replace("Tom", "Liam").replace("Ann", "Zoe").replace("3", "7").replace("2", "6")
    other = "Sea was 3 miles. Sun made her 5 less than ours. Sea soon had 2 by any means. Sun left 4 out into her sky. Why does Sea now go?"
    assert whole_leaks(spark, [(1, again), (2, "So now: " + again.replace(". ", ".\n")), (3, other), (4, again.upper()), (5, ask.upper())], [(1, ask)]) == {(1, 1), (2, 1), (5, 1)}


# Pieces


@pytest.fixture(scope="module")
def machine():
    with open(PIECE_MODEL, "rb") as f:
        return piece_transducer.PieceTransducer(f.read())


def test_pieces_are_the_library_s(machine, spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    texts = noise(4000) + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for t in texts:
        ids = np.frombuffer(machine.encode(t), "<i4")
        assert ids.tolist() == library.encode(t)
        assert machine.decode(ids) == library.decode(ids.tolist())


def test_decoding_any_ids(machine):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    rng = random.Random(4)
    for _ in range(2000):
        ids = [rng.randrange(3, 32000) if rng.random() < 0.8 else rng.randrange(3, 259) for _ in range(8)]
        assert machine.decode(np.array(ids)) == library.decode(ids)


def test_unigram_models_take_the_best_path(machine):
    """The same pieces read as a unigram model, against the library's own search."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(PIECE_MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    rng = random.Random(8)
    for piece in proto.pieces:
        if piece.type == 1:
            piece.score = -rng.uniform(5, 15)
    own = piece_transducer.PieceTransducer(proto.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    texts = [t for t in noise(1500, 2) if "▁" not in t]
    assert sum(np.frombuffer(own.encode(t), "<i4").tolist() != library.encode(t) for t in texts) == 0


def test_pieces_of_tables(messy, empty):
    got = piece_transducer.digests(messy, PIECE_MODEL).collect()
    assert len(got) == messy.count() and piece_transducer.digests(empty, PIECE_MODEL).count() == 0
    assert all(r.round_trip for r in got if r.doc_id != 11)  # U+2581 itself becomes a blank
    assert [r.n_pieces for r in got if r.doc_id in (3, 4)] == [0, 0]
    full = {r.doc_id: r for r in piece_transducer.encode(messy.filter("doc_id in (6, 8)"), PIECE_MODEL).collect()}
    assert full[8].decoded == "one" and len(full[6].ids) > 30_000


# Counts


def test_counts_are_the_tokenizer_s(messy, empty):
    entries = count_viterbi.vocabulary(PIECE_MODEL)
    rng = random.Random(6)
    ties = [(p, float(rng.randint(-9, -5))) for p, _ in entries[:3000]]
    for vocabulary in (entries, ties):
        tokenizer = Tokenizer(models.Unigram(vocabulary, 0, True))
        tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        counter = count_viterbi.Counter(vocabulary)
        for t in noise(4000, 3):
            assert counter.count(t) == len(tokenizer.encode(t, add_special_tokens=False).ids)
        got = count_viterbi.token_counts(messy, vocabulary).collect()
        texts = messy.select("doc_id", "text").collect()
        assert sorted((r.n_tokens for r in got)) == sorted(len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) for r in texts)
    assert count_viterbi.token_counts(empty, ties).count() == 0


# Shards


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0, 7], list(range(200)), [0, 1 << 40], sorted(random.Random(1).randrange(1 << 30) for _ in range(500))])
def test_elias_fano(values):
    code = elias_fano_ids.EliasFano.of(np.array(values, np.int64))
    code = elias_fano_ids.EliasFano.unpack(*code.pack())
    assert code.block(0, len(values)).tolist() == values and [code.get(i) for i in range(len(values))] == values
    for first in range(0, len(values), 37):
        last = min(first + 101, len(values))
        assert code.block(first, last).tolist() == values[first:last]


def test_elias_fano_is_small():
    bounds = np.cumsum(np.random.default_rng(0).integers(1, 900, 100_000))
    assert len(elias_fano_ids.EliasFano.of(bounds).pack()[0]) < 100_000 * 1.6


@pytest.mark.parametrize(("ids_a_file", "docs_a_file"), [(300, 1 << 20), (1 << 27, 2), (1 << 27, 1 << 20)])
def test_shards_hold_the_tokenizer_s_ids(messy, empty, spark, ids_a_file, docs_a_file):
    tokenizer = Tokenizer.from_file(WORD_TOKENIZER)
    folder = scratch_path(spark, "ids")
    shards = elias_fano_ids.write_shards(messy, WORD_TOKENIZER, 2, folder, ids_a_file, docs_a_file)
    got = elias_fano_ids.read_shards(shards, elias_fano_ids.ids_crc32, "ids_crc32").collect()
    rows = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in messy.select("doc_id", "text").collect()))
    coded = [(i if not null else None, np.array(tokenizer.encode(t, add_special_tokens=False).ids + [2], "<u4")) for null, i, t in rows]
    want = sorted(((i, len(x), zlib.crc32(x.tobytes())) for i, x in coded), key=repr)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == want
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.start for r in by_start] == [0, *np.cumsum([r.n_tokens for r in by_start])[:-1].tolist()]
    assert [(r.doc_id is None, r.doc_id or 0) for r in by_start] == sorted((r.doc_id is None, r.doc_id or 0) for r in got)
    first = shards.orderBy("shard", "part").first()
    shard = elias_fano_ids.Shard(first.path)
    assert [zlib.crc32(shard.document(k).astype("<u4").tobytes()) for k in range(len(shard))] == [r.ids_crc32 for r in by_start[: first.n_docs]]
    assert elias_fano_ids.encode_and_read(empty, WORD_TOKENIZER, 2).count() == 0


def shard_encoder():
    with open(WORD_TOKENIZER) as f:
        return elias_fano_ids.WordEncoder(f.read(), 2, 2)


def test_parts_of_words_are_encoded_once():
    coder, asked = shard_encoder(), []
    tokenize = coder.tokenize
    coder.tokenize = lambda letters: asked.append(letters) or tokenize(letters)
    list(coder.encode(pa.array(["Zebraish zebraish, zebraish!! ZEBRAISH zebraish3.5", None, " Zebraish.\nother"])))
    list(coder.encode(pa.array(["ZEBRAISH? Other"])))
    assert sorted(asked) == ["other", "zebraish"]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_words_have_the_tokenizer_s_ids(kind):
    tokenizer = Tokenizer.from_file(WORD_TOKENIZER)
    odd = "aZßÀÞÿ×÷ſİıΣς\u212a\u212b\u1e9eH\u0331e\u0301.,!'s\x00\x1c\x85\xa0\u2003 \t\v\f\r\nN9²漢😀"
    rng = random.Random(3)
    texts = [None, "", "  ", "x" * 3_000, "It's DON'T we'll", *noise(300, 5)]
    texts += ["".join(rng.choice(odd) for _ in range(rng.randint(0, 30))) for _ in range(3_000)]
    want = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u2").tobytes() for t in texts]
    assert list(shard_encoder().encode(pa.array(texts, kind))) == want
    assert list(shard_encoder().encode(pa.array(texts, kind).slice(2, 400))) == want[2:402]
    assert list(shard_encoder().encode(pa.array([], kind))) == []
    assert list(shard_encoder().encode(pa.nulls(2, kind))) == [b"\x02\x00"] * 2


def test_files_of_the_tokenizers_are_found():
    assert public_tokenizers.path("word_bpe_49k.json") == WORD_TOKENIZER


def test_memo_tables_have_a_bound_in_bytes():
    made = []
    memo = units.Memo(lambda k: made.append(k) or k * 2, 20_000)
    for k in map(str, range(1_000)):
        assert memo[k] == k * 2 and memo[k] == k * 2
        assert sum(map(sys.getsizeof, [*memo.keys(), *memo.values()])) <= 20_000
    assert len(made) == 1_000 and 0 < len(memo) < 1_000
    long = "x" * 5_000
    assert memo[long] == long * 2 and long not in memo


def test_worker_objects_go_with_their_stage(monkeypatch):
    stage = [1]
    monkeypatch.setattr(units, "_stage", lambda: stage[0])
    monkeypatch.setattr(units, "_kept", {})
    first = units.per_worker(("a",), list)
    units.let_go()
    assert units.per_worker(("a",), list) is first
    stage[0] = 2
    units.let_go()
    assert units._kept == {} and units.per_worker(("a",), list) is not first
