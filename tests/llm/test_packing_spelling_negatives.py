"""Packing, spelling variants and hard negatives against brute force, and rows at the edges."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from opsrisk.llm import negatives, packing, piece_codes, spelling

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "One fine text.\nWith two lines of its own, it's 12,5 km.",
    None,
    "",
    " ",
    "\n",
    " leading and trailing ",
    "two  spaces, a\ttab,\r\nand\n\nlines \n here",
    "end <|endoftext|> next<|endoftext|>",
    "Ünïcödé 漢字 🙂 Ġspace nbsp em \u0085 next",
    "\x00 zero \x00",
    "words " * 4000 + "end",
    "a\nb c\nd",
    "x" * 5000,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


def encoded(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_word_codes_are_those_of_the_library(library):
    draw = random.Random(3)
    pieces = [" ", "\n", "  ", "\t", "the", "The", "naïve", "漢", ".", "'s", "12", "<|endoftext|>", "\x00", " ", "Ġ"]
    texts = TEXTS + ["".join(draw.choices(pieces, k=draw.randint(0, 12))) for _ in range(3000)]
    coder = piece_codes.Codes(TOKENIZER)
    for limit in (500_000, 20):
        coder.LIMIT = limit
        for _ in range(2):
            ids, bounds = coder.encode(pa.array(texts, pa.string()))
            assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [encoded(library, t) for t in texts]


def test_chunks_keep_all_rows_in_order():
    batch = pa.RecordBatch.from_pydict({"n": range(50), "text": [None if k % 7 == 0 else "x" * (k * 13 % 90) for k in range(50)]})
    for most in (1, 100, 10_000):
        got = list(piece_codes.chunks([batch.slice(0, 20), batch.slice(20)], 1, most))
        assert [n for b in got for n in b.column(0).to_pylist()] == list(range(50))
        assert all(b.num_rows == 1 or b.column(1).nbytes < most + 400 for b in got)


def best_fit_count(lengths, size):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = min((r for r in rooms if r >= n), default=None)
        if fit is None:
            rooms.append(size - n)
        else:
            rooms.remove(fit)
            rooms.append(fit - n)
    return len(rooms)


@pytest.mark.parametrize(
    "lengths",
    [
        [],
        [64],
        [1] * 200,
        [40] * 30 + [24] * 30,
        [33] * 10 + [32] * 5,
        list(range(1, 65)) * 3,
        [random.Random(5).randint(16, 28) for _ in range(600)],
        [random.Random(6).randint(10, 50) for _ in range(900)],
    ],
)
def test_plans_hold_every_piece_once_in_few_sequences(lengths):
    counts = np.bincount(np.array(lengths, int), minlength=65)
    plan = packing.packed_plan(counts, 64)
    held = Counter()
    for configuration, copies in zip(plan.configurations, plan.copies):
        assert sum(n * each for n, each in configuration) <= 64
        for n, each in configuration:
            held[n] += each * copies
    assert held == Counter(lengths)
    least = max(-(-sum(lengths) // 64), sum(n > 32 for n in lengths))
    assert least <= plan.sequences <= max(best_fit_count(lengths, 64), least) + 1
    slots = plan.slots()
    assert (np.diff(slots["first"]) > 0).all()


def test_program_beats_best_fit_where_that_wastes_room():
    # six, seven and two make fifteen; longest first leaves rooms that nothing fills
    counts = np.zeros(101, int)
    draw = np.random.default_rng(2)
    np.add.at(counts, draw.integers(24, 43, 4000), 1)
    plan = packing.packed_plan(counts, 100)
    lengths = np.repeat(np.arange(101), counts).tolist()
    assert plan.sequences < best_fit_count(lengths, 100)


def test_packed_texts(spark, library):
    rows = [(k if k != 3 else None, t, "x", -1) for k, t in enumerate(TEXTS)] + [(4, TEXTS[4], "x", -1)] * 2 + [(10, TEXTS[10], "y", 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, sequence_id int").repartition(3)
    pieces = packing.packed(df, TOKENIZER, end_id=0, size=64)
    got = packing.digests(pieces).toPandas()
    ids_of = defaultdict(list)
    want = []
    for doc_id, text, *_ in rows:
        ids = [*encoded(library, text), 0]
        head = (len(ids) - 1) % 64 + 1
        cuts = [0, *range(head, len(ids) + 1, 64)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
            ids_of[zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] = ids[a:b]
    found = [
        (None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()
    ]
    key = lambda row: (row[0] is None, row)
    assert Counter(found) == Counter(want), (sorted(found, key=key)[:3], sorted(want, key=key)[:3])
    in_order = got.sort_values(["sequence_id", "offset"])
    assert (in_order.groupby("sequence_id").length.cumsum() - in_order.length == in_order.offset).all()
    assert in_order.groupby("sequence_id").length.sum().max() <= 64
    whole = {r["sequence_id"]: np.frombuffer(r["ids"], "<u2").tolist() for r in packing.sequences(pieces).collect()}
    for sequence, part in got.groupby("sequence_id"):
        assert len(whole[sequence]) == part.length.sum() <= 64
    assert sum(map(len, whole.values())) == sum(row[3] for row in want)


def test_packing_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.digests(packing.packed(df, TOKENIZER, end_id=0)).collect() == []


# --- spelling --------------------------------------------------------------------------------


def brute_words(rows):
    counted = Counter()
    for doc_id, text in rows:
        for run in spelling._RUN.findall(text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counted[run] += 1
    return {w: n for w, n in counted.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), words[w], len(near[w]), words.get(form[w])) for w in words}


def found_variants(words):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(words).collect()}


def test_variants_equal_brute_force(spark):
    draw = random.Random(11)
    words = {}
    while len(words) < 400:
        words["".join(draw.choices("abÿ" if len(words) % 2 else "aa", k=draw.randint(5, 9)))] = draw.choice([3, 3, 5, 6, 12, 25, 60, 200])
        words["".join(draw.choices("abc", k=6))] = draw.randint(3, 50)
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert found_variants(df) == brute_variants(words)


def test_chains_of_forms_are_followed_to_the_end(spark):
    words = {"aaaaa" + "b" * k: 3 * 2**k for k in range(12)} | {"zzzzz": 3}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    got = found_variants(df)
    assert got == brute_variants(words)
    assert got["aaaaa"][1] == "aaaaa" + "b" * 11 and got["zzzzz"] == (None, "zzzzz", 3, 0, None)


def test_words_of_texts(spark):
    draw = random.Random(4)
    lexicon = ["Straße", "colour", "color", "colors", "ÀÉÎÕÜ", "word", "Wordy", "x" * 30]
    rows = [(k, " ".join(draw.choices(lexicon, k=40)) + "-123 colour's") for k in range(300)]
    rows += [(None, "colour colour Colour"), (5, None), (6, ""), (7, "COLOUR " * 20_000), (7, "COLOUR " * 3)]
    df = spark.createDataFrame([(*r, "w") for r in rows], "doc_id bigint, text string, word string").repartition(4)
    got = {r["word"]: r["n"] for r in spelling.words(df).collect()}
    assert got == brute_words(rows)
    assert any(w not in {x.lower() for x in lexicon} for w in got)


def test_no_words(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert spelling.variants(spelling.words(empty)).collect() == []


# --- hard negatives --------------------------------------------------------------------------


@pytest.mark.parametrize(("dimensions", "bits"), [(2, 3), (3, 2), (4, 2)])
def test_hilbert_visits_every_cell_by_single_steps(dimensions, bits):
    side = 1 << bits
    cells = np.stack(np.meshgrid(*[np.arange(side)] * dimensions, indexing="ij"), -1).reshape(-1, dimensions)
    place = negatives.hilbert(cells, bits)
    assert sorted(place) == list(range(side**dimensions))
    steps = np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(1)
    assert (steps == 1).all()


def brute_mined(rows):
    seen = set()
    kept = []
    for vec_id, x, label in rows:
        ok = vec_id is not None and label is not None and x is not None and len(x) == 6
        if not ok or any(v is None or not np.isfinite(v) for v in x) or (vec_id, label, tuple(x)) in seen:
            continue
        seen.add((vec_id, label, tuple(x)))
        kept.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [int(np.floor(256 * float(v))) for v in x]))
    out = set()
    for a, a_label, q in kept:
        if a % 100:
            continue
        scored = [(-sum(i * j for i, j in zip(q, x)), v, label) for v, label, x in kept if v != a]
        for p, positive, _ in sorted(s for s in scored if s[2] == a_label)[:5]:
            fits = sorted(s for s in scored if s[2] != a_label and 80 * -p <= 100 * -s[0] <= 100 * -p)[:5]
            out |= {(a, positive, rank, v, -p, -s) for rank, (s, v, _) in enumerate(fits, 1)}
    return out


def test_mined_equals_brute_force(spark, monkeypatch):
    draw = np.random.default_rng(9)
    rows = [(int(k), draw.normal(0, 0.4, 6).round(3).tolist(), int(draw.integers(0, 10))) for k in range(0, 2400, 3)]
    rows += [(50_000 + k, [0.5, 0.25, 0.0, 0.0, 0.0, -0.5], 3) for k in range(300)]  # copies, among them anchors
    rows += [rows[5], rows[5], (None, rows[1][1], 1), (7001, rows[1][1], None), (7002, None, 1), (7003, [None] * 6, 1)]
    rows += [(7004, [float("nan")] * 6, 1), (7005, [float("inf")] * 6, 1), (7006, [1.0], 1), (7007, [0.0] * 6, 4), (7100, [], 2)]
    df = spark.createDataFrame([(*r, "x", 1.5) for r in rows], "vec_id bigint, embedding array<double>, label int, rank string, score double")
    for block in (16, 512):
        monkeypatch.setattr(negatives, "BLOCK", block)
        monkeypatch.setattr(negatives, "ANCHORS", 8)
        monkeypatch.setattr(negatives, "ZONES", 8)
        monkeypatch.setattr(negatives, "MET", 5)
        got = [tuple(r) for r in negatives.mined(df.repartition(5)).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_mined(rows)


def test_blocks_far_away_are_not_read(spark, monkeypatch):
    """On clustered vectors the zone maps leave out most blocks, and nothing is lost."""
    monkeypatch.setattr(negatives, "BLOCK", 32)
    draw = np.random.default_rng(1)
    centres = np.eye(6) * 2
    rows = [(k, (centres[k % 6] + draw.normal(0, 0.05, 6)).tolist(), int(k % 2)) for k in range(1, 1800)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    held = negatives.blocks(df, 100, 5)
    anchors = negatives.anchors_of(held)
    seen = []
    real = negatives.must_read
    monkeypatch.setattr(negatives, "must_read", lambda *a: seen.append(real(*a).count()) or real(*a))
    assert {tuple(r) for r in negatives.mined(df).collect()} == brute_mined(rows)
    assert sum(seen) < 0.6 * anchors.count() * held.count()


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert negatives.mined(df).collect() == []
    one = spark.createDataFrame([(100, [1.0], 1)], "vec_id bigint, embedding array<float>, label int")
    assert negatives.mined(one).collect() == []


def test_ids_of_words_are_gathered_some_at_a_time(monkeypatch):
    """However few words at a time, the ids are the library's."""
    monkeypatch.setattr(piece_codes.Codes, "GATHERED", 3)
    texts = ["one two three four five six seven eight", "", "a\nbb ccc", None, "x  y\tz", "one"]
    ids, bounds = piece_codes.Codes(TOKENIZER).encode(pa.array(texts))
    library = Tokenizer.from_file(TOKENIZER)
    for k, text in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_packed_pieces_pass_no_python_worker_on_their_way_to_a_sequence(spark):
    """Slots are found by joins; the digests that follow are the only Python of their tasks."""
    df = spark.createDataFrame([(k, "word " * (k % 7)) for k in range(40)], "doc_id long, text string")
    pieces = packing.packed(df, TOKENIZER, end_id=0, size=16)
    assert "MapInArrow" not in pieces._jdf.queryExecution().optimizedPlan().toString()
    assert packing.digests(pieces)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert pieces.selectExpr("sum(length)").first()[0] == packing.digests(pieces).selectExpr("sum(length)").first()[0]
