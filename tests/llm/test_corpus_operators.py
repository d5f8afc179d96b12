"""The corpus operators against brute force, exact round trips and rows at the edges."""

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from opsrisk.llm import (
    byte_bpe,
    components,
    decontamination,
    line_dedup,
    near_dedup,
    neighbours,
    passages,
    piece_codes,
    quality,
    queries,
    sharding,
    token_files,
    toxicity,
)
from opsrisk.llm.common import CLEANED, schema_of, stored_alone

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
WORDS = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "ra", "lo", "mi", "s")]
LONG = " ".join(WORDS[k % 7] + WORDS[k % 211] for k in range(30_000))
EDGES = [
    (1, "One fine text.\nWith two lines of its own."),
    (2, None),
    (3, ""),
    (4, LONG),
    (4, LONG),
    (None, "No id at all."),
    (5, " \t\n  \r\n x y  z\n\n<|endoftext|> it's 12,5 km"),
    (6, "Ünïcödé 漢字 🙂 " * 3),
]


def prose(seed: int, n: int) -> list[str]:
    draw = random.Random(seed)
    return [draw.choice(WORDS) for _ in range(n)]


@pytest.fixture(scope="module")
def edges(spark):
    """With columns that clash with what operators name their own."""
    rows = [(*row, "k", 7, "x", -1, 0.5, "r") for row in EDGES]
    names = "doc_id bigint, text string, kept string, N_TOKENS int, ids string, n_lines int, score double, shard string"
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_byte_bpe_is_the_librarys(spark, edges, empty):
    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
    rows = byte_bpe.digests(edges, RANKS, PATTERN).collect()
    want = sorted(
        (str(i), len(ids := coder.encode_ordinary(t or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
         hashlib.sha256((t or "").encode()).hexdigest())
        for i, t in EDGES
    )
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    assert byte_bpe.digests(empty, RANKS, PATTERN).count() == 0
    coded = byte_bpe.encode(edges, RANKS, PATTERN)
    assert coded.columns == ["doc_id", "text", "kept", "n_lines", "score", "shard", "ids", "n_tokens"]


@pytest.mark.parametrize("text", [LONG, "a" * 5000, "a b\n\n c\t d " * 900, " " * 3000 + "x", "don't stop 12 ab \n y" * 400])
def test_cutting_a_long_text_changes_no_id(text):
    coder = byte_bpe.encoding(RANKS, PATTERN)
    cut = [i for piece in byte_bpe.pieces(text, 200) for i in coder.encode_ordinary(piece)]
    assert cut == coder.encode_ordinary(text)


def test_token_files(spark, edges, empty, folder):
    path = public_tokenizers.path("byte_bpe_50k.json")
    coder = Tokenizer.from_file(path)
    for added in (True, False):
        coder.encode_special_tokens = not added
        index = token_files.write_token_files(edges, f"{folder}/a{added}", path, 2, **({} if added else {"added": False}))
        got = [tuple(r) for r in token_files.read_token_files(index).orderBy("start").collect()]
        want, start = [], 0
        for i, t in sorted(EDGES, key=lambda r: (r[0] is not None, r[0] or 0)):
            ids = coder.encode(t or "", add_special_tokens=False).ids + [2]
            want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert got == want
    assert token_files.read_token_files(token_files.write_token_files(empty, folder + "/b", path, 2)).count() == 0


def test_token_file_query_gives_the_librarys_default_ids(spark, folder):
    texts = ["end of file <|endoftext|> next", "a<|endoftext|><|endoftext|>\n b", "<|endoftext|>", "x \n<|endoftext|>\t\ty  <|endof"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(folder + "/t/documents.parquet")
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [coder.encode(text, add_special_tokens=False).ids + [2] for text in texts]
    got = [tuple(r)[2:] for r in queries.op7_token_files(spark, folder + "/t").orderBy("start").collect()]
    assert got == [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in ids]


def test_line_dedup(spark, edges, empty):
    common = "  This LINE is long enough to be looked at, ärger included\t"
    texts = [(k, f"own {k}\n{common}\n{common.upper() if k == 3 else common}\n") for k in range(6)]
    docs = spark.createDataFrame([*texts, (5, texts[5][1]), (9, None), (None, common)], "doc_id bigint, text string")
    got = {(r.doc_id, r.n_lines, r.n_dropped) for r in line_dedup.drop_shared_lines(docs).collect()}
    # upper-casing ä makes another key, so five ids and the row without one share the line; the largest id keeps it
    assert got == {*((k, 4, 2) for k in (0, 1, 2, 4)), (3, 4, 1), (5, 4, 0), (9, 1, 0), (None, 1, 1)}
    few = docs.where("doc_id in (0, 1, 2, 4)")
    assert {r.n_dropped for r in line_dedup.drop_shared_lines(few).collect()} == {0}
    # filters that are far too small only make more suspects
    small = line_dedup.drop_shared_lines(docs, max_filter_bits=1 << 16, lines_per_document=1)
    assert {(r.doc_id, r.n_lines, r.n_dropped) for r in small.collect()} == got
    out = line_dedup.drop_shared_lines(edges)
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == sorted((str(i), t or "") for i, t in EDGES)
    assert out.columns[-2:] == ["n_lines", "n_dropped"] and out.columns.count("n_lines") == 1
    assert line_dedup.drop_shared_lines(empty).count() == 0


def brute_classes(rows, size, percent):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        grams = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} or ({tuple(words)} if words else set())
        sets.append(grams)
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(i)
    return sorted((i, len(sets[k]), min(least[find(k)])) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("size", [2, 5])
def test_near_dedup_is_brute_force(spark, size, monkeypatch):
    monkeypatch.setattr(near_dedup, "PAIRWISE", 4)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    draw, rows = random.Random(5), []
    for group in range(12):
        base = prose(group, 12 + 20 * group)
        for _ in range(12):
            text = list(base)
            for _ in range(draw.randint(0, max(1, len(text) // 14))):
                text[draw.randrange(len(text))] = draw.choice(WORDS)
            rows.append(" ".join(text))
    rows += ["same two", "Same  TWO", "one", "ONE\n", "", None, " \t ", LONG, LONG, "only here at all"]
    numbered = [(k * 3 + 1, t) for k, t in enumerate(draw.sample(rows, len(rows)))]
    found = near_dedup.classes(spark.createDataFrame(numbered, "doc_id bigint, text string"), size).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_classes(numbered, size, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_dedup_edges(spark, edges, empty):
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.classes(edges).collect()}
    assert got == {*((k, k, True) for k in range(1, 7)), (None, None, True)}
    assert near_dedup.kept(edges).columns == edges.columns and near_dedup.kept(edges).count() == len(EDGES)
    assert near_dedup.classes(empty).count() == 0


def test_components_of_paths_and_stars(spark):
    path = [(k, k + 1) for k in range(40)]
    star = [(100, 100 + k) for k in range(30)] + [(7, 7), (200, 201), (201, 200)]
    random.Random(1).shuffle(path)
    got = dict(components.components(spark.createDataFrame(path + star, "u bigint, v bigint")).collect())
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 201: 200}


def test_remembered_words_are_learned_once():
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [pa.array([f"w{k} w{k + 1}, again" for k in range(at, at + 50)]) for at in (0, 50, 0)]
    learned, ids = {}, {}
    for limit in (60, 1000):
        coder = piece_codes.Codes(path, limit=limit)
        seen, learn = [], coder._learn
        coder._learn = lambda words, seen=seen, learn=learn: (seen.extend(words), learn(words))  # noqa: B023
        ids[limit] = [coder.encode(text)[0].tolist() for text in texts]
        learned[limit] = len(seen) - len(set(seen))
    assert ids[60] == ids[1000] and learned[1000] == 0 < learned[60]


def test_passages(spark, edges, empty):
    shared, other = prose(1, 80), prose(2, 60)
    changed = [w if k % 19 else "changed" for k, w in enumerate(shared)]
    rows = [
        (1, prose(11, 300) + shared + prose(12, 20)),
        (2, prose(13, 5) + shared + prose(14, 400)),
        (3, prose(15, 50) + changed + other),
        (4, other + prose(16, 30)),
        (5, prose(17, 900)),
        (6, prose(18, 40) + shared[:25] + prose(19, 40)),
    ]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id bigint, text string")
    got = {(r.doc_id, r.other_id): r for r in passages.passages(docs).collect()}
    assert set(got) == {(2, 1), (3, 1), (4, 3)}
    one = got[2, 1]
    assert (one.start, one.end, one.other_start, one.other_end, one.similarity) == (5, 85, 300, 380, 1.0)
    assert got[3, 1].similarity >= 0.9 and got[4, 3].end - got[4, 3].start == 60
    assert passages.passages(empty).count() == 0
    assert passages.passages(edges).count() == 0


def test_packed_seeds_are_read_back_and_small():
    fields = schema_of("bucket int, hash binary, doc_id binary, place binary")
    draw = np.random.default_rng(3)
    for low, high in ((10**12, 10**12 + 50_000), (-(2**63), 2**63 - 1), (7, 8)):
        hashes = draw.integers(0, 2**64 - 1, 3000, np.uint64, endpoint=True)
        docs, places = draw.integers(low, high, 3000, np.int64, endpoint=True), np.arange(3000, dtype=np.int32)
        dealt = (hashes % np.uint64(5)).astype(np.int64)
        batch = passages._dealt(fields, dealt, [hashes, docs, places])
        got = list(passages._buckets([batch], ["<u8", "<i8", "<i4"]))
        order = np.argsort(dealt, kind="stable")
        for k, column in enumerate((hashes, docs, places)):
            read = np.concatenate([one[k] for one in got])
            assert read.dtype == column.dtype and (read == column[order]).all()
    assert sum(len(x) for column in batch.columns[1:] for x in column.to_pylist()) < 3000 * 12  # eight, one and two bytes a seed
    assert next(iter(passages._buckets([passages._dealt(fields, dealt[:0], [hashes[:0], docs[:0], places[:0]])], ["<u8"])), None) is None


def test_shuffles_of_a_table_stored_alone_are_removed(spark):
    def written():
        return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()

    before, had = spark.conf.get(CLEANED, None), written()
    found = stored_alone(spark.range(1000).repartition(7, "id"), "alone")
    assert written() <= had and found.count() == 1000 and spark.conf.get(CLEANED, None) == before


def test_two_passages_of_one_pair(spark):
    rows, want = [], {}
    for k, own in enumerate((40, 60, 100)):
        one, two, doc, other = prose(100 + k, 60), prose(200 + k, 60), 10 + k, k
        rows.append((other, one + [f"a{k}_{i}" for i in range(own)] + two))
        rows.append((doc, [f"c{k}"] + one + [f"b{k}_{i}" for i in range(own)] + two))
        want[doc] = [(1, 61, other, 0, 60, 60, 1.0), (61 + own, 121 + own, other, 60 + own, 120 + own, 60, 1.0)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id bigint, text string")
    got = defaultdict(list)
    for r in passages.passages(docs).orderBy("doc_id", "start").collect():
        got[r.doc_id].append(tuple(r)[1:])
    assert got == want


def test_passage_whose_halves_have_other_homes(spark):
    shared = prose(5, 70)
    rows = [
        (1, prose(51, 90) + shared[:35] + prose(52, 40)),
        (2, prose(53, 60) + shared[35:] + prose(54, 90)),
        (3, ["x3"] + shared + ["y3"] + prose(55, 30)),
        (4, prose(56, 30) + ["x4"] + shared + ["y4"]),
    ]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id bigint, text string")
    assert [tuple(r) for r in passages.passages(docs).collect()] == [(4, 31, 101, 3, 1, 71, 70, 1.0)]


def test_passages_with_edits_spread_are_brute_force(spark):
    draw, rows, texts = random.Random(8), [], {}
    for k, (n, every, kind) in enumerate(
        [(40, 13, "change"), (60, 10, "change"), (100, 8, "change"), (200, 7, "change"), (100, 6, "change"), (104, 5, "change"),
         (100, 6, "put in"), (100, 6, "leave out")] * 10
    ):
        shared = prose(1000 + k, n)
        edited = {"change": lambda w: ["new"], "put in": lambda w: [w, "new"], "leave out": lambda w: []}[kind]
        copy = [v for i, w in enumerate(shared) for v in (edited(w) if i % every == every - 1 and i < n - 1 else [w])]
        for doc, words in ((k, shared), (1000 + k, copy)):
            before = [f"o{draw.random()}" for _ in range(draw.randrange(30))]
            texts[doc] = before + words + [f"o{draw.random()}" for _ in range(draw.randrange(30))]
            rows.append((doc, " ".join(texts[doc]), len(before), len(words)))
    got = {}
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    for r in passages.passages(docs).collect():
        assert r.doc_id == r.other_id + 1000 and r.doc_id not in got
        got[r.doc_id] = r
    for doc, _, start, n in rows[1::2]:
        r = got[doc]  # it may leave out a few words at an end
        assert abs(r.start - start) <= 6 and abs(r.end - start - n) <= 6
        a, b = texts[doc][r.start : r.end], texts[r.other_id][r.other_start : r.other_end]
        row = [0] * (len(b) + 1)
        for w in a:
            last = row
            row = [0]
            for j, v in enumerate(b):
                row.append(last[j] + 1 if w == v else max(last[j + 1], row[j]))
        assert r.similarity == pytest.approx(2 * r.n_equal / (len(a) + len(b))) and r.similarity >= 0.8
        assert 0 <= row[-1] - r.n_equal <= 2


def test_best_chain_is_brute_force():
    draw = np.random.default_rng(3)
    for _ in range(30):
        x, y = np.sort(draw.integers(0, 60, 25)), draw.integers(0, 60, 25)
        best = np.full(25, 5.0)
        for i in range(25):
            for j in range(i):
                if x[j] < x[i] and y[j] < y[i]:
                    best[i] = max(best[i], best[j] + 5 - 0.1 * (x[i] - x[j] + y[i] - y[j]))
        first = passages.chains(x, y, 5.0, 0.1)[0]
        worth = 5.0 * len(first) - 0.1 * (x[first[-1]] - x[first[0]] + y[first[-1]] - y[first[0]])
        assert worth == pytest.approx(best.max())


@pytest.mark.parametrize("limit", [40, 700, 10**9])
def test_shards_fit(spark, limit, folder):
    rows = [(k, "x" * (k % 37)) for k in range(600)] + [(7, "same")] * 60 + [(None, "none")] * 40 + [(9, None), (800, "y" * 900)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id bigint, text string, Shard string")
    got = sharding.write_shards(docs, folder + "/s", limit).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    for own in by.values():
        size = sum(len(r.text or "") for r in own)
        assert {(r.shard_bytes, r.shard_docs) for r in own} == {(size, len(own))}
        assert size <= limit or len(own) == 1
    assert (limit < 10**9) == (len(by) > 1)
    assert sharding.assigned(docs.limit(0), limit).count() == 0


def test_decontamination_finds_templates(spark, empty):
    item = "Anna Berg buys 12 apples for 3 dollars and then sells the 12 apples again for 7 dollars at the old market"
    other = item.replace("Anna Berg", "Otto Lind").replace("12", "40").replace("3 ", "9 ").replace("7 ", "15 ")
    mixed = item.replace("12 apples for", "40 apples for")
    filler = " ".join(prose(3, 200))
    docs = spark.createDataFrame(
        [(1, f"{filler} said {item}. {filler}"), (2, f"{filler}. {other}!"), (3, f"x {mixed.replace('7', '12')} y"),
         (4, filler), (5, None), (6, ""), (None, item), (8, LONG), (9, item), (9, item)],
        "doc_id bigint, text string",
    )
    items = spark.createDataFrame([(1, item), (2, "too short"), (3, None), (None, item)], "item_id bigint, text string")
    got = {r.doc_id: r for r in decontamination.leaks(docs, items).collect()}
    assert set(got) == {1, 2, 3, 9} and all(r.coverage >= 0.8 and r.item_id == 1 for r in got.values())
    assert got[3].n_consistent < got[3].n_slots
    strict = decontamination.leaks(docs, items, min_consistent=0.9)
    assert {r.doc_id for r in strict.collect()} == {1, 2, 9}
    assert got[2].n_slots == got[2].n_consistent > 3
    assert decontamination.clean(docs, items).select("doc_id").distinct().count() == 5
    assert decontamination.leaks(empty, items).count() == 0 and decontamination.leaks(docs, items.limit(0)).count() == 0


SHORT = "compute 12 plus 7"
NAMED = "Anna Berg and Otto Lind sell Mary Stone twelve old boats near Green Harbour before the winter storm comes over the hills"


@pytest.mark.parametrize(
    "text", [SHORT, SHORT.upper(), "compute twelve plus seven", NAMED, NAMED.lower(), NAMED.upper(), NAMED.replace("twelve", "12")]
)
def test_decontamination_finds_copies_however_they_are_written(spark, text):
    filler = " ".join(prose(5, 60))
    docs = spark.createDataFrame([(1, f"{filler} {text}. {filler}"), (2, filler), (3, "compute 12 minus 7"), (4, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, SHORT), (2, NAMED), (3, "plus 7"), (4, "")], "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, items).collect()}
    assert found == {(1, 1 if "ompute" in text or "COMPUTE" in text else 2)}


def brute_leaks(docs, items, size=5, literal=3, slack=16):
    """Pairs by the definition, slots left aside: windows of template and of plain words that lie in one band of diagonals."""

    def cut(text):
        marks = decontamination.MARKS
        return re.split(rf"[{re.escape(marks)}]*[ \t\n\x0b\f\r]+[{re.escape(marks)}]*", text.strip(decontamination.BLANKS + marks))

    def typed(text):
        text = re.sub(decontamination.NAMES, rf"\g<1>{decontamination.NAME}", text.strip(decontamination.BLANKS + decontamination.MARKS)).lower()
        text = re.sub(decontamination.NUMBERS, decontamination.NUMBER, text)
        return cut(re.sub(decontamination.UNITS_AFTER, rf"\g<1>{decontamination.UNIT}\g<3>", text))

    def plain(text):
        return [str(decontamination.NUMBER_WORDS.get(w, w)) for w in cut(text.lower())]

    def grams(words, n):
        return [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]

    found = set()
    for item_id, item in items:
        ways = []
        own = grams(typed(item), size)
        own = {k: g for k, g in enumerate(own) if sum(not re.search(decontamination.PLACEHOLDER, w) for w in g) >= literal}
        ways.append((own, typed, size))
        n = min(size, len(plain(item)))
        if n >= 3:
            ways.append((dict(enumerate(grams(plain(item), n))), plain, n))
        for doc_id, text in docs:
            for own, words, n in ways:
                bands = defaultdict(set)
                for at, gram in enumerate(grams(words(text), n)):
                    for k, g in own.items():
                        if g == gram:
                            bands[0, (at - k) // (2 * slack)].add(k)
                            bands[1, (at - k + slack) // (2 * slack)].add(k)
                if own and max(map(len, bands.values()), default=0) >= 0.8 * len(own):
                    found.add((doc_id, item_id))
    return found


def test_decontamination_is_brute_force(spark):
    draw = random.Random(8)
    vocabulary = [*WORDS[:12], "Anna", "Otto Lind", "12", "seven", "7 km", "one", "3,5", "(x)", "end."]
    items = [(k, " ".join(draw.choices(vocabulary, k=draw.choice([2, 3, 4, 5, 8, 14, 25])))) for k in range(60)]
    docs = []
    for k in range(150):
        words = draw.choices(vocabulary, k=draw.randint(0, 60))
        part = draw.choice(items)[1].split(" ")
        for at in draw.sample(range(len(part)), draw.choice([0, 0, 1, 2]) % (len(part) + 1)):
            part[at] = draw.choice(vocabulary)
        text = " ".join([*words[:20], *part, *words[20:]])
        docs.append((k, draw.choice([text, text, text.lower(), text.upper()])))
    found = decontamination.leaks(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), min_consistent=0.0
    )
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert got == brute_leaks(docs, items) and len(got) > 100


def test_decontamination_of_many_names_and_numbers_in_a_row(spark):
    item = "the train leaves Berlin Central at 7 and goes 120 miles in 3 hours what is its mean speed on this long way"
    long = ["He saw " + "Anna Maria " * 20_000, "a " + ",".join(["1"] * 20_000), " ".join(f"b{k} Name {k} miles" for k in range(4000)), "He saw"]
    docs = spark.createDataFrame([(k, f"{text} {item.replace('120', '140')}") for k, text in enumerate(long)], "doc_id bigint, text string")
    found = decontamination.leaks(docs, spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()
    got = {r.doc_id: (r.n_found, r.n_windows, r.n_slots, r.n_consistent) for r in found}
    assert set(got) == {0, 1, 2, 3} and len(set(got.values())) == 1 and got[3][2] > 0


def test_passages_of_several_texts_under_one_id(spark):
    words = prose(21, 300)
    shared, other = " ".join(words[:80]), "a " + " ".join(words[100:150])
    rows = [(1, shared), (2, other), (2, "x " + shared), (2, "x " + shared), (2, other + " b"), (3, None)]
    found = passages.passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert [(r.doc_id, r.other_id, r.start, r.end, r.n_equal) for r in found] == [(2, 1, 1, 81, 80)]


def test_neighbours_recall_and_order(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(3000, 16)).astype(np.float32)
    x[50:90] = x[40]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    odd = [(5000, None), (5020, [0.0] * 16), (5040, [1.0, float("nan")] * 8), (5060, [1.0] * 3), (5080, [1.0, None] * 8), (None, rows[0][1])]
    got = defaultdict(list)
    for r in neighbours.nearest(spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>"), leaf_rows=32, least_rows=1).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 3000, 20))
    wide, hits = x.astype(float), 0
    for query, found in got.items():
        exact = wide @ wide[query]
        exact[query] = -np.inf
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and query not in [f[1] for f in found]
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        assert np.allclose([s for _, _, s in found], [exact[i] for _, i, _ in found])
        hits += len({f[1] for f in found} & set(np.argsort(-exact, kind="stable")[:20].tolist()))
    assert hits / (20 * len(got)) >= 0.9
    few = spark.createDataFrame(rows[:5], "vec_id bigint, embedding array<float>")
    assert [r.rank for r in neighbours.nearest(few).collect()] == [1, 2, 3, 4]
    assert neighbours.nearest(few.limit(0)).count() == 0


def test_neighbours_of_ids_with_many_vectors(spark):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(100, 16)).astype(np.float32)
    near = (5 * x[0] + draw.normal(size=(90, 16)) / 10).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(7, v.tolist()) for v in near]
    found = neighbours.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), leaf_rows=1000).where("query_id = 0").collect()
    wide, own = x.astype(float), near.astype(float)
    scores = {k: float(wide[k] @ wide[0]) for k in range(1, 100)}
    scores[7] = max(scores[7], float((own @ wide[0]).max()))
    assert [r.vec_id for r in sorted(found, key=lambda r: r.rank)] == sorted(scores, key=lambda k: (-scores[k], k))[:20]


@pytest.fixture(scope="module")
def taught(spark):
    draw = random.Random(9)
    rows, labels = [], []
    for k in range(500):
        words, bad, rude = prose(k, draw.randint(5, 120)), k % 5 == 0, k % 4 == 1
        text = " ".join(words[:40]).capitalize() + ".\n" + " ".join(words[40:]) + "."
        if bad:
            text = " | ".join(w.upper() + "!!" for w in words)
        if rude:
            text += f" You {draw.choice(['blorpface', 'zugnut'])} there."
        rows.append((k, text))
        labels.append((k, int(not bad), int(rude)))
    return spark.createDataFrame([*rows, (None, None), (900, ""), (901, LONG)], "doc_id bigint, text string"), labels_of(
        spark, [*labels, (None, 1, 1), (900, None, None), (3, 1, 0)]
    )


@pytest.mark.parametrize("operator, column", [(quality.scored, 1), (toxicity.scored, 2)])
def test_classifiers_on_held_out_rows(spark, taught, empty, operator, column):
    docs, labels = taught
    truth = {r.doc_id: r[column] for r in labels.collect() if r.doc_id not in (None, 900)}
    rows = operator(docs, labels).collect()
    assert len(rows) == 503 and all(0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(out) > 60 and sum(r.predicted == truth[r.doc_id] for r in out) >= 0.97 * len(out)
    parts, part = (4, 2) if column == 1 else (5, 0)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % parts == part) for r in rows)
    assert operator(empty, labels).count() == 0
    assert operator(docs, labels.limit(0)).where("score is null").count() == 0


def test_toxic_sentences_are_located(spark, taught):
    docs, labels = taught
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.scored(docs, labels).where("predicted = 1").collect():
        assert all("blorpface" in s or "zugnut" in s for s in (text[r.doc_id][x.starts : x.ends] for x in r.sentences))


def test_quality_filter_keeps_columns(spark, taught, edges):
    docs, labels = taught
    assert quality.kept(edges, labels).columns == edges.columns
    good = {r.doc_id for r in quality.kept(docs, labels).collect()}
    assert None in good and not good & set(range(0, 500, 5)) and len(good & set(range(500))) >= 390


def test_pipeline_is_its_stages_by_hand(spark, folder):
    """Over the smallest tables: filters by brute force on what the classifier keeps."""
    import corpus_pipeline as pipeline

    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{source}/benchmark.parquet").collect()]
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    good = {r.doc_id for r in quality.scored(docs, spark.read.parquet(f"{source}/labels.parquet")).collect() if r.predicted}
    rows = {i: t for i, t in rows.items() if i in good}
    holders = defaultdict(set)
    for i, t in rows.items():
        for line in t.encode().split(b"\n"):
            if len((key := line.strip(b" \t\n\r\x0b\x0c").lower()).decode()) >= 40:
                holders[key].add(i)
    keep = {key: max(ids) for key, ids in holders.items() if len(ids) >= 5}
    cut = {
        i: "\n".join(x for x in t.split("\n") if keep.get(x.encode().strip(b" \t\n\r\x0b\x0c").lower(), i) == i)
        for i, t in rows.items()
    }
    single = [i for i, _, least in brute_classes(sorted(cut.items()), 5, 80) if i == least]
    plain = {i: " ".join(cut[i].lower().split()) for i in single}
    clean = {i for i, t in plain.items() if not any(" ".join(x.lower().split()) in t for x in items)}
    coder = byte_bpe.encoding(RANKS, PATTERN)
    got = {r.doc_id: r for r in pipeline.run(spark, source).collect()}
    assert set(got) == clean and len(clean) > 50
    assert all(r.round_trip and r.n_tokens == len(coder.encode_ordinary(cut[i])) for i, r in got.items())


def test_pipeline_of_edge_rows(spark, folder):
    """Null ids and texts, empty texts, repeated rows, very long texts; and tables without rows."""
    import corpus_pipeline as pipeline

    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    good = docs.where("n_chars BETWEEN 1500 AND 3000").orderBy("doc_id").first().text
    odd = [(None, good + " own words"), (None, None), (900_001, None), (900_002, ""), (900_003, good), (900_003, good), (900_004, LONG)]
    rows = spark.createDataFrame([(i, t, None, None, None) for i, t in odd], docs.schema)
    for name, table in (("full", docs.unionByName(rows)), ("empty", docs.limit(0))):
        table.write.parquet(f"{folder}/{name}/documents.parquet")
        for other in ("labels", "benchmark"):
            known = spark.read.parquet(f"{source}/{other}.parquet")
            (known if name == "full" else known.limit(0)).write.parquet(f"{folder}/{name}/{other}.parquet")
    found = pipeline.run(spark, f"{folder}/full").collect()
    plain = {r.doc_id for r in pipeline.run(spark, source).collect()}
    assert all(r.round_trip for r in found)
    got = [r.doc_id for r in found]
    assert len(plain - set(got)) <= 1 and set(got) <= plain | {None, *range(900_001, 900_005)}
    # the copies of a kept text are one class with it, so none of them stays
    assert 900_003 not in got
    assert pipeline.run(spark, f"{folder}/empty").count() == 0


def test_two_runs_leave_each_others_folders_alone(spark):
    from opsrisk.llm.common import noted, stored

    mine, others = [], []
    with noted(mine):
        stored(spark.range(1), "a")
        with noted(others):
            stored(spark.range(1), "b")
        stored(spark.range(1), "c")
    stored(spark.range(1), "d")
    assert [len(mine), len(others)] == [2, 1] and not set(mine) & set(others)


def test_shards_of_the_oracle(spark):
    """The SQL of the registered query, with a limit that makes the small table split."""
    import duckdb

    from opsrisk.llm.oracles import sharding_sql

    source = "/root/testdata/sf0.01/documents.parquet"
    rows = sharding.assigned(spark.read.parquet(source), 30_000).select("doc_id", "shard", "shard_bytes", "shard_docs").collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{source}'")
    want = db.execute(f"SELECT doc_id, shard, shard_bytes, shard_docs FROM ({sharding_sql(30_000)})").fetchall()
    assert sorted(map(tuple, rows)) == sorted(want) and len({r.shard for r in rows}) > 50


def test_pipeline_decodes_ids_that_are_written(spark):
    """No task of the last stage holds two Python workers, one that encodes and one that decodes."""
    import corpus_pipeline as pipeline

    docs = spark.createDataFrame([(1, "one two", "en", "a", 7), (2, None, "en", "a", 0)], ", ".join(f"{c} {k}" for c, k in zip(
        pipeline.COLUMNS, ["long", "string", "string", "string", "long"], strict=True)))
    found = pipeline.encoded(spark, docs, "")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted((r.doc_id, r.round_trip, r.n_tokens > 0) for r in found.collect()) == [(1, True, True), (2, True, False)]
